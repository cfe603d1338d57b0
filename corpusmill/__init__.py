"""corpusmill: Spark jobs that turn crawled web pages into a retrieval-ready text corpus."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors inside the job, so the cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
