"""Sessions: settings that fit the jobs, and the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, app: str = "corpusmill", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; master and partitions are left to the cluster unless given."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        b = b.config(key.replace("_", "."), value)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, made known to Spark. Only a local master without the setting gets a fresh local folder; a cluster must name a shared one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(rows: DataFrame) -> DataFrame:
    """rows, computed now and written as a table into the shared folder, for results that several later steps read.

    Unlike a cache it is computed once also where its readers start together, and outlives the executors that made it.
    """
    path = f"{checkpoint_dir(rows.sparkSession)}/stored/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as there are cores, where they fill less than half of them: a few small files. Larger inputs stay as they are read.

    For tables as they are read: asking a joined frame for its tasks would already run its shuffles.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows
