"""The manifest kept up to date from a stream of entries.

The state is cut into buckets of domains. A micro-batch runs the same frames as a batch job over the buckets that it touches and writes those again, under the
number of the batch; the others stay where they are. A batch that is run again after a failure writes the same files once more. Of each bucket
the version before the current one is kept, older ones go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators import corpus

BUCKETS = 256


def _versions(spark: SparkSession, root: str, number: int) -> dict[int, tuple[int, int | None]]:
    """Current version and the one before it of every bucket that has any, after a batch; at most BUCKETS rows."""
    if number < 0:
        return {}
    rows = spark.read.parquet(f"{root}/versions/{number}").collect()
    return {r.bucket: (r.version, r.before) for r in rows}


def _path(root: str, bucket: int, version: int) -> str:
    return f"{root}/state/bucket={bucket}/version={version}"


def read_state(spark: SparkSession, root: str, number: int, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """The manifest after a batch, or some buckets of it."""
    paths = [_path(root, b, v) for b, (v, _) in _versions(spark, root, number).items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_batch(root: str, batch: DataFrame, number: int) -> None:
    """Writes the touched buckets after a batch: the survivors of their state before and the batch."""
    spark, bucket = batch.sparkSession, F.pmod(F.xxhash64("domain"), F.lit(BUCKETS)).cast("int")
    touched = sorted(r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect())
    known = _versions(spark, root, number - 1)
    if touched:
        kept = corpus.survivors(read_state(spark, root, number - 1, batch.schema, touched).unionByName(batch))
        rows = kept.withColumns({"bucket": bucket, "version": F.lit(number)})
        rows.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "version").parquet(f"{root}/state")
    now = known | {b: (number, known[b][0] if b in known else None) for b in touched}
    spark.createDataFrame([(b, v, w) for b, (v, w) in now.items()], "bucket int, version int, before int").coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/{number}")
    for old in [_path(root, b, known[b][1]) for b in touched if b in known and known[b][1] is not None]:
        where = spark._jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def read_entries(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_manifest(entries: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a stream of manifest entries into the state under root; start() it with any trigger."""
    return entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: upsert_batch(root, batch, number))
