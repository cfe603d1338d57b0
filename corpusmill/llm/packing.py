"""Problem 7: documents into containers of fixed capacity, nearly full, by the sum-of-squares rule.

Sizes are token counts. A document above the capacity gives full pieces, each a container of its own, and one rest;
every other document is one item. Items are spread over blocks of about BLOCK documents by hash, and each block is packed
by itself in one task, so tasks stay bounded and a block leaves only a handful of containers unfinished. An item goes where
the sum of squares of the numbers of open containers per gap becomes smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import table, texts
from .tokens import VOCABULARY, token_counts

#: Documents a block; a block's containers are packed in one task.
BLOCK = 16_384
LIMITS = ("context_small", "context_large")


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item (0 < size <= capacity), in the order given.

    Among equally good places the one that leaves the smallest gap wins, an open container before a new one.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers per gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = np.arange(capacity + 1)
    out, used = [], 0
    for size in sizes:
        gap = capacity
        if size < capacity:
            have = gaps[size:capacity][count[size:capacity] > 0]
            if len(have):
                left = have - size
                change = np.where(left > 0, 2 * count[left] + 1, 0) - 2 * count[have] + 1
                best = int(np.argmin(change))  # the first is the smallest gap
                if change[best] <= 2 * count[capacity - size] + 1:
                    gap = int(have[best])
        if gap == capacity:
            here, used = used, used + 1
        else:
            count[gap] -= 1
            here = open_[gap].pop()
        out.append(here)
        if gap > size:
            count[gap - size] += 1
            open_[gap - size].append(here)
    return out


_SCHEMA = "limit_name string, block bigint, container bigint, doc_id bigint, piece_no bigint, first_token bigint, n_tokens bigint"


def pack(docs: DataFrame, limits: list[tuple[str, int]], doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """limit_name, container_id, doc_id, piece_no, first_token, n_tokens: every document's place for each (name, capacity) of limits.

    Each token of each document is in exactly one container a limit. Null and empty texts take no place. Repeated documents are packed
    each time; further columns are left out. Several documents keep the order of their hash, so results do not depend on the partitions.
    """
    if any(capacity < 1 for _, capacity in limits):
        raise ValueError("a capacity must be at least 1")
    n_blocks = max(1, -(-docs.count() // block))
    sizes = token_counts(docs.where(F.col(text).isNotNull()), [doc_id], text, vocabulary).where("n_tokens > 0")
    choice = F.array(*(F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in limits))
    items = sizes.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), "n_tokens", F.pmod(F.xxhash64(doc_id), F.lit(n_blocks)).alias("block"), F.explode(choice).alias("x")
    ).select("doc_id", "n_tokens", "block", "x.limit_name", "x.capacity", F.xxhash64("doc_id", F.lit("order")).alias("turn"))

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["turn"].to_pylist(), group["doc_id"].to_pylist(), group["n_tokens"].to_pylist(), strict=True))
        capacity, name, number = group["capacity"][0].as_py(), group["limit_name"][0].as_py(), group["block"][0].as_py()
        rest = [(d, n // capacity, n // capacity * capacity, n % capacity) for _, d, n in rows if n % capacity]
        bins = sum_of_squares([r[3] for r in rest], capacity)
        used = max(bins, default=-1) + 1
        full = [(d, k, k * capacity, capacity) for _, d, n in rows for k in range(n // capacity)]
        bins += range(used, used + len(full))
        rest += full
        m = len(rest)
        cols = [[name] * m, [number] * m, bins, *(list(c) for c in zip(*rest, strict=True))] if m else [[]] * 7
        return pa.table({n: pa.array(c, t) for n, c, t in zip(_NAMES, cols, _TYPES, strict=True)})

    packed = items.groupBy("limit_name", "block").applyInArrow(run, _SCHEMA)
    return packed.select("limit_name", F.concat_ws("/", "limit_name", "block", "container").alias("container_id"), "doc_id", "piece_no", "first_token", "n_tokens")


_NAMES = ("limit_name", "block", "container", "doc_id", "piece_no", "first_token", "n_tokens")
_TYPES = (pa.string(), *(pa.int64(),) * 6)


def fill(packed: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """limit_name, capacity, n_containers, n_tokens, fill_share of a packing."""
    capacity = F.create_map(*(x for n, c in limits for x in (F.lit(n), F.lit(c).cast("bigint"))))
    each = packed.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n"))
    total = each.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens")).withColumn("capacity", capacity[F.col("limit_name")])
    return total.select("limit_name", "capacity", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill_share"))


def _limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """Capacities of the four-row table size_limits."""
    rows = table(spark, sf_dir, "size_limits").where(F.col("limit_name").isin(*LIMITS)).groupBy("limit_name").agg(F.min("max_tokens").alias("m")).collect()
    return sorted((r.limit_name, r.m) for r in rows)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in containers of both context sizes."""
    return pack(texts(spark, sf_dir, "documents"), _limits(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill(p7_containers(spark, sf_dir), _limits(spark, sf_dir))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each limit: its capacity, the documents placed, documents with a gap or an overlap between their pieces, documents in pieces that fit whole, and containers above the capacity."""
    packed = stored(p7_containers(spark, sf_dir))
    limits = spark.createDataFrame(_limits(spark, sf_dir), "limit_name string, capacity bigint")
    pieces = F.array_sort(F.collect_list(F.struct("first_token", "n_tokens")))
    per_doc = packed.groupBy("limit_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("n_pieces"), pieces.alias("p")).join(F.broadcast(limits), "limit_name")
    torn = (F.col("n") != F.col("end")) | F.exists(F.sequence(F.lit(0), F.size("p") - 2), lambda k: F.get("p", k)["first_token"] + F.get("p", k)["n_tokens"] != F.get("p", k + 1)["first_token"])
    torn = F.when(F.col("n_pieces") == 1, F.get("p", F.lit(0))["first_token"] != 0).otherwise(torn)
    docs = per_doc.groupBy("limit_name", "capacity").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(torn).alias("n_torn"), F.count_if((F.col("n_pieces") > 1) & (F.col("n") <= F.col("capacity"))).alias("n_cut_for_nothing"))
    full = packed.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(limits), "limit_name").groupBy("limit_name").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_overfull"))
    return docs.join(full, "limit_name")


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_checks": p7_checks}
ORACLE = {
    "p7_checks": """SELECT limit_name, min(max_tokens)::BIGINT AS capacity, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, 0::BIGINT AS n_torn, 0::BIGINT AS n_cut_for_nothing, 0::BIGINT AS n_overfull
 FROM size_limits WHERE limit_name IN ('context_small', 'context_large') GROUP BY limit_name""",
}
