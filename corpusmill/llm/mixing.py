"""Problem 8: a mixture of sources in which each has its target share of the tokens and none repeats beyond its cap.

Weights lie on a path between the targets (exponent 0) and the sources' own token shares (exponent 1): target * (share /
target) ** exponent, normalised. With flat targets that is plain temperature sampling. The exponent is bisected to the
smallest one at which, for the wanted total, no source must repeat beyond its cap (for_total); without a wanted total the largest one
is taken that allows exponent 0, so that the targets are met. Without targets, the own shares alone are exponentiated, and the exponent is bisected to a wanted entropy (temper).

The weights are then realised: whole repetitions of a source, and of one more pass the first blocks of a seeded permutation up to the rest
of its budget. Blocks hold about BLOCK documents, so only the block where a budget ends needs a running sum over documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import table, texts
from .tokens import VOCABULARY, token_counts

BLOCK = 4_096
SEED = 17
#: Sources that may be planned; more raise an error.
SOURCES = 100_000
#: Size of the tempered mixture, as a share of the tokens of its sources.
TEMPERED = 0.5


@dataclass(frozen=True)
class Source:
    """tokens: size of one pass; target: wanted share (any scale); cap: passes at most."""

    tokens: int
    target: float
    cap: int


def path(sources: dict[str, Source], exponent: float) -> dict[str, float]:
    """Weights at an exponent, adding up to 1."""
    total, aims = sum(s.tokens for s in sources.values()), sum(s.target for s in sources.values())
    logs = {k: (1 - exponent) * math.log(s.target / aims) + exponent * math.log(s.tokens / total) for k, s in sources.items()}
    top = max(logs.values())
    w = {k: math.exp(v - top) for k, v in logs.items()}
    return {k: v / sum(w.values()) for k, v in w.items()}


def _bisect(holds, lo: float, hi: float) -> float:
    """Smallest value in [lo, hi] from which holds() is true; holds(hi) is taken for granted."""
    if holds(lo):
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        if holds(mid):
            hi = mid
        else:
            lo = mid
    return hi


def largest_total(sources: dict[str, Source], weights: dict[str, float]) -> int:
    """Most tokens that these weights give without a source beyond its cap."""
    return int(min(s.cap * s.tokens / weights[k] for k, s in sources.items()))


def for_total(sources: dict[str, Source], total: int) -> float:
    """Smallest exponent at which the total needs no source beyond its cap; 1 where even the own shares need that."""
    return _bisect(lambda e: largest_total(sources, path(sources, e)) >= total, 0.0, 1.0)


def temper(sources: dict[str, Source], entropy: float) -> float:
    """Exponent of plain temperature sampling (flat targets) whose weights have this entropy in nats, within what 0 to 1 can give."""
    return _bisect(lambda e: entropy_of(path(flat(sources), e)) <= entropy, 0.0, 1.0)


def flat(sources: dict[str, Source]) -> dict[str, Source]:
    """The sources without their targets."""
    return {k: Source(s.tokens, 1.0, s.cap) for k, s in sources.items()}


def entropy_of(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w)


def plan(sources: dict[str, Source], total: int | None = None, entropy: float | None = None) -> tuple[dict[str, int], float]:
    """Token budget of each source, and the exponent: for a total within the caps, for an entropy of the weights, or else for the targets as they are. Budgets never exceed cap * tokens."""
    if not sources:
        return {}, 0.0
    if entropy is not None:
        exponent = temper(sources, entropy)
        weights = path(flat(sources), exponent)
        total = min(total or 2**62, largest_total(sources, weights))
    else:
        if total is None:
            total = largest_total(sources, path(sources, 0.0))
        exponent = for_total(sources, total)
        weights = path(sources, exponent)
    return {k: min(int(total * weights[k]), s.cap * s.tokens) for k, s in sources.items()}, exponent


def usable(sizes: DataFrame, targets: DataFrame) -> dict[str, Source]:
    """Sources with tokens, a positive target and a cap; repeated target rows add up, their smallest cap holds. ValueError for more than SOURCES sources."""
    aims = (
        targets.where(F.col("source").isNotNull() & (F.col("target_weight") > 0) & (F.col("max_repeats") >= 1))
        .groupBy("source")
        .agg(F.sum("target_weight").alias("target"), F.min("max_repeats").alias("cap"))
    )
    totals = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = totals.join(aims, "source").limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    return {r.source: Source(r.tokens, r.target, r.cap) for r in rows}


def realise(sizes: DataFrame, sources: dict[str, Source], budgets: dict[str, int], seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, source, copy, n_tokens: the mixture. copy counts from 1; the last, partial pass takes whole documents, ending at the document nearest to the budget.

    Documents of other or null sources, and of no tokens, are left out. Repeated documents count each time.
    """
    spark = sizes.sparkSession
    rows = [(k, budgets[k] // s.tokens, budgets[k] % s.tokens) for k, s in sorted(sources.items())]
    plans = spark.createDataFrame(rows, "source string, passes bigint, rest bigint")
    docs = sizes.where("n_tokens > 0").join(F.broadcast(plans), "source").withColumn("turn", F.xxhash64(F.lit(seed), "doc_id"))
    n_docs = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    blocked = docs.join(F.broadcast(n_docs), "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.ceil(F.col("n_docs") / block)))
    # Blocks are few: documents over BLOCK. Their running sums decide all documents but those of one block a source.
    sums = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("goal"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sums.withColumn("before", before).select("source", "block", "before", "size", (F.col("before") + F.col("size") <= F.col("goal")).alias("inside"), (F.col("before") < F.col("goal")).alias("begun"))
    placed = blocked.join(places, ["source", "block"])
    cut = placed.where(F.col("begun") & ~F.col("inside"))
    run = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    part = cut.withColumn("upto", F.col("before") + run).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"))
    last = placed.where("inside").select("doc_id", "source", "passes", "n_tokens").unionByName(part.select("doc_id", "source", "passes", "n_tokens"))
    whole = docs.where("passes > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("bigint"), "passes")).alias("copy"), "n_tokens")
    return whole.unionByName(last.select("doc_id", "source", (F.col("passes") + 1).alias("copy"), "n_tokens"))


def report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, n_tokens, n_rows, max_copies: one row a target or mixed source."""
    own = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_weight").alias("w"))
    aims = own.crossJoin(F.broadcast(own.agg(F.sum("w").alias("all")))).select("source", (F.col("w") / F.col("all")).alias("target_share"))
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("copy").alias("copies"))
    total = got.agg(F.sum("n").alias("all"))
    return (
        aims.join(got, "source", "full_outer")
        .crossJoin(F.broadcast(total))
        .select(
            "source",
            "target_share",
            F.coalesce(F.col("n") / F.col("all"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("n", F.lit(0)).alias("n_tokens"),
            F.coalesce("rows", F.lit(0)).alias("n_rows"),
            F.coalesce("copies", F.lit(0)).alias("max_copies"),
        )
    )


def sized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of documents (doc_id, text, source) with text and source, as a table in the shared folder: far smaller than the texts, and read several times."""
    return stored(token_counts(docs.where("text IS NOT NULL AND source IS NOT NULL"), ["doc_id", "source"], "text", vocabulary))


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mixture of documents (doc_id, text, source) by targets (source, target_weight, max_repeats); see plan() and realise()."""
    sizes = sized(docs, vocabulary)
    sources = usable(sizes, targets)
    return realise(sizes, sources, plan(sources, total)[0])


def tempered(docs: DataFrame, targets: DataFrame, share: float = TEMPERED) -> DataFrame:
    """The mixture with this share of all tokens of its sources: its exponent is bisected until no source repeats beyond its cap."""
    sizes = sized(docs)
    sources = usable(sizes, targets)
    return realise(sizes, sources, plan(sources, int(share * sum(s.tokens for s in sources.values())))[0])


def leveled(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The mixture by the sources' own shares, with the exponent bisected until they are as evenly spread as the targets are: the same entropy. The targets' caps hold."""
    sizes = sized(docs)
    sources = usable(sizes, targets)
    return realise(sizes, sources, plan(sources, entropy=entropy_of(path(sources, 0.0)) if sources else 0.0)[0])


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return texts(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and copies of the mixture that meets the targets."""
    return mix(*_tables(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the mixture."""
    return report(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target source with text: its target share in millionths, whether the mixture is within half a percent of it, keeps the cap, and has no copy twice."""
    docs, targets = _tables(spark, sf_dir)
    mixed = stored(mix(docs, targets))
    caps = targets.where("source IS NOT NULL AND target_weight > 0 AND max_repeats >= 1").groupBy("source").agg(F.sum("target_weight").alias("w"), F.min("max_repeats").alias("cap"))
    used = caps.join(docs.where("text <> ''").select("source").distinct(), "source", "left_semi")
    aims = used.crossJoin(F.broadcast(used.agg(F.sum("w").alias("all")))).select("source", "cap", (F.col("w") / F.col("all")).alias("aim"))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("copy").alias("copies"), F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id", "copy").alias("different"))
    both = aims.join(got, "source", "left").crossJoin(F.broadcast(mixed.agg(F.sum("n_tokens").alias("total"))))
    # A source is cut at whole documents, so half of its longest one may be missing or too much.
    longest = F.coalesce(F.col("longest"), F.lit(0))
    both = both.join(mixed.groupBy("source").agg(F.max("n_tokens").alias("longest")), "source", "left")
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("aim") * F.col("total")) <= longest + F.lit(0.005) * F.col("total")
    return both.select("source", F.floor(F.col("aim") * 1_000_000 + 0.5).cast("bigint").alias("target_millionths"), near.alias("on_target"), (F.coalesce("copies", F.lit(0)) <= F.col("cap")).alias("within_cap"), F.coalesce(F.col("rows") == F.col("different"), F.lit(True)).alias("copies_once"))


def p8_tempered_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and copies of a mixture of half of all tokens, tempered to the repetition limits."""
    return tempered(*_tables(spark, sf_dir))


def p8_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the tempered mixture."""
    return report(p8_tempered_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_leveled_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and copies of a mixture by the own shares, tempered to the entropy of the targets."""
    return leveled(*_tables(spark, sf_dir))


def p8_leveled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the mixture of the targets' entropy."""
    return report(p8_leveled_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {
    "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_checks": p8_checks, "p8_tempered_mixture": p8_tempered_mixture, "p8_tempered_shares": p8_tempered_shares,
    "p8_leveled_mixture": p8_leveled_mixture, "p8_leveled_shares": p8_leveled_shares,
}
ORACLE = {
    "p8_checks": """WITH aims AS (SELECT source, sum(target_weight) AS w FROM mix_targets WHERE source IS NOT NULL AND target_weight > 0 AND max_repeats >= 1 GROUP BY source),
 used AS (SELECT * FROM aims WHERE source IN (SELECT source FROM documents WHERE text <> ''))
 SELECT source, floor(w / (SELECT sum(w) FROM used) * 1000000 + 0.5)::BIGINT AS target_millionths, true AS on_target, true AS within_cap, true AS copies_once FROM used""",
}
