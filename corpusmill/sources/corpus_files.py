"""A corpus on disk: page files, manifest, index, and reading them back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import corpus, documents

ENTRY = "domain string, seq bigint, slug string, url string, title string, scraped_at string, content_hash string, word_count bigint, token_estimate bigint, section_count bigint, tags array<string>, status string, document_type string"


def safe_name(name: str) -> str:
    """A folder or file name as it is; ValueError for one that leaves its folder."""
    if not name or name in (".", "..") or re.search(r"[/\\\x00]", name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def is_safe(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^[^/\\\x00]+\z")) & ~name.isin(".", "..")


def write_pages(pages: DataFrame, root: str) -> None:
    """Page files (domain, slug, document) as text, in row groups under domain=. ValueError, before anything is written, where a page lacks its document or has a name that leaves its folder."""
    good = F.coalesce((F.col("document") != "") & is_safe(F.col("domain")) & is_safe(F.col("slug")), F.lit(False))
    bad = pages.where(~good).select("domain", "slug").first()
    if bad is not None:
        raise ValueError(f"not a complete page with plain names: {bad.domain!r}, {bad.slug!r}")
    pages.select("domain", "slug", "document").write.mode("overwrite").partitionBy("domain").parquet(f"{root}/pages")


def write_manifests(entries: DataFrame, root: str, as_of: str) -> None:
    """Totals of each domain, and its entries in order of their titles as one JSON line each.

    Sorted by ranges over the cluster, so a domain of any size is spread over files that follow one another.
    """
    names = [c.split(" ")[0] for c in ENTRY.split(", ")]
    title = F.collate(F.col("title"), "UNICODE")
    entries.select(*names).repartitionByRange("domain", title, "seq").sortWithinPartitions("domain", title, "seq").write.mode("overwrite").json(f"{root}/manifest/entries")
    corpus.totals(entries).withColumn("updated_at", F.lit(as_of)).write.mode("overwrite").json(f"{root}/manifest/totals")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the manifests under root; unreadable lines give none."""
    return spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(f"{root}/manifest/entries")


def index_file(entries: DataFrame, as_of: str) -> DataFrame:
    """domain, line_no, line: the lines of each corpus' index file in upsert order, header lines at 0 and below."""
    rows = corpus.totals(entries)
    stats = F.concat(F.lit(f"*Generated: {as_of[:10]} | "), F.col("page_count").cast("string"), F.lit(" documents | ~"), F.format_number("total_token_estimate", 0), F.lit(" tokens*"))
    front = {
        "title": F.concat(F.col("domain"), F.lit(" Corpus Index")), "description": F.concat(F.lit("Manifest of scraped Markdown documents for "), "domain", F.lit(".")), "source_domain": urls.index_domain("domain"), "crawled_at": F.lit(as_of),
        "document_type": F.lit("corpus-index"), "page_count": F.col("page_count").cast("string"), "total_word_count": F.col("total_word_count").cast("string"), "total_token_estimate": F.col("total_token_estimate").cast("string"), "status": F.lit("active"),
    }
    head = [F.lit("---"), *(F.concat(F.lit(f"{k}: "), v) for k, v in front.items()), F.lit("---"), F.concat(F.lit("# "), "domain", F.lit(" — Corpus Index")), F.lit(""), stats, F.lit(""), F.lit("## Documents"), F.lit("")]
    top = rows.select("domain", F.posexplode(F.array(*head)).alias("k", "line")).select("domain", (F.col("k") - len(head) + 1).cast("bigint").alias("line_no"), "line")
    return top.unionByName(corpus.index_lines(entries))


def write_index(entries: DataFrame, root: str, as_of: str) -> None:
    """The index files: the lines of index_file() in their order, as text under domain=."""
    lines = index_file(entries, as_of)
    lines.repartitionByRange("domain", "line_no").sortWithinPartitions("domain", "line_no").select("domain", "line").write.mode("overwrite").partitionBy("domain").text(f"{root}/index")


def load(spark: SparkSession, root: str, from_manifest: bool = True) -> DataFrame:
    """Saved pages with their parsed frontmatter: those the manifests name and that are there, or all page files."""
    pages = spark.read.parquet(f"{root}/pages")
    parsed = documents.parse_documents(pages.select(F.concat_ws("/", "domain", "slug").alias("slug"), F.col("document").alias("raw")))
    named = parsed.withColumn("domain", F.substring_index("slug", "/", 1)).withColumn("slug", F.substring_index("slug", "/", -1))
    if not from_manifest:
        return named
    wanted = read_manifests(spark, root).select(F.col("domain").alias("_d"), F.col("slug").alias("_s")).distinct()
    return named.join(wanted, (F.col("domain") == F.col("_d")) & (F.col("slug") == F.col("_s")), "left_semi")
