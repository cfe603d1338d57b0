"""From fetched pages to documents and manifest, as one chain of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality, urls
from ..functions.dialect import blank_to_null
from ..operators import corpus, documents
from ..operators.cleaner import clean
from ..session import spread
from ..sources import html as H


def quality_columns(pages: DataFrame, markdown: str = "markdown", title: str = "title", fetch_method: str = "fetch_method") -> DataFrame:
    """pages with the completeness signals, warnings, score and grade of a page's markdown; null markdown gives nulls."""
    m, t, f = F.col(markdown), F.coalesce(F.col(title), F.lit("")), F.col(fetch_method)
    signals = (
        pages.withColumn("words", quality.count_words(m))
        .withColumn("headings", quality.count_headings(m))
        .withColumn("density", quality.link_density(m, F.col("words")))
        .withColumn("short_ratio", quality.short_line_ratio(m))
        .withColumn("duplicate_ratio", quality.duplicate_line_ratio(m))
        .withColumn("richness", quality.structural_richness(m))
    )
    warned = signals.withColumn("warnings", quality.warnings(t, f, F.col("words"), F.col("density"), F.col("short_ratio"), F.col("duplicate_ratio")))
    scored = warned.withColumn("score", quality.score(t, F.col("words"), F.col("density"), F.col("short_ratio"), F.col("duplicate_ratio"), F.col("richness"), F.size("warnings")))
    return scored.withColumn("grade", quality.grade(F.col("score")))


def chosen_fetches(fetches: DataFrame) -> DataFrame:
    """Fetches that end up as documents: the newest with content of each page and, of those, the survivors by file name and URL.

    Decided on a few short columns before any page is parsed; of the texts only chosen rows go on.
    """
    some = fetches.where((F.col("html") != "") | (F.col("markdown") != ""))
    light = some.select("fetch_id", "page_id", "fetched_at", F.coalesce(blank_to_null(F.col("final_url")), F.col("url")).alias("url"))
    newest = light.groupBy("page_id").agg(F.max_by(F.struct("fetch_id", "url"), F.struct("fetched_at", "fetch_id")).alias("x")).select("x.*")
    kept = corpus.survivors(newest.withColumn("domain", urls.domain_key("url")).withColumn("slug", urls.slug("url")), order="fetch_id")
    return spread(fetches).join(kept.select(F.col("fetch_id").alias("_f")), F.col("fetch_id") == F.col("_f"), "left_semi")


def page_bodies(fetches: DataFrame, rag_optimized: bool = True) -> DataFrame:
    """fetches with title, url, slug, description and last_updated of the head, and body: the rendered markdown, else the HTML's, cleaned if wanted. Neither HTML nor its parse goes on."""
    parsed = H.parse(fetches, [c for c in fetches.columns if c != "html"])
    page, url = F.col("page"), F.coalesce(blank_to_null(F.col("final_url")), F.col("url"))
    taken = parsed.select(
        *(c for c in fetches.columns if c not in ("html", "url", "markdown", "extracted_title", "final_url")), url.alias("url"), F.coalesce(blank_to_null(F.col("markdown")), page["markdown"]).alias("markdown"),
        H.page_title(F.col("extracted_title"), page, url).alias("title"), H.meta_description(page).alias("description"), H.last_updated(page).alias("last_updated"),
    ).withColumn("slug", urls.slug("url"))
    return clean(taken).drop("markdown") if rag_optimized else taken.withColumnRenamed("markdown", "body")


def corpus_pages(fetches: DataFrame, as_of: str | None = None) -> DataFrame:
    """Metadata, quality and text of every document: the chosen fetches, cleaned, scored and described.

    as_of is the time of the crawl where fetched_at does not say it.
    """
    bodies = page_bodies(chosen_fetches(fetches))
    timed = bodies.withColumn("crawled_at", F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(as_of)))
    scored = quality_columns(timed, "body").withColumnsRenamed({"score": "completeness_score", "grade": "completeness_grade"})
    return documents.page_metadata(scored.withColumn("document_type", F.lit("web-page")))


def manifest(pages: DataFrame) -> DataFrame:
    """Manifest entries of pages."""
    return pages.select(
        F.col("fetch_id").alias("seq"), urls.domain_key("url").alias("domain"), "slug", "url", "title", F.col("crawled_at").alias("scraped_at"), "content_hash", "word_count", "token_estimate",
        F.size("chunk_sections").alias("section_count"), "tags", F.lit("active").alias("status"), "document_type",
    )
