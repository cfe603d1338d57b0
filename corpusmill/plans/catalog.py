"""Registered queries of the core operators, each over whole tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, urls
from ..functions import text as T
from ..operators import corpus, discovery, documents, pdf
from ..operators.cleaner import clean
from ..operators.sections import section_rows
from ..sources import html as H
from ..session import spread
from . import pipeline
from .catalog_sql import ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts for work by row, over all cores also where it is one small file."""
    return spread(read(spark, sf_dir, name))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with markdown, and the fetch method of their stored report."""
    rows = read_texts(spark, sf_dir, "discovered_pages").where("markdown IS NOT NULL")
    return rows.withColumn("fetch_method", F.coalesce("completeness_report.fetch_method", F.lit("static")))


def million(x: F.Column) -> F.Column:
    return F.floor(x * 1_000_000 + 0.5).cast("bigint")


@query
def corpus_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages to documents' metadata: choose, parse, clean, score, describe."""
    made = pipeline.corpus_pages(read(spark, sf_dir, "fetched_pages"))
    return made.select(
        "page_id", urls.domain_key("url").alias("domain"), "slug", "url", "title", "description", "last_updated", "crawled_at", F.array_join("tags", ",").alias("tags"), "word_count", "token_estimate", "content_hash",
        F.size("chunk_sections").alias("section_count"), "completeness_score", "completeness_grade", F.size("warnings").alias("n_warnings"), F.size("resources").alias("n_resources"),
    )


@query
def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fetches become documents, and under which names."""
    chosen = pipeline.chosen_fetches(read(spark, sf_dir, "fetched_pages"))
    url = F.coalesce(F.nullif("final_url", F.lit("")), F.col("url"))
    return chosen.select("page_id", "fetch_id", urls.domain_key(url).alias("domain"), urls.slug(url).alias("slug"), url.alias("url"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("crawled_at"), F.array_join(urls.tags(url), ",").alias("tags"))


@query
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = pipeline.quality_columns(pages(spark, sf_dir))
    return q.select(
        "page_id", F.length("markdown").cast("bigint").alias("chars"), "words", "headings", million(F.col("density")).alias("density"), million(F.col("short_ratio")).alias("short_ratio"),
        million(F.col("duplicate_ratio")).alias("duplicate_ratio"), "richness", F.array_join("warnings", " | ").alias("warnings"), "score", "grade",
    )


@query
def quality_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = pipeline.quality_columns(pages(spark, sf_dir))
    return q.groupBy("grade", quality.badge(F.col("grade")).alias("badge")).agg(F.count(F.lit(1)).alias("n_pages"), F.floor(F.avg("score") + 0.5).cast("bigint").alias("avg_score"))


@query
def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of warnings, figures aside."""
    q = pipeline.quality_columns(pages(spark, sf_dir)).select(F.explode("warnings").alias("w"))
    return q.groupBy(F.regexp_replace("w", "[0-9]+", "N").alias("warning")).agg(F.count(F.lit(1)).alias("n_pages"))


@query
def stale_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports whose word or heading count no longer fits the markdown."""
    q = pages(spark, sf_dir).where("completeness_report IS NOT NULL")
    now = q.select("page_id", F.col("completeness_report.content_word_count").cast("bigint").alias("stored_words"), T.count_words("markdown").alias("words"), F.col("completeness_report.heading_count").cast("bigint").alias("stored_headings"), quality.count_headings("markdown").alias("headings"))
    return now.where(~F.col("stored_words").eqNullSafe(F.col("words")) | ~F.col("stored_headings").eqNullSafe(F.col("headings")))


@query
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages a consumer keeps and leaves out, by host."""
    q = pipeline.quality_columns(pages(spark, sf_dir)).withColumn("host", urls.host("url"))
    return q.groupBy("host").agg(F.count_if(F.col("score") >= 50).alias("n_kept"), F.count_if(F.col("score") < 50).alias("n_left_out"))


@query
def plain_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", T.plain_text("markdown").alias("plain"))
    return p.select("page_id", F.length("plain").cast("bigint").alias("chars"), T.count_words("plain").alias("word_count"), T.estimate_tokens("plain").alias("token_estimate"), T.content_hash("plain").alias("content_hash"))


@query
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plain text once: its first page and how many have it."""
    p = pages(spark, sf_dir).select("page_id", T.content_hash(T.plain_text("markdown")).alias("content_hash"))
    return p.groupBy("content_hash").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n_pages"))


@query
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "discovered_pages").where("title IS NOT NULL").select("page_id", T.clean_title("title").alias("title"))


def _hashed(spark: SparkSession, sf_dir: str, made: F.Column) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", made.alias("x")).select("page_id", F.length("x").cast("bigint").alias("chars"), F.sha2("x", 256).alias("hash"))


@query
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, T.normalize_whitespace(T.normalize_encoding("markdown")))


@query
def residual_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, T.strip_residual_html("markdown"))


@query
def markdown_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, T.strip_artifacts("markdown"))


@query
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, T.remove_noise_lines("markdown"))


@query
def ui_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, T.remove_trailing_ui_sections(T.remove_control_bursts(T.remove_ui_headings("markdown"))))


@query
def flat_subheadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, T.flatten_subheadings("markdown"))


@query
def section_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, T.dedupe_sections("markdown"))


@query
def paragraph_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, T.dedupe_paragraphs("markdown"))


@query
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaner."""
    c = clean(pages(spark, sf_dir).select("page_id", "markdown"))
    return c.select("page_id", F.length("markdown").alias("chars_before"), F.length("body").alias("chars"), F.sha2("body", 256).alias("hash"), F.size("resources").alias("n_resources"))


@query
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = section_rows(pages(spark, sf_dir), "page_id", "markdown")
    return s.select("page_id", F.col("section_no").cast("bigint").alias("section_no"), "heading", F.col("level").cast("bigint").alias("level"), F.col("word_count").cast("bigint").alias("word_count"), F.col("token_estimate").cast("bigint").alias("token_estimate"))


@query
def stale_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose stored section list has another number of sections than their markdown."""
    now = pages(spark, sf_dir).select("page_id", F.size(documents.chunk_sections("markdown")).cast("bigint").alias("n_sections"))
    kept = read(spark, sf_dir, "page_metadata").groupBy("page_id").agg(F.max(F.coalesce(F.size("chunk_sections"), F.lit(-1))).cast("bigint").alias("n_stored"))
    return now.join(kept, "page_id").where("n_sections <> n_stored")


@query
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", T.clean_title(F.coalesce("title", F.lit(""))).alias("title"), T.body_description("markdown").alias("description"), "markdown")
    return p.select("page_id", "description", T.embed_text(F.col("title"), F.col("description"), F.col("markdown")).alias("embed_text"))


@query
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "discovered_pages")
    return p.select(
        "page_id", urls.normalize_discovered("url").alias("discovered"), urls.normalize_persisted("url").alias("persisted"), urls.host("url").alias("host"), urls.domain_key("url").alias("domain"),
        urls.index_domain(urls.domain_key("url")).alias("index_domain"), urls.slug("url").alias("slug"), F.array_join(urls.tags("url"), ",").alias("tags"),
    )


@query
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "discovered_pages").select("page_id", urls.page_key("url").alias("id"))


@query
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows of the URLs found, each once."""
    found = read(spark, sf_dir, "discovered_pages").select(urls.normalize_discovered("url").alias("url")).where("url IS NOT NULL").distinct()
    return corpus.session_rows(found).select("id", "url", "title", "selected", "status")


@query
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that the default patterns keep, by domain."""
    e = read(spark, sf_dir, "link_edges").where("href IS NOT NULL").withColumn("kept", urls.matches_patterns("href", "", discovery.DEFAULT_EXCLUDES))
    return e.groupBy("domain").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_left_out"))


@query
def discovered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in first-seen order by host."""
    p = read(spark, sf_dir, "discovered_pages").select("page_id", urls.host("url").alias("host"), urls.normalize_discovered("url").alias("norm"))
    return discovery.first_seen(p, "host", "norm", "page_id")


@query
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that several URLs of a host share."""
    p = read(spark, sf_dir, "discovered_pages").select(urls.domain_key("url").alias("domain"), urls.slug("url").alias("slug"), urls.normalize_persisted("url").alias("norm")).distinct()
    return p.groupBy("domain", "slug").agg(F.count(F.lit(1)).alias("n_urls")).where("n_urls > 1")


@query
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.survivors(read(spark, sf_dir, "manifest_entries")).select(
        "seq", "domain", "slug", "url", "title", F.coalesce(F.col("word_count").cast("bigint"), F.lit(-1)).alias("word_count"), F.coalesce(F.col("token_estimate").cast("bigint"), F.lit(-1)).alias("token_estimate")
    )


@query
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.totals(corpus.survivors(read(spark, sf_dir, "manifest_entries")))


@query
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_lines(corpus.survivors(read(spark, sf_dir, "manifest_entries")))


@query
def manifest_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written in the last year of the data that a tag names, by tag."""
    m = corpus.survivors(read(spark, sf_dir, "manifest_entries"))
    newest = m.agg(F.max("scraped_at").alias("newest"))
    recent = m.join(F.broadcast(newest), F.substring("scraped_at", 1, 10) > F.date_format(F.add_months(F.to_date(F.substring("newest", 1, 10)), -12), "yyyy-MM-dd"))
    return recent.select(F.explode("tags").alias("tag"), "domain").groupBy("tag").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("domain").alias("n_domains"))


@query
def unchanged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts whose content their page had before, by domain."""
    m = read(spark, sf_dir, "manifest_entries").where("content_hash IS NOT NULL").groupBy("domain", "slug", "content_hash").agg((F.count(F.lit(1)) - 1).alias("again"))
    return m.groupBy("domain").agg(F.sum("again").alias("n_unchanged"))


@query
def resume_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.resume(read(spark, sf_dir, "discovered_pages"), corpus.survivors(read(spark, sf_dir, "manifest_entries")))


@query
def preview_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.preview(read(spark, sf_dir, "discovered_pages"), corpus.survivors(read(spark, sf_dir, "manifest_entries")))


@query
def patched_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows with title and URL of their last fetch."""
    session = read(spark, sf_dir, "discovered_pages").select("page_id", "url", "title", "status")
    patches = read(spark, sf_dir, "fetched_pages").select("page_id", "fetch_id", F.col("final_url").alias("url"), F.col("extracted_title").alias("title"))
    return corpus.patch(session, patches, "page_id", ["url", "title"], "fetch_id")


@query
def session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.restored(read(spark, sf_dir, "discovered_pages")).withColumn("host", urls.host("url"))
    return corpus.progress(p, ["host"])


@query
def scrape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "discovered_pages")
    rows = p.select(urls.host("url").alias("host"), "status", F.col("completeness_report.completeness_score").alias("completeness_score"), F.col("completeness_report.fetch_method").alias("fetch_method"))
    return corpus.scrape_summary(rows, ["host"])


@query
def completed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may be saved, and selected ones that still wait, by host."""
    p = read(spark, sf_dir, "discovered_pages").withColumn("host", urls.host("url"))
    waits = F.coalesce(F.col("selected"), F.lit(False)) & ~F.col("status").eqNullSafe("done")
    return p.groupBy("host").agg(F.count_if(corpus.is_complete(F.col("status"), F.col("markdown"), F.col("slug"))).alias("n_complete"), F.count_if(waits).alias("n_waiting"))


@query
def save_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be saved of each host, what failed, and whether all that was selected is done."""
    return corpus.save_counts(read(spark, sf_dir, "discovered_pages").withColumn("host", urls.host("url")), ["host"])


@query
def stored_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session without its texts."""
    return corpus.persistable(read(spark, sf_dir, "discovered_pages")).select("page_id", "id", "url", "title", "selected", "status", "error", "slug")


@query
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries of the documents that the fetches make."""
    made = pipeline.manifest(pipeline.corpus_pages(read(spark, sf_dir, "fetched_pages")))
    return made.select("seq", "domain", "slug", "url", "scraped_at", F.array_join("tags", ",").alias("tags"), "status", "document_type", (F.length("content_hash") == 64).alias("hashed"), (F.col("token_estimate") * 4 >= F.col("word_count")).alias("estimated"))


@query
def persisted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of saved pages, from the score and grade in their files and the counts of the text."""
    p = pages(spark, sf_dir).select("page_id", "markdown", F.col("completeness_report.completeness_score").cast("double").alias("completeness_score"), F.col("completeness_report.grade").alias("completeness_grade"), "fetch_method")
    made = p.select("page_id", documents.persisted_report(p, F.col("markdown")).alias("r")).where("r IS NOT NULL")
    return made.select("page_id", "r.fetch_method", F.col("r.content_char_count").cast("bigint").alias("chars"), F.col("r.content_word_count").alias("words"), F.col("r.heading_count").alias("headings"), F.col("r.completeness_score").cast("bigint").alias("score"), "r.grade")


@query
def scrape_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 crawls (a domain's writes of one day) with their pages."""
    m = read(spark, sf_dir, "manifest_entries").where("written_at IS NOT NULL").withColumn("day", F.date_format("written_at", "yyyy-MM-dd"))
    days = m.groupBy("domain", "day").agg(F.count(F.lit(1)).alias("n_pages"), F.max("seq").alias("last_seq"))
    return days.orderBy(F.col("day").desc(), F.col("last_seq").desc()).limit(50)


@query
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.links(read(spark, sf_dir, "link_edges"))


@query
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reached in at most three steps from the front page of each domain, or, where no link starts there, from its smallest source."""
    _checkpoint_dir(spark)
    graph = discovery.links(read(spark, sf_dir, "link_edges")).checkpoint()
    seeds = graph.groupBy("domain").agg(F.min("source").alias("url"))
    return discovery.crawl(graph, seeds, "domain", 3).withColumn("depth", F.col("depth").cast("bigint"))


def _checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder of the session; makes a local one only where none is named, as in tests."""
    from ..session import checkpoint_dir

    checkpoint_dir(spark)


@query
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every fetch: rendered, <title>, og:title, first h1 or URL."""
    f = H.parse(read_texts(spark, sf_dir, "fetched_pages"), ["fetch_id", "extracted_title", "final_url"], markdown=False)
    return f.select("fetch_id", H.page_title(F.col("extracted_title"), F.col("page"), F.col("final_url")).alias("title"))


@query
def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description and date of every fetch's head."""
    f = H.parse(read_texts(spark, sf_dir, "fetched_pages"), ["fetch_id"], markdown=False)
    return f.select("fetch_id", H.meta_description(F.col("page")).alias("description"), H.last_updated(F.col("page")).alias("last_updated"))


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every fetch's HTML in order."""
    f = H.parse(read_texts(spark, sf_dir, "fetched_pages"), ["fetch_id"], markdown=False)
    return f.select("fetch_id", F.posexplode(H.anchors(F.col("page"))).alias("ord", "href")).withColumn("ord", F.col("ord").cast("bigint"))


@query
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = H.parse(read_texts(spark, sf_dir, "fetched_pages").where("html IS NOT NULL"), ["fetch_id"])
    return f.select("fetch_id", F.length("page.markdown").alias("chars"), quality.count_headings("page.markdown").alias("headings"), F.sha2("page.markdown", 256).alias("hash"))


@query
def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs linked from every fetched page, with their file names and titles."""
    f = H.parse(read_texts(spark, sf_dir, "fetched_pages"), ["fetch_id", "final_url"], markdown=False)
    keyed = f.withColumn("final_url", F.concat(F.col("final_url"), F.lit("#"), F.col("fetch_id").cast("string")))
    named = pdf.unique_slugs(pdf.pdf_links(keyed, "final_url"))
    return named.select(F.substring_index("page_url", "#", -1).cast("bigint").alias("fetch_id"), F.col("ord").cast("bigint").alias("ord"), "pdf_url", "slug", urls.pdf_title("pdf_url", F.col("label")).alias("title"))


@query
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files written and read back: what the parsed frontmatter says."""
    p = pages(spark, sf_dir).where("url IS NOT NULL").select(
        "page_id", "url", F.coalesce("title", F.lit("")).alias("title"), F.col("markdown").alias("body"), F.date_format("discovered_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("crawled_at"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("last_updated"),
    )
    made = documents.page_metadata(p).withColumn("document_type", F.lit("web-page"))
    files = documents.with_documents(made, documents.frontmatter(made), T.document_body(F.col("title"), F.col("url"), F.col("crawled_at"), F.col("body")))
    parsed = documents.parse_documents(files.select(F.col("page_id").cast("string").alias("slug"), F.col("document").alias("raw")))
    return parsed.select(F.col("slug").cast("bigint").alias("page_id"), "url", "title", "scraped_at", "content_words", "content_hash", "token_estimate", "status", "document_type")


