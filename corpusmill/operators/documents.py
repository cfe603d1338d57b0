"""Page files: frontmatter as a struct, the text below it, and reading both back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions.dialect import blank_to_null
from .sections import chunk_sections


def page_metadata(pages: DataFrame) -> DataFrame:
    """pages (url, title, body, crawled_at, description, last_updated) with the metadata of each page's text.

    Plain text, sections, counts and hash are computed once. A missing description falls back to the body's.
    """
    plain = pages.withColumn("title", T.clean_title("title")).withColumn("_plain", T.plain_text("body"))
    described = plain.withColumn("description", F.coalesce(blank_to_null(F.col("description")), T.body_description("body")))
    return (
        described.withColumn("source_domain", urls.host("url"))
        .withColumn("tags", urls.tags("url"))
        .withColumn("word_count", T.count_words("_plain"))
        .withColumn("token_estimate", T.estimate_tokens("_plain"))
        .withColumn("content_hash", T.content_hash("_plain"))
        .withColumn("embed_text", T.embed_text(F.col("title"), F.col("description"), F.col("body")))
        .withColumn("chunk_sections", chunk_sections("body"))
        .drop("_plain")
    )


#: Frontmatter keys in their order; absent values are left out.
KEYS = (
    "title", "description", "url", "source_domain", "crawled_at", "tags", "word_count", "token_estimate", "status", "content_hash", "embed_text", "section_count", "chunk_sections",
    "last_updated", "document_type", "pdf_url", "source_page_url", "pdf_pages", "related_pdfs", "completeness_score", "completeness_grade", "fetch_method",
)


def frontmatter(pages: DataFrame) -> Column:
    """Struct of the frontmatter keys that the rows have; status is active where none is given, empty section lists are absent."""
    have = {c: F.col(c) for c in pages.columns}
    have["status"] = F.coalesce(have.get("status", F.lit(None).cast("string")), F.lit("active"))
    if "chunk_sections" in have:
        some = F.size("chunk_sections") > 0
        have["section_count"] = F.when(some, F.size("chunk_sections"))
        have["chunk_sections"] = F.when(some, F.col("chunk_sections"))
    return F.struct(*(have[k].alias(k) for k in KEYS if k in have))


def plain_frontmatter(pages: DataFrame) -> Column:
    """Struct of the few keys of a document that keeps its body as it is."""
    return F.struct(*(F.col(k) for k in ("title", "url", "crawled_at", "completeness_score", "completeness_grade") if k in pages.columns))


def with_documents(pages: DataFrame, front: Column, body: Column, into: str = "document") -> DataFrame:
    """pages with `into`: YAML frontmatter between --- lines and the body. Null values are left out; the result parses back to the same values."""
    rows = pages.withColumn("_front", F.to_json(front)).withColumn("_body", body)
    kept = [f for f in rows.schema if f.name not in ("_front", "_body", into)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import yaml

        for batch in batches:
            fronts, bodies = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            made = [None if b is None else "---\n" + yaml.safe_dump(json.loads(f or "{}"), sort_keys=False, allow_unicode=True, width=10**6) + "---\n" + b for f, b in zip(fronts, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(made, pa.string())], names=[*names, into])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*names, "_front", "_body").mapInArrow(run, f"{ddl}, `{into}` string")


_PARSED = "url string, title string, scraped_at string, completeness_score double, completeness_grade string, fetch_method string, content_chars bigint, content_words bigint, content_hash string, token_estimate bigint, section_count bigint, tags array<string>, status string, document_type string"


def parse_documents(files: DataFrame, slug: str = "slug", raw: str = "raw", as_of: str | None = None) -> DataFrame:
    """slug and the frontmatter of page files; files without a url or with unreadable frontmatter give no row.

    Values of another type than expected are null; the title falls back to the slug, the time to the older key and then to as_of.
    """

    def front(text: str) -> dict | None:
        import yaml

        if not text.startswith("---"):
            return None
        parts = text[3:].split("\n---", 1)
        try:
            data = yaml.safe_load(parts[0])
        except yaml.YAMLError:
            return None
        return data if len(parts) == 2 and isinstance(data, dict) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("slug", pa.string()), *((n, pa.string()) for n in ("url", "title", "scraped_at")), ("completeness_score", pa.float64()), ("completeness_grade", pa.string()), ("fetch_method", pa.string())]
            + [("content_chars", pa.int64()), ("content_words", pa.int64()), ("content_hash", pa.string()), ("token_estimate", pa.int64()), ("section_count", pa.int64())]
            + [("tags", pa.list_(pa.string())), ("status", pa.string()), ("document_type", pa.string())]
        )
        word = lambda x: x if isinstance(x, str) else None
        number = lambda x: x if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        whole = lambda x: None if number(x) is None else int(x)
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = front(text) if text else None
                if not d or not word(d.get("url")):
                    continue
                words = whole(d.get("word_count"))
                rows.append(
                    {
                        "slug": name, "url": d["url"], "title": word(d.get("title")) if word(d.get("title")) is not None else name,
                        "scraped_at": next((x for x in (word(d.get("crawled_at")), word(d.get("scraped_at"))) if x is not None), as_of),
                        "completeness_score": number(d.get("completeness_score")), "completeness_grade": word(d.get("completeness_grade")), "fetch_method": word(d.get("fetch_method")),
                        "content_chars": whole(d.get("content_chars")), "content_words": words if words is not None else whole(d.get("content_words")), "content_hash": word(d.get("content_hash")),
                        "token_estimate": whole(d.get("token_estimate")), "section_count": whole(d.get("section_count")),
                        "tags": [x for x in d["tags"] if isinstance(x, str)] if isinstance(d.get("tags"), list) else None, "status": word(d.get("status")), "document_type": word(d.get("document_type")),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col(slug).alias("slug"), F.col(raw).alias("raw")).mapInArrow(run, f"slug string, {_PARSED}")


def persisted_report(parsed: DataFrame, raw: Column) -> Column:
    """Completeness of a saved page: stored score and grade, counts of the whole file; null without a stored score."""
    from ..functions import quality

    made = F.struct(
        F.when(F.col("fetch_method") == "firecrawl", "firecrawl").otherwise("static").alias("fetch_method"),
        F.length(raw).alias("content_char_count"),
        T.count_words(raw).alias("content_word_count"),
        quality.count_headings(raw).alias("heading_count"),
        F.col("completeness_score"),
        F.coalesce("completeness_grade", F.lit("fair")).alias("grade"),
        F.array().cast("array<string>").alias("warnings"),
    )
    return F.when(F.col("completeness_score").isNotNull(), made)


def pdf_metadata(pdfs: DataFrame) -> DataFrame:
    """pdfs (pdf_url, title, source_page_url, source_page_title, body, crawled_at, page_count) with page_metadata columns of a PDF extract."""
    described = pdfs.withColumn("description", F.concat(F.lit("Extracted text from PDF linked on "), "source_page_title", F.lit("."))).withColumn("url", F.col("pdf_url"))
    made = page_metadata(described.withColumn("last_updated", F.lit(None).cast("string")))
    tagged = made.withColumn("tags", F.concat(urls.tags("source_page_url"), F.array(F.lit("pdf"))))
    return tagged.withColumn("document_type", F.lit("pdf-extract")).withColumnRenamed("page_count", "pdf_pages")
