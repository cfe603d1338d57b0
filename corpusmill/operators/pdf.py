"""PDFs linked from pages: which ones, under which names, and their extracts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import parse_qs, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions.dialect import trim
from . import documents
from .cleaner import clean

MAX_PER_PAGE = 100


def resolve(href: str, page_url: str) -> str | None:
    """Absolute URL of the PDF behind a link: of a nested ?url= first, else of the link itself; null if neither is a PDF."""

    def is_pdf(value: str) -> bool:
        low = value.lower()
        return any(low[i + 4 :][:1] in ("", "?", "#") for i in range(len(low)) if low.startswith(".pdf", i))

    try:
        parts = urlsplit(urljoin(page_url, href.strip()))
        if parts.scheme not in ("http", "https") or not parts.hostname:
            return None
        parts = parts._replace(scheme=parts.scheme.lower(), netloc=parts.netloc.lower(), path=parts.path or "/", fragment="")
        nested = parse_qs(parts.query, keep_blank_values=True).get("url", [""])[0]
        if nested and is_pdf(nested):
            return urljoin(f"{parts.scheme}://{parts.netloc}", nested)
        return urlunsplit(parts) if is_pdf(parts.path + ("?" + parts.query if parts.query else "")) else None
    except ValueError:
        return None


_CANDIDATE = pa.struct([("ord", pa.int32()), ("href", pa.string()), ("label", pa.string()), ("pdf_url", pa.string())])


def pdf_links(parsed: DataFrame, page_url: str, most: int = MAX_PER_PAGE) -> DataFrame:
    """page_url, ord, href, label, pdf_url of a parsed page's (column page) PDF links: anchors first, each PDF once, at most `most` a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[str, dict] = {}
                for link in sorted(links or [], key=lambda x: x["tag"] != "a"):
                    target = resolve(link["href"], url) if link["href"] and link["href"].strip() and url else None
                    if target and target not in seen:
                        seen[target] = {"ord": len(seen), "href": link["href"].strip(), "label": (link["label"] or "").strip() or target, "pdf_url": target}
                out.append(list(seen.values())[:most])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_CANDIDATE))], names=["page_url", "found"])

    found = parsed.select(F.col(page_url).alias("page_url"), F.col("page.links").alias("links")).mapInArrow(run, "page_url string, found array<struct<ord:int,href:string,label:string,pdf_url:string>>")
    return found.select("page_url", F.inline("found"))


def unique_slugs(links: DataFrame, by: str = "page_url", order: str = "ord", url: str = "pdf_url") -> DataFrame:
    """links with slug: the file name of each PDF, made unique within its page by -2, -3 and so on.

    A number that another PDF of the page has as its own name is passed over.
    """
    base = links.withColumn("_base", urls.pdf_slug(url))
    ranked = base.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_base").orderBy(order)))
    taken = F.collect_set("_base").over(Window.partitionBy(by))
    listed = ranked.withColumn("_taken", taken)
    # The n-th use takes the n-th free number: own names never number more than the page's links.
    numbers = F.filter(F.sequence(F.lit(2), F.size("_taken") + F.col("_n") + 1), lambda k: ~F.array_contains("_taken", F.concat(F.col("_base"), F.lit("-"), k.cast("string"))))
    named = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("-"), F.get(numbers, F.col("_n") - 2).cast("string")))
    return listed.withColumn("slug", named).drop("_base", "_n", "_taken")


def is_pdf(content: Column) -> Column:
    """Whether bytes start like a PDF."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def to_fetch(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted PDFs (pdf_url) that the cache (pdf_url) lacks. The key is the URL, so two PDFs of one file name never mix."""
    return wanted.join(cache.select(F.col("pdf_url").alias("_u")).distinct(), F.col("pdf_url") == F.col("_u"), "left_anti")


def extract_text(files: DataFrame, reader: Callable[[bytes], tuple[str, int]], url: str = "pdf_url", content: str = "content") -> DataFrame:
    """pdf_url, text, page_count, error of PDF files, by a reader of bytes; what is no PDF, or has no text, gives an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, pages, error = "", 0, None
                if not data or data[:4] != b"%PDF":
                    error = "not a PDF"
                else:
                    try:
                        text, pages = reader(data)
                    except Exception as why:  # one bad file must not end the job
                        error = str(why) or type(why).__name__
                rows.append({"pdf_url": u, "text": text, "page_count": pages, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("pdf_url", pa.string()), ("text", pa.string()), ("page_count", pa.int64()), ("error", pa.string())]))

    return files.select(url, content).mapInArrow(run, "pdf_url string, text string, page_count bigint, error string")


def extracts(links: DataFrame, texts: DataFrame) -> DataFrame:
    """page_url, ord, slug, title, pdf_url, body, page_count, char_count, error: an extract, or an error row, for each linked PDF."""
    named = unique_slugs(links).withColumn("title", urls.pdf_title("pdf_url", F.col("label")))
    t = texts.select(F.col("pdf_url").alias("_u"), trim(F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n")).alias("_text"), "page_count", F.col("error").alias("_error"))
    joined = named.join(t, F.col("pdf_url") == F.col("_u"), "left")
    error = F.coalesce("_error", F.when(F.col("_u").isNull(), "PDF was not fetched").when(F.col("_text") == "", "No text, the PDF may be scanned or hold images only"))
    cleaned = clean(joined.withColumn("error", error).withColumn("_text", F.when(error.isNull(), F.col("_text"))), "_text", "body")
    return cleaned.select(
        "page_url", "ord", "slug", "title", "pdf_url", F.coalesce("body", F.lit("")).alias("body"), F.when(F.col("error").isNull(), F.col("page_count")).otherwise(0).alias("page_count"), F.coalesce(F.length("_text"), F.lit(0)).alias("char_count"), "error"
    )


def related(pdfs: DataFrame) -> DataFrame:
    """page_url, related_pdfs: title, slug and URL of each page's good extracts, in order."""
    good = pdfs.where((F.col("body") != "") & F.col("error").isNull())
    return good.groupBy("page_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "slug", "pdf_url"))), lambda x: F.struct(x["title"].alias("title"), x["slug"].alias("slug"), x["pdf_url"].alias("pdf_url"))).alias("related_pdfs"))


def with_pdfs(pages: DataFrame, links: DataFrame, texts: DataFrame, download: bool = True, in_body: bool = False) -> DataFrame:
    """pages (url, body) with related_pdfs, the good extracts of what links (page_url, by pdf_links()) leads to, and with a list of them in the body if wanted.

    Without download nothing is looked up and related_pdfs is null, as it is for pages without a good extract.
    """
    if not download:
        return pages.withColumn("related_pdfs", F.lit(None).cast("array<struct<title:string,slug:string,pdf_url:string>>"))
    joined = pages.join(related(extracts(links, texts)).withColumnRenamed("page_url", "_page"), F.col("url") == F.col("_page"), "left").drop("_page")
    return joined.withColumn("body", append_list(F.col("body"), F.col("related_pdfs"))) if in_body else joined


def documents_of(pdfs: DataFrame) -> DataFrame:
    """extracts() with source_page_title and crawled_at, as page files: slug, pdf_url and document, of the good ones."""
    good = pdfs.where((F.col("body") != "") & F.col("error").isNull()).withColumnRenamed("page_url", "source_page_url")
    made = documents.pdf_metadata(good)
    body = T.document_body(F.col("title"), F.col("pdf_url"), F.col("crawled_at"), F.concat(F.lit("## Document\n\n"), trim("body")))
    return documents.with_documents(made, documents.frontmatter(made), body).select("slug", "pdf_url", "document")


def append_list(body: Column, related_pdfs: Column) -> Column:
    """Body with a list of its PDF extracts right below its last line; unchanged where there are none."""
    listed = F.array_join(F.transform(related_pdfs, lambda r: F.concat(F.lit("- **"), r["title"], F.lit("** — "), r["pdf_url"], F.lit("\n"))), "")
    return F.when(F.coalesce(F.size(related_pdfs), F.lit(0)) > 0, F.concat(trim(body), F.lit("\n## Related PDF extracts\n\n"), listed)).otherwise(body)
