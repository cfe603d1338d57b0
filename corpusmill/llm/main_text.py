"""Problem 2, put together: furniture lines of pages that are neither stuffed with keywords nor residue.

The rules of blocks.label_lines give the labels; the same pass over a page scores it for problems 1 and 5, so a
page is read and labelled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources import html
from . import residue, spam
from .blocks import ARTICLE, load_pages, with_repeats
from .common import pages_with_host, receive, send, texts


def page_lines(pages: DataFrame, without_cases: bool = True, text: bool = True) -> DataFrame:
    """page_id, furniture, kept: numbers of the furniture lines and the article's lines, joined, of each page (page_id, markdown, title, host).

    Pages that are cases of problem 1 or 5 give no row if without_cases. kept is null without text. Null markdown gives no row, an empty page two empty
    results; repeated pages give repeated rows.
    """
    counts = spam.kept_counts(pages)
    rows, repeats = with_repeats(residue.with_warnings(pages.where(F.col("markdown").isNotNull())), ["page_id", "markdown", "title", "warnings"], counts)
    sent = send(pages.sparkSession, (residue.fit(rows, repeats) if without_cases else None, repeats))
    schema = pa.schema([("page_id", pa.int64()), ("furniture", pa.list_(pa.int64())), ("kept", pa.string()), *spam.ACCOUNT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes, lines = receive(sent)
        for batch in batches:
            ids, hosts, own = (batch.column(k).to_pylist() for k in (0, 2, 3))
            out: tuple[list, ...] = tuple([] for _ in schema)
            for i, t, host, keys in zip(ids, batch.column(1), hosts, own, strict=True):
                markdown = t.as_py()
                page = lines.label(markdown, host, keys)
                row = spam.CLOSED
                if bayes is not None:
                    n_residue, notice = residue.judge(page, bayes)
                    if n_residue or notice > residue.NOTICE_SHARE:
                        continue
                    account = spam.short_account(page)
                    if not account.open and spam.above(account.spam, account.good):
                        continue
                    row = spam.account_row(account, markdown, host)
                gone = [n for n, x in zip(page.number, page.label, strict=True) if x != ARTICLE]
                kept = None
                if text:
                    drop = set(gone)
                    kept = "\n".join(x for n, x in enumerate(markdown.split("\n")) if n not in drop).strip()
                for column, x in zip(out, (i, gone, kept, *row), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    made = rows.select("page_id", "markdown", "host", "own_keys").mapInArrow(run, f"page_id bigint, furniture array<bigint>, kept string, {spam.ACCOUNT_DDL}")
    if without_cases:
        made = spam.close(stored(made), counts).where(~spam.is_stuffed())
    return made.select("page_id", "furniture", "kept")


def _lines(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    return page_lines(load_pages(spark, sf_dir, "title", "completeness_report.warnings"), text=text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not part of the article, of pages that are no case of problems 1 and 5."""
    return _lines(spark, sf_dir, text=False).select("page_id", F.explode("furniture").alias("line_no"))


def p2_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every such page: page_id, n_removed, article."""
    return _lines(spark, sf_dir).select("page_id", F.size("furniture").cast("bigint").alias("n_removed"), F.col("kept").alias("article"))


def html_pages(fetches: DataFrame) -> DataFrame:
    """page_id (the fetch's id), markdown, title, host of fetched HTML, as a table in the shared folder, as several passes read it and parsing is the dear part."""
    made = html.parse(fetches.where(F.col("html").isNotNull()), ["fetch_id", "url"], escape=False)
    rows = made.select(F.col("fetch_id").alias("page_id"), F.col("page.markdown").alias("markdown"), F.col("page.title").alias("title"), "url")
    return stored(pages_with_host(rows, None, ["page_id", "markdown", "title"]))


def p2_html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every fetched HTML document that is no such case: fetch_id, n_removed, article."""
    lines = page_lines(html_pages(texts(spark, sf_dir, "fetched_pages")))
    return lines.select(F.col("page_id").alias("fetch_id"), F.size("furniture").cast("bigint").alias("n_removed"), F.col("kept").alias("article"))


QUERIES = {"p2_found": p2_found, "p2_articles": p2_articles, "p2_html_articles": p2_html_articles}
ORACLE: dict[str, str] = {}
