"""Fetching pages inside tasks. The fetcher is a plain function, so tests and offline runs hand in a snapshot."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import urls

SCHEMA = pa.schema([("url", pa.string()), ("markdown", pa.string()), ("html", pa.string()), ("final_url", pa.string()), ("fetch_method", pa.string()), ("extracted_title", pa.string()), ("attempts", pa.int64()), ("error", pa.string())])
Fetcher = Callable[[str, dict], dict]


def http_fetch(url: str, settings: dict) -> dict:
    """Static fetch over HTTP; any answer but success raises."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": settings["user_agent"]}), timeout=settings["scrape_timeout_ms"] / 1000) as answer:  # noqa: S310
        body = answer.read()
        return {"html": body.decode(answer.headers.get_content_charset() or "utf-8", "replace"), "final_url": answer.url, "fetch_method": "static"}


def fetch(found: DataFrame, settings: Settings, fetcher: Fetcher = http_fetch, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """url and what its fetch gave; a page that fails every attempt has an error. Waits grow with the attempts.

    URLs are filtered before anything is fetched, and spread over as many tasks as requests may run at once.
    """
    wanted = found.where(urls.is_absolute("url") & urls.matches_patterns("url", settings.include_patterns, settings.exclude_patterns)).select("url").distinct()
    given = asdict(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                row: dict = {"url": url}
                for attempt in range(given["max_retries"] + 1):
                    row["attempts"] = attempt + 1
                    try:
                        got = fetcher(url, given)
                        if not got.get("html") and not got.get("markdown"):
                            raise ValueError("the answer is empty")
                        row |= {k: got.get(k) for k in ("markdown", "html", "final_url", "fetch_method", "extracted_title")} | {"error": None}
                        row["final_url"] = row["final_url"] or url
                        break
                    except Exception as why:  # each failure becomes a row, not the end of the job
                        row["error"] = str(why) or type(why).__name__
                        if attempt < given["max_retries"]:
                            pause(given["request_delay_ms"] / 1000 * (attempt + 1))
                rows.append(row)
                pause(given["request_delay_ms"] / 1000)
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    ddl = "url string, markdown string, html string, final_url string, fetch_method string, extracted_title string, attempts bigint, error string"
    return wanted.repartition(settings.max_concurrency, "url").mapInArrow(run, ddl)


def fetch_texts(wanted: DataFrame, settings: Settings, fetcher: Fetcher = http_fetch) -> DataFrame:
    """url, text of sitemap and robots addresses (url), once each; what cannot be fetched gives a null text."""
    given = asdict(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for url in batch.column(0).to_pylist():
                try:
                    text = fetcher(url, given).get("html")
                except Exception:  # a missing sitemap is no error: the next place is tried
                    text = None
                out[0].append(url)
                out[1].append(text)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["url", "text"])

    return wanted.where(urls.is_absolute("url")).select("url").distinct().repartition(settings.max_concurrency, "url").mapInArrow(run, "url string, text string")


def dispatch(rendered: Fetcher | None, static: Fetcher = http_fetch) -> Fetcher:
    """A fetcher that renders where it can and otherwise, or where rendering fails or gives nothing, fetches the page as it is. The rendered title and URL come first."""

    def either(url: str, given: dict) -> dict:
        if rendered is not None:
            try:
                got = rendered(url, given)
                if got.get("html") or got.get("markdown"):
                    return {"final_url": url, **{k: v for k, v in got.items() if v}, "fetch_method": "firecrawl"}
            except Exception:  # rendering is a service that may be down
                pass
        return static(url, given)

    return either


def history(runs: DataFrame, most: int = 50) -> DataFrame:
    """The newest runs (scraped_at, success_count) with at least one page."""
    return runs.where("success_count > 0").orderBy(F.col("scraped_at").desc()).limit(most)

