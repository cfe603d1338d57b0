"""Settings of a crawl and their limits."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from .operators.discovery import DEFAULT_EXCLUDES


def _between(low: int, high: int | None = None):
    return lambda x: max(low, x) if high is None else min(high, max(low, x))


# Limits of the numeric settings.
LIMITS = {"max_concurrency": _between(1, 20), "max_crawl_depth": _between(0), "max_retries": _between(0), "wait_for_ms": _between(0, 30_000), "scrape_timeout_ms": _between(5_000, 120_000), "max_linked_pdfs_per_page": _between(1, 100)}
# Older names of two settings.
LEGACY = {"post_interaction_delay_ms": "wait_for_ms", "playwright_navigation_timeout_ms": "scrape_timeout_ms"}


@dataclass(frozen=True)
class Settings:
    user_agent: str = "corpusmill/1.0"
    request_delay_ms: int = 600
    max_concurrency: int = 2
    max_crawl_depth: int = 3
    max_retries: int = 3
    include_patterns: str = ""
    exclude_patterns: str = DEFAULT_EXCLUDES
    fallback_crawl: bool = True
    wait_for_ms: int = 3_000
    scrape_timeout_ms: int = 60_000
    rag_optimized: bool = True
    download_linked_pdfs: bool = True
    max_linked_pdfs_per_page: int = 100
    include_pdf_links_in_page_body: bool = False


def settings(given: Mapping[str, Any] | None = None) -> Settings:
    """Defaults overlaid with what is given, within the limits. An older name counts only where the new one is explicitly None."""
    given = dict(given or {})
    for old, new in LEGACY.items():
        if old in given and new in given and given[new] is None:
            given[new] = int(given[old])
    known = {f.name for f in fields(Settings)}
    chosen = {k: v for k, v in given.items() if k in known and v is not None}
    return Settings(**{k: LIMITS[k](v) if k in LIMITS else v for k, v in chosen.items()})
