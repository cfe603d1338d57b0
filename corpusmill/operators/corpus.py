"""The manifest, its aggregates, and the joins between a crawl session and what is already saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dialect import blank_to_null, round_half_up


def survivors(entries: DataFrame, order: str = "seq", by: str = "domain", slug: str = "slug", url: str = "url") -> DataFrame:
    """Entries left after upserting them in order: a later entry replaces all with its slug or its URL.

    An entry stays if it is the last of its slug and the last of its URL. A null slug or URL equals only nulls. The last
    numbers are aggregates, combined before the shuffle; the entries meet them by key and number together, so a slug or
    URL with very many entries is spread over the tasks.
    """
    keyed = entries.withColumn("_norm", urls.normalize_persisted(url))
    left = keyed
    for key in (slug, "_norm"):
        last = keyed.groupBy(F.col(by).alias("_by"), F.col(key).alias("_key")).agg(F.max(order).alias("_last"))
        left = left.join(last, F.col(by).eqNullSafe(F.col("_by")) & F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_last")), "left_semi")
    return left.drop("_norm")


def totals(entries: DataFrame, by: str = "domain") -> DataFrame:
    """by, page_count, total_word_count, total_token_estimate; missing counts are 0."""
    return entries.groupBy(by).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_word_count"),
        F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("total_token_estimate"),
    )


def index_lines(entries: DataFrame, order: str = "seq", by: str = "domain") -> DataFrame:
    """by, line_no, line: numbered document list of each corpus in upsert order.

    Numbers come from counts per block of the order, so only blocks, never a whole domain, are sorted in one task.
    """
    stats = F.when(F.col("token_estimate").isNotNull(), F.concat(F.lit(" (~"), F.format_number("token_estimate", 0), F.lit(" tokens)"))).otherwise("")
    numbered = number_rows(entries, by, order)
    name = F.coalesce(blank_to_null(F.col("title")), F.col("slug"))
    return numbered.select(by, F.col("row_no").alias("line_no"), F.concat(F.col("row_no").cast("string"), F.lit(". "), F.coalesce(name, F.lit("")), F.lit(" — "), F.coalesce("url", F.lit("")), stats).alias("line"))


def number_rows(rows: DataFrame, by: str, order: str, block: int = 65_536) -> DataFrame:
    """rows with row_no from 1 within by, in ascending order of a whole-number column without ties.

    Blocks of the order are numbered by themselves; the offsets of the blocks are a small table of counts.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocked.groupBy(by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(by).alias("_by"), F.col("_block").alias("_b"), before.alias("_before"))
    placed = blocked.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_b")))
    here = F.row_number().over(Window.partitionBy(by, "_block").orderBy(order))
    return placed.withColumn("row_no", (F.col("_before") + here).cast("bigint")).drop("_block", "_by", "_b", "_before")


def _saved_by(saved: DataFrame, key: str, order: str, pick) -> DataFrame:
    """One entry (slug, title) of each domain and key ('url' or 'slug'), the first or last in order; entries without the key give none."""
    entries = saved.select(F.col("domain").alias("_d"), F.col(order).alias("_o"), urls.normalize_persisted("url").alias("_url"), F.col("slug").alias("_slug"), F.col("title").alias("_title"))
    found = entries.where(F.col(f"_{key}").isNotNull()).groupBy(F.col("_d").alias(f"_{key}_domain"), F.col(f"_{key}").alias(f"_{key}_key"))
    return found.agg(pick(F.struct(F.col("_slug").alias("slug"), F.col("_title").alias("title")), F.col("_o")).alias(f"_by_{key}"))


def _looked_up(session: DataFrame, saved: DataFrame, order: str, pick) -> DataFrame:
    """session (with columns _domain, _k and _ks) with the saved entry of its domain by URL (_by_url) and by slug (_by_slug)."""
    for key, own in (("url", "_k"), ("slug", "_ks")):
        hit = _saved_by(saved, key, order, pick)
        session = session.join(hit, (F.col("_domain") == F.col(f"_{key}_domain")) & (F.col(own) == F.col(f"_{key}_key")), "left")
    return session


def resume(session: DataFrame, saved: DataFrame, order: str = "seq") -> DataFrame:
    """Session rows with what is saved of their domain: page_id, url, matched_by ('url', 'slug' or null), status, selected, saved_slug, saved_title.

    A saved page matches by URL, else by the slug that the session URL gives; of saved pages with one key the last counts. A match sets
    the status to done and takes the selection away; pages that were being fetched wait again.
    """
    keyed = restored(session).select("page_id", "url", "status", "selected", urls.domain_key("url").alias("_domain"), urls.normalize_persisted("url").alias("_k"), urls.slug("url").alias("_ks"))
    joined = _looked_up(keyed, saved, order, F.max_by)
    match = F.coalesce("_by_url", "_by_slug")
    return joined.select(
        "page_id",
        "url",
        F.when(F.col("_by_url").isNotNull(), "url").when(F.col("_by_slug").isNotNull(), "slug").alias("matched_by"),
        F.when(match.isNotNull(), "done").otherwise(F.col("status")).alias("status"),
        F.when(match.isNotNull(), F.lit(False)).otherwise(F.col("selected")).alias("selected"),
        match["slug"].alias("saved_slug"),
        match["title"].alias("saved_title"),
    )


def preview(session: DataFrame, saved: DataFrame, order: str = "seq") -> DataFrame:
    """page_id, saved_slug, saved_title: the first saved page of the session row's domain with its URL, else the first with its slug; rows without one give nulls."""
    keyed = session.select("page_id", urls.domain_key("url").alias("_domain"), urls.normalize_persisted("url").alias("_k"), F.col("slug").alias("_ks"))
    hit = F.coalesce("_by_url", "_by_slug")
    return _looked_up(keyed, saved, order, F.min_by).select("page_id", hit["slug"].alias("saved_slug"), hit["title"].alias("saved_title"))


def patch(rows: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """rows with the columns of the last patch of each key; a patch's null leaves the old value. Rows without a patch stay."""
    own = patches.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*columns), order).alias("_p"))
    joined = rows.join(own, F.col(key) == F.col("_k"), "left")
    return joined.select(*(F.coalesce(F.col("_p")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def is_complete(status: Column, markdown: Column, slug: Column) -> Column:
    return F.coalesce((status == "done") & (markdown != "") & (slug != ""), F.lit(False))


def progress(session: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of a session and its progress in percent: done and failed pages of all, over the selected pages (all, where none is selected)."""
    selected, done, failed = (F.count_if(F.coalesce(c, F.lit(False))) for c in (F.col("selected"), F.col("status") == "done", F.col("status") == "error"))
    counted = session.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pages"), selected.alias("n_selected"), done.alias("n_done"), failed.alias("n_error"), F.count_if(~F.col("status").eqNullSafe("done")).alias("n_remaining"))
    total = F.when(F.col("n_selected") > 0, F.col("n_selected")).otherwise(F.col("n_pages"))
    processed = F.col("n_done") + F.col("n_error")
    return counted.withColumn("progress", F.when(total > 0, round_half_up(processed / total * 100)).otherwise(0).cast("bigint"))


def eta_text(seconds: Column) -> Column:
    """Time left in words; a dash where it is unknown or over."""
    whole = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.ceil(seconds % 60).cast("string"), F.lit("s"))
    return F.when(seconds.isNull() | (seconds <= 0) | F.isnan(seconds), "—").when(seconds < 60, F.concat(F.ceil(seconds).cast("string"), F.lit("s"))).otherwise(whole)


def pages_per_second(session: DataFrame, started: Column, now: Column, by: Sequence[str] = ()) -> DataFrame:
    """by, rate, seconds_left of a running crawl: pages done or failed a second since it started, and the time that the remaining selected pages take at that rate; null before the first page."""
    counted = progress(session, by)
    processed, total = F.col("n_done") + F.col("n_error"), F.when(F.col("n_selected") > 0, F.col("n_selected")).otherwise(F.col("n_pages"))
    spent = F.unix_millis(now) - F.unix_millis(started)
    rate = F.when((processed > 0) & (spent > 0), processed / (spent / 1000))
    return counted.withColumn("rate", rate).withColumn("seconds_left", F.greatest(total - processed, F.lit(0)) / F.col("rate")).select(*by, "rate", "seconds_left")


def save_counts(session: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n_saved, n_failed, any_saved, all_done: complete pages, failed ones, whether there is anything to save and whether every selected page is done."""
    complete, wanted = is_complete(F.col("status"), F.col("markdown"), F.col("slug")), F.coalesce(F.col("selected"), F.lit(False))
    return session.groupBy(*by).agg(
        F.count_if(complete).alias("n_saved"),
        F.count_if(F.coalesce(F.col("status") == "error", F.lit(False))).alias("n_failed"),
        F.coalesce(F.bool_or(complete), F.lit(False)).alias("any_saved"),
        F.coalesce(F.bool_and(F.coalesce(F.col("status") == "done", F.lit(False)) | ~wanted), F.lit(False)).alias("all_done"),
    )


def persistable(session: DataFrame) -> DataFrame:
    """A session as it is stored: without the texts, which the saved files have."""
    return session.drop("markdown", "linked_pdfs")


def scrape_summary(pages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean score, low scores (below 50), rendered fetches and total of pages (status, completeness_score, fetch_method) that are done and scored."""
    scored = pages.where((F.col("status") == "done") & F.col("completeness_score").isNotNull())
    return scored.groupBy(*by).agg(
        round_half_up(F.avg("completeness_score")).cast("bigint").alias("avg_score"),
        F.count_if(F.col("completeness_score") < 50).alias("n_low"),
        F.count_if(F.col("fetch_method") == "firecrawl").alias("n_rendered"),
        F.count(F.lit(1)).alias("n_scored"),
    )


def restored(session: DataFrame) -> DataFrame:
    """A stored session as it is opened again: pages that were being fetched wait again."""
    return session.withColumn("status", F.when(F.col("status") == "scraping", "pending").otherwise(F.col("status")))


def session_rows(found: DataFrame, url: str = "url") -> DataFrame:
    """Session rows of discovered URLs: id, url, title (path), selected, status."""
    return found.select(
        urls.page_key(url).alias("id"), F.col(url).alias("url"), F.coalesce(urls.pathname(url), F.col(url)).alias("title"), F.lit(True).alias("selected"), F.lit("pending").alias("status")
    )
