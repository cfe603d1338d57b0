"""Problem 3: lines repeated across the pages of one host.

State is a pair of tables: pages per host and line, and pages per host. A new partition of pages is counted by itself (one shuffle,
pre-aggregated on the map side) and merged as a delta; comparing the states before and after gives the lines that crossed the
threshold. The occurrences found so far are then only corrected - those of crossed lines come or go, those of the new pages are added - and only
pages that hold a crossed line are built again.

A page counts once for a line however often it holds the line, so the count of a line is the sum over
partitions of pages, which makes deltas additive. Lines are hashed once, before anything is shuffled; from then on only 64-bit keys move. States and keys
are tables in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import pages_with_host, single_blanks, table, texts, trim_blanks

MIN_CHARS = 20
MIN_PAGES = 5
MIN_SHARE = 0.15
#: Pages ingested later than this after discovery make the second partition in the queries.
LATE_DAYS = 7


def line_keys(markdown: Column, min_chars: int = MIN_CHARS) -> Column:
    """Array with, for each line of the markdown, the hash of its form; null for lines that do not count.

    The form in which two lines are the same: trimmed, lower case, single blanks, digit runs as 0.
    """
    form = lambda x: F.regexp_replace(single_blanks(F.lower(x)), "[0-9]+", "0")
    counts = lambda x: (F.length(x) >= min_chars) & ~F.startswith(x, F.lit("#"))
    trimmed = F.transform(F.split(markdown, "\n"), trim_blanks)
    return F.transform(trimmed, lambda x: F.when(counts(x), F.xxhash64(form(x))))


def keyed_pages(pages: DataFrame, meta: DataFrame | None = None, *keep: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """page_id, columns of keep, host, keys: the hash of host and line form of every line, null for lines that do not count.

    pages: (page_id, markdown, url) and, for a host by metadata, meta (page_id, source_domain, meta_id); pages with a column host need neither url nor meta. Null
    markdown gives no row, repeated pages count as they stand. Texts stay where they are read; the host joins the hashes.
    """
    own = pages.where(F.col("markdown").isNotNull()).withColumn("keys", line_keys(F.col("markdown"), min_chars))
    placed = own.select("page_id", *keep, "host", "keys") if "host" in pages.columns else pages_with_host(own, meta, ["page_id", *keep, "keys"])
    return placed.withColumn("keys", F.transform("keys", lambda k: F.when(k.isNotNull(), F.xxhash64("host", k))))


@dataclass
class State:
    """lines: host, line_key, n_pages. hosts: host, host_pages."""

    lines: DataFrame
    hosts: DataFrame

    def stored(self) -> State:
        return State(stored(self.lines), stored(self.hosts))

    def merge(self, delta: State) -> State:
        """The state after a delta; counts add up."""
        lines = self.lines.unionByName(delta.lines).groupBy("host", "line_key").agg(F.sum("n_pages").alias("n_pages"))
        hosts = self.hosts.unionByName(delta.hosts).groupBy("host").agg(F.sum("host_pages").alias("host_pages"))
        return State(lines, hosts)

    def excessive(self, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
        """host, line_key, n_pages, host_pages of the lines on enough pages and on enough of the host's pages."""
        often = self.lines.where(F.col("n_pages") >= min_pages).join(self.hosts, "host")
        return often.where(F.col("n_pages") >= F.lit(min_share) * F.col("host_pages")).select("host", "line_key", "n_pages", "host_pages")


def count_partition(keyed: DataFrame) -> State:
    """Delta of a partition of keyed_pages()."""
    lines = keyed.select("host", F.explode(F.array_compact(F.array_distinct("keys"))).alias("line_key")).groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n_pages"))
    return State(lines, keyed.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")))


def crossings(before: DataFrame, after: DataFrame) -> DataFrame:
    """host, line_key, crossed ('up' newly excessive, 'down' no longer) between two results of excessive()."""
    a = before.select(F.col("host").alias("h0"), F.col("line_key").alias("k0"))
    b = after.select(F.col("host").alias("h1"), F.col("line_key").alias("k1"))
    both = a.join(b, (F.col("h0") == F.col("h1")) & (F.col("k0") == F.col("k1")), "full_outer")
    return both.where(F.col("k0").isNull() | F.col("k1").isNull()).select(
        F.coalesce("h1", "h0").alias("host"),
        F.coalesce("k1", "k0").alias("line_key"),
        F.when(F.col("k0").isNull(), "up").otherwise("down").alias("crossed"),
    )


def occurrences(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, line_no, line_key of every occurrence of the found lines on keyed pages."""
    keys = found.select(F.col("line_key").alias("_k")).distinct()
    numbered = keyed.select("page_id", F.posexplode("keys").alias("line_no", "line_key")).where(F.col("line_key").isNotNull())
    return numbered.join(keys, F.col("line_key") == F.col("_k"), "left_semi").select("page_id", "line_no", "line_key")


def corrected(occurred: DataFrame, old: DataFrame, new: DataFrame, crossed: DataFrame, after: DataFrame) -> DataFrame:
    """The occurrences after a new partition: those so far without the lines that fell, the old pages' of the lines that rose, and all of the new pages."""
    fell, rose = (crossed.where(F.col("crossed") == way).select(F.col("line_key").alias("_k")) for way in ("down", "up"))
    stay = occurred.join(fell, F.col("line_key") == F.col("_k"), "left_anti")
    return stay.unionByName(occurrences(old, rose.withColumnRenamed("_k", "line_key"))).unionByName(occurrences(new, after))


def without_lines(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """page_id, n_removed, markdown of pages (page_id, markdown) without the lines of gone (page_id, line_no)."""
    lines = gone.groupBy(F.col("page_id").alias("_g")).agg(F.collect_set("line_no").alias("_gone"))
    numbered = F.transform(F.split("markdown", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.filter(numbered, lambda s: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), s["i"]))
    return pages.join(lines, F.col("page_id") == F.col("_g"), "left").select(
        "page_id",
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("markdown")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n")).alias("markdown"),
    )


def rebuild(pages: DataFrame, keyed: DataFrame, crossed: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, n_removed, markdown of the pages that hold a crossed line, without any line that is excessive now; other pages give no row."""
    touched = occurrences(keyed, crossed).select(F.col("page_id").alias("_p")).distinct()
    again = keyed.join(touched, F.col("page_id") == F.col("_p"), "left_semi")
    return without_lines(pages.select("page_id", "markdown").join(touched, F.col("page_id") == F.col("_p"), "left_semi"), occurrences(again, after))


@dataclass
class Run:
    """Two partitions of pages, one after the other: keyed pages of both, excessive lines before and after the second, and what crossed."""

    early: DataFrame
    late: DataFrame
    before: DataFrame
    after: DataFrame
    crossed: DataFrame

    def found(self) -> DataFrame:
        return corrected(occurrences(self.early, self.before), self.early, self.late, self.crossed, self.after)


def run(pages: DataFrame, meta: DataFrame | None) -> Run:
    """The first partition counted into a state, the late pages (column late) merged as a delta; states, keys and crossings stored."""
    keyed = stored(keyed_pages(pages, meta, "late"))
    early, late = keyed.where("NOT late"), keyed.where("late")
    state = count_partition(early).stored()
    merged = state.merge(count_partition(late)).stored()
    before, after = stored(state.excessive()), stored(merged.excessive())
    return Run(early, late, before, after, stored(crossings(before, after)))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.coalesce(F.col("ingested_at") > F.col("discovered_at") + F.expr(f"INTERVAL {LATE_DAYS} DAYS"), F.lit(False))
    return texts(spark, sf_dir, "discovered_pages").where(F.col("markdown").isNotNull()).select("page_id", "url", "markdown", late.alias("late"))


def _run(spark: SparkSession, sf_dir: str) -> Run:
    return run(_pages(spark, sf_dir), table(spark, sf_dir, "page_metadata"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line repeated excessively on its host: those of the first partition, corrected by the delta of the late one."""
    return _run(spark, sf_dir).found().select("page_id", F.col("line_no").cast("bigint").alias("line_no"))


def p3_crossed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose standing the late partition changes: host, crossed, n_lines."""
    return _run(spark, sf_dir).crossed.groupBy("host", "crossed").agg(F.count(F.lit(1)).alias("n_lines"))


def p3_rebuilt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the first partition that the late one makes build again: page_id, n_removed, markdown."""
    r = _run(spark, sf_dir)
    return rebuild(_pages(spark, sf_dir).where("NOT late"), r.early, r.crossed, r.after)


def p3_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its excessive lines: page_id, n_removed, markdown."""
    return without_lines(_pages(spark, sf_dir).select("page_id", "markdown"), _run(spark, sf_dir).found())


QUERIES = {"p3_found": p3_found, "p3_crossed_lines": p3_crossed_lines, "p3_rebuilt_pages": p3_rebuilt_pages, "p3_clean_pages": p3_clean_pages}

_HOST = r"""
 meta AS (SELECT page_id, arg_min(regexp_replace(regexp_replace(lower(trim(source_domain)), '\.$', ''), '^www\.', ''), meta_id) AS mh
   FROM page_metadata WHERE source_domain IS NOT NULL GROUP BY page_id),
 pages AS (SELECT p.page_id, p.markdown, coalesce(p.ingested_at > p.discovered_at + INTERVAL 7 DAY, false) AS late,
   coalesce(m.mh, regexp_replace(regexp_replace(lower(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '\.$', ''), '^www\.', '')) AS host
   FROM discovered_pages p LEFT JOIN meta m USING (page_id) WHERE p.markdown IS NOT NULL),
 cut AS (SELECT page_id, host, late, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no FROM pages),
 trimmed AS (SELECT page_id, host, late, line_no, line, regexp_replace(line, '^[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS t FROM cut),
 forms AS (SELECT page_id, host, late, line_no, regexp_replace(regexp_replace(lower(t), '[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '[0-9]+', '0', 'g') AS form
   FROM trimmed WHERE length(t) >= 20 AND NOT starts_with(t, '#'))"""
_FOUND = """
 lines AS (SELECT host, form, count(DISTINCT page_id) AS n FROM forms {where} GROUP BY host, form),
 hosts AS (SELECT host, count(*) AS hp FROM pages {where} GROUP BY host),
 found AS (SELECT host, form FROM lines JOIN hosts USING (host) WHERE n >= 5 AND n >= 0.15 * hp)"""

ORACLE = {
    "p3_found": f"WITH {_HOST}, {_FOUND.format(where='')} SELECT page_id, line_no::BIGINT AS line_no FROM forms JOIN found USING (host, form)",
    "p3_crossed_lines": f"""WITH {_HOST}, {_FOUND.format(where='')},
 lines0 AS (SELECT host, form, count(DISTINCT page_id) AS n FROM forms WHERE NOT late GROUP BY host, form),
 hosts0 AS (SELECT host, count(*) AS hp FROM pages WHERE NOT late GROUP BY host),
 found0 AS (SELECT host, form FROM lines0 JOIN hosts0 USING (host) WHERE n >= 5 AND n >= 0.15 * hp),
 crossed AS ((SELECT host, form, 'up' AS crossed FROM (SELECT * FROM found EXCEPT SELECT * FROM found0))
   UNION ALL (SELECT host, form, 'down' AS crossed FROM (SELECT * FROM found0 EXCEPT SELECT * FROM found)))
 SELECT host, crossed, count(*) AS n_lines FROM crossed GROUP BY host, crossed""",
    "p3_rebuilt_pages": f"""WITH {_HOST}, {_FOUND.format(where='')},
 lines0 AS (SELECT host, form, count(DISTINCT page_id) AS n FROM forms WHERE NOT late GROUP BY host, form),
 hosts0 AS (SELECT host, count(*) AS hp FROM pages WHERE NOT late GROUP BY host),
 found0 AS (SELECT host, form FROM lines0 JOIN hosts0 USING (host) WHERE n >= 5 AND n >= 0.15 * hp),
 crossed AS ((SELECT * FROM found EXCEPT SELECT * FROM found0) UNION ALL (SELECT * FROM found0 EXCEPT SELECT * FROM found)),
 touched AS (SELECT DISTINCT page_id FROM forms JOIN crossed USING (host, form) WHERE NOT late),
 gone AS (SELECT page_id, line_no FROM forms JOIN found USING (host, form)),
 kept AS (SELECT c.page_id, string_agg(c.line, chr(10) ORDER BY c.line_no) FILTER (WHERE g.line_no IS NULL) AS markdown, count(g.line_no) AS n_removed
   FROM cut c JOIN touched USING (page_id) LEFT JOIN gone g ON c.page_id = g.page_id AND c.line_no = g.line_no GROUP BY c.page_id)
 SELECT page_id, n_removed, coalesce(markdown, '') AS markdown FROM kept""",
    "p3_clean_pages": f"""WITH {_HOST}, {_FOUND.format(where='')},
 gone AS (SELECT page_id, line_no FROM forms JOIN found USING (host, form)),
 kept AS (SELECT c.page_id, string_agg(c.line, chr(10) ORDER BY c.line_no) FILTER (WHERE g.line_no IS NULL) AS markdown, count(g.line_no) AS n_removed
   FROM cut c LEFT JOIN gone g ON c.page_id = g.page_id AND c.line_no = g.line_no GROUP BY c.page_id)
 SELECT page_id, n_removed, coalesce(markdown, '') AS markdown FROM kept""",
}
