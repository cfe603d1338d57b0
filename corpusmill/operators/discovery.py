"""Which URLs a site has: first-seen order, filters, and a breadth-first walk over its link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.texts import nested_sitemaps, robots_sitemaps

DEFAULT_EXCLUDES = "/tag/,/author/,/wp-json/,/feed/,?replytocom=,/login,/cart,/mysupermicro,/search?"
# Places where a site's sitemap is looked for, in order.
SITEMAP_CANDIDATES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml", "/sitemaps/sitemap.xml", "/sitemap1.xml", "/post-sitemap.xml", "/page-sitemap.xml")
ROBOTS = "/robots.txt"


def first_seen(found: DataFrame, by: str, url: str, order: str) -> DataFrame:
    """by, url, first_seen: each URL once, with its smallest order."""
    return found.where(F.col(url).isNotNull()).groupBy(by, F.col(url).alias("url")).agg(F.min(order).alias("first_seen"))


def links(edges: DataFrame, by: str = "domain", src: str = "src", href: str = "href") -> DataFrame:
    """by, source, target: distinct links between normalised URLs of one origin.

    Anchors and mail addresses are no links. A relative target counts from the origin, not from the page that has it.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(href).isNotNull()).select(F.col(by).alias("by"), urls.canonical(src).alias("page"), F.trim(href).alias("h"))
    some = e.where((F.col("h") != "") & ~F.rlike("h", F.lit("^(#|(?i:mailto:|javascript:|tel:))")))
    placed = some.withColumn("origin", F.regexp_extract("page", r"^([a-z][a-z0-9+.\-]*://[^/?#]*)", 1))
    absolute = (
        F.when(F.rlike("h", F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), F.col("h"))
        .when(F.startswith("h", F.lit("//")), F.concat(F.regexp_extract("origin", "^[a-z]+:", 0), "h"))
        .when(F.startswith("h", F.lit("/")), F.concat("origin", "h"))
        .otherwise(F.concat("origin", F.lit("/"), F.regexp_replace("h", r"^(\./)+", "")))
    )
    # Step by step, so that each intermediate column is computed once.
    rows = placed.withColumn("absolute", absolute).withColumn("target", urls.normalize_discovered("absolute")).withColumn("source", urls.normalize_discovered("page"))
    inside = rows.where(F.col("target").isNotNull() & urls.same_origin("target", "origin"))
    return inside.select(F.col("by").alias(by), "source", "target").distinct()


def crawl(graph: DataFrame, seeds: DataFrame, by: str, max_depth: int, includes: str = "", excludes: str = DEFAULT_EXCLUDES) -> DataFrame:
    """by, url, depth: pages reached from the seeds (by, url) over the graph (by, source, target) in at most max_depth steps.

    A target outside the patterns is neither listed nor followed. The graph is read at every level, so hand in a written or checkpointed one. One join and one anti-join a level, levels bounded by max_depth; each
    level is cut from its history through the checkpoint folder of the session, so plans stay short and a lost executor
    does not walk the graph again.
    """
    edges = graph.where(urls.matches_patterns("target", includes, excludes) & (F.col("source") != F.col("target")))
    seen = seeds.select(F.col(by).alias("by"), F.col("url").alias("url")).distinct().withColumn("depth", F.lit(0))
    step = edges.select(F.col(by).alias("e_by"), F.col("source"), F.col("target"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(step, (F.col("by") == F.col("e_by")) & (F.col("url") == F.col("source"))).select("by", F.col("target").alias("url")).distinct()
        known = seen.select(F.col("by").alias("k_by"), F.col("url").alias("k_url"))
        frontier = reached.join(known, (F.col("by") == F.col("k_by")) & (F.col("url") == F.col("k_url")), "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select(F.col("by").alias(by), "url", "depth")


def choose(candidates: DataFrame, by: str, rank: str) -> DataFrame:
    """All rows of the best-ranked candidate of each by; a candidate without rows does not compete."""
    best = candidates.groupBy(F.col(by).alias("_by")).agg(F.min(rank).alias("_rank"))
    return candidates.join(best, (F.col(by) == F.col("_by")) & (F.col(rank) == F.col("_rank")), "left_semi")


def sitemap_candidates(origins: DataFrame) -> DataFrame:
    """origin, rank, url: the places where the sitemap of each origin may be, and, ranked last, its robots file."""
    places = F.array(*(F.lit(x) for x in (*SITEMAP_CANDIDATES, ROBOTS)))
    return origins.select("origin", F.posexplode(places).alias("rank", "place")).select("origin", "rank", F.concat("origin", "place").alias("url"))


def discover(origins: DataFrame, documents: DataFrame, graph: DataFrame, max_depth: int = 3, includes: str = "", excludes: str = DEFAULT_EXCLUDES, fallback_crawl: bool = True) -> DataFrame:
    """origin, url, source ('sitemap' or 'crawl'): the pages of each origin, from the first sitemap place that names any, else from the sitemaps of its robots file, else by a walk.

    documents (url, text) holds whatever was fetched of sitemap_candidates() and of the sitemaps that those lead to; graph (by origin, source, target) is links() of the pages, read only for origins
    without a sitemap. URLs of other origins and outside the patterns are left out; a walk starts at the origin itself.
    """
    files = documents.select("url", F.col("text").alias("xml"))
    places = sitemap_candidates(origins).where(F.col("url").isNotNull())
    listed = nested_sitemaps(files, places.where(~F.endswith("url", F.lit(ROBOTS))).select("url").distinct())
    named = choose(places.join(listed, F.col("url") == F.col("root")).select("origin", "rank", "loc"), "origin", "rank").select("origin", "loc").checkpoint()
    rest = origins.select("origin").distinct().join(named.select(F.col("origin").alias("_o")).distinct(), F.col("origin") == F.col("_o"), "left_anti").checkpoint()
    robots = robots_sitemaps(rest.join(documents, F.concat("origin", F.lit(ROBOTS)) == F.col("url")).select(F.col("origin").alias("url"), "text"))
    told = robots.select(F.col("url").alias("origin"), "sitemap").distinct().checkpoint()
    from_robots = told.join(nested_sitemaps(files, told.select(F.col("sitemap").alias("url")).distinct()), F.col("sitemap") == F.col("root")).select("origin", "loc")
    site = named.unionByName(from_robots).select("origin", urls.normalize_discovered("loc").alias("url"), F.lit("sitemap").alias("source")).checkpoint()
    if fallback_crawl:
        left = rest.join(site.select(F.col("origin").alias("_o")).distinct(), F.col("origin") == F.col("_o"), "left_anti").select("origin", F.col("origin").alias("url"))
        site = site.unionByName(crawl(graph, left, "origin", max_depth, includes, excludes).select("origin", "url", F.lit("crawl").alias("source")))
    return site.where(urls.same_origin("url", "origin") & urls.matches_patterns("url", includes, excludes)).distinct()
