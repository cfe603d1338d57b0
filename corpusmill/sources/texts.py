"""Sitemaps and robots files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import trim


def sitemap_urls(documents: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """url, kind ('page' or 'index'), loc, seq: entries of sitemap documents. Text that is no sitemap gives no rows."""
    well = documents.where(F.col(xml).isNotNull() & F.contains(F.col(xml), F.lit("<")))
    body = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"<!\[CDATA\[([^\]]*)\]\]>", "$1")
    entry = lambda tag: F.regexp_extract_all(body, F.lit(rf"<(?:\w+:)?{tag}\b[^>]*>([\s\S]*?)</(?:\w+:)?{tag}>"), F.lit(1))
    kinds = F.array(F.struct(F.lit("page").alias("kind"), entry("url").alias("items")), F.struct(F.lit("index").alias("kind"), entry("sitemap").alias("items")))
    rows = well.select(F.col(url).alias("url"), F.explode(kinds).alias("k")).select("url", "k.kind", F.posexplode("k.items").alias("seq", "item"))
    loc = trim(F.regexp_extract("item", r"<(?:\w+:)?loc\b[^>]*>([^<]*)<", 1))
    plain = F.replace(F.replace(F.replace(F.replace(loc, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return rows.select("url", "kind", plain.alias("loc"), "seq").where("loc <> ''")


def robots_sitemaps(documents: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """url, sitemap, seq: addresses of the Sitemap lines of robots files."""
    rows = documents.select(F.col(url).alias("url"), F.posexplode(F.split(text, "\n")).alias("seq", "line"))
    named = rows.where(F.rlike(trim("line"), F.lit("(?i)^sitemap:"))).select("url", trim(F.regexp_replace(trim("line"), "(?i)^sitemap:", "")).alias("sitemap"), "seq")
    return named.where("sitemap <> ''")


def nested_sitemaps(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """root, loc: pages of each root sitemap (url) and of all sitemaps it leads to among the documents (url, xml); cycles end.

    A loop over levels with an anti-join against what was visited, to the deepest level there is.
    """
    entries = sitemap_urls(documents)
    links = entries.where("kind = 'index'").select(F.col("url").alias("from_url"), F.col("loc").alias("to_url")).distinct()
    visited = roots.select(F.col("url").alias("root"), F.col("url").alias("at")).distinct()
    frontier = visited
    while True:
        step = frontier.join(links, F.col("at") == F.col("from_url")).select("root", F.col("to_url").alias("at")).distinct()
        known = visited.select(F.col("root").alias("kr"), F.col("at").alias("ka"))
        frontier = step.join(known, (F.col("root") == F.col("kr")) & (F.col("at") == F.col("ka")), "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    pages = entries.where("kind = 'page'").select(F.col("url").alias("p_url"), "loc")
    return visited.join(pages, F.col("at") == F.col("p_url")).select("root", "loc").distinct()
