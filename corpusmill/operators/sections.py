"""Sections of a page's markdown with word and token counts.

A heading of level one to three opens a section unless its text is a user-interface label. Text before the first section, and
text under a user-interface heading, counts towards the next section. All within one row: array functions over the
page's lines, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import EOL, WS, join_lines, let, lines, text, trim
from ..functions.text import count_words, estimate_tokens, is_ui_heading, plain_text

MIN_WORDS = 5
_HEAD = rf"^(#{{1,3}})[{WS}]+([^{EOL}]+)\z"


def chunk_sections(body: Column | str, min_words: int = MIN_WORDS) -> Column:
    """array<struct<heading, level, word_count, token_estimate>> of the sections of at least min_words words."""
    numbered = F.transform(lines(body), lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.rlike(x, F.lit(_HEAD)).alias("head")))

    def headings(rows: Column) -> Column:
        found = F.transform(
            F.filter(rows, lambda s: s["head"]),
            lambda s: F.struct(s["at"].alias("at"), F.length(F.regexp_extract(s["line"], _HEAD, 1)).alias("level"), trim(F.regexp_extract(s["line"], _HEAD, 2)).alias("heading")),
        )
        return F.transform(found, lambda h, k: F.struct(k.alias("k"), h["at"].alias("at"), h["level"].alias("level"), h["heading"].alias("heading"), is_ui_heading(h["heading"]).alias("ui")))

    def made(rows: Column, heads: Column) -> Column:
        real = lambda h: ~h["ui"]
        return F.filter(F.transform(F.filter(heads, real), lambda h, j: section(rows, heads, h, j)), lambda s: s["word_count"] >= min_words)

    def section(rows: Column, heads: Column, h: Column, j: Column) -> Column:
        end = F.coalesce(F.get(heads, h["k"] + 1)["at"], F.size(rows))
        # The section before this one ends at the heading after its own; what lies between leaks into this one.
        before = F.get(F.filter(heads, lambda x: ~x["ui"]), j - 1)["k"]
        start = F.coalesce(F.when(j > 0, F.get(heads, before + 1)["at"]), F.lit(0))
        own = F.filter(F.slice(rows, start + 1, end - start), lambda s: ~s["head"])
        plain = plain_text(join_lines(F.transform(own, lambda s: s["line"])))
        return let(plain, lambda p: F.struct(h["heading"].alias("heading"), h["level"].cast("int").alias("level"), count_words(p).cast("int").alias("word_count"), estimate_tokens(p).cast("int").alias("token_estimate")))

    return let(numbered, lambda rows: let(headings(rows), lambda heads: made(rows, heads)))


def section_rows(pages: DataFrame, key: str, body: str) -> DataFrame:
    """key, section_no, heading, level, word_count, token_estimate: one row a section. Null bodies give none."""
    sections = pages.select(F.col(key), F.posexplode(chunk_sections(text(body))).alias("section_no", "s"))
    return sections.select(key, "section_no", "s.heading", "s.level", "s.word_count", "s.token_estimate")
