"""Completeness of a page's markdown: word volume, links, short and repeated lines, structure; warnings, score and grade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import EOL, WS, let, lines, round_half_up, text, trim
from .text import count_words


def count_headings(markdown: Column | str) -> Column:
    return F.regexp_count(text(markdown), F.lit(rf"(?m)^#{{1,6}}[{WS}]+")).cast("bigint")


def word_penalty(words: Column) -> Column:
    """60 without words, falling from 40 to 0 with the square root of the words up to 500."""
    curve = round_half_up(F.lit(40.0) * (1 - F.sqrt(words / F.lit(500.0))))
    return F.when(words == 0, 60).when(words >= 500, 0).otherwise(curve).cast("bigint")


def link_words(markdown: Column | str) -> Column:
    """Words inside link labels."""
    labels = F.regexp_extract_all(text(markdown), F.lit(r"\[([^\]]+)\]\([^)]*\)"), F.lit(1))
    return F.aggregate(F.transform(labels, count_words), F.lit(0).cast("bigint"), lambda a, x: a + x)


def link_density(markdown: Column | str, words: Column) -> Column:
    return F.when(words == 0, F.lit(0.0)).otherwise(link_words(markdown) / words)


def short_line_ratio(markdown: Column | str) -> Column:
    """Share of lines under five words among lines that are no headings, fences or table rows; 0 below five such lines."""
    marks = lambda x: F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("```")) | F.startswith(x, F.lit("|"))
    kept = F.filter(F.transform(lines(markdown), trim), lambda x: (x != "") & ~marks(x))
    short = lambda ls: F.filter(ls, lambda x: F.size(F.split(x, f"[{WS}]+", 5)) < 5)
    return let(kept, lambda ls: F.when(F.size(ls) < 5, F.lit(0.0)).otherwise(F.size(short(ls)) / F.size(ls)))


def duplicate_line_ratio(markdown: Column | str) -> Column:
    """Share of repetitions among lines over ten characters; 0 below five such lines."""
    kept = F.filter(F.transform(lines(markdown), trim), lambda x: F.length(x) > 10)
    return let(kept, lambda ls: F.when(F.size(ls) < 5, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(ls)) / F.size(ls)))


def structural_richness(markdown: Column | str) -> Column:
    """0 to 4: headings, three headings, a list, a table row."""
    x, heads = text(markdown), count_headings(markdown)
    listed = F.rlike(x, F.lit(rf"(?m)^[-*+][{WS}]+|^\d+\.[{WS}]+"))
    row = F.rlike(x, F.lit(rf"\|[^{EOL}]+\|"))
    return ((heads > 0).cast("bigint") + (heads >= 3).cast("bigint") + listed.cast("bigint") + row.cast("bigint")).cast("bigint")


def is_error_title(title: Column) -> Column:
    return F.coalesce(F.contains(F.lower(title), F.lit("[error")), F.lit(False))


def _percent(ratio: Column) -> Column:
    return round_half_up(ratio * 100).cast("string")


def warnings(title: Column, fetch_method: Column, words: Column, density: Column, short: Column, duplicate: Column) -> Column:
    """Warnings in their fixed order; the texts are fixed values."""
    n = words.cast("string")
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.array_compact(
        F.array(
            F.when(fetch_method == "static", F.lit("Static HTTP fetch — JavaScript-rendered content may be missing.")),
            F.when(words == 0, F.lit("No content extracted — page may have failed to render."))
            .when(words < 50, say("Very short content (", n, " words) — page may be incomplete or blocked."))
            .when(words < 200, say("Short content (", n, " words) — verify against the live page.")),
            F.when(is_error_title(title), F.lit("Page title suggests a rendering error — content may be incomplete.")),
            F.when(density > 0.6, say("Very high link density (", _percent(density), "% link text) — page is likely a navigation index, not content.")).when(
                density > 0.4, say("High link density (", _percent(density), "% link text) — page may be navigation-heavy.")
            ),
            F.when(short > 0.7, say("Very high short-line ratio (", _percent(short), "%) — content may be a link dump or menu rather than prose.")).when(
                short > 0.5, say("High short-line ratio (", _percent(short), "%) — content may be list-heavy with little prose.")
            ),
            F.when(duplicate > 0.3, say("Duplicate line ratio ", _percent(duplicate), "% — repeated boilerplate blocks detected.")),
        )
    )


def score(title: Column, words: Column, density: Column, short: Column, duplicate: Column, richness: Column, n_warnings: Column) -> Column:
    """0 to 100."""
    links = F.when(density > 0.6, 30).when(density > 0.4, 15).otherwise(0)
    lines_ = F.when(short > 0.7, 15).when(short > 0.5, 8).otherwise(0)
    shape = F.when(words <= 200, 0).when(richness == 0, -15).when(richness == 1, -5).when(richness >= 3, 5).otherwise(0)
    points = (
        F.lit(100) - word_penalty(words) - links - lines_ - F.when(duplicate > 0.3, 10).otherwise(0) + shape
        - F.when(is_error_title(title), 20).otherwise(0) - F.greatest(n_warnings - 1, F.lit(0)) * 5
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("bigint")


def grade(points: Column) -> Column:
    return F.when(points >= 90, "excellent").when(points >= 75, "good").when(points >= 50, "fair").otherwise("poor")


def badge(of_grade: Column) -> Column:
    """Display variant of a grade."""
    return F.when(of_grade == "excellent", "default").when(of_grade == "good", "secondary").when(of_grade == "fair", "outline").when(of_grade == "poor", "destructive")
