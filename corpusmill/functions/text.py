"""Scalar functions on page text: titles, tokens, words, hashes, plain text and the native steps of the cleaner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import EOL, WS, blank_to_null, collapse, join_lines, let, lines, text, trim

NOT_EOL = f"[^{EOL}]"

# Labels of user-interface headings.
UI_LABELS = r"open chat|resources|filters?|naming conventions|panel\s+\d+|grp-type-\d+|slick-slide\d+"
# Lines that are controls of a page rather than content.
NOISE_LABELS = (
    r"previous|next|resources|video|×clear all|clear all|clear filters?|reset filters?|show models?|show model|shop models?|watch the video|watch now|100%"
    r"|finalizing…|finalizing\.\.\.|compare\s+\d+\s*/\s*\d+|open chat|learn more|get pricing|contact us|apply|cancel|close"
    r"|you can['’]?t perform that action at this time|card view|list view|card view\s*list view|cancel\s*apply|loading products(?:…|\.\.\.)?|filters?|filter by"
    r"|view as|keyword|showing \d+(?:\s*-\s*\d+)?\s+results|sort by|panel\s+\d+|grp-type-\d+|slick-slide\d+|starting at\s*\$\s*[\d,.]+"
    r"|white paper|success story|product brief|solution brief|datasheet|brochure|product review"
)
# Names of the tags that are dropped from markdown, matched as prefixes.
HTML_TAGS = "div|span|p|br|a|strong|em|ul|ol|li|table|tr|td|th|section|article|header|footer|nav"
# Single-line controls in bursts.
BURSTS = r"card view\s*list view|cancel\s*apply|loading products(?:…|\.\.\.)?|panel\s+\d+|grp-type-\d+|slick-slide\d+|starting at\s*\$\s*[\d,.]+|filters?|filter by|sort by|view as"
# Link labels that only call for an action.
CTA = "Show Models?|Show Model|Shop Models?|Watch the|Learn more|Get pricing|Contact us|Apply|Cancel|Close"
NO_CONTENT = "Scraped page content."


def clean_title(title: Column | str) -> Column:
    """Title without a site suffix: cut at the first pipe, then at a spaced dash; the collapsed title itself where nothing is left."""
    whole = collapse(title)
    cut = F.regexp_replace(whole, rf"[{WS}]*\|[{WS}]*{NOT_EOL}+\z", "")
    cut = F.regexp_replace(cut, rf"[{WS}]+[–—][{WS}]*{NOT_EOL}+\z", "")
    cut = F.regexp_replace(cut, rf"[{WS}]+-[{WS}]+{NOT_EOL}+\z", "")
    return F.coalesce(blank_to_null(trim(cut)), whole)


def estimate_tokens(x: Column | str) -> Column:
    """A quarter of the characters of the trimmed text, rounded up."""
    return F.ceil(F.length(trim(x)) / 4).cast("bigint")


def count_words(x: Column | str) -> Column:
    """Runs of non-blanks."""
    return let(trim(x), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{WS}]+")))).cast("bigint")


def content_hash(x: Column | str) -> Column:
    return F.sha2(text(x), 256)


def plain_text(markdown: Column | str) -> Column:
    """Markdown as plain words: the first span between --- lines, headings, link targets and marks go, blanks collapse."""
    x = F.regexp_replace(text(markdown), r"(?sm)\A(.*?)^---.*?---", "$1")
    x = F.regexp_replace(x, rf"(?m)^#+ {NOT_EOL}+", "")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1")
    x = F.regexp_replace(x, r"\*\*([^*]+)\*\*", "$1")
    return collapse(F.translate(x, "*_`>#-", "      "))


def normalize_encoding(x: Column | str) -> Column:
    """No-break spaces, zero-width characters, curly quotes, long dashes and CRLF in their plain form."""
    plain = F.translate(text(x), "\u00a0‘’“”–—\u200b\u200c\u200d\ufeff", " ''\"\"--")
    return F.replace(plain, F.lit("\r\n"), F.lit("\n"))


def normalize_whitespace(x: Column | str) -> Column:
    return trim(F.regexp_replace(F.replace(text(x), F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n"))


def strip_residual_html(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(text(x), rf"(?i)</?(?:{HTML_TAGS})[^>]*>", ""), r"(?s)<!--.*?-->", "")


def strip_artifacts(x: Column | str) -> Column:
    """Images, scripted and in-page links, calls to action and escapes. The run of broken link blocks before it is cleaner.broken_links."""
    x = F.regexp_replace(text(x), rf"(?m)^\\?\]\([^)\n]+\)[{WS}]*$", "")
    x = F.regexp_replace(x, rf"(?im)!\[[^\]]*\]\([^)]*\)|\\?\*\[Image:[^\]]*\]\*|^\*\[Image:[^\]]*\]\*[{WS}]*$", "")
    x = F.regexp_replace(x, rf"(?m)^\*\\?\[Image:[^\]]*\]\*[{WS}]*$", "")
    x = F.regexp_replace(x, r"(?i)\[([^\]]+)\]\(javascript:[^)]+\)", "$1")
    x = F.regexp_replace(x, r"(?i)\[([^\]]+)\]\(#(?:models|[\w-]+)?\)", "$1")
    x = F.regexp_replace(x, rf"(?im)^\[(?:{CTA})[^\]]*\]\([^)]+\)[{WS}]*$", "")
    return F.regexp_replace(F.replace(x, F.lit("\\_"), F.lit("_")), r"\\([\[\]()])", "$1")


def is_ui_heading(heading: Column) -> Column:
    return F.rlike(trim(heading), F.lit(rf"(?i)^(?:{UI_LABELS})\z"))


def page_title_line(markdown: Column | str) -> Column:
    """Trimmed text of the first level-one heading; '' where there is none."""
    return trim(F.regexp_extract(text(markdown), rf"(?m)^# ({NOT_EOL}+)", 1))


def is_noise_line(line: Column, title: Column) -> Column:
    """Whether a line is page furniture. Blank lines are not; title is the page's own first heading or ''."""
    facet = r"[^(\n]+\(\d+\)"

    def told(s: Column) -> Column:
        noise = (
            (F.length(s) <= 2)
            | F.rlike(s, F.lit(r"(?i)^\*\\?\[image:|javascript:|^\\?\]\("))
            | F.rlike(s, F.lit(rf"(?i)^(?:{NOISE_LABELS})\z"))
            # Two counts in brackets first: the pattern of a whole facet is slow on long lines without any.
            | ((F.regexp_count(s, F.lit(r"\(\d+\)")) >= 2) & (F.regexp_count(s, F.lit(facet)) >= 2) & (trim(F.regexp_replace(s, facet, "")) == ""))
            | F.rlike(s, F.lit(rf"^\*[{WS}]+\d+\z"))
            | F.rlike(s, F.lit(rf"^\\?(?:\[|\]|\)|\([{WS}]*\z|[\\*]{{1,3}}[{WS}]*\z)"))
            | ((title != "") & (F.lower(s) == F.lower(title)))
        )
        return (s != "") & noise

    return let(trim(line), told)


def remove_noise_lines(markdown: Column | str) -> Column:
    return let(page_title_line(markdown), lambda title: join_lines(F.filter(lines(markdown), lambda x: ~is_noise_line(x, title))))


def remove_ui_headings(markdown: Column | str) -> Column:
    """Without headings of any level whose text is a label of the user interface."""
    label = lambda x: F.regexp_extract(x, rf"^#{{1,6}}[{WS}]+({NOT_EOL}+)\z", 1)
    return join_lines(F.filter(lines(markdown), lambda x: (label(x) == "") | ~is_ui_heading(label(x))))


def remove_control_bursts(markdown: Column | str) -> Column:
    return join_lines(F.filter(lines(markdown), lambda x: ~F.rlike(trim(x), F.lit(rf"(?i)^(?:{BURSTS})\z"))))


def flatten_subheadings(markdown: Column | str) -> Column:
    """Headings of level four to six as plain lines."""
    return F.regexp_replace(text(markdown), rf"(?m)^#{{4,6}}[{WS}]+({NOT_EOL}+)", "$1")


def remove_trailing_ui_sections(markdown: Column | str) -> Column:
    """Headings of chat, filter and naming sections; their text stays."""
    x = text(markdown)
    for label in ("Open chat", "Filters?", "Naming Conventions"):
        x = F.regexp_replace(x, rf"(?im)\n## {label}\b[^\n]*", "")
    heading = rf"(?i)^#{{1,3}}[{WS}]+(?:open chat|filters?|naming conventions)\b"
    return join_lines(F.filter(lines(x), lambda s: ~F.rlike(s, F.lit(heading))))


def _first_of_each(parts: Column, key: Callable[[Column], Column], counts: Callable[[Column], Column]) -> Column:
    """Parts without those whose key an earlier part had, if the key counts; blank lines between."""
    pick = lambda ps, keys: F.filter(ps, lambda p, i: ~counts(F.get(keys, i)) | (F.array_position(keys, F.get(keys, i)) == i + 1))
    return F.array_join(let(parts, lambda ps: let(F.transform(ps, key), lambda keys: pick(ps, keys))), "\n\n")


def dedupe_sections(markdown: Column | str) -> Column:
    """First of the ## sections of one title in any case; parts trimmed, empty ones dropped, blank lines between."""
    marked = F.regexp_replace(text(markdown), "(?m)^## ", "\x01## ")
    parts = F.filter(F.transform(F.split(marked, "\x01"), trim), lambda p: p != "")
    return _first_of_each(parts, lambda p: F.lower(trim(F.regexp_extract(p, rf"\A## ({NOT_EOL}+)", 1))), lambda k: k != "")


def dedupe_paragraphs(markdown: Column | str) -> Column:
    """First of equal paragraphs of at least 40 characters, blanks and case aside."""
    return _first_of_each(F.split(text(markdown), "\n{2,}"), lambda p: F.lower(collapse(p)), lambda k: F.length(k) >= 40)


def heading_texts(body: Column | str, most: int = 12) -> Column:
    """Texts of the first headings of level one to three that are no user-interface labels."""
    heads = F.filter(lines(body), lambda x: F.rlike(x, F.lit(rf"^#{{1,3}}[{WS}]+")))
    texts = F.transform(heads, lambda x: trim(F.regexp_replace(x, rf"^#+[{WS}]+", "")))
    return F.slice(F.filter(texts, lambda x: ~is_ui_heading(x)), 1, most)


def embed_text(title: Column, description: Column, body: Column | str) -> Column:
    parts = F.filter(F.concat(F.array(title, description), heading_texts(body)), lambda x: x.isNotNull() & (x != ""))
    return F.substring(F.array_join(parts, " | "), 1, 1500)


def body_description(body: Column | str) -> Column:
    """Description from the text: the first longer line that is no heading or bullet, else the first heading, else a constant."""
    trimmed = F.transform(lines(body), trim)
    long = F.filter(trimmed, lambda x: (F.length(x) > 40) & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("*")))
    heading = trim(F.regexp_extract(text(body), rf"(?m)^#{{1,3}}[{WS}]+({NOT_EOL}+)", 1))
    return F.coalesce(F.substring(F.regexp_replace(F.get(long, F.lit(0)), f"[{WS}]+", " "), 1, 320), blank_to_null(heading), F.lit(NO_CONTENT))


def document_body(title: Column, url: Column, crawled_at: Column, body: Column | str) -> Column:
    """The text of a page file: title, source line and the body without its first heading."""
    content = F.regexp_replace(trim(body), rf"\A#[{WS}]+{NOT_EOL}+\n+", "")
    source = F.concat(F.lit("*Source: [Original URL]("), url, F.lit(") | Crawled: "), F.substring(crawled_at, 1, 10), F.lit("*"))
    return trim(F.concat(F.lit("# "), clean_title(title), F.lit("\n\n"), source, F.lit("\n\n"), content))


def preview_body(document: Column | str) -> Column:
    """What follows the frontmatter of a page file, trimmed."""
    return trim(F.regexp_replace(text(document), r"(?s)\A---\n.*?\n---\n", ""))

