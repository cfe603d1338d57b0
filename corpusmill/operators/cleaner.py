"""The markdown cleaner: native steps of functions.text, and in between Arrow functions, of the pages that need them, for the steps that look across lines.

A repeated group over thousands of lines exhausts the stack of Spark's regex engine, so resource cards, naming lists,
product sections, tables and runs of broken links are read line by line in Python instead, one page a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What a call to action says about the document behind it (keys lack "the ").
CTA_TYPES = {
    "read white paper": "White Paper", "read success story": "Success Story", "read product brief": "Product Brief", "read solution brief": "Solution Brief",
    "download datasheet": "Datasheet", "download brochure": "Brochure", "check out product review": "Product Review",
}
# Document types named in a card's text.
NAMED_TYPES = ("White Paper", "Success Story", "Product Brief", "Solution Brief", "Datasheet", "Brochure", "Product Review")

_CARD_LINK = re.compile(r"^\[(?:Read|Download|Check out)[^\]]+\]\(([^)]+)\)", re.M)
_CTA_LABEL = re.compile(r"\[((?:read|download|check out)[^\]]+)\]", re.I)
_HEAD3 = re.compile(r"### (.+)")
_TABLE_LINE = re.compile(r"\s*\|.+\|\s*")
_RULE_CELL = re.compile(r":?-{3,}:?")


def doc_type(label: str, block: str) -> str:
    """Type of a linked document by its call to action, by the words around it, or by its extension."""
    low, around = label.lower(), block.lower()
    for key, kind in CTA_TYPES.items():
        if key in low:
            return kind
    for kind in NAMED_TYPES:
        if kind.lower() in around:
            return kind
    return "PDF" if re.search(r"\.pdf(?:\Z|[?#])", block, re.I) else "Document"


def _between(lines: list[str], start, stops) -> tuple[int, int] | None:
    """Line numbers (first, end) of the text after the first line that starts it, up to a line that stops it."""
    for k in range(1, len(lines)):
        if start(lines[k]):
            end = next((j for j in range(k + 1, len(lines)) if stops(lines[j])), len(lines))
            return k + 1, end
    return None


def cards(text: str, over_heads: bool = False) -> Iterator[tuple[int, re.Match, str]]:
    """(start, link, title) of resource cards: a level-three heading and, at the start of a later line, a reading link. A card that has none before the next
    heading of its level is no card, or takes the next one in if over_heads.
    """
    links, at = list(_CARD_LINK.finditer(text)), 0
    heads = list(re.finditer(r"^### (.+)\n", text, re.M))
    for head, after in zip(heads, [*heads[1:], None], strict=False):
        while at < len(links) and links[at].start() < head.end():
            at += 1
        if at == len(links):
            return
        inside = over_heads or after is None or links[at].start() < after.start()
        if inside:
            yield head.start(), links[at], head[1].strip()
            at += 1


def resource_entries(markdown: str) -> list[dict[str, str]]:
    """Title, url and type of the documents a page's resource cards lead to, each URL once in any case.

    The cards are looked for under the Resources label, else under Related documents, else everywhere.
    """
    lines = markdown.split("\n")
    stop = lambda x: x.lower().startswith(("## available models", "#### naming", "* ["))
    found = _between(lines, lambda x: x.strip().lower() == "resources" and not x[:1].isspace(), stop)
    if found is None or found[0] >= found[1]:
        found = _between(lines, lambda x: x.rstrip().lower() == "## related documents", lambda x: False)
    scope = "\n".join(lines[found[0] : found[1]] if found and found[0] < found[1] else lines)
    out, seen = [], set()
    for start, link, title in cards(scope):
        url = link[1].strip()
        if url.lower() not in seen:
            seen.add(url.lower())
            block = scope[start : link.end()]
            label = _CTA_LABEL.search(block)
            out.append({"title": title, "url": url, "type": doc_type(label[1] if label else "", block)})
    return out


def remove_resource_cards(text: str) -> str:
    """Without the cards of the first Resources block; what else it holds stays under a Resources heading."""
    lines = text.split("\n")
    label = re.compile(r"(?:## )?resources\s*", re.I)
    stops = lambda x: bool(re.match(r"## available models|#### naming|## [^#]|# ", x, re.I))
    found = _between(lines, lambda x: label.fullmatch(x) is not None, stops)
    if found is None:
        return text
    first, end = found
    inner, kept, at = "\n".join(lines[first:end]) + ("\n" if end < len(lines) else ""), [], 0
    for start, link, _ in cards(inner, over_heads=True):
        if start >= at:
            kept.append(inner[at:start])
            at = link.end()
            while at < len(inner) and inner[at].isspace():
                at += 1
    left = ("".join(kept) + inner[at:]).strip()
    return "\n".join([*lines[: first - 1], *(["## Resources", "", left, ""] if left else []), *lines[end:]])


def remove_naming_lists(text: str) -> str:
    """Without lists of links to naming conventions, their label, and a heading of models that they leave empty."""
    lines, out, k = text.split("\n"), [], 0
    link = re.compile(r"[*-]\s+\[[^\]]+\]\([^)\n]*product_naming_convention[^)\n]*\)\s*", re.I)
    blank = lambda j: j < len(lines) and not lines[j].strip()
    while k < len(lines):
        j = k
        if lines[j].rstrip().lower() == "## available models":
            j += 1
            while blank(j):
                j += 1
        if k and j < len(lines) and lines[j].rstrip().lower() == "naming conventions":
            j += 1
            while blank(j):
                j += 1
            end = j
            while end < len(lines) and link.fullmatch(lines[end]):
                end += 1
            if end > j:
                out.append("")
                k = end
                while blank(k):
                    k += 1
                continue
        if k and lines[k].rstrip() == "## Available Models":
            j = k + 1
            while blank(j):
                j += 1
            if j > k + 1 and (j == len(lines) or lines[j].startswith(("## ", "# "))):
                out.append("")
                k = j
                continue
        out.append(lines[k])
        k += 1
    return "\n".join(out)


def format_product_sections(text: str) -> str:
    """Level-three sections as title, text, and bullet lines, in this order; image lines and links without text go.

    A last line without a line end stays behind its section as it is.
    """
    lines, out, k = text.split("\n"), [], 0
    last = len(lines) - 1  # the text after the final line end
    while k < len(lines):
        head = _HEAD3.fullmatch(lines[k]) if k < last else None
        if not head:
            out.append(lines[k])
            k += 1
            continue
        j = k + 1
        while j < last and not re.match(r"#{1,3} ", lines[j]):
            j += 1
        body = "\n".join(x for x in lines[k + 1 : j] if not x.strip().lower().startswith("*[image:")).strip().split("\n")
        specs = [x for x in body if x.strip().startswith("* ")]
        intro = [x for x in body if x.strip() and not x.strip().startswith(("* ", "[", "](", "\\]("))]
        parts = [f"### {head[1].strip()}", *(["\n".join(intro)] if intro else []), *(["\n".join(specs)] if specs else [])]
        out += ["\n\n".join(parts), ""]
        k = j
    return "\n".join(out)


def _cells(line: str) -> list[str]:
    inner = line.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner[:-1] if inner.endswith("|") else inner
    return [c.strip() for c in inner.split("|")]


def is_rule(line: str) -> bool:
    """A separator row of at least two columns."""
    cells = _cells(line)
    return len(cells) > 1 and all(_RULE_CELL.fullmatch(c) for c in cells)


def normalize_tables(text: str) -> str:
    """Tables without repeated headers, repeated separators, repeated rows (in any case) and torn rows."""
    out: list[str] = []
    block: list[str] = []

    def flush() -> None:
        if len(block) < 3 or not is_rule(block[1]):
            out.extend(block)
        else:
            head, rule = block[:2]
            width, kept, seen, skip = len(_cells(head)), [head, rule], set(), False
            for k, row in enumerate(block[2:], 2):
                if skip:
                    skip = False
                elif row == head and k + 1 < len(block) and is_rule(block[k + 1]):
                    skip = True
                elif is_rule(row):
                    if kept[-1] != rule:
                        kept.append(row)
                else:
                    cells = _cells(row)
                    torn = width >= 3 and len(cells) < width and sum(map(bool, cells)) < width - 1
                    key = "|".join(cells).lower()
                    if not torn and key not in seen:
                        seen.add(key)
                        kept.append(row)
            out.extend(kept)
        block.clear()

    for line in text.split("\n"):
        if _TABLE_LINE.fullmatch(line):
            block.append(line)
        else:
            flush()
            out.append(line)
    flush()
    return "\n".join(out)


def remove_broken_links(text: str) -> str:
    """Without links whose label is only line ends and image marks."""
    out, at = [], 0
    label = re.compile(r"\\?\[")
    inside = re.compile(r"(?:\s|\*\[image:[^\]]*\]\*)*", re.I)
    target = re.compile(r"\]?\([^)\n]*\)\s*")
    for m in label.finditer(text):
        if m.start() < at:
            continue
        filled = inside.match(text, m.end())
        end = target.match(text, filled.end())
        body = filled.group()
        if end and ("\n" in body or "[" in body):
            out.append(text[at : m.start()])
            at = end.end()
    out.append(text[at:])
    return "".join(out)


_ENTRY = pa.struct([("title", pa.string()), ("url", pa.string()), ("type", pa.string())])
ENTRIES = "array<struct<title:string,url:string,type:string>>"


def _udf(f: Callable[[str], object], kind: pa.DataType, ddl: str) -> Callable[[Column], Column]:
    """A column function of a Python function of a text, by Arrow batches; only the text leaves the JVM, and null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in texts.to_pylist()], kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Not to be folded into the step after it, where it would be computed for each use.
    return F.arrow_udf(run, ddl).asNondeterministic()


def _where(needs: Column, x: Column, f: Callable[[Column], Column]) -> Column:
    """f of the texts that need it, others as they are."""
    return F.coalesce(f(F.when(needs, x)), x)


def _late(text: str) -> str:
    return normalize_tables(format_product_sections(remove_naming_lists(text)))


def clean(pages: DataFrame, markdown: str = "markdown", into: str = "body") -> DataFrame:
    """pages with `into`, the cleaned markdown, and `resources`, the documents it leads to. Null stays null; other columns stay.

    The order of the steps shows in the result: resources come from the text as it is, headings of level four to six lose
    user-interface labels before they turn into lines, and noise goes twice.
    """
    text_of = lambda f: _udf(f, pa.string(), "string")
    entries = _udf(resource_entries, pa.list_(_ENTRY), ENTRIES)
    raw, x = F.col(markdown), F.col("_x")
    linked = F.contains(raw, F.lit("### ")) & F.rlike(raw, F.lit(r"\[(?:Read|Download|Check out)"))
    first = pages.withColumn("_x", T.strip_residual_html(T.normalize_encoding(markdown)))
    one = first.withColumn("resources", F.when(raw.isNotNull(), F.coalesce(entries(F.when(linked, raw)), F.array().cast(ENTRIES)))).withColumn("_x", _where(F.rlike(x, F.lit(r"\[\s|\[\*\[")), x, text_of(remove_broken_links)))
    plain = one.withColumn("_x", T.flatten_subheadings(T.remove_control_bursts(T.remove_ui_headings(T.remove_noise_lines(T.strip_artifacts("_x"))))))
    two = plain.withColumn("_x", _where(F.rlike(x, F.lit(r"(?im)^(?:## )?resources\s*$")), x, text_of(remove_resource_cards)))
    listed = F.array_join(F.transform("resources", lambda r: F.concat(F.lit("- **"), r["title"], F.lit("** ("), r["type"], F.lit("): "), r["url"])), "\n")
    body = T.dedupe_sections(T.remove_trailing_ui_sections("_x"))
    related = two.withColumn("_x", body).withColumn("_x", F.when(F.size("resources") > 0, F.concat(F.btrim("_x", F.lit(" \n")), F.lit("\n\n## Related documents\n\n"), listed)).otherwise(x))
    shaped = F.contains(x, F.lit("### ")) | F.contains(x, F.lit("|")) | F.rlike(x, F.lit(r"(?im)^(?:naming conventions|## available models)\s*$"))
    three = related.withColumn("_x", _where(shaped, x, text_of(_late)))
    y = F.regexp_replace(T.dedupe_paragraphs("_x"), r"(?m)^\\?\]\([^)\n]+\)[ \t]*$", "")
    return three.withColumn(into, T.normalize_whitespace(T.remove_ui_headings(T.remove_noise_lines(y)))).drop("_x")
