"""HTML as columns: metadata, links and markdown, by one tolerant parse in Arrow batches.

A row is a page, so the work has no shuffle; only the parse itself is Python. Malformed markup is read as far as it
goes: an unclosed paragraph or list item ends where the next one starts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import WS, blank_to_null, trim

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style noscript template head title svg iframe".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form header html main nav p section summary center".split())
# Link texts of controls that lead nowhere.
_CONTROLS = re.compile(r"(?:show models?|shop models?|previous|next|watch the video|clear all|clear filters?|reset filters?|apply|cancel|close)", re.I)
_BLANK = re.compile(r"[ \t\r\n\f\xa0]+")
# What is escaped in a text - marks anywhere, and marks at its start that would open a list, heading, quote, rule or fence.
_MARKS = re.compile(r"[\\*`\[\]_]")
_OPENING = re.compile(r"^(?:-|\+ |=+|#{1,6} |~~~|>)")
_NUMBERED = re.compile(r"^(\d+)\. ")


def escaped(text: str) -> str:
    """Text in which nothing reads as markup."""
    told = _MARKS.sub(r"\\\g<0>", text)
    return _NUMBERED.sub(r"\1\\. ", _OPENING.sub(r"\\\g<0>", told))


class _Node:
    __slots__ = ("tag", "attrs", "out", "number")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.out, self.number = tag, attrs, [], 0


class _Markdown(HTMLParser):
    """Builds markdown while reading: each open element collects its own pieces, and closing it renders them into its parent."""

    def __init__(self, escape: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Node("root", {})]
        self.skip = 0
        self.escape = escape

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attrs = {k: v or "" for k, v in attrs}
        if tag in _SKIP:
            if tag not in ("head",):
                self.skip += 1
                self.stack.append(_Node(tag, attrs))
            return
        if tag == "body":
            return
        self._end_implied(tag)
        if tag == "br":
            self.stack[-1].out.append("\n")
        elif tag == "hr":
            self.stack[-1].out.append("\n\n* * *\n\n")
        elif tag == "img":
            src, alt = attrs.get("src", "").strip(), attrs.get("alt", "image").strip()
            if src:
                self.stack[-1].out.append(f"\n\n![{alt}]({src})\n\n")
            elif alt:
                self.stack[-1].out.append(f"\n\n*[Image: {alt}]*\n\n")
        elif tag not in _VOID:
            node = _Node(tag, attrs)
            if tag == "ol" and re.fullmatch(r"\d{1,9}", attrs.get("start", "").strip()):
                node.number = int(attrs["start"]) - 1
            if tag == "li":
                parent = next((n for n in reversed(self.stack) if n.tag in ("ul", "ol")), None)
                if parent is not None:
                    parent.number += 1
                    node.number = parent.number if parent.tag == "ol" else 0
            self.stack.append(node)

    def _end_implied(self, tag: str) -> None:
        ends = {"li": ("li", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag)
        if ends is None and (tag in _BLOCK or tag in ("ul", "ol", "pre", "table", "h1", "h2", "h3", "h4", "h5", "h6")):
            ends = ("p",)
        stop = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            open_ = self.stack[k].tag
            if open_ in stop:
                return
            if ends and open_ in ends:
                while len(self.stack) > k:
                    self._close()
                return self._end_implied(tag)
            if open_ in _BLOCK or open_ in ("table", "ul", "ol"):
                return None
        return None

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("br", "hr", "img"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not any(n.tag == tag for n in self.stack[1:]):
            return
        while len(self.stack) > 1:
            closed = self.stack[-1].tag
            self._close()
            if closed == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if any(n.tag == "pre" for n in self.stack):
            self.stack[-1].out.append(data)
        else:
            flat = _BLANK.sub(" ", data)
            if self.escape and not any(n.tag == "code" for n in self.stack):
                lead = flat[: len(flat) - len(flat.lstrip(" "))]
                flat = lead + escaped(flat[len(lead) :])
            if flat != " " or (self.stack[-1].out and not self.stack[-1].out[-1].endswith(("\n", " "))):
                self.stack[-1].out.append(flat)

    def _close(self) -> None:
        node = self.stack.pop()
        if node.tag in _SKIP:
            self.skip -= 1
            return
        self.stack[-1].out.append(_render(node, "".join(node.out), self.stack))

    def finish(self) -> str:
        self.close()
        while len(self.stack) > 1:
            self._close()
        body = "".join(self.stack[0].out)
        return _tidy(_tables(body))


def _tables(body: str) -> str:
    """Runs of finished rows as pipe tables; rows need no table element around them."""

    def table(m: re.Match) -> str:
        rows = re.findall(r"\x1e([^\x1d]*)\x1d", m.group())
        rule = "|" + "---|" * (rows[0].count(" | ") + 1)
        return "\n\n" + "\n".join([f"| {rows[0]} |", rule, *(f"| {r} |" for r in rows[1:])]) + "\n\n"

    return re.sub(r"(?:\s*\x1e[^\x1d]*\x1d)+\s*", table, body)


def _tidy(body: str) -> str:
    """No blanks around line ends outside fences, no more than one blank line in a row."""
    parts = body.split("```")
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?=\S)(?![ \t]*(?:[-*]|\d+\.) )", "\n", parts[k]))
    return re.sub(r"\n{3,}", "\n\n", "```".join(parts)).strip()


def _render(node: _Node, inner: str, stack: list[_Node]) -> str:
    tag = node.tag
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        flat = " ".join(inner.split())
        return f"\n\n{'#' * int(tag[1])} {flat}\n\n" if flat else ""
    if tag == "pre":
        return f"\n\n```\n{inner.strip()}\n```\n\n"
    if tag == "code":
        return inner if any(n.tag == "pre" for n in stack) or not inner.strip() else f"`{inner.strip()}`"
    if tag in ("strong", "b"):
        return f"**{inner.strip()}**" if inner.strip() else ""
    if tag in ("em", "i"):
        return f"*{inner.strip()}*" if inner.strip() else ""
    if tag == "a":
        href, label = node.attrs.get("href", "").strip(), inner.strip()
        if href.startswith("#") or href.lower().startswith("javascript:"):
            return f"\n\n{label}\n\n" if label and not _CONTROLS.fullmatch(label) else ""
        return f"[{' '.join(label.split())}]({href})" if href and label else label
    if tag == "li":
        mark = f"{node.number}. " if node.number else "- "
        body = re.sub(r"\n{2,}", "\n", inner.strip()).replace("\n", "\n" + " " * len(mark))
        return f"\n{mark}{body}\n" if body else ""
    if tag in ("ul", "ol"):
        flat = re.sub(r"\n{2,}", "\n", inner.strip("\n"))
        return f"\n{flat}\n" if any(n.tag == "li" for n in stack) else f"\n\n{flat}\n\n"
    if tag in ("td", "th"):
        if "\n\n" in inner:  # a cell of page layout, not of data
            return f"\n\n{inner.strip()}\n\n"
        return "\x1f" + " ".join(inner.split()).replace("|", "\\|")
    if tag == "tr":
        if "\x1f" not in inner:
            return inner
        cells = inner.strip().strip("\x1f").split("\x1f")
        return f"\x1e{' | '.join(c.strip() for c in cells)}\x1d"
    if tag == "table":
        return f"\n\n{_tables(inner).strip()}\n\n" if inner.strip() else ""
    if tag == "blockquote":
        quoted = "\n".join(f"> {x}".rstrip() for x in _tidy(inner).split("\n"))
        return f"\n\n{quoted}\n\n"
    if tag in _BLOCK:
        return f"\n\n{inner.strip()}\n\n"
    return inner


def html_to_markdown(html: str, escape: bool = True) -> str:
    """Markdown of an HTML document: atx headings, fenced code, - bullets, pipe tables; head, scripts and styles leave nothing. Marks in texts are escaped."""
    reader = _Markdown(escape)
    reader.feed(html.replace("\xa0", " "))
    return reader.finish()


class _Head(HTMLParser):
    """Title, first h1, metas, first time, and all elements with an href in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.h1: list[str] | None = None
        self.meta: dict[str, str] = {}
        self.time: str | None = None
        self.links: list[tuple[str, str, list[str]]] = []
        self.open: list[str] = []
        self.anchor: list[str] | None = None
        self.into: list[str] | None = None
        self.mute = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.mute += 1
        if tag == "meta":
            for key in (a.get("name"), a.get("property")):
                if key and "content" in a:
                    self.meta.setdefault(key.lower(), a["content"])
        if tag == "time" and self.time is None and a.get("datetime"):
            self.time = a["datetime"]
        if tag == "title" and self.title is None:
            self.title = self.into = []
        if tag == "h1" and self.h1 is None:
            self.h1 = self.into = []
        if "href" in a:
            label: list[str] = []
            self.links.append((tag, a["href"], label))
            if tag == "a":
                self.anchor = label

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        if tag in ("title", "h1"):
            self.into = None
        if tag == "a":
            self.anchor = None

    def handle_data(self, data: str) -> None:
        if self.mute:
            return
        if self.into is not None:
            self.into.append(data)
        if self.anchor is not None:
            self.anchor.append(data)


_LINK = pa.struct([("tag", pa.string()), ("href", pa.string()), ("label", pa.string())])
_FIELDS = ("title", "og_title", "h1", "description", "og_description", "twitter_description", "modified_time", "updated_time", "last_modified", "dcterms_modified", "time")
_PARSED = "struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ",links:array<struct<tag:string,href:string,label:string>>,markdown:string>"
_ARROW = pa.struct([*((f, pa.string()) for f in _FIELDS), ("links", pa.list_(_LINK)), ("markdown", pa.string())])


def _read(html: str, markdown: bool, escape: bool = True) -> dict:
    head = _Head()
    head.feed(html)
    head.close()
    words = lambda parts: " ".join("".join(parts).split()) if parts is not None else None
    whole = lambda parts: "".join(parts) if parts is not None else None
    m = head.meta
    return {
        "title": whole(head.title), "og_title": m.get("og:title"), "h1": whole(head.h1), "description": m.get("description"), "og_description": m.get("og:description"),
        "twitter_description": m.get("twitter:description"), "modified_time": m.get("article:modified_time"), "updated_time": m.get("og:updated_time"), "last_modified": m.get("last-modified"),
        "dcterms_modified": m.get("dcterms.modified"), "time": head.time, "links": [{"tag": t, "href": h, "label": words(x)} for t, h, x in head.links], "markdown": html_to_markdown(html, escape) if markdown else None,
    }


def parse(pages: DataFrame, columns: list[str], html: str = "html", markdown: bool = True, escape: bool = True) -> DataFrame:
    """The columns and `page`, a struct of the parsed HTML; null HTML gives a null struct. markdown=False leaves the conversion out, escape=False the escapes of marks in texts. Only the HTML leaves the JVM."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if h is None else _read(h, markdown, escape) for h in texts.slice(k, 500).to_pylist()], _ARROW) for k in range(0, len(texts), 500)]
        return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Not to be folded into what reads its fields, where it would be computed for each.
    read = F.arrow_udf(run, _PARSED).asNondeterministic()
    return pages.select(*columns, read(F.col(html)).alias("page"))


def page_title(extracted: Column, page: Column, url: Column) -> Column:
    """First of the rendered title, <title>, og:title, the first h1 and the URL that says something."""
    return F.coalesce(blank_to_null(extracted), *(blank_to_null(trim(x)) for x in (page["title"], page["og_title"], page["h1"])), url)


def meta_description(page: Column) -> Column:
    """Description from the head if it has over 20 characters, collapsed, at most 320 of them; else null."""
    told = F.coalesce(*(blank_to_null(trim(page[f])) for f in ("description", "og_description", "twitter_description")))
    return F.when(F.length(told) > 20, F.substring(F.regexp_replace(told, f"[{WS}]+", " "), 1, 320))


#: Formats in which a date is understood, most specific first.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss z", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")


def parse_date(value: Column) -> Column:
    """yyyy-MM-dd of a date in one of DATE_FORMATS, a weekday before it aside, in UTC; null for anything else."""
    v = F.regexp_replace(trim(value), "^[A-Za-z]{3,9}, ", "")
    return F.date_format(F.coalesce(*(F.try_to_timestamp(v, F.lit(f)) for f in DATE_FORMATS)), "yyyy-MM-dd")


def last_updated(page: Column) -> Column:
    """First date of the head, or of the first time element, that can be read."""
    return F.coalesce(*(parse_date(page[f]) for f in ("modified_time", "updated_time", "last_modified", "dcterms_modified", "time")))


def anchors(page: Column) -> Column:
    """href of every a element but in-page and mail links, in order."""
    kept = F.filter(page["links"], lambda x: (x["tag"] == "a") & ~F.rlike(x["href"], F.lit(r"^(?:#|(?i:mailto:))")))
    return F.transform(kept, lambda x: x["href"])


