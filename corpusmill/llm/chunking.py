"""Problem 6: sections above the size limit are cut into overlapping pieces at natural boundaries.

A section's text is first cut into atomic segments: lines, lines into sentences, sentences into words, and
words above the limit into runs of characters, each level used only where the level above leaves a segment
too large. Every boundary between neighbours has a strength (blank line > line > sentence > word > inside a
word; fenced code and table rows hold together). Neighbouring pairs lie in a heap; the weakest boundary is
merged first as long as the merged piece and the overlap before it fit. Overlaps start at words. Sections are independent, so the work
is one pass without a shuffle; one section is bounded by one page.

Sections are measured in characters, as their limit says; whole pages in the tokens of a public tokenizer: pages above the page limit are cut with the same
method, sizes being counts of the tokens that begin in a segment.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .tokens import VOCABULARY, encoding

#: size_limits row 'section_chunk': characters divided by 4, rounded up.
CHARS_PER_TOKEN = 4
TRIM = " \t\r\n"

_HEADING = re.compile(r"#{1,3}[ \t]")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+|(?<=[。！？])")
_WORD = re.compile(r"(?<=[ \t])")
_SENTENCE_KEEP = re.compile(r".*?(?:[.!?][\"')\]]*[ \t]+|[。！？]|$)", re.S)

#: Strength of the boundary before a segment.
INSIDE_WORD, BETWEEN_WORDS, BETWEEN_SENTENCES, BETWEEN_ROWS, BETWEEN_LINES, BLANK_LINE = range(6)


def sections(markdown: str) -> Iterator[tuple[int, str | None, int, str]]:
    """(section_no, heading, level, text) of a page; section 0 is the text before the first heading."""
    number, heading, level, fenced, body = 0, None, 0, False, []
    for line in markdown.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and _HEADING.match(line):
            yield number, heading, level, "\n".join(body).strip(TRIM)
            number, body = number + 1, []
            level = len(line) - len(line.lstrip("#"))
            heading = line[level:].strip()
            continue
        body.append(line)
    yield number, heading, level, "\n".join(body).strip(TRIM)


def tokens(n_chars: int) -> int:
    return -(-n_chars // CHARS_PER_TOKEN)


def _atoms(text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before) of segments of at most `most` characters that cover the text."""
    out: list[tuple[int, int, int]] = []

    def words(start: int, end: int, strength: int) -> None:
        at = start
        while at < end:
            stop = at
            while stop < end:
                blank = text.find(" ", stop, end)
                nxt = end if blank < 0 else blank + 1
                if nxt - at > most:
                    break
                stop = nxt
            inside = stop == at
            if inside:
                stop = min(end, at + most)
            out.append((at, stop, strength))
            strength = INSIDE_WORD if inside else BETWEEN_WORDS
            at = stop

    def sentences(start: int, end: int, strength: int) -> None:
        for m in _SENTENCE_KEEP.finditer(text, start, end):
            if m.end() > m.start():
                if m.end() - m.start() > most:
                    words(m.start(), m.end(), strength)
                else:
                    out.append((m.start(), m.end(), strength))
                strength = BETWEEN_SENTENCES

    at, fenced, blank, before = 0, False, True, ""
    for line in text.split("\n"):
        end = min(len(text), at + len(line) + 1)
        fence = line.startswith("```")
        together = fenced or (line.startswith("|") and before.startswith("|"))
        strength = BETWEEN_ROWS if together else BLANK_LINE if blank else BETWEEN_LINES
        if fence:
            fenced = not fenced
        if end > at:
            if end - at > most:
                (words if fenced or line.startswith("|") else sentences)(at, end, strength)
            else:
                out.append((at, end, strength))
        blank, before, at = not line.strip(), line, end
    return out


def split_text(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int]]:
    """(start, own, end): piece = text[start:end], of which text[start:own] repeats the end of the piece before.

    Pieces cover the text in order, each at most max_tokens; the overlap is overlap_tokens, or all of a shorter piece before. It begins at a word: an earlier one
    where the piece has room for it, else the next one.
    """
    size, lap = max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    if len(text) <= size:
        return [(0, 0, len(text))]
    pieces, last = [], 0
    for own, end in merge(_atoms(text, size - lap), size, lap):
        start = own if not pieces else max(last, own - lap)
        if last < start < own and not text[start - 1].isspace():
            before = max(text.rfind(" ", last, start), text.rfind("\n", last, start)) + 1
            behind = min((k for k in (text.find(" ", start, own), text.find("\n", start, own)) if k >= 0), default=-1) + 1
            start = before if before > last and end - before <= size else behind or start
        pieces.append((start, own, end))
        last = own
    return pieces


def merge(atoms: list[tuple[int, int, int]], size: int, lap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces that atoms (start, end, strength of the boundary before) merge into: the first of at most size, others of at most size - lap."""
    most, n = size - lap, len(atoms)
    start, end = [a[0] for a in atoms], [a[1] for a in atoms]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    # The weakest boundary first; among equals the pair that is smallest, then the first.
    heap = [(atoms[i][2], end[i] - start[i - 1], i - 1, i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, length, i, j = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] - start[i] == length):
            continue
        if length > (size if i == 0 else most):
            continue
        end[i], alive[j], after[i] = end[j], False, after[j]
        k = after[j]
        if k < n:
            before[k] = i
            heapq.heappush(heap, (atoms[k][2], end[k] - start[i], i, k))
        h = before[i]
        if h >= 0:
            heapq.heappush(heap, (atoms[i][2], end[i] - start[h], h, i))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def split_page(text: str, max_tokens: int, overlap_tokens: int, encoder) -> list[tuple[int, int, int]]:
    """split_text() in tokens of a tokenizer; overlaps start at segments.

    The size of a piece is the sum of its segments' tokens, which its own tokens do not exceed. A segment has at most a quarter as many characters as a piece has room for
    tokens, so that it fits whatever it is made of.
    """
    size = lambda x: len(encoder.encode_ordinary(x))
    if size(text) <= max_tokens:
        return [(0, 0, len(text))]
    atoms = _atoms(text, max(1, (max_tokens - overlap_tokens) // 4))
    ends = list(accumulate(size(text[a:b]) for a, b, _ in atoms))
    begins = [0, *ends[:-1]]
    places = [*(a for a, _, _ in atoms), len(text)]
    pieces = []
    for own, end in merge([(b, e, x[2]) for b, e, x in zip(begins, ends, atoms, strict=True)], max_tokens, overlap_tokens):
        k = bisect_left(begins, own)
        first = max(bisect_left(begins, own - overlap_tokens), pieces[-1][3]) if pieces else k
        pieces.append((places[first], places[k], places[bisect_left(ends, end) + 1], k))
    return [p[:3] for p in pieces]


SCHEMA = (
    "page_id bigint, section_no bigint, heading string, level int, token_estimate bigint, "
    "pieces array<struct<piece_no:int,overlap_chars:int,token_estimate:int,text:string>>"
)
_PIECE = pa.struct([("piece_no", pa.int32()), ("overlap_chars", pa.int32()), ("token_estimate", pa.int32()), ("text", pa.string())])
_ARROW = pa.schema([("page_id", pa.int64()), ("section_no", pa.int64()), ("heading", pa.string()), ("level", pa.int32()), ("token_estimate", pa.int64()), ("pieces", pa.list_(_PIECE))])


def split_sections(pages: DataFrame, max_tokens: int, overlap_tokens: int, page_id: str = "page_id", markdown: str = "markdown") -> DataFrame:
    """One row a section above the limit, with its pieces; other columns of the input are left out.

    Null markdown gives no row; an empty page has one empty section, within any limit. Repeated pages give repeated rows.
    """
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be at least 0 and below the limit")
    most = max_tokens * CHARS_PER_TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for number, heading, level, body in sections(text.as_py()):
                    if len(body) > most:
                        cut = split_text(body, max_tokens, overlap_tokens)
                        pieces = [{"piece_no": k, "overlap_chars": own - a, "token_estimate": tokens(b - a), "text": body[a:b]} for k, (a, own, b) in enumerate(cut)]
                        rows.append({"page_id": key, "section_no": number, "heading": heading, "level": level, "token_estimate": tokens(len(body)), "pieces": pieces})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    # A section is never longer than its page, so shorter pages need not leave the JVM.
    long = pages.where(F.length(F.col(markdown)) > most).select(F.col(page_id).alias("page_id"), F.col(markdown).alias("markdown"))
    return long.mapInArrow(run, SCHEMA)


def split_pages(pages: DataFrame, max_tokens: int, overlap_tokens: int, page_id: str = "page_id", markdown: str = "markdown", vocabulary: str = VOCABULARY) -> DataFrame:
    """page_id, piece_no, overlap_chars, n_tokens, text: the pieces of every page above the limit in tokens. Null, empty and shorter pages give no row, repeated pages repeat theirs."""
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be at least 0 and below the limit")
    schema = pa.schema([("page_id", pa.int64()), ("piece_no", pa.int64()), ("overlap_chars", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = split_page(text, max_tokens, overlap_tokens, encoder)
                if len(cut) > 1:
                    rows += [{"page_id": key, "piece_no": k, "overlap_chars": own - a, "n_tokens": len(encoder.encode_ordinary(text[a:b])), "text": text[a:b]} for k, (a, own, b) in enumerate(cut)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # A token is at least one byte.
    long = pages.where(F.octet_length(F.col(markdown)) > max_tokens).select(F.col(page_id).cast("bigint").alias("page_id"), F.col(markdown).alias("markdown"))
    return long.mapInArrow(run, "page_id bigint, piece_no bigint, overlap_chars bigint, n_tokens bigint, text string")


def limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """max_tokens and overlap_tokens of one row of the four-row table size_limits."""
    row = table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).agg(F.min("max_tokens").alias("m"), F.max("overlap_tokens").alias("o")).first()
    if row is None or row.m is None:
        raise ValueError(f"size_limits has no limit {name!r}")
    return row.m, row.o or 0


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(texts(spark, sf_dir, "discovered_pages"), *limit(spark, sf_dir, "section_chunk"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections above the limit."""
    return _split(spark, sf_dir).select("page_id", "section_no")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every section above the limit."""
    return _split(spark, sf_dir).select("page_id", "section_no", "heading", "level", F.inline("pieces"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every section above the limit: the hash of its pieces put together again without their overlaps, and how many of them are above the limit."""
    most = limit(spark, sf_dir, "section_chunk")[0]
    whole = F.array_join(F.transform("pieces", lambda p: F.substr(p["text"], p["overlap_chars"] + 1)), "")
    return _split(spark, sf_dir).select("page_id", "section_no", F.sha2(whole, 256).alias("hash"), F.size(F.filter("pieces", lambda p: p["token_estimate"] > most)).cast("bigint").alias("n_above"))


def p6_page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every page above the page limit, in tokens."""
    return split_pages(texts(spark, sf_dir, "discovered_pages"), *limit(spark, sf_dir, "page_chunk"))


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_checks": p6_checks, "p6_page_pieces": p6_page_pieces}

_BODIES = r"""
WITH cut AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM discovered_pages WHERE markdown IS NOT NULL),
 fenced AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS fences FROM cut),
 marked AS (SELECT *, CASE WHEN fences % 2 = 0 AND NOT starts_with(line, '```') AND regexp_matches(line, '^#{1,3}[ \t]') THEN 1 ELSE 0 END AS head FROM fenced),
 numbered AS (SELECT *, sum(head) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section_no FROM marked),
 bodies AS (SELECT page_id, section_no, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE head = 0), ''), chr(32) || chr(9) || chr(13) || chr(10)) AS body FROM numbered GROUP BY page_id, section_no),
 found AS (SELECT page_id, section_no::BIGINT AS section_no, body FROM bodies WHERE ceil(length(body) / 4.0) > (SELECT max_tokens FROM size_limits WHERE limit_name = 'section_chunk'))"""
ORACLE = {
    "p6_found": f"{_BODIES} SELECT page_id, section_no FROM found",
    "p6_checks": f"{_BODIES} SELECT page_id, section_no, sha256(body) AS hash, 0::BIGINT AS n_above FROM found",
}
