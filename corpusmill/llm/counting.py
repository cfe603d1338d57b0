"""One pass over the corpus that counts, for blocks.repeated_lines and spam, lines by host and neighbouring words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

#: Entries a task holds before it hands on its partial counts, and pages looked at together.
HELD, TOGETHER = 400_000, 1_000

_DIGITS = re.compile(r"[0-9]+")
_SPACES = re.compile(r"  +")
_ODD_BLANK = re.compile(f"[{BLANKS[1:]}]")
_CJK = "぀-ヿ㐀-鿿"
WORD = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+")
#: Stands for a line end among words.
LINE_END = "\x01"
LINE_END_APART = f" {LINE_END} "
_WORD_LINES = re.compile(WORD.pattern + "|" + LINE_END)
#: ASCII text with anything but lower-case letters and the line end as blanks.
ASCII_LETTERS = {p: " " for p in range(128) if not (97 <= p < 123) and chr(p) != LINE_END}
URL = re.compile(r"(?:https?://|www\.)\S+")
_TARGET = re.compile(r"\]\([^)\n]*\)")
#: The steps of words() for many pages at once: link targets, addresses, and all that is no letter go; each CJK letter stands by itself.
_ARROW_STEPS = (
    (r"\]\([^)\n]*\)", "] "),
    (r"(?:https?://|www\.)\S+", " "),
    (rf"[^\p{{L}}\p{{Nl}}\p{{No}}{_CJK}\n{LINE_END} ]+", " "),
    (rf"([{_CJK}])", r" \1 "),
)


def words(line: str) -> list[str]:
    """Lower-case words of a line without link targets and addresses."""
    if "](" in line:
        line = _TARGET.sub("] ", line)
    if "://" in line or "www." in line:
        line = URL.sub(" ", line)
    return line.lower().translate(ASCII_LETTERS).split() if line.isascii() else WORD.findall(line.lower())


def line_form(line: str) -> bytes:
    """The form of a trimmed line in which lines are equal: lower case, single blanks, digit runs as 0."""
    form = line.lower()
    if not (form.isascii() and form.isprintable()):
        form = _ODD_BLANK.sub(" ", form)
    if "  " in form:
        form = _SPACES.sub(" ", form)
    return _DIGITS.sub("0", form).encode("utf-8", "surrogatepass")


def page_forms(low: str) -> str:
    """All lines of a lower-case page in their forms at once; each still has to be trimmed."""
    if not low.isascii() or "\t" in low or "\r" in low or "\x0b" in low or "\x0c" in low:
        low = _ODD_BLANK.sub(" ", low)
    if "  " in low:
        low = _SPACES.sub(" ", low)
    return _DIGITS.sub("0", low)


def page_words(low: str) -> list[str]:
    """words() of all lines of a lower-case page, with a line end between the words of different lines; lines may change places."""
    if "](" in low:
        low = _TARGET.sub("] ", low)
    if "://" in low or "www." in low:
        low = URL.sub(" ", low)
    if low.isascii():
        return low.replace("\n", LINE_END_APART).translate(ASCII_LETTERS).split()
    # Lines are taken by themselves, so plain ones go the quick way whatever stands between them.
    lines = low.split("\n")
    plain = LINE_END_APART.join([x for x in lines if x.isascii()]).translate(ASCII_LETTERS).split()
    return [*plain, LINE_END, *_WORD_LINES.findall(LINE_END.join([x for x in lines if not x.isascii()]))]


def signed(key: int) -> int:
    return key - 2**64 if key >= 2**63 else key


def host_seed(host: str) -> int:
    """Seed with which xxhash64 of a form is Spark's xxhash64(host, form)."""
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 42)


def python_key(line: str, seed: int = 42) -> int:
    """xxhash64(host, form) as Spark computes it where seed is host_seed(host), else xxhash64(form)."""
    return signed(xxhash.xxh64_intdigest(line_form(line), seed))


_SCHEMA = pa.schema([("host", pa.string()), ("key", pa.int64()), ("form", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def _lines(counts: dict[tuple[str, int | None, int | None], int]) -> pa.RecordBatch:
    host, key, form = zip(*counts, strict=True) if counts else ((), (), ())
    m = len(counts)
    whole = lambda x: None if x is None else signed(x)
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(map(whole, key), pa.int64(), size=m), pa.array(map(whole, form), pa.int64(), size=m), pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.array(counts.values(), pa.int64(), size=m)], schema=_SCHEMA)


def _distinct(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and how often they occur, or their summed weights."""
    if weights is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[starts], np.add.reduceat(weights, starts) if len(starts) else weights


class _Words:
    """Counts of words and of neighbouring words of one task. Words are numbered, so both are counted as whole numbers with numpy."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {LINE_END: 0}
        self.single = np.zeros(1, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.folded = 0

    def add(self, pages: list[str]) -> None:
        """Counts lower-case pages: words() of every line, without a loop over words in Python."""
        text = pa.array([LINE_END_APART.join(pages)])
        for pattern, by in _ARROW_STEPS:
            text = pc.replace_substring_regex(text, pattern, by)
        text = pc.ascii_trim_whitespace(pc.replace_substring(text, "\n", LINE_END_APART))
        if not pc.binary_length(text)[0].as_py():
            return
        found = pc.ascii_split_whitespace(text).values.dictionary_encode()
        number = self.number
        names = found.dictionary.to_pylist()
        for x in names:
            if x not in number:
                number[x] = len(number)
        ids = np.fromiter(map(number.__getitem__, names), dtype=np.int64, count=len(names))[found.indices.to_numpy()]
        seen = np.bincount(ids, minlength=len(number))
        seen[: len(self.single)] += self.single
        self.single = seen
        left, right = ids[:-1], ids[1:]
        inner = (left > 0) & (right > 0)
        self.parts.append(_distinct((left[inner] << 32) | right[inner]))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * self.folded + HELD:
            self._fold()

    def _fold(self) -> None:
        """One array of distinct pairs instead of one for each call of add()."""
        if len(self.parts) > 1:
            self.parts = [_distinct(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.held = self.folded = sum(len(c) for c, _ in self.parts)

    def full(self) -> bool:
        return len(self.number) + self.folded > HELD

    def batch(self) -> pa.RecordBatch:
        self._fold()
        codes, n = self.parts[0] if self.parts else (np.zeros(0, dtype=np.int64),) * 2
        names, some = pa.array(list(self.number), pa.string()), np.flatnonzero(self.single[1:]) + 1
        m = len(some) + len(codes)
        a = names.take(pa.array(np.concatenate([some, codes >> 32])))
        b = pa.concat_arrays([pa.nulls(len(some), pa.string()), names.take(pa.array(codes & (2**32 - 1)))])
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), a, b, pa.array(np.concatenate([self.single[some], n]))], schema=_SCHEMA)


def count_corpus(pages: DataFrame, of_lines: bool = True, of_words: bool = True) -> DataFrame:
    """Counts over all pages (markdown, host), null markdown aside.

    Lines: host, key, form (hashes of host and line, and of the line), n = pages of the host with the line; headings and table
    rows are left out. Hosts: host, n = its pages, key and form null. Words: a, b, n = how often b follows a in a line, b null for the word a itself. The columns
    of the other kind are null. Each task adds up its own counts before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int | None, int | None], int] = {}
        counted = _Words()
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                lows: list[str] = []
                for text, host in zip(batch.column(0)[start : start + TOGETHER].to_pylist(), batch.column(1)[start : start + TOGETHER].to_pylist(), strict=True):
                    low = text.lower()
                    if of_words:
                        lows.append(low)
                    if of_lines:
                        seed = host_seed(host)
                        held[host, None, None] = held.get((host, None, None), 0) + 1
                        for form in {s for x in page_forms(low).split("\n") if (s := x.strip()) and s[0] not in "#|"}:
                            data = form.encode("utf-8", "surrogatepass")
                            k = (host, digest(data, seed), digest(data, 42))
                            held[k] = held.get(k, 0) + 1
                if lows:
                    counted.add(lows)
                if len(held) > HELD:
                    yield _lines(held)
                    held = {}
                if counted.full():
                    yield counted.batch()
                    counted = _Words()
        yield _lines(held)
        yield counted.batch()

    rows = pages.where(F.col("markdown").isNotNull()).select("markdown", F.coalesce("host", F.lit("")).alias("host")).mapInArrow(run, "host string, key bigint, form bigint, a string, b string, n bigint")
    return rows.groupBy("host", "key", "form", "a", "b").agg(F.sum("n").alias("n"))
