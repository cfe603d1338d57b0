"""Problem 4: one consistent form for text that looks the same in other characters.

Per text: ignorable characters go, width forms, ligatures, special blanks and hyphens are replaced by their
compatibility forms (superscripts, fractions and other visibly different forms stay), the rest is composed. Then each
token becomes a lattice of the letters that look alike in the scripts; Viterbi takes the path with the fewest changes of
script and, among these, the best character bigram score. Scores are counted over the whole corpus in one pass whose
result is bounded by the alphabets. A lattice depends on how a token looks, never on how it is written, so texts
of one look always get one form.

Texts are reduced to 128-bit hashes of form and spelling once. Pairs come from an equi-join of the different spellings of a form, and only those are joined to their
pages, hot spellings in parts: copies are never compared, and a form with a single spelling makes no work however many pages have it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import receive, send, texts

# Letters of other scripts drawn like a Latin letter.
LOOKALIKES = {
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "o": "оο", "p": "р", "q": "ԛ", "s": "ѕ",
    "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
#: Compatibility classes that look like their plain form.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
HYPHENS = "‐‑"
#: Letters of the scripts in the lattice: Latin, Greek, Cyrillic.
RANGES = ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x250), (0x370, 0x400), (0x400, 0x530), (0x1E00, 0x2000))
#: Pages of one spelling that are paired in one task.
SALTED = 4_096
_MARKS = "̀-ͯ"
_SWITCH = 1000.0


def _script(ch: str) -> int:
    """0 Latin, 1 Greek, 2 Cyrillic."""
    point = ord(ch)
    return 2 if 0x400 <= point < 0x530 else 1 if 0x370 <= point < 0x400 or 0x1F00 <= point < 0x2000 else 0


def _replacements() -> dict[str, str]:
    out = {}
    for point in range(0x80, 0x30000):
        ch = chr(point)
        kind, form = unicodedata.category(ch), unicodedata.decomposition(ch)
        tag = form.split(" ")[0]
        if kind == "Cf" or 0xFE00 <= point < 0xFE10 or point in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0x180B <= point < 0x1810:
            out[ch] = ""
        elif kind == "Zs":
            out[ch] = " "
        elif ch in HYPHENS:
            out[ch] = "-"
        elif tag in SAME_LOOK or (tag == "<compat>" and (kind == "Nl" or "LIGATURE" in unicodedata.name(ch, "") or 0x2F00 <= point < 0x2FD6 or 0x132 <= point < 0x134 or 0x1C4 <= point < 0x1F4)):
            out[ch] = unicodedata.normalize("NFKC", ch)
    for point in range(0xE0000, 0xE01F0):
        out[chr(point)] = ""
    return out


def _set(chars: Iterator[str] | str) -> str:
    """Body of a regex class, runs joined."""
    points, runs = sorted({ord(c) for c in chars}), []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Normalizer:
    """Brings texts to one form. `bigrams` maps two lower-case letters ('' edges as ' ') to their count in the corpus."""

    def __init__(self, bigrams: dict[tuple[str, str], int]):
        self.replace = _replacements()
        self.special = re.compile(f"[{_set(self.replace)}]")
        alike = {latin: latin + others for latin, others in LOOKALIKES.items()}
        self.choices = {ch: group for group in alike.values() for ch in group}
        letters = [chr(p) for a, b in RANGES for p in range(a, b) if chr(p).isalpha()]
        foreign = _set([c for c in letters if _script(c)])
        latin = [c for c in letters if not _script(c)]
        open_ = _set([c for c in latin if unicodedata.normalize("NFD", c)[0] in LOOKALIKES])
        word = _set(letters) + _MARKS
        self.plain = re.compile(f"(?<![A-Za-z])[{_set(LOOKALIKES)}]+(?![A-Za-z])")
        self.token = re.compile(f"(?<![{word}])(?:[{open_}{_MARKS}]+(?![{word}])|[{word}]*[{foreign}][{word}]*)")
        total, starts = {}, {}
        for (a, b), n in bigrams.items():
            total[a] = total.get(a, 0) + n
            if a == " ":
                s = _script(b)
                starts[s] = starts.get(s, 0) + n
        seen = sum(starts.values())
        self.prior = [math.log((starts.get(s, 0) + 1) / (seen + 3)) for s in range(3)]
        self.logs = {k: math.log((n + 0.1) / (total[k[0]] + 100)) for k, n in bigrams.items()}
        self.rest = {a: math.log(0.1 / (n + 100)) for a, n in total.items()}
        self.memo: dict[str, str] = {}

    def _score(self, a: str, b: str) -> float:
        a, b = a.lower(), b.lower()
        return self.logs.get((a, b), self.rest.get(a, -9.0))

    def best(self, token: str) -> str:
        """Viterbi over the look-alikes of a token's letters: fewest script changes, then the best bigrams, then Latin first."""
        chars = [c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)]
        paths: dict[str, tuple[float, str]] = {}
        for i, ch in enumerate(chars):
            step = {}
            for c in self.choices.get(ch, ch):
                if i == 0:
                    step[c] = (-self.prior[_script(c)] - self._score(" ", c), c)
                else:
                    step[c] = min(((cost + _SWITCH * (_script(p) != _script(c)) - self._score(p, c), path + c) for p, (cost, path) in paths.items()), key=lambda x: x[0])
            paths = step
        letters = min(((cost - self._score(c, " "), path) for c, (cost, path) in paths.items()), key=lambda x: x[0])[1] if paths else ""
        found = iter(letters)
        return unicodedata.normalize("NFC", "".join(c if unicodedata.combining(c) else next(found) for c in unicodedata.normalize("NFD", token)))

    def _token(self, m: re.Match) -> str:
        token = m.group()
        form = self.memo.get(token)
        if form is None:
            form = self.best(token)
            if len(self.memo) < 500_000:  # memory of a task; a token beyond it is searched again
                self.memo[token] = form
        return form

    def __call__(self, text: str) -> str:
        if text.isascii():
            return self.plain.sub(self._token, text)
        text = unicodedata.normalize("NFC", self.special.sub(lambda m: self.replace[m.group()], text))
        return self.token.sub(self._token, text)


_ALPHABET = [p for a, b in RANGES for p in range(a, b) if chr(p).isalpha() and chr(p).lower() == chr(p)]


def count_bigrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """a, b, n: letter bigrams inside words of one script over all texts; ' ' is a word's edge. One row a task and bigram before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.zeros(0x110000, dtype=np.int32)
        size = len(_ALPHABET) + 1
        for i, p in enumerate(_ALPHABET):
            index[p] = i + 1
        for a, b in RANGES:
            for p in range(a, b):
                low = chr(p).lower()
                if len(low) == 1 and index[ord(low)]:
                    index[p] = index[ord(low)]
        script = np.array([-1, *(_script(chr(p)) for p in _ALPHABET)])
        counts = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for chunk in range(0, batch.num_rows, 1000):
                joined = " " + " ".join(x for x in batch.column(0)[chunk : chunk + 1000].to_pylist() if x) + " "
                codes = index[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                a, b = codes[:-1], codes[1:]
                same = ((a > 0) | (b > 0)) & ((a == 0) | (b == 0) | (script[a] == script[b]))
                counts += np.bincount(a[same] * size + b[same], minlength=size * size)
        some = np.flatnonzero(counts)
        char = lambda k: " " if k == 0 else chr(_ALPHABET[k - 1])
        yield pa.RecordBatch.from_pydict({"a": [char(k // size) for k in some], "b": [char(k % size) for k in some], "n": counts[some].tolist()}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

    return texts.select(text).mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, text: str = "text") -> Normalizer:
    """Normalizer with scores over all texts; the alphabets bound its size."""
    return Normalizer({(r.a, r.b): r.n for r in count_bigrams(texts, text).collect()})


def normalize_columns(rows: DataFrame, model: Normalizer, key: str, columns: list[str]) -> DataFrame:
    """The key and the columns in their one form; nulls stay null, empty texts empty, repeated rows repeated, other columns are left out."""
    sent = send(rows.sparkSession, model)
    schema = pa.schema([(key, pa.int64()), *((c, pa.string()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = receive(sent)
        for batch in batches:
            done = [pa.array([None if x is None else one(x) for x in batch.column(i + 1).to_pylist()], pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *done], schema=schema)

    return rows.select(F.col(key).cast("bigint").alias(key), *columns).mapInArrow(run, f"{key} bigint, " + ", ".join(f"{c} string" for c in columns))


def fingerprints(rows: DataFrame, model: Normalizer, key: str, columns: list[str]) -> DataFrame:
    """key, field, form, spelling: 128-bit hashes of each non-null text in its one form and as written."""
    sent = send(rows.sparkSession, model)
    schema = pa.schema([("key", pa.int64()), ("field", pa.string()), ("form", pa.binary()), ("spelling", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = receive(sent)
        digest = lambda x: xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, field in enumerate(columns):
                have = [(k, x) for k, x in zip(keys, batch.column(i + 1).to_pylist(), strict=True) if x is not None]
                yield pa.RecordBatch.from_pydict({"key": [k for k, _ in have], "field": [field] * len(have), "form": [digest(one(x)) for _, x in have], "spelling": [digest(x) for _, x in have]}, schema=schema)

    return rows.select(F.col(key).cast("bigint").alias(key), *columns).mapInArrow(run, "key bigint, field string, form binary, spelling binary")


def spellings(prints: DataFrame) -> DataFrame:
    """field, form, spelling, n_pages, first_page of the forms with several spellings. A row that repeats counts once."""
    each = prints.groupBy("field", "form", "spelling").agg(F.count_distinct("key").alias("n_pages"), F.min("key").alias("first_page"))
    mixed = each.groupBy("field", "form").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return each.join(mixed, ["field", "form"], "left_semi")


def same_look_pairs(prints: DataFrame, salted: int = SALTED) -> DataFrame:
    """key_a < key_b, field: rows whose texts have one form and different spellings. A key that repeats gives a pair once. prints is read several times.

    Pairs of spellings come first, so copies are never compared with each other; each pair then meets the pages of both sides, a spelling with many
    pages in parts of about `salted` pages.
    """
    known = stored(spellings(prints))
    pages = prints.join(known.select("field", "form", "spelling", "n_pages"), ["field", "form", "spelling"]).distinct()
    parts = F.ceil(F.col("n_pages") / salted)
    side = lambda x: pages.select("field", "form", F.col("spelling").alias(f"spelling_{x}"), F.col("key").alias(f"key_{x}"), F.pmod(F.xxhash64("key"), parts).alias(f"part_{x}"))
    one = lambda x: known.select("field", "form", F.col("spelling").alias(f"spelling_{x}"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias(f"part_{x}"))
    both = one("a").join(one("b"), ["field", "form"]).where(F.col("spelling_a") < F.col("spelling_b"))
    met = both.join(side("a"), ["field", "form", "spelling_a", "part_a"]).join(side("b"), ["field", "form", "spelling_b", "part_b"])
    pairs = met.where(F.col("key_a") != F.col("key_b")).select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "field")
    return pairs.distinct()


def look_classes(prints: DataFrame) -> DataFrame:
    """key, field, look, spelling, n_links of the rows that have a partner: the first keys with this look and with this spelling of it, and how many rows look the same in other characters.

    One row a key and field: partners are the rows of one look and another spelling.
    """
    known = spellings(prints)
    looks = known.groupBy("field", "form").agg(F.min("first_page").alias("look"), F.sum("n_pages").alias("_all"))
    classes = known.join(looks, ["field", "form"]).select("field", "form", "spelling", "look", F.col("first_page").alias("_first"), (F.col("_all") - F.col("n_pages")).alias("n_links"))
    return prints.distinct().join(classes, ["field", "form", "spelling"]).select("key", "field", "look", F.col("_first").alias("spelling"), "n_links")


def _texts(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(F.array("markdown", "title")).alias("text")).where("text IS NOT NULL")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "discovered_pages")
    return stored(fingerprints(pages, fit(_texts(pages)), "page_id", ["markdown", "title"]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages whose markdown or title looks the same and is not the same string."""
    return same_look_pairs(_prints(spark, sf_dir)).select(F.col("key_a").alias("page_a"), F.col("key_b").alias("page_b"), "field")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look and spelling of every page with such a partner, and the number of its partners."""
    return look_classes(_prints(spark, sf_dir)).withColumnRenamed("key", "page_id")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and markdown of every page in their one form."""
    pages = texts(spark, sf_dir, "discovered_pages")
    return normalize_columns(pages, fit(_texts(pages)), "page_id", ["title", "markdown"])


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms}
ORACLE: dict[str, str] = {}
