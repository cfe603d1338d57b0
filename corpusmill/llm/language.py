"""Problem 9: language of documents and of each block in them, by rank-order n-gram profiles.

Profiles come from the trusted samples (a table of fixed size): each language keeps its most frequent character
n-grams (n = 1 to 3, words padded) in order of rank. A block's own most frequent n-grams are ranked the same way
and compared by out-of-place distance: the sum of rank differences, PROFILE for an n-gram the language lacks.
N-grams that no profile has would add the same to every language and are left out.

Documents are scored in one pass without a shuffle. Inside a task the blocks of an Arrow batch are counted and
ranked together with numpy, so no Python runs per n-gram.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import receive, send, table, texts

#: N-grams kept a language, and the penalty of a missing one.
PROFILE = 1000
#: Sample rows and characters a row that profiles may be fitted on (lang_samples has 132 short rows).
SAMPLE_ROWS, SAMPLE_CHARS = 20_000, 2_000
MIN_LETTERS = 40
#: Blocks counted together: bounds the memory of a task.
CHUNK = 256
#: Blocks longer than this are ranked by counts that saturate; counts stay exact below 2**20.
_COUNT_BITS, _GRAM_BITS = 20, 20

# ISO 639 code forms of the languages of the samples (two letters; terminology and bibliographic codes).
CODES = {
    "en": "en", "eng": "en", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr",
    "es": "es", "spa": "es", "it": "it", "ita": "it", "pt": "pt", "por": "pt", "nl": "nl", "nld": "nl", "dut": "nl",
    "pl": "pl", "pol": "pl", "sv": "sv", "swe": "sv", "ru": "ru", "rus": "ru", "ja": "ja", "jpn": "ja",
}
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown", "n/a", "na", "none", "null", "mul", "mis", "zxx", "xx", "?", "-")

_WORD = re.compile(r"[^\W\d_]+")
_MARKS = "#|-`"


def grams(text: str) -> Counter:
    """Counts of the padded character n-grams of a text's words."""
    out: Counter = Counter()
    for word in _WORD.findall(text.lower()):
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


class Profiles:
    """Rank-order profiles as arrays: `ranks[g, l]` is the rank of n-gram g in language l, PROFILE where it has none."""

    def __init__(self, samples: list[tuple[str, str]], size: int = PROFILE):
        counts: dict[str, Counter] = {}
        for lang, text in samples:
            if lang and text:
                counts.setdefault(lang, Counter()).update(grams(unicodedata.normalize("NFC", text)))
        self.langs = sorted(counts)
        self.size = size
        # A tie in counts goes to the shorter n-gram, then to the smaller one.
        ranked = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size]] for lang, c in counts.items()}
        total: Counter = Counter()
        for c in counts.values():
            n = sum(c.values())
            total.update({g: k / n for g, k in c.items()})
        known = {g for r in ranked.values() for g in r}
        order = sorted(known, key=lambda g: (-total[g], g))  # ties inside a block go to the commoner n-gram
        letters = sorted({ch for g in order for ch in g if ch != " "})
        self.base = len(letters) + 2  # 0: no letter, 1: a letter that no profile has
        self.code = np.zeros(0x110000, dtype=np.uint16)
        for start, stop in _letter_ranges():
            self.code[start:stop] = 1
        for i, ch in enumerate(letters):
            self.code[ord(ch)] = i + 2
        at = {ch: i + 2 for i, ch in enumerate(letters)} | {" ": 0}
        b = self.base
        self.one = np.full(b, -1, dtype=np.int32)
        self.two = np.full(b * b, -1, dtype=np.int32)
        keys, values = [], []
        self.ranks = np.full((len(order), len(self.langs)), size, dtype=np.int32)
        for k, g in enumerate(order):
            c = [at[ch] for ch in g]
            if len(c) == 1:
                self.one[c[0]] = k
            elif len(c) == 2:
                self.two[c[0] * b + c[1]] = k
            else:
                keys.append((c[0] * b + c[1]) * b + c[2])
                values.append(k)
        self.three = np.full(b**3, -1, dtype=np.int16 if len(order) < 2**15 else np.int32)
        self.three[keys] = values
        place = {g: i for i, g in enumerate(order)}
        for lang in self.langs:
            for rank, g in enumerate(ranked[lang]):
                self.ranks[place[g], self.langs.index(lang)] = rank
        self.n = len(order)

    def distances(self, texts: list[str]) -> np.ndarray:
        """Out-of-place distance of each text to each language, as a share of the largest possible; 1 where a text has no known n-gram."""
        if not self.langs:
            return np.ones((len(texts), 0))
        return np.concatenate([self._chunk(texts[i : i + CHUNK]) for i in range(0, len(texts), CHUNK)]) if texts else np.ones((0, len(self.langs)))

    def _chunk(self, texts: list[str]) -> np.ndarray:
        b, m = self.base, len(texts)
        joined = "\0\0" + "\0\0".join(texts) + "\0\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.code[points].astype(np.int32)
        sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=m)
        sizes[0] += 2
        block = np.repeat(np.arange(m, dtype=np.int64), sizes)
        a, c, d = codes[:-2], codes[1:-1], codes[2:]
        at = np.flatnonzero(c)
        blk = block[at + 1] * self.n
        x, y, z = a[at], c[at], d[at]
        pair, first = y * b + z, x == 0
        found = [(self.one[y], blk), (self.two[pair], blk), (self.two[(x * b + y)[first]], blk[first]), (self.three[(x * b + y) * b + z].astype(np.int32), blk)]
        keys = np.concatenate([k[g >= 0] + g[g >= 0] for g, k in found])
        counts = np.bincount(keys, minlength=m * self.n)
        some = np.flatnonzero(counts)
        much = np.minimum(counts[some], 2**_COUNT_BITS - 1)
        who, gram = np.divmod(some, self.n)
        order = np.sort((who << (_COUNT_BITS + _GRAM_BITS)) | ((2**_COUNT_BITS - 1 - much) << _GRAM_BITS) | gram)
        who, gram = order >> (_COUNT_BITS + _GRAM_BITS), order & (2**_GRAM_BITS - 1)
        starts = np.searchsorted(who, np.arange(m))
        rank = np.arange(len(order)) - starts[who]
        keep = rank < self.size
        who, gram, rank = who[keep], gram[keep], rank[keep]
        place = np.abs(self.ranks[gram] - rank[:, None].astype(np.int32))
        np.minimum(place, self.size, out=place)
        out = np.ones((m, len(self.langs)))
        have = np.unique(who)
        if len(have):
            sums = np.add.reduceat(place, np.searchsorted(who, have), axis=0)
            out[have] = sums / (self.size * np.bincount(who, minlength=m)[have])[:, None]
        return out


def _letter_ranges() -> Iterator[tuple[int, int]]:
    """Runs of code points that are letters."""
    start = None
    for point in range(0x30000):
        letter = unicodedata.category(chr(point))[0] == "L"
        if letter and start is None:
            start = point
        elif not letter and start is not None:
            yield start, point
            start = None
    if start is not None:
        yield start, 0x30000


def label_language(label: str | None) -> str | None:
    """Two-letter language of a label in any code form, region or case; None where it names no language of the samples."""
    if label is None or label.strip().lower() in NO_LANGUAGE:
        return None
    return CODES.get(re.split(r"[-_ ]", label.strip().lower())[0])


def letters(text: str) -> int:
    return sum(map(len, _WORD.findall(text)))


def fit(samples: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of (lang, text) samples; rows with a null are passed over. At most SAMPLE_ROWS rows of SAMPLE_CHARS characters are used, chosen by their hash."""
    rows = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    return Profiles(sorted((r.lang, r.text) for r in rows.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(SAMPLE_ROWS).collect()), size)


_SCHEMA = "doc_id bigint, label string, blocks array<struct<block_no:bigint,lang:string,confidence:double,letters:bigint,prose:boolean>>"
_BLOCK = pa.struct([("block_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int64()), ("prose", pa.bool_())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("blocks", pa.list_(_BLOCK))])


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, label (the stored label's language or null) and the blocks of each document with language and confidence.

    A block is a piece between blank lines; blocks without letters have a null language and confidence 0. Confidence is the
    lead of the best language over the next, as a share of the next one's distance. Null text gives no row, empty text one
    empty block; repeated documents give repeated rows; further columns are left out.
    """
    sent = send(docs.sparkSession, profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = receive(sent)
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts, size, prose, spans = [], [], [], []
            for t in batch.column(1):
                first = len(texts)
                for block in t.as_py().split("\n\n"):
                    n = letters(block)
                    texts.append(block.lower())
                    size.append(n)
                    prose.append(n >= MIN_LETTERS and block[:1] not in _MARKS)
                spans.append((first, len(texts)))
            far = model.distances(texts)
            if far.shape[1] > 1:
                order = np.argsort(far, axis=1, kind="stable")
                at = np.arange(len(texts))
                best, nearest, second = order[:, 0], far[at, order[:, 0]], far[at, order[:, 1]]
                sure = np.where(second > 0, 1 - nearest / np.maximum(second, 1e-12), 0.0)
            else:
                best, nearest, sure = np.zeros(len(texts), int), far[:, 0] if far.shape[1] else np.ones(len(texts)), np.zeros(len(texts))
            langs = [model.langs[k] if n and d < 1 else None for k, n, d in zip(best, size, nearest, strict=True)]
            rows = [
                {
                    "doc_id": i,
                    "label": label_language(label),
                    "blocks": [{"block_no": k - a, "lang": langs[k], "confidence": float(sure[k]) if langs[k] else 0.0, "letters": size[k], "prose": prose[k]} for k in range(a, b)],
                }
                for i, label, (a, b) in zip(ids, labels, spans, strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.mapInArrow(run, _SCHEMA)


def document_languages(blocks: DataFrame) -> DataFrame:
    """doc_id, label, lang, confidence, n_langs: the language with the most letters in a document's prose (all blocks where it has none)."""
    prose = F.filter("blocks", lambda x: x["prose"] & x["lang"].isNotNull())
    used = F.when(F.size(prose) > 0, prose).otherwise(F.filter("blocks", lambda x: x["lang"].isNotNull()))
    langs = F.array_sort(F.array_distinct(F.transform("used", lambda x: x["lang"])))
    weigh = lambda lang: F.aggregate(F.filter("used", lambda x: x["lang"] == lang), F.lit(0).cast("bigint"), lambda a, x: a + x["letters"])
    trust = lambda lang: F.aggregate(F.filter("used", lambda x: x["lang"] == lang), F.lit(0.0), lambda a, x: a + x["letters"] * x["confidence"])
    votes = F.transform(langs, lambda lang: F.struct((-weigh(lang)).alias("minus"), lang.alias("lang"), trust(lang).alias("trust")))
    return (
        blocks.withColumn("used", used)
        .withColumn("vote", F.array_min(votes))
        .withColumn("all", F.aggregate("used", F.lit(0).cast("bigint"), lambda a, x: a + x["letters"]))
        .select(
            "doc_id",
            "label",
            F.col("vote.lang").alias("lang"),
            F.coalesce(F.col("vote.trust") / F.nullif("all", F.lit(0)), F.lit(0.0)).alias("confidence"),
            F.size(langs).cast("bigint").alias("n_langs"),
        )
    )


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(texts(spark, sf_dir, "documents"), fit(table(spark, sf_dir, "lang_samples")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose blocks whose language is not the one the label stands for."""
    rows = _identified(spark, sf_dir).select("doc_id", "label", F.inline("blocks"))
    return rows.where(F.col("prose") & F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("label"))).select("doc_id", "block_no", "lang")


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language and confidence."""
    return document_languages(_identified(spark, sf_dir))


def p9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with its language and confidence."""
    return _identified(spark, sf_dir).select("doc_id", F.inline("blocks")).select("doc_id", "block_no", "lang", "confidence")


QUERIES = {"p9_found": p9_found, "p9_documents": p9_documents, "p9_blocks": p9_blocks}
ORACLE: dict[str, str] = {}
