"""Problem 5: unfilled templates, filler text and error, block, sign-in, loading or script notices.

A naive Bayes model of passages (lines) with three classes - ordinary text, residue (template fields, filler) and
notice - is learned from positive and unlabelled records by expectation-maximization. Trusted records give the
positives: passages with a field of one of three template languages or with Latin filler, and the passages of short records that have an HTTP status
as their title or whose stored warnings call them blocked. All other passages are unlabelled: they start as ordinary text and take the model's own
opinion in each round, which is how other kinds of fields, fillers and notices are found. The model is fitted on a bounded sample, trusted records of
the whole corpus first (FIT_TRUSTED, FIT_RECORDS); every record is then scored.

A passage is residue as a whole, by one of its sentences, or by the tokens around one of its marks: prose around a field or filler does not
outweigh it. A record is a case if a passage outside code is residue, or if notices make up most of its content besides site furniture.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Page, Repeats, load_pages, with_repeats
from .common import receive, send

#: Records that may be trusted ones, and other records, that the model may be fitted on, and the longest of them in characters.
FIT_TRUSTED, FIT_RECORDS, FIT_CHARS = 4_000, 4_000, 20_000
ROUNDS = 6
#: Every SPY-th trusted passage is a spy; unlabelled ones below this quantile of the spies are settled as ordinary.
SPY, SPY_SHARE = 7, 0.15
#: Tokens of the corpus mixed into each class: a token that a class never showed speaks against it.
BACKGROUND = 300.0
#: Content below which a record counts as short.
SHORT = 700
#: Log-odds from which a passage is residue or notice; share of notice characters that makes the record one.
#: Headings, short as they are and with the words of articles, and lines of the site's furniture need more.
RESIDUE_ODDS, FIRM_ODDS, NOTICE_ODDS, NOTICE_SHARE = 2.0, 8.0, 0.0, 0.5
#: Tokens speak for a class from such log-odds on; weaker ones count as 0. So a passage without any is ordinary.
TELLING = 1.5
#: Tokens on either side of a mark that may belong to the same field.
REACH = 8
ORDINARY, RESIDUE, NOTICE = range(3)

# Fields of trusted records, in the syntax of three template languages.
FIELD = re.compile(r"\{\{[^{}\n]+\}\}|<%[^%\n]+%>|\$\{[^{}\n]+\}")
# Words of Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur".split()
)
# Titles of trusted notices are an HTTP status.
STATUS = re.compile(r"^(?:\[error\] |error |http )?[45]\d\d\b", re.I)

#: Reasons of blocks.Page that make a line furniture here. Lines of many hosts are not: notices and fillers are such lines.
FURNITURE = ("repeat", "trail", "links", "above")

_SPAN = re.compile(r"`[^`\n]*`")
_TOKEN = re.compile(r"[^\W\d_]+|[{}\[\]<>%$#@|_…]+")
_MARK = re.compile(r"[`{}\[\]<>%$#@|_…]")
#: Tokens that stand for a short record, and for a name between marks, such as a field has: words joined by dots, bars or underscores.
_SHORT, _NAME = "\x01short", "\x01name"
_NAMED = re.compile(r"[{}\[\]<>%$#@_]\s?(?:[#/=]|each |if )?[^\W\d_]+(?:[._|:]+[^\W\d_]+)*(?:\(\))?\s?[{}\[\]<>%$#@_]")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def tokens(passage: str, short: bool, words: list[str] | None = None) -> list[str]:
    """Features of a passage without code spans: words, runs of marks, and whether its record is short. words: the passage's words, if known."""
    if words is not None and not _MARK.search(passage):
        return [*words, _SHORT] if short else words
    text = _SPAN.sub(" ", passage) if "`" in passage else passage
    found = _TOKEN.findall(text.lower())
    if not text.isascii() and _CJK.search(text):
        found = [c for w in found for c in (w if _CJK.search(w) else (w,))]
    if _NAMED.search(text):
        found.append(_NAME)
    if short:
        found.append(_SHORT)
    return found


def is_latin(words: list[str]) -> bool:
    """Whether lower-case words are Latin filler."""
    return len(words) > 5 and sum(map(LATIN.__contains__, words)) > 0.6 * len(words)


def content(page: Page) -> list[int]:
    """Lines that are neither code nor furniture by its own evidence."""
    return [k for k in range(len(page.text)) if page.kind[k] != "code" and page.reason[k] not in FURNITURE]


def passages(page: Page) -> tuple[list[int], bool]:
    lines = content(page)
    size = sum(len(page.text[k]) for k in lines if page.kind[k] != "head")
    return lines, size < SHORT


def trusted(page: Page, title: str | None, warnings: str | None, lines: list[int], short: bool) -> dict[int, int]:
    """Class of the passages of a trusted record: residue by a field or Latin filler, notice in a short record with an HTTP status as title or heading, or stored as blocked.

    Where residue makes up half of the content besides headings, the rest of it counts as residue too.
    """
    out = {}
    heads = [page.text[k].lstrip("# ").strip() for k in lines if page.kind[k] == "head"][:1]
    notice = short and (any(STATUS.search(h) for h in heads) or bool(title and STATUS.search(title.strip())) or bool(warnings and "blocked" in warnings))
    for k in lines:
        text = _SPAN.sub(" ", page.text[k])
        if FIELD.search(text) or is_latin(_WORD.findall(text.lower())):
            out[k] = RESIDUE
        elif notice:
            out[k] = NOTICE
    body = [k for k in lines if page.kind[k] not in ("head", "table")]
    filled = sum(len(page.text[k]) for k in body if out.get(k) == RESIDUE)
    if filled and 2 * filled >= sum(len(page.text[k]) for k in body):
        out |= dict.fromkeys(body, RESIDUE)
    return out


@dataclass
class NaiveBayes:
    """Log-odds of each token, and of the class, of residue and of notice against ordinary text."""

    residue: dict[str, float]
    notice: dict[str, float]
    prior: tuple[float, float]

    def __post_init__(self) -> None:
        self.residue_telling = frozenset(w for w, x in self.residue.items() if x >= TELLING)
        self.telling = frozenset(w for g in (self.residue, self.notice) for w, x in g.items() if x >= TELLING)

    def odds(self, found: list[str], short: bool) -> tuple[float, float]:
        """Log-odds of residue and of notice; only a passage of a short record can be a notice."""
        r, n = self.residue, self.notice
        return self.prior[0] + sum([r[w] for w in found if w in r]), self.prior[1] + sum([n[w] for w in found if w in n]) if short else -50.0


def _best_run(gains: list[float]) -> int:
    """How many of the first gains make the largest sum."""
    best = total = 0.0
    taken = 0
    for k, g in enumerate(gains, 1):
        total += g
        if total > best:
            best, taken = total, k
    return taken


def holds_residue(text: str, found: list[str], short: bool, model: NaiveBayes) -> bool:
    """Whether a sentence of a passage, or the tokens around one of its marks, are residue by themselves."""
    parts = []
    if len(pieces := _SENTENCE_END.split(_SPAN.sub(" ", text))) > 1:
        parts += [tokens(x, short) for x in pieces]
    gains = [model.residue.get(w, 0.0) for w in found]
    for k, w in enumerate(found):
        if _MARK.match(w):
            left, right = gains[max(0, k - REACH) : k], gains[k + 1 : k + 1 + REACH]
            parts.append(found[k - _best_run(left[::-1]) : k + 1 + _best_run(right)])
    for part in parts:
        # A lone sign - a percentage, a sum of money - is no evidence without prose to weigh it against: two telling words or kinds of marks, or a run of marks.
        marks = {w for w in part if _MARK.match(w) and w in model.residue_telling}
        said = sum(w in model.residue_telling and w not in marks for w in part)
        if len(marks) + said > 1 or any(len(w) > 1 for w in marks):
            residue, note = model.odds(part, short)
            if residue > RESIDUE_ODDS and residue > note:
                return True
    return False


def learn(rows: list[tuple[list[str], int]], rounds: int = ROUNDS) -> NaiveBayes:
    """fit_passages() of (tokens, class) rows in memory."""
    found = pa.array([w for f, _ in rows for w in f], pa.string()).dictionary_encode()
    return fit_passages(found, np.array([len(f) for f, _ in rows], dtype=np.int64), np.array([c for _, c in rows], dtype=np.int64), rounds)


def fit_passages(found: pa.DictionaryArray, sizes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> NaiveBayes:
    """EM over passages: all their tokens in a row, numbers of tokens, and classes, -1 for unlabelled. Only passages of short records can be notices.

    First every unlabelled passage counts as ordinary, and each SPY-th trusted one hides among them. Unlabelled passages
    less suspect than the spies are settled as ordinary; only the rest take part in the rounds of expectation and maximization.
    """
    vocabulary, what = found.dictionary.to_pylist(), found.indices.to_numpy()
    v, m = len(vocabulary), len(sizes)
    if not v or not (labels > 0).any():
        return NaiveBayes({}, {}, (-50.0, -50.0))
    where = np.repeat(np.arange(m, dtype=np.int32), sizes)
    long = np.bincount(where[what == vocabulary.index(_SHORT)], minlength=m) == 0 if _SHORT in vocabulary else np.ones(m, dtype=bool)
    corpus = np.bincount(what, minlength=v) / len(what)
    free = labels < 0

    def maximize(post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.stack([np.bincount(what, post[where, c], minlength=v) for c in range(3)])
        logs = np.log((counts + BACKGROUND * corpus) / (counts.sum(1, keepdims=True) + BACKGROUND))
        return logs, np.log((post.sum(0) + 1) / (post.sum() + 3))

    def expect(logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
        score = np.stack([np.bincount(where, logs[c][what], minlength=m) for c in range(3)], axis=1) + prior
        score[long & free, NOTICE] = -1e9
        return score

    hard = lambda classes: np.eye(3)[classes]
    spies = np.flatnonzero(~free)[::SPY]
    start = np.where(free, ORDINARY, labels)
    hidden = start.copy()
    hidden[spies] = ORDINARY
    score = expect(*maximize(hard(hidden)))
    suspect = score[:, 1:].max(1) - score[:, ORDINARY]
    open_ = free & (suspect >= np.quantile(suspect[spies], SPY_SHARE))
    post = hard(start)
    for _ in range(rounds):
        score = expect(*maximize(post))
        score = np.exp(score - score.max(1, keepdims=True))
        post[open_] = (score / score.sum(1, keepdims=True))[open_]
    logs, prior = maximize(post)
    gain = logs - logs[ORDINARY]
    # Only tokens that tell for a class, or speak against it, take part: what lies between decides nothing.
    pick = lambda c: {w: float(g) for w, g in zip(vocabulary, gain[c], strict=True) if g >= TELLING or g < -0.05}
    return NaiveBayes(pick(RESIDUE), pick(NOTICE), (float(prior[RESIDUE] - prior[ORDINARY]), float(prior[NOTICE] - prior[ORDINARY])))


def judge(page: Page, model: NaiveBayes) -> tuple[int, float]:
    """Number of residue passages, and the share of notices in the content besides headings.

    A line of the site's furniture counts only if it has marks and the model is firm that they are residue; a line of many hosts counts only if the model finds it.
    """
    short = passages(page)[1]
    n_residue = notice = rest = 0
    for k, text in enumerate(page.text):
        kind, why = page.kind[k], page.reason[k]
        if kind == "code":
            continue
        own = why in FURNITURE
        if own and ("](" in text or not _MARK.search(text)):
            continue
        found = tokens(text, short, page.words[k])
        residue, note = (-1.0, -1.0) if model.telling.isdisjoint(found) else model.odds(found, short)
        if residue > (FIRM_ODDS if kind == "head" or own else RESIDUE_ODDS) and (residue > note or _MARK.search(text)):
            n_residue += 1
        elif own:
            continue
        elif kind != "head" and not model.residue_telling.isdisjoint(found) and holds_residue(text, found, short, model):
            n_residue += 1
        if kind != "head":
            if note > NOTICE_ODDS and note >= residue:
                notice += len(text)
            elif why != "common":
                rest += len(text)
    return n_residue, notice / (notice + rest) if notice else 0.0


def may_be_trusted() -> F.Column:
    """Native test for pages of which trusted() would take something, most of them and few others: plain searches, patterns only behind them."""
    title, has = F.coalesce("title", F.lit("")), lambda x: F.contains("markdown", F.lit(x))
    status = r"(?im)^(?:# *)?(?:\[error\] |error |http )?[45]\d\d\b"
    either = F.rlike(title, F.lit(status)) | F.contains("warnings", F.lit("blocked")) | ((has("# 4") | has("# 5")) & F.rlike("markdown", F.lit(status)))
    for x in ("{{", "<%", "${", "lorem", "adipiscing", "consectetur", "incididunt"):
        either = F.coalesce(either, F.lit(False)) | has(x)
    return F.coalesce(either, F.lit(False))


def fit_sample(rows: DataFrame) -> DataFrame:
    """The pages to fit on: of those that may be trusted ones about FIT_TRUSTED, of the others about FIT_RECORDS, chosen by the hash of the page."""
    fits = rows.where(F.length("markdown") <= FIT_CHARS).withColumn("_likely", may_be_trusted())
    n = {r._likely: r.n for r in fits.groupBy("_likely").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("page_id", F.lit("fit")), F.lit(2**30))
    least = lambda likely, most: F.lit(int(min(1.0, most / max(1, n.get(likely, 0))) * 2**30))
    return fits.where(place < F.when(F.col("_likely"), least(True, FIT_TRUSTED)).otherwise(least(False, FIT_RECORDS))).drop("_likely")


def fit(rows: DataFrame, repeats: Repeats) -> NaiveBayes:
    """Model of pages (page_id, markdown, title, host, warnings, own_keys) and what tells their repeated lines. Passages are labelled and cut into tokens in the tasks.

    Pages without any trusted record give a model that finds nothing.
    """
    sent = send(rows.sparkSession, repeats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines_of = receive(sent)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, markdown, title, host, warnings, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = lines_of.label(markdown, host, keys)
                lines, short = passages(page)
                classes = trusted(page, title, warnings, lines, short)
                for k in lines:
                    out[0].append(i)
                    out[1].append(classes.get(k, -1))
                    out[2].append(" ".join(tokens(page.text[k], short, page.words[k])))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["page_id", "class", "tokens"])

    chosen = fit_sample(rows).select("page_id", "markdown", "title", "host", "warnings", "own_keys")
    # A bounded sample; its order decides which passages are spies.
    known = chosen.mapInArrow(run, "page_id bigint, class bigint, tokens string").toArrow().sort_by([("page_id", "ascending"), ("class", "ascending"), ("tokens", "ascending")])
    said = known["tokens"].combine_chunks()
    split = pc.split_pattern(said if isinstance(said, pa.Array) else pa.array([], pa.string()), " ")
    found = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode() if len(split) else pa.array([], pa.string()).dictionary_encode()
    return fit_passages(found, np.diff(split.offsets.to_numpy()), known["class"].to_numpy())


def judged_pages(pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """page_id, n_residue, notice_share of each page (page_id, markdown, title, host, warnings if there are any); counts is stored count_corpus() of the pages, made here if absent.

    Null markdown gives no row, an empty page zeros, repeated pages repeated rows.
    """
    rows, repeats = with_repeats(with_warnings(pages.where(F.col("markdown").isNotNull())), ["page_id", "markdown", "title", "warnings"], counts)
    sent = send(pages.sparkSession, (fit(rows, repeats), repeats))
    schema = pa.schema([("page_id", pa.int64()), ("n_residue", pa.int64()), ("notice_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes, lines = receive(sent)
        for batch in batches:
            ids, hosts, own = (batch.column(k).to_pylist() for k in (0, 2, 3))
            got = [judge(lines.label(t.as_py(), h, o), bayes) for t, h, o in zip(batch.column(1), hosts, own, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], schema=schema)

    return rows.select("page_id", "markdown", "host", "own_keys").mapInArrow(run, "page_id bigint, n_residue bigint, notice_share double")


def with_warnings(pages: DataFrame) -> DataFrame:
    """pages with the column warnings as one text; null where there are none."""
    if "warnings" not in pages.columns:
        return pages.withColumn("warnings", F.lit(None).cast("string"))
    return pages.withColumn("warnings", F.array_join("warnings", " ")) if pages.schema["warnings"].dataType.typeName() == "array" else pages


def is_case() -> F.Column:
    return (F.col("n_residue") > 0) | (F.col("notice_share") > NOTICE_SHARE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are, or hold, residue or a notice."""
    pages = load_pages(spark, sf_dir, "title", "completeness_report.warnings")
    return judged_pages(pages).where(is_case()).select("page_id")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue passages and notice share of every page."""
    pages = load_pages(spark, sf_dir, "title", "completeness_report.warnings")
    return judged_pages(pages)


QUERIES = {"p5_found": p5_found, "p5_scores": p5_scores}
ORACLE: dict[str, str] = {}
