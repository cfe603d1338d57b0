"""Problem 1: pages of stuffed keywords, bare links or product, place and tag names instead of sentences.

Pass one counts words and pairs of neighbouring words over the whole corpus (pre-aggregated in each task, one
shuffle); all counts stay a table. Pass two takes each page by itself: site furniture, told by blocks.label_lines, stays out of the account, sentences
count as text and lines of bare links as stuffing. What may be keywords - listings, long lines without function words, lines that a
collocation dominates - is handed on as passages of word pairs, to which the counts are joined by key.

The counts decide a passage by its coherence: the mean pointwise mutual information of its neighbouring words, each pair's normalised by its own
information, so that 0 means words met by chance and 1 words always met together, at any size of corpus. A collocation that the page repeats
excessively, measured by its share in the corpus, informs once and then counts as 0. Word salad and repeated collocations both end up
below COHERENT. A page's own words do not speak for it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .blocks import FUNCTION_WORDS, LONG, Page, load_pages, with_repeats
from .common import receive, send
from .counting import URL, count_corpus, page_words, signed, words
from .residue import is_latin

#: Pairs, met and expected by chance alike, that are added to each count: an unseen pair of rare words tells nothing, one of frequent words much.
SMOOTHING = 0.5
#: Mean normalised PMI from which a passage is text.
COHERENT = 0.45
#: A pair repeats excessively if a page has it so often and its share there is so many times its share in the corpus.
REPEATS, EXCESS = 3, 2.0
#: A collocation with a content word dominates a page from this share of its pairs on, if it occurs so often.
DOMINANT_SHARE, DOMINANT_COUNT = 0.03, 4
#: Share of a line's words inside dominating collocations from which the counts decide about it.
COVERED = 0.30
#: Share of function words below which a line is no sentence.
FUNCTION_SHARE = 0.07
#: Lines below so many words that end without a stop are listings up to this share.
LISTED_WORDS, LISTED_SHARE = 12, 0.25
#: Words from which the listings of a page are a passage.
LEAST_WORDS = 20
#: A list of links under a label is a related list up to this length.
RELATED = 10
SPAM_SHARE = 0.5

_KANA = re.compile(r"[ぁ-ゟ]")
_END = (".", "!", "?", "。", "！", "？", "…")
# Marks of unfilled template fields.
TEMPLATE = re.compile(r"\{\{|\}\}|\{%|<%|\$\{|#\{|\[\[|<<\w|%%?\w+%|\$\w+\$|__\w+__|@\w+\.\w|\{[\w.|]+\}")


@dataclass
class Account:
    """Characters of a page that are stuffing and that are not, and the passages (characters if stuffing, if not, words of the lines) that the corpus decides."""

    spam: int
    good: int
    open: list[tuple[int, int, list[list[str]]]]

    def settle(self) -> None:
        """Closes the passages where they cannot move the page over SPAM_SHARE, or back."""
        most, rest = self.spam + sum(x[0] for x in self.open), self.good + sum(x[1] for x in self.open)
        if not above(most, self.good):
            self.spam, self.open = most, []
        elif above(self.spam, rest):
            self.good, self.open = rest, []


def above(spam: int, good: int) -> bool:
    return spam > SPAM_SHARE * (spam + good)


def _words_and_pairs(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = counts.where(F.col("a").isNotNull())
    return known.where(F.col("b").isNull()).select(F.col("a").alias("word"), F.col("n").alias("n_word")), known.where(F.col("b").isNotNull()).select("a", "b", "n")


def _with_words(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """pairs (a, b) with n_a and n_b, how often their words are in the corpus."""
    for side in ("a", "b"):
        pairs = pairs.join(single.select(F.col("word").alias(side), F.col("n_word").alias(f"n_{side}")), side, "left")
    return pairs


def _function_share(line: str, w: list[str]) -> float:
    if not line.isascii() and (kana := len(_KANA.findall(line))):
        return kana / max(1, len(w))
    return sum(map(FUNCTION_WORDS.__contains__, w)) / max(1, len(w))


def account(page: Page) -> Account:
    """The characters besides furniture: stuffed keywords, bare links or names, others, and passages that may be salad."""
    n = len(page.text)
    good = spam = 0
    unsettled: list[tuple[int, int, list[list[str]]]] = []
    title = next((k for k in range(n) if page.kind[k] == "head"), -1)
    ordered: list[tuple[int, list[str]]] = []
    k = 0
    while k < n:
        kind, why, text = page.kind[k], page.reason[k], page.text[k]
        if kind in ("code", "table"):
            good += len(text)
        elif kind == "head":
            if k != title and page.label[k]:
                good += len(text)
        elif why == "links":
            stop = k
            while stop < n and page.reason[stop] == "links" and page.block[stop] - page.block[k] == 0:
                stop += 1
            related = kind == "item" and stop - k <= RELATED and k > 0 and page.kind[k - 1] in ("head", "text") and page.reason[k - 1] != "prose"
            pointer = kind == "text" and stop == k + 1 and text.count("](") == 1
            if not (related or pointer):
                spam += sum(len(page.text[i]) for i in range(k, stop))
            k = stop
            continue
        elif why in ("repeat", "trail", "above"):
            pass
        elif page.kind[k] == "item" and page.label[k] and "](" in text and why != "prose":
            good += len(text)  # downloads
        else:
            w = page.words[k]
            if w is None or "://" in text:
                w = words(text)
            if len(w) < 1:
                if URL.search(text):
                    spam += len(text)
            elif why != "common" or not text.endswith(_END):
                ordered.append((k, w))
        k += 1
    # A dominating pair has a content word that is as frequent; where there is none, pairs need not be counted.
    often: Counter = Counter()
    for _, w in ordered:
        often.update(w)
    total = sum(often.values()) - len(ordered)
    least = max(DOMINANT_COUNT, DOMINANT_SHARE * total)
    frequent = {x for x, c in often.items() if c >= least and x not in FUNCTION_WORDS}
    pairs: Counter = Counter()
    if frequent:
        for _, w in ordered:
            pairs.update(zip(w, w[1:], strict=False))
    top = {p for p, c in pairs.items() if c >= least and not frequent.isdisjoint(p)}
    listed: list[tuple[int, list[str]]] = []
    dominated: list[tuple[int, list[str]]] = []
    for k, w in ordered:
        text, covered = page.text[k], 0
        if top:
            inside = [False] * len(w)
            for i in range(len(w) - 1):
                if (w[i], w[i + 1]) in top:
                    inside[i] = inside[i + 1] = True
            covered = sum(inside)
        ended = text.endswith(_END)
        share = 1.0 if ended and page.reason[k] == "prose" and len(text) <= LONG else _function_share(text, w)
        if page.reason[k] == "common":
            listed.append((k, w))
        elif TEMPLATE.search(text) or is_latin(w):
            good += len(text)  # an unfilled form or filler, whatever it repeats: problem 5
        elif covered >= COVERED * len(w) and len(w) > 1:
            dominated.append((k, w))
        elif not ended and (share < FUNCTION_SHARE or (share < LISTED_SHARE and len(w) < LISTED_WORDS)):
            listed.append((k, w))
        elif ended and share < FUNCTION_SHARE and len(w) >= LISTED_WORDS:
            unsettled.append((len(text), len(text), [w]))
        else:
            good += len(text)
    if dominated:
        size = sum(len(page.text[k]) for k, _ in dominated)
        unsettled.append((size, size, [w for _, w in dominated]))
    # a line that many hosts have is furniture unless it is stuffing
    own = sum(len(page.text[k]) for k, _ in listed if page.reason[k] != "common")
    if sum(len(w) for _, w in listed) >= LEAST_WORDS:
        unsettled.append((sum(len(page.text[k]) for k, _ in listed), own, [w for _, w in listed]))
    else:
        good += own
    return Account(spam, good, unsettled)


def short_account(page: Page) -> Account:
    """An account on the same side of SPAM_SHARE as account(), settled where it can be. Pages of prose without a frequent content word are told by a bound on it."""
    sure = doubt = pairs = 0
    every: list[str] = []
    for k, text in enumerate(page.text):
        why, kind = page.reason[k], page.kind[k]
        if why == "prose":
            w = page.words[k]
            if w is None or "://" in text:
                w = words(text)
            every += w
            pairs += len(w) - 1
            if text.endswith(_END) and (len(text) <= LONG or sum(map(FUNCTION_WORDS.__contains__, w)) >= FUNCTION_SHARE * len(w)):
                sure += len(text)
            else:
                doubt += len(text)
        elif kind in ("code", "table"):
            sure += len(text)
        elif why not in ("repeat", "trail", "above") and kind != "head":
            doubt += len(text)
            if why != "links":
                every += words(text)
    if sure * SPAM_SHARE >= doubt * (1 - SPAM_SHARE):
        least = max(DOMINANT_COUNT, DOMINANT_SHARE * pairs)  # of fewer pairs than account() counts: too low, if anything
        if not any(c >= least and x not in FUNCTION_WORDS for x, c in Counter(every).items()):
            return Account(0, sure, [])
    told = account(page)
    told.settle()
    return told


#: Columns of a page's account: a hash that tells pages of one page_id apart, characters, how many pairs of words the page has, and the open
#: passages with theirs - how often in the passage, and how often the page has the pair and its words.
_PAIR = pa.struct([("a", pa.string()), ("b", pa.string()), ("k", pa.int64()), ("own", pa.int64()), ("own_a", pa.int64()), ("own_b", pa.int64())])
ACCOUNT = [("digest", pa.int64()), ("spam", pa.int64()), ("good", pa.int64()), ("n_pairs", pa.int64()), ("open", pa.list_(pa.struct([("spam", pa.int64()), ("good", pa.int64()), ("pairs", pa.list_(_PAIR))])))]
ACCOUNT_DDL = "digest bigint, spam bigint, good bigint, n_pairs bigint, open array<struct<spam: bigint, good: bigint, pairs: array<struct<a: string, b: string, k: bigint, own: bigint, own_a: bigint, own_b: bigint>>>>"
CLOSED = (0, 0, 0, 0, None)


def account_row(told: Account, markdown: str, host: str) -> tuple:
    """The columns of ACCOUNT; open is null where nothing is."""
    if not told.open:
        return 0, told.spam, told.good, 0, None
    w = page_words(markdown.lower())
    single, both = Counter(w), Counter(zip(w, w[1:], strict=False))
    digest = signed(xxhash.xxh64_intdigest(f"{host}\n{markdown}".encode("utf-8", "surrogatepass")))
    passages = []
    for spam, good, lines in told.open:
        pairs = Counter(p for x in lines for p in zip(x, x[1:], strict=False))
        passages.append({"spam": spam, "good": good, "pairs": [{"a": a, "b": b, "k": k, "own": both[a, b], "own_a": single[a], "own_b": single[b]} for (a, b), k in pairs.items()]})
    return digest, told.spam, told.good, len(w), passages


def coherence(n_words: int, n_pairs: int) -> F.Column:
    """Sum over pairs (k, n_pairs of their page, own, own_a, own_b; n, n_a, n_b of the corpus) of their normalised PMI without the page's own words.

    A pair that the page repeats excessively counts once.
    """
    others = lambda n, own: F.greatest(F.coalesce(F.col(n), F.lit(0)) - F.col(own), F.lit(0))
    met = others("n", "own") + F.lit(SMOOTHING)
    chance = others("n_a", "own_a") * others("n_b", "own_b") * F.lit(n_pairs / max(1, n_words) ** 2) + F.lit(SMOOTHING)
    normal = F.log(met / chance) / F.log(F.lit(n_pairs + 1.0) / met)
    excessive = (F.col("own") >= REPEATS) & (F.col("own") / F.col("n_pairs") >= F.lit(EXCESS) * met / F.lit(n_pairs + 1.0))
    return F.sum(F.when(excessive, F.least(F.col("k"), F.lit(1))).otherwise(F.col("k")) * normal)


def close(accounts: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of accounts (page_id, columns of ACCOUNT, others) with every passage settled by the corpus counts: without digest, n_pairs and open.

    Both inputs are read several times, so hand in stored ones. Only open passages move: each distinct pair of them meets the counts once, and only those
    rows are joined to their verdict. A passage without any pair is stuffing.
    """
    known = counts.where(F.col("a").isNotNull())
    single = known.where(F.col("b").isNull()).select(F.col("a").alias("word"), F.col("n").alias("n_word"))
    pairs = known.where(F.col("b").isNotNull()).select("a", "b", "n")
    totals = known.agg(F.coalesce(F.sum(F.when(F.col("b").isNull(), F.col("n"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(F.col("b").isNotNull(), F.col("n"))), F.lit(0)).alias("pairs")).first()
    undecided = accounts.where(F.col("open").isNotNull())
    passage = (
        undecided.select("page_id", "digest", "n_pairs", F.posexplode("open").alias("no", "o"))
        .select("page_id", "digest", "n_pairs", "no", F.col("o.spam").alias("if_spam"), F.col("o.good").alias("if_good"), F.explode_outer("o.pairs").alias("p"))
        .select("page_id", "digest", "n_pairs", "no", "if_spam", "if_good", "p.*")
    )
    met = passage.where(F.col("a").isNotNull()).select("a", "b").distinct().join(pairs, ["a", "b"], "left")
    for side in ("a", "b"):
        met = met.join(single.select(F.col("word").alias(side), F.col("n_word").alias(f"n_{side}")), side, "left")
    verdict = (
        passage.join(met, ["a", "b"], "left")
        .groupBy("page_id", "digest", "no", "if_spam", "if_good")
        .agg((coherence(totals.words, totals.pairs) / F.sum("k")).alias("mean"))
        .withColumn("stuffed", F.col("mean").isNull() | (F.col("mean") < F.lit(COHERENT)))
        .groupBy("page_id", "digest")
        .agg(F.sum(F.when(F.col("stuffed"), F.col("if_spam")).otherwise(0)).alias("if_spam"), F.sum(F.when(F.col("stuffed"), 0).otherwise(F.col("if_good"))).alias("if_good"))
    )
    closed = undecided.join(verdict, ["page_id", "digest"], "left").withColumns({"spam": F.col("spam") + F.col("if_spam"), "good": F.col("good") + F.col("if_good")})
    columns = [c for c in accounts.columns if c not in ("digest", "n_pairs", "open")]
    return accounts.where(F.col("open").isNull()).select(*columns).unionByName(closed.select(*columns))


def share() -> F.Column:
    """spam_share of an account; 0 for a page without text."""
    return F.when(F.col("spam") + F.col("good") > 0, F.col("spam") / (F.col("spam") + F.col("good"))).otherwise(0.0)


def is_stuffed() -> F.Column:
    return share() > SPAM_SHARE


def spam_pages(pages: DataFrame, counts: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """page_id, spam_share of each page (page_id, markdown, host). Null markdown gives no row, an empty page share 0. counts is kept_counts() of the pages, made here if absent.

    Shares that need not be exact are on the right side of SPAM_SHARE.
    """
    counts = kept_counts(pages) if counts is None else counts
    rows, repeats = with_repeats(pages.where(F.col("markdown").isNotNull()), ["page_id", "markdown"], counts)
    told = send(pages.sparkSession, repeats)
    schema = pa.schema([("page_id", pa.int64()), *ACCOUNT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = receive(told)
        for batch in batches:
            ids, hosts, own = (batch.column(k).to_pylist() for k in (0, 2, 3))
            made = []
            for t, h, o in zip(batch.column(1), hosts, own, strict=True):
                markdown = t.as_py()
                page_account = account(lines.label(markdown, h, o))
                if not exact:
                    page_account.settle()
                made.append(account_row(page_account, markdown, h))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([m[k] for m in made], kind) for k, (_, kind) in enumerate(ACCOUNT))], schema=schema)

    accounts = stored(rows.mapInArrow(run, f"page_id bigint, {ACCOUNT_DDL}"))
    return close(accounts, counts).select("page_id", share().alias("spam_share"))


def kept_counts(pages: DataFrame) -> DataFrame:
    """Counts of the corpus as a table in the shared folder."""
    return stored(count_corpus(pages))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are more than half stuffed keywords, bare links or names."""
    return spam_pages(load_pages(spark, sf_dir), exact=False).where(F.col("spam_share") > SPAM_SHARE).select("page_id")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of stuffing of every page."""
    return spam_pages(load_pages(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_shares": p1_shares}
ORACLE: dict[str, str] = {}
