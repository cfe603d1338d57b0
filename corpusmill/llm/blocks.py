"""Problem 2: the lines of the article, told from the site furniture around and inside it.

First pass over a page's lines (each line of markdown is a block): rules on length, density of function words, density
of links and repetition decide the clear blocks. Second pass: ambiguous short blocks inherit from their nearest
decided neighbours, the ends of the page counting as furniture.

Repetition comes from one pass over the corpus: how many pages of a host, and of all hosts, hold a line (digit runs
count as equal). The lines above a share are a table by host and line. It is sent to the tasks while it is
below SEND_LINES rows; beyond that it is joined to the lines of each page by key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import pages_with_host, receive, send, single_blanks, texts, trim_blanks
from .counting import ASCII_LETTERS, count_corpus, host_seed, line_form, signed

ARTICLE, FURNITURE, UNSURE = 1, 0, -1

# Function words of the languages met, by language.
FUNCTION_WORDS = frozenset(
    (
        "the of a an and to in is are was were be been for with that this on by at from or not as it its if so no one "
        "der die das den dem des ein eine einen und ist sind wurde wurden mit von zu im auf für nicht bei nach aus bis "
        "le la les un une et est sont du des au aux dans pour par sur que qui ne pas se ce cette sans ou à l d en "
        "el los las y del al una unos es son por para con sin que se su lo no si o más "
        "il lo gli di da che non per con sono della nel si "
        "o os as um uma do dos da na no não são com em ao "
        "het een van niet zijn op voor met aan bij de "
        "och att det som är för på av inte "
        "i w na z nie jest się do "
        "и в на не с по что к из за при от о без для как чтобы если когда только пока потому прежде чем"
    ).split()
)

#: From this length on a block that reads like prose is article text wherever it stands.
LONG = 200

MIN_HOST_PAGES, HOST_SHARE = 5, 0.10
MIN_HOSTS, CORPUS_SHARE = 5, 0.001
#: Short lines whose verdict a task remembers.
MEMO = 300_000
#: Rows up to which the table of repeated lines is sent to the tasks, some 65 bytes a row in the set of each Python worker.
SEND_LINES = 500_000

_LINK = re.compile(r"!?\[([^\]]*)\]\(([^()\s]*)[^()]*\)")
_ITEM = re.compile(r"(?:[-*+•]|\d{1,3}[.)]) +")
_FILE = re.compile(r"\.(?:pdf|zip|tar|gz|tgz|docx?|xlsx?|pptx?|csv|bin|iso|exe|msi|txt|epub)(?:$|[?#])|/(?:files|downloads?)/", re.I)
_TRAIL = re.compile(r" (?:>|»|›|→) ")
_CODE = ("code", ARTICLE, "", False, None)
_KANA = re.compile(r"[぀-ヿ]")
_WORD = re.compile(r"[^\W\d_]+")
_END = (".", "!", "?", ":", ";", "。", "！", "？", "…", ".\"", ".)", "»", "\"")


def line_hashes(host: Column, markdown: Column) -> Column:
    """Distinct pairs (hash of host and line, hash of line) of a page's lines but headings and table rows."""
    form = lambda x: F.regexp_replace(single_blanks(F.lower(x)), "[0-9]+", "0")
    wanted = lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("|"))
    forms = F.transform(F.filter(F.transform(F.split(markdown, "\n"), trim_blanks), wanted), form)
    return F.transform(F.array_distinct(forms), lambda x: F.struct(F.xxhash64(host, x).alias("key"), F.xxhash64(x).alias("form")))


def repeated_lines(counts: DataFrame) -> tuple[DataFrame, int]:
    """key: hashes of (host, line) of the lines on many pages of their host, and of (line) of those on many pages of many hosts; and the number of pages.

    counts is count_corpus().
    """
    by_host = counts.where(F.col("key").isNotNull())
    hosts = counts.where(F.col("key").isNull() & F.col("host").isNotNull()).select("host", F.col("n").alias("host_pages"))
    n_pages = hosts.agg(F.sum("host_pages")).first()[0] or 0
    on_host = by_host.where(F.col("n") >= MIN_HOST_PAGES).join(hosts, "host").where(F.col("n") >= HOST_SHARE * F.col("host_pages")).select("key")
    spread = by_host.groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_hosts"))
    common = spread.where((F.col("n_hosts") >= MIN_HOSTS) & (F.col("n") >= CORPUS_SHARE * n_pages)).select(F.col("form").alias("key"))
    return on_host.union(common).distinct(), n_pages


@dataclass
class Page:
    """Non-blank lines of a page: line_no, trimmed text, label; kind: 'code', 'table', 'head', 'item', 'text'.

    reason: 'repeat' (on its host), 'common' (on many hosts) or 'trail' for furniture by its own evidence, 'links' for lines of links that are
    not repeated, 'above' for prose above the title, 'prose' for article text by rule, '' for the rest. block: number of the run of lines between blank ones.
    words: lower-case words of a line without links, where the rules needed them.
    """

    number: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    reason: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    words: list[list[str] | None] = field(default_factory=list)


def _sentence(s: str) -> tuple[bool, list[str] | None]:
    """Whether a line reads like prose: it ends like a sentence, with enough words and function words. Also its words, where they were needed."""
    if not s.isascii() and _KANA.search(s):
        return len(s) >= 12 and s.endswith(_END), None
    if not s.endswith(_END):
        return False, None
    words = s.lower().translate(ASCII_LETTERS).split() if s.isascii() else _WORD.findall(s.lower())
    if len(words) < 4:
        return False, words
    if len(s) > LONG:
        return not FUNCTION_WORDS.isdisjoint(words), words
    known = sum(map(FUNCTION_WORDS.__contains__, words))
    return known > 0 and known >= 0.05 * len(words), words


def _decide(s: str, repeated: Callable[[str], str]) -> tuple[str, int, str, bool, list[str] | None]:
    """Kind, label, reason, whether it is a list item of links, and words of a trimmed line outside code, by itself."""
    if s[0] == "#" and s.lstrip("#")[:1] in (" ", "\t"):
        return "head", ARTICLE, "", False, None
    if s[0] == "|" and s[-1] == "|" and len(s) > 1:
        return "table", ARTICLE, "", False, None
    m = _ITEM.match(s) if s[0] in "-*+•0123456789" else None
    sort, body = ("item", s[m.end() :]) if m else ("text", s)
    found = _LINK.findall(body) if "](" in body else ()
    if found and sum(len(a) for a, _ in found) >= len(_LINK.sub("", body).strip(" |·•-–—,;/")):
        if all(_FILE.search(b) for _, b in found):
            return sort, ARTICLE, "", False, None
        return sort, FURNITURE, repeated(s) or "links", m is not None, None
    prose, own = _sentence(body)
    if prose and len(s) > LONG:
        return sort, ARTICLE, "prose", False, None if found else own
    if (m is None or found) and (why := repeated(s)):
        return sort, FURNITURE, why, False, None
    if (">" in s or "»" in s or "›" in s or "→" in s) and len(_TRAIL.findall(s)) > 1:
        return sort, FURNITURE, "trail", False, None
    return sort, ARTICLE if prose else UNSURE, "prose" if prose else "", False, None if found else own


def label_lines(markdown: str, repeated: Callable[[str], str], memo: dict | None = None) -> Page:
    """The page with a label for each non-blank line. repeated tells of a trimmed line whether the corpus repeats it ('repeat', 'common' or ''); memo keeps what it said of short lines."""
    page = Page()
    number, text, kind, label, reason, groups, words = page.number, page.text, page.kind, page.label, page.reason, page.block, page.words
    links: list[bool] = []  # a list item that is only links to pages
    group, fenced = 0, False
    for i, raw in enumerate(markdown.split("\n")):
        s = raw.strip()
        if not s:
            group += 1
            continue
        number.append(i)
        text.append(s)
        groups.append(group)
        if fenced or s.startswith("```"):
            if s.startswith("```"):
                fenced = not fenced
            told = _CODE
        else:
            told = memo.get(s) if memo is not None else None
            if told is None:
                told = _decide(s, repeated)
                if memo is not None and len(s) <= LONG:
                    memo[s] = told
        kind.append(told[0])
        label.append(told[1])
        reason.append(told[2])
        links.append(told[3])
        words.append(told[4])
    n = len(text)
    # Prose of a line above the page title is a notice of the site, as is all else above it.
    top = next((k for k in range(n) if kind[k] == "head" and text[k].startswith("# ")), 0)
    for k in range(top):
        if kind[k] == "text" and label[k] == ARTICLE and len(text[k]) <= LONG:
            label[k], reason[k] = UNSURE, "above"
    # A heading or short label right before a list of links to pages belongs to the list.
    title = next((k for k in range(n) if kind[k] == "head"), -1)
    for k in [i - 1 for i, x in enumerate(links) if x and i]:
        if groups[k + 1] - groups[k] <= 1 and k != title and not links[k]:
            if kind[k] == "head" or (kind[k] == "text" and label[k] == UNSURE and len(text[k]) < 80):
                label[k] = FURNITURE
    # Ambiguous blocks inherit.
    decided = label[:]
    settled = [k for k in range(n) if decided[k] != UNSURE]
    at = 0  # settled[at] is the first settled block behind the one looked at
    for k in range(n):
        if decided[k] != UNSURE:
            at += 1
        else:
            a, b = settled[at - 1] if at else -1, settled[at] if at < len(settled) else n
            la = decided[a] if a >= 0 else FURNITURE
            lb = decided[b] if b < n and (k >= top or b < top) else FURNITURE
            if la == lb:
                label[k] = la
            elif kind[k] == "item" or text[k].endswith(_END) or text[k].count(",") > 1:
                near_a, near_b = (k - a if a >= 0 else n), (b - k if b < n else n)
                label[k] = la if near_a <= near_b else lb
            else:
                label[k] = FURNITURE
    return page


class Repeats:
    """Labels pages: knows the repeated lines by keys sent to the task, or by the keys that came with each page."""

    def __init__(self, keys: np.ndarray | None, n_pages: int = 0):
        self.held = None if keys is None else set(keys.tolist())
        self.n_pages = n_pages
        self.memos: dict[str, dict] = {}
        self.noted = 0

    def told(self, host: str, own: list[int] | None) -> Callable[[str], str]:
        seed, held = host_seed(host), self.held if self.held is not None else set(own or ())

        def repeated(line: str) -> str:
            form = line_form(line)
            if signed(xxhash.xxh64_intdigest(form, seed)) in held:
                return "repeat"
            return "common" if signed(xxhash.xxh64_intdigest(form, 42)) in held else ""

        return repeated

    def label(self, markdown: str, host: str, own: list[int] | None) -> Page:
        """The labelled page. Verdicts on short lines are remembered by host while the keys hold for all its pages; the memory of a task is bounded."""
        if self.held is None:
            return label_lines(markdown, self.told(host, own))
        if self.noted > MEMO:
            self.memos, self.noted = {}, 0
        memo = self.memos.setdefault(host, {})
        before = len(memo)
        page = label_lines(markdown, self.told(host, None), memo)
        self.noted += len(memo) - before
        return page


def with_repeats(pages: DataFrame, columns: list[str], counts: DataFrame | None = None, most: int = SEND_LINES) -> tuple[DataFrame, Repeats]:
    """The pages' columns, host and own_keys, and what tells repeated lines.

    own_keys is null where the keys are sent; where they are too many it holds each page's repeated keys, joined by key.
    """
    keys, n_pages = repeated_lines(stored(count_corpus(pages, of_words=False)) if counts is None else counts)
    few = np.array([r.key for r in keys.limit(most + 1).toLocalIterator()], dtype=np.int64)
    if len(few) <= most:
        return pages.select(*columns, "host", F.lit(None).cast("array<bigint>").alias("own_keys")), Repeats(few, n_pages)
    hashes = line_hashes(F.col("host"), F.col("markdown"))
    both = F.concat(F.transform(hashes, lambda x: x["key"]), F.transform(hashes, lambda x: x["form"]))
    lines = pages.select("page_id", F.explode(both).alias("key"))
    own = lines.join(keys, "key", "left_semi").groupBy(F.col("page_id").alias("_own_page")).agg(F.collect_set("key").alias("own_keys"))
    return pages.join(own, F.col("page_id") == F.col("_own_page"), "left").select(*columns, "host", "own_keys"), Repeats(None, n_pages)


def load_pages(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Pages with markdown and the host of their URL; texts are not shuffled for it."""
    return pages_with_host(texts(spark, sf_dir, "discovered_pages"), None, ["page_id", "markdown", *extra])


def labelled_lines(pages: DataFrame, most: int = SEND_LINES) -> DataFrame:
    """page_id, line_no, article (boolean) of every non-blank line of pages (page_id, markdown, host).

    Null markdown gives no row; a page of blank lines none either; repeated pages repeat their rows.
    """
    rows, repeats = with_repeats(pages.where(F.col("markdown").isNotNull()), ["page_id", "markdown"], most=most)
    sent = send(pages.sparkSession, repeats)
    schema = pa.schema([("page_id", pa.int64()), ("line_no", pa.int64()), ("article", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = receive(sent)
        for batch in batches:
            ids, hosts, own = (batch.column(k).to_pylist() for k in (0, 2, 3))
            out: tuple[list, list, list] = ([], [], [])
            for i, text, host, keys in zip(ids, batch.column(1), hosts, own, strict=True):
                page = told.label(text.as_py(), host, keys)
                out[0].extend([i] * len(page.number))
                out[1].extend(page.number)
                out[2].extend(x == ARTICLE for x in page.label)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "page_id bigint, line_no bigint, article boolean")
