"""Scalar functions on small tables: documented values and edge cases."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import quality, urls
from corpusmill.functions import text as T
from corpusmill.plans.pipeline import quality_columns


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "title, expected",
    [("High-End Servers | Acme", "High-End Servers"), ("A - B - C", "A"), ("| X", "| X"), ("Guide — Acme", "Guide"), ("  a  b ", "a b"), ("", ""), (None, None)],
)
def test_clean_title(spark, title, expected):
    assert one(spark, title, T.clean_title) == expected


@pytest.mark.parametrize("text, expected", [("", 0), ("abcd", 1), ("abcde", 2), ("  \n", 0), (None, None)])
def test_tokens(spark, text, expected):
    assert one(spark, text, T.estimate_tokens) == expected


@pytest.mark.parametrize(
    "markdown, expected",
    [("[a-b](u) **c**", "a b c"), ("# T\nx\n---\ny\n---\nz", "x z"), ("![alt](u)", "!alt"), ("High-End", "High End"), ("# A\r\nb\r\n", "b"), ("", "")],
)
def test_plain_text(spark, markdown, expected):
    assert one(spark, markdown, T.plain_text) == expected


@pytest.mark.parametrize("n, penalty", [(0, 60), (1, 38), (49, 27), (50, 27), (100, 22), (199, 15), (200, 15), (300, 9), (499, 0), (500, 0)])
def test_word_penalty(spark, n, penalty):
    assert one(spark, n, quality.word_penalty, "bigint") == penalty


W = lambda n: " ".join(["word"] * n)


@pytest.mark.parametrize(
    "markdown, title, method, words, headings, richness, n_warnings, score, grade",
    [
        ("", "x", "firecrawl", 0, 0, 0, 1, 40, "poor"), ("", "x", "static", 0, 0, 0, 2, 35, "poor"), (W(50), "x", "firecrawl", 50, 0, 0, 1, 73, "fair"), (W(50), "x", "static", 50, 0, 0, 2, 68, "fair"),
        (W(600), "[Error] x", "firecrawl", 600, 0, 0, 1, 65, "fair"), (W(600), "x", "static", 600, 0, 0, 1, 85, "good"),
        ("# A\n\n## B\n\n### C\n\n- item\n\n|a|b|\n|---|---|\n" + W(600), "x", "firecrawl", 610, 3, 4, 0, 100, "excellent"),
        ("\n".join(f"[go to page {i}](ui)" for i in range(100)), "x", "firecrawl", 400, 0, 0, 2, 31, "poor"), ("\n".join(["same boilerplate line here now"] * 60), "x", "static", 300, 0, 0, 2, 61, "fair"),
    ],
)
def test_completeness(spark, markdown, title, method, words, headings, richness, n_warnings, score, grade):
    df = spark.createDataFrame([(markdown, title, method)], "markdown string, title string, fetch_method string")
    r = quality_columns(df).first()
    assert (r.words, r.headings, r.richness, len(r.warnings), r.score, r.grade) == (words, headings, richness, n_warnings, score, grade)


@pytest.mark.parametrize(
    "url, discovered, persisted, slug, domain",
    [
        ("https://x.com/a/#t", "https://x.com/a", "https://x.com/a", "a", "x-com"), ("https://x.com/", "https://x.com", "https://x.com/", "index", "x-com"),
        ("https://X.com/en/474.html", "https://x.com/en/474.html", "https://x.com/en/474.html", "en-474html", "x-com"), ("https://x.com/a_b/c-d?p=1", "https://x.com/a_b/c-d?p=1", "https://x.com/a_b/c-d?p=1", "a_b-c-d", "x-com"),
        ("https://x.com/für x", "https://x.com/f%C3%BCr%20x", "https://x.com/f%C3%BCr%20x", "fC3BCr20x", "x-com"), ("https://x.com:443/a/../b", "https://x.com/b", "https://x.com/b", "b", "x-com"), ("http://X.com:80", "http://x.com", "http://x.com/", "index", "x-com"),
        ("http://x.com:443/./a/./", "http://x.com:443/a", "http://x.com:443/a", "a", "x-com"), ("https://x.com/../../a/b/..?q=/../", "https://x.com/a/?q=/..", "https://x.com/a/?q=/..", "a", "x-com"), ("https://x.com//a//", "https://x.com//a/", "https://x.com//a/", "-a-", "x-com"),
        ("https://x.com/a/%2E%2e/b/%2e", "https://x.com/b", "https://x.com/b", "b", "x-com"), ("https://x.com//", "https://x.com/", "https://x.com/", "index", "x-com"), ("nonsense", None, "nonsense", "page", None), (None, None, None, "page", None), ("https://x.com/?a/", "https://x.com/?a", "https://x.com/?a/", "index", "x-com"),
    ],
)
def test_urls(spark, url, discovered, persisted, slug, domain):
    df = spark.createDataFrame([(url,)], "u string")
    r = df.select(urls.normalize_discovered("u").alias("d"), urls.normalize_persisted("u").alias("p"), urls.slug("u").alias("s"), urls.domain_key("u").alias("k")).first()
    if url != "nonsense":
        assert r.k == domain
    assert (r.d, r.p, r.s) == (discovered, persisted, slug)


def test_tags_and_patterns(spark):
    assert one(spark, "https://x.com/en/Guides/gpu.html", urls.tags) == ["guides", "gpu"]
    assert one(spark, None, urls.tags) == []
    assert one(spark, "https://x.com/a/tag/b", lambda u: urls.matches_patterns(u, "", "/tag/")) is False
    assert one(spark, "https://x.com/doc/b", lambda u: urls.matches_patterns(u, "/doc/, /wiki/", "")) is True
    assert one(spark, "https://a.com.evil.net/x", lambda u: urls.same_origin(u, F.lit("https://a.com"))) is True


@pytest.mark.parametrize(
    "line, gone",
    [("[Docs](u) are here", True), ("OK", True), ("Show models", True), ("Starting at $ 1,200", True), ("Panel 3", True), ("* 12", True), ("Mid-Tower (1)Tower/4U (2)1U (21)", True), ("plain words stay", False), ("", False), ("* item", False)],
)
def test_noise_lines(spark, line, gone):
    assert (one(spark, f"keep this\n{line}\nand this", T.remove_noise_lines) == "keep this\nand this") is gone


def test_cleaner_steps(spark):
    assert one(spark, "# Title\ntitle\nx y z", T.remove_noise_lines) == "# Title\nx y z"
    assert one(spark, "a\n## Filters x\nfoo\n## B", T.remove_trailing_ui_sections) == "a\nfoo\n## B"
    assert one(spark, "## Intro\na\n## INTRO\nb\n## C", T.dedupe_sections) == "## Intro\na\n\n## C"
    p39, p40 = "a" * 39, "b" * 40
    assert one(spark, "\n\n".join([p39, p39, p40, p40.upper()]), T.dedupe_paragraphs) == "\n\n".join([p39, p39, p40])
    assert one(spark, "#### deep\n##### x", T.flatten_subheadings) == "deep\nx"
    assert one(spark, "a b​c ‘d’ “e” – f\r\n", T.normalize_encoding) == "a bc 'd' \"e\" - f\n"


def test_long_inputs_do_not_break_the_regex_engine(spark):
    facets = "x (1)" * 5000
    assert one(spark, f"keep\n{facets}", T.remove_noise_lines) == "keep"
    long = "\n".join(f"line {i} of many, quite long enough to count" for i in range(5000))
    assert one(spark, long, T.dedupe_paragraphs) == long
