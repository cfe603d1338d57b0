"""Operators on small tables, against hand-made results or a plain restatement."""

import random

from pyspark.sql import functions as F

from corpusmill.functions.urls import matches_patterns
from corpusmill.operators import corpus, discovery, documents, pdf
from corpusmill.operators.cleaner import clean, format_product_sections, normalize_tables, remove_broken_links, remove_naming_lists, remove_resource_cards, resource_entries
from corpusmill.operators.sections import section_rows
from corpusmill.sources import html as H
from corpusmill.sources.html import html_to_markdown
from corpusmill.sources.texts import nested_sitemaps, robots_sitemaps, sitemap_urls


def test_sections_leak_forward(spark):
    body = "pre one two\n# A\na b c d e\n## Filters\nleak1 leak2\n## B\nx y z w v u\n#### deep\nq"
    rows = section_rows(spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, body string"), "id", "body").collect()
    assert [(r.id, r.section_no, r.heading, r.level, r.word_count) for r in rows] == [(1, 0, "A", 1, 8), (1, 1, "B", 2, 9)]


def test_upsert_against_the_sequence(spark):
    rng = random.Random(7)
    rows = [(i, f"d{rng.randrange(2)}", f"s{rng.randrange(6)}", f"https://x.com/{rng.randrange(6)}", None, None) for i in range(120)]
    df = spark.createDataFrame([(*r[:4], "t", 1, 1) for r in rows], "seq int, domain string, slug string, url string, title string, word_count int, token_estimate int")
    want = []
    for r in rows:
        want = [p for p in want if p[1] != r[1] or (p[2] != r[2] and p[3] != r[3])] + [r]
    assert sorted(r.seq for r in corpus.survivors(df).collect()) == sorted(r[0] for r in want)
    assert corpus.survivors(df.limit(0)).count() == 0


def test_index_lines_number_across_blocks(spark):
    df = spark.range(0, 1000).select(F.lit("d").alias("domain"), (F.col("id") * 7).alias("seq"))
    got = [(r.seq, r.row_no) for r in corpus.number_rows(df, "domain", "seq", block=100).collect()]
    assert sorted(got) == [(i * 7, i + 1) for i in range(1000)]


def test_resume_and_preview_by_domain(spark):
    session = spark.createDataFrame(
        [(1, "https://x.com/a/", "pending", True, "a"), (2, "https://x.com/b", "error", True, "b"), (3, "https://x.com/none", "scraping", True, None), (4, "https://x.com/", "pending", True, "index"), (5, "nonsense", "pending", True, "b"), (6, None, None, None, None)],
        "page_id int, url string, status string, selected boolean, slug string",
    )
    saved = spark.createDataFrame(
        [(1, "x-com", "https://x.com/a", "zz", "old"), (2, "x-com", "https://x.com/a", "zz", "new"), (3, "x-com", "https://x.com/q", "b", "by slug"), (4, None, None, None, None), (5, "y-com", "https://y.com/", "index", "another host"), (0, "x-com", "https://x.com/w", "a", "slug of 1")],
        "seq int, domain string, url string, slug string, title string",
    )
    got = {r.page_id: (r.matched_by, r.status, r.selected, r.saved_title) for r in corpus.resume(session, saved).collect()}
    assert got == {1: ("url", "done", False, "new"), 2: ("slug", "done", False, "by slug"), 3: (None, "pending", True, None), 4: (None, "pending", True, None), 5: (None, "pending", True, None), 6: (None, None, None, None)}
    assert {r.page_id: r.saved_title for r in corpus.preview(session, saved).collect()} == {1: "old", 2: "by slug", 3: None, 4: None, 5: None, 6: None}


def test_progress_and_eta(spark):
    rows = spark.createDataFrame([("done", True), ("done", False), ("error", None), (None, None)], "status string, selected boolean")
    r = corpus.progress(rows).first()
    assert (r.n_pages, r.n_selected, r.n_done, r.n_error, r.n_remaining, r.progress) == (4, 1, 2, 1, 2, 300)
    clock = rows.select("*", F.lit(1).alias("x"))
    pace = corpus.pages_per_second(clock, F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(6))).first()
    assert (pace.rate, pace.seconds_left) == (0.5, 0.0)
    assert corpus.pages_per_second(clock.where("status IS NULL"), F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(6))).first().seconds_left is None
    eta = spark.createDataFrame([(0.0,), (12.2,), (125.0,), (None,)], "s double").select(corpus.eta_text(F.col("s")).alias("t"))
    assert [x.t for x in eta.collect()] == ["—", "13s", "2m 5s", "—"]


def test_patch_keeps_what_the_patch_lacks(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "id int, x string, y string")
    patches = spark.createDataFrame([(1, 1, "n", None), (1, 2, None, "m"), (9, 1, "q", "q")], "id int, seq int, x string, y string")
    assert {tuple(r) for r in corpus.patch(rows, patches, "id", ["x", "y"], "seq").collect()} == {(1, "a", "m"), (2, "c", None)}


def test_crawl_prunes_and_ends(spark):
    e = [("d", "https://d.x/", "/a"), ("d", "https://d.x/a", "/b"), ("d", "https://d.x/b", "/a"), ("d", "https://d.x/b", "/c"), ("d", "https://d.x/c", "/too-far"), ("d", "https://d.x/a", "/tag/hub"), ("d", "https://d.x/tag/hub", "/only-there"), ("d", "https://d.x/a", "#x"), ("d", "https://d.x/a", "mailto:q@d.x"), ("d", None, "/z"), ("d", "https://d.x/a", None), ("d", "https://d.x/a", "https://other.y/")]
    graph = discovery.links(spark.createDataFrame(e, "domain string, src string, href string"))
    seeds = spark.createDataFrame([("d", "https://d.x")], "domain string, url string")
    got = {(r.url, r.depth) for r in discovery.crawl(graph, seeds, "domain", 3).collect()}
    assert got == {("https://d.x", 0), ("https://d.x/a", 1), ("https://d.x/b", 2), ("https://d.x/c", 3)}
    assert matches_patterns("target", "", discovery.DEFAULT_EXCLUDES) is not None


def test_sitemaps_and_robots(spark):
    docs = spark.createDataFrame(
        [("r", '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>s1</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>'), ("s1", "<urlset><url><loc> https://x/1?a=1&amp;b=2 </loc><lastmod>2024</lastmod></url><url><lastmod>2023</lastmod></url></urlset>"), ("bad", "nothing"), ("none", None)],
        "url string, xml string",
    )
    assert {(r.url, r.kind, r.loc) for r in sitemap_urls(docs).collect()} == {("r", "index", "s1"), ("r", "index", "r"), ("s1", "page", "https://x/1?a=1&b=2")}
    roots = spark.createDataFrame([("r",)], "url string")
    assert [(r.root, r.loc) for r in nested_sitemaps(docs, roots).collect()] == [("r", "https://x/1?a=1&b=2")]
    robots = spark.createDataFrame([("x", "User-agent: *\r\nSITEMAP: https://x/s.xml \nsitemap:\nSitemap: https://x/s.xml")], "url string, text string")
    assert [r.sitemap for r in robots_sitemaps(robots).orderBy("seq").collect()] == ["https://x/s.xml", "https://x/s.xml"]
    ranked = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 1, "c")], "domain string, rank int, url string")
    assert {r.url for r in discovery.choose(ranked, "domain", "rank").collect()} == {"a", "c"}


def test_cleaner_islands():
    card = "### White paper on fans\ntext\n[Read the white paper](https://x/w.pdf)"
    assert resource_entries("a\nResources\n" + card + "\n### No link\nx") == [{"title": "White paper on fans", "url": "https://x/w.pdf", "type": "White Paper"}]
    assert remove_resource_cards("a\nResources\n" + card + "\nrest of it\n## B\nb") == "a\n## Resources\n\nrest of it\n\n## B\nb"
    assert resource_entries("### A\nsee [Read the white paper](u) inline\n### B\n[Download datasheet](https://x.com/d)") == [{"title": "B", "url": "https://x.com/d", "type": "Datasheet"}]
    assert [e["type"] for e in resource_entries("### A\nfile a.pdf\n[Read more](u)\n### B\n[Read more](v.pdf?x)\n### C\nplain")] == ["Document", "PDF"]
    assert resource_entries("no card") == [] and resource_entries("") == []
    assert remove_resource_cards("a\nResources\n### No link\nx\n" + card + "  \n\nrest") == "a\n## Resources\n\nrest\n"
    assert remove_resource_cards("a\n## Resources\n" + card) == "a"
    assert remove_naming_lists("x\nNaming Conventions\n\n- [A](/Product_Naming_Convention_a)\n- [B](/Product_Naming_Convention_b)\ny") == "x\n\ny"
    assert format_product_sections("### P\n*[Image: x]*\nintro\n[link](u)\n* one\nmore\n* two\n## Q") == "### P\n\nintro\nmore\n\n* one\n* two\n\n## Q"
    assert normalize_tables("|a|b|c|\n|---|---|---|\n|1|2|3|\n|1|2|3|\n|x|\n|a|b|c|\n|---|---|---|\n|4|5|6|") == "|a|b|c|\n|---|---|---|\n|1|2|3|\n|4|5|6|"
    assert remove_broken_links("a [\n\n](x) b [ok](y)") == "a b [ok](y)"


def test_cleaner_survives_long_pages(spark):
    long = "### P\n" + "\n".join(f"* line {i}" for i in range(5000)) + "\n" + "[\n*[Image: x]*\n](u)" * 2000
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], "id int, markdown string")
    got = {r.id: r.body for r in clean(df).collect()}
    assert got[1].startswith("### P") and got[2] is None and got[3] == ""


def test_html_to_markdown():
    assert html_to_markdown("<h1>T</h1><p>a <b>b</b> <i>c</i><p>d<ul><li>x<li>y</ul><pre>k\n l</pre>") == "# T\n\na **b** *c*\n\nd\n\n- x\n- y\n\n```\nk\n l\n```"
    assert html_to_markdown("<a href='/p'>go</a> <a href='#x'>Close</a><img src='i.png' alt='A'><script>no()</script>") == "[go](/p)\n\n![A](i.png)"
    assert html_to_markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1<td>2</table>") == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert html_to_markdown("<p>a*b_c [x]</p><p>1. x</p><p># x</p><p>- x</p><p>&gt; q</p><ol start='3'><li>a<li>b</ol><p><code>a*b</code></p>") == "a\\*b\\_c \\[x\\]\n\n1\\. x\n\n\\# x\n\n\\- x\n\n\\> q\n\n3. a\n4. b\n\n`a*b`"
    assert html_to_markdown("<p>a*b [x]</p>", escape=False) == "a*b [x]"
    assert html_to_markdown("") == "" and html_to_markdown("<p>unclosed <div>x") == "unclosed\n\nx"


def test_heads(spark):
    html = '<title> T </title><meta name="description" content="A description long enough to count"><meta property="article:modified_time" content="2024-05-06T23:30:00-05:00"><a href="/a">x</a><a href="mailto:q">m</a>'
    df = H.parse(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), ["id"], markdown=False)
    rows = {r.id: r for r in df.select("id", H.page_title(F.lit(None), F.col("page"), F.lit("u")).alias("t"), H.meta_description(F.col("page")).alias("d"), H.last_updated(F.col("page")).alias("l"), H.anchors(F.col("page")).alias("a")).collect()}
    assert (rows[1].t, rows[1].d, rows[1].l, rows[1].a) == ("T", "A description long enough to count", "2024-05-07", ["/a"])
    assert (rows[2].t, rows[2].d, rows[2].l, rows[2].a) == ("u", None, None, None)


def test_dates(spark):
    values = ["2024-05-06", "2024-05-06T01:02:03Z", "Tue, 07 May 2024 10:00:00 GMT", "7 May 2024", "May 7, 2024", "2024/05/07", "last week", "", None, "2024-13-45", "06.05.2024"]
    got = [r.d for r in spark.createDataFrame([(v,) for v in values], "v string").select(H.parse_date(F.col("v")).alias("d")).collect()]
    assert got == ["2024-05-06", "2024-05-06", "2024-05-07", "2024-05-07", "2024-05-07", "2024-05-07", None, None, None, None, None]


def test_pdf_links_and_names(spark):
    html = '<a href="/viewer?url=/d/a.pdf">First label</a><a href="https://x.com/d/a.pdf#p2">again</a><link href="/q/My%20File.pdf"><a href="/r/doc.pdf">d1</a><a href="/s/doc.pdf">d2</a><a href="/s/doc-2.pdf">d3</a><a href="no">n</a>'
    parsed = H.parse(spark.createDataFrame([("https://x.com/p", html), (None, html)], "page_url string, html string"), ["page_url"], markdown=False)
    links = pdf.pdf_links(parsed, "page_url").where("page_url IS NOT NULL")
    rows = {r.pdf_url: (r.label, r.slug) for r in pdf.unique_slugs(links).collect()}
    assert rows["https://x.com/d/a.pdf"] == ("First label", "a")
    assert rows["https://x.com/q/My%20File.pdf"][1] == "My-20File"
    assert sorted(v[1] for k, v in rows.items() if "doc" in k) == ["doc", "doc-2", "doc-3"]
    texts = spark.createDataFrame([("https://x.com/d/a.pdf", "one\r\n\r\n\r\n\r\ntwo lines", 3, None), ("https://x.com/r/doc.pdf", "", 1, None)], "pdf_url string, text string, page_count bigint, error string")
    made = {r.pdf_url: r for r in pdf.extracts(links, texts).collect()}
    assert made["https://x.com/d/a.pdf"].body == "one\n\ntwo lines" and made["https://x.com/d/a.pdf"].page_count == 3
    assert made["https://x.com/r/doc.pdf"].error and made["https://x.com/r/doc.pdf"].body == "" and made["https://x.com/s/doc.pdf"].error == "PDF was not fetched"
    got = pdf.related(pdf.extracts(links, texts)).first()
    assert [x.slug for x in got.related_pdfs] == ["a"]
    files = spark.createDataFrame([("u", bytearray(b"%PDF-1.4 x")), ("v", bytearray(b"nope")), ("w", None)], "pdf_url string, content binary")
    read = {r.pdf_url: r for r in pdf.extract_text(files, lambda b: (f"{len(b)} bytes", 1)).collect()}
    assert read["u"].text == "10 bytes" and read["v"].error and read["w"].error


def test_documents_round_trip(spark):
    rows = [(1, "A: 'quoted' | Site", "https://x.com/a", "# A\n\nSome text that is long enough to serve as the description.\n\n## B\none two three four five", "2024-01-02T03:04:05Z", None, None)]
    df = spark.createDataFrame(rows, "id int, title string, url string, body string, crawled_at string, description string, last_updated string")
    made = documents.page_metadata(df)
    files = documents.with_documents(made, documents.frontmatter(made), made["body"])
    raw = files.select(F.col("id").cast("string").alias("slug"), F.col("document").alias("raw"))
    extra = spark.createDataFrame([("bad", "---\n: [\n---\nx"), ("none", "plain"), ("nourl", "---\ntitle: x\n---\n"), ("old", "---\nurl: u\nscraped_at: then\ncompleteness_score: high\n---\n"), ("null", None)], "slug string, raw string")
    got = {r.slug: r for r in documents.parse_documents(raw.union(extra), as_of="now").collect()}
    assert set(got) == {"1", "old"}
    m = made.first()
    assert (got["1"].title, got["1"].content_hash, got["1"].content_words, got["1"].tags, got["1"].section_count) == (m.title, m.content_hash, m.word_count, m.tags, len(m.chunk_sections))
    assert (got["old"].title, got["old"].scraped_at, got["old"].completeness_score) == ("old", "then", None)


def test_corpus_files_round_trip(spark, tmp_path):
    import pytest

    from corpusmill.sources import corpus_files

    docs = spark.createDataFrame([("x-com", "a", "---\nurl: https://x.com/a\ntitle: A\n---\nbody"), ("x-com", "b", "---\nurl: https://x.com/b\n---\n"), ("x-com", "gone", "no frontmatter"), ("..", "evil", "---\nurl: u\n---\n"), ("x-com", "../up", "---\nurl: u\n---\n")], "domain string, slug string, document string")
    with pytest.raises(ValueError):
        corpus_files.write_pages(docs, str(tmp_path))
    corpus_files.write_pages(docs.where("slug IN ('a', 'b', 'gone')"), str(tmp_path))
    entries = spark.createDataFrame([("x-com", 1, "a", "https://x.com/a", "é", None, None, 3, 5, 1, ["t"], "active", None), ("x-com", 2, "missing", "https://x.com/m", "B", None, None, None, None, None, None, "active", None)], corpus_files.ENTRY)
    corpus_files.write_manifests(entries, str(tmp_path), "2024-01-02T00:00:00Z")
    assert [r.slug for r in corpus_files.load(spark, str(tmp_path)).collect()] == ["a"]
    assert sorted(r.slug for r in corpus_files.load(spark, str(tmp_path), from_manifest=False).collect()) == ["a", "b"]
    lines = [r.line for r in corpus_files.index_file(entries, "2024-01-02T00:00:00Z").orderBy("line_no").collect()]
    assert lines[0] == "---" and lines[-2:] == ["1. é — https://x.com/a (~5 tokens)", "2. B — https://x.com/m"] and "*Generated: 2024-01-02 | 2 documents | ~5 tokens*" in lines
    corpus_files.write_index(entries, str(tmp_path), "2024-01-02T00:00:00Z")
    assert [r.value for r in spark.read.text(str(tmp_path / "index" / "domain=x-com")).collect()] == lines
    with pytest.raises(ValueError):
        corpus_files.safe_name("../x")


def test_fetch_retries_and_reports(spark):
    from corpusmill.config import Settings, settings
    from corpusmill.sources.fetch import fetch, history

    def snapshot(url, given):
        if url.endswith("/bad"):
            raise OSError("refused")
        return {"html": "<h1>x</h1>", "fetch_method": "static"}

    found = spark.createDataFrame([("https://x.com/ok",), ("https://x.com/bad",), ("https://x.com/tag/x",), ("relative",), (None,)], "url string")
    got = {r.url: r for r in fetch(found, Settings(request_delay_ms=0, max_retries=2), snapshot, lambda s: None).collect()}
    assert set(got) == {"https://x.com/ok", "https://x.com/bad"}
    assert got["https://x.com/ok"].final_url == "https://x.com/ok" and (got["https://x.com/bad"].attempts, got["https://x.com/bad"].error) == (3, "refused")
    s = settings({"max_concurrency": 99, "scrape_timeout_ms": 1, "wait_for_ms": None, "post_interaction_delay_ms": 7, "unknown": 1})
    assert (s.max_concurrency, s.scrape_timeout_ms, s.wait_for_ms) == (20, 5_000, 7) and settings(None) == Settings()
    runs = spark.createDataFrame([("d", f"2024-01-{k:02d}", k % 2) for k in range(1, 9)], "domain string, scraped_at string, success_count int")
    assert [r.scraped_at for r in history(runs, 2).collect()] == ["2024-01-07", "2024-01-05"]


def test_streamed_manifest_equals_the_batch(spark, tmp_path):
    from corpusmill.streaming.manifest import keep_manifest, read_entries, read_state

    rng = random.Random(2)
    rows = [(i, f"d{rng.randrange(3)}", f"s{rng.randrange(5)}", f"https://x.com/{rng.randrange(5)}") for i in range(50)] + [(50, None, "s", None)]
    schema = "seq int, domain string, slug string, url string"
    for k in range(6):
        spark.createDataFrame(rows[k * 9 : k * 9 + 9], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kind = spark.createDataFrame([], schema).schema
    query = keep_manifest(read_entries(spark, str(tmp_path / "in"), kind, 1), str(tmp_path / "state"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(r.seq for r in read_state(spark, str(tmp_path / "state"), 5, kind).collect())
    assert got == sorted(r.seq for r in corpus.survivors(spark.createDataFrame(rows, schema)).collect())
    for bucket in (tmp_path / "state" / "state").glob("bucket=*"):
        assert len(list(bucket.glob("version=*"))) <= 2


def test_discovery_falls_back(spark):
    a, b, c, d = "https://a.com", "https://b.com", "https://c.com", "https://d.com"
    page = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    docs = spark.createDataFrame(
        [(f"{a}/sitemap.xml", "nothing"), (f"{a}/sitemap_index.xml", f"<sitemapindex><sitemap><loc>{a}/deep.xml</loc></sitemap></sitemapindex>"), (f"{a}/deep.xml", page(f"{a}/1/", f"{a}/tag/x", "https://other.com/2")), (f"{a}/sitemap1.xml", page(f"{a}/later"))]
        + [(f"{b}/robots.txt", f"User-agent: *\nSitemap: {b}/own.xml"), (f"{b}/own.xml", page(f"{b}/3#x")), (f"{c}/sitemap.xml", None)],
        "url string, text string",
    )
    edges = spark.createDataFrame([(x, x, h) for x in (a, c) for h in ("/crawled", "/tag/no", "mailto:x")], "origin string, src string, href string")
    origins = spark.createDataFrame([(x,) for x in (a, b, c, d, None)], "origin string")
    graph = discovery.links(edges, by="origin")
    got = {tuple(r) for r in discovery.discover(origins, docs, graph).collect()}
    assert got == {(a, f"{a}/1", "sitemap"), (b, f"{b}/3", "sitemap"), (c, c, "crawl"), (c, f"{c}/crawled", "crawl"), (d, d, "crawl")}
    assert {r.source for r in discovery.discover(origins, docs, graph, fallback_crawl=False).collect()} == {"sitemap"}


def test_fetchers(spark):
    from corpusmill.config import Settings
    from corpusmill.sources.fetch import dispatch, fetch_texts

    def static(url, given):
        if "missing" in url:
            raise OSError("404")
        return {"html": f"<p>{url}</p>", "final_url": url, "fetch_method": "static"}

    def rendered(url, given):
        if url.endswith("down"):
            raise OSError("down")
        return {"markdown": "# R" if url.endswith("ok") else "", "extracted_title": "T", "final_url": None}

    either = dispatch(rendered, static)
    assert either("https://x.com/ok", {}) == {"final_url": "https://x.com/ok", "markdown": "# R", "extracted_title": "T", "fetch_method": "firecrawl"}
    assert [either(f"https://x.com/{k}", {})["fetch_method"] for k in ("down", "empty")] == ["static", "static"] and dispatch(None, static)("u", {})["fetch_method"] == "static"
    wanted = spark.createDataFrame([("https://x.com/a",), ("https://x.com/a",), ("https://x.com/missing",), ("no url",), (None,)], "url string")
    assert {tuple(r) for r in fetch_texts(wanted, Settings(), static).collect()} == {("https://x.com/a", "<p>https://x.com/a</p>"), ("https://x.com/missing", None)}


def test_pdfs_of_pages(spark):
    links = spark.createDataFrame([("https://x.com/p", 0, "a.pdf", "A fine label", "https://x.com/a.pdf"), ("https://x.com/p", 1, "b.pdf", "B", "https://x.com/b.pdf")], "page_url string, ord int, href string, label string, pdf_url string")
    texts = spark.createDataFrame([("https://x.com/a.pdf", "## Head\nFive words are in here now.", 2, None)], "pdf_url string, text string, page_count bigint, error string")
    pages = spark.createDataFrame([("https://x.com/p", "body\n"), ("https://x.com/q", "other"), (None, None)], "url string, body string")
    got = {r.url: r for r in pdf.with_pdfs(pages, links, texts, in_body=True).collect()}
    assert got["https://x.com/p"].body == "body\n## Related PDF extracts\n\n- **A fine label** — https://x.com/a.pdf\n" and [x.slug for x in got["https://x.com/p"].related_pdfs] == ["a"]
    assert got["https://x.com/q"].related_pdfs is None and got["https://x.com/q"].body == "other"
    assert {r.related_pdfs for r in pdf.with_pdfs(pages, links, texts, download=False).collect()} == {None}
    named = pdf.extracts(links, texts).withColumn("source_page_title", F.lit("P")).withColumn("crawled_at", F.lit("2024-01-02T03:04:05Z"))
    made = pdf.documents_of(named).collect()
    assert len(made) == 1 and "document_type: pdf-extract" in made[0].document and "\n\n## Document\n\n## Head" in made[0].document and "Extracted text from PDF linked on P." in made[0].document
