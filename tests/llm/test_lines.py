"""Problems 1, 2, 3 and 5 on small pages: rules, repetition, edge cases."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import blocks, counting, main_text, repeated_lines, residue, spam

PROSE = "The storage controller waits for the slowest member of the group, and every node of the cluster keeps the older configuration until it is restarted."
SCHEMA = "page_id bigint, markdown string, title string, host string, late boolean"


def pages(spark, rows):
    return spark.createDataFrame([(i, m, t, h, late) for i, m, t, h, late in rows], SCHEMA)


def site(spark, extra=()):
    notice = "We use small files to remember what you chose on this site."
    rows = [(k, f"[Home](/) | [News](/n)\n\n# Page {k}\n\n{PROSE} The {chr(97 + k) * 4} part of it is another one.\n\n{notice}\nReject all\n\nLast updated {k} days ago", f"Page {k}", "a.example", k >= 8) for k in range(12)]
    return pages(spark, rows + list(extra))


NULLS = [(100, None, None, "a.example", False), (101, "", "", "a.example", False), (102, "\n \n", None, "", False)]


def test_keys_agree_between_spark_and_python(spark):
    lines = ["Hello 12 Wörld, a line  with 3\tblanks that is longer than thirty-two bytes", "x", "ΑΒΓ 007"]
    df = spark.createDataFrame([("h.example", "\n".join(lines))], "host string, markdown string")
    got = df.select(F.explode(blocks.line_hashes(F.col("host"), F.col("markdown"))).alias("x")).select("x.*").collect()
    assert [r.key for r in got] == [counting.python_key(x, counting.host_seed("h.example")) for x in lines]
    assert [r.form for r in got] == [counting.python_key(x) for x in lines]


def test_furniture_lines(spark):
    got = {(r.page_id, r.line_no): r.article for r in blocks.labelled_lines(site(spark, NULLS)).collect()}
    assert {k[0] for k in got} == set(range(12))
    assert [got[3, n] for n in (0, 2, 4, 6, 7, 9)] == [False, True, True, False, False, False]


def test_both_ways_of_handing_over_repeated_lines_agree(spark):
    rows = lambda most: sorted(map(tuple, blocks.labelled_lines(site(spark, NULLS), most).collect()))
    assert rows(0) == rows(10_000)


def test_related_lists_downloads_and_code():
    md = "# T\n\n" + PROSE + "\n\n### Manuals\n- [One](/files/one.pdf)\n- [Two](/files/two.pdf)\n\n```\n# not a heading\n[x](/y)\n```\n\n## Read on\n- [A](/a)\n- [B](/b)"
    page = blocks.label_lines(md, lambda line: "")
    assert dict(zip(page.text, page.label, strict=True)) == {"# T": 1, PROSE: 1, "### Manuals": 1, "- [One](/files/one.pdf)": 1, "- [Two](/files/two.pdf)": 1, "```": 1, "# not a heading": 1, "[x](/y)": 1, "## Read on": 0, "- [A](/a)": 0, "- [B](/b)": 0}


def test_short_blocks_inherit():
    page = blocks.label_lines(f"Menu\nNews\n\n# T\n\n{PROSE}\n\nShort label\n\n{PROSE}\n\nImprint", lambda line: "")
    assert [x for x, label in zip(page.text, page.label, strict=True) if not label] == ["Menu", "News", "Imprint"]


def test_stuffed_pages(spark):
    keywords = ["cheap rack server", "server sale", "low cost nas", "buy gpu server"]
    soup = ", ".join(keywords[(i * i) % 4] for i in range(200))
    links = "\n".join(f"- [{keywords[i % 4]} {i}](https://s{i}.test/x)" for i in range(40))
    spoken = " ".join("Our server sale is the best server sale for every server sale buyer." for _ in range(20))
    extra = [(20, soup, "t", "b.example", False), (21, links, "t", "b.example", False), (22, f"# H\n\n{spoken}", "t", "b.example", False), (23, f"{PROSE}\n\n{PROSE}\n\n" + ", ".join(keywords), "t", "b.example", False), *NULLS]
    got = {r.page_id: r.spam_share for r in spam.spam_pages(site(spark, extra)).collect()}
    assert {k for k, v in got.items() if v > 0.5} == {20, 21, 22}
    assert 100 not in got and got[101] == got[102] == 0.0
    assert spam.spam_pages(site(spark).limit(0)).count() == 0


def test_pmi_counts_cover_everything(spark):
    counts = {(r.a, r.b): r.n for r in counting.count_corpus(pages(spark, [(1, "a b a\na b", None, "h", False), (2, "a b", None, "h", False), NULLS[0]]), of_lines=False).collect()}
    assert counts == {("a", None): 4, ("b", None): 3, ("a", "b"): 3, ("b", "a"): 1}


@given(st.lists(st.text(alphabet="ab ²Ⅳé日゙か_1.\n\t\u3000()[]", max_size=30), max_size=4))
@settings(max_examples=60, deadline=None)
def test_arrow_words_are_the_words_of_the_lines(texts):
    texts = [*texts, "see https://a.b/c?d e [x y](/z 1) Ende"]
    single, both = Counter(), Counter()
    for line in "\n".join(texts).lower().split("\n"):
        w = counting.WORD.findall(counting.URL.sub(" ", counting._TARGET.sub("] ", line)))
        single.update((x, None) for x in w)
        both.update(zip(w, w[1:], strict=False))
    counted = counting._Words()
    for t in texts:
        counted.add([t.lower()])
    assert {(r["a"], r["b"]): r["n"] for r in counted.batch().to_pylist()} == dict(single | both)


def test_the_counts_decide(spark, monkeypatch):
    """With one PMI for every pair no listing and no repeated collocation is found."""
    soup = ", ".join(["cheap rack server", "server sale", "low cost nas", "buy gpu server"][(i * i) % 4] for i in range(200))
    spoken = " ".join("Our server sale is the best server sale for every server sale buyer." for _ in range(20))
    df = site(spark, [(20, soup, "t", "b.example", False), (22, f"# H\n\n{spoken}", "t", "b.example", False)])
    stuffed = lambda: {r.page_id for r in spam.spam_pages(df, exact=False).where(spam.F.col("spam_share") > 0.5).collect()}
    assert stuffed() == {20, 22}
    monkeypatch.setattr(spam, "coherence", lambda n_words, n_pairs: spam.F.sum("k") * 99.0)
    assert stuffed() == set()


def test_coherence_by_hand(spark):
    rows = [("x", 2, 10, 2, 2, 2, 12, 20, 30), ("x", 5, 10, 5, 5, 5, 5, 9, None), ("x", 1, 10, 1, 1, 1, None, 4, 4)]
    df = spark.createDataFrame(rows, "g string, k bigint, n_pairs bigint, own bigint, own_a bigint, own_b bigint, n bigint, n_a bigint, n_b bigint")
    normal = lambda n, a, b: np.log((n + 0.5) / (a * b * 1000 / 2000**2 + 0.5)) / np.log(1001 / (n + 0.5))
    want = 2 * normal(10, 18, 28) + normal(0, 4, 0) + normal(0, 3, 3)  # the second pair repeats excessively
    assert abs(df.groupBy("g").agg(spam.coherence(2000, 1000).alias("s")).first().s - want) < 1e-9


def test_shuffled_words_are_salad_however_rare(spark):
    # 20 000 words of 1/20 000 each, every one mostly followed by the next: in random order they mean nothing.
    letters = lambda k: F.concat(F.lit("w"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    word = lambda k: "w" + "".join("abcdefghij"[int(c)] for c in str(k % 20_000))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("key", "bigint"), ("form", "bigint"))]
    k = F.col("id")
    single = spark.range(20_000).select(*nothing, letters(k).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(200).cast("bigint").alias("n"))
    both = spark.range(20_000).select(*nothing, letters(k).alias("a"), letters((k + 1) % 20_000).alias("b"), F.lit(150).cast("bigint").alias("n"))
    order = np.random.default_rng(1).permutation(20_000)
    rows = [(k, ", ".join(map(word, order[60 * k : 60 * k + 60])), None, "h.example", False) for k in range(5)]
    rows += [(10 + k, ", ".join(map(word, range(70 * k, 70 * k + 60))), None, "h.example", False) for k in range(5)]
    df = pages(spark, rows)
    counts = counting.count_corpus(df, of_words=False).unionByName(single).unionByName(both)
    want = {k: 1.0 for k in range(5)} | {10 + k: 0.0 for k in range(5)}
    assert {r.page_id: r.spam_share for r in spam.spam_pages(df, counts).collect()} == want
    assert {r.page_id: r.spam_share for r in spam.spam_pages(df, counts, exact=False).collect()} == want


def test_a_page_does_not_speak_for_itself(spark):
    rows = [(k, f"{PROSE} The {chr(97 + k) * 4} part of it is another one.", None, f"h{k}.example", False) for k in range(12)]
    alone = " ".join(f"q{chr(97 + k)}{chr(97 + k * 7 % 26)}x" for k in range(25))
    got = {r.page_id: r.spam_share for r in spam.spam_pages(pages(spark, [*rows, (20, alone, None, "s.example", False), (20, PROSE, None, "s.example", False)])).collect() if r.page_id == 20 and r.spam_share > 0}
    assert got == {20: 1.0}


def test_residue_and_notices(spark):
    bad = [(20 + k, f"# 404 Not Found\n\nThe page {k} you are looking for could not be found on this server.", "404", f"h{k}.example", False) for k in range(6)]
    bad += [(40 + k, f"# P\n\n{PROSE} Item {k}.\n\nDear {{{{ customer.name }}}}, thank you for order {k}.", "P", f"g{k}.example", False) for k in range(6)]
    good = [(60, f"# Templates\n\nThe field is written as `{{{{ name }}}}` in the file. {PROSE}\n\n```\n{{{{ x }}}}\n```", "T", "k.example", False)]
    got = {r.page_id: (r.n_residue > 0) or r.notice_share > 0.5 for r in residue.judged_pages(site(spark, [*bad, *good, *NULLS])).collect()}
    assert {k for k, v in got.items() if v} == set(range(20, 26)) | set(range(40, 46))
    assert 100 not in got and got[101] is False
    assert residue.judged_pages(site(spark).limit(0)).count() == 0


def test_a_field_inside_long_prose_is_found(spark):
    marked = [(40 + k, f"# P\n\n{PROSE} Item {k}.\n\nDear {{{{ customer.name }}}}, thank you for order {k}.\n\nLorem ipsum dolor sit amet consectetur.", "P", f"g{k}.example", False) for k in range(6)]
    own = [f"{PROSE} {' '.join(chr(97 + (k * j) % 23) * 3 for j in range(5))}".split() for k in range(60)]
    prose = lambda n, k: [own[(k + j // 30) % 60][j % 30 % len(own[0])] for j in range(n)]
    rows = []
    for k, n in enumerate((15, 50, 300)):
        w = prose(n, k)
        for i, field in enumerate(("{{ product.name }}", "", "20 % at $ 5", "Lorem ipsum dolor sit amet consectetur adipiscing.")):
            text = " ".join([*w[: n // 2], *([field] if field else []), *w[n // 2 :]]) if i < 3 else f"{PROSE} {field} {' '.join(w)}"
            rows.append((100 + 10 * k + i, f"# P\n\n{text}", "P", f"k{k}{i}.example", False))
    got = {r.page_id for r in residue.judged_pages(site(spark, [*marked, *rows])).collect() if r.n_residue}
    assert got == set(range(40, 46)) | {100 + 10 * k + i for k in range(3) for i in (0, 3)}


def test_learning_needs_trusted_records():
    assert residue.learn([]).odds(["x"], True) == (-50.0, -50.0)
    assert residue.learn([(["x"], -1)] * 5).odds(["x"], False)[0] < 0


def test_kinds_of_residue_that_no_trusted_record_has(spark):
    """Fields, fillers and notices that the seeds do not name are learned from the unlabelled records."""
    import os
    import re

    where = "/root/testdata/sf0.1"
    if not os.path.isdir(where):
        pytest.skip("no test data")
    held = re.compile(r"\[\[\w+\]\]|__[A-Z_]{3,}__|%[A-Z_]{3,}%|<<\w+>>|#\{[\w.]+\}|\{%|text goes here|tagline here|beispieltext|texto de ejemplo", re.I)
    notice = re.compile(r"^# (?:access denied|session expired|just a second|loading|verify your visit|something went wrong|accès refusé|acceso denegado|zugriff verweigert|page introuvable|página no encontrada|erreur du serveur)$", re.I | re.M)
    pages = blocks.load_pages(spark, where, "title", "completeness_report.warnings")
    kinds = {}
    for r in pages.collect():
        text = re.sub(r"```.*?```|`[^`\n]*`", "", r.markdown, flags=re.S)
        if residue.FIELD.search(text) or residue.STATUS.search(r.title or "") or "blocked" in " ".join(r.warnings or []):
            continue
        if held.search(text) or (notice.search(text) and len(text) < 1500):
            kinds[r.page_id] = text
    found = {r.page_id for r in residue.judged_pages(pages).where(residue.is_case()).collect()}
    assert len(kinds) > 100 and len(found & set(kinds)) >= 0.9 * len(kinds)


def test_articles_leave_cases_out(spark):
    soup = ", ".join(["cheap rack server", "server sale", "low cost nas"][(i * i) % 3] for i in range(200))
    got = {r.page_id: r for r in main_text.page_lines(site(spark, [(20, soup, "t", "b.example", False), *NULLS])).collect()}
    assert 20 not in got and got[5].furniture == [0, 6, 7, 9] and got[5].kept.startswith("# Page 5") and got[101].furniture == []
    assert 20 in {r.page_id for r in main_text.page_lines(site(spark, [(20, soup, "t", "b.example", False)]), without_cases=False).collect()}


def brute_repeated(rows, min_pages, min_share):
    import re

    form = lambda x: re.sub("[0-9]+", "0", " ".join(x.lower().split()))
    host_pages, holders = {}, {}
    for i, m, _, h, _ in rows:
        if m is not None:
            host_pages[h] = host_pages.get(h, 0) + 1
            for line in m.split("\n"):
                if len(line.strip()) >= 20 and not line.strip().startswith("#"):
                    holders.setdefault((h, form(line.strip())), set()).add(i)
    found = {k for k, v in holders.items() if len(v) >= min_pages and len(v) >= min_share * host_pages[k[0]]}
    return {(i, n) for i, m, _, h, _ in rows if m is not None for n, line in enumerate(m.split("\n")) if len(line.strip()) >= 20 and not line.strip().startswith("#") and (h, form(line.strip())) in found}


def test_repeated_lines_against_brute_force(spark):
    rows = [(k, f"Share this text with all your friends {k % 3}\r\nonly here {k} {'x' * k}\n  share THIS text  with all your friends 77 \n# Share this text with all your friends 1", None, f"h{k % 2}.example", k % 5 == 0) for k in range(30)]
    # Lines of the early pages of one host fall with its late pages, others rise.
    rows += [(300 + k, "Only the early pages have this line of text." if k < 6 else f"Nothing {k}", None, "c.example", k >= 6) for k in range(60)]
    rows += [(200 + k, f"The late pages make this line excessive, {k}." if k % 3 == 0 else "x", None, "d.example", k >= 6) for k in range(18)]
    rows += NULLS
    df = pages(spark, rows)
    r = repeated_lines.run(df, None)
    got = [(x.page_id, x.line_no) for x in r.found().collect()]
    assert set(got) == brute_repeated(rows, 5, 0.15) and got and len(got) == len(set(got))
    assert {x.crossed for x in r.crossed.collect()} == {"up", "down"}
    whole = repeated_lines.count_partition(repeated_lines.keyed_pages(df))
    assert sorted(map(tuple, whole.excessive().collect())) == sorted(map(tuple, r.after.collect()))
    kept = {x.page_id: (x.n_removed, x.markdown) for x in repeated_lines.without_lines(df.where("markdown IS NOT NULL"), r.found()).collect()}
    assert kept[101] == (0, "") and kept[300] == (0, "Only the early pages have this line of text.") and kept[200] == (1, "")
    empty = repeated_lines.run(df.limit(0), None)
    assert empty.found().count() == 0 and empty.crossed.count() == 0


def test_only_pages_with_crossed_lines_are_built_again(spark):
    line = "This legal notice is on many pages of the site."
    rows = [(k, f"text {k}\n{line}" if k < 5 else f"text number {k}", None, "h.example", k in (4, 5, 6)) for k in range(7)]
    df = pages(spark, rows)
    r = repeated_lines.run(df, None)
    assert [x.crossed for x in r.crossed.collect()] == ["up"]
    made = {x.page_id: (x.n_removed, x.markdown) for x in repeated_lines.rebuild(df.where("NOT late"), r.early, r.crossed, r.after).collect()}
    assert made == {k: (1, f"text {k}") for k in range(4)}
