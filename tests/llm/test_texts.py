"""Problems 4, 6, 7, 8 and 9 on small inputs: brute force, round trips, edge cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import chunking, language, lookalike, mixing, packing, tokens

# ---- 4: one form


@pytest.fixture(scope="module")
def normalizer(spark):
    df = spark.createDataFrame([("Release notes for the cache of a server and its cost",), ("Настройка сервера и кэша о расходе а также",)], "text string")
    return lookalike.fit(df)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Rеleasе notеs", "Release notes", True), ("Ｆｅｎｆｏｒｄ １２", "Fenford 12", True), ("café", "café", True), ("Conﬁg", "Config", True), ("no​te­s﻿", "notes", True), ("a b c", "a b c", True),
        ("well‑known", "well-known", True), ("ХСС32574", "XCC32574", True), ("Нaстройка", "Настройка", True), ("x²", "x2", False), ("note", "Note", False), ("a b", "a  b", False), ("resume", "résumé", False), ("Отчёт", "Отчет", False), ("a–b", "a-b", False), ("O1", "01", False), ("", "", True),
    ],
)
def test_same_look(normalizer, a, b, same):
    assert (normalizer(a) == normalizer(b)) is same


def test_form_reads_like_its_script(normalizer):
    assert normalizer("Rеleasе nοtes") == "Release notes"
    assert normalizer("Нacтpoйка") == "Настройка"
    assert normalizer(normalizer("Rеleasе Нacтpoйка ﬁ")) == normalizer("Rеleasе Нacтpoйка ﬁ")


@given(st.text(alphabet="acexopАВЕсхроаеbdт ​ é", max_size=12))
@settings(max_examples=60, deadline=None)
def test_form_is_stable_and_blind_to_spelling(text):
    one = lookalike.Normalizer({("a", "c"): 3, (" ", "a"): 2, (" ", "с"): 2, ("с", "а"): 5})
    other = "".join({"a": "а", "c": "с", "e": "е", "x": "х", "o": "о", "p": "р"}.get(c, c) for c in text)
    assert one(one(text)) == one(text) and one(other) == one(text)


def test_pairs(spark, normalizer):
    rows = [(1, "Release", "t"), (2, "Rеlease", None), (3, "Release", ""), (4, None, "t"), (5, "Ｒelease", "Т"), (5, "Ｒelease", "Т"), (6, "other", "T")]
    df = spark.createDataFrame(rows, "page_id bigint, markdown string, title string")
    got = {tuple(r) for r in lookalike.same_look_pairs(lookalike.fingerprints(df, normalizer, "page_id", ["markdown", "title"])).collect()}
    assert got == {(1, 2, "markdown"), (1, 5, "markdown"), (2, 3, "markdown"), (2, 5, "markdown"), (3, 5, "markdown"), (5, 6, "title")}
    prints = lookalike.fingerprints(df, normalizer, "page_id", ["markdown", "title"])
    assert {tuple(r) for r in lookalike.same_look_pairs(prints, salted=1).collect()} == got
    classes = {(r.key, r.field): (r.look, r.spelling, r.n_links) for r in lookalike.look_classes(prints).collect()}
    assert classes == {(1, "markdown"): (1, 1, 2), (2, "markdown"): (1, 2, 3), (3, "markdown"): (1, 1, 2), (5, "markdown"): (1, 5, 3), (5, "title"): (5, 5, 1), (6, "title"): (5, 6, 1)}
    assert lookalike.same_look_pairs(lookalike.fingerprints(df.limit(0), normalizer, "page_id", ["markdown", "title"])).count() == 0
    kept = {r.page_id: (r.title, r.markdown) for r in lookalike.normalize_columns(df, normalizer, "page_id", ["title", "markdown"]).collect()}
    assert kept[2] == (None, "Release") and kept[4] == ("t", None) and kept[3][0] == ""


# ---- 6: pieces


def check_pieces(text, max_tokens, overlap):
    pieces = chunking.split_text(text, max_tokens, overlap)
    at = 0
    for k, (start, own, end) in enumerate(pieces):
        assert own == at and end > own and chunking.tokens(end - start) <= max_tokens
        most = min(overlap * 4, own - pieces[k - 1][1]) if k else 0
        if own - start != most:  # moved to a word start: back where there is room, else on
            assert text[start - 1].isspace() and pieces[k - 1][1] < start and (own - start > most or not any(c in " \n" for c in text[own - most : start - 1]))
        at = end
    assert at == len(text)
    return pieces


@given(st.lists(st.sampled_from(["word ", "A sentence. ", "\n", "\n\n", "x" * 50, "```\n", "| a | b |\n", "文。"]), min_size=1, max_size=120), st.integers(8, 40), st.integers(0, 7))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text_within_the_limit(parts, most, lap):
    check_pieces("".join(parts), most, lap)


@given(st.lists(st.sampled_from(["word ", "A sentence. ", "\n", "\n\n", "x" * 50, "```\n", "| a | b |\n", "文。", "é🙂"]), min_size=1, max_size=120), st.integers(24, 60), st.integers(0, 7))
@settings(max_examples=80, deadline=None)
def test_pieces_in_tokens_cover_the_text_within_the_limit(parts, most, lap):
    text, size = "".join(parts), lambda x: len(tokens.encoding().encode_ordinary(x))
    pieces = chunking.split_page(text, most, lap, tokens.encoding())
    assert "".join(text[own:end] for _, own, end in pieces) == text
    for k, (start, own, end) in enumerate(pieces):
        assert end > own >= start and size(text[start:end]) <= most and (k == 0 or start >= pieces[k - 1][1])


def test_page_pieces(spark):
    df = spark.createDataFrame([(1, "A sentence of words. " * 400, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (5, "é" * 3000, "x")], "page_id int, markdown string, text string")
    got = {}
    for r in chunking.split_pages(df, 256, 32).collect():
        got.setdefault(r.page_id, []).append((r.piece_no, r.overlap_chars, r.n_tokens, r.text))
    assert set(got) == {1, 5} and "".join(t[o:] for _, o, _, t in sorted(got[1])) == "A sentence of words. " * 400
    assert max(n for v in got.values() for _, _, n, _ in v) <= 256 and all(o for k, o, _, _ in got[1] if k)


def test_cuts_are_natural():
    paragraphs = ["One sentence here. " * 6 + "End." for _ in range(8)]
    text = "\n\n".join(paragraphs)
    for _, own, _ in chunking.split_text(text, 64, 0):
        assert own == 0 or text[own - 2 : own] == "\n\n"


def test_sections_and_edges(spark):
    md = "pre\n# A\n" + "word " * 600 + "\n```\n# no heading\n```\n#### deep\n## B\r\nshort"
    assert [(n, h, lv) for n, h, lv, _ in chunking.sections(md)] == [(0, None, 0), (1, "A", 1), (2, "B", 2)]
    df = spark.createDataFrame([(1, md, "x"), (2, None, "x"), (3, "", "x"), (4, "y" * 2048, "x"), (5, "z" * 2049, "x")], "page_id bigint, markdown string, pieces string")
    got = {(r.page_id, r.section_no): len(r.pieces) for r in chunking.split_sections(df, 512, 64).collect()}
    assert got == {(1, 1): 2, (5, 0): 2}
    with pytest.raises(ValueError):
        chunking.split_sections(df, 64, 64)


# ---- 7: containers


def brute_sum_of_squares(sizes, capacity):
    bins, out = [], []
    for size in sizes:
        best = None
        for j, gap in [*enumerate(bins), (len(bins), capacity)]:
            if gap >= size:
                after = [g for k, g in enumerate(bins) if k != j] + [gap - size]
                counts = {}
                for g in after:
                    if 0 < g < capacity:
                        counts[g] = counts.get(g, 0) + 1
                key = (sum(c * c for c in counts.values()), j == len(bins), gap)
                best = min(best, (key, j)) if best else (key, j)
        j = best[1]
        if j == len(bins):
            bins.append(capacity)
        bins[j] -= size
        out.append(j)
    return bins, out


@given(st.lists(st.integers(1, 20), max_size=40))
@settings(max_examples=80, deadline=None)
def test_sum_of_squares_matches_its_definition(sizes):
    out = packing.sum_of_squares(sizes, 20)
    load = {}
    for s, b in zip(sizes, out, strict=True):
        load[b] = load.get(b, 0) + s
    assert all(v <= 20 for v in load.values())
    assert sorted(20 - v for v in load.values()) == sorted(brute_sum_of_squares(sizes, 20)[0])


def test_packing(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["word"] * rng.randrange(1, 120)), "z") for k in range(400)] + [(500, None, "z"), (501, "", "z"), (502, "long text " * 2000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block string")
    sizes = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"]).collect()}
    packed = packing.pack(df, [("c", 512)], block=64)
    got = packed.collect()
    per_doc, per_bin = {}, {}
    for r in got:
        per_doc.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        per_bin[r.container_id] = per_bin.get(r.container_id, 0) + r.n_tokens
    for d, parts in per_doc.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == sizes[d] and (len(parts) == 1 or sizes[d] > 512)
    assert set(per_doc) == {d for d, n in sizes.items() if n} and max(per_bin.values()) <= 512
    assert sorted(map(tuple, got)) == sorted(map(tuple, packing.pack(df.repartition(7), [("c", 512)], block=64).collect()))
    whole = packing.pack(df, [("c", 512)])  # one block: blocks this small waste their last containers
    assert packing.fill(whole, [("c", 512)]).first().fill_share > 0.9
    assert packing.pack(df.limit(0), [("c", 512)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [("c", 0)])


# ---- 8: mixtures


def test_weights():
    s = {"a": mixing.Source(1000, 1.0, 2), "b": mixing.Source(100, 1.0, 4)}
    assert mixing.path(s, 0.0) == {"a": 0.5, "b": 0.5} and abs(mixing.path(s, 1.0)["a"] - 1000 / 1100) < 1e-12
    assert mixing.plan(s)[0] == {"a": 400, "b": 400} and mixing.plan(s)[1] == 0.0
    budget, exponent = mixing.plan(s, 1100)
    assert 0 < exponent < 1 and budget["b"] <= 400 and abs(sum(budget.values()) - 1100) <= 2
    e = mixing.temper(s, 0.5)
    w = mixing.path(s, e)
    import math

    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.5) < 1e-6
    assert mixing.plan({}) == ({}, 0.0)


def test_mixture_meets_targets(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["word"] * rng.randrange(20, 60)), "big") for k in range(900)] + [(1000 + k, " ".join(["word"] * rng.randrange(20, 60)), "small") for k in range(60)]
    rows += [(2000, None, "big"), (2001, "no source", None), (2002, "unknown source", "other"), (2003, "", "small")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 3.0, 1), ("small", 1.0, 3), ("absent", 1.0, 5), (None, 1.0, 1), ("zero", 0.0, 1)], "source string, target_weight double, max_repeats int")
    mixed = mixing.mix(docs, targets).cache()
    shares = {r.source: r for r in mixing.report(mixed, targets).collect()}
    assert abs(shares["big"].actual_share - 0.75) < 0.01 and abs(shares["small"].actual_share - 0.25) < 0.01
    assert shares["small"].max_copies <= 3 and shares["big"].max_copies <= 1 and shares["absent"].n_rows == 0
    assert mixed.count() == mixed.select("doc_id", "copy").distinct().count()
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_blocks_of_the_last_pass(spark):
    sizes = spark.range(2000).selectExpr("id AS doc_id", "'a' AS source", "10L AS n_tokens")
    s = {"a": mixing.Source(20000, 1.0, 3)}
    got = mixing.realise(sizes, s, {"a": 27000}, block=64)
    assert got.agg({"n_tokens": "sum"}).first()[0] == 27000 and got.where("copy = 1").count() == 2000 and got.where("copy = 2").count() == 700


# ---- 9: languages


def test_labels():
    assert [language.label_language(x) for x in ("en", "EN-us", "eng", "de_DE", "ger", "fre", "und", "", None, "n/a", "unknown", "xx")] == ["en", "en", "en", "de", "de", "fr", None, None, None, None, None, None]


def brute_distance(text, samples, size):
    import unicodedata
    from collections import Counter

    counts = {}
    for lang, t in samples:
        counts.setdefault(lang, Counter()).update(language.grams(unicodedata.normalize("NFC", t)))
    ranks = {k: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size])} for k, c in counts.items()}
    share = Counter()
    for c in counts.values():
        n = sum(c.values())
        share.update({g: k / n for g, k in c.items()})
    known = {g for r in ranks.values() for g in r}
    order = {g: i for i, g in enumerate(sorted(known, key=lambda g: (-share[g], g)))}
    own = [g for g, _ in sorted(((g, n) for g, n in language.grams(text).items() if g in known), key=lambda x: (-x[1], order[x[0]]))][:size]
    return [sum(min(size, abs(ranks[k].get(g, size) - i)) for i, g in enumerate(own)) / (size * max(1, len(own))) for k in sorted(ranks)]


def test_distances_match_the_definition():
    samples = [("en", "the quick brown fox jumps over the lazy dog and the cat"), ("de", "der schnelle braune fuchs springt über den faulen hund und die katze"), ("ja", "毎日の複製は失敗した接続を別の記録に残します")]
    p = language.Profiles(samples, 60)
    texts = ["the dog and the fox", "der hund und die katze", "毎日の記録", "", "123 !!", "xyz"]
    got = p.distances(texts)
    for t, row in zip(texts, got, strict=True):
        want = brute_distance(t, samples, 60) if any(c.isalpha() for c in t) and t != "xyz" else None
        if want:
            assert [round(x, 9) for x in row] == [round(x, 9) for x in want]
    assert (got[3] == 1).all() and (got[4] == 1).all()


def test_held_out_accuracy(spark, sf_dir):
    samples = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/lang_samples.parquet").collect()]
    hits = total = 0
    for fold in range(4):
        model = language.Profiles([x for k, x in enumerate(samples) if k % 4 != fold])
        held = [x for k, x in enumerate(samples) if k % 4 == fold]
        best = model.distances([t.lower() for _, t in held]).argmin(1)
        hits += sum(model.langs[b] == lang for b, (lang, _) in zip(best, held, strict=True))
        total += len(held)
    assert hits / total > 0.95


def test_blocks_and_documents(spark, sf_dir):
    model = language.fit(spark.read.parquet(f"{sf_dir}/lang_samples.parquet"))
    en, de = "The storage controller waits for the slowest member of the group.", "Der Speichercontroller wartet auf das langsamste Mitglied der Gruppe."
    df = spark.createDataFrame([(1, f"{en}\n\n{de}\n\n{de}\n\n# Title", "en-GB", "x"), (2, None, "en", "x"), (3, "", None, "x"), (4, "12 34", "de", "x")], "doc_id bigint, text string, lang string, label string")
    blocks = language.identify(df, model)
    got = {r.doc_id: r for r in blocks.collect()}
    assert [b.lang for b in got[1].blocks][:3] == ["en", "de", "de"] and got[1].label == "en" and not got[1].blocks[3].prose and 2 not in got
    docs = {r.doc_id: r for r in language.document_languages(blocks).collect()}
    assert (docs[1].lang, docs[1].n_langs) == ("de", 2) and docs[1].confidence > 0 and docs[3].lang is None and docs[4].lang is None
    assert language.identify(df.limit(0), model).count() == 0
