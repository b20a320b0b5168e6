"""Nulls, empty and odd texts, repeated rows, empty tables, and columns that clash with internal names."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import contamination, jaccard, mixing, neighbours, pii, quality, secrets, tokens, urls, warc
from spanloom.llm.arrays import Words, flat_bytes
from tests.llm import brute

CLASH = ["size", "h", "_h", "_size", "text_", "_text", "_bytes", "base", "spans", "n", "rep", "source_size", "target", "copies", "log_weight", "key", "keep", "region", "_id", "component_id"]
TEXTS = [None, "", " \n\t", "a", "a", "A b", "x " * 3000, "y" * 30_000, "é😀 日本 ß", "tok\x00en\x1f", "mail a@b.co +49 (30) 1234567 1.2.3.4 password=abcdef1"]


def table(spark, texts=TEXTS, clash=True):
    rows = [(k // 2, t, "s" if k % 3 else None) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.withColumns({c: F.lit("?") for c in CLASH}) if clash else d


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, "a b"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_all_take_clashing_columns_and_keep_row_counts(spark):
    d, n = table(spark), len(TEXTS)
    assert mixing.mix_documents(d).count() == n
    assert mixing.mix_documents(table(spark, clash=False).withColumn("more", F.lit(1)), ("doc_id", "more")).count() == n
    assert contamination.scan_documents(d, bench(spark)).count() == n
    assert tokens.count_tokens(d).count() == n
    assert pii.find_pii(d).count() == n
    assert secrets.find_secrets(d).count() == n
    assert quality.resample(d, labels(spark)).filter("keep").count() == n
    assert jaccard.join_components(d).count() == n


def test_all_take_empty_tables(spark):
    e = empty(spark)
    assert mixing.mix_documents(e).count() == contamination.scan_documents(e, bench(spark, ())).count() == tokens.count_tokens(e).count() == 0
    assert pii.find_pii(e).count() == secrets.find_secrets(e).count() == quality.resample(e, labels(spark)).count() == jaccard.join_components(e).count() == 0
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.derivatives(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_odd_texts_give_what_plain_python_gives(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r for r in pii.find_pii(d).select("doc_id", pii.span_text("base").alias("b")).collect()}
    sec = {r["doc_id"]: r for r in secrets.find_secrets(d).select("doc_id", secrets.span_text("base").alias("b")).collect()}
    for i, t in rows:
        assert got[i]["b"] == brute.joined(brute.pii(t)) and sec[i]["b"] == brute.joined(brute.secrets(t))
    comp = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(d, 3, 90).collect()}
    assert comp == brute.jaccard(rows, 3, 90)


def test_pii_patterns_on_random_strings(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a@.-+ 0123456789()_x") for _ in range(rng.randrange(60))) for _ in range(400)] + ["a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "a." * 3000 + "@b.c", "a@" + "b." * 3000 + "c", "9" * 4000, "4111 1111 1111 1111-1"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(d).select("doc_id", pii.span_text("base").alias("b")).collect():
        assert r["b"] == brute.joined(brute.pii(texts[r["doc_id"]])), texts[r["doc_id"]][:80]


def test_pii_method_adds_spans_where_labelers_agree(spark):
    good = ["call me, tel 030 1234 5678 soon", "my phone: 089 9876 5432 is on", "mail: joe at example dot com now"] * 40
    d = spark.createDataFrame(list(enumerate(good + ["email a@b.com", "phone +49 30 1234567"] * 60)), "doc_id long, text string")
    got = pii.find_pii(d).filter("doc_id < 120")
    assert got.filter(F.size("spans") > F.size("base")).count() >= 80


def test_pii_adds_just_the_planted_national_numbers(spark):
    rng = random.Random(11)
    texts, want = [], {}
    for i in range(300):
        words = [rng.choice("the order of serial and page with some words in it".split()) for _ in range(30)]
        if i % 3 == 0:
            number = f"{rng.choice(['030', '089', '040'])} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)}"
            head = " ".join(words) + " call me, my phone is "
            texts.append(head + number + " until noon")
            want[i] = [("phone", len(head), len(head) + len(number))]
        elif i % 3 == 1:  # the same look behind words that speak against it, and glued to other letters
            texts.append(" ".join(words) + f" order serial 0{rng.randrange(10**11, 10**12)}")
        else:
            texts.append(" ".join(words) + f" mail a{i}@b.com or phone +49 30 {rng.randrange(10**6, 10**7)}")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(d).collect():
        added = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s not in r["base"]]
        assert added == want.get(r["doc_id"], []), texts[r["doc_id"]]


def test_pii_is_linear_in_matches_and_length(spark):
    many = " ".join(f"u{k}@example.com" for k in range(20_000))
    texts = [" at " * 500_000, many, "+1 " * 300_000, "0301 234 567 " * 20_000, "9" * 500_000, "é" * 300 + many[:50_000]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    rows = pii.find_pii(d, ("doc_id", "text")).withColumn("out", pii.redacted(F.col("text"), F.col("spans"))).collect()
    assert time.time() - began < 60
    for r in rows:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        assert spans == brute.pii(texts[r["doc_id"]])
        if r["doc_id"] in (1, 5):
            assert r["out"] == re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", texts[r["doc_id"]])


def test_redaction(spark):
    d = spark.createDataFrame([(1, "é a@b.co, +49 30 1234567!")], "doc_id long, text string")
    r = pii.find_pii(d, ("text",)).select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).first()
    assert r["t"] == "é <EMAIL>, <PHONE>!"


def test_reliabilities_prefer_the_labelers_that_agree():
    counts = {(1, 1, 1, 1, 1): 500, (1, 1, 1, 0, 1): 300, (0, -1, -1, -1, -1): 400, (0, 1, 1, 1, 1): 50, (0, -1, 0, -1, 1): 60}
    p = pii.reliabilities(counts)
    assert p[1, 1, 1, 1, 1] > 0.95 and p[0, 1, 1, 1, 1] > 0.9 and p[0, -1, -1, -1, -1] < 0.05


def test_secrets_by_randomness(spark):
    rng = random.Random(9)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["internationalization of counterrevolutionaries and Antidisestablishmentarianism"] * 60 + ["".join(rng.choice(symbols) for _ in range(40)) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.find_secrets(d).filter(F.exists("spans", lambda s: s["kind"] == "random")).collect()}
    assert found <= set(range(60, 80)) and len(found) >= 15
    assert min(secrets.randomness(b"A1" * 20, secrets.alphabet_of(b"A1" * 20))) < 0.001


def test_planted_random_strings_are_found_and_nothing_else(spark):
    rng = random.Random(21)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    plain = ["internationalization of counterrevolutionaries", "see /usr/share/documentation/packages/readme_first.html", "A1A1A1A1A1A1A1A1A1A1A1A1A1A1A1A1A1A1A1A1", "call getElementsByTagNameAndClass now", "0123456789012345678901234567890", "abcabcabcabcabcabcabcabcABCABCABCABCABC123123123"]
    texts, want = [], {}
    for i in range(400):
        if i % 4:
            texts.append(f"text {i} {plain[i % len(plain)]} and more")
            continue
        token = "".join(rng.choice(alphabets[i // 4 % 3]) for _ in range(rng.randrange(40, 64)))
        texts.append(f"note {i}: {token} is here")
        want[i] = token
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random"] for r in secrets.find_secrets(d).collect()}
    wrong = [i for i in range(400) if i not in want and got[i]]
    assert not wrong, [got[i] for i in wrong]
    assert sum(got[i] == [want[i]] for i in want) >= 0.97 * len(want)


def test_secrets_behind_names_and_in_paths(spark):
    rng = random.Random(11)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = ["internationalization of counterrevolutionaries and Antidisestablishmentarianism"] * 60 + ["https://host/blog/2019/How_To_Fix-your_Thing/Part_2"] * 20
    heads = ["DEPLOY_KEY=", "export AWS_ACCOUNT_KEY=", "https://host/file?sig=", "see https://host/some_dir/"]
    texts = plain + [heads[i % 4] + "".join(rng.choice(symbols + ("-_" if i % 4 == 3 else "")) for _ in range(40)) + ("==" if i % 4 == 2 else "") for i in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(d).collect() if r["spans"]}
    assert set(found) <= set(range(80, 120)) and all(sum(i % 4 == k for i in found) >= 7 for k in range(4))
    for i, spans in found.items():
        assert len(spans) == 1 and (i % 4 == 3 or spans == [(len(heads[i % 4]), len(texts[i]))])
    assert [p for _, p in secrets.pieces(b"DEPLOY_KEY=q8Zr3LwT0vNf5KyXb2HsJ7mPdUc9GeRa")] == [b"q8Zr3LwT0vNf5KyXb2HsJ7mPdUc9GeRa"]


def test_decontamination_with_several_automata_and_offsets(spark):
    items = [(i, f"word{i} and then word{i} again with more words to make ten of them") for i in range(30)]
    docs = [(i, f"Intro — WORD{i} and, then word{i} again with more words to make ten. End") for i in range(0, 30, 3)] + [(99, "nothing here"), (100, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {tuple(r[:4]) + (tuple(r["item_ids"]),) for r in contamination.scan_documents(d, bench(spark, items)).collect()}
    parts = {tuple(r[:4]) + (tuple(r["item_ids"]),) for r in contamination.scan_documents(d, bench(spark, items), limit=300).collect()}
    assert whole == parts
    want = brute.leaks(docs, items)
    assert {r[0]: (r[1], r[2], r[3]) for r in whole} == {i: w[:3] for i, w in want.items()}
    for r in contamination.scan_documents(d, bench(spark, items)).filter("n_hit > 0").collect():
        text, s = dict(docs)[r["doc_id"]], r["spans"][0]
        assert text[s["start"] : s["end"]].startswith(f"WORD{r['doc_id']}") and text[s["start"] : s["end"]].endswith("ten")


def test_windows_of_random_words_against_brute_force(spark):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice("a b c d e".split()) for _ in range(n))
    items = [(i, some(rng.randrange(0, 26))) for i in range(40)] + [(None, some(12)), (7, None), (7, "z y x w v u t s r q p o")]
    docs = []
    for i in range(200):
        tail = rng.choice([t for _, t in items if t])
        docs.append((i, f"{some(rng.randrange(0, 60))} {tail} {some(rng.randrange(0, 9))}" if i % 2 else some(rng.randrange(0, 120))))
    rows = contamination.scan_documents(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, items)).collect()
    want = brute.leaks(docs, [x for x in items if x[0] is not None])
    named = {i: tuple(w[2:3]) for i, w in want.items()}
    all_hits = brute.leaks(docs, items)
    for r in rows:
        assert (r["n_words"], r["n_hit"]) == all_hits[r["doc_id"]][:2] and (r["n_items"],) == named[r["doc_id"]]
        assert brute.sha(",".join(r["item_ids"])) == want[r["doc_id"]][3]


def test_mixing_leaves_null_sources_and_zero_sizes_whole(spark):
    d = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (2, None, "z"), (3, "c d e f", "a")], "doc_id long, text string, source string")
    rows = mixing.mix_documents(d).collect()
    assert len(rows) == 4 and all(r["taken"] <= 2 * r["size"] for r in rows) and sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(12)


def test_tokens_of_odd_strings():
    import sentencepiece

    rng = random.Random(2)
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    texts = ["", " ", "  a", "\n\n", "<s></s><unk><0x0A>", "aaaa" * 500, "▁▁ a▁b", "\x00", "日本語" * 200] + ["".join(rng.choice("ab c\nédef{}\r▁") for _ in range(rng.randrange(900))) for _ in range(60)]
    assert tokens.Counter(tokens.model_path())(texts) == [len(t) for t in model.encode(texts)]
    ranks = tokens.PairRanks(tokens.model_path())
    assert ranks.queued("▁hello▁▁▁world") == ranks.counts(["▁hello▁▁▁world"])[0]


def test_nearest_with_bad_vectors_copies_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [1.0, 0.0])] + [(100 + i, [1.0, 0.0]) for i in range(30)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 50, 100] and [v for _, v, _ in sorted(got[0])] == [1, 2, 9, 100, 101] and [v for _, v, _ in sorted(got[100])] == [0, 1, 2, 9, 101]
    few = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 0.0)]


def test_nearest_among_vectors_of_several_lengths(spark):
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(2 + k % 3)]) for k in range(160)] + [(200, [1.0] * 7), (201, [0.3] * 6)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    unit = lambda v: math.sqrt(sum(x * x for x in v))
    for q in (0, 50, 100, 150):
        v = dict(rows)[q]
        near = sorted((-sum(a * b for a, b in zip(v, w)) / unit(v) / unit(w), i) for i, w in rows if i != q and len(w) == len(v))[:5]
        assert [got[q][k + 1][0] for k in range(5)] == [i for _, i in near]
        assert [got[q][k + 1][1] for k in range(5)] == pytest.approx([-s for s, _ in near])
    assert 200 not in got


def test_nearest_with_repeated_rows_and_ids(spark):
    v, near, far = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    rows = [(7, v)] * 6 + [(i, v) for i in range(8, 13)] + [(50, near), (50, near)] + [(i, far) for i in range(20, 30)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(50, k + 1, 7 + k) for k in range(5)]
    rows = [(50, v), (50, v)] + [(i, v) for i in range(51, 56)] + [(i, far) for i in range(60, 70)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(50, k + 1, 51 + k) for k in range(5)]
    rows = [(50, v)] + [(7, [1.0, 0.001 * k]) for k in range(9)] + [(8 + k, [1.0, 0.1 + 0.1 * k]) for k in range(6)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(50, k + 1, 7 + k) for k in range(5)]


def test_tree_recall_on_clusters():
    rng = np.random.default_rng(1)
    x = neighbours.units(np.repeat(rng.normal(size=(40, 16)), 100, axis=0) + 0.2 * rng.normal(size=(4000, 16)))
    out = np.arange(4000) % 10 == 0
    tree = neighbours.Tree(x[~out], 4000)
    assert tree.n_leaves > 4 and neighbours.calibrated(tree, x[~out], x[out]) < tree.n_leaves
    assert np.bincount(tree.file(x), minlength=tree.n_leaves).sum() == 4000


def chains(n):
    """Near copies at all distances, linked in chains, beside texts of their own, copies and repeated lines."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(t))
    return texts + [" ".join(f"u{rng.randrange(10_000)}" for _ in range(rng.randrange(1, 80))) for _ in range(100)] + texts[:5] + ["same line of text"] * 9


@pytest.mark.parametrize("caps", [None, (40, 4000)])
def test_jaccard_on_chains_and_groups(spark, monkeypatch, caps):
    rows = list(enumerate(chains(150)))
    if caps:  # regions that are dealt out over tasks
        monkeypatch.setattr(jaccard, "REGION_DOCS", caps[0])
        monkeypatch.setattr(jaccard, "REGION_SHINGLES", caps[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)


def test_pivots_carry_the_join():
    """With the shipped constants pivots, Voronoi cells, windows and recursion do the work, and most links are distances to pivots."""
    rng, texts = random.Random(5), chains(100)
    parent = [f"w{k}" for k in range(150)]
    for _ in range(40):  # families at middle distances, each of near copies
        head = [w if rng.random() > 0.25 else f"f{rng.randrange(10_000)}" for w in parent]
        texts += [" ".join(w if rng.random() > 0.012 else f"v{rng.randrange(1000)}" for w in head) for _ in range(12)]
    sets = [s for _, s in jaccard.shingle_sets(pa.array([t.encode() for t in dict.fromkeys(texts)]), 3)]
    region = jaccard.Region(sets, 90)
    region.run(np.arange(len(sets)))
    assert region.work["pivots"] > 8 and region.work["cells"] > 1 and region.work["copies"] > 0 and region.work["depth"] > 0
    how = [k for _, _, k, _ in region.links]
    assert how.count(jaccard.BY_PIVOT) > how.count(jaccard.BY_PAIR) and region.work["pairs"] < len(sets) * (len(sets) - 1) / 4
    want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    met = jaccard.Union(len(sets))
    for i, j in want:
        met.join(i, j)
    same = lambda u: {tuple(np.flatnonzero(u.roots() == r)) for r in set(u.roots().tolist())}
    assert same(met) == same(region.union)


def test_windows_keep_every_close_pair_together():
    rng = np.random.default_rng(3)
    points = rng.random((400, 2))
    pivots, radius = points[:6], 0.1
    d = np.sqrt(((points[None] - pivots[:, None]) ** 2).sum(-1))
    cells = jaccard.windows(d, radius)
    close = np.sqrt(((points[None] - points[:, None]) ** 2).sum(-1)) <= radius
    assert all((cells[:, i] & cells[:, j]).any() for i, j in np.argwhere(close))


def test_near_copies_judge_rows_of_one_id_by_their_texts(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    d = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (7, b + " x"), (7, "z")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.without_near_copies(d).collect()) == [(3, a), (5, b), (7, "z")]


def test_near_copies_leave_one_of_each(spark):
    d = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "x"), (3, "x"), (4, None), (None, "z")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1) for r in jaccard.without_near_copies(d).collect()) == [-1, 1, 3, 4]


def test_rules_and_parts_of_urls(spark):
    rows = [(1, "http://A.Example.net/en/x?q#f"), (2, "http://net/"), (3, "http://x.net"), (4, "https://q.example.com/de/1"), (5, "http://foo.org/fr/"), (6, "nothing"), (7, None), (8, "ftp://h?x"), (9, "http://notexample.net/en/"), (10, "http://İ.org/a#b"), (11, "http://é" + "x" * 9000)]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("?")).withColumn("grams", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(d).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("net", "/", "net/", "block") and got[3][:3] == ("x.net", "", None)
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow") and got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][:2] == ("h", "") and got[9][2] == "net/" and got[10][0] == "İ.org" and len(got) == 11


def test_url_models_tell_classes_apart(spark):
    rng = random.Random(5)
    rows = [(k, f"http://{rng.choice(['xq', 'zz'])}{rng.randrange(999)}.net/a") for k in range(200)] + [(200 + k, f"http://good{rng.randrange(999)}.org/fr/b") for k in range(200)] + [(400, "http://zz12.com/a"), (401, "http://good7.com/fr/b")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[400]["verdict"] == "block" and got[401]["verdict"] == "allow" and got[400]["score"] < 0 < got[401]["score"]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; é</title><script>x</script><p>Hello<br>world &lt;3"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("?"))
    made = warc.derivatives(warc.responses(pages))
    warc.write_records(made, str(tmp_path / "w"))
    back = warc.read_records(spark, str(tmp_path / "w")).collect()
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(((r["headers"]["warc-record-id"], r["headers"]["warc-refers-to"], r["block"]) for r in back), key=key) == sorted(((r["record_id"], r["refers_to"], r["block"]) for r in made.collect()), key=key)
    text = {(r["page_id"], r["record_type"]): r["block"] for r in made.collect()}
    assert text[1, "conversion"] == "T & é Hello world <3" and text[2, "conversion"] == "" and "title: T & é" in text[1, "metadata"]


def test_quality_without_clean_or_without_rejected_labels_keeps_all(spark):
    d = table(spark, ["good text here", "bad", None, ""], clash=False)
    for rows in ([], [(0, 1, 0)], [(0, 0, 1), (1, 0, 0)], [(None, 1, 0), (0, None, None)]):
        assert quality.resample(d, labels(spark, rows)).filter("keep").count() == 4


def test_gumbel_threshold_takes_k(spark):
    rng = random.Random(3)
    for keys in ([rng.uniform(-20, 20) for _ in range(3000)], [rng.choice([-1.0, 0.5, 0.5000001]) for _ in range(3000)], [7.0] * 10):
        rows = list(enumerate(keys))
        d = spark.createDataFrame(rows, "doc_id long, key double")
        ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
        for k in (1, len(rows) // 3, len(rows)):
            assert quality.kth_largest(d, k) == (ordered[k - 1][1], ordered[k - 1][0])
        assert quality.kth_largest(d, 0) is None


def test_resampling_is_gumbel_top_k(spark):
    """The rows kept are the k with the largest of scaled log weight plus Gumbel noise, recomputed here from the ids."""
    rng = random.Random(8)
    good, bad = "the quiet river runs along fields of wheat and stone".split(), "buy cheap click win now free cash idiot".split()
    rows = [(i, " ".join(rng.choice(good if (i % 3 or rng.random() < 0.4) else bad) for _ in range(rng.randrange(1, 40)))) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    l = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(0, 900, 2)])
    got = quality.resample(d, l).collect()
    key = {}
    for r in got:
        u = (int(hashlib.sha256(f"gumbel{r['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48
        key[r["doc_id"]] = r["log_weight"] * quality.POWER - math.log(-math.log(u))
        assert abs(key[r["doc_id"]] - r["key"]) < 1e-9
    kept = {r["doc_id"] for r in got if r["keep"]}
    assert 0 < len(kept) < 900
    assert kept == set(sorted(key, key=lambda i: (-key[i], i))[: len(kept)])


def test_words_of_flat_arrays():
    import pyarrow as pa

    texts = ["ab  c", None, "", " d\n", "e", "f g"]
    w = Words(*flat_bytes(pa.array(texts)))
    assert w.counts.tolist() == [2, 0, 0, 1, 1, 2] and len(set(w.hashes().tolist())) == 6
    again = Words(*flat_bytes(pa.array(["c ab", "ab"])))
    assert set(again.hashes().tolist()) == set(w.hashes()[:2].tolist())
    long = Words(*flat_bytes(pa.array(["a" * 256 + "b" + "a" * 300, "b" + "a" * 556])))
    assert len(set(long.hashes().tolist())) == 2


def test_warc_blocks_that_hold_the_first_line_of_a_record(spark, tmp_path):
    blocks = ["plain", "a\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\nb", "WARC/1.1\r\n", "", "é WARC/1.1\r\nWARC/1.1\r\n end"]
    page = "<html><title>T</title><p>x &amp; y</p></html>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n{page}"
    whole = b"".join(f"WARC/1.1\r\nWARC-Type: {'response' if b is http else 'resource'}\r\nWARC-Record-ID: <id:{i}>\r\nContent-Length: {len(b.encode())}\r\n\r\n{b}\r\n\r\n".encode() for i, b in enumerate([*blocks, http]))
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))
    for name in ("a.warc", "b.warc.gz"):
        read = warc.read_records(spark, str(tmp_path / name))
        assert {r["headers"]["warc-record-id"]: r["block"] for r in read.collect()} == {f"<id:{i}>": b for i, b in enumerate([*blocks, http])}
        made = {r["record_type"]: r for r in warc.derivatives(warc.responses_of(read)).collect()}
        assert made["conversion"]["block"] == "T x & y" and made["conversion"]["refers_to"] == "<id:5>" and "Content-Type: text/html" in made["metadata"]["block"]


def test_markup_is_linear_and_references_are_decoded(spark):
    texts = ["<script x " * 100_000, "<!-- " * 200_000, "<a " * 300_000, "&eacute;&#233;&#x2014;&bogus;&#xD800;&amp;lt; &#99999999; &copy; 1 &lt; 2", "a<!-- b --> c <script>if (1<2) '<!--'</script> d <style>x</style>e<p>f"]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(warc.plain_text(F.col("t"))).collect()]
    assert time.time() - began < 30
    assert got == ["", "", "", "éé—&bogus;\ufffd&lt; &#99999999; © 1 < 2", "a c d e f"]
