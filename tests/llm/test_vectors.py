"""Vector codes and exact top-k search against plain Python, on odd tables too."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import codes, topk

SCHEMA = "vec_id long, embedding array<double>, label string"
NAN, INF = float("nan"), float("inf")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows, entries=256, parts=4, rounds=4, units=1024):
    """Plain Python integers; (vec_id, code, error, label) of each row, and the books by length."""
    out, books = [], {}
    kept = [(i, [math.floor(units * x) for x in v], l) for i, v, l in rows if usable(v)]
    for size in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        edge = [p * size // parts for p in range(parts + 1)]
        cut = [[tuple(v[a:z]) for a, z in zip(edge, edge[1:])] for _, v, _ in own]
        book = [[c[p] for c in cut[:entries]] for p in range(parts)]

        def best(x, b):
            return min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(b))

        for _ in range(rounds):
            for p in range(parts):
                members = defaultdict(list)
                for c in cut:
                    members[best(c[p], book[p])[1]].append(c[p])
                for k, m in members.items():
                    book[p][k] = tuple(sum(x) // len(m) for x in zip(*m))
        for (i, _, l), c in zip(own, cut):
            got = [best(c[p], book[p]) for p in range(parts)]
            out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), l))
        books[size] = book
    return out, books


def brute_top(rows, every=50, k=5, units=256):
    own = [(i, tuple(math.floor(units * x) for x in v)) for i, v, _ in rows if i is not None and usable(v)]
    out = {}
    for q in {i for i, _ in own if i % every == 0}:
        v = min((v for i, v in own if i == q))
        best = {}
        for i, w in own:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -(1 << 62)), sum(a * b for a, b in zip(v, w)))
        out[q] = [(i, s) for s, i in sorted((-s, i) for i, s in best.items())[:k]]
        out[q] = [(i, -s) for i, s in out[q]]
    return out


def odd_rows(seed=3, n=400):
    """Copies, ties, repeated ids and rows, lengths 5, 4 and 0, null and bad vectors, null ids and labels."""
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(5)], rng.choice([None, "", "a", "b"])) for k in range(n)]
    rows += [(k, [0.1, -0.2, 0.3, 0.4, -0.5], "a") for k in range(1000, 1100)]  # one very common vector
    rows += rows[:5] + [(7, [9.0, 9.0, 9.0, 9.0, 9.0], "b"), (50, [0.0] * 5, None), (100, [0.0] * 5, None)]
    rows += [(2000 + k, [float(k), -float(k), 0.5, 0.5], "c") for k in range(12)] + [(3000, [], "e"), (3050, [], None)]
    return rows + [(None, [0.5] * 5, "n"), (1, None, "x"), (2, [None, 1.0, 1.0, 1.0, 1.0], "x"), (3, [NAN] * 5, "x"), (4, [INF, 0.0, 0.0, 0.0, 0.0], "x")]


def coded(df, **how):
    out = codes.compress(df, **how)
    return codes.with_label_error(out.rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect(), out.books


@pytest.mark.parametrize("entries", [256, 7, 1])
def test_codes_of_odd_rows_equal_plain_python(spark, entries):
    rows = odd_rows()
    got, books = coded(spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("?") for c in ("size", "code", "v", "_label", "_rows", "x")}), entries=entries)
    want, want_books = brute_codes(rows, entries)
    by_label = defaultdict(int)
    for _, _, e, l in want:
        by_label[l] += e
    sha = {s: hashlib.sha256(",".join(str(x) for p in b for e in p for x in e).encode()).hexdigest() for s, b in want_books.items()}
    assert {s: [[tuple(e) for e in p.tolist()] for p in b] for s, b in books.items()} == want_books
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == sorted((i is None, i or 0, c, e, by_label[l]) for i, c, e, l in want)
    assert {r["codebooks_sha256"] for r in got} == set(sha.values())


def test_codes_of_empty_and_useless_tables(spark):
    assert coded(spark.createDataFrame([], SCHEMA)) == ([], {})
    assert coded(spark.createDataFrame([(1, None, "a"), (2, [NAN], "b")], SCHEMA)) == ([], {})


def test_codes_do_not_depend_on_partitions_and_errors_shrink(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=8) + 3 * (k % 5)).tolist(), str(k % 3)) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = coded(df.repartition(7), entries=16), coded(df.coalesce(1), entries=16)
    assert sorted(a[0]) == sorted(b[0])
    total = [sum(r["error"] for r in coded(df, entries=16, rounds=k)[0]) for k in (0, 1, 4)]
    assert total[0] > total[1] > total[2]


def test_codes_refuse_numbers_beyond_64_bits(spark):
    with pytest.raises(Exception, match="64 bits"):
        coded(spark.createDataFrame([(1, [1e18, 0.0], "a")], SCHEMA))


def test_books_of_many_lengths_go_in_groups():
    assert list(codes.grouped([1, 2, 40_000, 5])) == [[1, 2], [40_000], [5]]


def found(df, **how):
    out = defaultdict(list)
    for r in topk.top_k(df, **how).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


@pytest.mark.parametrize("block,sample,wave", [(4096, 20_000, 65_536), (16, 40, 3)])
def test_top_k_of_odd_rows_equals_plain_python(spark, monkeypatch, block, sample, wave):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SAMPLE", sample)
    monkeypatch.setattr(topk, "WAVE", wave)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("?") for c in ("v", "leaf", "wave", "floor", "score", "rank", "_n")})
    want = {q: b for q, b in brute_top(rows).items() if b}
    assert found(df) == want


def test_top_k_of_few_and_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0], "a")], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0], "a"), (1, [2.0], "a"), (1, [2.0], "a")], SCHEMA)) == {0: [(1, 512 * 256)]}


def test_lists_end_before_they_are_read_through():
    """On clustered rows, the threshold leaves most rows unread, and what it finds is exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 400
    x = np.floor(centres[rng.integers(0, 20, 20_000)] + rng.normal(size=(20_000, 8)) * 20).astype(np.int64)
    ids = np.arange(len(x))
    q = x[:40]
    leaders = topk.Leaders(ids[:40], np.full(40, np.iinfo(np.int64).min), 5)
    group = topk.Tree(x[:4000].astype(float), len(x)).file(x.astype(float))
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        topk.Block(ids[at], x[at]).search(q, leaders, 0)
    for k in range(40):
        s = x @ q[k]
        s[k] = -(1 << 60)
        best = np.lexsort((ids, -s))[:5]
        own = leaders.query == k
        assert leaders.ids[own].tolist() == best.tolist() and leaders.scores[own].tolist() == s[best].tolist()
    assert leaders.shown < 0.3 * 40 * len(x)


def test_bounds_hold_at_every_rung():
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (500, 6))
    block, q = topk.Block(np.arange(500), x), rng.integers(-300, 300, (30, 6))
    bound, reach = block.bounds(q), block.reach(q)
    scores = q @ x.T
    assert (reach >= scores.max(axis=1)).all()
    for i in range(30):
        for rung, depth in enumerate(block.rungs.tolist()):
            shown = set()
            for d in range(6):
                shown |= set(block.order[:depth, d].tolist()) | set(block.order[500 - depth :, d].tolist())
            left = [r for r in range(500) if r not in shown]
            assert not left or scores[i, left].max() <= bound[i, rung]
