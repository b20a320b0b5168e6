"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric. Pivots are documents: each has a region, regions are dealt to the
Voronoi cells of further pivots, whoever lies within twice the radius of the border to another
cell is copied there, cells choose pivots of their own, and so on. Every pair within the radius
meets in a cell or at a pivot, so the join is exact.

Among millions of documents almost all distances are 1, and such a distance tells nothing: a pivot
can only divide the documents that share something with it. So a pivot's region are the documents
that hold one of the rare shingles for which it stands, and two documents within the radius share
one of their rarest few (all but the commonest 90 % of a set, for a similarity of 0.9). A
frequency sketch of all shingles, of bounded size, says which are rare; it only steers the work,
and any order gives the same links. Links come from distances to pivots and from the pairs that
pivots leave over in a cell, and each says from which.

Exact copies are merged before, by a 128-bit sum over the set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, flat_bytes, mixed, tidy
from .common import by_key, stored, table
from .graph import components

#: Words of a shingle and similarity in percent, where nothing else is asked for.
SHINGLE, PERCENT = 5, 80
#: Counters of the frequency sketch: a power of two between these, that follows the number of rows; and counters in one row of it.
COUNTERS, MOST_COUNTERS, CHUNK = 1 << 23, 1 << 26, 1 << 16
#: Shingles come in order of the leading bits of their number; only a leading band of them, this many
#: times as many as are chosen, is counted, so that counters are shared by few and common shingles can be left out.
BAND_TIMES = 2.5
#: Documents and shingles up to which a region is joined in one task.
REGION_DOCS, REGION_SHINGLES = 512, 500_000
#: Pivots of a round, rounds of a cell, documents up to which a cell isn't divided any more, and the share of
#: its pairs that its cells may hold together if it is.
PIVOTS, ROUNDS, SMALL, DIVIDED = 8, 16, 4, 0.8
#: Sets further than this from all pivots form a cell of their own, the outer one.
OUTER = 0.7
#: Rows of a few numbers up to which they are broadcast (some 32 MB); beyond, both sides are shuffled.
BROADCAST_IDS = 500_000
#: Text that is shingled at a time.
BLOCK = 1_000_000

_PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each row and its distinct shingles as sorted 64-bit numbers. A text of fewer words is one shingle."""
    raw, offsets = flat_bytes(column)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        words = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        h = words.hashes()
        n = max(0, len(h) - size + 1)
        gram = np.zeros(n, np.uint64)
        for k in range(size):
            gram = mixed(gram + h[k : k + n] * _PLACES[k % len(_PLACES)] + np.uint64(k))
        first = np.concatenate(([0], np.cumsum(words.counts)))
        for r in range(b - a):
            lo, hi = int(first[r]), int(first[r + 1])
            if hi - lo >= size:
                yield a + r, np.unique(gram[lo : hi - size + 1])
            elif hi > lo:
                short = np.array([hi - lo], np.uint64)
                for x in h[lo:hi]:
                    short = mixed(short * _PLACES[0] + x)
                yield a + r, short
            else:
                yield a + r, np.zeros(0, np.uint64)
        a = b


def digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mixed(s ^ c).sum().astype(np.int64)) for c in _PLACES[:2])


def banded(s: np.ndarray, percent: int) -> int:
    """How many of the sorted shingles lie in the counted band."""
    return int(np.searchsorted(s, np.uint64(int(min(0.999, BAND_TIMES * (1 - percent / 100)) * 2.0**64))))


def counter_of(s: np.ndarray, counters: int) -> np.ndarray:
    return (s & np.uint64(counters - 1)).astype(np.int64)


def counters_for(rows: int) -> int:
    """Counters of the sketch: eight rows of documents or fewer to a counter, within the bounds."""
    return min(MOST_COUNTERS, max(COUNTERS, 1 << max(0, rows // 8).bit_length()))


def summary(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, f1, f2) of every row, and the sketch: a level by counter, higher for frequent shingles.

    A task counts each set once. Counters stop at 255 within a task.
    """
    size_of_sketch = counters_for(docs.count())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = np.zeros(size_of_sketch, np.uint8), set()
        names = ["doc_id", "n", "f1", "f2", "chunk", "counts"]
        for batch in batches:
            n, f1, f2, new = [], [], [], []
            for _, s in shingle_sets(batch.column("_bytes"), size):
                key = digest(s)
                n.append(len(s)), f1.append(key[0]), f2.append(key[1])
                if key not in seen:
                    seen.add(key)
                    new.append(counter_of(s[: banded(s, percent)], size_of_sketch))
            if new:
                at, times = np.unique(np.concatenate(new), return_counts=True)
                counters[at] = np.minimum(counters[at] + times, 255)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for k in range(0, len(counters), CHUNK):
            part = counters[k : k + CHUNK]
            if part.any():
                row = [pa.nulls(1, pa.int64())] * 4 + [pa.array([k // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=names)
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_bytes"))
    both = stored(rows.mapInArrow(scan, "doc_id long, n long, f1 long, f2 long, chunk int, counts binary"), "jaccard-docs")

    def add(part: pa.Table) -> pa.Table:
        first = len(part.column("counts")[0].as_py()) == CHUNK  # bytes of a task, or sums of 4 bytes each
        total = np.zeros(CHUNK, np.int64)
        for x in part.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint8 if first else np.uint32)
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    parts = both.filter("chunk is not null")
    tasks = parts.groupBy("chunk").count().agg(F.max("count")).first()[0] or 1
    salt = F.pmod(F.spark_partition_id(), F.lit(int(np.ceil(np.sqrt(tasks)))))  # in two steps, so that no task gets all tasks' counters
    counts = parts.select("chunk", "counts", salt.alias("salt")).groupBy("chunk", "salt").applyInArrow(add, "chunk int, counts binary")
    counts = stored(counts.groupBy("chunk").applyInArrow(add, "chunk int, counts binary"), "jaccard-sketch")
    first = counts.orderBy("chunk").first()  # every chunk is a random part of the counters
    usual = max(1.0, float(np.median(np.frombuffer(bytes(first["counts"]), np.uint32)))) if first else 1.0

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.clip(np.round(4 * np.log2(np.maximum(np.frombuffer(x.as_py(), np.uint32), 1) / usual)), 0, 255).astype(np.uint8).tobytes() for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(found, pa.binary())], names=["chunk", "levels"])

    levels = np.zeros(size_of_sketch, np.uint8)
    for r in counts.mapInArrow(level, "chunk int, levels binary").toLocalIterator():  # MOST_COUNTERS bytes at most
        levels[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["levels"]), np.uint8)
    tidy()
    return both.filter("chunk is null").select("doc_id", "n", "f1", "f2"), levels


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n of which any set within the radius has one at least among its own first ones, in a common order."""
    return n - -(-percent * n // 100) + 1


def sent_size(n: int, percent: int) -> int:
    """Shingles of a set of n that are sent: a quarter more than :func:`prefix_size`, so that two within the radius share :func:`shared_least` of them."""
    k = prefix_size(n, percent)
    return k + -(-k // 4) - 1


def shared_least(n: Column, percent: int) -> Column:
    """How many of the sent shingles of a set of n any set within the radius, which has ``percent`` of its size at least, sends too."""
    least = F.ceil(n * percent / 100)
    return F.ceil((least - F.ceil(least * percent / 100) + 1) / 4)


def rare_shingles(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """(shingle, key, n): the rarest shingles of each set, enough that two within the radius share one.

    ``key`` is the first number of the set's digest. A task sends each set once, however many copies
    of it there are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        levels = sent.value
        for batch in batches:
            shingles, owners, sizes = [], [], []
            for _, s in shingle_sets(batch.column("_bytes"), size):
                if not len(s) or (key := digest(s)) in seen:
                    continue
                seen.add(key)
                k, band = sent_size(len(s), percent), s[: banded(s, percent)]
                order = np.argsort(levels[counter_of(band, len(levels))], kind="stable")[:k]  # by level, then by number
                part = np.concatenate((band[order], s[len(band) : len(band) + k - len(order)]))
                shingles.append(part.view(np.int64))
                owners.append(np.full(k, key[0]))
                sizes.append(np.full(k, len(s)))
            flat = np.concatenate(shingles) if shingles else np.zeros(0, np.int64)
            who = np.concatenate(owners).astype(np.int64) if owners else np.zeros(0, np.int64)
            n = np.concatenate(sizes).astype(np.int32) if sizes else np.zeros(0, np.int32)
            for a in range(0, len(flat), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]) for x in (flat, who, n)], names=["shingle", "key", "n"])
        tidy()

    rows = docs.filter("doc_id is not null").select(F.col("text").cast("binary").alias("_bytes"))
    return rows.mapInArrow(scan, "shingle long, key long, n int")


def pivot_regions(postings: DataFrame, percent: int) -> DataFrame:
    """(pivot, key, n): the regions that each set belongs to. Linear in the postings.

    Sets that share too few of their sent shingles with any others are left out: nobody is within the radius.
    Of all sets that hold a rare shingle the one with the least key is the pivot, and all of them
    belong to its region. Two sets within the radius share a rare shingle, so they meet in the
    region of its pivot. Sizes fall into classes so wide that similar sets are in one class or in
    neighbouring ones; every class with its successor has pivots of its own.
    """
    lists = postings.groupBy("shingle").agg(F.min("key").alias("_a"), F.max("key").alias("_b"), F.count("*").alias("_rows")).filter("_a < _b").select("shingle", "_rows")
    shared = stored(by_key(postings, stored(lists, "jaccard-lists"), ["shingle"]), "jaccard-shared")
    enough = shared.groupBy("key").agg(F.count("*").alias("_c"), F.max("n").alias("_m")).filter(F.col("_c") >= shared_least(F.col("_m"), percent)).select("key")
    shared = stored(shared.join(enough, "key", "left_semi"), "jaccard-shared")
    width = float(np.log(100 / percent) * (1 + 1e-9))
    own = F.floor(F.log("n") / width).cast("int")
    classed = shared.withColumn("_own", own).withColumn("class", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    heads = classed.groupBy("shingle", "class").agg(F.min("key").alias("pivot"), F.max("key").alias("_b"), F.max(F.col("class") == F.col("_own")).alias("_any"), F.count("*").alias("_rows")).filter("_any and pivot < _b").select("shingle", "class", "pivot", "_rows")
    return by_key(classed, stored(heads, "jaccard-heads"), ["shingle", "class"]).groupBy("pivot", "key").agg(F.max("n").alias("n"))


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)
        self.size = np.ones(n, np.int64)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return True

    def roots(self) -> np.ndarray:
        while (up := self.up[self.up]).tolist() != self.up.tolist():
            self.up = up
        return self.up


def windows(d: np.ndarray, radius: float) -> np.ndarray:
    """Which cells each set goes to, by its distances to the pivots (one row a pivot); the last row is the outer cell.

    If y is home at pivot j, no further than OUTER, and x is within the radius of y, then x is at most
    twice the radius further from j than from its own pivot, and at most the radius beyond OUTER:
    x is copied there. If neither has a pivot within OUTER, both are in the outer cell.
    """
    near = d.min(axis=0)
    return np.vstack([(d <= near + 2 * radius + 1e-9) & (d <= OUTER + radius + 1e-9), near > OUTER - radius - 1e-9])


#: What a link was found by: a distance to a pivot, or a pair of a cell that pivots don't divide any more.
BY_PIVOT, BY_PAIR = 0, 1


class Region:
    """Exact join of the sets of a region by pivots. Links inside what is already connected aren't looked for.

    The first set is the region's own pivot. Each round takes up to PIVOTS of them, the next always
    the most central one beyond the radius of those before, and measures all sets against them. If
    the Voronoi cells with their windows hold fewer pairs, the join goes on inside them with pivots of
    their own, else with further pivots of the same cell. ``work`` counts what was done.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, connected: np.ndarray | None = None):
        self.n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        self.tokens = np.unique(flat, return_inverse=True)[1]
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.mark = np.zeros(int(self.tokens.max()) + 1, np.int64)
        self.percent, self.radius = percent, 1 - percent / 100
        self.union = Union(len(sets))
        self.links: list[tuple[int, int, int, int]] = []
        self.work = {"pivots": 0, "cells": 0, "copies": 0, "depth": 0, "distances": 0, "pairs": 0}
        if connected is not None:
            for i in connected[1:]:
                self.union.join(int(connected[0]), int(i))

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Shingles that i shares with each of the others."""
        own = self.tokens[self.first[i] : self.first[i + 1]]
        self.mark[own] = 1
        size = self.n[others]
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        at = np.repeat(self.first[others] - start, size) + np.arange(int(size.sum()))
        out = np.add.reduceat(self.mark[self.tokens[at]], start)
        self.mark[own] = 0
        return out

    def compare(self, i: int, others: np.ndarray, how: int, depth: int) -> np.ndarray:
        """Distances from i; links it to all within the radius."""
        self.work["distances" if how == BY_PIVOT else "pairs"] += len(others)
        both = self.shared(i, others)
        either = self.n[i] + self.n[others] - both
        for j in others[100 * both >= self.percent * either]:
            if self.union.join(i, int(j)):
                self.links.append((i, int(j), how, depth))
        return 1 - both / either

    def spread(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of a cell that can have others within the radius, and how many sets of the cell hold their shingles on average.

        All others together are a set too, and whoever is further than the radius from its best part
        (the shingles that any other holds) is so from each of them.
        """
        size = self.n[cell]
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        tokens = self.tokens[np.repeat(self.first[cell] - start, size) + np.arange(int(size.sum()))]
        held = np.bincount(tokens)[tokens]
        near = 100 * np.add.reduceat((held > 1).astype(np.int64), start) >= self.percent * size
        return cell[near], (np.add.reduceat(held, start) / size)[near]

    def run(self, cell: np.ndarray, depth: int = 0) -> None:
        self.work["depth"] = max(self.work["depth"], depth)
        if len(cell) < 2 or self.one(cell):
            return
        cell, centrality = self.spread(cell)
        if len(cell) < 2:
            return
        far = np.full(len(cell), np.inf)
        rows, used = [], np.zeros(len(cell), bool)
        for _ in range(ROUNDS):
            for _ in range(PIVOTS):  # each next pivot is the most central set beyond the radius of those before
                open_ = far > self.radius
                if not open_.any() or self.one(cell):
                    break
                pick = 0 if not rows and not depth else int(np.argmax(np.where(open_, centrality, -1)))
                rows.append(self.compare(int(cell[pick]), cell, BY_PIVOT, depth))
                used[pick] = True
                far = np.minimum(far, rows[-1])
            if self.one(cell):
                break
            parts = windows(np.array(rows)[:, ~used], self.radius)  # pivots have met everyone
            sizes = parts.sum(axis=1)
            divides = (sizes * sizes).sum() <= DIVIDED * (~used).sum() ** 2
            if divides or not (far > self.radius).any():
                break
        self.work["pivots"] += len(rows)
        if self.one(cell):
            return
        d, cell = np.array(rows)[:, ~used], cell[~used]
        if len(cell) > SMALL and divides:
            self.work["cells"] += int((sizes > 0).sum())
            self.work["copies"] += int(sizes.sum()) - len(cell)
            for p in parts:
                self.run(cell[p], depth + 1)
        else:
            self.pairs(cell, d, depth)

    def one(self, cell: np.ndarray) -> bool:
        """Whether all are connected."""
        first = self.union.root(int(cell[0])) if len(cell) else 0
        return all(self.union.root(int(i)) == first for i in cell)

    def pairs(self, cell: np.ndarray, d: np.ndarray, depth: int) -> None:
        """All pairs of a cell whose distances to the pivots differ by the radius at most."""
        if len(cell) < 2:
            return
        roots = self.union.roots()[cell]
        _, inverse, count = np.unique(roots, return_inverse=True, return_counts=True)
        order = np.lexsort((inverse, count[inverse]))  # the largest connected part last: it needs no pairs inside
        cell, d, roots = cell[order], d[:, order], roots[order]
        stale = len(self.links)
        for k in range(len(cell) - 1):
            i, rest = int(cell[k]), cell[k + 1 :]
            if len(self.links) != stale:
                roots, stale = self.union.roots()[cell], len(self.links)
            ok = roots[k + 1 :] != roots[k]
            if not ok.any():
                continue
            low, high = np.minimum(self.n[i], self.n[rest]), np.maximum(self.n[i], self.n[rest])
            ok &= 100 * low >= self.percent * high
            ok &= (np.abs(d[:, k + 1 :] - d[:, k : k + 1]) <= self.radius + 1e-9).all(axis=0)
            if ok.any():
                self.compare(i, rest[ok], BY_PAIR, depth)


LINK = "a long, b long, how int, depth int"


def region_links(part: pa.Table, percent: int) -> pa.Table:
    """Links of one region; its own pivot, if it is there, comes first, and ``core`` sets are connected already."""
    nodes, firsts = np.unique(part.column("node").to_numpy(), return_index=True)  # a row that stands twice is one set
    pivot, keys = part.column("region")[0].as_py(), part.column("key").to_numpy()[firsts]
    order = np.argsort(keys != pivot, kind="stable")
    nodes, firsts = nodes[order], firsts[order]
    columns = [[], [], [], []]
    if len(nodes) > 1:
        core = np.flatnonzero(part.column("core").to_numpy(zero_copy_only=False)[firsts])
        sets = part.column("shingles")
        region = Region([unpacked(sets[int(k)].as_py()) for k in firsts], percent, core if len(core) > 1 else None)
        region.run(np.arange(len(nodes)))
        if region.links:
            a, b, how, depth = zip(*region.links)
            columns = [nodes[list(a)], nodes[list(b)], list(how), list(depth)]
    if len(nodes) > 64:
        tidy()
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64()), "how": pa.array(columns[2], pa.int32()), "depth": pa.array(columns[3], pa.int32())})


def packed(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def with_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(region, blocks, key, node, n, shingles): the sets of ``wanted`` (rep, n, f1, f2, node, regions), a row for each region."""
    side = wanted.withColumnRenamed("n", "_n")
    side = F.broadcast(side) if side.count() <= BROADCAST_IDS else side
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_bytes")).join(side, F.col("doc_id") == F.col("rep"))
    rows = rows.select("_bytes", "_n", "f1", "f2", "node", "regions")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, keep = [], []
            known = zip(batch.column("_n").to_pylist(), batch.column("f1").to_pylist(), batch.column("f2").to_pylist())
            for (row, s), (n, f1, f2) in zip(shingle_sets(batch.column("_bytes"), size), known):
                if len(s) == n and digest(s) == (f1, f2):  # an id may have other texts too
                    keep.append(row)
                    sets.append(packed(s))
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("regions"), own.column("f1"), own.column("node"), own.column("_n"), pa.array(sets, pa.binary())], names=["regions", "key", "node", "n", "shingles"])
        tidy()

    found = rows.mapInArrow(scan, "regions array<struct<region:long,blocks:int>>, key long, node long, n long, shingles binary")
    return found.select(F.inline("regions"), "key", "node", "n", "shingles")


def dealt(inside: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Deals the sets of large regions out to tasks of bounded size: (links to pivots, rows with a ``cell`` of their own).

    The region's blocks are measured against its pivots apart from each other, so a region of any
    size is many tasks. Sets go to their Voronoi cell and, by the windows, to those within twice the
    radius. Sets within the radius of the cell's pivot (its core) are linked to it and need no
    comparison among each other: blocks of the others meet all blocks of the core and each other.
    """
    radius = 1 - percent / 100
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    salted = inside.groupBy("region", "blocks", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("_p")).agg(F.min(F.struct(F.when(F.col("key") == F.col("region"), 0).otherwise(1).alias("o"), "key", "node", "shingles")).alias("x"))
    pivots = salted.groupBy("region", "blocks").agg(F.sort_array(F.collect_list("x")).alias("pivots"))  # at most PIVOTS sets a region
    pivots = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_block"), "pivots.node", "pivots.shingles").toDF("_region", "_block", "pivot_nodes", "pivots")
    rows = inside.withColumn("_b", block).join(pivots, (F.col("region") == F.col("_region")) & (F.col("_b") == F.col("_block")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for region, key, node, n, mine, names, others in zip(*(batch.column(c).to_pylist() for c in ("region", "key", "node", "n", "shingles", "pivot_nodes", "pivots"))):
                s, d = unpacked(mine), []
                for other in others:
                    o = unpacked(other)
                    both = len(np.intersect1d(s, o, assume_unique=True))
                    d.append(1.0 - both / (len(s) + len(o) - both) if 100 * both < percent * (len(s) + len(o) - both) else min(radius, 1.0 - both / (len(s) + len(o) - both)))
                near = [m for m, x in zip(names, d) if x <= radius and m != node]
                for k, j in enumerate(np.flatnonzero(windows(np.array([d]).T, radius)[:, 0])):
                    out.append((region, int(j), key, node, n, mine, bool(j < len(d) and d[j] <= radius), near if not k else []))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["region", "cell", "key", "node", "n", "shingles", "core", "near"])

    cells = stored(rows.mapInArrow(place, "region long, cell int, key long, node long, n long, shingles binary, core boolean, near array<long>"), "jaccard-cells")
    links = cells.select(F.col("node").alias("a"), F.explode("near").alias("b"), F.lit(BY_PIVOT).alias("how"), F.lit(0).alias("depth"))
    blocks = lambda c: F.ceil(F.greatest(F.count_if(c) / REGION_DOCS, F.sum(F.when(c, F.col("n")).otherwise(0)) / REGION_SHINGLES)).cast("int")
    sums = stored(cells.groupBy("region", "cell").agg(blocks(F.col("core")).alias("_cores"), blocks(~F.col("core")).alias("_rests"), F.count("*").alias("_rows")).filter("_rests > 0"), "jaccard-blocks")
    met = by_key(cells.drop("near"), sums, ["region", "cell"]).withColumn("_b", F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("_cores")).otherwise(F.col("_rests"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    none = F.array().cast("array<struct<x:int,y:int>>")
    with_core = F.when(F.col("_cores") > 0, F.transform(upto(F.col("_cores")), lambda c: pair(F.col("_b"), -1 - c))).otherwise(none)
    with_rest = F.when((F.col("_rests") > 1) | (F.col("_cores") == 0), F.transform(upto(F.col("_rests")), lambda j: pair(F.least("_b", j), F.greatest("_b", j)))).otherwise(none)
    keys = F.when(F.col("core"), F.transform(upto(F.col("_rests")), lambda i: pair(i, -1 - F.col("_b")))).otherwise(F.concat(with_core, with_rest))
    met = met.withColumn("_k", F.explode(keys))
    return links, met.select("region", F.xxhash64("cell", "_k").alias("cell"), "key", "node", "n", "shingles", "core")


def found_links(docs: DataFrame, classes: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """Links (a, b: nodes; how, depth) that connect all sets within the radius; ``classes``: rep, n, f1, f2, node."""
    postings = stored(rare_shingles(docs, levels, size, percent), "jaccard-postings")
    regions = stored(pivot_regions(postings, percent), "jaccard-regions")
    blocks = F.ceil(F.greatest(F.count("*") / REGION_DOCS, F.sum("n") / REGION_SHINGLES)).cast("int")
    weights = stored(regions.groupBy("pivot").agg(blocks.alias("blocks"), F.count("*").alias("_rows")), "jaccard-weights")
    mine = by_key(regions, weights, ["pivot"]).groupBy("key").agg(F.collect_list(F.struct(F.col("pivot").alias("region"), "blocks")).alias("regions"))  # at most one for each shingle of a set
    wanted = stored(mine.join(classes, F.col("key") == F.col("f1")).select("rep", "n", "f1", "f2", "node", "regions"), "jaccard-wanted")

    def some(ok: Callable[[Column], Column]) -> DataFrame:
        return wanted.withColumn("regions", F.filter("regions", ok)).filter(F.size("regions") > 0)

    sets = with_sets(docs, some(lambda x: x["blocks"] <= 1), size).select("region", F.lit(0).cast("long").alias("cell"), "key", "node", "n", "shingles", F.lit(False).alias("core"))
    large = some(lambda x: x["blocks"] > 1)
    links = None
    if not large.isEmpty():
        links, cells = dealt(stored(with_sets(docs, large, size), "jaccard-sets"), percent)
        sets = sets.unionByName(cells)
    inner = sets.groupBy("region", "cell").applyInArrow(lambda part: region_links(part, percent), LINK)
    return inner if links is None else inner.unionByName(links)


def classed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, f1, f2), their distinct sets (rep, n, f1, f2, node, _rows) and the links between those."""
    tidy()
    slim, levels = summary(docs, size, percent)
    full = slim.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_rows"))
    classes = stored(classes.withColumn("node", F.xxhash64("n", "f1", "f2")), "jaccard-classes")
    return slim, classes, stored(found_links(docs, classes, levels, size, percent), "jaccard-links")


def row_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, f1, f2, component_id for every row; rows of one id are judged by their own text."""
    slim, classes, links = classed(docs, size, percent)
    named = classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "jaccard-named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("_many")).filter("_many > 1").withColumnRenamed("_many", "_rows")
    several = by_key(named.withColumnRenamed("_rows", "_copies"), stored(least, "jaccard-least"), ["component"]).select("n", "f1", "f2", "component_id", F.col("_copies").alias("_rows"))
    # a set alone is named by its rows' smallest id, which differs from a row's own only where there are copies
    alone = named.filter("_rows > 1").join(least, "component", "left_anti").select("n", "f1", "f2", F.col("rep").alias("component_id"), "_rows")
    found = by_key(slim, stored(several.unionByName(alone), "jaccard-components"), ["n", "f1", "f2"], how="left")
    return found.select("doc_id", "n", "f1", "f2", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Words are what stands between blanks and the controls from tab to carriage return, A-Z in lower
    case. A text of fewer than ``size`` words is one shingle; null texts and texts without words
    have none and are linked with nothing; rows without doc_id have a null component. Documents
    whose sets are similar by ``percent`` or more are linked, and a component carries its smallest
    doc_id. Copies, also repeated rows, are in one component; rows that share an id but not their
    text are linked by their texts alone. An empty table gives none. Only doc_id and text are read.
    """
    found = row_components(docs, size, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def with_digests(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with n, f1 and f2 of every row's set, as _n, _f1 and _f2."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _n long, _f1 long, _f2 long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *digest(s)) for _, s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[k] for f in found], pa.int64()) for k in range(3)]], names=[*names, "_n", "_f1", "_f2"])

    return docs.mapInArrow(scan, schema)


def without_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one document (the smallest id) of each component.

    Rows without doc_id stay. Of rows that repeat an id and its text (as a set of shingles) one stays;
    rows that share an id but not the text are judged each by their own text.
    """
    found = stored(row_components(docs, size, percent), "jaccard-found").filter("doc_id is not null")
    gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "jaccard-gone")
    again = stored(found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again")), "jaccard-again")

    def less(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return rows.join(side, F.col("doc_id") == F.col(ids.columns[0]), how)

    if again.isEmpty():
        return less(docs, gone, "left_anti")
    once = less(less(docs, again, "left_anti"), gone, "left_anti")
    several = with_digests(less(docs, again, "left_semi"), size).dropDuplicates(["doc_id", "_n", "_f1", "_f2"])
    bad = less(found, again, "left_semi").filter("doc_id <> component_id").select(F.col("doc_id").alias("_d"), F.col("n").alias("_an"), F.col("f1").alias("_a1"), F.col("f2").alias("_a2")).distinct()
    stay = several.join(bad, (F.col("doc_id") == F.col("_d")) & (F.col("_n") == F.col("_an")) & (F.col("_f1") == F.col("_a1")) & (F.col("_f2") == F.col("_a2")), "left_anti")
    return once.unionByName(stay.drop("_n", "_f1", "_f2"))
