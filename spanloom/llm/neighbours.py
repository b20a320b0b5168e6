"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then filed under a leaf. A query walks the
tree best bin first: a priority queue holds the nodes met so far by their distance, the nearest is
opened next, and leaves come out in the order in which they promise neighbours. How many leaves
are visited is calibrated on held-out rows of the sample: the visits widen until recall there
reaches TARGET. Leaves are cut into blocks of bounded size, on the side of the rows and on that of
the queries, so a crowded leaf is many tasks. Scores are exact cosines of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HASH_BITS, key_hash, stored, table

#: Neighbours of each query, and the queries: ids divisible by EVERY.
NEAREST, EVERY = 5, 50
#: Rows and numbers that the tree is fitted on at most (up to chance), a sample by hash of the id.
SAMPLE, SAMPLE_NUMBERS = 20_000, 4_000_000
#: Children of a node, rows of a leaf aimed at, sample rows of a leaf at least, and rounds of k-means.
BRANCHES, LEAF, LEAF_SAMPLE, ROUNDS = 8, 500, 16, 12
#: One in so many rows of the sample is held out of the fit; held-out queries, and the recall at which visits stop widening.
HELD_OUT, TRIALS, TARGET = 10, 400, 0.95
#: Rows and queries of a block.
BLOCK, QUERY_BLOCK = 4096, 2048
#: Scores this close to the last of a block are computed again exactly before any is dropped.
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Nodes with a centre each; leaves have numbers, inner nodes have children."""

    def __init__(self, sample: np.ndarray, n_rows: int, seed: int = 7):
        self.centres, self.children, self.leaf = [], [], []
        self.rng = np.random.default_rng(seed)
        self.n_leaves = 0
        scale = n_rows / max(len(sample), 1)
        self._grow(sample, scale)
        self.table = np.array(self.centres)

    def _grow(self, x: np.ndarray, scale: float) -> int:
        me = len(self.centres)
        centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        k = int(min(BRANCHES, np.ceil(len(x) * scale / LEAF), len(x) // LEAF_SAMPLE))
        groups = self._split(x, k) if k > 1 else []
        if len(groups) < 2:
            self.leaf[me] = self.n_leaves
            self.n_leaves += 1
        else:
            self.children[me] = [self._grow(g, scale) for g in groups]
        return me

    def _split(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        centres = x[self.rng.choice(len(x), 1)]
        far = ((x - centres[0]) ** 2).sum(axis=1)
        while len(centres) < k and far.sum() > 0:  # spread the first centres out
            centres = np.vstack([centres, x[self.rng.choice(len(x), p=far / far.sum())]])
            far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        for _ in range(ROUNDS):
            own = self._nearest(x, centres)
            centres = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        own = self._nearest(x, centres)
        return [x[own == j] for j in range(len(centres)) if (own == j).any()]

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child all the way down."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            own = self._nearest(x[rows], self.table[kids])
            todo += [(kids[j], rows[own == j]) for j in range(len(kids)) if (own == j).any()]
        return out

    def visits(self, x: np.ndarray) -> Iterator[Iterator[int]]:
        """For each query its leaves, best bin first."""
        far = ((self.table**2).sum(axis=1) - 2 * x @ self.table.T) if len(x) else np.zeros((0, len(self.table)))
        for d in far:
            yield self._walk(d)

    def _walk(self, d: np.ndarray) -> Iterator[int]:
        queue = [(d[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (d[kid], kid))


def calibrated(tree: Tree, sample: np.ndarray, held: np.ndarray, k: int = NEAREST, target: float = TARGET) -> int:
    """Leaves to visit: the fewest at which recall of ``held`` rows, which the tree wasn't fitted on, among ``sample`` reaches ``target``."""
    n = min(TRIALS, len(held))
    if not n or len(sample) < k or tree.n_leaves == 1:
        return tree.n_leaves
    asked = held[np.linspace(0, len(held) - 1, n).astype(int)]
    best = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
    leaf = tree.file(sample)
    need = np.zeros((n, k), np.int64)  # visits that reach each true neighbour
    for i, walk in enumerate(tree.visits(asked)):
        place = np.zeros(tree.n_leaves, np.int64)
        for step, l in enumerate(walk):
            place[l] = step + 1
        need[i] = place[leaf[best[i]]]
    return int(np.sort(need.ravel())[int(np.ceil(target * need.size)) - 1])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: str) -> Column:
    """No null or non-finite component, and not all zero."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return x.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda v: v != 0)


def top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """For every query its k best ids of a block, each with its best row: number of the query, id, score. Ties go to smaller ids."""
    ql, xl = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    rough = (q / ql[:, None]) @ (x / xl[:, None]).T
    rough[own[:, None] == ids[None, :]] = -3.0
    each, number = np.unique(ids, return_inverse=True)
    by_id = rough
    if len(each) < len(ids):  # several rows of an id are one candidate
        order = np.argsort(number, kind="stable")
        by_id = np.maximum.reduceat(rough[:, order], np.searchsorted(number[order], np.arange(len(each))), axis=1)
    least = np.partition(by_id, max(0, len(each) - k), axis=1)[:, max(0, len(each) - k)] - SLACK
    a, b, c = [], [], []
    for i in range(len(q)):
        at = np.flatnonzero((rough[i] >= least[i]) & (rough[i] > -2.0))
        exact = (x[at] * q[i]).sum(axis=1) / (xl[at] * ql[i])
        order = np.lexsort((ids[at], -exact))
        if len(each) < len(ids):
            order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
        order = order[:k]
        a += [i] * len(order)
        b += ids[at][order].tolist()
        c += exact[order].tolist()
    return a, b, c


def search(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, nearest first.

    Vectors that are null, zero, or hold null or non-finite components take no part. Vectors meet
    those of their own length only; each length has a tree of its own.
    Rows of one id count as one candidate with its best score, and as one query with the smallest
    vector; a query is no candidate of its own. Of rows with the same vector only the k + 1 with
    the smallest ids can be among anyone's nearest, so the rest aren't compared. A table with
    fewer candidates gives all of them; an empty one gives none. Only vec_id and embedding are read.
    """
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count_if(F.col("vec_id") % every == 0).alias("asked")).filter("asked > 0").orderBy("size").collect()  # one row a length
    found = [search_length(rows.filter(F.size("v") == r["size"]), r["size"], every, k) for r in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_length(rows: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the best rows in each block of the leaves that a query visits, for (vec_id, v) of one length."""
    by_vector = Window.partitionBy(F.xxhash64("v"), F.col("v")[0]).orderBy("vec_id")
    distinct = rows.dropDuplicates(["vec_id", "v"])  # the cap below counts ids, so repeated rows must not fill it
    first = stored(distinct.withColumn("_n", F.row_number().over(by_vector)).filter(F.col("_n") <= k + 1).drop("_n"), "ann-rows")
    n = first.count()
    most = min(SAMPLE, SAMPLE_NUMBERS // dim)
    picked = first if n <= most else first.filter(key_hash(F.col("vec_id"), "ann") < int((1 << HASH_BITS) * (most / n)))
    sample = units(np.array([r["v"] for r in picked.orderBy("vec_id").collect()], float).reshape(-1, dim))
    out = np.arange(len(sample)) % HELD_OUT == 0
    tree = Tree(sample[~out], n)
    visits = calibrated(tree, sample[~out], sample[out], k)
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(tree)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.file(units(matrix(batch.column("v")))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf)], names=["vec_id", "v", "leaf"])

    index = stored(first.mapInArrow(filed, "vec_id long, v array<double>, leaf long"), "ann-index")
    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row a leaf of the bounded tree
    rows_in = sc.broadcast([held.get(l, 0) for l in range(tree.n_leaves)])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = []
            for walk in sent.value.visits(units(matrix(batch.column("v")))) if batch.num_rows else []:
                seen, met = [], 0
                for leaf in walk:
                    if len(seen) >= visits and met > 8 * (k + 1):
                        break
                    seen.append(leaf)
                    met += rows_in.value[leaf]
                leaves.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), pa.array(leaves, pa.list_(pa.int64()))], names=["query_id", "v", "leaves"])

    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    visited = stored(queries.mapInArrow(walked, "query_id long, v array<double>, leaves array<long>"), "ann-visits").select("query_id", "v", F.explode("leaves").alias("leaf"))
    asked = {r["leaf"]: r["count"] for r in visited.groupBy("leaf").count().collect()}
    blocks = F.array(*[F.lit(-(-held.get(l, 0) // BLOCK)) for l in range(tree.n_leaves)])
    query_blocks = F.array(*[F.lit(max(1, -(-asked.get(l, 0) // QUERY_BLOCK))) for l in range(tree.n_leaves)])
    leaf = F.col("leaf").cast("int")
    left = index.withColumn("block", F.pmod(F.hash("vec_id"), F.get(blocks, leaf))).withColumn("part", F.explode(F.sequence(F.lit(0), F.get(query_blocks, leaf) - 1)))
    right = visited.filter(F.get(blocks, leaf) > 0).withColumn("part", F.pmod(F.hash("query_id"), F.get(query_blocks, leaf))).withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, leaf) - 1)))

    def compare(xs: pa.Table, qs: pa.Table) -> pa.Table:
        if not xs.num_rows or not qs.num_rows:
            a, b, c, own = [], [], [], np.zeros(0, np.int64)
        else:
            own = qs.column("query_id").to_numpy()
            a, b, c = top(matrix(qs.column("v")), matrix(xs.column("v")), xs.column("vec_id").to_numpy(), own, k)
        return pa.table({"query_id": pa.array(own[a] if len(a) else [], pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    keys = ("leaf", "block", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
