"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Rows are dealt into blocks of similar vectors, and each block keeps a list for every dimension,
sorted by that component. The lists are read from both ends in lockstep, for many queries at a time:
every row that a list shows is scored in full, and a query's bound is what a row not yet shown could
score at most, given how far each list has come from the end that helps this query. Once the bound
is below its k-th best score, the rest of the block can't matter to it. The k-th best of a sample is known from the start, so most blocks
end before their lists are read. Nothing is approximate: blocks and sample decide on the work only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codes import finite
from .common import HASH_BITS, key_hash, stored, table
from .neighbours import SAMPLE, SAMPLE_NUMBERS, Tree, matrix

#: Results of each query, the queries (ids divisible by EVERY), and units of a component.
BEST, EVERY, UNITS = 5, 50, 256
#: Rows of a block at most; queries, and their numbers, that are sent to the tasks at a time.
BLOCK, WAVE, WAVE_NUMBERS = 4096, 65_536, 4_000_000
#: Queries whose bounds are computed together.
CHUNK = 2048
#: Rows of the index, and queries, in a partition, about.
PART_ROWS, PART_QUERIES = 8192, 512
#: How much deeper the lists are read before the bound is looked at again.
STEP = 4


class Leaders:
    """The k best ids of every query so far, as flat arrays in order of query, falling score, rising id."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int):
        #: A result below a query's floor can't be among its best.
        self.own, self.floor, self.k = own, floor.copy(), k
        self.query, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        #: Scores computed.
        self.shown = 0

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, repeats: int) -> None:
        """Scores of rows (columns) for some queries (rows); among the rows are ``repeats`` more than ids."""
        self.shown += scores.size
        floor = self.floor[queries]
        most = self.k + 1 + repeats  # the query's own row, and repeats of an id, may stand among the first
        if scores.shape[1] > most:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most])
        at, row = np.nonzero((scores >= floor[:, None]) & (ids[None, :] != self.own[queries][:, None]))
        if not len(at):
            return
        touched = np.zeros(len(self.own), bool)
        touched[queries[at]] = True
        old = touched[self.query]
        q, i, s = (np.concatenate(x) for x in ((self.query[old], queries[at]), (self.ids[old], ids[row]), (self.scores[old], scores[at, row].astype(np.int64))))
        order = np.lexsort((-s, i, q))  # an id counts once, with its best score
        q, i, s = q[order], i[order], s[order]
        once = np.concatenate(([True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])))
        q, i, s = q[once], i[once], s[once]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        best = place < self.k
        q, i, s = (np.concatenate(x) for x in ((self.query[~old], q[best]), (self.ids[~old], i[best]), (self.scores[~old], s[best])))
        order = np.lexsort((i, -s, q))
        self.query, self.ids, self.scores = q[order], i[order], s[order]


class Block:
    """Rows with a list for every dimension, sorted by that component; ``x`` holds whole numbers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.repeats = len(ids) - len(np.unique(ids))
        n, depth, rungs = len(ids), 1, [0]
        while depth < n:
            rungs.append(depth)
            depth *= STEP
        #: Rows that each list has shown from either end when the bound is looked at.
        self.rungs = np.array(rungs, np.int64)
        self.order = np.argsort(x, axis=0, kind="stable")
        sorted_x = np.take_along_axis(x, self.order, axis=0)
        #: What the lists show next at every rung, from the low and the high end.
        self.low, self.high = sorted_x[self.rungs], sorted_x[n - 1 - self.rungs]
        self.centre = x.mean(axis=0)
        self.radius = float(np.sqrt(((x - self.centre) ** 2).sum(axis=1).max()))
        self.peak = int(np.abs(x).max(initial=0))

    def kind(self, q: np.ndarray) -> type:
        """Doubles where every sum of products is exact in them, as they multiply faster."""
        return np.float64 if max(1, self.peak) * max(1, int(np.abs(q).max(initial=0))) * max(1, q.shape[1]) < 2**52 else np.int64

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and rung the most that a row not yet shown can score."""
        kind = self.kind(q)
        return np.maximum(q, 0).astype(kind) @ self.high.T.astype(kind) + np.minimum(q, 0).astype(kind) @ self.low.T.astype(kind)

    def reach(self, q: np.ndarray) -> np.ndarray:
        """The most that any row can score by its distance from the centre, rounded up."""
        length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        far = q @ self.centre + length * self.radius
        return far + 1 + np.abs(far) * 1e-9 + length * (np.abs(self.centre).sum() + self.radius) * 1e-9

    def search(self, q: np.ndarray, leaders: Leaders, first: int) -> None:
        """Offers ``leaders`` every row of the block that can be among the best of the queries ``first`` and on.

        The lists are read for all of these together: a row that any list shows is scored for every
        query still at it, each of which stops by its own bound.
        """
        n, bound = len(self.ids), self.bounds(q)
        floor = leaders.floor[first : first + len(q)]
        at = np.flatnonzero((bound[:, 0] >= floor) & (self.reach(q) >= floor))
        if not len(at):
            return
        kind, seen = self.kind(q), np.zeros(n, bool)
        for rung, depth in enumerate(self.rungs.tolist()):
            at = at[bound[at, rung] >= leaders.floor[first + at]]
            if not len(at):
                return
            upto = int(self.rungs[rung + 1]) if rung + 1 < len(self.rungs) else n
            new = np.ones(n, bool)
            if upto < n:
                new[:] = False
                new[self.order[depth:upto].ravel()] = True
                new[self.order[n - upto : n - depth].ravel()] = True
            new &= ~seen
            seen |= new
            rows = np.flatnonzero(new)
            if len(rows):
                leaders.offer(first + at, self.ids[rows], q[at].astype(kind) @ self.x[rows].T.astype(kind), self.repeats)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Runs of rows of one leaf, BLOCK at most."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last, n = None, 0

    def built() -> Block:
        return Block(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))

    for batch in batches:
        if not batch.num_rows:
            continue
        leaf, ids, x = batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy(), whole(batch.column("v"))
        cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
        for a, z in zip(cuts, cuts[1:]):
            while a < z:
                if held and (leaf[a] != last or n == BLOCK):
                    yield built()
                    held, n = [], 0
                take = min(z - a, BLOCK - n)
                held.append((ids[a : a + take], x[a : a + take]))
                last, n, a = leaf[a], n + take, a + take
    if held:
        yield built()


def whole(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def top_k(vectors: DataFrame, every: int = EVERY, k: int = BEST, units: int = UNITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the highest inner product with each query.

    ``vectors`` has vec_id and embedding (an array of numbers); other columns are not read. Queries
    are the rows whose vec_id is divisible by ``every``; all rows but those of the query's own id
    are candidates. Components become floor(units * x). Ties go to the smaller id. Rows whose id is
    null, or whose vector is null or holds a null or non-finite component, take no part. Vectors
    meet those of their own length only. Rows of one id are one candidate with its best score, and
    one query with its smallest vector. With fewer candidates than k all are returned; an empty
    table gives no rows. Numbers whose products exceed 64 bits raise an error.
    """
    spark = vectors.sparkSession
    number = lambda v: F.floor(v.cast("double") * units).cast("long")
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", number).alias("v"))
    # of equal vectors only the k + 1 smallest ids can be among anyone's best
    smallest = Window.partitionBy("v").orderBy("vec_id")
    kept = stored(rows.dropDuplicates(["vec_id", "v"]).withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= k + 1).drop("_n"), "topk-rows")
    peaks = kept.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("peak")).orderBy("size")
    queries = stored(rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "topk-queries")
    asked = {r["size"]: r["count"] for r in queries.groupBy(F.size("v").alias("size")).count().toLocalIterator()}
    found = None
    for r in peaks.collect():  # one row a length of vectors
        if r["size"] in asked:
            if (r["peak"] or 0) ** 2 * max(1, r["size"]) >= 2**62:
                raise OverflowError("components are too large for products of 64 bits")
            own = of_length(spark, kept.filter(F.size("v") == r["size"]), queries.filter(F.size("v") == r["size"]), r["size"], r["n"], asked[r["size"]], k)
            found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def of_length(spark: SparkSession, kept: DataFrame, queries: DataFrame, size: int, n: int, n_queries: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the best rows of every part of the index, for vectors of one length."""
    sc = spark.sparkContext
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // max(size, 1)))
    picked = kept if n <= most else kept.filter(key_hash(F.col("vec_id"), "topk") < int((1 << HASH_BITS) * (most / n)))
    sample = picked.orderBy("vec_id", "v").collect()  # about `most` rows
    ids, x = np.array([r["vec_id"] for r in sample], np.int64), np.array([r["v"] for r in sample], np.int64).reshape(len(sample), size)
    grown = Tree(x.astype(float) if size else np.zeros((len(x), 1)), n)
    tree = sc.broadcast(grown)
    known = sc.broadcast((ids, x, grown.file(x.astype(float)) if size and len(x) else np.zeros(len(x), np.int64)))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.file(matrix(batch.column("v"))) if batch.num_rows and size else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("vec_id"), batch.column("v")], names=["leaf", "vec_id", "v"])

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th best score among the sample, where it has that many others."""
        ids, x, leaf = known.value
        order = np.argsort(leaf, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(leaf[order])) + 1).tolist(), len(order)]
        sampled = [Block(ids[order[a:z]], x[order[a:z]]) for a, z in zip(cuts, cuts[1:]) if a < z]
        for batch in batches:
            own, q = batch.column("query_id").to_numpy(), whole(batch.column("v"))
            leaders = Leaders(own, np.full(len(own), np.iinfo(np.int64).min), k)
            for block in sampled:
                block.search(q, leaders, 0)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), pa.array(leaders.floor)], names=["query_id", "v", "floor"])

    placed = stored(kept.mapInArrow(filed, "leaf long, vec_id long, v array<long>"), "topk-filed")
    index = stored(placed.repartitionByRange(max(1, -(-n // PART_ROWS)), "leaf", "vec_id").sortWithinPartitions("leaf", "vec_id"), "topk-index")
    wave = max(1, min(WAVE, WAVE_NUMBERS // max(size, 1)))
    n_waves = -(-n_queries // wave)
    asked = stored(queries.repartition(max(1, -(-n_queries // PART_QUERIES)), "query_id").mapInArrow(floored, "query_id long, v array<long>, floor long").withColumn("wave", F.pmod(F.xxhash64("query_id"), F.lit(n_waves))), "topk-asked")
    found = None
    for w in range(n_waves):
        some = asked.filter(F.col("wave") == w).toArrow()  # about `wave` queries
        sent = sc.broadcast((some.column("query_id").to_numpy(), whole(some.column("v").combine_chunks()), some.column("floor").to_numpy()))

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, q, floor = sent.value
            leaders = Leaders(own, floor, k)
            for block in blocks(batches):
                for first in range(0, len(own), CHUNK):
                    block.search(q[first : first + CHUNK], leaders, first)
            yield pa.RecordBatch.from_arrays([pa.array(own[leaders.query]), pa.array(leaders.ids), pa.array(leaders.scores)], names=["query_id", "vec_id", "score"])

        part = stored(index.mapInArrow(searched, "query_id long, vec_id long, score long"), "topk-found")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score over all of ``embeddings``."""
    return top_k(table(spark, sf_dir, "embeddings"))
