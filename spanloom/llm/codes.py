"""Product codes of vectors: every part of a vector becomes the index of its nearest codebook entry.

Vectors turn into whole numbers and are stored once as columnar blocks: a block holds some vectors
of one length, dimension by dimension. Each round is one ``treeAggregate`` over these blocks. A
task adds up distances one dimension after the other, ``np.add.at`` gathers int64 sums and counts
of each entry, and the tensors merge through a reduction tree, so what reaches the driver are a few
tensors of the codebooks' own size, whatever the number of vectors. Sums of whole numbers don't
depend on their order, so reruns and recomputed tasks agree to the last digit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, stored, table

#: Units of a component, parts of a vector, entries of a codebook, and rounds.
UNITS, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a block at most, and the levels of the reduction tree.
BLOCK, DEPTH = 1024, 3
#: Dimensions of all lengths whose codebooks are fitted together; more lengths take further passes.
TOGETHER = 32_768

Books = dict[int, list[np.ndarray]]


def finite(vector: str) -> Column:
    """The vector is there and holds no null, NaN or infinite component. An empty one holds none."""
    fine = F.forall(F.col(vector), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def bounds(size: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and the end; lengths that don't divide give parts as even as can be."""
    return [i * size // parts for i in range(parts + 1)]


def columnar(batches: Iterator[pa.RecordBatch], units: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: ids, labels, the largest absolute number, and the numbers as bytes, dimension by dimension."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            some = batch.slice(first, BLOCK)
            vectors = some.column("v")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for size in np.unique(sizes).tolist():
                own = pa.array(np.flatnonzero(sizes == size))
                flat = vectors.take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(flat * units).reshape(len(own), size).T
                peak = float(np.abs(x).max()) if x.size else 0.0
                if 4.0 * peak * peak * max(size, 1) >= 2.0**62:
                    raise OverflowError("components are too large for distances of 64 bits")
                x = np.ascontiguousarray(x, np.int32 if peak < 2**31 else np.int64)
                lists = [pa.array([some.column(c).take(own).to_pylist()], pa.list_(some.schema.field(c).type)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([int(peak)]), *lists, pa.array([x.itemsize], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["size", "peak", "ids", "labels", "width", "x"])


def numbers(size: int, width: int, x: bytes) -> np.ndarray:
    """A block's numbers: a row a dimension."""
    flat = np.frombuffer(x, np.int32 if width == 4 else np.int64)
    return flat.reshape(size, -1) if size else np.zeros((0, 0), np.int32)


def nearest(x: np.ndarray, book: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to each column's nearest entry, the first of equal ones. Distances grow dimension by dimension."""
    far = np.zeros((x.shape[1], len(book)), kind)
    step = np.empty_like(far)
    for values, entries in zip(x.astype(kind), book.T.astype(kind)):
        np.subtract(values[:, None], entries[None, :], out=step)
        np.multiply(step, step, out=step)
        far += step
    at = far.argmin(axis=1)
    return at, far[np.arange(len(at)), at]


@dataclass
class First:
    """Of every length the first vectors by id, as they start the codebooks, and the largest number met."""

    entries: int
    rows: dict[int, list[tuple]] = field(default_factory=dict)
    peak: dict[int, int] = field(default_factory=dict)

    def add(self, block: tuple) -> First:
        size, peak, ids, width, x = block
        keys = [(i is None, 0 if i is None else i) for i in ids]
        last = sorted(keys)[: self.entries][-1]
        columns = numbers(size, width, x)
        self._keep(size, [(key, tuple(columns[:, k].tolist()) if size else ()) for k, key in enumerate(keys) if key <= last])
        self.peak[size] = max(self.peak.get(size, 0), peak)
        return self

    def merge(self, other: First) -> First:
        for size, rows in other.rows.items():
            self._keep(size, rows)
            self.peak[size] = max(self.peak.get(size, 0), other.peak[size])
        return self

    def _keep(self, size: int, more: list[tuple]) -> None:
        self.rows[size] = sorted(self.rows.get(size, []) + more)[: self.entries]


@dataclass
class Sums:
    """int64 sums and counts of the vectors of each entry, by length and part."""

    of: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)

    def add(self, block: tuple, books: Books, kinds: dict[int, type]) -> Sums:
        size, _, _, width, x = block
        if size not in books:
            return self
        x, edges = numbers(size, width, x), bounds(size, len(books[size]))
        if size not in self.of:
            self.of[size] = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books[size]]
        for (sums, counts), book, a, z in zip(self.of[size], books[size], edges, edges[1:]):
            if a == z:
                continue
            at, _ = nearest(x[a:z], book, kinds[size])
            np.add.at(counts, at, 1)
            for d in range(z - a):
                np.add.at(sums[:, d], at, x[a + d].astype(np.int64))
        return self

    def merge(self, other: Sums) -> Sums:
        for size, tensors in other.of.items():
            if size not in self.of:
                self.of[size] = tensors
                continue
            for (sums, counts), (more, most) in zip(self.of[size], tensors):
                sums += more
                counts += most
        return self


@dataclass(frozen=True)
class Codes:
    """``rows``: vec_id, label, code, error, codebooks_sha256; ``books``: the entries of each part by vector length."""

    rows: DataFrame
    books: Books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, units: int = UNITS) -> Codes:
    """Codes of all vectors, and the codebooks.

    ``vectors`` has vec_id, embedding (an array of numbers) and label; other columns are not read.
    A vector that is null or holds a null or non-finite component is left out. Components become
    floor(units * x). Vectors of different lengths can't be compared, so each length has codebooks
    of its own; an empty vector has code zero in every part and no error. Codebooks start as the
    vectors with the smallest ids, null ids last, repeated ids in order of their numbers; with fewer
    vectors than ``entries``, the codebook is smaller. Rows are coded one by one, so repeated rows
    stay. Ties go to the lower index, an entry without vectors stays as it is, and an empty table
    gives no rows. Numbers whose distances exceed 64 bits raise an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes of two hex digits have 256 entries at most")
    spark = vectors.sparkSession
    rows = vectors.filter(finite("embedding")).select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    blocks = stored(rows.mapInArrow(lambda b: columnar(b, units), f"size long, peak long, ids array<{id_type}>, labels array<{label_type}>, width int, x binary"), "code-blocks")
    cells = blocks.select("size", "peak", "ids", "width", "x").rdd.map(tuple)
    first = cells.treeAggregate(First(entries), First.add, First.merge, DEPTH)
    books: Books = {}
    for size, found in first.rows.items():
        start = np.array([v for _, v in found], np.int64).reshape(len(found), size)
        edges = bounds(size, parts)
        books[size] = [start[:, a:z].copy() for a, z in zip(edges, edges[1:])]
    # distances of half the width are twice as fast, where every one surely fits
    kinds = {size: np.int32 if 4 * peak * peak * max(size, 1) < 2**31 else np.int64 for size, peak in first.peak.items()}
    for group in grouped(sorted(s for s in books if s)):
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(({s: books[s] for s in group}, kinds))
            sums = cells.treeAggregate(Sums(), lambda s, block, sent=sent: s.add(block, *sent.value), Sums.merge, DEPTH)
            sent.unpersist()
            for size, tensors in sums.of.items():
                for book, (total, count) in zip(books[size], tensors):
                    used = count > 0
                    book[used] = total[used] // count[used, None]
    sent = spark.sparkContext.broadcast((books, kinds, {size: digest(b) for size, b in books.items()}))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, kinds, hashes = sent.value
        for batch in batches:
            for k, (size, width, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("size", "width", "x")))):
                ids, labels = (batch.column(c).slice(k, 1).flatten() for c in ("ids", "labels"))
                x, edges = numbers(size, width, x), bounds(size, parts)
                error, code = np.zeros(len(ids), np.int64), np.zeros((len(ids), parts), np.uint8)
                for p, (book, a, z) in enumerate(zip(books[size], edges, edges[1:])):
                    if a < z:
                        at, far = nearest(x[a:z], book, kinds[size])
                        code[:, p] = at
                        error += far
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error), pa.array([hashes[size]] * len(ids), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    out = blocks.select("size", "ids", "labels", "width", "x").mapInArrow(coded, f"vec_id {id_type}, label {label_type}, code string, error long, codebooks_sha256 string")
    return Codes(out, books)


def grouped(sizes: list[int]) -> Iterator[list[int]]:
    """Lengths whose dimensions sum to TOGETHER at most, a longer one alone."""
    some: list[int] = []
    for size in sizes:
        if some and sum(some) + size > TOGETHER:
            yield some
            some = []
        some.append(size)
    if some:
        yield some


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``: the error summed over rows of the same label, null ones together. Sums are made before anything is sent, and the sum of a hot label goes to its rows."""
    label = F.col("label").cast("string")
    rows = stored(codes.withColumn("_label", F.when(label.isNull(), "").otherwise(F.concat(F.lit("="), label))), "codes")
    sums = stored(rows.groupBy("_label").agg(F.count("*").alias("_rows"), F.sum("error").alias("label_error")), "code-errors")
    return by_key(rows, sums, ["_label"]).drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of ``embeddings``."""
    return with_label_error(compress(table(spark, sf_dir, "embeddings")).rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
