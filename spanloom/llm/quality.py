"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target (clean labelled texts), one of raw
text, give every document a log importance weight: the sum of its n-grams' log ratios. Documents
are then sampled without replacement in proportion to a power of their weight by Gumbel top-k: a
uniform hash of the id becomes a Gumbel variate, is added to the scaled log weight, and the k
largest sums stay. k is the number of documents whose weight lies above a cut calibrated on held
out labelled rows.

N-grams are words, pairs of words, runs of one word (the n-gram of n times the same, by the power of
two of n), and the first and last bytes of words. Each counts once a document, so that no single
text's repetitions make it look frequent. Raw text is seen twice: as all
documents and as the labelled ones. Of both ratios the one nearer to zero counts, and small ones
count nothing: text that is frequent among all documents but was never labelled, such as a large
group of copies, carries no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, flat_bytes, mixed, tidy
from .common import HASH_BITS, key_hash, stored, table

#: Labelled rows that the classifier is fitted and calibrated on, at most (up to chance): a sample by
#: hash of the id. Raw text counts cover all documents.
SAMPLE = 100_000
#: One in so many of them, by hash, is held out for the cut.
HELD_OUT = 5
#: Bits of buckets of each view: words, pairs, runs, first 4, first 6 and last 3 bytes.
VIEWS = {"word": 16, "pair": 16, "run": 4, "head4": 14, "head6": 15, "tail3": 14}
#: Pseudo-counts on both sides of a ratio; log ratios nearer to zero than DEAD count nothing; none counts more than MOST.
PRIOR, DEAD, MOST = 1.0, 2.2, 8.0
#: Standard deviations by which a bucket's count must differ from the expected one to count at all.
DEVIATIONS = 3.0
#: Power to which weights are raised: above 1, sampling is sharper.
POWER = 4.0
#: A lost clean row of the held-out ones weighs as much as so many rejected rows that stay.
LOSS_WEIGHT = 10
#: Buckets of the histograms that find the k-th largest sum: width, furthest, parts of the boundary.
WIDTH, FURTHEST, PARTS = 0.25, 16_000, 65_536

STARTS = dict(zip(VIEWS, np.concatenate(([0], np.cumsum([1 << b for b in VIEWS.values()])[:-1])).tolist()))
BUCKETS = sum(1 << b for b in VIEWS.values())


def ngrams(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each view the bucket of every n-gram and its row, once a row."""
    h = words.hashes()
    same = words.row[1:] == words.row[:-1]
    pair = h[1:] ^ h[:-1]
    again = np.concatenate(([False], same & (pair == 0), [False]))  # words that are the one before
    edges = np.flatnonzero(again[1:] != again[:-1])
    runs = np.minimum(np.log2(edges[1::2] - edges[::2] + 1).astype(np.uint64), 15)
    found = {"word": (h, words.row), "pair": (mixed(pair[same]), words.row[1:][same]), "run": (runs, words.row[edges[::2]]), "head4": (mixed(words.edge(4)), words.row), "head6": (mixed(words.edge(6)), words.row), "tail3": (mixed(words.edge(3, tail=True)), words.row)}
    for view, (x, row) in found.items():
        key = np.sort((row << VIEWS[view]) | (x & np.uint64((1 << VIEWS[view]) - 1)).astype(np.int64))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        yield (key & ((1 << VIEWS[view]) - 1)) + STARTS[view], key >> VIEWS[view]


#: Text that is split into n-grams at a time.
BLOCK = 1_000_000


def blocks(column: pa.Array) -> Iterator[tuple[slice, Words]]:
    """Rows in blocks of about BLOCK bytes, each row whole."""
    raw, offsets = flat_bytes(column)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        yield slice(a, b), Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def labelled_sample(labels: DataFrame, most: int = SAMPLE) -> dict[int, tuple[bool, bool]]:
    """doc_id: (clean, held out) of a sample by hash of about ``most`` rows.

    Rows without doc_id or with neither label are left out; a missing label of the two counts as
    good; of several rows for an id a bad one decides.
    """
    rows = labels.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"), (F.col("quality").isNull() & F.col("toxic").isNull()).alias("none")).filter("doc_id is not null and not none")
    n = rows.count()
    h = key_hash(F.col("doc_id"), "label")
    if n > most:
        rows = rows.filter(h < int((1 << HASH_BITS) * (most / n)))
    found = rows.groupBy("doc_id").agg(F.min(F.col("good") & ~F.col("toxic")).alias("clean")).select("doc_id", "clean", (key_hash(F.col("doc_id"), "held") % HELD_OUT == 0).alias("held")).toArrow()
    return dict(zip(found.column("doc_id").to_pylist(), zip(found.column("clean").to_pylist(), found.column("held").to_pylist())))


def count_ngrams(docs: DataFrame, sample: dict[int, tuple[bool, bool]]) -> DataFrame:
    """bucket, target, labelled, total: n-grams of clean training rows, of all training rows, of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            said = [known.get(i) for i in batch.column("doc_id").to_pylist()]
            trained = np.array([s is not None and not s[1] for s in said], bool)
            clean = trained & np.array([s is not None and s[0] for s in said], bool)
            for part, words in blocks(batch.column("text")):
                for bucket, row in ngrams(words):
                    sums[2] += np.bincount(bucket, minlength=BUCKETS)
                    for k, flags in ((0, clean[part]), (1, trained[part])):
                        if flags.any():
                            sums[k] += np.bincount(bucket[flags[row]], minlength=BUCKETS)
        at = np.flatnonzero(sums[2])
        for a in range(0, len(at), 50_000):
            some = at[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(s[some]) for s in sums]], names=["bucket", "target", "labelled", "total"])
        tidy()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket int, target long, labelled long, total long")
    return rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("labelled").alias("labelled"), F.sum("total").alias("total"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The log ratio of each bucket. The counts have at most BUCKETS rows, whatever the input."""
    sums = np.zeros((3, BUCKETS))
    for r in counts.toLocalIterator():
        sums[:, r["bucket"]] = r["target"], r["labelled"], r["total"]
    out = np.zeros(BUCKETS)
    for view, bits in VIEWS.items():
        own = slice(STARTS[view], STARTS[view] + (1 << bits))
        t, pools = sums[0, own], sums[1:, own]
        expected = [p * (t.sum() / max(p.sum(), 1)) for p in pools]
        ratios = [np.where(np.abs(t - e) >= DEVIATIONS * np.sqrt(e + PRIOR), np.log((t + PRIOR) / (e + PRIOR)), 0) for e in expected]
        agree = np.sign(ratios[0]) == np.sign(ratios[1])
        out[own] = np.where(agree, np.sign(ratios[0]) * np.minimum(*np.abs(ratios)), 0)
    out[np.abs(out) < DEAD] = 0
    return np.clip(out, -MOST, MOST)


def weigh(docs: DataFrame, ratios: np.ndarray, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of each row and its log_weight."""
    sent = docs.sparkSession.sparkContext.broadcast(np.round(ratios, 6))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ", log_weight double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for part, words in blocks(batch.column("_bytes" if "_bytes" in batch.schema.names else "text")):
                for bucket, row in ngrams(words):
                    out[part] += np.bincount(row, weights=sent.value[bucket], minlength=words.n_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.round(out, 6))], names=[*columns, "log_weight"])
        tidy()

    rows = docs.select(*columns) if "text" in columns else docs.select(*columns, F.col("text").cast("binary").alias("_bytes"))
    return rows.mapInArrow(score, schema)


def calibrated_cut(scores: list[tuple[float, bool]]) -> float | None:
    """The weight from which rows count as clean; None where held-out rows show no rejected ones."""
    if all(clean for _, clean in scores):
        return None
    best, cut = None, None
    ordered = sorted(scores)
    loss = sum(not clean for _, clean in ordered)  # everything stays
    k = 0
    levels = [float("-inf"), *sorted({s for s, _ in ordered}), float("inf")]
    for low, high in zip(levels, levels[1:]):
        while k < len(ordered) and ordered[k][0] <= low:
            loss += LOSS_WEIGHT if ordered[k][1] else -1
            k += 1
        if best is None or loss < best:
            middle = high - 1.0 if low == float("-inf") else low + 1.0 if high == float("inf") else (low + high) / 2
            best, cut = loss, middle
    return cut


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """The k-th row in order of falling key and rising doc_id: its key and id; None for k of 0.

    A histogram of keys finds the bucket in which it lies, and a second one a part of that; only the
    rows of this part are ordered.
    """
    if k <= 0:
        return None
    bucket = F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), F.floor(F.col("key") / WIDTH)))
    inner = F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.floor((F.col("key") / WIDTH - F.floor(F.col("key") / WIDTH)) * PARTS)))
    left, rows = k, keys
    for level in (bucket, inner):
        edge = None
        for r in rows.groupBy(level.alias("b")).count().orderBy(F.desc("b")).collect():  # a row a bucket
            edge = r["b"]
            if r["count"] >= left:
                break
            left -= r["count"]
        if edge is None:
            return None
        rows = rows.filter(level == edge)
    last = rows.select("key", F.col("doc_id").cast("long").alias("doc_id")).orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(left).orderBy("key", F.desc_nulls_first("doc_id")).first()
    return (last["key"], last["doc_id"]) if last else None


def resample(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row with log_weight, key and keep.

    Null and empty texts have no n-grams and a weight of 0, as text without evidence, and stay as
    such. Repeated rows get the same key and the same verdict. Without labelled rows, or without
    clean or rejected ones among them, nothing speaks against a row and all stay. An empty table
    gives none. Only doc_id, text and ``columns`` are read.
    """
    sample = labelled_sample(labels)
    counts = stored(count_ngrams(docs, sample), "quality-counts")
    ids = columns if "doc_id" in columns else (*columns, "doc_id")
    rows = weigh(docs, log_ratios(counts), ids)
    uniform = (key_hash(F.col("doc_id"), "gumbel") + 0.5) / float(1 << HASH_BITS)
    rows = rows.withColumn("key", F.col("log_weight") * POWER - F.log(-F.log(uniform)))
    if set(columns) == {"doc_id"}:
        rows = stored(rows, "quality-weights")
        slim = rows
    else:
        slim = stored(rows.select("doc_id", "log_weight", "key"), "quality-weights")
    held = {i: clean for i, (clean, out) in sample.items() if out}
    cut = None
    if held and any(c for c, _ in sample.values()):
        listed = slim.sparkSession.createDataFrame(list(held.items()), "doc_id long, clean boolean")
        scores = slim.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(listed), "doc_id").groupBy("doc_id", "clean").agg(F.min("log_weight").alias("w")).collect()  # at most the sample
        cut = calibrated_cut([(r["w"], r["clean"]) for r in scores])
    if cut is None:
        return rows.withColumn("keep", F.lit(True)).select(*columns, "log_weight", "key", "keep")
    least = kth_largest(slim, slim.filter(F.col("log_weight") >= cut).count())
    if least is None:
        return rows.withColumn("keep", F.lit(False)).select(*columns, "log_weight", "key", "keep")
    tie = F.lit(True) if least[1] is None else F.coalesce(F.col("doc_id").cast("long") <= least[1], F.lit(False))
    return rows.withColumn("keep", (F.col("key") > least[0]) | ((F.col("key") == least[0]) & tie)).select(*columns, "log_weight", "key", "keep")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
