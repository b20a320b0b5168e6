"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are normalised on bytes: A-Z become lower case, every other ASCII character that is no
letter or digit becomes a blank, and bytes of non-ASCII characters stay. The automaton's symbols are
the benchmark's words. Any window of ten words holds a whole block of five that starts at a multiple
of five in its item, so the automaton holds these blocks, about one state a word of the benchmark,
and reports all their occurrences in one scan of a text. Each is widened both ways along its item; a
common run of ten words or more is hit. Items of fewer words must be found whole. Word numbers of
the hits lead back to character offsets of the original text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import tidy
from .common import stored, table

#: Words of a window; an item of fewer words is one window as a whole.
WINDOW = 10
#: Text of items that one automaton may hold, which is broadcast and takes some ten times its size in a
#: worker. Only a larger benchmark is dealt to several automata, and the texts pass through them one
#: after the other, so that memory stays bounded.
AUTOMATON_BYTES = 64_000_000

#: Bytes to lower case, separators to blank; bytes from 0x80 belong to words.
NORMAL = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


Item = tuple[str | None, bytes | None]


def parts_of(items: Iterable[Item], limit: int = AUTOMATON_BYTES) -> Iterator[list[Item]]:
    """Items in parts of about ``limit`` bytes of text; one empty part without any."""
    part: list[Item] = []
    held = n = 0
    for item, text in items:
        if held > limit:
            yield part
            part, held, n = [], 0, n + 1
        part.append((item, text))
        held += len(text or b"")
    if part or not n:
        yield part


class Scanner:
    """Finds the windows of items in texts."""

    def __init__(self, items: list[Item], size: int = WINDOW):
        import ahocorasick

        self.size, block = size, (size + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.items: list[str | None] = []
        self.words: list[array] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        seen: set[tuple[str | None, bytes | None]] = set()
        for item, text in items:
            if (item, text) in seen or not (words := words_of(text)):
                continue
            seen.add((item, text))
            own = array("I", [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words])  # 0 is any other word
            for at in [0] if len(own) < size else range(0, len(own) - block + 1, block):
                places.setdefault(tuple(own[at : at + block]), []).append((len(self.items), at))
            self.items.append(item)
            self.words.append(own)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, value in places.items():
            self.found.add_word(key, (len(key), value))
        self.empty = not places
        if places:
            self.found.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, end), merged, and the items found; items without a name are hit but not told."""
        if self.empty or not words:
            return [], set()
        get = self.numbers.get
        text = tuple([get(w, 0) for w in words])
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        upto: dict[tuple[int, int], int] = {}  # by item and shift against the text: the end of the run looked at last
        for end, (length, places) in self.found.iter(text):
            first = end - length + 1
            for item, at in places:
                key = (item, first - at)
                if upto.get(key, -1) > first:
                    continue
                own = self.words[item]
                a, i = first, at
                while a and i and text[a - 1] == own[i - 1]:
                    a, i = a - 1, i - 1
                b, j = end + 1, at + length
                while b < len(text) and j < len(own) and text[b] == own[j]:
                    b, j = b + 1, j + 1
                upto[key] = b
                if b - a >= min(self.size, len(own)):
                    spans.append((a, b))
                    if self.items[item] is not None:
                        names.add(self.items[item])
        return merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets (end exclusive) in the original text of runs of words."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before a byte
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


FIELDS = "_words long, _runs array<struct<first:int,end:int>>, _items array<string>, spans array<struct<start:int,end:int>>"


def _scanned(rows: DataFrame, part: list[Item], first: bool, size: int) -> DataFrame:
    """One pass through one automaton: merges its hits with those that the rows carry."""
    sent = rows.sparkSession.sparkContext.broadcast(part)
    kept = [c for c in rows.columns if c not in ("_words", "_runs", "_items", "spans")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema) + ", " + FIELDS

    run_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value, size)
        for batch in batches:
            counts, all_runs, all_items, all_spans = [], [], [], []
            before = None if first else (batch.column("_runs").to_pylist(), batch.column("_items").to_pylist())
            for k, text in enumerate(batch.column("_bytes" if "_bytes" in batch.schema.names else "text").cast(pa.binary())):
                raw = text.as_py()
                words = words_of(raw)
                runs, items = scanner.scan(words)
                if before:
                    runs = merged(runs + [(r["first"], r["end"]) for r in before[0][k]])
                    items |= set(before[1][k])
                counts.append(len(words))
                all_runs.append([{"first": a, "end": b} for a, b in runs])
                all_items.append(sorted(items))
                all_spans.append([{"start": a, "end": b} for a, b in original_spans(raw, runs)] if runs else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(all_runs, run_type), pa.array(all_items, pa.list_(pa.string())), pa.array(all_spans, span_type)],
                names=[*kept, "_words", "_runs", "_items", "spans"],
            )
        tidy()

    return rows.mapInArrow(scan, schema)


def scan_documents(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), size: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """For every row of ``docs``: the columns of ``carry``, n_words, n_hit, n_items, item_ids, spans.

    ``spans`` are the hit passages in characters of the original text. A null or empty text has no
    words and no hits; null or empty items have no windows; repeated rows are judged one by one; an
    empty benchmark hits nothing; columns beyond doc_id, text, item_id and ``carry`` aren't read.
    Items without item_id hit words, but are not among the items. The test set streams through the
    driver; up to ``limit`` bytes of it are one automaton and one pass over the documents.
    """
    items = ((r["item_id"], r["text"]) for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).toLocalIterator())
    rows = docs.select(*carry) if "text" in carry else docs.select(*carry, F.col("text").cast("binary").alias("_bytes"))
    parts = parts_of(items, limit)
    part, first = next(parts), True
    while part is not None:
        following = next(parts, None)
        rows = _scanned(rows, part, first, size)
        if following is not None:  # else two automata would be held at once
            rows = stored(rows, "leaks")
        part, first = following, False
    hits = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["first"]))
    return rows.select(*carry, F.col("_words").alias("n_words"), hits.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.array_sort("_items").alias("item_ids"), "spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark."""
    return scan_documents(docs, benchmark, tuple(docs.columns)).filter("n_hit = 0").select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
