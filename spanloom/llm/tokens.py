"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie in one flat array of symbols. In each step every sequence finds its pair
of lowest rank and all sequences apply theirs at the same time; sequences without a known pair
leave. What counts is the number of surviving symbols, those outside the vocabulary once a byte.
Counts of pre-tokens are kept from batch to batch, so most text costs a look-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Name of the vocabulary file, and the tokens above which a text is over the limit.
MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Pre-tokens whose counts a worker keeps; beyond it starts anew.
KEPT = 500_000
#: Symbols that one flat array may hold; longer pre-tokens are merged with a priority queue instead.
FLAT, LONG = 1_000_000, 400
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairRanks:
    """The vocabulary as arrays: pairs of symbols that merge, with their ranks and what they become."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normal = model.normalize
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.ids = {model.id_to_piece(i): k for k, i in enumerate(ranked)}
        scores = np.array([-model.get_score(i) for i in ranked])
        self.rank_of = np.unique(scores, return_inverse=True)[1].astype(np.int64)  # equal scores have equal ranks: then the leftmost goes first
        chars = {c for piece in self.ids for c in piece}
        self.symbols = dict(self.ids)
        for c in sorted(chars - set(self.ids)):  # parts of pieces that are no pieces themselves
            self.symbols[c] = len(self.symbols)
        self.known = len(self.ids)
        self.unseen = len(self.symbols)  # characters in no piece
        pairs = {}
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = k
        self.pairs = pairs
        self.width = self.unseen + 1
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(pairs.values()), np.int64)[order]
        # a blank inside a piece stands only at its start, and line feeds in no longer piece: texts can be cut there
        long = [p for p in self.ids if len(p) > 1]
        self.cut_blank = not any(p[i] == SPACE and p[i - 1] != SPACE for p in long for i in range(1, len(p)))
        self.cut_line = not any("\n" in p for p in long)
        run, end = f"{SPACE}*", "\n" if self.cut_line else ""
        self.pattern = re.compile(f"{run}[^{SPACE}{end}]+|{SPACE}+" + ("|\n" if end else "")) if self.cut_blank else re.compile("(?s).+")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``known``, which is above all ranks, where it doesn't merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[self.merged[at]], self.known)

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs that merge become."""
        return self.merged[np.searchsorted(self.keys, left * self.width + right)]

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        group, held = [], 0
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.queued(w)
                continue
            group.append(k)
            held += len(w)
            if held >= FLAT:
                out[group] = self._flat([words[i] for i in group])
                group, held = [], 0
        if group:
            out[group] = self._flat([words[i] for i in group])
        return out.tolist()

    def _flat(self, words: list[str]) -> np.ndarray:
        text = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, at = np.unique(points, return_inverse=True)
        sym = np.array([self.symbols.get(chr(c), self.unseen) for c in distinct], np.int64)[at]
        n_bytes = np.array([1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) for c in distinct], np.int64)[at]
        seq = np.repeat(np.arange(len(words)), lengths)
        done = np.zeros(len(words), np.int64)
        none = self.known
        rank = np.full(len(sym), none)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[1:] == seq[:-1], self.ranks(sym[:-1], sym[1:]), none)
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate((first, [len(sym)])))
            ended = least == none
            if ended.any():
                gone = np.repeat(ended, size)
                np.add.at(done, seq[gone], np.where(sym[gone] < self.known, 1, n_bytes[gone]))
                keep = ~gone
                sym, rank, seq, n_bytes = sym[keep], rank[keep], seq[keep], n_bytes[keep]
                if not len(sym):
                    break
                first, least, size = None, least[~ended], size[~ended]
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
            hit = np.flatnonzero(rank == np.repeat(least, size))
            own = seq[hit]
            hit = hit[np.concatenate(([True], own[1:] != own[:-1]))]  # the leftmost of each sequence
            sym[hit] = self.made(sym[hit], sym[hit + 1])
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where the merged symbols stand afterwards
            sym, rank, seq, n_bytes = sym[keep], rank[keep], seq[keep], n_bytes[keep]
            for left in (moved, moved[moved > 0] - 1):
                right = np.minimum(left + 1, len(sym) - 1)
                joined = (right > left) & (seq[right] == seq[left])
                rank[left] = np.where(joined, self.ranks(sym[left], sym[right]), none)
        return done

    def queued(self, word: str) -> int:
        """The same for one long pre-token, in n log n steps."""
        import heapq

        sym = [self.symbols.get(c, self.unseen) for c in word]
        size = [len(c.encode("utf-8", "surrogatepass")) for c in word]
        n = len(sym)
        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        heap = [(self.rank_of[p], i, 0, 0) for i in range(n - 1) if (p := self.pairs.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, vi, vj = heapq.heappop(heap)
            if sym[i] < 0 or version[i] != vi or (j := after[i]) >= n or version[j] != vj or sym[j] < 0:
                continue
            sym[i], sym[j] = self.pairs[sym[i], sym[j]], -1
            version[i] += 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (x := self.pairs.get((sym[a], sym[b]))) is not None:
                    heapq.heappush(heap, (self.rank_of[x], a, version[a], version[b]))
        return sum(1 if s < self.known else size[i] for i, s in enumerate(sym) if s >= 0)


class Counter:
    """Counts the tokens of texts, keeping the counts of pre-tokens."""

    def __init__(self, path: str):
        self.ranks, self.kept = PairRanks(path), {}

    def __call__(self, texts: list[str]) -> list[int]:
        out, group, held = [], [], 0
        for t in texts:  # a bounded amount of text at a time
            group.append(t)
            held += len(t)
            if held >= FLAT:
                out += self._some(group)
                group, held = [], 0
        return out + self._some(group)

    def _some(self, texts: list[str]) -> list[int]:
        cut = [self.ranks.pattern.findall(self.ranks.normal(t)) if t else [] for t in texts]
        if len(self.kept) > KEPT:
            self.kept.clear()
        kept = self.kept
        new = list({w for words in cut for w in words if w not in kept})
        kept.update(zip(new, self.ranks.counts(new)))
        return [sum(map(kept.__getitem__, words)) for words in cut]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted one by one, an empty
    table gives none, and only doc_id and text are read. ``path`` must exist on every executor, as
    libraries do. Texts of any length are counted whole.
    """
    where = path or model_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(where)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter([t or "" for t in texts]), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias("_text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
