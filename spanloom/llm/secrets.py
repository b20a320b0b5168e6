"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Long tokens that no pattern covers are tested twice. First, the encoding is inferred from the
characters, and three tests ask whether its symbols are uniform over the alphabet (chi-squared),
whether there are too few or too many runs about the median, and whether neighbours correlate. Their
p-values make one (three times the least, which holds however they depend on each other), and within
each class of lengths the Benjamini-Hochberg rule over all tested tokens of the corpus says which are
no random strings, such that at most REJECT of those turned down are random after all. Second, what
remains gets a p-value against ordinary text: how often would text of this corpus, with its letter
frequencies and its rate of changes between capitals, small letters, digits and marks, look as mixed
as this? All long tokens count as tests, and by the same rule the share of false finds within a
class of lengths stays under LEVEL.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, Words, flat_bytes
from .common import stored, table

#: Fixed patterns, in the order of their kinds; bytes patterns ignore case for ASCII letters only.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_LEAST = 6
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]{16,}"), re.compile(rb"[0-9a-f]{24,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

#: Shortest token that is tested, and the lengths at which a new class begins.
LEAST = 20
CLASSES = (20, 28, 40, 64)
#: Share of false finds within a class of lengths, and share of random strings among those that the battery turns down.
LEVEL, REJECT = 0.001, 0.001
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
PLAIN = re.compile(rb"[A-Za-z]{20,}")
#: What a token falls into: '=' stays only at its end, as padding; runs that have the marks of one base64 alphabet.
PART = re.compile(rb"[A-Za-z0-9+/_-]+(?:=+\Z)?")
RUNS = (re.compile(rb"[A-Za-z0-9+/]+=*"), re.compile(rb"[A-Za-z0-9_-]+=*"))
#: p-values are kept by tenths of their negative decimal logarithm, up to BINS of them, those of the battery up to BATTERY_BINS.
BINS, BATTERY_BINS = 400, 100

CLASS_OF = np.full(256, 3, np.int8)
CLASS_OF[ord("a") : ord("z") + 1], CLASS_OF[ord("A") : ord("Z") + 1], CLASS_OF[ord("0") : ord("9") + 1] = 0, 1, 2


def assign_end(text: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]


def base_spans(text: bytes, words: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes. ``words``: spans of the long words, which alone can hold keys and digits."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(a, b, "assign") for a, b in assign_end(text)]
    for a, b in words:
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text, a, b)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def is_plain(token: bytes) -> bool:
    """A word: letters in one case, or a capital before small letters."""
    return token.isalpha() and (token.islower() or token.isupper() or token[1:].islower())


def is_text(run: bytes) -> bool:
    """Words and numbers with marks between them."""
    return all(p.isdigit() or is_plain(p) for p in re.findall(rb"[A-Za-z0-9]+", run))


def pieces(token: bytes) -> list[tuple[int, bytes]]:
    """What is tested of a token: the parts between '=' that is no padding, as NAME=value, each by :func:`coded`."""
    return [(m.start() + at, piece) for m in PART.finditer(token) if len(m[0]) >= LEAST for at, piece in coded(m[0])]


def coded(part: bytes) -> list[tuple[int, bytes]]:
    """A part as a whole if it could be base64, else its parts between marks.

    With marks of both base64 alphabets, as in paths, it is no base64 as a whole, but the runs with
    the marks of either one can be, unless words and numbers are all they hold; they may overlap.
    """
    if any(48 <= c <= 57 for c in part) and any(c >= 97 for c in part) and any(65 <= c <= 90 for c in part):
        if alphabet_of(part):
            return [(0, part)]
        return sorted({(m.start() + at, piece) for runs in RUNS for m in runs.finditer(part) if len(m[0]) >= LEAST and not is_text(m[0]) for at, piece in coded(m[0])})
    return [(m.start(), m[0]) for m in re.finditer(rb"[A-Za-z0-9]{20,}", part)]


def alphabet_of(token: bytes) -> bytes | None:
    """The smallest encoding that has all symbols; None for digits alone and for words."""
    body = token.rstrip(b"=")
    if not body or body.isdigit() or is_plain(body):
        return None
    for symbols in (b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"0123456789abcdefghijklmnopqrstuvwxyz", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", b"-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"):
        if not body.strip(symbols) and not set(body) - set(symbols):
            return symbols
    return None


def phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def randomness(token: bytes, symbols: bytes) -> tuple[float, float, float]:
    """p-values of the battery: chi-squared uniformity, runs about the median, serial correlation."""
    x = np.array([symbols.index(c) for c in token.rstrip(b"=")], float)
    n, k = len(x), len(symbols)
    chi = float(np.sum((np.bincount(x.astype(int), minlength=k) - n / k) ** 2) * k / n)
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))  # Wilson and Hilferty
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean, runs = 2 * a * b / n + 1, 1 + int(np.sum(high[1:] != high[:-1]))
        sd = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs_p = 2 * phi(-abs(runs - mean) / sd)
    else:
        runs_p = 2.0 ** (1 - n)
    d = x - x.mean()
    var = float(d @ d)
    serial = float(d[:-1] @ d[1:]) / var if var else 1.0
    return phi(-z), runs_p, 2 * phi(-abs(serial + 1 / n) * math.sqrt(n))


class TextNull:
    """Ordinary text: letter frequencies and the rate at which neighbours change class."""

    def __init__(self, letters: np.ndarray, changes: int, neighbours: int):
        self.q = (letters + 1.0) / (letters.sum() + 26)
        self.rate = (changes + 1.0) / (neighbours + 20.0)

    def p_value(self, token: bytes, symbols: bytes) -> float:
        """How likely text looks as much like a code as the token does: changes of class, and letters."""
        raw = np.frombuffer(token, np.uint8)
        kinds = CLASS_OF[raw]
        n, changes = len(raw) - 1, int(np.sum(kinds[1:] != kinds[:-1]))
        p = max(min(self.rate, 0.5), 1e-6)
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(changes, n + 1)]
        mixed = min(1.0, sum(map(math.exp, logs))) if changes else 1.0
        low = LOWER[raw[kinds <= 1]].astype(int) - 97
        m = len(low)
        if m < 4:
            even = 1.0
        elif len(symbols) == 16:  # letters beyond f would rule the encoding out
            even = float(self.q[:6].sum() ** m)
        else:
            u = float(np.sum((np.bincount(low, minlength=26) - m / 26) ** 2) * 26 / m)
            s2, s3 = float(np.sum(self.q**2)), float(np.sum(self.q**3))
            mean = 26 * ((m - 1) * s2 + 1) - m
            sd = 26 / m * math.sqrt(max(4 * m**3 * (s3 - s2 * s2) + 2 * m * m * s2 * s2, 1e-9))
            even = phi((u - mean) / sd)
        x = -math.log(max(mixed, 1e-300)) - math.log(max(even, 1e-300))
        return min(1.0, math.exp(-x) * (1 + x))  # both together, by Fisher's rule


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
TESTED = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.binary())])
#: Bytes that are looked at together.
BLOCK = 1_000_000


def scanned(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``carry``, base spans, tokens to test, and what the row's plain tokens say of text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    schema += ", base array<struct<start:int,end:int,kind:string>>, tested array<struct<start:int,end:int,token:binary>>, plain array<long>, letters array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat_bytes(batch.column("_bytes"))
            base, tested, plain, letters = [], [], [], []
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
                part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words = Words(part, own)
                long = np.flatnonzero(words.end - words.start >= LEAST)
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                by_row = np.searchsorted(words.row[long], np.arange(b - a + 1))
                for k in range(b - a):
                    low = int(own[k])
                    text = part[low : own[k + 1]].tobytes()
                    spans = [(int(words.start[i]) - low, int(words.end[i]) - low) for i in long[by_row[k] : by_row[k + 1]]]
                    fixed = base_spans(text, spans)
                    tests, counts, common = [], [0] * (len(CLASSES) + 2), []
                    for s, e in spans:
                        for m in TOKEN.finditer(text, s, e):
                            for at, piece in pieces(m[0]):
                                x, y = m.start() + at, m.start() + at + len(piece)
                                if any(u < y and x < v for u, v, _ in fixed):
                                    continue
                                counts[length_class(len(piece))] += 1
                                if alphabet_of(piece):
                                    tests.append((x, y, piece))
                                else:
                                    common.append(piece)
                    line = b"".join(common)
                    if line:
                        kinds = [CLASS_OF[np.frombuffer(p, np.uint8)] for p in common]
                        counts[-2:] = [sum(int(np.sum(c[1:] != c[:-1])) for c in kinds), sum(len(c) - 1 for c in kinds)]
                    place = lambda x, low=low: int(chars[low + x] - chars[low])
                    base.append([{"start": place(x), "end": place(y), "kind": kind} for x, y, kind in fixed])
                    tested.append([{"start": place(x), "end": place(y), "token": t} for x, y, t in tests])
                    plain.append(counts)
                    letters.append(np.bincount(LOWER[np.frombuffer(line, np.uint8)], minlength=123)[97:123].tolist() if line else [])
                a = b
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(base, pa.list_(SPAN)), pa.array(tested, pa.list_(TESTED)), pa.array(plain, pa.list_(pa.int64())), pa.array(letters, pa.list_(pa.int64()))], names=[*carry, "base", "tested", "plain", "letters"])

    return docs.select(*carry, F.col("text").cast("binary").alias("_bytes")).mapInArrow(scan, schema)


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def tenths(p: float, most: int) -> int:
    """Tenths of the negative decimal logarithm."""
    return min(most - 1, int(-10 * math.log10(max(p, 1e-300))))


def surprises(null: TextNull, tokens: list[bytes]) -> list[tuple[int, int]]:
    """For each token the bins of its p-values as a random string, by the whole battery, and as ordinary text."""
    out = []
    for t in tokens:
        symbols = alphabet_of(t) or b""
        out.append((tenths(min(1.0, 3 * min(randomness(t, symbols))), BATTERY_BINS), tenths(null.p_value(t, symbols), BINS)))
    return out


def discovery_cut(found: dict[int, int], tests: int, level: float = LEVEL) -> int:
    """The smallest bin from which on at most ``level`` of the finds are false (Benjamini and Hochberg); BINS for none."""
    cut, above = BINS, 0
    for b in sorted((b for b in found if b >= 0), reverse=True):
        above += found[b]
        if tests * 10 ** (-b / 10) <= level * above:
            cut = b
    return cut


def apart(found: list[tuple[int, dict]]) -> list[dict]:
    """Of finds (surprise, span) that overlap, the most surprising, then the longest."""
    kept: list[dict] = []
    for _, x in sorted(found, key=lambda f: (-f[0], f[1]["start"] - f[1]["end"], f[1]["start"])):
        if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in kept):
            kept.append(x)
    return kept


def find_secrets(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For every row: ``carry``, base spans and all spans, each with start, end (characters, end exclusive) and kind.

    Null and empty texts have none. Repeated rows are judged alike, and each counts as its own
    test. Tokens are cut at '=' that is no padding, so of NAME=value the value is tested; pieces that
    touch a base span are not. An empty table gives an empty result; only
    doc_id, text and ``carry`` are read. No shuffle of texts; what reaches the driver are counts of
    fixed size.
    """
    rows = stored(scanned(docs, carry), "secrets")
    sums = rows.agg(*[F.coalesce(F.sum(F.get("plain", F.lit(i))), F.lit(0)) for i in range(len(CLASSES) + 2)], *[F.coalesce(F.sum(F.get("letters", F.lit(i))), F.lit(0)) for i in range(26)]).first()
    per_class, changes, neighbours = sums[: len(CLASSES)], sums[len(CLASSES)], sums[len(CLASSES) + 1]
    null = TextNull(np.array(sums[len(CLASSES) + 2 :], float), changes, neighbours)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(CLASSES), BATTERY_BINS, BINS), np.int64)
        for batch in batches:
            tokens = [x["token"] for row in batch.column("tested").to_pylist() for x in row]
            for t, (r, b) in zip(tokens, surprises(null, tokens)):
                counts[length_class(len(t)), r, b] += 1
        c, r, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[c, r, b])], names=["c", "r", "b", "n"])

    tested = rows.filter(F.size("tested") > 0)
    counts = tested.select("tested").mapInArrow(histogram, "c int, r int, b int, n long").groupBy("c", "r", "b").agg(F.sum("n").alias("n")).collect()  # bins alone, whatever the input
    orderly, cuts = [], []
    for c in range(len(CLASSES)):
        own = [x for x in counts if x["c"] == c]
        battery: dict[int, int] = {}
        for x in own:
            battery[x["r"]] = battery.get(x["r"], 0) + x["n"]
        orderly.append(min(BATTERY_BINS, discovery_cut(battery, sum(battery.values()), REJECT)))
        found: dict[int, int] = {}
        for x in own:
            if x["r"] < orderly[c]:
                found[x["b"]] = found.get(x["b"], 0) + x["n"]
        cuts.append(discovery_cut(found, per_class[c]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema) + ", base array<struct<start:int,end:int,kind:string>>, spans array<struct<start:int,end:int,kind:string>>"

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fixed, tests in zip(batch.column("base").to_pylist(), batch.column("tested").to_pylist()):
                bins = surprises(null, [x["token"] for x in tests])
                added = []
                for x, (r, b) in zip(tests, bins):
                    c = length_class(len(x["token"]))
                    if r < orderly[c] and b >= cuts[c]:
                        added.append((b, {"start": x["start"], "end": x["end"], "kind": "random"}))
                out.append(sorted(fixed + apart(added), key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), batch.column("base"), pa.array(out, pa.list_(SPAN))], names=[*carry, "base", "spans"])

    return rows.select(*carry, "base", "tested").mapInArrow(judged, schema)


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
