"""Personal data: patterns, and spans added by weak supervision.

Fixed patterns find the base spans. Looser patterns propose more candidates. Five labelers vote on
every candidate (for, against, or not at all): pattern, shape, gazetteer, words before, and
characters around. The votes of all candidates of the corpus are counted by pattern of votes, a
table of bounded size, on which expectation-maximisation estimates how reliable each labeler is
and how likely each pattern means personal data. A logistic classifier over votes and shape is
trained on these probabilities and decides on the candidates that no fixed pattern covers.

All work on rows is DataFrame code. Offsets are characters: they follow from the lengths of the
matches and of the gaps between them. Texts of any length and with any number of candidates take
time in proportion: running sums go block by block (:func:`scan`), and characters are reached through
pieces of the text (:func:`chunks_of`) instead of from its start. Candidates are written once, and
both training and judgement read them from there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns. Possessive groups and a look behind keep them linear on long runs; they find
#: the same spans as the plain forms. Cards are matched from 16 digits on, as shorter runs fail anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser candidates: spelt-out addresses, sixteen-byte ips, shorter cards, national phone numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}+(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9](?:[ -]?[0-9]){12,14}+(?![0-9A-Za-z]|[ -][0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})(?:[ ./-]?[0-9]{2,4}){2,4}+(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
LOOSE_NEEDED = {"email": (r"\(at\)|\[at\]| at ", r"\(dot\)|\[dot\]| dot "), "ip": (r"(?:[0-9a-fA-F]{1,4}:){7}",), "card": (r"[0-9](?:[ -]?[0-9]){12}",), "phone": (r"0[0-9]{1,4}\)?(?:[ ./-]?[0-9]{2,4}){2}",)}
#: Gazetteers: ends of domains, country codes, first digits of cards, first parts of ips that name no host.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91")
AREAS = ("01", "02", "030", "040", "05", "069", "07", "0800", "089", "091", "093")
CARDS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "60", "64", "65", "62", "35", "30", "36", "38")
NO_HOSTS = ("0.", "127.", "255.")
#: Words before a span that speak for its kind, and words that speak against any.
FOR = {"email": "mail|contact|write|reach", "ip": "\\bip\\b|server|host|address|client|login", "card": "card|visa|credit|debit|payment|paid", "phone": "tel|phone|call|mobile|fax|whatsapp|ring"}
AGAINST = r"version|isbn|issn|serial|order|invoice|build|section|ref\b|build|sku|article|page"
#: Characters before and after a span that the context labelers see.
BEFORE, AFTER = 40, 2
#: Labelers, rounds of expectation-maximisation, training rounds, and the probability that an added span needs.
LABELERS, ROUNDS, EPOCHS, SURE = 5, 30, 300, 0.9


#: Elements of a block of a running total, and characters of a piece of a text.
BLOCK, CHUNK = 256, 256


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is computed once, however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def scan(xs: Column, most: bool = False) -> Column:
    """For each number (bigint) of an array the sum, or with ``most`` the maximum (at least 0), of those before it.

    Blocks of BLOCK numbers are run through apart, each from the total of the blocks before, so that
    no array grows number by number beyond a block.
    """
    join = (lambda a, b: F.greatest(a, b)) if most else (lambda a, b: a + b)
    zero = F.lit(0).cast("long")

    def before(first: Column, numbers: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(numbers, begin, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def whole(numbers: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda i: F.slice(numbers, i * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, before(zero, F.transform(bs, lambda b: F.aggregate(b, zero, join))), lambda b, o: before(o, b))))

    return let(xs, lambda numbers: F.when(F.size(numbers) > 0, whole(numbers)).otherwise(F.array().cast("array<bigint>")))


def spans_of(text: Column, matches: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches, end exclusive."""
    gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(matches))
    pieces = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"), m.alias("value")))

    def placed(x: Column, before: Column) -> Column:
        start = (before + x["gap"]).cast("int")
        return F.struct(start.alias("start"), (start + x["own"]).alias("end"), x["value"].alias("value"))

    return let(pieces, lambda ps: F.zip_with(ps, scan(F.transform(ps, lambda x: (x["gap"] + x["own"]).cast("long"))), placed))


def chunks_of(text: Column) -> Column:
    """The text in pieces of CHUNK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def near(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, at most CHUNK of them."""
    k = F.floor(start / CHUNK).cast("int")
    two = F.concat(F.coalesce(F.get(chunks, k), F.lit("")), F.coalesce(F.get(chunks, k + 1), F.lit("")))
    return F.substring(two, start - k * CHUNK + 1, end - start)


def part(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, any number of them."""
    i, j = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    first, last = (F.coalesce(F.get(chunks, k), F.lit("")) for k in (i, j))
    whole = F.concat(F.substring(first, start - i * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), end - j * CHUNK))
    return F.when(start >= end, F.lit("")).when(i == j, F.substring(first, start - i * CHUNK + 1, end - start)).otherwise(whole)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = digits(value)

    def add(s: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return s + F.when((F.length(d) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def ip_parts(value: Column) -> Column:
    """Whether all parts are at most 255; leading zeros don't count."""
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(9)).cast("int") <= 255))


def valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda s: ip_parts(s["value"])
    if kind == "card":
        return lambda s: F.when(F.length(digits(s["value"])).between(16, 19), luhn(s["value"])).otherwise(F.lit(False))
    if kind == "phone":
        return lambda s: F.length(digits(s["value"])).between(8, 15)
    return lambda s: F.lit(True)


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(kind: str, base: bool, s: Column, before: Column, after: Column) -> Column:
    """The five votes on a candidate: pattern, shape, gazetteer, words before, characters around."""
    value, d, no = s["value"], digits(s["value"]), F.lit(False)
    if kind == "email":
        end = F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1))
        shape, listed = vote(end.rlike("^[a-z]{2,10}$"), ~end.rlike("^[a-z]{2,}$")), vote(end.isin(*DOMAINS), no)
        strict = vote(value.rlike(r"[(\[]at[)\]]"), value.rlike(r" at ") & value.rlike(r" dot "))
    elif kind == "ip":
        shape, listed = vote(F.lit(True), no), vote(F.lit(True), F.lit(False) if not base else F.greatest(*[value.startswith(p) for p in NO_HOSTS]))
        strict = vote(value.rlike("[a-fA-F]"), ~value.rlike("[1-9a-fA-F]"))
    elif kind == "card":
        ok = luhn(value)
        shape, listed = vote(ok, ~ok), vote(F.greatest(*[d.startswith(p) for p in CARDS]), ~F.greatest(*[d.startswith(p) for p in CARDS]))
        strict = vote(value.rlike("^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}$"), value.rlike("^[0-9]+$"))
    else:
        n = F.length(d)
        shape = vote(n.between(9, 13), ~n.between(8, 15))
        listed = vote(F.greatest(*[d.startswith(p) for p in (COUNTRIES if base else AREAS)]), no)
        strict = vote(value.rlike(r"^\(|^0[0-9]+[ ./-]"), value.rlike("^[0-9]+$"))
    said_by = F.lower(before)
    said = vote(said_by.rlike(FOR[kind]), said_by.rlike(AGAINST))
    glued = before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")
    return F.array(F.lit(1) if base else strict, shape, listed, said, vote(~glued, glued))


def apart(loose: Column, base: Column) -> Column:
    """The loose candidates that touch no base span: both in order of their starts, with the furthest end of a base span
    before each, and the nearest start of one after it."""
    far = 2**31 - 1
    bare = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("o"), b["end"].alias("end"), F.lit(None).cast("int").alias("at")))
    own = F.transform(loose, lambda x, i: F.struct(x["start"].alias("start"), F.lit(1).alias("o"), x["end"].alias("end"), i.alias("at")))

    def alone(mixed: Column) -> Column:
        end_before = scan(F.transform(mixed, lambda x: F.when(x["o"] == 0, x["end"]).otherwise(0).cast("long")), most=True)
        start_after = F.reverse(scan(F.reverse(F.transform(mixed, lambda x: F.when(x["o"] == 0, far - x["start"]).otherwise(0).cast("long"))), most=True))
        left = F.zip_with(mixed, end_before, lambda x, e: F.struct(x.alias("x"), ((x["o"] == 1) & (e <= x["start"])).alias("l")))
        both = F.zip_with(left, start_after, lambda y, f: F.struct(y["x"]["at"].alias("at"), (y["l"] & (far - f >= y["x"]["end"])).alias("ok")))
        return F.transform(F.filter(both, lambda t: t["ok"]), lambda t: F.get(loose, t["at"]))

    return let(F.array_sort(F.concat(bare, own)), alone)


CANDIDATE = "array<struct<kind:string,start:int,end:int,votes:array<int>,shape:int>>"


def candidates(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` with ``base`` and ``loose``: arrays of (kind, start, end, votes, shape) of every row's text."""
    rows = docs.select(*columns, F.coalesce(docs["text"], F.lit("")).alias("_text"))
    text = F.col("_text")
    none = F.array().cast("array<string>")
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    for name, patterns in (("b", BASE), ("l", LOOSE)):
        for kind, p in patterns.items():
            guard = F.lit(True)
            if name == "b" and kind in NEEDED:
                guard = F.contains(text, F.lit(NEEDED[kind]))
            elif name == "l":
                for needed in LOOSE_NEEDED[kind]:
                    guard = guard & text.rlike(needed)
            rows = rows.withColumn(f"_{name}{kind}", F.when(guard, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none))
    for name, patterns in (("b", BASE), ("l", LOOSE)):
        rows = rows.withColumns({f"_{name}{k}": F.when(F.size(f"_{name}{k}") > 0, spans_of(text, F.col(f"_{name}{k}"), p)).otherwise(nothing) for k, p in patterns.items()})
    rows = rows.withColumns({f"_b{k}": F.when(F.size(f"_b{k}") > 0, F.filter(f"_b{k}", valid(k))).otherwise(nothing) for k in KINDS})
    found = sum((F.size(f"_{n}{k}") for n in "bl" for k in KINDS), F.lit(0))
    rows = rows.withColumn("_chunks", F.when(found > 0, chunks_of(text)).otherwise(none))

    def judged(kind: str, base: bool) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            before = near(F.col("_chunks"), F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"])
            after = near(F.col("_chunks"), s["end"], s["end"] + AFTER)
            share = F.floor(F.length(digits(s["value"])) * 3 / F.length(s["value"])).cast("int")
            size = F.least(F.floor(F.length(s["value"]) / 10), F.lit(3)).cast("int")
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes(kind, base, s, before, after).alias("votes"), (size * 4 + share).alias("shape"))

        return one

    empty = F.array().cast(CANDIDATE)
    parts = {name: F.concat(*[F.when(F.size(f"_{name[0]}{k}") > 0, F.transform(f"_{name[0]}{k}", judged(k, name == "base"))).otherwise(empty) for k in KINDS]) for name in ("base", "loose")}
    rows = rows.select(*columns, parts["base"].alias("base"), parts["loose"].alias("loose"))
    return rows.withColumn("loose", F.when((F.size("loose") > 0) & (F.size("base") > 0), apart(F.col("loose"), F.col("base"))).otherwise(F.col("loose")))


def reliabilities(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """The probability of each pattern of votes to mean a true span, by expectation-maximisation.

    Two classes; each labeler votes independently within a class. It starts from the share of votes
    in favour, and one pseudo-count keeps every vote possible.
    """
    p = {v: 1 / (1 + math.exp(-sum(v))) for v in counts}
    for _ in range(ROUNDS):
        total = {y: sum(n * (p[v] if y else 1 - p[v]) for v, n in counts.items()) + 2 for y in (0, 1)}
        odds = math.log(total[1] / total[0])
        rate = [{(x, y): (sum(n * (p[v] if y else 1 - p[v]) for v, n in counts.items() if v[j] == x) + 1) / (total[y] + 1) for x in (-1, 0, 1) for y in (0, 1)} for j in range(LABELERS)]
        p = {v: 1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(math.log(rate[j][x, 1] / rate[j][x, 0]) for j, x in enumerate(v)))))) for v in counts}
    return p


def features(votes_: tuple[int, ...], shape: int) -> list[int]:
    return [0, *(1 + j * 3 + x + 1 for j, x in enumerate(votes_)), 1 + LABELERS * 3 + shape]


N_FEATURES = 1 + LABELERS * 3 + 16


def trained(rows: dict[tuple[tuple[int, ...], int], int], p: dict[tuple[int, ...], float]) -> list[float]:
    """Weights of the logistic span classifier, fitted to the probabilities with a little shrinkage."""
    w, total = [0.0] * N_FEATURES, sum(rows.values()) or 1
    data = [(features(v, s), n / total, p[v]) for (v, s), n in sorted(rows.items())]
    for _ in range(EPOCHS):
        grad = [0.001 * x for x in w]
        for at, share, goal in data:
            z = sum(w[i] for i in at)
            error = share * (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - goal)
            for i in at:
                grad[i] += error
        w = [x - 2.0 * g for x, g in zip(w, grad)]
    return [round(x, 9) for x in w]


def fit(found: DataFrame) -> dict[str, list[float]]:
    """Weights of the span classifier of each kind, from the votes on all :func:`candidates` of all rows.

    What is gathered are counts by kind, votes and shape: at most 4 * 3**5 * 16 rows.
    """
    counts = found.select(F.explode(F.concat("base", "loose")).alias("c")).groupBy("c.kind", "c.votes", "c.shape").count().collect()
    out = {}
    for kind in KINDS:
        own = {(tuple(r["votes"]), r["shape"]): r["count"] for r in counts if r["kind"] == kind}
        by_votes: dict[tuple[int, ...], int] = {}
        for (v, _), n in own.items():
            by_votes[v] = by_votes.get(v, 0) + n
        out[kind] = trained(own, reliabilities(by_votes))
    return out


def judged_spans(found: DataFrame, weights: dict[str, list[float]], columns: tuple[str, ...]) -> DataFrame:
    """``columns``, ``base`` and ``spans`` of :func:`candidates`: base spans and the loose ones that the classifier is sure of."""
    model = F.array(*[F.array(*[F.lit(x) for x in weights[k]]) for k in KINDS])
    order = F.array(*[F.lit(k) for k in KINDS])

    def sure(c: Column) -> Column:
        own = F.get(model, F.array_position(order, c["kind"]).cast("int") - 1)
        z = F.get(own, F.lit(0)) + F.get(own, c["shape"] + (1 + LABELERS * 3))
        for j in range(LABELERS):
            z = z + F.get(own, F.get(c["votes"], F.lit(j)) + (2 + j * 3))
        return z >= math.log(SURE / (1 - SURE))

    def bare(xs: Column) -> Column:
        keyed = F.array_sort(F.transform(xs, lambda c: F.struct(F.array_position(order, c["kind"]).alias("o"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
        return F.transform(keyed, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    added = F.when(F.size("loose") > 0, F.filter("loose", sure)).otherwise(F.col("loose"))
    rows = found.select(*columns, bare(F.col("base")).alias("_base"), bare(F.concat("base", added)).alias("_spans"))
    return rows.select(*columns, F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def find_pii(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row, ``base`` and ``spans``: arrays of (kind, start, end), by kind and start.

    Null and empty texts have no spans. Repeated rows are judged alike, an empty table gives an
    empty result, and only text and ``columns`` are read, so further columns of any name but base,
    loose and spans do no harm. Base spans always stay; added ones touch no base span.
    """
    found = stored(candidates(docs, columns), "pii-candidates")
    return judged_spans(found, fit(found), columns)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; of spans that overlap, the first names the place."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rebuilt(chunks: Column, ordered: Column) -> Column:
        end_before = scan(F.transform(ordered, lambda s: s["end"].cast("long")), most=True)
        parts = F.zip_with(ordered, end_before, lambda s, e: F.when(s["start"] < e, F.lit("")).otherwise(F.concat(part(chunks, e.cast("int"), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        last = F.array_max(F.transform(ordered, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), part(chunks, last, F.size(chunks) * CHUNK))

    return F.when(F.size(spans) > 0, let(chunks_of(text), lambda chunks: let(by_start, lambda ordered: rebuilt(chunks, ordered)))).otherwise(text)


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
