"""URL filters: rules first, then the ratio of two character language models.

URLs that a rule decides train two smoothed variable-order Markov models over characters, one of
the accepted and one of the rejected. Order two is interpolated with order one and that with order
zero, each with KAPPA pseudo-counts of the lower order, so contexts that were seen often count for
themselves and rare ones fall back. A URL without a rule is blocked if its log-likelihood
difference a character lies under a threshold, which is calibrated on labelled URLs of hosts that
are held out of training. Everything is DataFrame code; the model is one array of ALPHABET**3 numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import key_hash, stored, table

#: (verdict, rule): host, then path from the first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Symbols: start, letters, any digit, marks; every other character counts as the last.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0./:-_?=&#%+~"
#: Pseudo-counts of the lower order.
KAPPA = 8.0
#: One in so many hosts, by hash, is held out with all its labelled URLs for calibration.
HELD_OUT = 5
#: Largest share of accepted held-out URLs that the threshold may lose, in percent.
LOSS_PERCENT = 1
#: Log ratios are kept as whole millionths: sums are exact in any order.
UNIT = 1_000_000
#: Width of a calibration bucket in units, and the furthest bucket either way.
BUCKET, FURTHEST = 10_000, 1500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest ends up outermost
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """Numbers of the symbols of a URL behind two starts."""
    low = F.translate(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "123456789", "000000000")
    return F.transform(F.split(F.concat(F.lit("^^"), F.regexp_replace(low, "[^a-z0./:_?=&#%+~-]", "~")), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def contexts(codes: Column) -> Column:
    """Every symbol with the two before it, as one number."""
    a, n = len(ALPHABET), F.size(codes) - 2
    two = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda x, y: x * a + y)
    return F.zip_with(two, F.slice(codes, F.lit(3), n), lambda xy, z: xy * a + z)


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row ``lr``: an array with the log ratio, in units, of each (context, symbol).

    ``counts``: i, accepted, rejected. Its rows are at most ALPHABET**3, whatever the input.
    """
    a = len(ALPHABET)
    n_acc, n_rej = counts.agg(F.coalesce(F.sum("accepted"), F.lit(0)), F.coalesce(F.sum("rejected"), F.lit(0))).first()
    grid = counts.sparkSession.range(a**3).withColumnRenamed("id", "i").join(counts, "i", "left").na.fill(0, ["accepted", "rejected"])
    grid = grid.withColumns({"xy": F.floor(F.col("i") / a), "yz": F.col("i") % (a * a), "z": F.col("i") % a})
    grid = grid.withColumn("y", F.col("xy") % a)
    prob = {}
    for kind, total in (("accepted", n_acc), ("rejected", n_rej)):
        count = {k: F.sum(kind).over(Window.partitionBy(*k)) for k in (("xy",), ("y", "z"), ("y",), ("z",))}
        p0 = (count["z",] + 1.0) / F.lit(float(total + a))
        p1 = (count["y", "z"] + KAPPA * p0) / (count["y",] + KAPPA)
        prob[kind] = (F.col(kind) + KAPPA * p1) / (count["xy",] + KAPPA)
    lr = F.round((F.log(prob["accepted"]) - F.log(prob["rejected"])) * UNIT).cast("long")
    return grid.select("i", lr.alias("lr")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lr"))), lambda x: x["lr"]).alias("lr"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, loss_percent: int = LOSS_PERCENT) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``.

    ``score`` is the log-likelihood difference a character in nats; rows with a rule have one too.
    Null, empty and scheme-less URLs have an empty host and path, so no rule fits and the models
    judge them. Where either class has no labelled URL, or calibration has no accepted one, there
    is nothing to go by and URLs without a rule are allowed. Repeated rows are judged alike; only
    page_id and url are read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), (key_hash(F.col("host"), "url") % HELD_OUT == 0).alias("held"), contexts(symbols(F.col("url"))).alias("grams"))
    rows = stored(rows, "urls")
    trained = rows.filter(F.col("ruled").isNotNull() & ~F.col("held"))
    said = trained.select(F.explode("grams").alias("i"), (F.col("ruled") == "allow").alias("good"))
    counts = stored(said.groupBy(F.col("i").cast("long").alias("i")).agg(F.count_if("good").alias("accepted"), F.count_if(~F.col("good")).alias("rejected")), "url-counts")
    # the model has ALPHABET**3 numbers for any input; as a constant of the plan it is looked up by position
    model = F.split(F.lit(log_ratios(counts).select(F.array_join(F.col("lr").cast("array<string>"), ",")).first()[0]), ",").cast("array<bigint>")
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, i: s + F.get(model, i))
    unit_score = F.when(F.size("grams") > 0, F.floor(total / F.size("grams").cast("double"))).otherwise(0).cast("long")
    scored = rows.withColumn("units", unit_score)
    # calibration: a histogram of at most 2 * FURTHEST + 1 rows
    bucket = F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), F.floor(F.col("units") / float(BUCKET)))).cast("int")
    held = scored.filter(F.col("ruled").isNotNull() & F.col("held")).groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("ruled") == "allow").alias("good")).collect()
    seen = counts.agg(F.max(F.col("accepted") > 0), F.max(F.col("rejected") > 0)).first()
    cut = threshold({r["bucket"]: r["good"] for r in held}, loss_percent) if seen[0] and seen[1] else None
    blocked = F.lit(False) if cut is None else bucket < cut
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"), (F.col("units") / float(UNIT)).alias("score"))


def threshold(good: dict[int, int], loss_percent: int) -> int | None:
    """The largest bucket below which at most ``loss_percent`` of the accepted lie, but none above 0, where both models are as likely; None without any."""
    total, below = sum(good.values()), 0
    if not total:
        return None
    for b in sorted(good):
        if (below + good[b]) * 100 > total * loss_percent:
            return min(b, 0)
        below += good[b]
    return None


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
