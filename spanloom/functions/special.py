"""Special functions as Column expressions, so that they stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rational approximation of the normal distribution function (West 2005), good to about 1e-15. Fixed values.
TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BOTTOM = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT = 7.07106781186547


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_sf(z: Column) -> Column:
    """1 - Phi(z). Null for null and NaN."""
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    tail = x + 0.65
    for k in (4, 3, 2, 1):
        tail = x + F.lit(float(k)) / tail
    upper = F.when(x > 37, 0.0).when(x < SPLIT, e * _horner(x, TOP) / _horner(x, BOTTOM)).otherwise(e / tail / math.sqrt(2 * math.pi))
    return F.when(F.isnan(z), F.lit(None)).when(z < 0, 1 - upper).otherwise(upper)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; lambdas have no other way to name one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The least number that a continued fraction divides by.
TINY = 1e-300


def _fraction(terms: Column, numerator: Callable[[Column], Column], denominator: Callable[[Column], Column], first: Column) -> Column:
    """A continued fraction first + n(1) / (d(1) + n(2) / (d(2) + ...)), as many terms as asked, by the modified method of Lentz."""
    safe = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)
    start = safe(first)

    def step(s: Column, k: Column) -> Column:
        a, b = numerator(k), denominator(k)
        d, c = 1 / safe(b + a * s["d"]), safe(b + a / s["c"])
        return F.struct((s["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

    zero = F.struct(start.alias("f"), start.alias("c"), F.lit(0.0).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), terms), zero, step, lambda s: s["f"])


def gamma_p(a: Column, x: Column) -> Column:
    """The regularised lower incomplete gamma function for a > 0: by its series below a + 1, else by one minus its continued fraction."""
    n = (F.lit(60) + F.ceil(8 * F.sqrt(F.greatest(a, F.lit(1.0))))).cast("int")

    def held(s: Column) -> Column:
        a, x, lead = s["a"], s["x"], s["lead"]
        series = F.aggregate(F.sequence(F.lit(1), s["n"]), F.struct((1 / a).alias("t"), (1 / a).alias("s")), lambda acc, k: F.struct((acc["t"] * x / (a + k)).alias("t"), (acc["s"] + acc["t"] * x / (a + k)).alias("s")), lambda acc: acc["s"])
        tail = 1 / _fraction(s["n"], lambda k: -k * (k - a), lambda k: x + 2 * k + 1 - a, x + 1 - a)
        return F.when(x <= 0, 0.0).when(x < a + 1, lead * series).otherwise(1 - lead * tail)

    lead = F.when(x > 0, F.exp(a * F.log(F.when(x > 0, x)) - x - lgamma(a))).otherwise(0.0)
    return bound(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x"), lead.alias("lead"), n.alias("n")), held)


def beta_i(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a, b > 0 by its continued fraction, from the side where that converges fast."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.when(turned, 1 - x).otherwise(x)
    n = (F.lit(100) + F.ceil(4 * F.sqrt(F.greatest(a, b, F.lit(1.0))))).cast("int")

    def held(s: Column) -> Column:
        p, q, z = s["p"], s["q"], s["z"]

        def numerator(k: Column) -> Column:
            m = F.floor(k / 2)
            return F.when(k % 2 == 0, m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))).otherwise(-(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)))

        inner = s["lead"] / p / _fraction(s["n"], numerator, lambda k: F.lit(1.0), F.lit(1.0))
        return F.when(s["turned"], 1 - inner).otherwise(inner)

    lead = F.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * F.log(F.when(z > 0, z)) + q * F.log(F.when(z < 1, 1 - z)))
    found = bound(F.struct(p.alias("p"), q.alias("q"), z.alias("z"), lead.alias("lead"), n.alias("n"), turned.alias("turned")), held)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(found)


#: Counts up to which their probabilities are added one by one, and the least probability of 0 that this starts from.
FEW, LEAST = 256, 1e-290


def count_span(y: Column, mu: Column, alpha: Column) -> Column:
    """A struct of ``below`` and ``upto``, P(count < y) and P(count <= y), of a Poisson count of mean mu where alpha is 0, else of a negative binomial one of variance mu + alpha * mu^2; y whole, both 0 below 0.

    Small counts are a plain sum of probabilities, which gives both in one fold; all others an
    incomplete gamma or beta function.
    """
    both = lambda below, upto: F.struct(below.alias("below"), upto.alias("upto"))

    def held(s: Column) -> Column:
        y, mu, size, none, ratio = (s[k] for k in ("y", "mu", "size", "none", "ratio"))
        # p is the last probability, s the sum of those before it
        growth = lambda k: F.coalesce((size + k - 1) / k * ratio, ratio / k)
        terms = F.when(y >= 1, F.sequence(F.lit(1), y.cast("int"))).otherwise(F.array().cast("array<int>"))
        few = F.aggregate(terms, F.struct(none.alias("p"), F.lit(0.0).alias("s")), lambda a, k: F.struct((a["p"] * growth(k)).alias("p"), (a["s"] + a["p"]).alias("s")), lambda a: both(F.least(a["s"], F.lit(1.0)), F.least(a["s"] + a["p"], F.lit(1.0))))
        many = lambda y: F.when(size.isNull(), 1 - gamma_p(y + 1, mu)).otherwise(beta_i(size, y + 1, size / (size + mu)))
        rest = both(F.when(y < 1, 0.0).otherwise(many(y - 1)), many(y))
        return F.when(y < 0, both(F.lit(0.0), F.lit(0.0))).when(mu <= 0, both(F.when(y < 1, 0.0).otherwise(1.0), F.lit(1.0))).when((y <= FEW) & (none > LEAST), few).otherwise(rest)

    mu, size = mu.cast("double"), 1 / F.when(alpha > 0, F.greatest(alpha.cast("double"), F.lit(1e-12)))
    none = F.exp(F.when(size.isNull(), -mu).otherwise(-size * F.log1p(mu / size)))
    ratio = F.when(size.isNull(), mu).otherwise(mu / (size + mu))
    return bound(F.struct(y.cast("double").alias("y"), mu.alias("mu"), size.alias("size"), none.alias("none"), ratio.alias("ratio")), held)


def count_cdf(y: Column, mu: Column, alpha: Column) -> Column:
    """P(count <= y) as in :func:`count_span`."""
    return count_span(y, mu, alpha)["upto"]


#: Rational approximation of the normal quantile (Acklam 2003), good to 1.2e-9. Fixed values.
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_FROM = 0.02425


def normal_quantile(p: Column) -> Column:
    """The z of which P(Z <= z) = p: minus and plus infinity at 0 and 1, null outside and for null. One step of Halley's method mends the approximation."""

    def lower(low: Column) -> Column:
        q = F.sqrt(-2 * F.log(F.when(low > 0, low)))
        r = low - 0.5
        start = F.when(low < TAIL_FROM, _horner(q, TAIL_TOP) / _horner(q, TAIL_BOTTOM)).otherwise(r * _horner(r * r, MIDDLE_TOP) / _horner(r * r, MIDDLE_BOTTOM))

        def mended(z: Column) -> Column:
            u = (normal_sf(-z) - low) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
            return z - u / (1 + z * u / 2)

        return bound(start, mended)

    def whole(p: Column) -> Column:
        sign = F.when(p > 0.5, -1.0).otherwise(1.0)
        return F.when((p < 0) | (p > 1) | F.isnan(p), F.lit(None)).when(p == 0, float("-inf")).when(p == 1, float("inf")).otherwise(sign * bound(F.least(p, 1 - p), lower))

    return bound(p, whole)


def digamma(x: Column) -> Column:
    """The derivative of lgamma for x > 0: its asymptotic series at x + 8, brought back by the recurrence."""
    y = x + 8
    i = 1 / (y * y)
    series = F.log(y) - 1 / (2 * y) - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    return series - sum((1 / (x + k) for k in range(1, 8)), 1 / x)


def trigamma(x: Column) -> Column:
    """The derivative of digamma for x > 0."""
    y = x + 8
    i = 1 / (y * y)
    series = (1 / y) * (1 + 1 / (2 * y) + i * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66)))))
    return series + sum((1 / ((x + k) * (x + k)) for k in range(1, 8)), 1 / (x * x))


def clean(x: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def cauchy_combined(p_values: Column, clip: float = 1e-15) -> Column:
    """One p-value from an array of p-values: nulls left out, values kept inside [clip, 1 - clip]."""
    kept = F.filter(p_values, lambda p: p.isNotNull() & ~F.isnan(p))
    total = F.aggregate(kept, F.lit(0.0), lambda s, p: s + F.tan(math.pi * (0.5 - F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip)))))
    return F.when(F.size(kept) > 0, 0.5 - F.atan(total / F.size(kept)) / math.pi)


#: Draws are numbers below this prime, which products of two of them in 64 bits allow.
PRIME = 2147483647


def draw(a: Column, b: Column, seed: int, inside: bool = False) -> Column:
    """A number from 0 to PRIME - 1 that looks random in (a, b, seed) and that any engine can compute.

    Squares modulo a prime between linear steps: draws of neighbouring numbers have nothing in common.
    ``inside`` a lambda each step has to be named, or it is made twice for each step after it.
    """
    a, b = F.pmod(a.cast("long"), F.lit(PRIME)), F.pmod(b.cast("long"), F.lit(PRIME))
    h = F.pmod(a * 48271 + b * 69621 + F.lit(seed % PRIME * 16807 + 1), F.lit(PRIME))
    for factor, other in ((39373, a), (40692, b), (62089, a), (25214, b)):
        step = partial(_squared, other * factor + 12345)
        h = bound(h, lambda v: step(v)) if inside else step(h)  # noqa: B023
    return h


def _squared(more: Column, h: Column) -> Column:
    return F.pmod(h * h + more, F.lit(PRIME))
