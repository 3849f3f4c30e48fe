"""Special functions as Column expressions (Spark has no erf, erfc or lgamma).

All builders are closed-form or fixed-length higher-order array expressions,
so they run per row inside the JVM and never touch Python at execution time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

_HALF_LN_2PI = 0.5 * math.log(2.0 * math.pi)
_SQRT_PI = math.sqrt(math.pi)
_SERIES_TERMS = 60        # erf power series below the switch point
_CF_DEPTH = 80            # Laplace continued fraction depth above it
_ERFC_SWITCH = 2.5
_NODES = list(zip(*np.polynomial.legendre.leggauss(40)))  # of the binomial tail's integral
_REACH_STEPS = 12         # to the end of its integrand


def lgamma(x: str | Column) -> Column:
    """log Gamma(x) for x > 0: Stirling series after shifting the argument by 10.

    Relative error of some 1e-15; differences of large values cancel, so probabilities of many
    trials use :func:`binom_log_pmf` instead.
    """
    x = col(x).cast("double")
    z = x + F.lit(10.0)
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    series = inv * (F.lit(1.0 / 12) + inv2 * (F.lit(-1.0 / 360) + inv2 * (F.lit(1.0 / 1260)
             + inv2 * (F.lit(-1.0 / 1680) + inv2 * (F.lit(1.0 / 1188) + inv2 * F.lit(-691.0 / 360360))))))
    stirling = (z - F.lit(0.5)) * F.log(z) - z + F.lit(_HALF_LN_2PI) + series
    shift = sum((F.log(x + F.lit(float(i))) for i in range(1, 10)), F.log(x))
    return stirling - shift


def log_choose(n: str | Column, k: str | Column) -> Column:
    n = col(n).cast("double")
    k = col(k).cast("double")
    return lgamma(n + F.lit(1.0)) - lgamma(k + F.lit(1.0)) - lgamma(n - k + F.lit(1.0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a column used several times would be planned as often."""
    return F.get(F.transform(F.array(value), body), 0)


def _stirling_rest(n: Column) -> Column:
    """log n! less Stirling's formula, for n >= 1: a series from 16 on, below from a table."""
    small = F.array(*[F.lit(math.lgamma(i + 1.0) - (i + 0.5) * math.log(i) + i - _HALF_LN_2PI if i else 0.0) for i in range(16)])

    def series(inv: Column) -> Column:
        return _let(inv * inv, lambda inv2: inv * (F.lit(1.0 / 12) - inv2 * (F.lit(1.0 / 360) - inv2 * (
            F.lit(1.0 / 1260) - inv2 * (F.lit(1.0 / 1680) - inv2 * F.lit(1.0 / 1188))))))

    return F.when(n >= F.lit(16.0), _let(F.lit(1.0) / n, series)).otherwise(F.get(small, n.cast("int")))


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x without cancellation, for x, mean > 0."""
    def near(v: Column) -> Column:
        def rest(v2: Column) -> Column:
            tail = F.lit(1.0 / 25)
            for j in range(11, 0, -1):
                tail = F.lit(1.0 / (2 * j + 1)) + v2 * tail
            return (x - mean) * v + F.lit(2.0) * x * v * v2 * tail
        return F.when(F.abs(v) < F.lit(0.1), _let(v * v, rest)).otherwise(x * F.log(x / mean) + mean - x)
    return _let((x - mean) / (x + mean), near)


def binom_log_pmf(k: Column, n: Column, p: float | Column) -> Column:
    """log P(X = k), X ~ Binomial(n, p), in saddle-point form: no difference of large terms.

    p: a number, or a column of probabilities strictly between 0 and 1.
    """
    p = F.lit(p) if isinstance(p, float) else p

    def of(v: Column) -> Column:
        k, n, p = (v.getField(c) for c in ("k", "n", "p"))
        inner = (_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k)
                 - _deviance(k, n * p) - _deviance(n - k, n * (F.lit(1.0) - p))
                 + F.lit(0.5) * F.log(n / (k * (n - k))) - F.lit(_HALF_LN_2PI))
        return F.when(k <= 0, n * F.log1p(-p)).when(k >= n, n * F.log(p)).otherwise(inner)

    return _let(F.struct(k.cast("double").alias("k"), n.cast("double").alias("n"), p.alias("p")), of)


def _log1p_rest(x: Column) -> Column:
    """x - log(1 + x) without cancellation, for x > -1; 0 or more."""
    def near(v: Column) -> Column:
        def rest(v2: Column) -> Column:
            tail = F.lit(1.0 / 17)
            for j in range(7, 0, -1):
                tail = F.lit(1.0 / (2 * j + 1)) + v2 * tail
            return x * v - F.lit(2.0) * v * v2 * tail
        return F.when(F.abs(x) < F.lit(0.1), _let(v * v, rest)).otherwise(x - F.log1p(x))
    return _let(x / (F.lit(2.0) + x), near)


def binom_sf(successes: str | Column, trials: str | Column, p: float = 0.5) -> Column:
    """P(X >= s) for X ~ Binomial(n, p): the one-sided exact binomial test p-value.

    The tail is the regularised incomplete beta function, n P(Y = s - 1) times an integral, with
    Y ~ Binomial(n - 1, p).  The integrand is taken relative to its value at p, where it is largest
    on the far side of the mean, so its logarithm has no large terms.  It falls by e^-40 within a
    bound found in a few steps, and Gauss-Legendre nodes of a fixed number integrate it up to there.
    On the near side of the mean the other tail is taken from 1.  The work per row is the same for
    any n (a continued fraction of fixed depth would not do near the mean: it takes sqrt(n) terms).
    Relative error under 1e-10 up to 1e12 trials; nothing underflows before the result does.
    """
    if not 0.0 < p < 1.0:
        raise ValueError("p must lie strictly between 0 and 1")
    s = col(successes).cast("double")
    n = col(trials).cast("double")
    nodes = F.array(*[F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in _NODES])

    def tail(v: Column) -> Column:
        a, b, n, p, q = (v.getField(c) for c in ("a", "b", "n", "p", "q"))  # a, b: exponents of t and 1 - t
        slope = (a - (n - F.lit(1.0)) * p) / (p * q)

        def reach(slope: Column) -> Column:
            """A distance below p at which the integrand has fallen by e^-40, or p."""
            def nearer(u: Column, _: Column) -> Column:
                bend = a / (p * p) + b / (q * (q + u))
                return F.least(p, F.try_divide(F.lit(80.0), slope + F.sqrt(slope * slope + F.lit(80.0) * bend)))  # p if flat
            return F.aggregate(F.array(*[F.lit(i) for i in range(_REACH_STEPS)]), F.lit(0.0), nearer)

        def integral(w: Column) -> Column:
            slope, far = w.getField("slope"), w.getField("far")

            def add(total: Column, node: Column) -> Column:
                return total + _let(far * node.getField("x"), lambda u: node.getField("w") * F.exp(
                    -(slope * u + a * _log1p_rest(-u / p) + b * _log1p_rest(u / q))))
            return far * F.aggregate(nodes, F.lit(0.0), add)

        area = _let(slope, lambda m: _let(F.struct(m.alias("slope"), reach(m).alias("far")), integral))
        one = n * F.exp(binom_log_pmf(a, n - F.lit(1.0), p)) * area
        return F.when(v.getField("upper"), one).otherwise(F.lit(1.0) - one)

    def sides(v: Column) -> Column:
        s, n, upper = v.getField("s"), v.getField("n"), v.getField("upper")
        first, second = s - F.lit(1.0), n - s
        return F.struct(F.when(upper, first).otherwise(second).alias("a"), F.when(upper, second).otherwise(first).alias("b"),
                        F.when(upper, F.lit(p)).otherwise(F.lit(1.0 - p)).alias("p"),
                        F.when(upper, F.lit(1.0 - p)).otherwise(F.lit(p)).alias("q"), n.alias("n"), upper.alias("upper"))

    far_side = s - F.lit(1.0) >= (n - F.lit(1.0)) * F.lit(p)
    value = _let(F.struct(s.alias("s"), n.alias("n"), far_side.alias("upper")), lambda v: _let(sides(v), tail))
    return (F.when(s.isNull() | n.isNull(), F.lit(None).cast("double"))
            .when(s <= F.lit(0.0), F.lit(1.0))
            .when(s > n, F.lit(0.0))
            .otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))))


def erfc(x: str | Column) -> Column:
    """Complementary error function, relative error ~1e-13 over the real line.

    |x| < 2.5: erf from the all-positive series 2/sqrt(pi) e^{-x^2} sum 2^n x^{2n+1}/(2n+1)!!;
    |x| >= 2.5: Laplace continued fraction e^{-x^2}/sqrt(pi) / (x + (1/2)/(x + 1/(x + ...))).
    Negative arguments use erfc(-x) = 2 - erfc(x).
    """
    x = col(x).cast("double")
    ax = F.abs(x)
    two_x2 = F.lit(2.0) * ax * ax

    def series_step(acc: Column, i: Column) -> Column:
        t = acc.getField("t")
        nxt = t * two_x2 / (F.lit(2.0) * i.cast("double") + F.lit(1.0))
        return F.struct(nxt.alias("t"), (acc.getField("total") + t).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
                         F.struct(ax.alias("t"), F.lit(0.0).alias("total")), series_step).getField("total")
    erf_small = F.lit(2.0 / _SQRT_PI) * F.exp(-ax * ax) * series
    frac = F.aggregate(F.sequence(F.lit(_CF_DEPTH), F.lit(1)), ax,
                       lambda acc, m: ax + (m.cast("double") * F.lit(0.5)) / acc)
    erfc_large = F.exp(-ax * ax) / (F.lit(_SQRT_PI) * frac)
    pos = F.when(ax < F.lit(_ERFC_SWITCH), F.lit(1.0) - erf_small).otherwise(erfc_large)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x < 0, F.lit(2.0) - pos).otherwise(pos)


def normal_sf(z: str | Column) -> Column:
    """Upper-tail standard normal probability P(Z > z) = erfc(z / sqrt 2) / 2."""
    return F.lit(0.5) * erfc(col(z).cast("double") / F.lit(math.sqrt(2.0)))
