"""Special functions against Python's math module, including the far tails."""

import math

import pytest

from stancelab.functions.stats import binom_sf, erfc, lgamma, normal_sf


def exact_binom_sf(s, n, p=0.5):
    from fractions import Fraction
    pf = Fraction(p).limit_denominator(10**9)
    tot = sum(math.comb(n, k) * pf**k * (1 - pf) ** (n - k) for k in range(max(s, 0), n + 1))
    return float(tot)


def rel(a, b):
    return abs(a - b) / max(abs(b), 1e-300)


def test_lgamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 55.5, 1000.0, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(lgamma("x")).collect()]
    for x, g in zip(xs, got):
        assert abs(g - math.lgamma(x)) < 1e-12 * max(1.0, abs(math.lgamma(x)))


@pytest.mark.parametrize("s,n", [(112, 179), (112, 121), (37, 49), (37, 44), (0, 10), (10, 10), (11, 10),
                                  (1, 1), (5, 1000), (500, 1000), (990, 1000), (3000, 5000), (1, 6000)])
def test_binom_sf_matches_exact(spark, s, n):
    df = spark.createDataFrame([(s, n)], "s long, n long")
    got = df.select(binom_sf("s", "n")).first()[0]
    want = exact_binom_sf(s, n)
    if want > 1e-300:
        assert rel(got, want) < 1e-10, (got, want)
    else:
        assert got < 1e-290


def test_binom_sf_published_values(spark):
    # the study's four forecast tests
    rows = [(112, 179, 4.764e-04), (112, 121, 4.613e-24), (37, 49, 2.349e-04), (37, 44, 2.650e-06)]
    df = spark.createDataFrame([(s, n) for s, n, _ in rows], "s long, n long")
    got = [r[0] for r in df.select(binom_sf("s", "n")).collect()]
    for g, (_, _, w) in zip(got, rows):
        assert rel(g, w) < 1e-3


def test_binom_sf_other_p(spark):
    df = spark.createDataFrame([(30, 100)], "s long, n long")
    got = df.select(binom_sf("s", "n", p=0.25)).first()[0]
    assert rel(got, exact_binom_sf(30, 100, 0.25)) < 1e-10


def test_erfc_and_normal_sf(spark):
    xs = [-3.0, -1.2, -0.1, 0.0, 1e-8, 0.3, 1.0, 2.0, 2.4999, 2.5, 3.0, 5.0, 8.0, 12.0, 26.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(erfc("x").alias("e"), normal_sf("x").alias("p")).collect()
    for x, r in zip(xs, got):
        assert rel(r.e, math.erfc(x)) < 1e-11, (x, r.e, math.erfc(x))
        want = 0.5 * math.erfc(x / math.sqrt(2))
        assert rel(r.p, want) < 1e-11


def test_erfc_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(erfc("x")).first()[0] is None


def test_binomial_terms_of_many_trials(spark):
    """Against logarithms in 60 digits: no digits are lost as the number of trials grows."""
    from decimal import Decimal, getcontext

    from pyspark.sql import functions as F

    from stancelab.functions.stats import binom_log_pmf
    getcontext().prec = 60

    def log_factorial(n):  # Stirling's series, far beyond double precision for n >= 1000
        x = Decimal(n + 1)
        pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
        bernoulli = [(1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510)]
        rest = sum(Decimal(a) / b / (2 * i * (2 * i - 1) * x ** (2 * i - 1)) for i, (a, b) in enumerate(bernoulli, 1))
        return (x - Decimal("0.5")) * x.ln() - x + (2 * pi).ln() / 2 + rest

    rows = [(n, k) for n in (4_000, 10**6, 10**9, 10**12) for k in (n // 2, n // 2 + int(2 * n**0.5), n // 2 - n // 1000)]
    df = spark.createDataFrame([(float(n), float(k)) for n, k in rows], "n double, k double")
    got = df.select(binom_log_pmf(F.col("k"), F.col("n"), 0.5)).collect()
    for (n, k), (value,) in zip(rows, got):
        want = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * Decimal(2).ln()
        assert abs(Decimal(value) - want) < Decimal("1e-11") * max(1, abs(want)), (n, k)


def test_binom_sf_of_many_trials(spark):
    """Against the same tails summed in 50 digits, near the mean, far out and on the other side."""
    from decimal import Decimal, getcontext
    getcontext().prec = 50

    def tail(s, n, first):
        """P(X = s) and on, for a fair coin, from P(X = s)."""
        total, term, k = Decimal(0), first, s
        while term > total * Decimal(10) ** -18:
            total += term
            term *= Decimal(n - k) / (k + 1)
            k += 1
        return total

    def log_factorial(n):
        x = Decimal(n + 1)
        pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
        bernoulli = [(1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510)]
        rest = sum(Decimal(a) / b / (2 * i * (2 * i - 1) * x ** (2 * i - 1)) for i, (a, b) in enumerate(bernoulli, 1))
        return (x - Decimal("0.5")) * x.ln() - x + (2 * pi).ln() / 2 + rest

    cases = [(n, n // 2 + int(z * n**0.5 / 2)) for n, zs in ((10**4, (0, 1, 5, 20)), (10**6, (0, 0.01, 3, 30)),
                                                             (10**8, (2, 20)), (10**12, (300, 1000))) for z in zs]
    rows = [(s, n) for n, s in cases] + [(n + 1 - s, n) for n, s in cases]
    df = spark.createDataFrame(rows, "s long, n long")
    got = [r[0] for r in df.select(binom_sf("s", "n")).collect()]
    for (s, n), value, other in zip(rows, got, got[len(cases):]):
        want = tail(s, n, (log_factorial(n) - log_factorial(s) - log_factorial(n - s) - n * Decimal(2).ln()).exp())
        if want > Decimal("1e-290"):
            assert abs(Decimal(value) / want - 1) < Decimal("1e-10"), (s, n, value, want)
        assert abs(value + other - 1) < 1e-10  # P(X >= s) + P(X >= n + 1 - s) of a fair coin
    # half of an odd number of trials, however many
    odd = spark.createDataFrame([((n + 1) // 2, n) for n in (1, 99, 10**6 + 1, 10**9 + 1, 10**12 + 1)], "s long, n long")
    assert all(abs(r[0] - 0.5) < 1e-10 for r in odd.select(binom_sf("s", "n")).collect())


def test_binom_sf_on_a_grid(spark):
    rows = [(s, n) for n in (1, 2, 3, 7, 40, 179, 300) for s in range(0, n + 2, max(1, n // 12))]
    df = spark.createDataFrame(rows, "s long, n long")
    for p in (0.5, 0.01, 0.9):
        for (s, n), r in zip(rows, df.select(binom_sf("s", "n", p=p)).collect()):
            want = exact_binom_sf(s, n, p)
            assert rel(r[0], want) < 1e-10 or want < 1e-290, (s, n, p, r[0], want)


def test_binom_sf_plans_quickly(spark):
    """Values are bound once, so the plan stays small; no array grows with the trials."""
    import time
    df = spark.createDataFrame([(600_000, 1_000_000)], "s long, n long").select(binom_sf("s", "n").alias("p"))
    df.collect()
    began = time.time()
    plan = spark.createDataFrame([(1, 2)], "s long, n long").select(binom_sf("s", "n").alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan
    assert time.time() - began < 2.0
