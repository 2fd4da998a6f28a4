"""Zero-inflated fits against direct maximisation, closed forms and known values; diagnostics against numpy."""

from math import exp, lgamma, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from interlace.operators import inflated


def drawn(n, seed, negbin):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 5, n) / 2
    mu = np.exp(0.6 + 0.5 * v)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, n) if negbin else mu)
    return [(1.0, float(a), int(b)) for a, b in zip(v, np.where(rng.random(n) < 1 / (1 + np.exp(0.8 - 0.4 * v)), 0, y), strict=True)]


def likelihood(rows, theta, negbin):
    total = 0.0
    for one, v, y in rows:
        mu, pi = exp(theta[0] + theta[1] * v), 1 / (1 + exp(-theta[2] - theta[3] * v))
        if negbin:
            r = exp(theta[4])
            p = exp(lgamma(y + r) - lgamma(r) - lgamma(y + 1) + r * log(r / (r + mu)) + y * log(mu / (r + mu)))
        else:
            p = exp(y * log(mu) - mu - lgamma(y + 1))
        total += log((pi if y == 0 else 0) + (1 - pi) * p)
    return total


@pytest.mark.parametrize("family", ["poisson", "negbin"])
def test_direct_maximisation(spark, family):
    negbin = family == "negbin"
    rows = drawn(1500, 4, negbin)
    fit = inflated.zero_inflated(spark.createDataFrame(rows, "one double, v double, y long"), ["one", "v"], ["one", "v"], "y", family)
    assert fit.settled and all(b >= a for a, b in zip(fit.likelihoods, fit.likelihoods[1:], strict=False))
    best = likelihood(rows, fit.theta, negbin)
    assert best == pytest.approx(fit.likelihoods[-1], abs=1e-6)
    size, h = len(fit.theta), 1e-3
    bump = lambda *at: likelihood(rows, fit.theta + sum(s * h * np.eye(size)[i] for i, s in at), negbin)
    # no direction rises, and the information is that of differences
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1e-2, 0.1, 0.5):
        assert all(likelihood(rows, fit.theta + scale * d, negbin) < best for d in rng.normal(size=(6, size)))
    for i in range(size):
        assert (bump((i, 1)) - bump((i, -1))) / (2 * h) == pytest.approx(0, abs=2e-2)
    hessian = np.array([[(bump((i, 1), (j, 1)) - bump((i, 1), (j, -1)) - bump((i, -1), (j, 1)) + bump((i, -1), (j, -1))) / (4 * h * h) for j in range(size)] for i in range(size)])
    assert np.allclose(np.linalg.inv(-hessian), fit.covariance, rtol=2e-3, atol=1e-6)
    truth = [0.6, 0.5, -0.8, 0.4, log(2)][:size]
    assert np.all(np.abs(fit.theta - truth) < 4 * np.sqrt(np.diag(fit.covariance)))


def test_groups_are_met_exactly(spark):
    df = spark.createDataFrame([(1.0, v, y) for _, v, y in drawn(600, 9, False)], "one double, v double, y long").withColumn("high", (F.col("v") > 1).cast("double"))
    for r in inflated.fitted_zeros(df, ["one", "high"], "y").collect():
        assert r.total == pytest.approx(r.fitted_total, abs=2e-3) and r.zeros == pytest.approx(r.fitted_zeros, abs=2e-3) and r.zeros > 0


def test_nulls_empty_and_negative(spark):
    schema = "one double, y long"
    rows = [(1.0, y) for y in [0] * 30 + [2, 3, 4, 5, 3, 4] * 5]
    fit = lambda r: inflated.zero_inflated(spark.createDataFrame(r, schema), ["one"], ["one"], "y")
    assert np.allclose(fit(rows).theta, fit([*rows, (None, 9), (1.0, None)]).theta)
    assert not fit([]).settled
    with pytest.raises(ValueError):
        fit([*rows, (1.0, -1)])


def test_diagnostics(spark):
    rng = np.random.default_rng(2)
    y, f = rng.poisson(3, 400), np.exp(rng.normal(1, 0.4, 400))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, f, strict=True)] + [(None, 1.0), (4, None), (4, -1.0)], "y long, f double")
    got = {(r.model, r.bin): r for r in inflated.diagnostics(df, "y", {"a": F.col("f"), "b": F.lit(3.0)}).collect()}
    bins = np.floor(np.log10(f) * 10).astype(int)
    for b in set(bins):
        at, r = bins == b, got["a", b]
        assert (r.n, r.observed, r.residual, r.spread) == (at.sum(), pytest.approx(y[at].mean(), abs=1e-4), pytest.approx((y - f)[at].mean(), abs=1e-4), pytest.approx((y - f)[at].std(), abs=1e-4))
    assert got["a", None].n == 1 and got["b", 4].n == 402
