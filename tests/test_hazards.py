"""Spells against a loop over waves, hazards against Newton's steps in numpy on all rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from interlace.operators import hazards

SPELLS = ["year", "person", "tenure", "entry", "exit", "gap"]


def by_loop(ties, permanent):
    waves, out = sorted({y for y, _ in ties}), set()
    for unit in {p for _, p in ties}:
        years, tenure = sorted(y for y, p in ties if p == unit), 0
        for i, wave in enumerate(waves):
            if wave < years[0]:
                continue
            if wave not in years:
                if permanent:
                    continue
                break
            tenure += 1
            if i + 1 < len(waves):
                gone = wave == years[-1] if permanent else waves[i + 1] not in years
                out.add((wave, unit, tenure, years[0], int(gone), waves[i + 1] - wave))
    return out


def test_spells(spark):
    rng = random.Random(3)
    ties = {(y, p) for y in (1932, 1937, 1938, 1944, 1950) for p in range(60) if rng.random() < 0.6}
    df = spark.createDataFrame([(y, p, f) for y, p in ties for f in (1, 2)], "year long, person long, firm long")
    for permanent in (False, True):
        assert {tuple(r) for r in hazards.spells(df, "person", permanent).select(*SPELLS).collect()} == by_loop(ties, permanent)
    assert hazards.spells(df.where("false"), "person").count() == 0


def in_numpy(x, y, offset, units):
    beta = np.zeros(x.shape[1])
    beta[0] = -2  # from 0 the steps overshoot
    for _ in range(60):
        e = np.exp(x @ beta + offset)
        mu = 1 - np.exp(-e)
        slope = e * np.exp(-e)
        info = x.T @ (x * (slope**2 / (mu * (1 - mu)))[:, None])
        score = x * ((y - mu) * slope / (mu * (1 - mu)))[:, None]
        beta = beta + np.linalg.solve(info, score.sum(0))
    sums = np.stack([score[units == u].sum(0) for u in np.unique(units)])
    g, (n, k) = len(sums), x.shape
    return beta, np.linalg.inv(info) @ sums.T @ sums @ np.linalg.inv(info) * g / (g - 1) * (n - 1) / (n - k)


def test_hazards(spark):
    rng = np.random.default_rng(6)
    n = 900
    unit, a, c, gap = rng.integers(0, 150, n), rng.integers(0, 2, n), rng.integers(1, 4, n), rng.integers(1, 6, n)
    y = (rng.random(n) < 1 - np.exp(-np.exp(-2 + 0.7 * a + 0.2 * c) * gap)).astype(int)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(unit, a, c, gap, y, strict=True)], "unit long, a int, c int, gap int, exit int")
    x = np.stack([np.ones(n), a, c == 2, c == 3], 1).astype(float)
    beta, cov = in_numpy(x, y, np.log(gap), unit)
    dirty = df.union(spark.createDataFrame([(1, None, 2, 3, 1), (1, 0, 2, None, 1), (2, 1, None, 1, 0), (2, 1, 2, 1, None)], df.schema))
    names, got, got_cov, rows, events = hazards.hazard_fit(dirty, ["a"], ["c"], "unit")
    assert names == ["one", "a", "c=2", "c=3"] and (rows, events) == (n, y.sum())
    assert np.allclose(got, beta, atol=1e-7) and np.allclose(got_cov, cov, rtol=1e-5, atol=1e-10)
    table = {r.specification: r for r in hazards.nested_hazards(df, "a", {"alone": ([], []), "beside": ([], ["c"])}, "unit").collect()}
    assert abs(table["beside"].coefficient - beta[1]) < 1e-6 and table["beside"].lo < table["beside"].hr < table["beside"].hi and table["beside"].p < 0.001
    found = {r.variant: r for r in hazards.sensitivity({"all": (df, "a"), "late": (df.where("gap > 1").withColumn("b", 1 - F.col("a")), "b")}, [], ["c"], "unit").collect()}
    assert found["all"].hr == table["beside"].hr and found["late"].n == (gap > 1).sum() and found["late"].hr < 1
