"""Resamples are drawn and added up in a task: the draws are those of MD5, and only sums are dealt on."""

from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from interlace.operators import stats


def weight(unit, b):
    head = int(md5((("" if unit is None else f"{unit}:") + str(b)).encode()).hexdigest()[:8], 16) / 2**32
    return sum(head >= p for p in stats.POISSON)


def test_draws_are_those_of_md5():
    units = ["1", "12345678", None, "é" * 10, "x" * 80, *("y" * n for n in range(48, 54)), ""]
    got = stats.draws(units, 2000)
    assert all(got[i, b - 1] == weight(u, b) for i, u in enumerate(units) for b in (1, 9, 10, 99, 100, 101, 999, 1000, 2000))


def test_groups_nulls_and_units_of_many_rows(spark):
    rows = [(u, g, float(u * k) if (u + k) % 4 else None) for u in range(90) for k, g in enumerate("abb" if u % 2 else "a")] + [(None, None, 3.0), (None, "a", None), (7, "n", None)]
    df = spark.createDataFrame(rows, "u long, g string, v double")
    out = stats.bootstrap_mean(df.repartition(3), ["g"], "u", "v", 300)
    got = {r.g: (r.n, r.lo, r.hi) for r in out.collect()}
    for g in ("a", "b"):
        mine = [(u, v) for u, h, v in rows if h == g]
        w = np.array([[weight(u, b) for b in range(1, 301)] for u, _ in mine])
        m = w.T @ [v or 0 for _, v in mine] / w.sum(0)
        assert got[g] == (len(mine), *(round(float(np.percentile(m, q)), 6) for q in (2.5, 97.5)))
    assert got["n"] == (1, None, None) and set(got) == {"a", "b", "n"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and stats.bootstrap_mean(df.limit(0), ["g"], "u", "v", 5).where(F.lit(True)).count() == 0
