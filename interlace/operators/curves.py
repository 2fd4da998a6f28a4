"""Quantile regression, densities and joint tests, from grouped sums."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.operators.lineage import cut


def quantile_fit(df: DataFrame, x: list[str], y: str, levels: list[float], rounds: int = 400, close: float = 1e-5) -> np.ndarray:
    """Coefficients of each level (a row each), by majorising the check loss.

    Each round solves least squares with weights 1 / (e + |residual|), whose sums for all levels are made in one pass
    over the rows, counted by (x, y) first; e falls from the spread of y to a hundred-thousandth of it.
    """
    k = len(x)
    data = cut(df.groupBy(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("y")).agg(F.count("*").cast("double").alias("n")).where(" and ".join([*[f"x{i} is not null" for i in range(k)], "y is not null"])))
    spread = data.agg(F.stddev_pop("y")).first()[0] or 1.0
    tau, beta, e, upper = np.array(levels), None, float(spread), [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds):
        held, small = beta, e

        def sums(batches: Iterator[pa.RecordBatch], held: np.ndarray | None = held, small: float = small) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(tau), len(upper) + 2 * k))
            for batch in batches:
                rows, out, n = np.stack([batch.column(f"x{i}").to_numpy() for i in range(k)], 1), batch.column("y").to_numpy(), batch.column("n").to_numpy()
                w = np.ones((len(out), len(tau))) if held is None else 1 / (small + np.abs(out[:, None] - rows @ held.T))
                w = w * n[:, None]
                total[:, : len(upper)] += w.T @ np.stack([rows[:, i] * rows[:, j] for i, j in upper], 1)
                total[:, len(upper) : len(upper) + k] += (w * out[:, None]).T @ rows
                total[:, len(upper) + k :] += n @ rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tau)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["level", "sums"])

        each = data.mapInArrow(sums, "level int, sums array<double>").groupBy("level").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(len(upper) + 2 * k)])
        new = np.zeros((len(tau), k))
        for r in each.collect():  # a row for each level
            h, s = np.zeros((k, k)), np.array(r[1:], float)
            for v, (i, j) in zip(s, upper, strict=False):
                h[i, j] = h[j, i] = v
            lean = 0 if held is None else 2 * tau[r["level"]] - 1
            new[r["level"]] = np.linalg.pinv(h) @ (s[len(upper) : len(upper) + k] + lean * s[len(upper) + k :])
        moved = np.inf if held is None else np.abs(new - held).max()
        beta = new
        if moved < close * spread and e <= 1e-5 * spread:
            break
        e = max(e * 0.6, 1e-5 * spread)
    return beta


def quantile_regression(df: DataFrame, x: list[str], y: str, levels: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95), digits: int = 3) -> DataFrame:
    """level, term, estimate: linear quantiles of y. Rows with a null are left out; x holds the intercept, too."""
    beta = quantile_fit(df, x, y, list(levels))
    rows = [(float(t), c, round(float(b), digits) + 0.0) for t, bs in zip(levels, beta, strict=True) for c, b in zip(x, bs, strict=True)]
    return df.sparkSession.createDataFrame(rows, "level double, term string, estimate double")


def densities(df: DataFrame, by: list[str], value: str, width: float, reach: float = 4.0, least: int = 5) -> DataFrame:
    """by, point, density: a Gaussian density on a grid of this width from the least to the greatest value, bandwidth
    by Scott's rule (sample spread times n to the -1/5).

    Values are counted by grid point first, so the work is grid points times the points within ``reach`` bandwidths;
    groups of fewer than ``least`` values or without spread are left out, and so are null values.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    facts = known.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high")).where((F.col("n") >= least) & (F.col("sd") > 0)).withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    counts = known.groupBy(*by, F.round(F.col("v") / width).cast("long").alias("bin")).agg(F.count("*").alias("k"))
    near = counts.join(facts, by).withColumn("point", F.explode(F.sequence(F.greatest(F.col("bin") - F.ceil(reach * F.col("h") / width), F.round(F.col("low") / width).cast("long")), F.least(F.col("bin") + F.ceil(reach * F.col("h") / width), F.round(F.col("high") / width).cast("long")))))
    z = (F.col("point") - F.col("bin")) * width / F.col("h")
    kernel = F.when(F.abs(z) <= reach, F.exp(-z * z / 2)).otherwise(0.0)
    return near.groupBy(*by, "point").agg(F.round(F.sum(F.col("k") * kernel / (F.col("n") * F.col("h"))) / float(np.sqrt(2 * np.pi)), 6).alias("density")).select(*by, F.round(F.col("point") * width, 6).alias("point"), "density")


def chi_square_tail(x: float, df: int) -> float:
    """The chance of a chi-square variable of so many degrees above x: the upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:  # series of the lower part
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * exp(-x + a * log(x) - lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)  # continued fraction of the upper part
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * exp(-x + a * log(x) - lgamma(a))


def joint_wald(estimates: np.ndarray, covariance: np.ndarray, at: list[int]) -> tuple[float, int, float]:
    """chi2, df, p of these coefficients being zero together."""
    b, v = estimates[at], covariance[np.ix_(at, at)]
    stat = float(b @ np.linalg.pinv(v) @ b)
    rank = int(np.linalg.matrix_rank(v))
    return stat, rank, chi_square_tail(stat, rank)
