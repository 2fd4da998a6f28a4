"""Spells until exit, nested hazard models of them, and what one term comes to when a definition changes."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlace.operators import panel
from interlace.operators.lineage import cut


def spells(ties: DataFrame, unit: str, permanent: bool = False) -> DataFrame:
    """year, <unit>, tenure, entry, exit, gap: the waves in which a unit can leave before the next.

    A spell ends with the first wave that lacks the unit. If ``permanent``, units may come back: every wave that has the
    unit counts, and exit is its last. entry is the unit's first year, gap the years to the next wave; the last
    wave has no next one and is left out. A unit's waves are ordered within it, so a task holds no more than one unit's.
    """
    d = ties.select("year", unit).distinct().join(F.broadcast(panel.waves(ties)), "year")
    w = Window.partitionBy(unit).orderBy("wave")
    d = d.select("year", unit, "wave", "next_year", F.row_number().over(w).cast("long").alias("tenure"), F.first("year").over(w).alias("entry"), F.first("wave").over(w).alias("first"), F.lead("wave").over(w).alias("next"))
    gone = F.col("next").isNull() if permanent else ~F.coalesce(F.col("next") == F.col("wave") + 1, F.lit(False))
    unbroken = F.lit(True) if permanent else F.col("wave") == F.col("first") + F.col("tenure") - 1
    return d.where(unbroken & F.col("next_year").isNotNull()).select("year", unit, "tenure", "entry", gone.cast("long").alias("exit"), (F.col("next_year") - F.col("year")).alias("gap"))


def _dummies(df: DataFrame, categories: list[str]) -> dict[str, Column]:
    """A column for each level of each category but its least. Levels come to the driver, so categories have few."""
    out = {}
    for c in categories:
        levels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
        out |= {f"{c}={v}": (F.col(c) == v).cast("double") for v in levels[1:]}
    return out


def hazard_fit(df: DataFrame, terms: list[str], categories: list[str], cluster: str, y: str = "exit", gap: str = "gap", rounds: int = 50) -> tuple[list[str], np.ndarray, np.ndarray, int, int]:
    """Names, estimates, clustered covariance, rows and events of a complementary log-log model of y in {0, 1}.

    The logarithm of gap is an offset, so exponentiated estimates are ratios of hazards. Rows that agree in all terms
    and the outcome are one row with a count; each step is a pass whose sums alone reach the driver. Rows with a null in a term,
    the outcome or the gap are left out. Terms that don't vary beside the others get the least of the equal solutions.
    """
    dummies = _dummies(df, categories)
    names, k = ["one", *terms, *dummies], 1 + len(terms) + len(dummies)
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in terms], *dummies.values())
    rows = df.select(cluster, x.alias("x"), F.log(F.col(gap).cast("double")).alias("offset"), F.col(y).cast("double").alias("y"))
    rows = cut(rows.where("y is not null and offset is not null and not exists(x, v -> v is null)"))
    cells = cut(rows.groupBy("x", "offset", "y").agg(F.count("*").cast("double").alias("n")))

    def scores(b: pa.RecordBatch, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, score and weight of each row."""
        at = b.column("x").flatten().to_numpy().reshape(-1, k)
        e = np.exp(np.clip(at @ beta + b.column("offset").to_numpy(), -30, 3.5))
        mu = -np.expm1(-e)
        return at, (b.column("y").to_numpy() - mu) * e / mu, e * e * np.exp(-e) / mu

    def add_up(frame: DataFrame, part, width: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                total += part(b)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        row = frame.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in row:
            out[r.i] = r.v
        return out

    n, events, mean_offset = cells.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0.0)), F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("offset")), F.sum("n")), F.lit(0.0))).first()
    beta, bread = np.zeros(k), np.zeros((k, k))
    share = min(max(events / n, 0.001), 0.999) if n else 0.5
    beta[0] = np.log(-np.log1p(-share)) - mean_offset  # from 0 the first steps can overshoot
    for _ in range(rounds):

        def step_sums(b: pa.RecordBatch, beta: np.ndarray = beta) -> np.ndarray:
            at, score, weight = scores(b, beta)
            n = b.column("n").to_numpy()
            return np.concatenate([(at.T @ (at * (n * weight)[:, None])).ravel(), at.T @ (n * score)])

        sums = add_up(cells, step_sums, k * k + k)
        bread = np.linalg.pinv(sums[: k * k].reshape(k, k), rcond=1e-10, hermitian=True)
        step = bread @ sums[k * k :]
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break

    def row_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, score, _ = scores(b, beta)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v) for v in (at * score[:, None]).T]], ["unit", *[f"g{i}" for i in range(k)]])

    kind = rows.schema[cluster].dataType.simpleString()
    units = rows.mapInArrow(row_scores, f"unit {kind}, " + ", ".join(f"g{i} double" for i in range(k))).groupBy("unit").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(k)]).drop("unit")

    def outer(b: pa.RecordBatch) -> np.ndarray:
        g = np.stack([b.column(i).to_numpy() for i in range(k)], 1)
        return np.concatenate([(g.T @ g).ravel(), [len(g)]])

    meat = add_up(units, outer, k * k + 1)
    groups = meat[-1]
    few = groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 and n > k else 1.0
    return names, beta, bread @ meat[:-1].reshape(k, k) @ bread * few, int(n), int(events)


def _ratio(fit: tuple, term: str) -> tuple:
    names, beta, cov, n, events = fit
    i = names.index(term)
    b, error = float(beta[i]), sqrt(max(float(cov[i, i]), 0.0))
    p = erfc(abs(b) / error / sqrt(2)) if error > 0 else None
    return (*[round(v, 6) for v in (b, exp(b), exp(b - 1.959963984540054 * error), exp(b + 1.959963984540054 * error))], None if p is None else round(p, 6), n, events)


RATIO = "coefficient double, hr double, lo double, hi double, p double, n long, events long"


def nested_hazards(df: DataFrame, term: str, specifications: dict[str, tuple[list[str], list[str]]], cluster: str) -> DataFrame:
    """specification, coefficient, hr, lo, hi, p, n, events of one term, beside the terms and categories of each specification."""
    data = cut(df)
    rows = [(name, *_ratio(hazard_fit(data, [term, *terms], categories, cluster), term)) for name, (terms, categories) in specifications.items()]
    return df.sparkSession.createDataFrame(rows, "specification string, " + RATIO)


def sensitivity(variants: dict[str, tuple[DataFrame, str]], terms: list[str], categories: list[str], cluster: str) -> DataFrame:
    """variant, coefficient, hr, lo, hi, p, n, events: the same model on each variant's rows, of the term that it names."""
    rows = [(name, *_ratio(hazard_fit(cut(df), [term, *terms], categories, cluster), term)) for name, (df, term) in variants.items()]
    return next(iter(variants.values()))[0].sparkSession.createDataFrame(rows, "variant string, " + RATIO)
