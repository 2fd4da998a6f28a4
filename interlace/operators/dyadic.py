"""Pseudolikelihood fits of dyads with a bootstrap of persons, all replicates in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.operators.lineage import cut


def poisson_cdf(tail: float = 2.0**-32) -> np.ndarray:
    """The distribution function of a Poisson variable of mean 1, term by term until what is left is below ``tail``."""
    term, out = exp(-1.0), [exp(-1.0)]
    while 1 - out[-1] > tail:
        term /= len(out)
        out.append(out[-1] + term)
    return np.array(out)


def unit_weights(unit: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each unit is drawn in each replicate: Poisson counts of mean 1 from a hash of (seed, replicate, unit),
    so a task that runs again draws the same. Replicate 0 draws each unit once."""
    h = unit.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(replicates + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h ^= h >> np.uint64(30)
        h *= np.uint64(odd)
    h ^= h >> np.uint64(31)
    w = np.searchsorted(poisson_cdf(), (h >> np.uint64(11)).astype(float) / 2.0**53, "right").astype(float)
    w[:, 0] = 1.0
    return w


def cells(df: DataFrame, x: list[str], y: str, count: str | None, *more: Column) -> DataFrame:
    """x0.., y, n: rows of equal terms and outcome (and more) by number; ``count`` names the column that has it, and may
    hold negative numbers that take back what others count."""
    n = F.sum(F.col(count)) if count else F.count("*")
    out = df.groupBy(*more, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("y")).agg(n.cast("double").alias("n"))
    return out.where("n <> 0") if count else out


def pooled(rows: DataFrame, k: int, replicates: int, seed: int, most: int = 1 << 12) -> DataFrame:
    """x0.., y, w of cells() by unit: each cell's weights in all replicates, summed over its units.

    A task holds so many cells at ``most`` before it hands them on; a cell that comes in parts is as good as
    whole to a sum. Weights are made once for each unit of a batch, and once in a fit.
    """
    names = [f"x{i}" for i in range(k)] + ["y"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            for first in range(0, len(keys), 256):
                part = keys[first : first + 256]
                at = np.frombuffer(b"".join(part), float).reshape(-1, k + 1)
                flat = pa.array(np.concatenate([held[c] for c in part]))
                w = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * (replicates + 1), flat)
                yield pa.RecordBatch.from_arrays([*[pa.array(at[:, i].copy()) for i in range(k + 1)], w], [*names, "w"])
            held.clear()

        for batch in batches:
            for first in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(first, 1 << 12)
                at = np.stack([part.column(c).to_numpy() for c in names], 1) + 0.0  # no signed zeros
                if "w" in part.schema.names:
                    w = np.stack([np.asarray(v) for v in part.column("w").to_numpy(zero_copy_only=False)])
                else:
                    unit, own = np.unique(part.column("unit").to_numpy(), return_inverse=True)
                    w = unit_weights(unit, replicates, seed)[own] * part.column("n").to_numpy()[:, None]
                order = np.lexsort(at.T)
                at, w = at[order], w[order]
                starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
                for c, v in zip(at[starts], np.add.reduceat(w, starts), strict=True):
                    key = c.tobytes()
                    held[key] = held[key] + v if key in held else v
                if len(held) >= most:
                    yield from out()
        yield from out()

    schema = ", ".join(f"{c} double" for c in names) + ", w array<double>"
    return rows.mapInArrow(sums, schema).repartition(*names).mapInArrow(sums, schema)


def fit(df: DataFrame, x: list[str], y: str, unit: str, replicates: int = 200, seed: int = 7, link: str = "logit", rounds: int = 40, count: str | None = None) -> dict:
    """Estimates of all replicates: beta (replicates + 1 rows), which of them settled, and rows, y and units.

    Rows with the same terms and outcome are one row with its weights in all replicates, which don't change
    from step to step. Each Newton step then is one pass over these, and what leaves a task are the sums of each
    replicate. These, k * k for each, are all that reaches the driver. Where nearly every row has terms of its own,
    rows are kept by unit instead and their weights made in passing. ``count`` as in cells().
    """
    k = len(x)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    if replicates:
        data = cut(cells(df, x, y, count, F.col(unit).cast("long").alias("unit")))
        total = data.agg(F.sum("n"), F.sum(F.col("y") * F.col("n")), F.count("*")).first()
        if data.select("y", *[f"x{i}" for i in range(k)]).distinct().count() * (replicates + 1) <= 4 * total[2] + (1 << 20):
            data = cut(pooled(data, k, replicates, seed))
    else:
        data = cut(cells(df, x, y, count))
        total = data.agg(F.sum("n"), F.sum(F.col("y") * F.col("n"))).first()
    beta = np.zeros((replicates + 1, k))
    open_ = np.ones(replicates + 1, bool)
    failed = np.zeros(replicates + 1, bool)
    for _ in range(rounds):
        at, which = beta.copy(), np.flatnonzero(open_)

        def sums(batches: Iterator[pa.RecordBatch], at: np.ndarray = at, which: np.ndarray = which) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(which), len(upper) + k))
            for batch in batches:
                for first in range(0, batch.num_rows, 1 << 14):
                    part = batch.slice(first, 1 << 14)
                    rows = np.stack([part.column(f"x{i}").to_numpy() for i in range(k)], 1)
                    if "w" in part.schema.names:
                        w = np.stack([np.asarray(v) for v in part.column("w").to_numpy(zero_copy_only=False)])[:, which]
                    else:
                        units = part.column("unit").to_numpy() if replicates else np.zeros(part.num_rows, np.int64)
                        w = unit_weights(units, replicates, seed)[:, which] * part.column("n").to_numpy()[:, None]
                    eta = np.clip(rows @ at[which].T, -30, 30)
                    mu = np.exp(eta) if link == "poisson" else 1 / (1 + np.exp(-eta))
                    curve = mu if link == "poisson" else mu * (1 - mu)
                    total[:, : len(upper)] += (w * curve).T @ np.stack([rows[:, i] * rows[:, j] for i, j in upper], 1)
                    total[:, len(upper) :] += (w * (part.column("y").to_numpy()[:, None] - mu)).T @ rows
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["replicate", "sums"])

        each = data.mapInArrow(sums, "replicate int, sums array<double>").groupBy("replicate").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(len(upper) + k)])
        for r in each.collect():
            h = np.zeros((k, k))
            for v, (i, j) in zip(r[1:], upper, strict=False):
                h[i, j] = h[j, i] = v
            b = r["replicate"]
            step = np.linalg.pinv(h) @ np.array(r[1 + len(upper) :], float)
            beta[b] += np.clip(step, -3, 3)
            open_[b] = np.abs(step).max() >= 1e-8
            failed[b] = np.linalg.matrix_rank(h) < k
        if not open_.any():
            break
    return {"beta": beta, "settled": ~open_ & ~failed, "rows": int(total[0] or 0), "ties": int(total[1] or 0), "seed": seed}


def mple(df: DataFrame, x: list[str], y: str = "tie", unit: str = "person", replicates: int = 200, seed: int = 7, link: str = "logit", count: str | None = None) -> DataFrame:
    """term, estimate, boot_se, lo, hi, n_dyads, n_ties, n_boot: a fit, and its spread over resamples of the units.

    lo and hi are the 2.5 and 97.5 percentiles. Replicates that don't settle, as where a term doesn't vary, are left out
    and n_boot counts the others. Terms hold no intercept but their own.
    """
    found = fit(df, x, y, unit, replicates, seed, link, count=count)
    draws = found["beta"][1:][found["settled"][1:]]
    spread = lambda f: [None] * len(x) if len(draws) < 2 else [round(float(v), 6) for v in f]
    columns = [found["beta"][0].round(6).tolist(), spread(draws.std(0, ddof=1) if len(draws) > 1 else []), *[spread(np.percentile(draws, q, axis=0) if len(draws) > 1 else []) for q in (2.5, 97.5)]]
    rows = [(term, *values, found["rows"], found["ties"], len(draws)) for term, *values in zip(x, *columns, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, boot_se double, lo double, hi double, n_dyads long, n_ties long, n_boot long")


def by_process(df: DataFrame, x: list[str], memory: str = "memory", replicates: int = 100, seed: int = 13, count: str | None = None) -> DataFrame:
    """mple() apart for dyads without the tie before (formation) and with it (retention), without the memory term."""
    terms = [c for c in x if c != memory]
    parts = [mple(df.where(F.col(memory) == m), terms, replicates=replicates, seed=seed, count=count).withColumn("process", F.lit(name)) for m, name in ((0, "formation"), (1, "retention"))]
    return parts[0].union(parts[1])


def closure_forms(df: DataFrame, others: list[str], replicates: int = 100, seed: int = 13, count: str | None = None) -> DataFrame:
    """mple() of formation with closure as a count, whether there is any, its logarithm, four-cycles, and not at all."""
    forms: dict[str, Column | None] = {"closure": F.col("closure"), "closure_any": (F.col("closure") > 0).cast("double"), "closure_log": F.log1p("closure"), "closure4": F.col("cycles"), "none": None}
    new = cut(df.where("memory = 0"))
    out = None
    for form, column in forms.items():
        terms = others if column is None else [*others, form]
        part = mple(new if column is None else new.withColumn(form, column), terms, replicates=replicates, seed=seed, count=count).withColumn("form", F.lit(form))
        out = part if out is None else out.union(part)
    return out


def fitted_totals(df: DataFrame, x: list[str], y: str = "tie", unit: str = "person", link: str = "logit", count: str | None = None) -> DataFrame:
    """term, observed, fitted: the sum of each term over the ties, and over all rows by the fitted chance of a tie.

    At the maximum the two are equal, term by term: these are the score equations.
    """
    data = cut(cells(df, x, y, count))
    named = data.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(x)], "y", "n", F.lit(0).cast("long").alias("unit_"))
    beta = fit(named, x, "y", "unit_", 0, link=link, count="n")["beta"][0]
    eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, x, strict=True)), F.lit(0.0))
    mu = F.exp(eta) if link == "poisson" else 1 / (1 + F.exp(-eta))
    sums = named.agg(*[F.struct(F.sum(F.col(c) * F.col("y") * F.col("n")).alias("observed"), F.sum(F.col(c) * mu * F.col("n")).alias("fitted")).alias(c) for c in x])
    rows = F.array(*[F.struct(F.lit(c).alias("term"), F.round(F.col(c)["observed"], 3).alias("observed"), F.round(F.col(c)["fitted"], 3).alias("fitted")) for c in x])
    return sums.select(F.inline(rows))
