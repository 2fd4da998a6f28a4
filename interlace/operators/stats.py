"""Stratified gaps, permutation nulls and regressions from grouped sums."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from interlace.operators.curves import joint_wald
from interlace.operators.lineage import cut, dealt
from interlace.operators.nulls import stratified_null


def stratified_gap(df: DataFrame, cells: list[str], group: str, y: str, min_cell: int = 5) -> DataFrame:
    """Pooled difference of means within cells, weighted by n1 n0 / (n1 + n0); cells need min_cell on both sides."""
    c = df.groupBy(*cells).agg(F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n0"), F.avg(F.when(F.col(group), F.col(y))).alias("y1"), F.avg(F.when(~F.col(group), F.col(y))).alias("y0"))
    c = c.where((F.col("n1") >= min_cell) & (F.col("n0") >= min_cell)).withColumn("w", F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0")))
    return c.agg(F.count("*").alias("cells"), F.round(F.try_divide(F.sum((F.col("y1") - F.col("y0")) * F.col("w")), F.sum("w")), 6).alias("gap"))


def permutation_null(df: DataFrame, cells: list[str], group: str, y: str, key: list[str] | None = None, draws: int = 2000, min_cell: int = 5, seed: int = 7) -> DataFrame:
    """gap, draws, p: the gap and its share of draws at least as large, labels being dealt anew within cells.

    Rows are counted, so ``key``, which tells them apart, isn't needed.
    """
    return stratified_null(df, cells, group, y, draws, min_cell, seed).select(F.col("observed").alias("gap"), "draws", "p")


def slopes(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least squares of y on x within groups, from sums."""
    n, sx, sy, sxx, sxy = F.count("*"), F.sum(x), F.sum(y), F.sum(F.col(x) * F.col(x)), F.sum(F.col(x) * F.col(y))
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    return df.groupBy(by).agg(n.alias("n"), F.round(slope, 6).alias("slope"), F.round((sy - slope * sx) / n, 6).alias("intercept"))


def glm(df: DataFrame, x: list[str], y: str, cluster: str, link: str = "logit", offset: str | None = None, rounds: int = 25) -> DataFrame:
    """term, estimate, error, ratio of glm_fit()."""
    beta, cov = glm_fit(df, x, y, cluster, link, offset, rounds)
    out = [(c, round(float(b), 6), round(float(np.sqrt(max(v, 0))), 6), round(float(np.exp(b)), 6)) for c, b, v in zip(x, beta, np.diag(cov), strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, error double, ratio double")


def wald_tests(df: DataFrame, x: list[str], y: str, cluster: str, blocks: dict[str, list[str]], link: str = "logit", offset: str | None = None) -> DataFrame:
    """block, chi2, df, p: whether all terms of each block are zero, by the clustered covariance of glm_fit()."""
    beta, cov = glm_fit(df, x, y, cluster, link, offset)
    rows = []
    for name, terms in blocks.items():
        chi2, n, p = joint_wald(beta, cov, [x.index(t) for t in terms])
        rows.append((name, round(chi2, 5), n, round(p, 6)))
    return df.sparkSession.createDataFrame(rows, "block string, chi2 double, df int, p double")


def glm_fit(df: DataFrame, x: list[str], y: str, cluster: str, link: str = "logit", offset: str | None = None, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and covariance of a logit, cloglog or Poisson regression by iterated weighted sums, robust to clusters.

    Each round aggregates k * k sums over the rows; only those reach the driver. Columns x hold
    the intercept, too, if one is wanted. The rows are made once and read in every round.
    """
    df = cut(df.select(*dict.fromkeys([cluster, y, *x, *([offset] if offset else [])])))
    k = len(x)
    beta = np.zeros(k)
    off = F.col(offset) if offset else F.lit(0.0)

    def parts(b: np.ndarray):
        eta = off + sum((F.lit(float(v)) * F.col(c) for v, c in zip(b, x, strict=True)), F.lit(0.0))
        if link == "poisson":
            mu = F.exp(eta)
            return mu, mu, F.col(y) - mu
        if link == "cloglog":
            e = F.exp(F.least(eta, F.lit(20.0)))
            mu = F.greatest(F.least(1 - F.exp(-e), F.lit(1 - 1e-12)), F.lit(1e-12))
            d = e * F.exp(-e)
            return mu, d * d / (mu * (1 - mu)), (F.col(y) - mu) * d / (mu * (1 - mu))
        mu = 1 / (1 + F.exp(-eta))
        return mu, mu * (1 - mu), F.col(y) - mu

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    bread = np.eye(k)
    for _ in range(rounds):
        _, weight, score = parts(beta)
        d = df.select(*x, weight.alias("w_"), score.alias("s_"))
        row = d.agg(*[F.sum(F.col(x[i]) * F.col(x[j]) * F.col("w_")) for i, j in pairs], *[F.sum(F.col(c) * F.col("s_")) for c in x]).first()
        h = np.zeros((k, k))
        for v, (i, j) in zip(row, pairs, strict=False):
            h[i, j] = h[j, i] = v
        bread = np.linalg.pinv(h)
        step = bread @ np.array(row[len(pairs) :], float)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    _, _, score = parts(beta)
    g = df.select(cluster, *[(F.col(c) * score).alias(f"g{i}") for i, c in enumerate(x)]).groupBy(cluster).agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(k)])
    row = g.agg(F.count("*"), *[F.sum(F.col(f"g{i}") * F.col(f"g{j}")) for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for v, (i, j) in zip(row[1:], pairs, strict=True):
        meat[i, j] = meat[j, i] = v
    groups = row[0]
    return beta, bread @ meat @ bread * (groups / (groups - 1) if groups > 1 else 1)


# The distribution function of a Poisson variable of mean 1, from 0 on.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


# MD5's turns and constants.
TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, axis=0).ravel()
SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
#: Units whose draws are made at once, and groups whose sums a task holds before it hands them on.
UNITS, GROUPS = 8, 256


def md5_heads(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes of each MD5, as a number, of messages of one padded block of 64 bytes, all at once."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = first = [np.full(len(blocks), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + SINES[i] + m[g]
        a, d, c, b = d, c, b, b + (f << np.uint32(TURNS[i]) | f >> np.uint32(32 - TURNS[i]))
    return (a + first[0]).byteswap()


def draws(units: list[str | None], replicates: int) -> np.ndarray:
    """Poisson weights of mean 1, a row for each unit: from the MD5 of "unit:replicate"."""
    ends, heads = [b"%d" % b for b in range(1, replicates + 1)], np.empty((len(units), replicates), np.uint32)
    starts = [b"" if u is None else u.encode() + b":" for u in units]
    width = len(ends[-1]) + 1
    size = np.array([len(e) for e in ends])
    tails = np.frombuffer(b"".join((e + b"\x80").ljust(width, b"\0") for e in ends), np.uint8).reshape(-1, width)
    short = [i for i, x in enumerate(starts) if len(x) + width <= 56]
    for at in range(0, len(short), UNITS):
        some = short[at : at + UNITS]
        blocks = np.zeros((len(some), replicates, 64), np.uint8)
        for block, i in zip(blocks, some, strict=True):
            n = len(starts[i])
            block[:, :n] = np.frombuffer(starts[i], np.uint8)
            block[:, n : n + width] = tails
            block[:, 56:58] = (8 * (n + size)).astype("<u2").view(np.uint8).reshape(-1, 2)
        heads[some] = md5_heads(blocks.reshape(-1, 64)).reshape(len(some), -1)
    for i in sorted(set(range(len(units))) - set(short)):
        heads[i] = np.frombuffer(b"".join(md5(starts[i] + e).digest()[:4] for e in ends), ">u4")
    return sum((heads >= np.uint32(np.ceil(p * 2.0**32)) for p in POISSON), np.zeros(heads.shape, np.int8))


def bootstrap_mean(df: DataFrame, by: list[str], unit: str, value: str, replicates: int) -> DataFrame:
    """n, mean, and lo and hi, the 2.5 and 97.5 percentiles of means over Poisson resamples of the units.

    A unit's weight in a replicate comes from a hash of both, so a rerun of a lost task draws the same; it is drawn once for
    all of the unit's rows. Weights are drawn in numpy and added up within a task, so what is dealt on are sums, not rows.
    """
    keyed = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    own = dealt(df.select(F.col(unit).cast("string").alias("u"), *keyed, F.col(value).cast("double").alias("v")), "u")
    own = own.groupBy("u").agg(F.collect_list(F.struct(*[f"k{i}" for i in range(len(by))], "v")).alias("rows"))
    kinds = pa.schema([pa.field(f"k{i}", to_arrow_type(df.schema[c].dataType)) for i, c in enumerate(by)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in sums], f.type) for i, f in enumerate(kinds)]
            parts = [pa.array([x[i].tolist() for x in sums.values()], pa.list_(pa.float64())) for i in range(3)]
            return pa.RecordBatch.from_arrays([*keys, *parts], [*kinds.names, "w", "wv", "held"])

        for batch in batches:
            units, lists = batch["u"].to_pylist(), batch["rows"]
            rows, of = lists.flatten(), np.repeat(np.arange(len(units)), lists.value_lengths().to_numpy())
            keys = list(zip(*[rows.field(i).to_pylist() for i in range(len(by))], strict=True))
            v = rows.field(len(by)).to_numpy(zero_copy_only=False)
            for at in range(0, len(units), 64):
                low, high = np.searchsorted(of, [at, at + 64])
                weights = draws(units[at : at + 64], replicates).astype(np.float64)
                names: dict[tuple, int] = {}
                g = np.array([names.setdefault(k, len(names)) for k in keys[low:high]])
                three = np.zeros((3, len(names), len(weights)))
                known = ~np.isnan(v[low:high])
                for x, y in zip(three, (np.ones(high - low), np.where(known, v[low:high], 0), known), strict=True):
                    np.add.at(x, (g, of[low:high] - at), y)
                found = three @ weights
                for k, i in names.items():
                    sums[k] = sums[k] + found[:, i] if k in sums else found[:, i]
                if len(sums) > GROUPS:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    columns = ", ".join([f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by)])
    parts = own.mapInArrow(add_up, f"{columns}, w array<double>, wv array<double>, held array<double>")
    each = parts.select(*kinds.names, F.posexplode(F.arrays_zip("w", "wv", "held")).alias("b", "x")).groupBy(*kinds.names, "b").agg(*[F.sum(f"x.{c}").alias(c) for c in ("w", "wv", "held")])
    means = each.where("w > 0").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], F.when(F.col("held") > 0, F.col("wv") / F.col("w")).alias("m"))
    ends = means.groupBy(*by).agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).join(ends, by)
