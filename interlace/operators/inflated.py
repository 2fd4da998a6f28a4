"""Counts with more zeros than their distribution has, and how counts fit: zero-inflated and quasi-Poisson models, diagnostics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.operators.lineage import cut
from interlace.operators.stats import glm_fit


@dataclass
class Inflated:
    """A fit: terms of the count and of the inflation, estimates (and the log of the size, for "negbin"), covariance,
    log likelihoods of the accepted steps, and whether the last step was far below the errors."""

    x: list[str]
    z: list[str]
    family: str
    theta: np.ndarray
    covariance: np.ndarray
    likelihoods: list[float]
    settled: bool

    def mean(self) -> Column:
        """The fitted mean of a row: its share of counts times their mean."""
        eta = lambda names, b: sum((F.lit(float(v)) * F.col(c) for c, v in zip(names, b, strict=True)), F.lit(0.0))
        count, zero = eta(self.x, self.theta[: len(self.x)]), eta(self.z, self.theta[len(self.x) : len(self.x) + len(self.z)])
        return F.exp(count) / (1 + F.exp(zero))


def _row_terms(x: np.ndarray, z: np.ndarray, y: np.ndarray, n: np.ndarray, theta: np.ndarray, negbin: bool) -> tuple:
    """Sums over rows: log likelihood, score, curvature of the two weighted fits, and observed information.

    The score of the likelihood is that of the two fits, rows with a zero being counts by the chance ``1 - tau``.
    """
    k, m = x.shape[1], z.shape[1]
    mu, zero = np.exp(np.clip(x @ theta[:k], -30, 30)), np.clip(z @ theta[k : k + m], -30, 30)
    y_int = y.astype(np.int64)
    up_to = lambda values: np.concatenate([[0.0], np.cumsum(values)])[y_int]
    steps = np.arange(int(y_int.max()) if len(y_int) else 0, dtype=float)
    if negbin:
        r = np.exp(theta[-1])
        none = r * np.log(r / (r + mu))
        log_p = up_to(np.log(steps + r) - np.log(steps + 1)) + none + y * (np.log(mu) - np.log(r + mu))
        residual, curve = (y - mu) * r / (r + mu), mu * r / (r + mu)
        observed = mu * r * (r + y) / (r + mu) ** 2
        first = up_to(1 / (steps + r)) + np.log(r / (r + mu)) + 1 - (y + r) / (r + mu)
        second = -up_to(1 / (steps + r) ** 2) + 1 / r - 2 / (r + mu) + (y + r) / (r + mu) ** 2
        size_score, size_curve = r * first, -(r * r * second + r * first)
        across = -(y - mu) * r * mu / (r + mu) ** 2
    else:
        none = -mu
        log_p = y * np.log(mu) - mu - up_to(np.log(steps + 1))
        residual, curve, observed = y - mu, mu, mu
    pi, log_pi, log_count = 1 / (1 + np.exp(-zero)), -np.logaddexp(0, -zero), -np.logaddexp(0, zero)
    at_zero = np.logaddexp(log_pi, log_count + none)
    likelihood = np.where(y == 0, at_zero, log_count + log_p)
    tau = np.where(y == 0, np.exp(log_pi - at_zero), 0.0)
    count = n * (1 - tau)
    score = [x.T @ (count * residual), z.T @ (n * (tau - pi))]
    size = k + m + int(negbin)
    fits, info = np.zeros((size, size)), np.zeros((size, size))
    fits[:k, :k] = x.T @ (x * (count * curve)[:, None])
    fits[k : k + m, k : k + m] = info[k : k + m, k : k + m] = z.T @ (z * (n * pi * (1 - pi))[:, None])
    info[:k, :k] = x.T @ (x * (count * observed)[:, None])
    apart = [-x * residual[:, None], z]  # how the complete score differs between the two kinds of zero
    if negbin:
        score.append([count @ size_score])
        info[-1, -1] = count @ size_curve
        fits[-1, -1] = max(info[-1, -1], 0.1 * abs(info[-1, -1]) + 1e-9)
        info[:k, -1] = info[-1, :k] = x.T @ (count * across)
        apart.append(-size_score[:, None])
    apart = np.concatenate(apart, 1)
    info -= apart.T @ (apart * (n * tau * (1 - tau))[:, None])
    return float(n @ likelihood), np.concatenate(score), fits, info


def zero_inflated(df: DataFrame, x: list[str], z: list[str], y: str, family: str = "poisson", warm: int = 5, rounds: int = 200) -> Inflated:
    """Counts y with terms x, "poisson" or "negbin", beside rows that are always zero with a logit of terms z.

    Expectation-maximisation: a zero belongs to the counts by its chance at the estimates so far, and a step of two
    weighted fits follows. After ``warm`` such steps Newton's step on the observed information is tried first. A step
    that lowers the log likelihood is not taken but halved. Rows with the same terms and outcome are one row
    with a count; a step is one pass whose sums alone reach the driver. A task holds tables up to its largest y.
    Rows with a null in y or a term are left out, negative y are an error. Terms hold no intercept but their own.
    """
    k, negbin = len(x), {"poisson": False, "negbin": True}[family]
    columns = [*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(z)], F.col(y).cast("double").alias("y")]
    data = cut(df.select(*columns).dropna().groupBy(*[f"x{i}" for i in range(k)], *[f"z{i}" for i in range(len(z))], "y").agg(F.count("*").cast("double").alias("n")))
    if data.where("y < 0").limit(1).collect():
        raise ValueError(f"{y} holds negative counts")
    size = k + len(z) + int(negbin)
    width = 1 + size + 2 * size * size

    def evaluate(theta: np.ndarray) -> tuple:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                rows = [np.stack([b.column(f"{name}{i}").to_numpy() for i in range(many)], 1) for name, many in (("x", k), ("z", len(z)))]
                value, score, fits, info = _row_terms(*rows, b.column("y").to_numpy(), b.column("n").to_numpy(), theta, negbin)
                total += np.concatenate([[value], score, fits.ravel(), info.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        row = np.array(data.mapInArrow(sums, "sums array<double>").agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0.0)) for i in range(width)]).first(), float)
        return float(row[0]), row[1 : 1 + size], row[1 + size : 1 + size + size * size].reshape(size, size), row[1 + size + size * size :].reshape(size, size)

    theta, settled = np.zeros(size), False
    now = evaluate(theta)
    likelihoods = [now[0]]
    for done in range(rounds):
        _, score, fits, info = now
        newton = np.linalg.pinv(info) @ score
        definite = np.linalg.eigvalsh(info).min() > 0
        if definite and score @ newton < 1e-16:
            settled = True
            break
        tries = [newton] if definite and done >= warm else []
        em = np.linalg.pinv(fits) @ score
        tries += [em / 2**i for i in range(12)]
        for step in tries:
            further = theta + step * min(1.0, 2 / max(np.abs(step).max(), 1e-300))
            then = evaluate(further)
            if then[0] >= now[0]:
                break
        else:  # no step raises it: as near as the arithmetic allows
            settled = bool(definite and score @ newton < 1e-8)
            break
        theta, now = further, then
        likelihoods.append(now[0])
    return Inflated(x, z, family, theta, np.linalg.pinv(now[3]), likelihoods, settled)


def inflated_table(df: DataFrame, x: list[str], z: list[str], y: str, families: tuple[str, ...] = ("poisson", "negbin")) -> DataFrame:
    """family, part, term, estimate, error, log_likelihood, settled of zero_inflated() by each family; the part "size" is
    the log of a negative binomial's size, whose variance is mean + mean ** 2 / size. Errors are by the observed information."""
    rows = []
    for family in families:
        f = zero_inflated(df, x, z, y, family)
        named = [*[("count", c) for c in x], *[("inflation", c) for c in z], *([("size", "log_size")] if family == "negbin" else [])]
        rows += [(family, part, term, round(float(b), 5), round(float(np.sqrt(max(v, 0))), 5), round(f.likelihoods[-1], 4), f.settled) for (part, term), b, v in zip(named, f.theta, np.diag(f.covariance), strict=True)]
    return df.sparkSession.createDataFrame(rows, "family string, part string, term string, estimate double, error double, log_likelihood double, settled boolean")


def fitted_zeros(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """term, total, fitted_total, zeros, fitted_zeros: what a zero-inflated Poisson with the same terms in both its parts
    gives for the sum of y and the number of its zeros, each weighted by a term. Where the terms tell groups apart, both
    are met exactly: these are its score equations."""
    f = zero_inflated(df, x, x, y)
    eta = lambda b: sum((F.lit(float(v)) * F.col(c) for c, v in zip(x, b, strict=True)), F.lit(0.0))
    mu, pi = F.exp(eta(f.theta[: len(x)])), 1 / (1 + F.exp(-eta(f.theta[len(x) :])))
    sums = lambda c: [F.round(F.sum(F.col(c) * v).cast("double"), 3).alias(name) for name, v in (("total", F.col(y)), ("fitted_total", (1 - pi) * mu), ("zeros", (F.col(y) == 0).cast("int")), ("fitted_zeros", pi + (1 - pi) * F.exp(-mu)))]
    return df.agg(*[F.struct(F.lit(c).alias("term"), *sums(c)).alias(f"t{i}") for i, c in enumerate(x)]).select(F.inline(F.array(*[f"t{i}" for i in range(len(x))])))


def quasi_poisson(df: DataFrame, x: list[str], y: str, cluster: str) -> DataFrame:
    """term, estimate, error, ratio, dispersion: a Poisson regression with errors robust to clusters, and Pearson's
    dispersion, the sum of squared residuals by their means over rows less terms (1 where the counts are Poisson)."""
    data = cut(df.select(*x, y, cluster))
    beta, cov = glm_fit(data, x, y, cluster, "poisson")
    mu = F.exp(sum((F.lit(float(b)) * F.col(c) for c, b in zip(x, beta, strict=True)), F.lit(0.0)))
    spread = data.agg(F.try_divide(F.sum((F.col(y) - mu) * (F.col(y) - mu) / mu), F.count(y) - len(x))).first()[0]
    rows = [(c, round(float(b), 5), round(float(np.sqrt(max(v, 0))), 5), round(float(np.exp(b)), 5), None if spread is None else round(spread, 5)) for c, b, v in zip(x, beta, np.diag(cov), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, error double, ratio double, dispersion double")


def diagnostics(df: DataFrame, y: str, fitted: dict[str, Column], per_decade: int = 10) -> DataFrame:
    """model, bin, n, observed, fitted, residual, spread, positive: fitted values by decades cut in ``per_decade``, and within
    each bin the mean of y, of the fit and of what is left, its spread, and the share of rows whose y is positive.

    ``fitted`` has an expression for each model. All models are read in one pass; a fit of zero or less has a null bin.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), c.cast("double").alias("f")) for name, c in fitted.items()]))
    rows = df.select(F.col(y).cast("double").alias("y"), each.alias("m")).select("y", "m.model", "m.f").where("y is not null and f is not null")
    rows = rows.withColumn("bin", F.when(F.col("f") > 0, F.floor(F.log10("f") * per_decade)))
    left = F.col("y") - F.col("f")
    return rows.groupBy("model", "bin").agg(F.count("*").alias("n"), F.round(F.avg("y"), 4).alias("observed"), F.round(F.avg("f"), 4).alias("fitted"), (F.round(F.avg(left), 4) + F.lit(0.0)).alias("residual"), F.round(F.stddev_pop(left), 4).alias("spread"), F.round(F.avg((F.col("y") > 0).cast("int")), 6).alias("positive"))
