"""Nulls by redrawing labels within cells, from counts of cells rather than from rows.

Dealing n1 labels anew among a cell's rows only changes how many of each value carry one, and these counts are
multivariate hypergeometric. So a cell is its distinct values with their counts, a draw is a few numbers, and
the work follows cells times draws whatever the number of rows. Draws come in blocks that are dealt to tasks,
each keyed by (seed, cell, block), so a task that runs again draws the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100


def cell_sums(df: DataFrame, cells: list[str], group: str, y: str, draws: int, seed: int, min_cell: int = 1) -> DataFrame:
    """cells, draw, n1, n0, s1, s0: how many rows of a cell are labelled or not, and the sums of y over them.

    Draw 0 is as observed, the others 1 to ``draws`` are dealt anew. Rows without y or label are left out, and cells
    with fewer than ``min_cell`` rows on a side.
    """
    known = df.where(F.col(y).isNotNull() & F.col(group).isNotNull())
    values = known.groupBy(*cells, F.col(y).cast("double").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col(group)).alias("k"))
    whole = values.groupBy(*cells).agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("values"), F.sum("k").alias("n1"), F.sum(F.col("n") - F.col("k")).alias("n0"), F.sum(F.col("v") * F.col("k")).alias("s1"), F.sum(F.col("v") * F.col("n")).alias("s"))
    whole = whole.where((F.col("n1") >= min_cell) & (F.col("n0") >= min_cell)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws + BLOCK - 1) // BLOCK - 1))))
    # by cell and block, so the draws of a few cells are dealt to many tasks
    whole = whole.repartition(*cells, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                name = "|".join(str(row[c]) for c in cells)
                rng = np.random.default_rng([seed, zlib.crc32(name.encode()), row["block"]])
                first = row["block"] * BLOCK
                numbers = np.arange(first + 1, min(first + BLOCK, draws) + 1)
                v, n = np.array([x["v"] for x in row["values"]]), np.array([x["n"] for x in row["values"]])
                s1 = rng.multivariate_hypergeometric(n, row["n1"], size=len(numbers), method="marginals") @ v
                if not row["block"]:
                    numbers, s1 = np.concatenate([[0], numbers]), np.concatenate([[row["s1"]], s1])
                same = batch.slice(i, 1)
                columns = [pa.array([row[c]] * len(numbers), same.column(c).type) for c in cells]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), *[pa.array(np.full(len(numbers), row[c]), pa.int64()) for c in ("n1", "n0")], pa.array(s1), pa.array(row["s"] - s1)], [*cells, "draw", "n1", "n0", "s1", "s0"])

    schema = ", ".join(f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in cells) + ", draw long, n1 long, n0 long, s1 double, s0 double"
    return whole.mapInArrow(run, schema)


def against_null(gaps: DataFrame, by: list[str]) -> DataFrame:
    """by, observed, p, lo, hi, draws of gaps(by, draw, gap): draw 0 beside the others; p is the share of these that are
    as large at least, whatever their sign."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row for each draw
    rows = gaps.withColumn("seen", F.max(F.when(F.col("draw") == 0, F.col("gap"))).over(w)).where("draw > 0")
    as_large = (F.abs("gap") >= F.abs("seen") - 1e-12).cast("double")
    return rows.groupBy(*by, F.round("seen", 6).alias("observed")).agg(F.avg(as_large).alias("p"), F.round(F.percentile("gap", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("gap", F.lit(0.975)), 6).alias("hi"), F.count("*").alias("draws"))


def stratified_null(df: DataFrame, cells: list[str], group: str, y: str, draws: int = 2000, min_cell: int = 5, seed: int = 7) -> DataFrame:
    """The gap of means within cells, pooled with weights n1 n0 / (n1 + n0), beside labels dealt anew within cells."""
    w = F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))
    sums = cell_sums(df, cells, group, y, draws, seed, min_cell)
    gaps = sums.groupBy("draw").agg((F.sum((F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")) * w) / F.sum(w)).alias("gap"))
    return against_null(gaps, [])


def wave_null(df: DataFrame, group: str, y: str, by: str = "year", draws: int = 20000, least: int = 3, seed: int = 42) -> DataFrame:
    """The difference of means in each wave beside labels dealt anew within it, and Cohen's d (over the spread of all)."""
    sums = cell_sums(df, [by], group, y, draws, seed, least)
    out = against_null(sums.select(by, "draw", (F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")).alias("gap")), [by])
    spread = df.where(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(by).agg(F.stddev_samp(F.col(y).cast("double")).alias("sd"))
    return out.join(spread, by).withColumn("d", F.round(F.col("observed") / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)), 6)).drop("sd")


def redrawn_gap(df: DataFrame, group: str, y: str, by: str = "year", draws: int = 5000, seed: int = 5) -> DataFrame:
    """The gap of means over all waves beside as many members redrawn within each wave; waves without members count too."""
    sums = cell_sums(df, [by], group, y, draws, seed, 0)
    total = lambda c: F.sum(c)
    return against_null(sums.groupBy("draw").agg((total("s1") / total("n1") - total("s0") / total("n0")).alias("gap")), [])


def mixing_null(boards: DataFrame, by: str, board: str, label: str, draws: int = 400, groups: int = 32, seed: int = 1) -> DataFrame:
    """by, observed, expected, lo, hi, p, pairs: the share of pairs on one board that have one label, beside labels dealt
    anew over all seats of a wave's boards; p is the share of draws that are as large at least.

    boards has a row for each seat; boards of one don't count. A draw first deals each wave's labels to groups of
    boards (as counts), then, within each group apart, to its seats, which is the same as one deal over all.
    """
    known = boards.where(F.col(label).isNotNull()).select(F.col(by).alias("w_"), F.col(board).alias("b_"), F.col(label).cast("string").alias("l_"))
    sizes = known.groupBy("w_", "b_").agg(F.count("*").alias("k")).where("k > 1").withColumn("g_", F.pmod(F.xxhash64("b_"), F.lit(groups)).cast("int"))
    used = known.join(sizes.select("w_", "b_"), ["w_", "b_"])
    counts = used.groupBy("w_", "b_", "l_").agg(F.count("*").alias("n"))
    seen = counts.groupBy("w_").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    pairs = sizes.groupBy("w_").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"))
    pool = used.groupBy("w_", "l_").agg(F.count("*").alias("n")).groupBy("w_").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_", "n"))), lambda x: x["n"]).alias("pool"))
    # boards of one size are alike: a group is how many it has of each
    by_size = sizes.groupBy("w_", "g_", "k").agg(F.count("*").alias("m"))
    shape = by_size.groupBy("w_", "g_").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("shape"), F.sum(F.col("k") * F.col("m")).alias("seats"))
    seats = shape.groupBy("w_").agg(F.sort_array(F.collect_list(F.struct("g_", "seats"))).alias("groups")).join(pool, "w_")
    name = known.schema["w_"].dataType.simpleString()

    def deal(t: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in t:
            for row in frame.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(str(row.w_).encode()), int(row.draw)])
                left, out = np.array(row.pool, np.int64), []
                for g in row.groups:
                    got = rng.multivariate_hypergeometric(left, int(g["seats"]), method="marginals")
                    left = left - got
                    out.append((row.w_, int(row.draw), int(g["g_"]), got.tolist()))
                yield pd.DataFrame(out, columns=["w_", "draw", "g_", "got"])

    def seat(t: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in t:
            same = []
            for row in frame.itertuples(index=False):
                rng = np.random.default_rng([seed + 1, zlib.crc32(f"{row.w_}|{row.g_}".encode()), int(row.draw)])
                labels = rng.permutation(np.repeat(np.arange(len(row.got)), row.got))
                first, total = 0, 0
                for x in row.shape:
                    k, m = int(x["k"]), int(x["m"])
                    part = labels[first : first + k * m].reshape(m, k)
                    first += k * m
                    on = np.stack([(part == v).sum(1) for v in range(len(row.got))])
                    total += int((on * (on - 1) // 2).sum())
                same.append(total)
            yield pd.DataFrame({"w_": frame["w_"], "draw": frame["draw"], "same": same})

    each = seats.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition("w_", "draw").mapInPandas(deal, f"w_ {name}, draw long, g_ int, got array<long>")
    drawn = each.join(shape, ["w_", "g_"]).repartition("w_", "draw", "g_").mapInPandas(seat, f"w_ {name}, draw long, same long").groupBy("w_", "draw").agg(F.sum("same").alias("same"))
    rows = drawn.join(pairs, "w_").join(seen.withColumnRenamed("same", "seen"), "w_")
    share, real = F.col("same") / F.col("pairs"), F.col("seen") / F.col("pairs")
    return rows.groupBy(F.col("w_").alias(by), F.round(real, 6).alias("observed"), F.col("pairs").cast("long").alias("pairs")).agg(F.round(F.avg(share), 6).alias("expected"), F.round(F.percentile(share, F.lit(0.025)), 6).alias("lo"), F.round(F.percentile(share, F.lit(0.975)), 6).alias("hi"), F.avg((F.col("same") >= F.col("seen")).cast("double")).alias("p"))
