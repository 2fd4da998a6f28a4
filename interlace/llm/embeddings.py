"""Near-duplicate vectors by products of int8 tiles with rigorous error bounds.

Vectors are dealt to cells around a bounded sample of pivots and cells to units of bounded size.
A vector meets a unit only if the triangle inequality of angles leaves room for a partner there,
so no link is lost. Pairs of units are taken in rounds, so that what is dealt out at once is a few
times the table, however many units a vector meets. Inside a tile (two units) the product of the quantised vectors, plus what
their quantisation errors can change at most, rules out most pairs; only pairs possibly above the
threshold are computed in double precision. A tile emits counts and a spanning forest, never all
of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interlace.llm.common import checkpoint, components, release

#: Rows in a unit about, pivots at most, rows of a block inside a tile.
UNIT, PIVOTS, BLOCK = 2048, 512, 1024
#: Units grow with the table up to so many rows; a vector is dealt out at most about so often at once; rows handed on at once.
LARGEST, VISITS, ROWS = 16384, 8, 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and length of the error for rows of unit length."""
    scale = np.abs(x).max(1, initial=1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def linked(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b whose cosine is at least the threshold. a, b: unit rows in double, int8, scale, error."""
    # whole numbers below 2**24, so the float product is exact
    product = a[1].astype(np.float32) @ b[1].T.astype(np.float32)
    product *= a[2][:, None].astype(np.float32)
    product *= b[2][None].astype(np.float32)
    slack = 1e-5 + a[3].max() * (1 + b[3].max()) + b[3].max()
    i, j = np.nonzero(product >= threshold - slack)
    bound = product[i, j] + a[3][i] * (1 + b[3][j]) + b[3][j] + 1e-5
    i, j = i[bound >= threshold], j[bound >= threshold]
    hit = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):  # full precision, a bounded number of pairs at a time
        p, r = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        hit[at : at + (1 << 16)] = np.einsum("ij,ij->i", a[0][p], b[0][r]) >= threshold
    return i[hit], j[hit]


def forest(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels (smallest row of a component) after joining rows i and j."""
    while len(i):
        low = np.minimum(labels[i], labels[j])
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        while np.any(labels != labels[labels]):
            labels = labels[labels]
        left = labels[i] != labels[j]
        i, j = i[left], j[left]
    return labels


def normed(raw: np.ndarray) -> np.ndarray:
    """Rows of unit length; they are scaled by their largest component first, so no square over- or underflows."""
    x = raw / np.abs(raw).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def matrix(v: pa.Array) -> np.ndarray:
    """Rows of lists of one length, in double precision."""
    return v.flatten().to_numpy().astype(np.float64).reshape(len(v), -1)


def of_each(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each value of a column."""
    values = batch[name].to_numpy()
    for value in np.unique(values):
        yield int(value), batch.take(pa.array(np.flatnonzero(values == value)))


def tile(ids: np.ndarray, raw: np.ndarray, copies: np.ndarray, side: np.ndarray, own: bool, threshold: float) -> pd.DataFrame:
    """Rows (id, n, root): links of each vector inside the tile, copies counted, and the root it hangs on.

    ``own`` says that the tile is a unit with itself. It can't be told from ``side``: of two units
    often only one sends rows.
    """
    x = normed(raw)
    data = (x, *quantise(x))
    links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    left, right = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for p in range(0, len(left), BLOCK):
        for r in range(p if own else 0, len(right), BLOCK):
            a, b = left[p : p + BLOCK], right[r : r + BLOCK]
            i, j = linked(tuple(v[a] for v in data), tuple(v[b] for v in data), threshold)
            i, j = a[i], b[j]
            if own:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            labels = forest(len(ids), i, j, labels)
    hit = links > 0
    return pd.DataFrame({"id": ids[hit], "n": links[hit], "root": ids[labels[hit]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, unit: int = UNIT) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Null, zero and non-finite vectors, and those with null components, link with nothing; vectors
    link only with others of their length. Equal vectors link; they are compared once. Repeated
    ids are vectors of their own with one id between them. A null vec_id counts as a vector whose
    component_id is null only if no vector of its component has an id. Other columns are ignored;
    an empty table gives no rows.
    """
    kept = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kept}>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    texts = rows.where("sound").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = checkpoint(texts.select(F.monotonically_increasing_id().alias("id"), F.size("v").alias("dim"), "v", "least", "copies"))
    lengths = distinct.groupBy("dim").agg(F.count("*").alias("total"))
    total = lengths.agg(F.sum("total")).first()[0]
    if not total:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    unit = max(unit, min(LARGEST, total // 64)) if unit == UNIT else unit
    pivots = F.least(F.lit(PIVOTS), F.floor(F.col("total") / unit) + 1)
    drawn = distinct.select("dim", "id", F.xxhash64("v").alias("h")).withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("h", "id")))
    drawn = drawn.join(F.broadcast(lengths), "dim").where(F.col("place") <= pivots).select("id")
    centres: dict[int, list] = {}
    for r in distinct.join(F.broadcast(drawn), "id", "left_semi").orderBy(F.xxhash64("v"), "id").select("dim", "v").collect():
        centres.setdefault(r["dim"], []).append(r["v"])
    centre = {d: normed(np.array(v)) for d, v in centres.items()}
    reach, spark = float(np.arccos(threshold)) + 1e-6, vectors.sparkSession

    def angles(v: pa.Array, dim: int) -> np.ndarray:
        return np.arccos(np.clip(normed(matrix(v)) @ centre[dim].T, -1, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, b in of_each(batch, "dim"):
                angle = angles(b["v"], dim)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle.argmin(1).astype(np.int32)), pa.array(angle.min(1))], [*b.schema.names, "cell", "near"])

    array = f"array<{kept}>"
    placed = checkpoint(distinct.select("id", "copies", "v", "dim").mapInArrow(place, f"id long, copies long, v {array}, dim int, cell int, near double"))
    # how many units a cell has, where their numbers begin, and how far from it a partner may be: at most PIVOTS rows for each length
    parts = {d: np.zeros(len(c), np.int64) for d, c in centre.items()}
    far = {d: np.full(len(c), -1.0) for d, c in centre.items()}
    for r in placed.groupBy("dim", "cell").agg((F.floor(F.count("*") / unit) + 1).alias("parts"), (F.max("near") + reach).alias("far")).collect():
        parts[r["dim"]][r["cell"]], far[r["dim"]][r["cell"]] = r["parts"], r["far"]
    begin = {d: np.cumsum(p) - p for d, p in parts.items()}

    def met(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Which rows visit which cells: all that are near enough."""
        return np.nonzero(angles(batch["v"], dim) <= far[dim])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, b in of_each(batch, "dim"):
                yield pa.RecordBatch.from_arrays([pa.array([int(parts[dim][met(b, dim)[1]].sum())])], ["n"])

    visits = placed.select("v", "dim").mapInArrow(count, "n long").agg(F.sum("n")).first()[0]
    rounds = max(1, -(-visits // (VISITS * total)))

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by("id")
        own = g["a"][0].as_py() == g["b"][0].as_py()
        return pa.Table.from_pandas(tile(g["id"].to_numpy(), matrix(g["v"].combine_chunks()), g["copies"].to_numpy(), g["side"].to_numpy(), own, threshold), preserve_index=False)

    def turn(which: int) -> DataFrame:
        """Links of the pairs of units whose turn it is: a row goes to each that its unit makes with one it visits."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, b in of_each(batch, "dim"):
                    cell = b["cell"].to_numpy()
                    mine = begin[dim][cell] + b["id"].to_numpy() % parts[dim][cell]
                    row, other = met(b, dim)
                    n = parts[dim][other]
                    row, unit2 = np.repeat(row, n), np.repeat(begin[dim][other] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    low, high = np.minimum(mine[row], unit2), np.maximum(mine[row], unit2)
                    due = np.flatnonzero((low * 31 + high) % rounds == which)
                    for at in range(0, len(due), ROWS):
                        some = due[at : at + ROWS]
                        took = b.select(["dim", "id", "copies", "v"]).take(pa.array(row[some]))
                        side = (mine[row[some]] > unit2[some]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([*took.columns, pa.array(low[some]), pa.array(high[some]), pa.array(side)], [*took.schema.names, "a", "b", "side"])

        sent = placed.mapInArrow(visit, f"dim int, id long, copies long, v {array}, a long, b long, side int")
        return sent.groupBy("dim", "a", "b").applyInArrow(run, "id long, n long, root long")

    found = checkpoint(turn(0))
    for which in range(1, rounds):
        release(spark)
        found = found.union(checkpoint(turn(which)))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = distinct.join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left").select("v", "least", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component"))
    first = classes.groupBy("component").agg(F.min("least").alias("first"))
    classes = classes.join(first, "component").select("v", "copies", "n", "first")
    out = rows.withColumn("key", F.when(F.col("sound"), F.col("v"))).join(classes.withColumnRenamed("v", "key"), "key", "left")
    component = F.coalesce("first", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
