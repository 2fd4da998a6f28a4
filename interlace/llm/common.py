"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that all executors share.

    The folder is the cluster's ``spark.checkpoint.dir``; where that is unset (tests), one
    below the warehouse, which is shared as well.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(place or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    clean, was = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:  # the files of this action's shuffles are of no use once its result is written
        was = spark.conf.get(clean, None)
        spark.conf.set(clean, "true")
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(clean, was) if was else spark.conf.unset(clean)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of phases whose results are checkpointed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like these that aren't taken, whatever their case."""
    used = {name.lower() for name in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def repeated_ids(docs: DataFrame) -> bool:
    """Whether doc_ids repeat or are null."""
    return len(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).collect()) > 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in one array, and where each row begins (one more at the end)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    size = int(at[-1])
    raw = np.frombuffer(data, np.uint8, size) if size else np.zeros(0, np.uint8)
    return raw[int(at[0]) : size], at - at[0]


def slices(at: np.ndarray, size: int = 1 << 19):
    """Cut rows into runs of about ``size`` bytes; a longer row is a run of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(h: np.ndarray, odd: int) -> np.ndarray:
    """One round of a bijective 64-bit scrambler, in place."""
    h *= U64(odd)
    h ^= h >> U64(32)
    return h


#: Odd multipliers for hashing.
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def words8(raw: np.ndarray) -> np.ndarray:
    """View: at each position the eight bytes that begin there, as one integer."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", np.ascontiguousarray(raw), strides=(1,))


def gram_hash(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit names of all k-byte strings (k >= 8), built from eight-byte names at growing offsets."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    view = words8(raw)
    h = view[:n].copy()
    mix(h, ODD[0])
    for step, at in enumerate([*range(8, k - 7, 8), *([k - 8] if k % 8 else [])]):
        h += view[at : at + n]
        mix(h, ODD[1 + step % 4])
    return h


def run_lengths(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group, for groups of these sizes one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for nodes with an edge.

    Alternating large-star and small-star steps: each node sends its neighbours to the smallest
    one near it until every node hangs on the smallest of its component. A node's rows are only
    ever aggregated to a minimum before they are joined back, so a hot node splits like any
    other skewed join side.
    """
    digest = lambda edges: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    # edges only become fewer: no more partitions than they fill
    fitting = lambda df, rows: checkpoint(df.distinct().coalesce(1 + rows // 250_000))
    e = fitting(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), edges.count())
    was = digest(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e, before = fitting(small.union(low.select("u", F.col("m").alias("v"))), was[0]), was
        was = digest(e)
        if before == was:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(stars.select("component", "component").distinct())


_powers = [np.ones(1, U64), np.ones(1, U64)]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(max(n, 1 << 20), U64(base))
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


#: A letter value for each byte; 0 outside words. Words are runs of ASCII letters and digits and of
#: bytes beyond ASCII; ASCII letters count without case.
LETTER = np.zeros(256, U64)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    LETTER[_b] = (_b * 0x9FB21C651E98DF25 ^ 0xD6E8FEB86659FD93) % (1 << 64)
LETTER[65:91] = LETTER[97:123]


def words(raw: np.ndarray, at: np.ndarray, letter: np.ndarray = LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each begins, and how many each row has (rows end words).

    ``letter`` has a value for each byte, 0 for bytes outside words.
    """
    n = len(raw)
    inside = (letter != 0)[raw]
    edge = np.zeros(n + 1, np.int8)
    edge[:n] += inside
    edge[1:] -= inside
    begin, end = edge[:n] > 0, edge[1:] < 0
    # rows that meet inside a run of letters
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut - 1]]
    begin[cut] = True
    end[cut - 1] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(letter[raw] * up[:n], dtype=U64)])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> U64(29)
    mix(h, ODD[2])
    return h, starts, np.diff(np.searchsorted(starts, at))


def shingles(h: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and how many each row has; a row with fewer words has one run of all."""
    if not len(h):
        return h, counts
    row = np.repeat(np.arange(len(counts)), counts)
    place = run_lengths(counts)
    here = (place + size <= counts[row]) | ((place == 0) & (counts[row] < size))
    first = np.flatnonzero(here)
    s = np.full(len(first), U64(ODD[4]))
    for i in range(size):
        more = np.minimum(i, counts[row[first]] - 1)  # short rows repeat their last word
        s += h[first + more]
        mix(s, ODD[i % 4])
    return s, np.bincount(row[first], minlength=len(counts))
