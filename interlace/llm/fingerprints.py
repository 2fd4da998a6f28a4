"""Order MinHash: signatures that follow edit distance.

A text's k-mers (eight UTF-8 bytes) are numbered by occurrence; hashes of (k-mer, occurrence)
deal them to BINS bins, each keeps its two smallest, in the order in which they stand in the
text, and hashes that tuple. One hash per k-mer thus serves all bins, so the work per character
doesn't grow with the signature. A bin without k-mers takes the next filled bin's tuple.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.llm.common import ODD, U64, mix, shuffle_partitions, slices, utf8, words8

K, BINS, KEEP = 8, 64, 2


def occurrences(name: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often the same name stood in the same row before."""
    n = len(name)
    bits = max(1, int(n - 1).bit_length())
    own = name ^ mix(row.astype(U64) + U64(1), ODD[3])
    low = U64((1 << bits) - 1)
    key = (own & ~low) | np.arange(n, dtype=U64)
    key.sort()
    place = (key & low).astype(np.int64)
    same = (key[1:] ^ key[:-1]) <= low
    full = own[place]
    if np.any(same & (full[1:] != full[:-1])):  # two names share their upper bits: sort by all of them
        place = np.lexsort((np.arange(n), own))
        full = own[place]
    start = np.concatenate([[True], full[1:] != full[:-1]])
    index = np.arange(n)
    number = np.empty(n, np.int64)
    number[place] = index - np.maximum.accumulate(np.where(start, index, 0))
    return number


def signatures(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of BINS 16-bit values for each text; 0 stands in all bins of an empty text only."""
    out = np.zeros((len(at) - 1, BINS), np.uint16)
    for first, last in slices(at, 1 << 18):
        for lo in range(first, last, 1 << 13):
            hi = min(last, lo + (1 << 13))
            out[lo:hi] = _signatures(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
    return out


def _signatures(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, BINS), np.uint16)
    if not len(raw):
        return out
    padded = np.concatenate([raw, np.zeros(K, np.uint8)])
    grams = np.where(size >= K, size - K + 1, size > 0)
    row = np.repeat(np.arange(n), grams)
    place = np.repeat(at[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(len(row))
    name = words8(padded)[place]
    for i in np.flatnonzero((size < K) & (size > 0)):  # shorter than a k-mer: all bytes, then zeros
        name[int(grams[:i].sum())] = int.from_bytes(raw[at[i] : at[i + 1]].tobytes(), "little")
    name = mix(name ^ U64(ODD[1]), ODD[0])
    v = name + occurrences(name, row).astype(U64) * U64(ODD[2])
    mix(mix(v, ODD[4]), ODD[0])
    # the two smallest of each (row, bin) by all 64 bits of v, so a text's tuples don't depend on what stands beside it
    group = row * BINS + (v >> U64(64 - 6)).astype(np.int64)
    order = np.argsort(v, kind="stable")
    index = order[np.argsort(group[order], kind="stable")]
    group = group[index]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    second = np.minimum(start + 1, len(group) - 1)
    pair = group[second] == group[start]
    pair &= second != start
    a, b = index[start], np.where(pair, index[second], index[start])
    tuples = v[np.minimum(a, b)] * U64(ODD[3])
    tuples ^= tuples >> U64(31)
    tuples += v[np.maximum(a, b)]
    mix(tuples, ODD[2])
    out.reshape(-1)[group[start]] = (tuples >> U64(40)).astype(np.uint16) | 1
    thin = np.flatnonzero((out == 0).any(1) & (out != 0).any(1))
    if len(thin):
        twice = np.concatenate([out[thin], out[thin]], 1)
        filled = np.where(twice != 0, np.arange(2 * BINS), 2 * BINS)
        nearest = np.minimum.accumulate(filled[:, ::-1], 1)[:, ::-1][:, :BINS]
        lent = np.take_along_axis(twice, nearest, 1).astype(np.int64) + 2 * 7919 * (nearest - np.arange(BINS))
        out[thin] = lent.astype(np.uint16) | 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """part, ahead, doc_id, text: ranges of doc_id, each closed by the first row of the next range.

    Only range bounds and each range's first id (one per part) pass through the driver.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").alias("own_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    if bounds:
        splits = [-float("inf"), *sorted(set(bounds)), float("inf")]
        docs = docs.withColumn("at", F.col("doc_id").cast("double"))
        docs = Bucketizer(splits=splits, inputCol="at", outputCol="part").transform(docs).withColumn("part", F.col("part").cast("int")).drop("at")
    else:  # one partition, or an empty table
        docs = docs.withColumn("part", F.lit(0))
    firsts = sorted(docs.groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect())
    if not firsts:
        return docs.withColumn("ahead", F.lit(0)).select("part", "ahead", "doc_id", "own_id", "text")
    heads = [(firsts[i - 1]["part"], f["doc_id"]) for i, f in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(heads, "part int, doc_id long")
    ahead = docs.drop("part").join(F.broadcast(heads), "doc_id").withColumn("ahead", F.lit(1))
    return docs.withColumn("ahead", F.lit(0)).unionByName(ahead).select("part", "ahead", "doc_id", "own_id", "text")


def fingerprint(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, its edited text, and how like they are.

    Rows are ordered by (doc_id, text), null ids first; the text after a row is that of the next
    row, after the last that of the first. A null text is empty; empty texts are alike (1.0), and
    an empty and a filled one are not (0.0). Repeated rows each give a row; other columns are ignored.
    An empty table gives an empty one.
    """
    parts = parts or shuffle_partitions(docs.sparkSession)
    rows = neighbours(docs, parts).repartition(parts, "part").sortWithinPartitions("part", "ahead", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                held += zip(part["part"].to_pylist(), part["ahead"].to_pylist(), part["own_id"].to_pylist(), part["text"].to_pylist(), strict=True)
                if len(held) > 1:
                    yield finish(held)
                    held = held[-1:]

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edited = [edit(texts[i], texts[i + 1]) for i in own]
        both = signatures(*utf8(pa.array([*texts, *edited], pa.large_string())))
        a, e = both[: len(rows)], both[len(rows) :]
        show = lambda s: [x.tobytes().hex() for x in s.astype("<u2")]
        columns = [
            pa.array([rows[i][2] for i in own], pa.int64()),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(show(a[own]), pa.string()),
            pa.array(show(e), pa.string()),
            pa.array(likeness(a[own], e), pa.float64()),
            pa.array(likeness(a[own], a[[i + 1 for i in own]]), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
