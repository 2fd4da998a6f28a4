"""Removal of byte strings that also start in an earlier document, by prefix doubling.

The rank of a position is a 64-bit name of the string that begins there. Names of eight bytes are
read off; names at growing offsets are paired up to half the threshold inside the tasks. Of all
windows of the threshold's length, neighbours with the same smallest half-length name form a run,
and runs of equal strings have equal names wherever they stand, so Spark deals and sorts one
(name, rank pair) for about fourteen positions. What is unique is dropped at once. Runs that meet
under one name without being equal are reranked window by window on the pair of names at offset
0 and half the threshold, which reaches the threshold: a second sort settles them.

Rows travel as packed arrays, one for each bucket and some 16 MB of text, and each such batch
first drops what its own smallest document settles, so a string that stands in a third of all
documents reaches its bucket once a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.llm.common import ODD, U64, checkpoint, gram_hash, mix, release, run_lengths, shuffle_partitions, slices, utf8, words8

#: Bytes of text whose runs are settled among themselves before they are dealt out.
BATCH = 16 << 20
SETTLED, RUN = 0, 1  # kinds of packed rows: for the buckets of documents, and of names
REMOVED, ASKED = 0, 1  # what a settled row says, in place of its name: the run goes, or is to be reranked
FIELDS = (("name", "<u4"), ("pair", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("more", "<u1"))
ROW_BYTES = sum(np.dtype(kind).itemsize for _, kind in FIELDS)
PACKED = "kind int, bucket int, n int, data binary"


def pack(part: dict[str, np.ndarray]) -> bytes:
    """Columns as planes of bytes (ids as differences), compressed: checkpoints don't compress by themselves."""
    planes = []
    for name, kind in FIELDS:
        x = np.ascontiguousarray(part[name], kind)
        if name == "doc":
            x = np.diff(x, prepend=np.zeros(1, x.dtype))
        planes.append(x.view(np.uint8).reshape(len(x), -1).T.tobytes())
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(blobs: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {name: [] for name, _ in FIELDS}
    for n, data in blobs:
        at, data = 0, pa.decompress(data, n * ROW_BYTES, "zstd", asbytes=True)
        for name, kind in FIELDS:
            width = np.dtype(kind).itemsize
            x = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)
            parts[name].append(np.cumsum(x) if name == "doc" else x)
            at += n * width
    return {name: np.concatenate(x) if x else np.zeros(0, kind) for (name, kind), x in zip(FIELDS, parts.values(), strict=True)}


def take(part: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in part.items()}


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return ((doc ^ (doc.view(U64) >> U64(17)).view(np.int64)) % buckets).astype(np.int64)


def doc_bucket_column(doc: Column, buckets: int) -> Column:
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 17)), F.lit(buckets).cast("long")).cast("int")


def deal(kind: int, bucket: np.ndarray, part: dict[str, np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, part = bucket[order], take(part, order)
    if not len(bucket):
        return
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(edge, [*edge[1:], len(bucket)], strict=True):
        yield kind, int(bucket[lo]), int(hi - lo), pack({k: v[lo:hi] for k, v in part.items()})


def as_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, n, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["kind", "bucket", "n", "data"])


def least_name(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` names in a row, by doubling."""
    low, reach = h, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[: len(low) - (width - reach)], low[width - reach :]) if width > reach else low


def runs(raw: np.ndarray, at: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Runs of windows with one smallest name: row, at (first window), more (further windows), name, pair."""
    half = size // 2
    tail = size - half
    none = np.zeros(0, np.int64)
    if len(raw) < size:
        return {"row": none, "at": none, "more": none, "name": none.astype(U64), "pair": none.astype(U64)}
    h = gram_hash(raw, half)
    low = least_name(h, tail + 1)
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    fits = np.diff(at) >= size
    new[at[:-1][fits]] = True
    past = at[1:][fits] - size + 1
    new[past[past < len(low)]] = True
    start = np.flatnonzero(new)
    more = np.diff(start, append=len(low)) - 1
    row = np.searchsorted(at, start, "right") - 1
    keep = start + size <= at[row + 1]
    start, more, row = start[keep], more[keep], row[keep]
    if len(more) and more.max() >= size:  # only in periodic text: cut, so that both ends tell the whole run
        parts = more // size + 1
        step = run_lengths(parts) * size
        start, row, end = np.repeat(start, parts) + step, np.repeat(row, parts), np.repeat(start + more, parts)
        more = np.minimum(end - start, size - 1)
    window = lambda p: mix(mix(h[p], ODD[1]) + h[p + tail], ODD[2])
    pair = mix(mix(window(start), ODD[3]) + window(start + more), ODD[0]) + more.astype(U64)
    return {"row": row, "at": start - at[row], "more": more, "name": mix(low[start], ODD[4]), "pair": mix(pair, ODD[1])}


def names_at(raw: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the two halves of the windows at these places."""
    view, half = words8(raw), size // 2

    def name(p: np.ndarray) -> np.ndarray:
        h = mix(view[p], ODD[0])
        for step, at in enumerate([*range(8, half - 7, 8), *([half - 8] if half % 8 else [])]):
            h += view[p + at]
            mix(h, ODD[1 + step % 4])
        return h

    return name(place), name(place + size - half)


def settle(part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort by (name, pair, doc): the order, which rows have an earlier document with the same pair, where names and pairs begin."""
    order = np.lexsort((part["doc"], part["pair"], part["name"]))
    name, pair, doc = (part[k][order] for k in ("name", "pair", "doc"))
    fresh_name = np.concatenate([[True], name[1:] != name[:-1]])
    fresh = fresh_name | np.concatenate([[True], pair[1:] != pair[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
    return order, doc > doc[first], fresh_name, fresh


def to_docs(part: dict[str, np.ndarray], says: np.ndarray, doc_buckets: int) -> Iterator[tuple]:
    """Rows for the buckets of their documents, in order there; names and pairs are of no more use."""
    part = {**part, "name": says, "pair": np.zeros(len(says), np.int64)}
    part = take(part, np.lexsort((part["at"], part["doc"])))
    return deal(SETTLED, doc_bucket(part["doc"], doc_buckets), part)


def local(part: dict[str, np.ndarray], buckets: int, doc_buckets: int) -> Iterator[tuple]:
    """What a batch settles by itself goes to its documents, the rest to the buckets of its names."""
    if not len(part["doc"]):
        return
    order, gone, _, _ = settle(part)
    out = take(part, order[gone])
    yield from to_docs(out, np.full(len(out["doc"]), REMOVED), doc_buckets)
    rest = take(part, np.sort(order[~gone]))
    yield from deal(RUN, (rest["name"] >> U64(40)).astype(np.int64) % buckets, {**rest, "name": rest["name"] & U64(0xFFFFFFFF)})


def rerank(table: pa.Table, doc_buckets: int, ask: bool) -> pa.Table:
    """Settle one bucket of names. ``ask``: pass on the runs that share a name with other strings of other documents."""
    if table["kind"][0].as_py() != RUN:
        return table
    part = _blobs(table)
    order, gone, fresh_name, fresh = settle(part)
    tell = gone
    if ask:
        begin, of = np.flatnonzero(fresh_name), np.cumsum(fresh_name) - 1
        doc = part["doc"][order]
        mixed = (np.bincount(of, fresh) > 1) & (np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin))
        tell = gone | mixed[of]
    return pa.Table.from_batches([as_batch(list(to_docs(take(part, order[tell]), np.where(gone[tell], REMOVED, ASKED), doc_buckets)))])


class Rows:
    """The documents of one bucket: their bytes in a row, and where (doc, tag) stands."""

    def __init__(self, table: pa.Table):
        key = np.zeros(table.num_rows, [("doc", "<i8"), ("tag", "<u4")])
        key["doc"], key["tag"] = table["key__"].to_numpy(), table["tag__"].to_numpy()
        self.tagged = bool(key["tag"].any())
        self.keys, index, self.inverse = np.unique(key if self.tagged else key["doc"], return_index=True, return_inverse=True)
        self.doc, self.tag = key["doc"][index], key["tag"][index]
        self.raw, self.at = utf8(table["text"].take(pa.array(index)).combine_chunks())

    def find(self, part: dict[str, np.ndarray]) -> np.ndarray:
        if not self.tagged:
            return np.searchsorted(self.keys, part["doc"])
        key = np.zeros(len(part["doc"]), self.keys.dtype)
        key["doc"], key["tag"] = part["doc"], part["tag"]
        return np.searchsorted(self.keys, key)


def _blobs(table: pa.Table) -> dict[str, np.ndarray]:
    return unpack(list(zip(table["n"].to_pylist(), table["data"].to_pylist(), strict=True)))


def windows(docs: pa.Table, asked: pa.Table, size: int, buckets: int, doc_buckets: int) -> pa.Table:
    """Each window of the runs asked for, ranked by the pair of its half names."""
    part = _blobs(asked)
    part = take(part, part["name"] == ASKED)
    if not len(part["doc"]):
        return pa.Table.from_batches([as_batch([])])
    rows = Rows(docs)
    row, n = rows.find(part), part["more"].astype(np.int64) + 1
    row, at = np.repeat(row, n), np.repeat(part["at"].astype(np.int64), n) + run_lengths(n)
    first, second = names_at(rows.raw, rows.at[row] + at, size)
    pair = mix(mix(first.copy(), ODD[3]) + second, ODD[1])
    every = {"name": mix(first, ODD[4]), "pair": pair, "doc": rows.doc[row], "tag": rows.tag[row], "at": at, "more": np.zeros(len(at), np.uint8)}
    return pa.Table.from_batches([as_batch(list(local(every, buckets, doc_buckets)))])


def covered(rows: Rows, part: dict[str, np.ndarray], size: int) -> np.ndarray:
    """Which bytes some removed window covers."""
    change = np.zeros(len(rows.raw) + 1, np.int32)
    part = take(part, part["name"] == REMOVED)
    if len(part["doc"]):
        start = rows.at[rows.find(part)] + part["at"]
        change += np.bincount(start, minlength=len(change)).astype(np.int32)
        change -= np.bincount(start + part["more"] + size, minlength=len(change)).astype(np.int32)
    return np.cumsum(change[:-1]) > 0


def cut_out(docs: pa.Table, part: dict[str, np.ndarray], size: int) -> tuple[dict[str, list], np.ndarray]:
    """Figures and kept bytes of the distinct rows of a bucket, and the place of each row among them."""
    rows = Rows(docs)
    gone = covered(rows, part, size)
    begin = gone.copy()
    begin[1:] &= _not_after(gone, rows.at)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[rows.at])
    removed, runs_ = total(gone), total(begin)
    kept, left = rows.raw[~gone].tobytes(), np.concatenate([[0], np.cumsum(np.diff(rows.at) - removed)])
    return {"n_bytes": np.diff(rows.at), "n_removed": removed, "n_spans": runs_, "kept": [kept[a:b] for a, b in zip(left[:-1], left[1:], strict=True)]}, rows.inverse


def _not_after(gone: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte but the first: the byte before is kept, or belongs to another document."""
    free = ~gone[:-1]
    cut = at[(at > 0) & (at < len(gone))]
    free[cut - 1] = True
    return free


def removals(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Keyed documents and their packed runs, both with the buckets of documents."""
    spark = docs.sparkSession
    doc_buckets = 2 * shuffle_partitions(spark) + 1
    buckets = shuffle_partitions(spark)
    repeated = len(docs.groupBy("doc_id").count().where("count > 1").limit(1).collect()) > 0
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = docs.withColumns({"key__": key, "tag__": (F.crc32(text.cast("binary")) if repeated else F.lit(0)).cast("long"), "text": text})
    keyed = keyed.withColumn("bucket__", doc_bucket_column(F.col("key__"), doc_buckets))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        seen = 0

        def flush() -> pa.RecordBatch:
            part = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            return as_batch(list(local(part, buckets, doc_buckets)))

        for b in batches:
            doc, tag = b["key__"].to_numpy(), b["tag__"].to_numpy()
            raw, at = utf8(b["text"])
            for lo, hi in slices(at):
                part = runs(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], size)
                row = part.pop("row") + lo
                held.append({**part, "at": part["at"].astype(np.uint32), "more": part["more"].astype(np.uint8), "doc": doc[row], "tag": tag[row].astype(np.uint32)})
                seen += int(at[hi] - at[lo])
                if seen >= BATCH:
                    yield flush()
                    held, seen = [], 0
        if held:
            yield flush()

    ranked = keyed.select("key__", "tag__", "text").mapInArrow(rank, PACKED)
    settled = checkpoint(ranked.groupBy("kind", "bucket").applyInArrow(lambda t: rerank(t, doc_buckets, True), PACKED))
    release(spark)
    expanded = keyed.select("key__", "tag__", "text", "bucket__").groupBy("bucket__").cogroup(settled.groupBy("bucket")).applyInArrow(lambda d, a: windows(d, a, size, buckets, doc_buckets), PACKED)
    more = checkpoint(expanded.groupBy("kind", "bucket").applyInArrow(lambda t: rerank(t, doc_buckets, False), PACKED))
    release(spark)
    return keyed, settled.union(more)


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing repeated byte strings of ``size``.

    A byte goes if it is covered by ``size`` bytes that also start in a document with a smaller
    doc_id, judged on the input. Null texts are empty; a null doc_id comes before all others;
    rows with the same doc_id never remove from each other; every row gives a row. An empty table
    gives none. Other columns are ignored.
    """
    if not 16 <= size <= 255:
        raise ValueError("size must be from 16 to 255 bytes")
    keyed, gone = removals(docs.select("doc_id", "text"), size)

    def finish(d: pa.Table, g: pa.Table) -> pa.Table:
        found, inverse = cut_out(d, _blobs(g), size)
        sha = np.array([hashlib.sha256(k).hexdigest() for k in found["kept"]], object)
        columns = [d["doc_id"].cast(pa.int64()), *(pa.array(np.asarray(found[k])[inverse], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(sha[inverse], pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return keyed.groupBy("bucket__").cogroup(gone.groupBy("bucket")).applyInArrow(lambda d, g: finish(d, g) if d.num_rows else _none(schema), schema)


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.table({f.split()[0]: pa.array([], kinds[f.split()[1]]) for f in schema.split(", ")})


def without_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """All columns of docs, texts without the repeated strings; characters that lose some of their bytes go whole.

    Other columns pass through, whatever their names. Null texts become empty.
    """
    schema = docs.schema
    plain = [c if c in ("doc_id", "text") else f"other{i}" for i, c in enumerate(docs.columns)]
    keyed, gone = removals(docs.toDF(*plain), size)

    def finish(d: pa.Table, g: pa.Table) -> pa.Table:
        out = d.select(plain).rename_columns(schema.names)
        if not d.num_rows:
            return out
        found, inverse = cut_out(d, _blobs(g), size)
        texts = [k.decode("utf-8", "ignore") for k in found["kept"]]
        return out.set_column(schema.names.index("text"), "text", pa.array([texts[i] for i in inverse], pa.string()))

    return keyed.groupBy("bucket__").cogroup(gone.groupBy("bucket")).applyInArrow(finish, schema)
