"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text is a weighted set of five-word shingles, the weight being how often a shingle occurs. Each
element's arrivals form a Poisson process of its weight; an arrival picks a component, and a
component keeps the element that arrives first. An element whose next arrival comes after the
latest component's first is done. Components agree with the probability Jaccard similarity of two
texts. Bands of components give candidates, and the similarity of a candidate pair is computed
exactly before it counts.

Texts with equal weighted sets are one class from the start. In each band every member is held
against the bucket's smallest member; after links have joined members into components, pairs of
one bucket that still lie in different components and were not compared are verified too, in large
buckets by tiles that emit a spanning forest only. So no candidate is left out, and no large group
turns into a table of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.llm.common import ODD, U64, checkpoint, components, fresh, mix, release, repeated_ids, shingles, slices, utf8, words

#: 24 bands of 4 components miss a pair at similarity 0.8 in 3 of a million cases.
BANDS, WIDTH = 24, 4
SIZE = BANDS * WIDTH
#: Buckets with more members are compared in tiles, smaller ones pair by pair.
LARGE = 32
#: Repeats of a shingle up to which a tile compares sets by matrix products; sets beyond go pair by pair.
LAYERS = 4


def weighted(raw: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each row's distinct shingles, in order of row and hash."""
    h, counts = words(raw, at)[::2]
    s, per_row = shingles(h, counts, size)
    row = np.repeat(np.arange(len(at) - 1), per_row)
    bits = max(1, int(len(at) - 2).bit_length())
    key = row.astype(U64) << U64(64 - bits) | s >> U64(bits)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, n = key[new], np.diff(new, append=len(key))
    return (key >> U64(64 - bits)).astype(np.int64), (key << U64(bits)) >> U64(14), n


def prob_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """For each row and component the element that arrives first (0 for rows without elements)."""
    first = np.full(rows * size, np.inf)
    kept = np.zeros(rows * size, U64)
    time = np.zeros(len(row))
    turn = 0
    while len(row):
        turn += 1
        r = mix(element + U64(turn * ODD[1] % (1 << 64)), ODD[0])
        r = mix(mix(r, ODD[2]), ODD[4])
        time = time - np.log(((r >> U64(11)) + U64(1)) * 2.0**-53) / weight
        component = row * size + ((mix(r.copy(), ODD[3]) >> U64(40)) % U64(size)).astype(np.int64)
        sooner = np.flatnonzero(time < first[component])
        at, t = component[sooner], time[sooner]
        np.minimum.at(first, at, t)
        won = first[at] == t
        kept[at[won]] = element[sooner[won]]
        last = first.reshape(rows, size).max(1)
        more = time < last[row]
        row, element, weight, time = row[more], element[more], weight[more], time[more]
    return kept.reshape(rows, size)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    s = signature.reshape(len(signature), BANDS, WIDTH)
    key = np.tile(np.arange(BANDS, dtype=U64) * U64(ODD[1]), (len(s), 1))
    for i in range(WIDTH):
        key += s[:, :, i]
        mix(key, ODD[i])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted elements, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    alone_x, alone_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratios, which = np.unique(x / y, return_inverse=True)
    shares = np.bincount(which, x)
    return float(sum(share / (np.maximum(x, c * y).sum() + alone_x + c * alone_y) for c, share in zip(ratios, shares, strict=True)))


def reaches(value, threshold: float):
    """The comparison of every path: similarities are sums of fractions, equal up to rounding."""
    return value >= threshold - 1e-9


def describe(docs: DataFrame) -> DataFrame:
    """uid, doc_id, p1, p2, n (digests and size of the weighted set) and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = utf8(b["text"])
            for lo, hi in slices(at):
                row, element, weight = weighted(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                rows = hi - lo
                keys = bands(prob_minhash(row, element, weight.astype(float), rows))
                sums = np.zeros((2, rows), U64)
                for k in range(2):
                    np.add.at(sums[k], row, mix(mix(element + U64(k), ODD[k]) * weight.astype(U64) + U64(ODD[3 + k]), ODD[2]))
                n = np.bincount(row, weight, rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b["uid"].slice(lo, rows), b["doc_id"].slice(lo, rows), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))], ["uid", "doc_id", "p1", "p2", "n", "bands"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, p1 long, p2 long, n long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are as similar as that. A hot ``a`` splits like any skewed join side."""
    left = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = np.concatenate([part["a"].to_numpy(), part["b"].to_numpy()])
                _, index, inverse = np.unique(ids, return_index=True, return_inverse=True)
                both = pa.concat_arrays([part["text_a"].cast(pa.large_string()), part["text_b"].cast(pa.large_string())]).take(pa.array(index))
                row, element, weight = weighted(*utf8(both))
                cut = np.searchsorted(row, np.arange(len(index) + 1))
                sets = [(element[x:y], weight[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                n = part.num_rows
                good = [reaches(similarity(sets[inverse[i]], sets[inverse[n + i]]), threshold) for i in range(n)]
                yield pa.RecordBatch.from_arrays([part["a"], part["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similarities(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float, left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted pairs of a left and a right set are similar enough.

    For weights u and v, a product of 0/1 rows counts the shared elements that weigh u on the left
    and v on the right, and the similarity is a function of these counts. Sets with an element that
    weighs more than LAYERS are compared one by one, where the weight of what is shared, which
    bounds the similarity from above, allows.
    """
    size = np.array([w.sum() for _, w in sets], float)
    row = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    _, column, times = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True, return_counts=True)
    most = np.zeros(len(times), np.int64)
    np.maximum.at(most, column, weight)
    odd = np.zeros(len(sets), bool)
    odd[row[weight > LAYERS]] = True
    layers = range(1, LAYERS + 1)
    counts = {(u, v): np.zeros((len(left), len(right))) for u in layers for v in layers}
    by_weight = np.zeros((2, len(left), len(right)))  # what is shared, as the left and as the right weigh it
    for repeated in (False, True):
        chosen = (times > 1) & ((most > 1) == repeated)
        place = np.cumsum(chosen) - 1
        for at in range(0, int(chosen.sum()), 4096):
            here = chosen[column] & (place[column] >= at) & (place[column] < at + 4096)
            r, k, w = row[here], place[column[here]] - at, weight[here]
            grids = []
            for u in layers if repeated else (1,):
                grid = np.zeros((len(sets), min(4096, int(chosen.sum()) - at)), np.float32)
                grid[r[w == u], k[w == u]] = 1
                grids.append((u, grid[left], grid[right]))
            for u, x, _ in grids:
                for v, _, y in grids:
                    counts[u, v] += x @ y.T
            if odd.any():
                grid = np.zeros((2, len(sets), min(4096, int(chosen.sum()) - at)), np.float32)
                grid[0, r, k], grid[1, r, k] = 1, w
                by_weight[0] += grid[1, left] @ grid[0, right].T
                by_weight[1] += grid[0, left] @ grid[1, right].T
    counts = {uv: n for uv, n in counts.items() if n.any()}
    alone_x = size[left][:, None] - sum(u * n for (u, _), n in counts.items())
    alone_y = size[right][None] - sum(v * n for (_, v), n in counts.items())
    total = np.zeros((len(left), len(right)))
    for c in {u / v for u, v in counts}:
        share = sum(u * n for (u, v), n in counts.items() if u / v == c)
        total += share / np.maximum(sum(n * max(u, c * v) for (u, v), n in counts.items()) + alone_x + c * alone_y, 1e-300)
    good = wanted & reaches(total, threshold)
    if odd.any():
        one_by_one = wanted & (odd[left][:, None] | odd[right][None])
        good &= ~one_by_one
        bound = np.minimum(by_weight[0] / size[left][:, None], by_weight[1] / size[right][None])
        for i, j in zip(*np.nonzero(one_by_one & reaches(bound, threshold)), strict=True):
            good[i, j] = reaches(similarity(sets[left[i]], sets[right[j]]), threshold)
    return good


def tiles(rows: DataFrame, texts: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """Links (a, b) between components within large buckets (key, rep, component, n), enough to join what is similar.

    A bucket is cut into blocks, and a tile holds two of them; it emits a spanning forest at most.
    """
    parts = (F.floor(F.col("n") / block) + 1).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("rep"), parts.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = own.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "component")

    def run(t: pa.Table) -> pa.Table:
        row, element, weight = weighted(*utf8(t["text"].combine_chunks()))
        cut = np.searchsorted(row, np.arange(t.num_rows + 1))
        rep, component, side = (t[c].to_numpy() for c in ("rep", "component", "side"))
        sets = [(element[x:y], weight[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        # most rows of a large bucket lie in one component already: pairs within it aren't computed
        values, counts = np.unique(component, return_counts=True)
        minor = component != values[counts.argmax()]
        if t["lo"][0].as_py() == t["hi"][0].as_py():
            sides = [(minor, np.ones(t.num_rows, bool))]
        else:
            sides = [((side == 0) & minor, side == 1), ((side == 0) & ~minor, (side == 1) & minor)]
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for left, right in (map(np.flatnonzero, x) for x in sides):
            wanted = component[left][:, None] != component[right][None]
            if wanted.any():
                x, y = np.nonzero(similarities(sets, threshold, left, right, wanted))
                i.append(left[x])
                j.append(right[y])
        i, j = np.concatenate(i), np.concatenate(j)
        # one pair for each two components, then a forest of these
        ends = np.sort(np.stack([component[i], component[j]], 1), 1)
        _, firsts = np.unique(ends, axis=0, return_index=True)
        root = {c: c for c in component.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        links = []
        for k in firsts:
            x, y = top(int(ends[k, 0])), top(int(ends[k, 1]))
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((rep[i[k]], rep[j[k]]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return dealt.join(texts, dealt.rep == texts.uid).select("key", "lo", "hi", "side", "rep", "component", "text").groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")


def row_key(docs: DataFrame) -> tuple[Column, bool]:
    """What tells documents apart: doc_id, or, where ids repeat or are null (second value), id and text."""
    repeated = repeated_ids(docs)
    return F.xxhash64("doc_id", F.isnull("doc_id"), "text", F.isnull("text")) if repeated else F.col("doc_id").cast("long"), repeated


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and kept for every row of docs.

    A class is what links of similarity >= threshold connect. Documents without a word (null and
    empty texts among them) are classes of their own; shorter than five words, a text is one
    shingle of all its words. Repeated rows are equal documents. Null doc_ids are nobody's
    smallest unless all of a class are null. Of a class one document (doc_id and text) is kept. Other
    columns are ignored; an empty table gives none.
    """
    return classified(docs, *row_key(docs), threshold).drop("uid")


def classified(docs: DataFrame, uid: Column, repeated: bool, threshold: float) -> DataFrame:
    """near_duplicates() with each row's key."""
    spark = docs.sparkSession
    keyed = docs.select(uid.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = checkpoint(describe(keyed))
    full = known.where("n > 0")
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "uid") if repeated else F.col("uid")
    classes = checkpoint(full.groupBy("p1", "p2", "n").agg(F.min("uid").alias("rep"), F.min(order).alias("least"), F.first("bands").alias("bands")))
    in_bands = classes.select("rep", F.explode("bands").alias("key"))
    groups = in_bands.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = checkpoint(in_bands.join(groups, "key").select("key", "rep", "lead"))
    pairs = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    needed = members.select("rep").distinct()
    texts = checkpoint(keyed.join(needed, keyed.uid == needed.rep, "left_semi").select("uid", "text").dropDuplicates(["uid"]) if repeated else keyed.join(needed, keyed.uid == needed.rep, "left_semi").select("uid", "text"))
    release(spark)
    links = checkpoint(verify(pairs, texts, threshold))
    joined = components(links)
    # candidates that lie in different components and were not compared
    placed = members.join(joined, members.rep == joined.node, "left").select("key", "rep", "lead", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 < c1").select("key", "n")
    rest = placed.where("rep <> lead").join(mixed, "key").select("key", "rep", "component", "n")
    small = rest.where(F.col("n") <= LARGE)
    x, y = small.select("key", F.col("rep").alias("a"), F.col("component").alias("ca")), small.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"))
    others = x.join(y, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    late = checkpoint(verify(others, texts, threshold).union(tiles(rest.where(F.col("n") > LARGE), texts, threshold)))
    if late.limit(1).count():
        # the graph of components that late links join, and each node's component in it
        ends = late
        for side in ("a", "b"):
            ends = ends.join(joined.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(side, F.coalesce(f"c{side}", side)).drop(f"c{side}")
        above = components(ends).toDF("component", "top")
        known_nodes = joined.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        # nodes that had no link before
        joined = known_nodes.union(above.join(joined, above.component == joined.node, "left_anti").select("component", "top"))
    where = classes.join(joined, classes.rep == joined.node, "left").select("p1", "p2", "n", "least", F.coalesce("component", "rep").alias("component"))
    least = where.groupBy("component").agg(F.min("least").alias("least"))
    class_id, keeper = (F.col("least.doc_id"), F.col("least.uid")) if repeated else (F.col("least"),) * 2
    by_class = where.drop("least").join(least, "component").select("p1", "p2", "n", class_id.alias("class_id"), keeper.alias("keeper"))
    alone = known.where("n = 0").select("uid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return full.join(by_class, ["p1", "p2", "n"]).select("uid", "doc_id", "class_id", (F.col("uid") == F.col("keeper")).alias("kept")).union(alone)


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs with all their columns, but of each class only one document, of its smallest doc_id, once."""
    uid, repeated = row_key(docs)
    own, dropped = fresh(docs.columns, "uid", "dropped")
    drop = classified(docs, uid, repeated, threshold).where("not kept").select(F.col("uid").alias(dropped))
    kept = docs.withColumn(own, uid).join(drop, F.col(own) == F.col(dropped), "left_anti")
    return (kept.dropDuplicates([own]) if repeated else kept).drop(own)
