"""Linkage of printed names: blocking, rules of acceptance, components, and one row for each entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlace.functions.text import company_letters, company_tokens, distance, extra_word, indel_ratio, skeleton
from interlace.operators.lineage import cut, dealt


def initials_agree(a: Column, b: Column) -> Column:
    """First letters of the keys' first tokens are equal; a key of one token agrees with all."""
    first = lambda k: F.when(F.size(F.split(k, " ")) > 1, F.left(k, F.lit(1)))
    return F.coalesce(first(a) == first(b), F.lit(True))


def blocked_pairs(names: DataFrame, key: str = "name_key") -> DataFrame:
    """a, b, agree, subset: pairs of distinct keys that share their last token, a < b, with what the rules ask.

    Distinct keys are compared, not mentions, so a name printed a million times is one row.
    """
    n = names.select(F.col(key).alias("k")).distinct().where("k <> ''").withColumn("block", F.substring_index("k", " ", -1))
    j = n.select("block", F.col("k").alias("a")).join(n.select("block", F.col("k").alias("b")), "block").where("a < b")
    ta, tb = F.split("a", " "), F.split("b", " ")
    subset = (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)
    return j.select("a", "b", initials_agree(F.col("a"), F.col("b")).alias("agree"), subset.alias("subset"))


def token_sort_ratio(a: str, b: str) -> Column:
    """Indel ratio of two columns with their words sorted, by Arrow batches."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(" ".join(sorted(i.split())), " ".join(sorted(j.split()))) for i, j in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def accepted(pairs: DataFrame, least: float = 88.0) -> DataFrame:
    """Those of blocked_pairs() that are one name: initials agree, and tokens are a subset or the words much alike."""
    gated = pairs.where("agree")
    alike = gated.where("not subset").where(token_sort_ratio("a", "b") >= least)
    return gated.where("subset").select("a", "b").union(alike.select("a", "b"))


def components(nodes: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: the smallest node that links (a, b) reach, for every row of nodes(node).

    Smallest labels are handed on and then looked up once more in each round, so chains shorten by
    half; every round is checkpointed in the shared folder.
    """
    spark = nodes.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    edges = links.union(links.select("b", "a")).distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("root")).checkpoint()
    for _ in range(rounds):
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", F.least("root", "low").alias("root"), (F.col("low") < F.col("root")).alias("moved"))
        far = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = lower.join(far, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "moved").checkpoint()
        labels = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def summary(mentions: DataFrame, prefix: str) -> DataFrame:
    """One row for each root of mentions(root, name, year): ordinal id, modal label, variants, years and counts.

    The label is the name printed most often, of equals the longest, then the first by alphabet.
    """
    by_name = mentions.groupBy("root", "name").agg(F.count("*").alias("n"), F.collect_set("year").alias("years"))
    order = Window.partitionBy("root").orderBy(F.desc("n"), F.desc(F.length("name")), "name")
    ranked = by_name.withColumn("place", F.row_number().over(order))
    ids = ranked.groupBy("root").agg(
        F.max(F.when(F.col("place") == 1, F.col("name"))).alias("label"),
        F.sum("n").alias("n_mentions"),
        F.array_join(F.sort_array(F.collect_set("name")), " ;; ").alias("name_variants"),
        F.array_join(F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))), lambda y: y.cast("string")), ";").alias("years_present"),
    )
    return ids.join(ordinals(ids, "root", prefix), "root")


def ordinals(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """column, id: a prefix and five digits or more, by order of the column."""
    return numbered(df, column).select(column, F.format_string(f"{prefix}%05d", F.col("number")).alias("id"))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """column, number: its distinct values numbered from 1 in order, without one task that sorts all.

    Rows are dealt by range; each range numbers its own and adds how many the ranges before it hold.
    """
    keys = df.select(column).distinct().repartitionByRange(column).withColumn("part_", F.spark_partition_id())
    keys = cut(keys)
    sizes = keys.groupBy("part_").agg(F.count("*").alias("n_"))  # one row for each partition
    before = sizes.withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).select("part_", "before_")
    own = F.row_number().over(Window.partitionBy("part_").orderBy(column))
    return keys.join(F.broadcast(before), "part_").select(column, (own + F.col("before_")).cast("long").alias("number"))


def audit(mentions: DataFrame, more_than: int = 2) -> DataFrame:
    """root, variants: entities under which more than so many spellings were merged."""
    return mentions.groupBy("root").agg(F.countDistinct("name").alias("variants")).where(F.col("variants") > more_than)


def fields(names: list[str]) -> tuple[dict[str, int], int, np.ndarray, int]:
    """Names side by side in one integer, each in whole bytes with a bit to spare: the bits of each letter and of all letters, the
    bytes that names begin at, and how many there are."""
    at: dict[str, list[int]] = {}
    starts, whole, end = [], [], 0
    for name in names:
        starts.append(end)
        for j, y in enumerate(name):
            at.setdefault(y, []).append(8 * end + j)
        whole.append(((1 << len(name)) - 1).to_bytes(len(name) // 8 + 1, "little"))
        end += len(name) // 8 + 1

    def number(bits: list[int]) -> int:
        row = np.zeros(8 * end, np.uint8)
        row[bits] = 1
        return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")

    return {y: number(bits) for y, bits in at.items()}, int.from_bytes(b"".join(whole), "little"), np.array(starts), end


def alike(a: list[str], b: list[str], least: float) -> Iterator[tuple[str, str]]:
    """Pairs of a name of either list whose indel_ratio() is ``least`` or more; one of a meets all of b at once, in the bits of one number."""
    at, whole, starts, size = fields(b)
    lengths = np.array([len(y) for y in b])
    for x in a:
        row = whole
        for letter in x:
            u = row & at.get(letter, 0)
            row = (row + u | row - u) & whole
        left = np.add.reduceat(np.bitwise_count(np.frombuffer(row.to_bytes(size, "little"), np.uint8)), starts, dtype=np.int64)
        for j in np.flatnonzero(200 * (lengths - left) / (len(x) + lengths) >= least):
            yield x, b[j]


def scan_candidates(names: DataFrame, least: float = 80.0, block: int = 8192) -> DataFrame:
    """a, b: pairs of distinct names(k) whose indel ratio is ``least`` or more, a < b, all of them.

    Every pair is compared, as names of few letters are all somewhat alike and no letter tells them apart: names are
    dealt to blocks of at most about ``block``, and a task has two of these. A pair costs a tenth of a microsecond.
    """
    n = cut(names.select("k").distinct().where("k <> ''"))
    count = n.count()
    blocks = max(-(-count // block), min(24, -(-count // 256)), 1)
    one = n.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = one.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k")

    def pairs(t: pa.Table) -> pa.Table:
        rows, own, j = t["k"].to_pylist(), t["own"].to_pylist(), t["j"][0].as_py()
        b = [k for k, o in zip(rows, own, strict=True) if o == j]
        a = [k for k, o in zip(rows, own, strict=True) if o != j] if t["i"][0].as_py() != j else b
        found = {(min(p), max(p)) for p in alike(a, b, least) if p[0] != p[1]} if b else ()
        return pa.table({"a": pa.array([x for x, _ in found], pa.string()), "b": pa.array([y for _, y in found], pa.string())})

    return dealt(tiles, "i", "j").groupBy("i", "j").applyInArrow(pairs, "a string, b string")


def complete_linkage(pairs: DataFrame, names: DataFrame, most: float = 0.30) -> DataFrame:
    """k, root: closest pairs (a, b, distance) merge first, and only if all cross pairs are within ``most``.

    names has k and, if distances are not those of k itself, the letters that they are of. Greedy, so in
    order (distance, a, b), within each component of the pairs; names not in a pair are their own root.
    """
    placed = components(names.select(F.col("k").alias("node")).distinct(), pairs.select("a", "b"))
    rows = pairs.join(placed, pairs.a == placed.node).select("root", "a", "b", "distance")
    spelt = names.select("k", F.col("letters" if "letters" in names.columns else "k").alias("spelt")).distinct()
    for side in ("a", "b"):
        rows = rows.join(spelt.select(F.col("k").alias(side), F.col("spelt").alias(f"spelt_{side}")), side)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        letters = dict(zip(t["a"], t["spelt_a"], strict=True)) | dict(zip(t["b"], t["spelt_b"], strict=True))
        group = {k: [k] for k in sorted(letters)}
        for a, b in t.sort_values(["distance", "a", "b"])[["a", "b"]].itertuples(index=False):
            x, y = group[a], group[b]
            if x is not y and all(distance(letters[i], letters[j]) <= most for i in x for j in y):
                for k in y:
                    group[k] = x
                x.extend(y)
        return pd.DataFrame({"k": list(group), "merged": [min(g) for g in group.values()]})

    merged = rows.groupBy("root").applyInPandas(run, "k string, merged string")
    return placed.select(F.col("node").alias("k")).join(merged, "k", "left").select("k", F.coalesce("merged", "k").alias("root"))


def confirmed(pairs: DataFrame, firms: DataFrame, most: float = 0.20, near: float = 0.10, letters: int = 8) -> DataFrame:
    """a, b, distance of candidate pairs of skeletons whose firms(k, letters, tokens) are close enough.

    Both names have ``letters`` letters at least. A word that one name has and the other lacks
    parts them, unless the names are within ``near`` of each other. a and b are the skeletons: names
    with the same letters, or none, are still two.
    """
    side = lambda x: firms.select(F.col("k").alias(x), F.col("letters").alias(f"letters_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(F.least(F.length("letters_a"), F.length("letters_b")) >= letters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for a, b, x, y, p, q in zip(t["a"], t["b"], t["letters_a"], t["letters_b"], t["tokens_a"], t["tokens_b"], strict=True):
                d = distance(x, y)
                if d <= most and (d <= near or not extra_word(list(p), list(q))):
                    rows.append((min(a, b), max(a, b), d))
            yield pd.DataFrame(rows, columns=["a", "b", "distance"]).astype({"distance": float})

    return both.select("a", "b", "letters_a", "letters_b", "tokens_a", "tokens_b").mapInPandas(run, "a string, b string, distance double").where("a <> b").distinct()


def person_roots(mentions: DataFrame, key: str, own: str) -> DataFrame:
    """mentions with root: one for all names that are one person's. A row without a key is like no other but
    those with its own ``own`` (a mention's id, or a name)."""
    names = mentions.select(F.col(key).alias("name_key")).where("name_key <> ''").distinct()
    root = components(names.select(F.col("name_key").alias("node")), cut(accepted(blocked_pairs(names))))
    linked = mentions.join(root, mentions[key] == root["node"], "left").drop("node")
    return linked.withColumn("root", F.coalesce("root", F.concat(F.lit("0"), F.col(own).cast("string"))))


def company_roots(mentions: DataFrame, name: str) -> DataFrame:
    """mentions with root: one for all spellings of a firm.

    Spellings of one skeleton are one firm, and near skeletons are merged by complete linkage. Names that have
    no skeleton (no letter or digit) stay apart, each spelling a firm of its own.
    """
    spelt = mentions.select(F.col(name).alias("name")).distinct().withColumn("k", skeleton(F.col("name")))
    firms = spelt.where("k <> ''").groupBy("k").agg(F.min("name").alias("first")).select("k", company_letters(F.col("first")).alias("letters"), company_tokens(F.col("first")).alias("tokens"))
    firms = cut(firms)
    root = complete_linkage(cut(confirmed(scan_candidates(firms), firms)), firms)
    by_name = spelt.join(root, "k", "left").select(F.col("name").alias("name_"), F.coalesce("root", F.concat(F.lit("0"), "name")).alias("root"))
    return mentions.join(by_name, mentions[name].eqNullSafe(by_name["name_"])).drop("name_")
