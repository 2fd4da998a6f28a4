"""How filters interact: what each removes in every order in which they may be applied.

Failure flags are cubed together with the part of the corpus. A row of the cube whose grouped flags
are all false counts what survives just those filters, whatever the others say, so 32 counts a part
hold everything: what a step removes is what survives the filters before it less what survives these
and the step's own. Steps are therefore joined to pairs of subsets; documents are read once and are
never visited again for an order.

Before the cube, documents are counted by part and flags. For documents that repeat an earlier text,
texts go by their SHA-256; documents of one text are counted within (text, part, labels) first, so a
text with any number of copies is a handful of rows before anything is joined on it.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
COUNTS = ("n", "good", "toxic")


def text_flags(text: str | None) -> tuple[bytes, bool, bool, bool, bool]:
    """SHA-256 of a text (null: empty) and whether it is short, repetitive, loud, or has symbols."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: at blanks and 0x09 to 0x0D, nothing else
    n = len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 2 * len(text or "")
    return hashlib.sha256(raw).digest(), n < 200, 100 * len(set(words)) < 50 * n, loud, len(raw.translate(None, SYMBOLS)) < len(raw)


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, good, toxic: counts of documents by part and by the filters that they fail.

    part is the source, '' for null; a null text is empty. E is true of a document whose text a
    smaller doc_id has as well; rows that share the smallest doc_id of a text pass, and so do rows
    with a null doc_id, which are smaller than none. Repeated rows count each. A document is good or
    toxic if any of its rows in labels says so; rows of labels with a null doc_id match nothing.
    """

    def run(batches):
        for batch in batches:
            found = [text_flags(x) for x in batch.column("text").to_pylist()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.binary(), *[pa.bool_()] * 4), strict=True)] if found else [pa.array([], kind) for kind in (pa.binary(), *[pa.bool_()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *columns], ["doc_id", "part", "key", *FILTERS[:4]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, part string, key binary, " + ", ".join(f"{f} boolean" for f in FILTERS[:4]))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    rows = rows.join(marks, "doc_id", "left")
    # by id as well at first, which deals copies of one text evenly
    own = ["key", "part", *FILTERS[:4], F.coalesce("is_good", F.lit(False)).alias("is_good"), F.coalesce("is_toxic", F.lit(False)).alias("is_toxic")]
    by_id = rows.groupBy(*own, "doc_id").agg(F.count("*").alias("n"))
    names = ["key", "part", *FILTERS[:4], "is_good", "is_toxic"]
    by_text = by_id.groupBy(*names).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    earliest = by_text.groupBy("key").agg(F.min("first").alias("earliest"))
    both = by_text.join(earliest, "key")
    again = F.when(F.col("first") == F.col("earliest"), F.col("known") - F.col("at_first")).otherwise(F.col("known"))
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("E"), again.alias("n")), F.struct(F.lit(False).alias("E"), (F.col("n") - again).alias("n"))))
    split = both.select("part", *FILTERS[:4], "is_good", "is_toxic", kinds.alias("x")).select("part", *FILTERS[:4], "x.E", "x.n", "is_good", "is_toxic")
    of = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0))
    return split.where("n > 0").groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def survivors(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, subset, n, good, toxic for every subset of filters (a bit each, the first has 1): what passes them all."""
    cube = counted.cube(*filters, "part").agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"any_{f}") for f in filters])
    failed = reduce(Column.__or__, [F.coalesce(f, F.lit(False)) for f in filters])
    subset = reduce(Column.__add__, [(1 - F.col(f"any_{f}")).cast("int") * (1 << i) for i, f in enumerate(filters)])
    some = cube.where("all_parts = 0").where(~failed).select("part", subset.alias("subset"), *COUNTS)
    # subsets that nothing survives have no row in the cube
    held = some.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct(*COUNTS)))).alias("held"))
    every = held.select("part", "held", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    return every.select("part", "subset", *[F.coalesce(F.col("held")[F.col("subset")][c], F.lit(0)).cast("long").alias(c) for c in COUNTS])


def orders(filters: str = FILTERS) -> list[tuple[str, int, str, int, int, int, int]]:
    """filter_order, step, filter, and subsets: before and after it, it alone, all but it."""
    out, bit = [], {f: 1 << i for i, f in enumerate(filters)}
    for order in permutations(filters):
        for k, f in enumerate(order):
            before = sum(bit[x] for x in order[:k])
            out.append(("".join(order), k + 1, f, before, before | bit[f], bit[f], (1 << len(filters)) - 1 - bit[f]))
    return out


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``counted`` has part, a boolean for each filter (true: fails it), and n, good and toxic; none of the
    first two is null. Parts without rows have none here, so an empty table gives an empty one. The
    orders are the factorial of the number of filters, so this is for a few filters.
    """
    every = survivors(counted, filters)
    steps = counted.sparkSession.createDataFrame(orders(filters), "filter_order string, step int, letter string, before int, after int, alone int, rest int")
    side = lambda name: every.select(F.col("part"), F.col("subset").alias(name), F.struct(*COUNTS).alias(f"{name}_"))
    full = (1 << len(filters)) - 1
    wide = every.groupBy("part").agg(F.max(F.when(F.col("subset") == 0, F.col("n"))).alias("total"), F.max(F.when(F.col("subset") == full, F.col("n"))).alias("last"))
    pairs = side("before").join(F.broadcast(steps), "before").join(side("after"), ["part", "after"]).join(side("alone"), ["part", "alone"]).join(side("rest"), ["part", "rest"]).join(wide, "part")
    lost = lambda c: F.col(f"before_.{c}") - F.col(f"after_.{c}")
    out = pairs.select(
        "part", "filter_order", "step", "letter", F.col("after_.n").alias("kept"), lost("n").alias("removed"), (F.col("total") - F.col("alone_.n") - lost("n")).alias("redundant"),
        (F.col("rest_.n") - F.col("last")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    shares = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters over whole documents; see flagged() for nulls, ties and repeated rows.

    Only doc_id, source and text of docs are read, and doc_id, quality and toxic of labels; other
    columns are of no account, whatever their names.
    """
    return interactions(flagged(docs, labels))
