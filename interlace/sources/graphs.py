"""Graphs as files, a GEXF or GraphML file for each wave, and volumes of text with what is on disk for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _xml(value: Column) -> Column:
    """Text for an attribute: null is empty, marks are escaped, characters that XML can't hold go."""
    plain = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        plain = F.replace(plain, F.lit(mark), F.lit(name))
    return plain


def _flat(df: DataFrame, name: str) -> Column:
    """Lists joined by semicolons, as attributes hold no lists."""
    return F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), ";") if df.schema[name].dataType.typeName() == "array" else F.col(name)


def write_graphs(nodes: DataFrame, edges: DataFrame, folder: str, form: str = "gexf") -> None:
    """folder/year=<wave>/part-...: one well-formed file for each year of nodes(year, id, ...) and edges(year, a, b, ...).

    Every other column is an attribute, of text. A file's lines are rows: they are dealt by wave, sorted in place
    and written as they come, so a wave needs no more memory than a task, and nothing is collected. Waves
    without nodes have no file. The edges of nodes that aren't listed are the caller's to leave out.
    """
    node_names, edge_names = [c for c in nodes.columns if c not in ("year", "id")], [c for c in edges.columns if c not in ("year", "a", "b")]
    line = lambda df, rank, key, text: df.select("year", F.lit(rank).alias("rank"), key.cast("string").alias("key"), text.alias("value"))
    waves = nodes.select("year").distinct()
    if form == "gexf":
        declared = lambda kind, names: f'<attributes class="{kind}">' + "".join(f'<attribute id="{kind[0]}{i}" title="{c}" type="string"/>' for i, c in enumerate(names)) + "</attributes>"
        head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected">' + declared("node", node_names) + declared("edge", edge_names) + "<nodes>"
        middle, tail = "</nodes><edges>", "</edges></graph></gexf>"
        values = lambda df, kind, names: F.concat(F.lit("<attvalues>"), *[F.concat(F.lit(f'<attvalue for="{kind}{i}" value="'), _xml(_flat(df, c)), F.lit('"/>')) for i, c in enumerate(names)], F.lit("</attvalues>"))
        node = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("id")), F.lit('">'), values(nodes, "n", node_names), F.lit("</node>"))
        edge = F.concat(F.lit('<edge source="'), _xml(F.col("a")), F.lit('" target="'), _xml(F.col("b")), F.lit('">'), values(edges, "e", edge_names), F.lit("</edge>"))
    elif form == "graphml":
        keys = "".join(f'<key id="{kind[0]}{i}" for="{kind}" attr.name="{c}" attr.type="string"/>' for kind, names in (("node", node_names), ("edge", edge_names)) for i, c in enumerate(names))
        head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'
        middle, tail = "", "</graph></graphml>"
        values = lambda df, kind, names: F.concat(F.lit(""), *[F.concat(F.lit(f'<data key="{kind}{i}">'), _xml(_flat(df, c)), F.lit("</data>")) for i, c in enumerate(names)])
        node = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), values(nodes, "n", node_names), F.lit("</node>"))
        edge = F.concat(F.lit('<edge source="'), _xml(F.col("a")), F.lit('" target="'), _xml(F.col("b")), F.lit('">'), values(edges, "e", edge_names), F.lit("</edge>"))
    else:
        raise ValueError(f"no such form: {form}")
    frame = [line(waves, rank, F.lit(""), F.lit(text)) for rank, text in ((0, head), (2, middle), (4, tail))]
    rows = line(nodes, 1, F.col("id"), node).union(line(edges.join(waves, "year", "left_semi"), 3, F.concat_ws(" ", "a", "b"), edge))
    for part in frame:
        rows = rows.union(part)
    rows.repartition("year").sortWithinPartitions("year", "rank", "key").select("year", "value").write.partitionBy("year").mode("overwrite").text(folder)


def write_edges(edges: DataFrame, folder: str) -> None:
    """Edges as CSV, lists joined by semicolons: year first, then a and b as source and target, then attributes."""
    rest = [c for c in edges.columns if c not in ("year", "a", "b")]
    edges.select("year", F.col("a").alias("source"), F.col("b").alias("target"), *[_flat(edges, c).alias(c) for c in rest]).write.options(header=True, escape='"', emptyValue="").mode("overwrite").csv(folder)


def hand_off(ties: DataFrame, persons: DataFrame, firms: DataFrame, folder: str) -> None:
    """Three long CSV tables for other programs, edges, persons and firms, year first; nodes are those of each wave's ties."""
    for name, df in (("edges", ties.select("year", "person", "firm")), ("persons", ties.select("year", "person").distinct().join(persons, "person", "left")), ("firms", ties.select("year", "firm").distinct().join(firms, "firm", "left"))):
        df.select("year", *[c for c in df.columns if c != "year"]).write.options(header=True, escape='"', emptyValue="").mode("overwrite").csv(f"{folder}/{name}")


def listing(spark: SparkSession, folder: str, waves: list[int], forms: tuple[str, ...] = ("txt", "pdf")) -> DataFrame:
    """year, path, form, bytes: for each wave the file volume_<year>.<form> that is read for it, the first of the forms
    there is; nulls where there is none. Sizes come from the listing, no file is opened."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "volume_*").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    there = there.withColumn("year", F.regexp_extract("path", r"volume_(\d+)\.\w+$", 1)).where("year <> ''").withColumn("form", F.regexp_extract("path", r"\.(\w+)$", 1))
    rank = F.array_position(F.array(*[F.lit(f) for f in forms]), F.col("form"))
    best = there.where(F.col("form").isin(*forms)).groupBy(F.col("year").cast("int").alias("year")).agg(F.min(F.struct(rank.alias("rank"), "path", "form", F.col("length").alias("bytes"))).alias("f"))
    named = spark.createDataFrame([(w,) for w in waves], "year int")
    return named.join(best, "year", "left").select("year", "f.path", "f.form", "f.bytes")


def read_volumes(spark: SparkSession, folder: str, waves: list[int]) -> DataFrame:
    """year, text of the text files listed for these waves; raises if one has none."""
    found = {r.year: r for r in listing(spark, folder, waves, ("txt",)).collect()}  # a row for each wave asked for
    absent = sorted(y for y, r in found.items() if r.path is None)
    if absent:
        raise FileNotFoundError(f"no text for {', '.join(map(str, absent))} in {folder}")
    text = spark.read.text([r.path for r in found.values()], wholetext=True)
    return text.select(F.regexp_extract(F.input_file_name(), r"volume_(\d+)\.txt$", 1).cast("int").alias("year"), F.col("value").alias("text"))
