"""Rosters end to end: from pages to entries, positions and mentions, and from mentions to the affiliation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interlace.functions import entries, repair
from interlace.operators import linkage
from interlace.operators.lineage import cut, dealt

#: How the section of entries is headed.
HEADING = r"(?iu)les\s+administrateurs\s+des\s+soci[eé]t[eé]s|nomenclature"


def section(counts: DataFrame, key: str, least: int = 3, ahead: int = 8, gap: int = 2) -> DataFrame:
    """key, first_page, last_page of each volume's roster, of counts(key, page, heading, n): a row for each page.

    It begins at the first page with ``least`` entries among the next ``ahead`` ones after a heading, for the
    first heading that has such a page, and goes on while no more than ``gap`` pages have fewer. Volumes
    without one have no row. A volume's pages are numbered in one task; they hold counts, not text.
    """
    order = Window.partitionBy(key).orderBy("page")
    rows = counts.withColumn("at", F.row_number().over(order)).withColumn("good", F.col("n") >= least)
    rows = rows.withColumn("start", F.min(F.when(F.col("good"), F.col("at"))).over(order.rowsBetween(1, ahead)))
    begun = rows.where("heading and start is not null").groupBy(key).agg(F.min_by("start", "at").alias("start"))
    good = rows.where("good").select(key, "page", "at")
    broken = F.coalesce((F.col("at") - F.lag("at").over(order) > gap + 1).cast("int"), F.lit(0))
    runs = good.withColumn("new", broken).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy(key, "run").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max("page").alias("last_page"))
    found = spans.join(begun, key).where("start between low and high")
    first = runs.select(key, F.col("at").alias("start"), F.col("page").alias("first_page"))
    return found.join(first, [key, "start"]).select(key, "first_page", "last_page")


def roster_entries(pages: DataFrame, key: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """key, page, place, printed, honorific, name, body, positions of every entry of pages(key, page, body).

    place counts a page's entries from 0. printed is the entry as read, the rest has its broken words mended,
    and the body also those that resemble a word of the grammar (or of ``vocabulary``, with place and term);
    names are left as printed. A null body has no entries.
    """
    spark = pages.sparkSession
    if vocabulary is None:
        vocabulary = spark.createDataFrame(list(enumerate(repair.STRUCTURAL)), "place int, term string")
    rows = dealt(pages.select(key, "page", "body"), key, "page").select(key, "page", F.posexplode(entries.joined_entries(F.col("body"))).alias("place", "printed"))
    rows = rows.withColumn("parts", entries.entry_parts(entries.mend_words(F.col("printed")))).select(key, "page", "place", "printed", "parts.honorific", "parts.name", "parts.body")
    return dealt(repair.repaired(cut(rows), "body", vocabulary), key, "page", "place").withColumn("positions", entries.positions(F.col("body")))


def roster_mentions(pages: DataFrame, key: str, firms_only: bool = True) -> DataFrame:
    """key, page, place, position, honorific, name, role, organisation of each position in the volumes' rosters.

    Only pages of the section() count, and entries with a name and a position. position counts an entry's
    positions from 0, those in public bodies too, which firms_only leaves out.
    """
    # written before it is filtered by positions, which would be read twice else
    found = cut(roster_entries(pages, key)).where("name <> '' and size(positions) > 0")
    by_page = found.groupBy(key, "page").agg(F.count("*").alias("n"))
    headed = pages.select(key, "page", F.coalesce(F.col("body").rlike(HEADING), F.lit(False)).alias("heading"))
    span = section(headed.join(by_page, [key, "page"], "left").fillna(0, ["n"]), key)
    rows = found.join(span, key).where("page between first_page and last_page")
    rows = rows.select(key, "page", "place", "honorific", "name", F.posexplode("positions").alias("position", "x"))
    rows = rows.where("x.firm") if firms_only else rows
    return rows.select(key, "page", F.col("place").cast("long").alias("place"), F.col("position").cast("long").alias("position"), "honorific", "name", "x.role", "x.organisation")


def affiliation_table(mentions: DataFrame) -> DataFrame:
    """One row for each of mentions(year, page, place, position, printed, organisation, role), with who and where it is.

    mention_id counts mentions from 0 in the order of their places; person_id and company_id number linked persons
    and firms in the order of their first mention, firms by (year, name); labels are the spellings used most
    (of persons by mentions, of firms by waves and spellings), of equals the longest, then the first by alphabet.
    """
    placed = cut(mentions.withColumn("at", F.struct("year", "page", "place", "position")))
    ids = linkage.numbered(placed, "at").select("at", (F.col("number") - 1).alias("mention_id"))
    rows = dealt(placed.join(ids, "at"), "mention_id").withColumn("who", entries.person(F.col("printed")))
    rows = cut(rows.select("mention_id", "year", "page", "role", "organisation", "printed", "who.*"))
    rows = linkage.person_roots(rows, "key", "mention_id").withColumnRenamed("root", "person")
    rows = cut(linkage.company_roots(rows, "organisation").withColumnRenamed("root", "firm"))
    # one row for each spelling first, so no entity's mentions meet in one task
    names = rows.groupBy("person", "display").agg(F.count("*").alias("n"), F.min("mention_id").alias("first"))
    best = lambda name: F.max_by(name, F.struct("n", F.length(name), -F.col("order")))
    ranked = lambda df, by, name: df.withColumn("order", F.row_number().over(Window.partitionBy(by, "n", F.length(name)).orderBy(name)))
    people = ranked(names, "person", "display").groupBy("person").agg(F.min("first").alias("first"), best("display").alias("person_label"))
    people = people.join(linkage.ordinals(people, "first", "P"), "first").select("person", F.col("id").alias("person_id"), "person_label")
    spelt = rows.groupBy("firm", "organisation").agg(F.countDistinct("year").alias("n"), F.min(F.struct("year", "organisation")).alias("first"))
    firms = ranked(spelt, "firm", "organisation").groupBy("firm").agg(F.min("first").alias("first"), best("organisation").alias("company_label"))
    firms = firms.join(linkage.ordinals(firms, "first", "C"), "first").select("firm", F.col("id").alias("company_id"), "company_label")
    out = rows.join(people, "person").join(firms, "firm")
    return out.select("mention_id", "year", "person_id", "person_label", F.col("printed").alias("person_printed"), "rank", F.col("prefix").alias("honorific"), "company_id", "company_label", F.col("organisation").alias("company_printed"), "role", F.col("page").alias("source_page"))


def highest_rank(affiliated: DataFrame) -> DataFrame:
    """person_id, highest_rank, rank_by_year: the highest rank that each person is printed with (of equals the first by
    alphabet), and a map of each wave's; persons without a rank have null and an empty map."""
    level = F.coalesce(*[F.when(F.col("rank") == r, n) for r, n in entries.RANK_ORDER.items()])
    printed = F.col("rank").isNotNull()
    top = F.min_by("rank", F.when(printed, F.struct(-level, "rank")))
    by_year = affiliated.groupBy("person_id", "year").agg(F.max_by("rank", F.when(printed, F.col("mention_id"))).alias("last"), top.alias("rank"))
    years = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("last").isNotNull(), F.struct("year", "last")))))
    return by_year.groupBy("person_id").agg(top.alias("highest_rank"), years.alias("rank_by_year"))
