"""Company sections of a volume: blocks under a header, and each as one record with its board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlace.functions import registers, rosters
from interlace.functions.entries import let, squeeze
from interlace.functions.text import company_key, fold, is_header

# How field labels and running words begin that are no header; the heading of a board; and labelled fields.
NO_HEADER = r"(?i)^(?:conseil|siege|capital|objet|bilan|actif|passif|exercice|annuaire|sommaire|table|index|societes?\s+egyptiennes|page|tome|chapitre|l\.?e\.?|total)\b"
BOARD_HEADING = r"(?im)^\s*conseil\s+d[' ]?administration\s*[:.—-]?\s*$"
FIELDS = {
    "seat": r"(?i)si[eè]ge\s+social\s*[:.—-]\s*(.+)",
    "founded": r"(?im)constitu[eé]e?\s+le\s+(.+?)(?:[.;]|\s+[-—]|$)",
    "duration": r"(?im)dur[eé]e\s*[:.—-]\s*(.+?)(?:[.;]|$)",
    "purpose": r"(?im)objet\s*[:.—-]\s*([^\n]+?)(?:\s*$)",
    "capital": r"(?im)capital(?:\s+social)?\s*[:.—-]\s*([^\n]+?)(?:\s+divis|\s*$)",
}
BOARD_ENDS = ("capital", "bilan", r"si[eè]ge", "objet", "exercice", "actif", "passif")
#: Labels of a board's lists and the role for which each stands; the first that fits counts.
BOARD_ROLES = (
    ("vice_president", r"vice[- ]?presidents?"), ("president", r"presidents?"), ("managing_director", r"administrateurs?[- ]delegues?"), ("director", r"administrateurs?"),
    ("manager", r"directeurs?"), ("secretary", r"secretaires?"), ("auditor", r"commissaires?(?:\s+aux\s+comptes)?"), ("auditor", r"censeurs?"), ("liquidator", r"liquidateurs?"),
)


def opens_block(line: Column) -> Column:
    """A header that is no field label."""
    plain = F.trim(line)
    return is_header(plain) & ~fold(plain).rlike(NO_HEADER)


def blocks(pages: DataFrame, key: str) -> DataFrame:
    """key, block, page, header, body: a volume's pages(key, page, body) cut at header lines, however many pages a block
    spans; page is the header's. What precedes the first header is left out.

    A page's lines are parted within its row; only the number of each page's headers passes through a window.
    """

    def cut(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when(opens_block(x), i)), lambda i: i.isNotNull())
        part = lambda h, after: F.array_join(F.slice(lines, h + 2, after - h - 1), "\n")
        first = F.struct(F.lit(None).cast("string").alias("header"), F.array_join(F.slice(lines, F.lit(1), F.coalesce(F.get(heads, F.lit(0)), F.size(lines))), "\n").alias("body"))
        rest = F.transform(heads, lambda h, i: F.struct(F.get(lines, h).alias("header"), part(h, F.coalesce(F.get(heads, i + 1), F.size(lines))).alias("body")))
        return F.concat(F.array(first), rest)

    parts = pages.where("body is not null").select(key, "page", let(F.split("body", "\n"), cut).alias("parts")).withColumn("n", F.size("parts") - 1)
    before = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(key, "page", "n").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = parts.join(starts, [key, "page"]).select(key, "page", "base", F.posexplode("parts").alias("at", "x"))
    rows = rows.select(key, (F.col("base") + F.col("at")).alias("block"), "page", "at", "x.header", "x.body").where("block > 0")
    # parts without a line of their own leave no gap
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("body") != "", F.struct("page", "at", "body")))), lambda x: x["body"]), "\n")
    out = rows.groupBy(key, "block").agg(F.min(F.when(F.col("header").isNotNull(), F.col("page"))).alias("page"), F.max("header").alias("header"), whole.alias("body"))
    return out.withColumn("header", squeeze(F.col("header"), r".:\-"))


def company_records(pages: DataFrame, key: str, roles: tuple[tuple[str, str], ...] = BOARD_ROLES) -> DataFrame:
    """key, block, page, name, name_key, seat, city, founded, duration, purpose, currency, amount, board of each company.

    Only blocks with a board's heading or a role label are companies. board is an array of (place, role, display, rank)
    in printed order; a block whose lists name nobody has an empty one. Fields that aren't printed are null.
    """
    label = r"(?im)^\s*(?:" + "|".join(p for _, p in roles) + r")\s*[:.—-]\s*"
    found = blocks(pages, key).where(fold(F.col("body")).rlike(BOARD_HEADING) | fold(F.col("body")).rlike(label)).withColumn("block_key", F.struct(key, "block"))
    flat = F.regexp_replace("body", r"\n(?=\p{Ll})", " ")
    field = lambda name: F.nullif(squeeze(F.regexp_extract(flat, FIELDS[name], 1), ".;"), F.lit(""))
    rows = found.select("block_key", key, "block", "page", F.col("header").alias("name"), company_key(F.col("header")).alias("name_key"), *[field(name).alias(name) for name in FIELDS])
    rows = rows.withColumn("city", rosters.city(F.col("seat"))).withColumn("money", registers.money(F.col("capital")))
    boards = rosters.board(found.select("block_key", fold(F.col("body")).alias("plain")), "block_key", "plain", roles, BOARD_ENDS)
    who = boards.select("block_key", F.struct("place", "role", registers.person_name(F.col("name")).alias("who")).alias("x"))
    members = who.groupBy("block_key").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["place"].alias("place"), x["role"].alias("role"), x["who"]["display"].alias("display"), x["who"]["rank"].alias("rank"))).alias("board"))
    none = F.expr("cast(array() as array<struct<place:bigint,role:string,display:string,rank:string>>)")
    return rows.join(members, "block_key", "left").select(key, "block", "page", "name", "name_key", "seat", "city", "founded", "duration", "purpose", "money.currency", "money.amount", F.coalesce("board", none).alias("board"))
