"""Reading printed registers: pages, rosters, labelled fields, name lists and roles, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks after a name, by their forms.
RANKS = {"pacha": "pasha", "pasha": "pasha", "bacha": "pasha", "bey": "bey", "beik": "bey", "bek": "bey", "effendi": "effendi", "effendy": "effendi", "agha": "agha"}


def pages(volumes: DataFrame, key: str, text: str, mark: str = r"<<<PAGE (\d+)>>>") -> DataFrame:
    """key, page, body: a volume cut at its page marks. What precedes the first mark has no page and is left out."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(mark), F.lit(1))
    bodies = F.slice(F.split(F.col(text), mark), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    both = volumes.select(key, F.explode(F.arrays_zip(numbers.alias("page"), bodies.alias("body"))).alias("x"))
    return both.select(key, F.col("x.page").cast("long").alias("page"), F.trim("x.body").alias("body"))


def page_of(offsets: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """offsets(key, at) with the page of the last of marks(key, at, page) at or before each; null before the first.

    One shuffle on the key and one ordered pass; a mark precedes an offset at its own place.
    """
    both = offsets.select(key, "at", F.lit(None).cast("long").alias("page"), F.lit(1).alias("kind")).union(marks.select(key, "at", F.col("page").cast("long"), F.lit(0).alias("kind")))
    w = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(key, "at", "kind", F.last("page", ignorenulls=True).over(w).alias("page")).where("kind = 1").drop("kind")


def field(text: Column, label: str) -> Column:
    """What follows ``label :`` up to the line's end; null where it doesn't occur."""
    found = F.trim(F.regexp_extract(text, rf"(?im)^\s*{label}\s*:\s*([^\n]*)$", 1))
    return F.when(found != "", found)


# How currencies are printed, without points and blanks, and their codes.
CURRENCIES = {"LE": "LE", "£E": "LE", "E": "LE", "£": "GBP", "FR": "FRF", "FRS": "FRF", "FRANC": "FRF", "FRANCS": "FRF", "$": "USD", "PT": "PT"}


def money(text: Column) -> Column:
    """struct(currency, amount): an amount after its currency; blanks, points, commas and apostrophes part thousands."""
    amount = r"(?i)(L\.?\s*E\.?|£\s*E\.?|£|P\.?\s*T\.?|francs?|frs?\.?|\$)\s*(\d[\d .,']*)"
    printed = F.upper(F.regexp_replace(F.regexp_extract(text, amount, 1), "[. ]", ""))
    digits = F.regexp_replace(F.regexp_extract(text, amount, 2), "[ .,']", "")
    code = F.coalesce(*[F.when(printed == name, value) for name, value in CURRENCIES.items()])
    return F.struct(code.alias("currency"), digits.try_cast("double").alias("amount"))


def name_list(text: Column) -> Column:
    """Names of a printed list: asides in brackets go; commas, semicolons and the word ``et`` part names."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"\bMM?\.\s*", "")
    parts = F.transform(F.split(F.regexp_replace(plain, r"\s+et\s+", ","), "[;,]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (F.length(x) >= 3) & x.rlike(r"\p{L}"))


def person_name(printed: Column, ranks: dict[str, str] = RANKS) -> Column:
    """struct(display, rank): trailing rank words, in any form, are popped; the last one popped is the rank."""
    tail = "|".join(ranks)
    display = F.trim(F.regexp_replace(printed, rf"(?i)(\s+({tail})\.?)+\s*$", ""))
    rank = F.lower(F.regexp_extract(F.substring(printed, F.length(display) + 1, F.length(printed)), rf"(?i)\b({tail})\b", 1))
    return F.struct(display.alias("display"), F.create_map(*[F.lit(v) for form in ranks.items() for v in form])[F.nullif(rank, F.lit(""))].alias("rank"))


def clauses(entries: DataFrame, key: str, text: str, roles: tuple[tuple[str, str], ...]) -> DataFrame:
    """key, clause, role, organisation: clauses of an entry, the role carried on to bare ones.

    roles are (label, pattern), the first that begins a clause counts. A clause without a role that begins
    with a preposition has that of the clause before; any other clause without a role is left out.
    """
    rows = entries.select(key, F.posexplode(F.split(F.col(text), "[;:]")).alias("clause", "part")).withColumn("part", F.trim("part"))
    found = F.coalesce(*[F.when(F.col("part").rlike(rf"(?i)^({p})\b"), label) for label, p in roles])
    cut = F.regexp_replace("part", r"(?i)^(" + "|".join(p for _, p in roles) + r")\b\s*", "")
    bare = F.col("part").rlike(r"(?i)^(de la|du|des|de|of|and|et)\b")
    w = Window.partitionBy(key).orderBy("clause").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", found).withColumn("role", F.last("own", ignorenulls=True).over(w)).where(F.col("own").isNotNull() | (bare & F.col("role").isNotNull()))
    place = F.trim(F.regexp_replace(F.when(F.col("own").isNotNull(), cut).otherwise(F.col("part")), r"(?i)^(de la|du|des|de|of|and|et|the)\b\s*", ""))
    return rows.select(key, F.col("clause").cast("long").alias("clause"), "role", place.alias("organisation"))


def entries(lines: DataFrame, key: str, order: str, text: str, start: str) -> DataFrame:
    """key, entry, text, n_lines: lines joined into entries; one that matches ``start`` opens the next.

    Lines before the first start belong to none.
    """
    running = Window.partitionBy(key).orderBy(order)
    rows = lines.withColumn("entry", F.sum(F.coalesce(F.col(text).rlike(start).cast("long"), F.lit(0))).over(running)).where("entry > 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: F.trim(x[text])), " ")
    return rows.groupBy(key, "entry").agg(joined.alias("text"), F.count("*").alias("n_lines"))


def spans(counts: DataFrame, key: str, page: str, n: str, least: int = 3, gap: int = 3) -> DataFrame:
    """key, span, first_page, last_page, pages, entries: runs of pages with entries, no further than ``gap`` apart.

    A run counts from its first page with at least ``least`` entries.
    """
    w = Window.partitionBy(key).orderBy(page)
    new = (F.col(page) - F.lag(page).over(w) > gap).cast("long")
    runs = counts.where(F.col(n) > 0).withColumn("span", F.sum(F.coalesce(new, F.lit(0))).over(w))
    opened = F.max((F.col(n) >= least).cast("int")).over(Window.partitionBy(key, "span").orderBy(page))
    runs = runs.withColumn("opened", opened).where("opened = 1")
    return runs.groupBy(key, "span").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("pages"), F.sum(n).alias("entries"))


def is_person(label: Column, anywhere: str, suffix: str, articles: str, heads: str) -> Column:
    """Not an institution: four letters at least, no word of ``anywhere``, no ``suffix`` at the end, and,
    without up to three leading articles, no beginning in ``heads``."""
    letters = F.length(F.regexp_replace(label, r"[^\p{L}]", ""))
    head = F.regexp_replace(F.trim(label), rf"(?i)^(?:(?:{articles})\s+){{1,3}}", "")
    return (letters >= 4) & ~label.rlike(rf"(?i){anywhere}") & ~label.rlike(rf"(?i)(?:{suffix})\.?\s*$") & ~head.rlike(rf"(?i)^(?:{heads})")


def offices(df: DataFrame, key: str, text: str, rules: tuple[tuple[str, str], ...], excluded: str, past: str) -> DataFrame:
    """key, office, former of each office named; former where every mention follows ``past`` at once.

    The patterns hold no capturing groups and match no empty text; what begins inside a match of ``excluded`` doesn't count.
    Texts in which nothing looks like the office are passed over, and one whose first match is a mention without ``past``
    isn't read further.
    """
    cols = []
    for office, pattern in rules:
        t, as_ = F.col(text), lambda former: F.struct(F.lit(office).alias("office"), F.lit(former).alias("former"))  # noqa: B023
        some = lambda rule: F.exists(F.regexp_extract_all(t, F.lit(rule), F.lit(1)), lambda m: m != "")  # noqa: E731, B023
        bare, former = rf"(?:{excluded})|(?:{past})(?:{pattern})|({pattern})", rf"(?:{excluded})|((?:{past})(?:{pattern}))"
        rest = F.when(F.regexp_extract(t, bare, 1) != "", as_(False)).when(some(bare), as_(False)).when(some(former), as_(True))
        cols.append(F.when(t.rlike(pattern), rest))
    # nulls go after the array is taken apart: a filter on the array would read the texts again
    found = df.select(key, F.explode(F.array(*cols)).alias("x")).where("x is not null")
    return found.select(key, "x.office", "x.former")
