"""Descriptive, window and survival operators on ties (year, person, firm)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def big(c: Column) -> Column:
    return c.cast("long")


def seats_per_person(ties: DataFrame) -> DataFrame:
    return ties.groupBy("year", "person").agg(F.countDistinct("firm").alias("seats"))


def directors_per_firm(ties: DataFrame) -> DataFrame:
    return ties.groupBy("year", "firm").agg(F.countDistinct("person").alias("directors"))


def quantile_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, quartiles with linear interpolation, maximum."""
    q = lambda p: F.round(F.expr(f"percentile({value}, {p})"), 6)
    return df.groupBy(by).agg(F.count("*").alias("n"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(value).alias("largest"))


def clipped_shares(df: DataFrame, by: str, value: str, top: int = 5) -> DataFrame:
    """Share of each value of ``value``, clipped at ``top``, within ``by``; and of rows above one."""
    c = df.groupBy(by, F.least(F.col(value), F.lit(top)).alias(value)).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def waves(ties: DataFrame) -> DataFrame:
    """year, next_year, wave number: one row for each wave, of which there are few."""
    w = Window.orderBy("year")
    return ties.select("year").distinct().select("year", F.lead("year").over(w).alias("next_year"), big(F.row_number().over(w)).alias("wave"))


def retention(ties: DataFrame, who: str) -> DataFrame:
    """Of those present in a wave, how many are in the next; per year between waves as well."""
    now = ties.select("year", who).distinct().join(F.broadcast(waves(ties).where("next_year is not null")), "year")
    after = ties.select(F.col("year").alias("next_year"), who, F.lit(1).alias("stays")).distinct()
    g = now.join(after, ["next_year", who], "left").groupBy("year", "next_year").agg(F.count("*").alias("n"), F.count("stays").alias("kept"))
    rate = F.col("kept") / F.col("n")
    return g.select("year", "next_year", "n", "kept", F.round(rate, 6).alias("rate"), F.round(F.pow(rate, 1 / (F.col("next_year") - F.col("year"))), 6).alias("yearly_rate"))


def turnover(ties: DataFrame) -> DataFrame:
    """New and returning firms of each wave."""
    d = ties.select("year", "firm").distinct().withColumn("first_year", F.min("year").over(Window.partitionBy("firm")))
    return d.groupBy("year").agg(F.count_if(F.col("year") == F.col("first_year")).alias("new_firms"), F.count_if(F.col("year") > F.col("first_year")).alias("returning_firms"))


def waves_histogram(ties: DataFrame, who: str) -> DataFrame:
    return ties.groupBy(who).agg(F.countDistinct("year").alias("waves")).groupBy("waves").agg(F.count("*").alias("n"))


def top_by_firms(ties: DataFrame, k: int = 22) -> DataFrame:
    """The k persons on most distinct firms over all waves; ties go to the smaller person."""
    return ties.groupBy("person").agg(F.countDistinct("firm").alias("n_firms"), F.countDistinct("year").alias("n_waves")).orderBy(F.desc("n_firms"), "person").limit(k)


def rank_structure(ties: DataFrame, persons: DataFrame) -> DataFrame:
    s = seats_per_person(ties).join(persons, "person", "left").withColumn("rank", F.coalesce(F.expr("nullif(rank, '')"), F.lit("untitled")))
    g = s.groupBy("year", "rank").agg(F.count("*").alias("n"), F.round(F.avg("seats"), 6).alias("mean_seats"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))


def beside(df: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """df with the facts of its keys, null keys included; facts has one row for each."""
    named = facts.withColumnsRenamed({k: f"{k}_of_facts" for k in keys})
    meet = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"{k}_of_facts"]) for k in keys])
    return df.join(named, meet).drop(*[f"{k}_of_facts" for k in keys])


def standardise(df: DataFrame, by: str, value: str, to: str) -> DataFrame:
    """z-scores within a group with the population deviation; a deviation of 0 counts as 1.

    Groups are aggregated and joined back, so a large group is no task of its own.
    """
    facts = df.groupBy(by).agg(F.avg(value).alias("mean_of_group"), F.stddev_pop(value).alias("sd_of_group"))
    sd = F.when(F.col("sd_of_group") == 0, 1.0).otherwise(F.col("sd_of_group"))
    z = F.round((F.col(value) - F.col("mean_of_group")) / sd, 6)
    return beside(df, facts, by).withColumn(to, z).drop("mean_of_group", "sd_of_group")


def below(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, rows_here, rows_below, rows_of_group: a window over distinct values, not over rows."""
    whole = Window.partitionBy(by)
    before = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    n = df.groupBy(by, value).agg(F.count("*").alias("rows_here"))
    return n.select("*", F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("rows_below"), F.sum("rows_here").over(whole).alias("rows_of_group"))


def percent_rank_average(df: DataFrame, by: str, value: str, to: str) -> DataFrame:
    """Average rank of ties, as a percentage of the group."""
    rank = F.col("rows_below") + 1 + (F.col("rows_here") - 1) / 2
    out = beside(df, below(df, by, value), by, value).withColumn(to, F.round(rank / F.col("rows_of_group") * 100, 6))
    return out.drop("rows_here", "rows_below", "rows_of_group")


def wide_flags(long: DataFrame, keys: list[str], name: str, values: list[str]) -> DataFrame:
    """One boolean column for each of a fixed list of values, and how many hold."""
    wide = long.groupBy(*keys).agg(*[F.coalesce(F.bool_or(F.col(name) == v), F.lit(False)).alias(v) for v in values])
    return wide.withColumn("n_flags", big(sum((F.col(v).cast("int") for v in values), F.lit(0))))


def firm_flags(ties: DataFrame, persons: DataFrame) -> DataFrame:
    j = ties.select("year", "firm", "person").distinct().join(persons.select("person", "political"), "person", "left")
    p = F.coalesce("political", F.lit(False))
    g = j.groupBy("year", "firm").agg(F.count("*").alias("n_directors"), F.count_if(p).alias("n_political"))
    return g.select("*", F.round(F.col("n_political") / F.col("n_directors"), 6).alias("share_political"), (F.col("n_political") > 0).alias("connected"))


def rate_sets(ties: DataFrame, persons: DataFrame) -> DataFrame:
    """Political rate by (year, origin) and by origin over all years (year 0)."""
    d = ties.select("year", "person").distinct().join(persons, "person")
    return d.groupingSets([["year", "origin"], ["origin"]], "year", "origin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("political").cast("double")), 6).alias("rate")).withColumn("year", F.coalesce("year", F.lit(0)))


def sector_facts(ties: DataFrame, firms: DataFrame, persons: DataFrame) -> DataFrame:
    f = firm_flags(ties, persons).join(firms, "firm", "left")
    g = f.groupBy("sector").agg(F.count("*").alias("firm_waves"), F.countDistinct("firm").alias("n_firms"), F.round(F.avg("n_directors"), 6).alias("mean_directors"), F.round(F.avg(F.col("connected").cast("double")), 6).alias("share_connected"))
    total = Window.partitionBy(F.lit(1))
    return g.withColumn("share", F.round(F.col("firm_waves") / F.sum("firm_waves").over(total), 6))


def concentration(values: DataFrame, by: str, group: str, x: str) -> DataFrame:
    """Gini coefficient, shares of the group in x and in heads, and share of zeros, per (by, group)."""
    w, all_ = Window.partitionBy(by, group), Window.partitionBy(by)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(x, "person"))
    v = values.select("*", ((2 * r - n - 1) * F.col(x)).alias("term"), F.sum(x).over(all_).alias("all_x"), F.count("*").over(all_).alias("all_n"))
    total = F.sum(x)
    return v.groupBy(by, group).agg(F.count("*").alias("n"), F.round(F.try_divide(F.sum("term"), F.count("*") * total), 6).alias("gini"), F.round(F.try_divide(total, F.first("all_x")), 6).alias("share_of_x"), F.round(F.count("*") / F.first("all_n"), 6).alias("share_of_heads"), F.round(F.avg((F.col(x) == 0).cast("double")), 6).alias("zero_share"))


def lorenz(values: DataFrame, by: str, x: str) -> DataFrame:
    """Running shares of heads and of x, poorest first: rows are numbered among those of the same x only."""
    whole = Window.partitionBy(by)
    before = whole.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    here = F.col(x) * F.col("rows_here")
    facts = below(values, by, x).withColumn("sum_below", F.coalesce(F.sum(here).over(before), F.lit(0))).withColumn("sum_of_group", F.sum(here).over(whole))
    n = F.row_number().over(Window.partitionBy(by, x).orderBy("person"))
    heads = F.round((F.col("rows_below") + n) / F.col("rows_of_group"), 6)
    held = F.round(F.try_divide(F.col("sum_below") + F.col(x) * n, F.col("sum_of_group")), 6)
    return beside(values, facts, by, x).select(by, "person", heads.alias("heads"), held.alias("held"))


def risk_set(ties: DataFrame) -> DataFrame:
    """Firm-waves from a firm's first wave to its first gap: tenure, exit (absent from the next wave), gap in years.

    The last wave has no next one and is left out as censored.
    """
    d = ties.select("year", "firm").distinct().join(F.broadcast(waves(ties)), "year")
    w = Window.partitionBy("firm").orderBy("wave")
    d = d.withColumn("tenure", big(F.row_number().over(w))).withColumn("entry_wave", F.min("wave").over(Window.partitionBy("firm"))).withColumn("next_wave", F.lead("wave").over(w))
    first_spell = d.where("wave = entry_wave + tenure - 1 and next_year is not null")
    return first_spell.select("year", "firm", "tenure", (~F.coalesce(F.col("next_wave") == F.col("wave") + 1, F.lit(False))).cast("long").alias("exit"), (F.col("next_year") - F.col("year")).alias("gap"))


def life_table(risk: DataFrame) -> DataFrame:
    """Hazard and survival by tenure; the running product is taken over the few tenures."""
    g = risk.groupBy("tenure").agg(F.count("*").alias("at_risk"), F.sum("exit").alias("events"))
    g = g.withColumn("hazard", F.col("events") / F.col("at_risk"))
    hs = F.collect_list("hazard").over(Window.partitionBy(F.lit(1)).orderBy("tenure").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("tenure", "at_risk", "events", F.round("hazard", 6).alias("hazard"), F.round(F.aggregate(hs, F.lit(1.0), lambda a, h: a * (1 - h)), 6).alias("survival"))


def persistence(ties: DataFrame, persons: DataFrame) -> DataFrame:
    """Firm-waves with flags, the highest seat count on the board, and whether the firm is in the next wave."""
    top = ties.join(seats_per_person(ties), ["year", "person"]).groupBy("year", "firm").agg(F.max("seats").alias("max_seats"))
    after = ties.select(F.col("year").alias("next_year"), "firm", F.lit(1).alias("again")).distinct()
    base = firm_flags(ties, persons).join(top, ["year", "firm"]).join(F.broadcast(waves(ties).where("next_year is not null")), "year")
    return base.join(after, ["next_year", "firm"], "left").select("year", "firm", "n_directors", "connected", "max_seats", F.least("n_directors", F.lit(5)).alias("directors_cat"), F.coalesce("again", F.lit(0)).cast("long").alias("reappears"))
