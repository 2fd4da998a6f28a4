"""Rates, shares and frames on ties (year, person, firm) that combine offices, sectors and origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.operators.lineage import cut
from interlace.operators.network import banded, components, met_dyads, unmarked
from interlace.operators.panel import directors_per_firm, firm_flags, seats_per_person, waves


def share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")), 6)


def multi_seat_share(ties: DataFrame) -> DataFrame:
    """Of a wave's persons, how many hold more than one seat."""
    return seats_per_person(ties).groupBy("year").agg(F.count("*").alias("n"), share(F.col("seats") > 1).alias("share"))


def person_flags(terms: DataFrame, offices: list[str], national: list[str]) -> DataFrame:
    """Of terms(year, person, office, former): a column for each office, their number, political, national, all_former."""
    held = [F.coalesce(F.bool_or(F.col("office") == o), F.lit(False)).alias(o) for o in offices]
    wide = terms.where(F.col("office").isin(offices)).groupBy("year", "person").agg(*held, F.bool_and("former").alias("all_former"))
    any_of = lambda names: F.greatest(*[F.col(f"`{o}`") for o in names], F.lit(False))
    n = sum((F.col(f"`{o}`").cast("long") for o in offices), F.lit(0).cast("long"))
    return wide.withColumn("n_offices", n).withColumn("political", any_of(offices)).withColumn("national", any_of(national))


def office_terms_by_wave(flags: DataFrame, offices: list[str]) -> DataFrame:
    """Persons with each office in a wave, and the share of them whose terms are all over."""
    return flags.groupBy("year").agg(F.count("*").alias("persons"), *[F.count_if(F.col(f"`{o}`")).alias(o) for o in offices], share(F.col("all_former")).alias("all_former"))


def connected_by_size(ties: DataFrame, persons: DataFrame, top: int = 4) -> DataFrame:
    """Share of connected firms and mean board size by number of directors, clipped at ``top``."""
    f = firm_flags(ties, persons).withColumn("bucket", F.least("n_directors", F.lit(top)))
    return f.groupBy("year", "bucket").agg(F.count("*").alias("firms"), share(F.col("connected")).alias("connected_share"), F.round(F.avg("n_directors"), 6).alias("mean_directors"))


def financiers(ties: DataFrame, firms: DataFrame) -> DataFrame:
    """year, person, seats, financier: whether one of the person's firms is in finance."""
    j = ties.join(firms, "firm", "left")
    return j.groupBy("year", "person").agg(F.countDistinct("firm").alias("seats"), F.coalesce(F.bool_or(F.col("sector") == "finance"), F.lit(False)).alias("financier"))


def financier_rate_by_seats(ties: DataFrame, firms: DataFrame, persons: DataFrame, top: int = 4, least: int = 8) -> DataFrame:
    """Political rate of financiers and others by seats, where there are ``least`` of either."""
    f = financiers(ties, firms).join(persons.select("person", "political"), "person").withColumn("seat_cat", F.least("seats", F.lit(top)))
    of = lambda side: F.round(F.avg(F.when(side, F.col("political").cast("double"))), 6)
    g = f.groupBy("seat_cat").agg(F.count_if("financier").alias("financiers"), F.count_if(~F.col("financier")).alias("others"), of(F.col("financier")).alias("financier_rate"), of(~F.col("financier")).alias("other_rate"))
    return g.where((F.col("financiers") >= least) & (F.col("others") >= least))


def sector_share_by_origin(ties: DataFrame, firms: DataFrame, persons: DataFrame) -> DataFrame:
    f = financiers(ties, firms).join(persons.select("person", "origin"), "person")
    return f.groupBy("origin").agg(F.count("*").alias("n"), share(F.col("financier")).alias("finance_share"))


def reappearance_rate(ties: DataFrame, persons: DataFrame) -> DataFrame:
    """Of a wave's connected and other firms, how many are there in the next wave."""
    w = F.broadcast(waves(ties).where("next_year is not null").select("year", "next_year"))  # a row for each wave
    after = ties.select(F.col("year").alias("next_year"), "firm", F.lit(True).alias("there")).distinct()
    f = firm_flags(ties, persons).join(w, "year").join(after, ["next_year", "firm"], "left")
    return f.groupBy("year", "connected").agg(F.count("*").alias("firms"), share(F.coalesce("there", F.lit(False))).alias("rate"))


def demean(df: DataFrame, by: str, value: str, to: str) -> DataFrame:
    """Less the group's mean: means are aggregated first and joined back, so that no task holds a group."""
    mean = df.groupBy(by).agg(F.avg(value).alias("mean_"))
    return df.join(F.broadcast(mean) if by == "year" else mean, by).withColumn(to, F.round(F.col(value) - F.col("mean_"), 6)).drop("mean_")


def entry_value(risk: DataFrame, flags: DataFrame) -> DataFrame:
    """Risk rows with ``connected_at_entry``, the firm's flag in the wave in which its tenure was 1; false where unknown."""
    first = risk.where("tenure = 1").join(flags.select("year", "firm", "connected"), ["year", "firm"], "left")
    first = first.groupBy("firm").agg(F.coalesce(F.max("connected"), F.lit(False)).alias("connected_at_entry"))
    return risk.join(first, "firm", "left").withColumn("connected_at_entry", F.coalesce("connected_at_entry", F.lit(False)))


def tier_panel(ties: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each person-wave with its tier from tiers(year, person, tier), the first by name, and its seats; none where there is none."""
    tier = tiers.groupBy("year", "person").agg(F.min("tier").alias("tier"))
    return seats_per_person(ties).join(tier, ["year", "person"], "left").select("year", "person", F.coalesce("tier", F.lit("none")).alias("tier"), "seats")


def largest_board(ties: DataFrame) -> DataFrame:
    """The size of the largest board on which a person sits."""
    return ties.join(directors_per_firm(ties), ["year", "firm"]).groupBy("year", "person").agg(F.max("directors").alias("largest_board"))


def origin_homophily(ties: DataFrame, persons: DataFrame) -> DataFrame:
    """Pairs of persons of known origin who share a board, counted for each board: how many are of one origin, and
    how many would be if a wave's seats were dealt at random. Counts within boards, never the pairs themselves."""
    known = ties.join(persons.select("person", "origin"), "person").where("origin <> 'unknown'")
    board = known.groupBy("year", "firm", "origin").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    both = board.groupBy("year", "firm").agg(F.sum(pairs(F.col("n"))).alias("same"), F.sum("n").alias("m")).groupBy("year").agg(F.sum(pairs(F.col("m"))).alias("pairs"), F.sum("same").alias("same"))
    seats = board.groupBy("year", "origin").agg(F.sum("n").alias("n"))
    chance = seats.groupBy("year").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("chance"))
    return both.join(chance, "year").where("pairs > 0").select("year", F.col("pairs").cast("long").alias("pairs"), F.round(F.col("same") / F.col("pairs"), 6).alias("observed"), F.round("chance", 6).alias("expected"))


def cohen_d(df: DataFrame, by: str, group: str, value: str) -> DataFrame:
    """Difference of means of two groups and Cohen's d with the pooled sample deviation, null where it is 0 or a side has under two."""
    of = lambda f, side: f(F.when(F.col(group) if side else ~F.col(group), F.col(value)))
    g = df.groupBy(by).agg(F.count_if(group).alias("n1"), F.count_if(~F.col(group)).alias("n0"), of(F.avg, True).alias("m1"), of(F.avg, False).alias("m0"), of(F.var_samp, True).alias("v1"), of(F.var_samp, False).alias("v0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return g.where("n1 > 1 and n0 > 1").select(by, "n1", "n0", F.round(F.col("m1") - F.col("m0"), 6).alias("difference"), F.round(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled), 6).alias("d"))


def percent_change(fits: DataFrame, coefficient: str) -> DataFrame:
    """A coefficient on a log outcome as a change in per cent."""
    return fits.withColumn("percent", F.round(F.expm1(coefficient) * 100, 6))


def network_overview(ties: DataFrame) -> DataFrame:
    """Components of each wave's two-mode graph and the share of its nodes in the largest."""
    c = components(ties).groupBy("year", "component").agg(F.count("*").alias("size"))
    return c.groupBy("year").agg(F.count("*").alias("components"), F.sum("size").alias("nodes"), F.round(F.max("size") / F.sum("size"), 6).alias("largest_share"))


def geodesic_bands(ties: DataFrame) -> DataFrame:
    """Dyads at risk without a tie before, by the distance then of person and firm: 3, 5, 7+ and -1 (unreachable)."""
    return banded(ties).select("band", "dyads", "formed", F.round(1000 * F.col("formed") / F.col("dyads"), 6).alias("rate_per_1000"))


def closure_expected(ties: DataFrame) -> DataFrame:
    """closure() with the wave before: the person's seats and mates, the board's size, and the mates that would sit
    on it by chance, mates times board over the wave's persons."""
    persons, firms, near, old = met_dyads(ties)
    seats = old.groupBy("before", "person").agg(F.count("*").alias("prior_seats"))
    board = old.groupBy("before", "firm").agg(F.count("*").alias("prior_board"))
    pairs = old.join(old.select("before", "firm", F.col("person").alias("mate")), ["before", "firm"]).where("person <> mate").groupBy("before", "person", "mate").agg(F.lit(1).alias("one"))
    mates = pairs.groupBy("before", "person").agg(F.count("*").alias("prior_mates"))
    n = old.groupBy("before").agg(F.countDistinct("person").alias("n"))
    persons = persons.join(seats, ["before", "person"]).join(mates, ["before", "person"], "left").fillna(0, ["prior_mates"]).join(F.broadcast(n), "before").drop("before")
    persons, firms = cut(persons), cut(firms.join(board, ["before", "firm"]).drop("before"))
    known = near.select("year", "person", "firm", "closure").join(persons, ["year", "person"]).join(firms, ["year", "firm"])
    rest = unmarked(persons, firms, near, ("prior_board",)).withColumn("closure", F.lit(0).cast("long"))
    return known.unionByName(rest).select("year", "person", "firm", "closure", "prior_seats", "prior_mates", "prior_board", F.round(F.col("prior_mates") * F.col("prior_board") / F.col("n"), 6).alias("expected"))


def entry_head(text: Column, ends: tuple[str, ...]) -> Column:
    """A text up to the first place where one of the patterns occurs."""
    return F.regexp_extract(text, r"(?s)^(.*?)(?:" + "|".join(ends) + r"|\z)", 1)


def first_tier(text: Column, ends: tuple[str, ...], excluded: str, tiers: tuple[tuple[str, str], ...]) -> Column:
    """The first of the tiers, in order of seniority, that the head of an entry names outside excluded phrases; null without one."""
    head = F.regexp_replace(entry_head(text, ends), excluded, " ")
    return F.coalesce(*[F.when(head.rlike(pattern), label) for label, pattern in tiers])


def ols(df: DataFrame, by: str, xs: list[str], y: str, cluster: str | None = None) -> DataFrame:
    """by, term, coefficient, error: least squares with an intercept, robust (HC1) or clustered errors.

    Only sums of products leave the executors: k(k+1) of them for each group, twice. With clusters,
    scores are summed by cluster before they are multiplied.
    """
    import numpy as np

    names = ["intercept", *xs]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    k = len(x)
    rows = df.select(by, *([cluster] if cluster else []), F.array(*x).alias("x"), F.col(y).cast("double").alias("y")).where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    cross = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(k) for j in range(k)]
    first = rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*cross).alias("xx"), F.array(*[F.sum(F.col("x")[i] * F.col("y")) for i in range(k)]).alias("xy"))
    fits, inverse = [], {}
    for r in first.collect():  # a row for each group, of which the caller states few
        xx = np.array(r["xx"]).reshape(k, k)
        inverse[r[by]] = (np.linalg.pinv(xx), r["n"])
        fits.append((r[by], (inverse[r[by]][0] @ np.array(r["xy"])).tolist()))
    if not fits:
        return df.sparkSession.createDataFrame([], f"{by} {dict(df.dtypes)[by]}, term string, coefficient double, error double")
    beta = F.broadcast(df.sparkSession.createDataFrame(fits, f"{by} {dict(df.dtypes)[by]}, beta array<double>"))
    scored = rows.join(beta, by).withColumn("e", F.col("y") - F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    scores = [(F.col("x")[i] * F.col("e")) for i in range(k)]
    scored = scored.select(by, *([cluster] if cluster else []), *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    if cluster:
        scored = scored.groupBy(by, cluster).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    meat = scored.groupBy(by).agg(F.count("*").alias("g"), F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)]).alias("m"))
    out = []
    for r in meat.collect():
        a, n = inverse[r[by]]
        scale = r["g"] / (r["g"] - 1) * (n - 1) / (n - k) if cluster else n / (n - k)
        error = np.sqrt(np.maximum(np.diag(a @ np.array(r["m"]).reshape(k, k) @ a) * scale, 0))
        out += [(r[by], name, float(b), float(e)) for name, b, e in zip(names, dict(fits)[r[by]], error, strict=True)]
    return df.sparkSession.createDataFrame(out, f"{by} {dict(df.dtypes)[by]}, term string, coefficient double, error double")


def retention_by(dyads: DataFrame, by: str) -> DataFrame:
    """by, held, kept, rate of dyads with a tie before: how many, how many of them still have it, and their share."""
    return dyads.where("memory = 1").groupBy(by).agg(F.count("*").alias("held"), F.sum("tie").cast("long").alias("kept"), share(F.col("tie")).alias("rate"))


def compared(df: DataFrame, measures_: list[str], group: str, by: str = "year", cluster: str = "person") -> DataFrame:
    """measure, coefficient, error, lo, hi: what the group adds to each measure in its own units of spread.

    Measures are standardised within ``by`` (by the spread of the whole, 1 where there is none), then each is
    regressed on the group with errors robust to clusters.
    """
    out = None
    for m in measures_:
        facts = df.where(F.col(m).isNotNull()).groupBy(by).agg(F.avg(m).alias("mean_"), F.coalesce(F.nullif(F.stddev_pop(m), F.lit(0.0)), F.lit(1.0)).alias("sd_"))
        z = df.where(F.col(m).isNotNull()).join(F.broadcast(facts) if by == "year" else facts, by).select(F.lit(1).alias("one"), cluster, F.col(group).cast("double").alias("group_"), ((F.col(m) - F.col("mean_")) / F.col("sd_")).alias("z"))
        one = ols(z, "one", ["group_"], "z", cluster).where("term = 'group_'").select(F.lit(m).alias("measure"), "coefficient", "error")
        out = one if out is None else out.union(one)
    end = lambda sign: F.round(F.col("coefficient") + sign * 1.959963984540054 * F.col("error"), 5)
    return out.select("measure", F.round("coefficient", 5).alias("coefficient"), F.round("error", 5).alias("error"), end(-1).alias("lo"), end(1).alias("hi"))
