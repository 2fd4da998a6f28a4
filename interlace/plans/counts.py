"""Queries of counted outcomes (the seats that a person has held in all waves) and of spells on boards, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.operators import hazards, inflated, measures, stats
from interlace.operators.lineage import cut
from interlace.sources.affiliations import persons, seats

TERMS = ["one", "office"]


def _held(s: SparkSession, d: str) -> DataFrame:
    """person, one, office, held: every person there is, most with seats and some without."""
    held = seats(s, d).groupBy("person").agg(F.count("*").alias("held"))
    return persons(s, d).join(held, "person", "left").select("person", F.lit(1).alias("one"), F.col("political").cast("int").alias("office"), F.coalesce("held", F.lit(0)).alias("held"))


def fit_diagnostics(s: SparkSession, d: str) -> DataFrame:
    """What three models fit: least squares of the logarithm, quasi-Poisson, and zero-inflated negative binomial."""
    rows = cut(_held(s, d))
    line = {r.term: r.coefficient for r in measures.ols(rows.withColumn("log_held", F.log1p("held")), "one", ["office"], "log_held").collect()}
    rate = dict(zip(TERMS, map(float, stats.glm_fit(rows, TERMS, "held", "person", "poisson")[0]), strict=True))
    fitted = {
        "log_normal": F.expm1(F.lit(line["intercept"]) + F.lit(line["office"]) * F.col("office")),
        "quasi_poisson": F.exp(F.lit(rate["one"]) + F.lit(rate["office"]) * F.col("office")),
        "zero_inflated": inflated.zero_inflated(rows, TERMS, TERMS, "held", "negbin").mean(),
    }
    return inflated.diagnostics(rows, "held", fitted)


def _spells(s: SparkSession, d: str, permanent: bool) -> DataFrame:
    """Persons' spells on boards, with office, seats and the largest board they sit on."""
    ties = cut(seats(s, d))
    boards = ties.groupBy("year", "firm").agg(F.count("*").alias("board"))
    held = ties.join(boards, ["year", "firm"]).groupBy("year", "person").agg(F.count("*").alias("seats"), F.max("board").alias("largest"))
    who = persons(s, d).select("person", F.col("political").cast("int").alias("office"), (F.col("political") & (F.col("rank") == "BUILDING")).cast("int").alias("national"))
    joined = hazards.spells(ties, "person", permanent).join(held, ["year", "person"]).join(who, "person")
    return joined.select("*", F.least("tenure", F.lit(4)).alias("tenure_cat"), F.least("seats", F.lit(5)).alias("seat_cat"), F.log("largest").alias("log_largest"))


def hazard_specifications(s: SparkSession, d: str) -> DataFrame:
    base = ["year", "tenure_cat"]
    specifications = {"baseline": ([], base), "seats": ([], [*base, "seat_cat"]), "anchor": (["log_largest"], [*base, "seat_cat"])}
    return hazards.nested_hazards(_spells(s, d, False), "office", specifications, "person")


def hazard_sensitivity(s: SparkSession, d: str) -> DataFrame:
    """The fullest specification when exit must be for good, when another flag counts, and without the first cohort."""
    spells = cut(_spells(s, d, False))
    first = spells.agg(F.min("entry")).first()[0]
    variants = {
        "first disappearance": (spells, "office"),
        "permanent exit": (_spells(s, d, True), "office"),
        "national office only": (spells, "national"),
        "without the first cohort": (spells.where(F.col("entry") != first), "office"),
    }
    return hazards.sensitivity(variants, ["log_largest"], ["year", "tenure_cat", "seat_cat"], "person")


QUERIES = {
    "spells": lambda s, d: _spells(s, d, False).select("year", "person", "tenure", "entry", "exit", "gap", "seats", "largest"),
    "spells_permanent": lambda s, d: _spells(s, d, True).select("year", "person", "tenure", "entry", "exit", "gap", "seats", "largest"),
    "hazard_specifications": hazard_specifications,
    "hazard_sensitivity": hazard_sensitivity,
    "quasi_poisson": lambda s, d: inflated.quasi_poisson(_held(s, d), TERMS, "held", "person"),
    "zero_inflated_fits": lambda s, d: inflated.inflated_table(_held(s, d), TERMS, TERMS, "held"),
    "zero_inflated_score_equations": lambda s, d: inflated.fitted_zeros(_held(s, d), TERMS, "held"),
    "fit_diagnostics": fit_diagnostics,
}

_HELD = """, h AS (
    SELECT person, 1 AS one, political::INT AS office, coalesce(n, 0) AS held
    FROM persons LEFT JOIN (SELECT person, count(*) AS n FROM dense GROUP BY ALL) USING (person)
)"""
_SPELLS = """, b AS (SELECT year, firm, count(*) AS board FROM dense GROUP BY ALL),
s AS (SELECT year, person, count(*) AS seats, max(board) AS largest FROM dense JOIN b USING (year, firm) GROUP BY ALL),
w AS (
    SELECT s.*, wave.wave, wave.next_year, row_number() OVER p AS tenure, min(s.year) OVER (PARTITION BY person) AS entry, min(wave.wave) OVER (PARTITION BY person) AS first, lead(wave.wave) OVER p AS next
    FROM s JOIN wave USING (year) WINDOW p AS (PARTITION BY person ORDER BY wave.wave)
)
SELECT year, person, tenure, entry, {exit}::BIGINT AS exit, next_year - year AS gap, seats, largest FROM w JOIN persons USING (person) WHERE next_year IS NOT NULL AND {kept}"""
#: SQL that follows the affiliation view. Two groups are told apart by one term, so fits are their means.
ON_VIEW = {
    "spells": _SPELLS.format(exit="(coalesce(next, 0) <> wave + 1)", kept="wave = first + tenure - 1"),
    "spells_permanent": _SPELLS.format(exit="(next IS NULL)", kept="true"),
    "quasi_poisson": _HELD + """, g AS (
    SELECT office, avg(held) AS m, count(*) AS n FROM h GROUP BY office
), v AS (
    SELECT office, any_value(m) AS m, sum(power(held - m, 2)) / power(any_value(n * m), 2) AS v FROM h JOIN g USING (office) GROUP BY office
), w AS (
    SELECT max(m) FILTER (office = 0) AS m0, max(m) FILTER (office = 1) AS m1, max(v) FILTER (office = 0) AS v0, max(v) FILTER (office = 1) AS v1 FROM v
), s AS (
    SELECT sum(power(held - m, 2) / m) / (count(*) - 2) AS dispersion, count(*) / (count(*) - 1) AS few FROM h JOIN g USING (office)
)
SELECT 'one' AS term, round(ln(m0), 5) AS estimate, round(sqrt(v0 * few), 5) AS error, round(m0, 5) AS ratio, round(dispersion, 5) AS dispersion FROM w, s
UNION ALL SELECT 'office', round(ln(m1 / m0), 5), round(sqrt((v0 + v1) * few), 5), round(m1 / m0, 5), round(dispersion, 5) FROM w, s""",
    "zero_inflated_score_equations": _HELD + " UNION ALL ".join(
        f"""
SELECT '{t}' AS term, round(sum({t} * held)::DOUBLE, 3) AS total, round(sum({t} * held)::DOUBLE, 3) AS fitted_total,
    round(sum({t} * (held = 0)::INT)::DOUBLE, 3) AS zeros, round(sum({t} * (held = 0)::INT)::DOUBLE, 3) AS fitted_zeros FROM h"""
        for t in TERMS
    ),
    "fit_diagnostics": _HELD + """, g AS (
    SELECT office, avg(held) AS m, exp(avg(ln(1 + held))) - 1 AS l FROM h GROUP BY office
), f AS (
    SELECT held, unnest(['log_normal', 'quasi_poisson', 'zero_inflated']) AS model, unnest([l, m, m]) AS f FROM h JOIN g USING (office)
)
SELECT model, CAST(floor(log10(f) * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(held), 4) AS observed, round(avg(f), 4) AS fitted,
    round(avg(held - f), 4) + 0.0 AS residual, round(stddev_pop(held - f), 4) AS spread, round(avg((held > 0)::INT), 6) AS positive
FROM f GROUP BY ALL""",
}
