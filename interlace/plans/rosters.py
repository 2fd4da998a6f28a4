"""Queries of roster reading, registers and crosswalks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions import rosters
from interlace.operators import registers
from interlace.sources.affiliations import affiliations, table

WORDS = ("widget", "anvil", "bolt", "plate")
ROLES = (("director", r"administrateurs?"), ("auditor", r"censeurs?"))
ENDS = ("capital", "bilan")


def _supplier(s: SparkSession, d: str, *printed: str) -> DataFrame:
    """Suppliers with one of these texts each, in turn."""
    k = F.col("s_suppkey") % len(printed)
    text = F.coalesce(*[F.when(k == i, t) for i, t in enumerate(printed)])
    return table(s, d, "supplier").select("s_suppkey", F.replace(text, F.lit("@"), F.col("s_name")).alias("t"))


def _printed(s: SparkSession, d: str) -> DataFrame:
    """Affiliations with a printed name that several persons share."""
    return affiliations(s, d).withColumn("printed", F.concat(F.lit("P"), (F.col("person") % 50).cast("string")))


def running_heads(s: SparkSession, d: str) -> DataFrame:
    t = _supplier(s, d, "ANNUAIRE DES SOCIÉTÉS ÉGYPTIENNES 12", "L'annuaire de @", "13 SOCI3TÉS EGYPTIENNES PAR ACTI0NS", "@ " * 9 + "annuaire des sociétés par actions")
    return t.select("s_suppkey", rosters.running_head(F.col("t")).alias("head"))


def closed_gaps(s: SparkSession, d: str) -> DataFrame:
    broken = F.regexp_replace("p_name", "(w|p|a)(.)(.)", "$1$2 $3")
    t = F.concat(F.lit("de Ia "), broken, F.lit(" et I'Union Bo lt PLA TE an v il"))
    return table(s, d, "part").select("p_partkey", rosters.close_gaps(t, WORDS).alias("mended"))


def organisations(s: SparkSession, d: str) -> DataFrame:
    t = _supplier(s, d, "de la Banque  @ .", "du Comité @, Le Caire", "d'@", "des Hotels @, Port-Saïd ; ", "l'union @")
    name = rosters.organisation(F.col("t"))
    return t.select("s_suppkey", name.alias("name"), rosters.is_firm(name, F.when(F.col("s_suppkey") % 2 == 0, "member")).alias("firm"))


def cities(s: SparkSession, d: str) -> DataFrame:
    t = _supplier(s, d, "12 rue @, Le  Caire", "Port-Saïd, @", "@ à ALEXANDRIE", "Tanta (@)", "@")
    return t.select("s_suppkey", rosters.city(F.col("t")).alias("city"))


def boards(s: SparkSession, d: str) -> DataFrame:
    t = _supplier(s, d, "Head\nAdministrateurs : MM. @,\n Ali Bey et Omar (sortant)\nCenseur: Zaki\nCapital : 5, 6", "censeurs - @; Amin\nBilan: x", "nobody: @")
    return rosters.board(t, "s_suppkey", "t", ROLES, ENDS)


QUERIES = {
    "running_heads": running_heads,
    "closed_gaps": closed_gaps,
    "organisations": organisations,
    "cities": cities,
    "boards": boards,
    "person_register": lambda s, d: registers.register(affiliations(s, d), "person"),
    "company_register": lambda s, d: registers.register(affiliations(s, d), "firm"),
    "company_last_known": lambda s, d: registers.last_known(affiliations(s, d), "firm", "role", "status"),
    "person_crosswalk": lambda s, d: registers.crosswalk(_printed(s, d), "person", "printed"),
    "offices_named_in_crosswalk": lambda s, d: registers.named(
        _printed(s, d).where("role = '3-MEDIUM'").select("year", "printed", F.col("role").alias("office"), (F.col("status") == "F").alias("former")),
        registers.crosswalk(_printed(s, d), "person", "printed"), "printed"),
    "tiers_named_in_crosswalk": lambda s, d: registers.named(
        _printed(s, d).where("role = '5-LOW'").select("year", "printed", F.when(F.col("month") < 7, "first").otherwise("second").alias("tier")),
        registers.crosswalk(_printed(s, d), "person", "printed"), "printed"),
}

_REGISTER = """SELECT {0}, count(*) AS n_mentions, array_to_string(list_sort(list(DISTINCT year)), ';') AS years_present,
    count(DISTINCT year) AS n_waves FROM aff GROUP BY {0}"""
_CROSSWALK = ", pr AS (SELECT *, 'P' || person % 50 AS printed FROM aff), x AS (SELECT year, printed, min(person) AS person FROM pr GROUP BY ALL)"

#: SQL that follows the affiliation view.
ON_VIEW = {
    "person_register": _REGISTER.format("person"),
    "company_register": _REGISTER.format("firm"),
    "company_last_known": "SELECT firm, year, role, status FROM aff QUALIFY row_number() OVER (PARTITION BY firm ORDER BY year DESC, role DESC, status DESC) = 1",
    "person_crosswalk": _CROSSWALK + " SELECT * FROM x",
    "offices_named_in_crosswalk": _CROSSWALK + " SELECT DISTINCT x.year, x.person, role AS office, status = 'F' AS former FROM pr JOIN x USING (year, printed) WHERE role = '3-MEDIUM'",
    "tiers_named_in_crosswalk": _CROSSWALK + " SELECT DISTINCT x.year, x.person, CASE WHEN month < 7 THEN 'first' ELSE 'second' END AS tier FROM pr JOIN x USING (year, printed) WHERE role = '5-LOW'",
}

#: SQL that stands alone. Texts made from suppliers differ by the remainder of the key, so their readings do.
ALONE = {
    "running_heads": """WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ANNUAIRE DES SOCIÉTÉS ÉGYPTIENNES 12' WHEN 1 THEN 'L''annuaire de ' || s_name
            WHEN 2 THEN '13 SOCI3TÉS EGYPTIENNES PAR ACTI0NS' ELSE repeat(s_name || ' ', 9) || 'annuaire des sociétés par actions' END AS t FROM supplier),
        f AS (SELECT *, regexp_replace(lower(strip_accents(t)), '[^a-z ]', '', 'g') AS f FROM t)
        SELECT s_suppkey, contains(f, 'nuaire')::INT + contains(f, 'socie')::INT + contains(f, 'gyptiennes')::INT + contains(f, 'actio')::INT >= 2 AND length(t) < 90 AS head FROM f""",
    "closed_gaps": r"""WITH t AS (SELECT p_partkey, 'de la ' || regexp_replace(p_name, '(w|p|a)(.)(.)', '\1\2 \3', 'g') || ' et l''Union Bo lt PLA TE an v il' AS t FROM part)
        SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(wi)\s(dget)|(wid)\s(get)|(widg)\s(et)', '\1\2\3\4\5\6', 'g'),
            '(?i)(an)\s(vil)|(anv)\s(il)', '\1\2\3\4', 'g'), '(?i)(bo)\s(lt)', '\1\2', 'g'), '(?i)(pl)\s(ate)|(pla)\s(te)', '\1\2\3\4', 'g') AS mended FROM t""",
    "organisations": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Banque ' || s_name WHEN 1 THEN 'Comité ' || s_name WHEN 2 THEN s_name WHEN 3 THEN 'Hotels ' || s_name ELSE 'union ' || s_name END AS name,
        CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true ELSE s_suppkey % 2 = 1 END AS firm FROM supplier""",
    "cities": "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Cairo' WHEN 1 THEN 'Port Said' WHEN 2 THEN 'Alexandria' WHEN 3 THEN 'Tanta' END AS city FROM supplier",
    "boards": """SELECT s_suppkey, unnest([1, 2, 3, 4]) AS place, unnest(['director', 'director', 'director', 'auditor']) AS role, unnest([s_name, 'Ali Bey', 'Omar', 'Zaki']) AS name FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT s_suppkey, unnest([1, 2]), 'auditor', unnest([s_name, 'Amin']) FROM supplier WHERE s_suppkey % 3 = 1""",
}
