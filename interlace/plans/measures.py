"""Queries of rates, frames and distances over the affiliation view, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions import text
from interlace.operators import measures, network, panel, stats
from interlace.streaming import ticks
from interlace.sources.affiliations import BOARD_ROLES, affiliations, firms, persons, seats, table

ENDS, TIERS = (" und ", " que ", " from "), (("first", " the "), ("second", " de "), ("third", " der "))


def _terms(s: SparkSession, d: str) -> DataFrame:
    return affiliations(s, d).select("year", "person", F.col("role").alias("office"), (F.col("status") == "F").alias("former"))


def _flags(s: SparkSession, d: str) -> DataFrame:
    return measures.person_flags(_terms(s, d), list(BOARD_ROLES), [BOARD_ROLES[0]])


def _valued(s: SparkSession, d: str) -> DataFrame:
    return panel.seats_per_person(seats(s, d)).join(persons(s, d), "person")


def tier_panel(s: SparkSession, d: str) -> DataFrame:
    third = affiliations(s, d).where("role = '3-MEDIUM'").select("year", "person", F.concat(F.lit("q"), F.floor((F.col("month") - 1) / 3).cast("string")).alias("tier"))
    return measures.tier_panel(seats(s, d), third)


def entry_value(s: SparkSession, d: str) -> DataFrame:
    ties = seats(s, d)
    return measures.entry_value(panel.risk_set(ties).select("firm", "year", "tenure"), panel.firm_flags(ties, persons(s, d)))


def entry_tiers(s: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    head = measures.entry_head(t, ENDS)
    return table(s, d, "documents").select("doc_id", F.length(head).cast("long").alias("chars"), F.md5(head).alias("head_md5"), measures.first_tier(t, ENDS, " of the ", TIERS).alias("tier"))


def company_names(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    printed = F.concat(F.when(k == 0, "The ").when(k == 1, "Société Anonyme ").when(k == 2, "Compagnie de la ").otherwise(""), F.initcap("p_name"), F.when(k == 0, " Company Ltd.").when(k == 3, " & Co.").otherwise(" d'Egypte"))
    p = table(s, d, "part").select("p_partkey", printed.alias("printed"))
    return p.select("p_partkey", text.company_key(F.col("printed")).alias("company_key"), text.company_letters(F.col("printed")).alias("letters"), text.skeleton(F.col("printed")).alias("skeleton"))


def ols_robust(s: SparkSession, d: str, cluster: str | None = None) -> DataFrame:
    v = _valued(s, d).withColumn("y", F.col("seats") * F.col("person") % 7).withColumn("office", F.col("political").cast("double")).withColumn("one", F.lit(1))
    out = measures.ols(v, "one" if cluster else "year", ["seats", "office"], "y", cluster)
    return out.select(*out.columns[:2], F.round("coefficient", 6).alias("coefficient"), F.round("error", 6).alias("error"))


def _slopes(s: SparkSession, d: str) -> DataFrame:
    v = _valued(s, d).withColumn("x", F.col("seats").cast("double")).withColumn("y", F.log1p(F.col("seats") * F.col("person") % 7))
    return stats.slopes(v, "year", "x", "y")


def windowed_counts(s: SparkSession, d: str) -> DataFrame:
    w = ticks.windowed_counts(table(s, d, "events"))
    return w.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    "windowed_counts": windowed_counts,
    "multi_seat_share": lambda s, d: measures.multi_seat_share(seats(s, d)),
    "person_flags": lambda s, d: _flags(s, d).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high"}),
    "office_terms_by_wave": lambda s, d: measures.office_terms_by_wave(_flags(s, d), list(BOARD_ROLES)).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high"}),
    "connected_by_size": lambda s, d: measures.connected_by_size(seats(s, d), persons(s, d)),
    "financier_rate_by_seats": lambda s, d: measures.financier_rate_by_seats(seats(s, d), firms(s, d), persons(s, d)),
    "sector_share_by_origin": lambda s, d: measures.sector_share_by_origin(seats(s, d), firms(s, d), persons(s, d)),
    "reappearance_rate": lambda s, d: measures.reappearance_rate(seats(s, d), persons(s, d)),
    "demean_in_wave": lambda s, d: measures.demean(panel.seats_per_person(seats(s, d)), "year", "seats", "demeaned"),
    "entry_value": entry_value,
    "tier_panel": tier_panel,
    "largest_board": lambda s, d: measures.largest_board(seats(s, d)),
    "origin_homophily": lambda s, d: measures.origin_homophily(seats(s, d), persons(s, d)),
    "cohen_d_by_wave": lambda s, d: measures.cohen_d(_valued(s, d), "year", "political", "seats"),
    "slope_percent": lambda s, d: measures.percent_change(_slopes(s, d), "slope").select("year", "n", "percent"),
    "network_overview": lambda s, d: measures.network_overview(seats(s, d)),
    "geodesic_bands": lambda s, d: measures.geodesic_bands(seats(s, d)),
    "closure_expected": lambda s, d: measures.closure_expected(seats(s, d)),
    "entry_tiers": entry_tiers,
    "company_names": company_names,
    "ols_hc1_by_wave": lambda s, d: ols_robust(s, d),
    "ols_pooled_clustered": lambda s, d: ols_robust(s, d, "person"),
}

_FINANCE = """, fin AS (
    SELECT year, person, count(DISTINCT firm) AS seats, coalesce(bool_or(sector = 'finance'), false) AS financier
    FROM dense LEFT JOIN sectors USING (firm) GROUP BY ALL)
"""
_PFLAGS = """, pf AS (
    SELECT year, person, bool_or(role = '1-URGENT') AS urgent, bool_or(role = '2-HIGH') AS high, bool_and(status = 'F') AS all_former
    FROM aff WHERE role IN ('1-URGENT', '2-HIGH') GROUP BY ALL)
"""
_REACH = """, e AS (
    SELECT year, person * 2 AS a, firm * 2 + 1 AS b FROM dense UNION ALL SELECT year, firm * 2 + 1, person * 2 FROM dense
), r AS (
    SELECT DISTINCT year, a, a AS l FROM e UNION SELECT r.year, e.b, r.l FROM r JOIN e ON e.year = r.year AND e.a = r.a
), comp AS (SELECT year, a AS node, min(l) AS component FROM r GROUP BY ALL)
"""

#: SQL that follows the affiliation view.
ON_VIEW = {
    "multi_seat_share": "SELECT year, count(*) AS n, round(avg((seats > 1)::INT), 6) AS share FROM held GROUP BY year",
    "person_flags": _PFLAGS + "SELECT *, urgent::BIGINT + high::BIGINT AS n_offices, urgent OR high AS political, urgent AS \"national\" FROM pf",
    "office_terms_by_wave": _PFLAGS + """SELECT year, count(*) AS persons, count(*) FILTER (WHERE urgent) AS urgent, count(*) FILTER (WHERE high) AS high,
        round(avg(all_former::INT), 6) AS all_former FROM pf GROUP BY year""",
    "connected_by_size": """SELECT year, least(n_directors, 4) AS bucket, count(*) AS firms, round(avg(connected::INT), 6) AS connected_share,
        round(avg(n_directors), 6) AS mean_directors FROM fflags GROUP BY ALL""",
    "financier_rate_by_seats": _FINANCE + """SELECT least(seats, 4) AS seat_cat, count(*) FILTER (WHERE financier) AS financiers, count(*) FILTER (WHERE NOT financier) AS others,
        round(avg(political::INT) FILTER (WHERE financier), 6) AS financier_rate, round(avg(political::INT) FILTER (WHERE NOT financier), 6) AS other_rate
        FROM fin JOIN persons USING (person) GROUP BY 1 HAVING count(*) FILTER (WHERE financier) >= 8 AND count(*) FILTER (WHERE NOT financier) >= 8""",
    "sector_share_by_origin": _FINANCE + "SELECT origin, count(*) AS n, round(avg(financier::INT), 6) AS finance_share FROM fin JOIN persons USING (person) GROUP BY origin",
    "reappearance_rate": """SELECT f.year, connected, count(*) AS firms, round(avg((n.firm IS NOT NULL)::INT), 6) AS rate
        FROM fflags f JOIN wave w ON w.year = f.year AND w.next_year IS NOT NULL
        LEFT JOIN (SELECT DISTINCT year, firm FROM dense) n ON n.year = w.next_year AND n.firm = f.firm GROUP BY ALL""",
    "demean_in_wave": "SELECT year, person, seats, round(seats - avg(seats) OVER (PARTITION BY year), 6) AS demeaned FROM held",
    "tier_panel": """, t AS (SELECT year, person, min('q' || CAST((month - 1) // 3 AS VARCHAR)) AS tier FROM aff WHERE role = '3-MEDIUM' GROUP BY ALL)
        SELECT year, person, coalesce(tier, 'none') AS tier, seats FROM held LEFT JOIN t USING (year, person)""",
    "largest_board": "SELECT year, person, max(n_directors) AS largest_board FROM dense JOIN fflags USING (year, firm) GROUP BY ALL",
    "origin_homophily": """, k AS (SELECT d.*, origin FROM dense d JOIN persons USING (person) WHERE origin <> 'unknown'),
        c AS (SELECT year, sum(n * n) / power(sum(n), 2) AS chance FROM (SELECT year, origin, count(*) AS n FROM k GROUP BY ALL) GROUP BY year)
        SELECT a.year, count(*) AS pairs, round(avg((a.origin = b.origin)::INT), 6) AS observed, round(any_value(chance), 6) AS expected
        FROM k a JOIN k b ON a.year = b.year AND a.firm = b.firm AND a.person < b.person JOIN c ON c.year = a.year GROUP BY a.year""",
    "cohen_d_by_wave": """, g AS (SELECT year, count(*) FILTER (WHERE political) AS n1, count(*) FILTER (WHERE NOT political) AS n0,
        avg(seats) FILTER (WHERE political) AS m1, avg(seats) FILTER (WHERE NOT political) AS m0,
        var_samp(seats) FILTER (WHERE political) AS v1, var_samp(seats) FILTER (WHERE NOT political) AS v0 FROM valued GROUP BY year)
        SELECT year, n1, n0, round(m1 - m0, 6) AS difference, round((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0), 6) AS d
        FROM g WHERE n1 > 1 AND n0 > 1""",
    "slope_percent": """SELECT year, count(*) AS n, round((exp(round(regr_slope(ln(1 + seats * person % 7), seats), 6)) - 1) * 100, 6) AS percent FROM valued GROUP BY year""",
    "closure_expected": """, w AS (SELECT year AS before, next_year AS year FROM wave WHERE next_year IS NOT NULL), o AS (SELECT w.year, person, firm FROM dense d JOIN w ON d.year = w.before),
        ps AS (SELECT year, person, count(*) AS prior_seats FROM o GROUP BY ALL), pb AS (SELECT year, firm, count(*) AS prior_board FROM o GROUP BY ALL),
        pm AS (SELECT a.year, a.person, count(DISTINCT b.person) AS prior_mates FROM o a JOIN o b ON a.year = b.year AND a.firm = b.firm AND a.person <> b.person GROUP BY ALL),
        pn AS (SELECT year, count(DISTINCT person) AS n FROM o GROUP BY year)
        SELECT c.year, c.person, c.firm, closure, prior_seats, coalesce(prior_mates, 0) AS prior_mates, prior_board,
            round(coalesce(prior_mates, 0) * prior_board / n, 6) AS expected
        FROM closed c JOIN ps ON ps.year = c.year AND ps.person = c.person JOIN pb ON pb.year = c.year AND pb.firm = c.firm
        LEFT JOIN pm ON pm.year = c.year AND pm.person = c.person JOIN pn ON pn.year = c.year""",
}
_OLS = """, v AS (SELECT {key} AS g, person, 1.0 AS x0, seats::DOUBLE AS x1, political::INT::DOUBLE AS x2, CAST(seats * person % 7 AS DOUBLE) AS y FROM valued),
s AS (SELECT g, count(*)::DOUBLE AS n, sum(x1) AS a, sum(x2) AS b, sum(x1 * x1) AS aa, sum(x1 * x2) AS ab, sum(x2 * x2) AS bb, sum(y) AS y, sum(x1 * y) AS ay, sum(x2 * y) AS by_ FROM v GROUP BY g),
k AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM s),
i AS (SELECT g, n, y, ay, by_, (aa * bb - ab * ab) / det AS i00, (ab * b - a * bb) / det AS i01, (a * ab - aa * b) / det AS i02,
    (n * bb - b * b) / det AS i11, (a * b - n * ab) / det AS i12, (n * aa - a * a) / det AS i22 FROM k),
f AS (SELECT *, i00 * y + i01 * ay + i02 * by_ AS b0, i01 * y + i11 * ay + i12 * by_ AS b1, i02 * y + i12 * ay + i22 * by_ AS b2 FROM i),
e AS (SELECT v.g, {unit} AS u, x0, x1, x2, v.y - b0 - b1 * x1 - b2 * x2 AS e FROM v JOIN f ON v.g = f.g),
q AS (SELECT g, u, sum(x0 * e) AS s0, sum(x1 * e) AS s1, sum(x2 * e) AS s2 FROM e GROUP BY ALL),
m AS (SELECT f.*, q.*, {scale} AS c FROM q JOIN f ON q.g = f.g),
t AS (SELECT g, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, any_value(n) AS n, count(*)::DOUBLE AS gs,
    sum(power(i00 * s0 + i01 * s1 + i02 * s2, 2)) AS v0, sum(power(i01 * s0 + i11 * s1 + i12 * s2, 2)) AS v1, sum(power(i02 * s0 + i12 * s1 + i22 * s2, 2)) AS v2 FROM m GROUP BY g)
SELECT g AS {name}, term, round(coefficient, 6) AS coefficient, round(sqrt(v * {factor}), 6) AS error
FROM (SELECT g, n, gs, 'intercept' AS term, b0 AS coefficient, v0 AS v FROM t UNION ALL SELECT g, n, gs, 'seats', b1, v1 FROM t UNION ALL SELECT g, n, gs, 'office', b2, v2 FROM t)"""
ON_VIEW["ols_hc1_by_wave"] = _OLS.format(key="year", unit="person", scale="1", name="year", factor="n / (n - 3)")
ON_VIEW["ols_pooled_clustered"] = _OLS.format(key="1", unit="person", scale="1", name="one", factor="gs / (gs - 1) * (n - 1) / (n - 3)")

#: Dyads at risk by the distance before; 1 for a tie.
_GRID = _REACH + """, w AS (SELECT year AS before, next_year AS year FROM wave WHERE next_year IS NOT NULL), o AS (SELECT w.year, person, firm FROM dense d JOIN w ON d.year = w.before),
        now AS (SELECT d.* FROM dense d JOIN w ON d.year = w.year), p AS (SELECT year, person FROM now INTERSECT SELECT year, person FROM o), f AS (SELECT year, firm FROM now INTERSECT SELECT year, firm FROM o),
        mates AS (SELECT DISTINCT a.year, a.person, b.person AS mate FROM o a JOIN o b ON a.year = b.year AND a.firm = b.firm AND a.person <> b.person),
        d3 AS (SELECT m.year, m.person, o.firm FROM mates m JOIN o ON o.year = m.year AND o.person = m.mate EXCEPT SELECT * FROM o),
        d5 AS (SELECT m.year, m.person, d3.firm FROM mates m JOIN d3 ON d3.year = m.year AND d3.person = m.mate EXCEPT SELECT * FROM o EXCEPT SELECT * FROM d3),
        c AS (SELECT w.year, node, component FROM comp JOIN w ON comp.year = w.before),
        grid AS (SELECT p.year, p.person, f.firm, CASE WHEN (p.year, p.person, f.firm) IN (SELECT (year, person, firm) FROM o) THEN '1' WHEN (p.year, p.person, f.firm) IN (SELECT (year, person, firm) FROM d3) THEN '3'
            WHEN (p.year, p.person, f.firm) IN (SELECT (year, person, firm) FROM d5) THEN '5' WHEN a.component = b.component THEN '7+' ELSE '-1' END AS band,
            ((p.year, p.person, f.firm) IN (SELECT (year, person, firm) FROM now))::INT AS tie
            FROM p JOIN f USING (year) JOIN c a ON a.year = p.year AND a.node = p.person * 2 JOIN c b ON b.year = p.year AND b.node = f.firm * 2 + 1)"""

#: SQL that follows the affiliation view and walks its graph.
RECURSIVE = {
    "network_overview": _REACH + """, z AS (SELECT year, component, count(*) AS size FROM comp GROUP BY ALL)
        SELECT year, count(*) AS components, sum(size)::BIGINT AS nodes, round(max(size) / sum(size), 6) AS largest_share FROM z GROUP BY year""",
    "geodesic_bands": _GRID + """
        SELECT band, count(*) AS dyads, sum(tie)::BIGINT AS formed, round(1000 * avg(tie), 6) AS rate_per_1000 FROM grid WHERE band <> '1' GROUP BY band""",
    "distance_table": _GRID + """, seats AS (SELECT year, person, count(*) AS n FROM o GROUP BY ALL), board AS (SELECT year, firm, count(*) AS n FROM o GROUP BY ALL),
        closure AS (SELECT m.year, m.person, o.firm, count(*) AS n FROM mates m JOIN o ON o.year = m.year AND o.person = m.mate GROUP BY ALL)
        SELECT band, count(*) AS dyads, sum(tie)::BIGINT AS formed, round(avg(coalesce(k.n, 0)), 6) AS mean_closure, round(avg(s.n), 6) AS prior_seats, round(avg(b.n), 6) AS prior_board, round(1000 * avg(tie), 6) AS rate_per_1000
        FROM grid g JOIN seats s USING (year, person) JOIN board b USING (year, firm) LEFT JOIN closure k USING (year, person, firm) WHERE band <> '1' GROUP BY band""",
}

#: SQL that stands alone.
ALONE = {
    "windowed_counts": "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "entry_tiers": r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '(?s)^(.*?)(?: und | que | from |\z)', 1) AS head FROM documents), x AS (SELECT *, regexp_replace(head, ' of the ', ' ', 'g') AS kept FROM h)
        SELECT doc_id, length(head) AS chars, md5(head) AS head_md5, CASE WHEN regexp_matches(kept, ' the ') THEN 'first' WHEN regexp_matches(kept, ' de ') THEN 'second' WHEN regexp_matches(kept, ' der ') THEN 'third' END AS tier FROM x""",
    "company_names": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN lower(p_name) WHEN p_partkey % 4 = 3 THEN lower(p_name) || ' co' ELSE lower(p_name) || ' egypte' END AS company_key,
        replace(lower(p_name), ' ', '') AS letters, translate(replace(lower(p_name), ' ', ''), 'ltjfeoaumhkqwy', 'iiiicccnnnbgvv') AS skeleton FROM part""",
}
