"""Queries over the affiliation view of the order tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions import text
from interlace.operators import network, panel, stats
from interlace.plans import chain, counts, inference, measures, registers, rosters
from interlace.sources.affiliations import BOARD_ROLES, affiliations, firms, persons, seats, sparse_seats, table

SECTORS = (("finance", "ring|bolt"), ("land", "widget|plate"), ("agriculture", "red|green"))


def _seats_value(s: SparkSession, d: str) -> DataFrame:
    return panel.seats_per_person(seats(s, d)).join(persons(s, d), "person")


def _political_panel(s: SparkSession, d: str) -> DataFrame:
    j = _seats_value(s, d)
    return j.withColumn("seat_cat", F.least("seats", F.lit(4))).withColumn("y", (F.col("seats") * F.col("person") % 7).cast("double"))


def _risk_panel(s: SparkSession, d: str) -> DataFrame:
    r = panel.risk_set(seats(s, d)).join(panel.firm_flags(seats(s, d), persons(s, d)), ["year", "firm"])
    return r.select("firm", F.lit(1.0).alias("one"), F.col("tenure").cast("double").alias("tenure"), F.col("n_directors").cast("double").alias("n_directors"), F.col("exit").cast("double").alias("exit"), F.log(F.col("gap").cast("double")).alias("log_gap"))


QUERIES = {
    "seats_per_person": lambda s, d: panel.seats_per_person(seats(s, d)),
    "directors_per_firm_quantiles": lambda s, d: panel.quantile_summary(panel.directors_per_firm(seats(s, d)), "year", "directors"),
    "seat_distribution_pct": lambda s, d: panel.clipped_shares(panel.seats_per_person(seats(s, d)), "year", "seats"),
    "retention": lambda s, d: panel.retention(seats(s, d), "person"),
    "firm_turnover": lambda s, d: panel.turnover(seats(s, d)),
    "waves_histogram": lambda s, d: panel.waves_histogram(sparse_seats(s, d), "firm"),
    "top_directors": lambda s, d: panel.top_by_firms(seats(s, d)),
    "rank_structure": lambda s, d: panel.rank_structure(seats(s, d), persons(s, d)),
    "zscore_in_wave": lambda s, d: panel.standardise(panel.seats_per_person(seats(s, d)), "year", "seats", "z"),
    "pct_rank_in_wave": lambda s, d: panel.percent_rank_average(panel.seats_per_person(seats(s, d)), "year", "seats", "pct"),
    "office_flags": lambda s, d: panel.wide_flags(affiliations(s, d), ["year", "person"], "role", list(BOARD_ROLES)),
    "firm_flags": lambda s, d: panel.firm_flags(seats(s, d), persons(s, d)),
    "rate_grouping_sets": lambda s, d: panel.rate_sets(seats(s, d), persons(s, d)),
    "sector_facts": lambda s, d: panel.sector_facts(seats(s, d), firms(s, d), persons(s, d)),
    "gini": lambda s, d: panel.concentration(_seats_value(s, d), "year", "origin", "seats"),
    "lorenz": lambda s, d: panel.lorenz(_seats_value(s, d), "year", "seats"),
    "risk_set": lambda s, d: panel.risk_set(sparse_seats(s, d)),
    "life_table": lambda s, d: panel.life_table(panel.risk_set(sparse_seats(s, d))),
    "persistence_panel": lambda s, d: panel.persistence(seats(s, d), persons(s, d)),
    "firm_projection": lambda s, d: network.projection(seats(s, d), "firm", "person"),
    "person_projection": lambda s, d: network.projection(seats(s, d), "person", "firm"),
    "degree": lambda s, d: network.board_degrees(seats(s, d), "person", "firm"),
    "square_clustering": lambda s, d: network.square_clustering(sparse_seats(s, d), "person", "firm"),
    "burt_and_effective_size": lambda s, d: network.burt(sparse_seats(s, d), "person", "firm"),
    "open_share": lambda s, d: network.open_pairs(sparse_seats(s, d), "person", "firm"),
    "network_summary": lambda s, d: network.summary(seats(s, d)),
    "pooled_edges": lambda s, d: network.pooled(seats(s, d), list(range(1995, 2002))),
    "link_components": lambda s, d: network.components(sparse_seats(s, d)),
    "path_centralities": lambda s, d: network.centralities(seats(s, d)),
    "transition_table": lambda s, d: network.transitions(seats(s, d)),
    "change_statistics": lambda s, d: network.change_statistics(seats(s, d), persons(s, d)),
    "closure_design": lambda s, d: network.closure(seats(s, d)),
    "distance_table": lambda s, d: network.distance_bands(seats(s, d)),
    "brokerage_outcomes": lambda s, d: network.brokerage_outcomes(seats(s, d)),
    "stratified_gap_observed": lambda s, d: stats.stratified_gap(_political_panel(s, d), ["year", "seat_cat"], "political", "y"),
    "permutation_null": lambda s, d: stats.permutation_null(_political_panel(s, d), ["year", "seat_cat"], "political", "y"),
    "ols_by_wave": lambda s, d: stats.slopes(_political_panel(s, d).withColumn("x", F.col("seats").cast("double")), "year", "x", "y"),
    "exit_hazard_cloglog": lambda s, d: stats.glm(_risk_panel(s, d), ["one", "tenure", "n_directors"], "exit", "firm", "cloglog", "log_gap"),
    "name_key": lambda s, d: table(s, d, "part").select("p_name").distinct().select("p_name", text.name_key(F.col("p_name")).alias("name_key"), text.skeleton(F.col("p_name")).alias("skeleton")),
    "sector_rules": lambda s, d: table(s, d, "part").select("p_partkey", text.first_rule(F.col("p_name"), SECTORS, "other").alias("sector")),
    "segment_blocks": lambda s, d: text.blocks(table(s, d, "documents")),
    "scan_distances": lambda s, d: _name_pairs(s, d),
}

#: The measures that the queries of these names take on a thinned graph, on the whole one.
QUERIES |= {
    "waves_histogram_whole": lambda s, d: panel.waves_histogram(seats(s, d), "firm"),
    "risk_set_whole": lambda s, d: panel.risk_set(seats(s, d)),
    "life_table_whole": lambda s, d: panel.life_table(panel.risk_set(seats(s, d))),
    "square_clustering_whole": lambda s, d: network.square_clustering(seats(s, d), "person", "firm"),
    "burt_and_effective_size_whole": lambda s, d: network.burt(seats(s, d), "person", "firm"),
    "open_share_whole": lambda s, d: network.open_pairs(seats(s, d), "person", "firm"),
    "link_components_whole": lambda s, d: network.components(seats(s, d)),
}


def _name_pairs(s: SparkSession, d: str) -> DataFrame:
    """Names that share their last token's key, blocked on it, with their distance."""
    n = table(s, d, "part").select("p_name").distinct().withColumn("block", F.substring_index(text.name_key(F.col("p_name")), " ", -1))
    j = n.alias("a").join(n.alias("b"), "block").where("a.p_name < b.p_name")
    return j.select(F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b"), F.round(text.scan_distance("a.p_name", "b.p_name"), 6).alias("distance"))


AFF = """
WITH aff AS (
    SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(o_custkey AS BIGINT) AS person, CAST(l_suppkey AS BIGINT) AS firm,
        o_orderpriority AS role, o_orderstatus AS status, month(o_orderdate) AS month
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
), dense AS (SELECT DISTINCT year, person, firm FROM aff WHERE role IN ('1-URGENT', '2-HIGH')),
sparse AS (SELECT DISTINCT year, person, firm FROM aff WHERE role = '1-URGENT' AND status = 'F' AND month = 3),
persons AS (
    SELECT CAST(c_custkey AS BIGINT) AS person, c_mktsegment AS rank_, CASE WHEN r_name = 'AFRICA' THEN 'unknown' ELSE r_name END AS origin, c_acctbal > 5000 AS political
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), sectors AS (
    SELECT CAST(s_suppkey AS BIGINT) AS firm, CASE WHEN s_nationkey < 8 THEN 'finance' WHEN s_nationkey < 14 THEN 'land' WHEN s_nationkey < 18 THEN 'agriculture' ELSE 'other' END AS sector FROM supplier
), wave AS (SELECT year, lead(year) OVER (ORDER BY year) AS next_year, row_number() OVER (ORDER BY year) AS wave FROM (SELECT DISTINCT year FROM dense)),
swave AS (SELECT year, lead(year) OVER (ORDER BY year) AS next_year, row_number() OVER (ORDER BY year) AS wave FROM (SELECT DISTINCT year FROM sparse)),
held AS (SELECT year, person, count(DISTINCT firm) AS seats FROM dense GROUP BY ALL),
valued AS (SELECT h.*, p.origin, p.political, p.rank_ FROM held h JOIN persons p USING (person)),
cased AS (SELECT *, least(seats, 4) AS seat_cat, CAST(seats * person % 7 AS DOUBLE) AS y FROM valued),
flags AS (
    SELECT year, firm, count(*) AS n_directors, count(*) FILTER (WHERE coalesce(political, false)) AS n_political
    FROM dense LEFT JOIN persons USING (person) GROUP BY ALL
), fflags AS (SELECT *, round(n_political / n_directors, 6) AS share_political, n_political > 0 AS connected FROM flags),
proj AS (
    SELECT x.year, x.person AS a, y.person AS b, count(*) AS weight, string_agg(CAST(x.firm AS VARCHAR), ';' ORDER BY x.firm) AS via
    FROM dense x JOIN dense y ON x.year = y.year AND x.firm = y.firm AND x.person < y.person GROUP BY ALL
), sproj AS (
    SELECT x.year, x.person AS a, y.person AS b, count(*) AS weight
    FROM sparse x JOIN sparse y ON x.year = y.year AND x.firm = y.firm AND x.person < y.person GROUP BY ALL
), sboth AS (SELECT year, a, b, weight FROM sproj UNION ALL SELECT year, b, a, weight FROM sproj),
st AS (SELECT year, a, b, weight / sum(weight) OVER (PARTITION BY year, a) AS p, weight / max(weight) OVER (PARTITION BY year, a) AS m FROM sboth),
spell AS (
    SELECT s.year, s.firm, w.next_year, w.wave, row_number() OVER x AS tenure, min(wave) OVER (PARTITION BY s.firm) AS entry_wave, lead(wave) OVER x AS next_wave
    FROM (SELECT DISTINCT year, firm FROM sparse) s JOIN swave w USING (year) WINDOW x AS (PARTITION BY s.firm ORDER BY wave)
), risk AS (
    SELECT year, firm, tenure, CASE WHEN next_wave = wave + 1 THEN 0 ELSE 1 END AS exit, next_year - year AS gap
    FROM spell WHERE wave = entry_wave + tenure - 1 AND next_year IS NOT NULL
), step AS (SELECT year AS before, next_year AS year FROM wave WHERE next_year IS NOT NULL),
riskp AS (SELECT DISTINCT d.year, before, person FROM dense d JOIN step USING (year) WHERE EXISTS (SELECT 1 FROM dense o WHERE o.year = step.before AND o.person = d.person)),
riskf AS (SELECT DISTINCT d.year, before, firm FROM dense d JOIN step USING (year) WHERE EXISTS (SELECT 1 FROM dense o WHERE o.year = step.before AND o.firm = d.firm)),
dyad AS (
    SELECT p.year, p.before, p.person, f.firm, (n.person IS NOT NULL)::INT AS tie, (o.person IS NOT NULL)::INT AS memory
    FROM riskp p JOIN riskf f USING (year, before) LEFT JOIN dense n ON n.year = p.year AND n.person = p.person AND n.firm = f.firm
    LEFT JOIN dense o ON o.year = p.before AND o.person = p.person AND o.firm = f.firm
), met AS (
    SELECT x.year AS before, x.person, b.firm, count(DISTINCT m.person) AS closure, count(*) AS cycles
    FROM dense x JOIN dense m ON x.year = m.year AND x.firm = m.firm AND x.person <> m.person JOIN dense b ON b.year = m.year AND b.person = m.person AND b.firm <> x.firm GROUP BY ALL
), closed AS (SELECT d.*, coalesce(m.closure, 0) AS closure, coalesce(m.cycles, 0) AS cycles FROM dyad d LEFT JOIN met m USING (before, person, firm))
"""

ORACLES = {
    k: AFF + v
    for k, v in {
        "seats_per_person": "SELECT * FROM held",
        "directors_per_firm_quantiles": "SELECT year, count(*) AS n, round(quantile_cont(c, 0.25), 6) AS p25, round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.75), 6) AS p75, max(c) AS largest FROM (SELECT year, firm, count(*) AS c FROM dense GROUP BY ALL) GROUP BY year",
        "seat_distribution_pct": "SELECT year, seats, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM (SELECT year, least(seats, 5) AS seats, count(*) AS n FROM held GROUP BY ALL)",
        "retention": "SELECT year, next_year, n, kept, round(kept / n, 6) AS rate, round(pow(kept / n, 1 / (next_year - year)), 6) AS yearly_rate FROM (SELECT h.year, w.next_year, count(*) AS n, count(o.person) AS kept FROM held h JOIN wave w ON h.year = w.year AND w.next_year IS NOT NULL LEFT JOIN held o ON o.year = w.next_year AND o.person = h.person GROUP BY ALL)",
        "firm_turnover": "SELECT year, count(*) FILTER (WHERE year = f) AS new_firms, count(*) FILTER (WHERE year > f) AS returning_firms FROM (SELECT DISTINCT year, firm, min(year) OVER (PARTITION BY firm) AS f FROM dense) GROUP BY year",
        "waves_histogram": "SELECT waves, count(*) AS n FROM (SELECT firm, count(DISTINCT year) AS waves FROM sparse GROUP BY firm) GROUP BY waves",
        "top_directors": "SELECT person, count(DISTINCT firm) AS n_firms, count(DISTINCT year) AS n_waves FROM dense GROUP BY person ORDER BY n_firms DESC, person LIMIT 22",
        "rank_structure": "SELECT year, rank_ AS rank, n, mean_seats, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM (SELECT year, coalesce(nullif(rank_, ''), 'untitled') AS rank_, count(*) AS n, round(avg(seats), 6) AS mean_seats FROM held LEFT JOIN persons USING (person) GROUP BY ALL)",
        "zscore_in_wave": "SELECT *, round((seats - avg(seats) OVER w) / coalesce(nullif(stddev_pop(seats) OVER w, 0), 1), 6) AS z FROM held WINDOW w AS (PARTITION BY year)",
        "pct_rank_in_wave": "SELECT *, round((rank() OVER (PARTITION BY year ORDER BY seats) + (count(*) OVER (PARTITION BY year, seats) - 1) / 2) / count(*) OVER (PARTITION BY year) * 100, 6) AS pct FROM held",
        "office_flags": "SELECT *, CAST(\"1-URGENT\" AS BIGINT) + CAST(\"2-HIGH\" AS BIGINT) AS n_flags FROM (SELECT year, person, coalesce(bool_or(role = '1-URGENT'), false) AS \"1-URGENT\", coalesce(bool_or(role = '2-HIGH'), false) AS \"2-HIGH\" FROM aff GROUP BY ALL)",
        "firm_flags": "SELECT * FROM fflags",
        "rate_grouping_sets": "SELECT coalesce(year, 0) AS year, origin, count(*) AS n, round(avg(political::INT), 6) AS rate FROM valued GROUP BY GROUPING SETS ((valued.year, origin), (origin))",
        "sector_facts": "SELECT *, round(firm_waves / sum(firm_waves) OVER (), 6) AS share FROM (SELECT sector, count(*) AS firm_waves, count(DISTINCT firm) AS n_firms, round(avg(n_directors), 6) AS mean_directors, round(avg(connected::INT), 6) AS share_connected FROM fflags LEFT JOIN sectors USING (firm) GROUP BY sector)",
        "gini": "SELECT year, origin, count(*) AS n, round(sum((2 * r - m - 1) * seats) / (count(*) * sum(seats)), 6) AS gini, round(sum(seats) / any_value(x), 6) AS share_of_x, round(count(*) / any_value(k), 6) AS share_of_heads, round(avg((seats = 0)::INT), 6) AS zero_share FROM (SELECT *, row_number() OVER (PARTITION BY year, origin ORDER BY seats, person) AS r, count(*) OVER (PARTITION BY year, origin) AS m, sum(seats) OVER (PARTITION BY year) AS x, count(*) OVER (PARTITION BY year) AS k FROM valued) GROUP BY year, origin",
        "lorenz": "SELECT year, person, round(row_number() OVER o / count(*) OVER w, 6) AS heads, round(sum(seats) OVER (o ROWS UNBOUNDED PRECEDING) / sum(seats) OVER w, 6) AS held FROM valued WINDOW w AS (PARTITION BY year), o AS (PARTITION BY year ORDER BY seats, person)".replace("OVER (o ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY year ORDER BY seats, person ROWS UNBOUNDED PRECEDING)"),
        "risk_set": "SELECT * FROM risk",
        "life_table": "SELECT a.tenure, a.at_risk, a.events, round(a.events / a.at_risk, 6) AS hazard, round(product(1 - b.events / b.at_risk), 6) AS survival FROM (SELECT tenure, count(*) AS at_risk, sum(exit)::BIGINT AS events FROM risk GROUP BY 1) a JOIN (SELECT tenure, count(*) AS at_risk, sum(exit)::BIGINT AS events FROM risk GROUP BY 1) b ON b.tenure <= a.tenure GROUP BY ALL",
        "persistence_panel": "SELECT f.year, f.firm, f.n_directors, f.connected, m.max_seats, least(f.n_directors, 5) AS directors_cat, CAST(EXISTS (SELECT 1 FROM dense d WHERE d.firm = f.firm AND d.year = w.next_year) AS BIGINT) AS reappears FROM fflags f JOIN wave w ON f.year = w.year AND w.next_year IS NOT NULL JOIN (SELECT year, firm, max(seats) AS max_seats FROM dense JOIN held USING (year, person) GROUP BY ALL) m ON m.year = f.year AND m.firm = f.firm",
        "firm_projection": "SELECT x.year, x.firm AS a, y.firm AS b, count(*) AS weight, string_agg(CAST(x.person AS VARCHAR), ';' ORDER BY x.person) AS via FROM dense x JOIN dense y ON x.year = y.year AND x.person = y.person AND x.firm < y.firm GROUP BY ALL",
        "person_projection": "SELECT * FROM proj",
        "degree": "SELECT year, node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT year, a AS node, weight FROM proj UNION ALL SELECT year, b, weight FROM proj) GROUP BY ALL",
        "square_clustering": ", q AS (SELECT x.year, x.firm AS u, y.firm AS w, count(*) - 1 AS q FROM sparse x JOIN sparse y ON x.year = y.year AND x.person = y.person AND x.firm < y.firm GROUP BY ALL), dg AS (SELECT year, firm, count(*) AS d FROM sparse GROUP BY ALL) SELECT s.year, s.person AS node, round(coalesce(sum(q) / nullif(sum(du.d + dw.d - 2 - q), 0), 0), 6) AS square_clustering FROM sparse s JOIN sparse t ON s.year = t.year AND s.person = t.person AND s.firm < t.firm JOIN q ON q.year = s.year AND q.u = s.firm AND q.w = t.firm JOIN dg du ON du.year = s.year AND du.firm = q.u JOIN dg dw ON dw.year = s.year AND dw.firm = q.w GROUP BY ALL",
        "burt_and_effective_size": ", ind AS (SELECT x.year, x.a AS u, y.b AS v, sum(x.p * y.p) AS i FROM st x JOIN st y ON x.year = y.year AND x.b = y.a WHERE x.a <> y.b GROUP BY ALL), red AS (SELECT x.year, x.a AS u, z.a AS v, sum(x.p * z.m) AS r FROM st x JOIN st z ON x.year = z.year AND x.b = z.b WHERE x.a <> z.a GROUP BY ALL) SELECT s.year, s.a AS node, round(sum(pow(s.p + coalesce(i, 0), 2)), 6) AS burt_constraint, round(sum(1 - coalesce(r, 0)), 6) AS effective_size FROM st s LEFT JOIN ind ON ind.year = s.year AND ind.u = s.a AND ind.v = s.b LEFT JOIN red ON red.year = s.year AND red.u = s.a AND red.v = s.b GROUP BY ALL",
        "open_share": "SELECT n.year, n.node, n.mates, round((n.mates * (n.mates - 1) / 2 - coalesce(c, 0)) / nullif(n.mates * (n.mates - 1) / 2, 0), 6) AS open_share FROM (SELECT year, a AS node, count(*) AS mates FROM sboth GROUP BY ALL) n LEFT JOIN (SELECT x.year, x.a AS node, count(*) AS c FROM sboth x JOIN sboth y ON x.year = y.year AND x.a = y.a JOIN sproj e ON e.year = x.year AND e.a = x.b AND e.b = y.b GROUP BY ALL) k ON k.year = n.year AND k.node = n.node",
        "network_summary": "SELECT *, round(2 * edges / (nodes * (nodes - 1)), 6) AS density, round(2 * edges / nodes, 6) AS mean_degree FROM (SELECT year, count(DISTINCT person) + count(DISTINCT firm) AS nodes, count(*) AS edges FROM dense GROUP BY year)",
        "pooled_edges": "SELECT person, firm, string_agg(CAST(year AS VARCHAR), ';' ORDER BY year) AS years, " + ", ".join(f"CAST(max((year = {y})::INT) AS BIGINT) AS y{y}" for y in range(1995, 2002)) + " FROM dense GROUP BY ALL",
        "transition_table": ", a AS (SELECT d.year AS t, w.next_year, person, firm FROM dense d JOIN wave w ON d.year = w.year AND w.next_year IS NOT NULL), b AS (SELECT w.year AS t, w.next_year, person, firm FROM dense d JOIN wave w ON d.year = w.next_year), a2 AS (SELECT * FROM a WHERE (t, person) IN (SELECT t, person FROM b) AND (t, firm) IN (SELECT t, firm FROM b)), b2 AS (SELECT * FROM b WHERE (t, person) IN (SELECT t, person FROM a) AND (t, firm) IN (SELECT t, firm FROM a)) SELECT coalesce(a2.t, b2.t) AS year, coalesce(a2.next_year, b2.next_year) AS next_year, count(*) FILTER (WHERE a2.t IS NOT NULL AND b2.t IS NOT NULL) AS stable, count(*) FILTER (WHERE a2.t IS NULL) AS formed, count(*) FILTER (WHERE b2.t IS NULL) AS dissolved FROM a2 FULL JOIN b2 ON a2.t = b2.t AND a2.person = b2.person AND a2.firm = b2.firm GROUP BY ALL",
        "change_statistics": "SELECT d.year, d.person, d.firm, d.tie, d.memory, coalesce(sum(tie) OVER (PARTITION BY d.year, d.person), 0)::BIGINT - d.tie AS b1star2, coalesce(sum(tie) OVER (PARTITION BY d.year, d.firm), 0)::BIGINT - d.tie AS b2star2, CASE WHEN origin = 'unknown' THEN 0 ELSE sum(tie) OVER (PARTITION BY d.year, d.firm, origin)::BIGINT - d.tie END AS origin_match, political::BIGINT AS office FROM dyad d LEFT JOIN persons USING (person)",
        "closure_design": "SELECT year, person, firm, tie, memory, closure, cycles FROM closed",
        "brokerage_outcomes": "SELECT h.year, h.person, h.seats, (o.person IS NOT NULL)::BIGINT AS survives, coalesce(o.seats, 0) AS seats_next, (SELECT count(*) FROM dense n WHERE n.year = w.next_year AND n.person = h.person AND n.firm NOT IN (SELECT firm FROM dense q WHERE q.year = h.year AND q.person = h.person)) AS new_seats, coalesce(o.seats, 0) - h.seats AS growth FROM held h JOIN wave w ON w.year = h.year AND w.next_year IS NOT NULL LEFT JOIN held o ON o.year = w.next_year AND o.person = h.person",
        "stratified_gap_observed": "SELECT count(*) AS cells, round(sum((y1 - y0) * n1 * n0 / (n1 + n0)) / sum(n1 * n0 / (n1 + n0)), 6) AS gap FROM (SELECT year, seat_cat, count(*) FILTER (WHERE political) AS n1, count(*) FILTER (WHERE NOT political) AS n0, avg(y) FILTER (WHERE political) AS y1, avg(y) FILTER (WHERE NOT political) AS y0 FROM cased GROUP BY ALL) WHERE n1 >= 5 AND n0 >= 5",
        "ols_by_wave": "SELECT year, count(*) AS n, round(regr_slope(y, seats), 6) AS slope, round(regr_intercept(y, seats), 6) AS intercept FROM cased GROUP BY year",
        "sector_rules": "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'finance' WHEN regexp_matches(p_name, 'widget|plate') THEN 'land' WHEN regexp_matches(p_name, 'red|green') THEN 'agriculture' ELSE 'other' END AS sector FROM part",
        "segment_blocks": r", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), h AS (SELECT *, sum((length(line) BETWEEN 6 AND 120 AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 4 AND length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) > 0.85 * length(regexp_replace(line, '[^\p{L}]', '', 'g')))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l) SELECT doc_id, block::BIGINT AS block, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM h GROUP BY doc_id, block",
    }.items()
}
ORACLES["link_components"] = AFF.replace("WITH aff", "WITH RECURSIVE aff", 1) + ", e AS (SELECT year, person * 2 AS a, firm * 2 + 1 AS b FROM sparse UNION ALL SELECT year, firm * 2 + 1, person * 2 FROM sparse), r AS (SELECT DISTINCT year, a, a AS l FROM e UNION SELECT r.year, e.b, r.l FROM r JOIN e ON e.year = r.year AND e.a = r.a) SELECT year, a AS node, min(l) AS component FROM r GROUP BY ALL"

QUERIES |= registers.QUERIES
ORACLES |= registers.ORACLES | {k: AFF + v for k, v in registers.ON_VIEW.items()}
QUERIES |= measures.QUERIES
ORACLES |= measures.ALONE | {k: AFF + v for k, v in measures.ON_VIEW.items()} | {k: AFF.replace("WITH aff", "WITH RECURSIVE aff", 1) + v for k, v in measures.RECURSIVE.items()}
QUERIES |= rosters.QUERIES
ORACLES |= rosters.ALONE | {k: AFF + v for k, v in rosters.ON_VIEW.items()}
QUERIES |= chain.QUERIES
ORACLES |= chain.ALONE | {k: AFF + v for k, v in chain.ON_VIEW.items()}
QUERIES |= counts.QUERIES
ORACLES |= {k: AFF + v for k, v in counts.ON_VIEW.items()}
QUERIES |= inference.QUERIES
ORACLES |= inference.ALONE | {k: AFF + v for k, v in inference.ON_VIEW.items()} | {k: AFF.replace("WITH aff", "WITH RECURSIVE aff", 1) + v for k, v in inference.RECURSIVE.items()}
#: The measures of the thinned graph over all ties: the same SQL, without the filter that thins.
_THIN = "FROM aff WHERE role = '1-URGENT' AND status = 'F' AND month = 3)"
ORACLES |= {f"{k}_whole": ORACLES[k].replace(_THIN, "FROM dense)") for k in ("waves_histogram", "risk_set", "life_table", "square_clustering", "burt_and_effective_size", "open_share", "link_components")}
