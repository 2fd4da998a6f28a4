"""Queries of distances, eigenvectors, dyadic fits and nulls, and the same in SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from interlace.functions import companies
from interlace.operators import curves, distances, dyadic, measures, network, nulls, panel, stats
from interlace.sources.affiliations import persons, seats, table

DYAD_TERMS = ["edges", "memory", "b1star2", "b2star2", "origin_match", "office"]
CLOSURE_TERMS = ["edges", "prior_seats", "prior_board"]


def _dyads(s: SparkSession, d: str) -> DataFrame:
    return network.change_counts(seats(s, d), persons(s, d)).withColumn("edges", F.lit(1))


def _closure(s: SparkSession, d: str) -> DataFrame:
    """Dyads with their closure, and the seats and the board of the wave before."""
    return network.closure_counts(seats(s, d)).withColumn("edges", F.lit(1))


def _brokers(s: SparkSession, d: str) -> DataFrame:
    return network.brokerage_outcomes(seats(s, d)).withColumn("one", F.lit(1)).join(persons(s, d).select("person", F.col("political").cast("int").alias("office")), "person")


def _panel(s: SparkSession, d: str) -> DataFrame:
    h = panel.seats_per_person(seats(s, d)).join(persons(s, d), "person")
    return h.withColumn("seat_cat", F.least("seats", F.lit(4))).withColumn("y", (F.col("seats") * F.col("person") % 7).cast("double"))


def mixing_null(s: SparkSession, d: str) -> DataFrame:
    known = seats(s, d).join(persons(s, d), "person").where("origin <> 'unknown'")
    return nulls.mixing_null(known, "year", "firm", "origin")


def joint_wald(s: SparkSession, d: str) -> DataFrame:
    """Whether staying to the next wave differs by seats, and by office, each beyond the other."""
    b = _brokers(s, d).select("person", "one", "office", "survives", *[(F.least("seats", F.lit(4)) == i).cast("int").alias(f"seats{i}") for i in (2, 3, 4)])
    return stats.wald_tests(b, ["one", "seats2", "seats3", "seats4", "office"], "survives", "person", {"seats": ["seats2", "seats3", "seats4"], "office": ["office"]})


def returns_to_brokerage(s: SparkSession, d: str) -> DataFrame:
    """measure, outcome, observed, p, lo, hi, draws: outcomes of those above their cell's median of effective size, or below
    that of constraint, beside labels dealt anew within waves and seats."""
    ties = seats(s, d)
    size = network.burt(ties, "person", "firm").withColumnRenamed("node", "person")
    rows = network.brokerage_outcomes(ties).join(size, ["year", "person"]).withColumn("seat_cat", F.least("seats", F.lit(4)))
    cells, out = ["year", "seat_cat"], None
    for measure in ("effective_size", "burt_constraint"):
        cut = rows.groupBy(*cells).agg(F.percentile(measure, F.lit(0.5)).alias("median"))
        high = F.col(measure) > F.col("median") if measure == "effective_size" else F.col(measure) < F.col("median")
        split = rows.join(cut, cells).withColumn("broker", high)
        for outcome in ("survives", "new_seats", "growth"):
            one = nulls.stratified_null(split, cells, "broker", outcome).select(F.lit(measure).alias("measure"), F.lit(outcome).alias("outcome"), "*")
            out = one if out is None else out.union(one)
    return out


def centrality_comparison(s: SparkSession, d: str) -> DataFrame:
    ties = seats(s, d)
    mates = network.board_degrees(ties, "person", "firm").withColumnRenamed("node", "person")
    rows = panel.seats_per_person(ties).join(mates, ["year", "person"], "left").fillna(0, ["degree", "strength"]).join(persons(s, d), "person")
    return measures.compared(rows, ["seats", "degree", "strength"], "political")


def company_records(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as a register prints them, five to a page and a volume for each nation, some cut by a page's end."""
    k = F.col("s_suppkey")
    name = F.concat(F.upper(F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "abdefgilmo")), F.lit(" MILLS"))
    text = F.concat(
        name, F.lit("\nSiège social : 12 rue Neuve, "), F.when(k % 2 == 0, "Le Caire").otherwise("Alexandrie"), F.lit("\nConstituée le 5 mai 19"), F.lpad((k % 50).cast("string"), 2, "0"),
        F.lit(".\nDurée : "), (k % 90 + 1).cast("string"), F.lit(" ans.\nObjet : filature\net tissage\nConseil d'Administration\nPrésident : "), F.initcap(F.lower(F.substring(name, 1, 6))), F.lit(" Bey\n@Administrateurs : Omar Hassan, Klein Jules et MM. Guido\nCapital : L.E. "), (k * 1000).cast("string"), F.lit("\nBilan : 5, 6"),
    )
    seated = table(s, d, "supplier").select("s_nationkey", "s_suppkey", text.alias("t")).withColumn("n", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    # the last company of a page goes on overleaf from its list of directors on
    page = F.floor(F.col("n") / 5)
    parts = seated.select("s_nationkey", "n", F.when(F.col("n") % 5 == 4, F.split("t", "@")).otherwise(F.array(F.replace("t", F.lit("@"), F.lit("")))).alias("x"), page.alias("page"))
    parts = parts.select("s_nationkey", "n", "page", F.posexplode("x").alias("at", "t")).select("s_nationkey", (F.col("page") + F.col("at") + 1).alias("page"), F.struct(F.col("n"), F.col("t")).alias("x"))
    pages = parts.groupBy("s_nationkey", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.rtrim(x["t"])), "\n").alias("body"))
    found = companies.company_records(pages, "s_nationkey")
    board = F.array_join(F.transform("board", lambda x: F.concat_ws(":", x["place"].cast("string"), x["role"], x["display"], x["rank"])), ";")
    return found.select("s_nationkey", "page", "name", "name_key", "seat", "city", "founded", "duration", "purpose", "currency", "amount", board.alias("board"))


QUERIES = {
    "joint_wald": joint_wald,
    "returns_to_brokerage": returns_to_brokerage,
    "centrality_comparison": centrality_comparison,
    "retention_by_office": lambda s, d: measures.retention_by(network.held_dyads(seats(s, d), persons(s, d)), "office"),
    "mple_interaction_score_equations": lambda s, d: dyadic.fitted_totals(_dyads(s, d).withColumn("memory_office", F.col("memory") * F.col("office")), [*DYAD_TERMS, "memory_office"], count="n"),
    "company_records": company_records,
    "quantile_regression": lambda s, d: curves.quantile_regression(_panel(s, d).select(F.lit(1).alias("one"), F.col("political").cast("int").alias("office"), "seats"), ["one", "office"], "seats"),
    "seat_densities": lambda s, d: curves.densities(_panel(s, d), ["year", "political"], "seats", 0.25),
    "formed_at_distance": lambda s, d: distances.formed_at_distance(seats(s, d)),
    "wave_frame": lambda s, d: distances.wave_frame(seats(s, d)),
    "mple_bootstrap": lambda s, d: dyadic.mple(_dyads(s, d), DYAD_TERMS, count="n"),
    "mple_score_equations": lambda s, d: dyadic.fitted_totals(_dyads(s, d), DYAD_TERMS, count="n"),
    "formation_and_retention": lambda s, d: dyadic.by_process(_dyads(s, d), DYAD_TERMS, count="n"),
    "closure_forms": lambda s, d: dyadic.closure_forms(_closure(s, d), CLOSURE_TERMS, count="n"),
    "brokerage_poisson": lambda s, d: dyadic.mple(_brokers(s, d), ["one", "seats", "office"], "new_seats", link="poisson"),
    "brokerage_poisson_score_equations": lambda s, d: dyadic.fitted_totals(_brokers(s, d), ["one", "seats", "office"], "new_seats", link="poisson"),
    "stratified_null": lambda s, d: nulls.stratified_null(_panel(s, d), ["year", "seat_cat"], "political", "y"),
    "wave_null": lambda s, d: nulls.wave_null(_panel(s, d), "political", "seats"),
    "redrawn_percentile_gap": lambda s, d: nulls.redrawn_gap(panel.percent_rank_average(_panel(s, d), "year", "seats", "pct"), "political", "pct"),
    "mixing_null": mixing_null,
}

_STEP = "w AS (SELECT year AS before, next_year AS year FROM wave WHERE next_year IS NOT NULL)"
_GRID = f""", {_STEP}, now AS (SELECT d.*, before FROM dense d JOIN w USING (year)), old AS (SELECT d.year AS before, person, firm FROM dense d),
p AS (SELECT DISTINCT year, n.before, n.person FROM now n JOIN old o ON o.before = n.before AND o.person = n.person),
f AS (SELECT DISTINCT year, n.before, n.firm FROM now n JOIN old o ON o.before = n.before AND o.firm = n.firm),
g AS (
    SELECT p.year, p.person, f.firm, (n.firm IS NOT NULL)::INT AS tie, (o.firm IS NOT NULL)::INT AS memory
    FROM p JOIN f ON p.year = f.year LEFT JOIN now n ON n.year = p.year AND n.person = p.person AND n.firm = f.firm
        LEFT JOIN old o ON o.before = p.before AND o.person = p.person AND o.firm = f.firm
), dp AS (SELECT year, person, sum(tie) AS dp FROM g GROUP BY ALL), df AS (SELECT year, firm, sum(tie) AS df FROM g GROUP BY ALL),
so AS (SELECT year, firm, origin, sum(tie) AS same FROM g JOIN persons USING (person) GROUP BY ALL),
z AS (
    SELECT tie, 1 AS edges, memory, dp - tie AS b1star2, df - tie AS b2star2, CASE WHEN origin = 'unknown' THEN 0 ELSE same - tie END AS origin_match, political::INT AS office
    FROM g JOIN dp USING (year, person) JOIN df USING (year, firm) JOIN persons USING (person) JOIN so USING (year, firm, origin)
)"""
_BROKERS = f""", {_STEP}, n AS (
    SELECT a.year, a.person, count(*) AS seats, w.year AS next FROM dense a JOIN w ON w.before = a.year GROUP BY ALL
), new_ AS (
    SELECT w.before AS year, b.person, count(*) FILTER (WHERE o.firm IS NULL) AS new_seats
    FROM dense b JOIN w ON w.year = b.year LEFT JOIN dense o ON o.year = w.before AND o.person = b.person AND o.firm = b.firm GROUP BY ALL
), z AS (
    SELECT 1 AS one, seats, political::INT AS office, coalesce(new_seats, 0) AS new_seats FROM n JOIN persons USING (person) LEFT JOIN new_ USING (year, person)
)"""


def _scores(terms: list[str], y: str) -> str:
    """The score equations: what is fitted equals what is observed."""
    return " UNION ALL ".join(f"SELECT '{t}' AS term, round(sum({t} * {y})::DOUBLE, 3) AS observed, round(sum({t} * {y})::DOUBLE, 3) AS fitted FROM z" for t in terms)


#: SQL that follows the affiliation view.
ON_VIEW = {
    "seat_densities": """, n AS (
    SELECT year, political, count(*) AS n, stddev_samp(seats) AS sd, min(seats) AS low, max(seats) AS high FROM valued GROUP BY ALL HAVING count(*) >= 5 AND stddev_samp(seats) > 0
), p AS (
    SELECT n.*, sd * power(n, -0.2) AS h, unnest(range(low * 4, high * 4 + 1)) / 4 AS point FROM n
)
SELECT year, political, point, round(sum(CASE WHEN abs(point - seats) <= 4 * h THEN exp(-power((point - seats) / h, 2) / 2) ELSE 0 END) / any_value(n * h) / sqrt(2 * pi()), 6) AS density
FROM p JOIN valued USING (year, political) GROUP BY year, political, point HAVING bool_or(abs(point - seats) <= ceil(4 * h / 0.25) * 0.25)""",
    "entry_value": """, s AS (
    SELECT firm, year, wave, next_year, row_number() OVER (PARTITION BY firm ORDER BY wave) AS tenure, min(wave) OVER (PARTITION BY firm) AS entry FROM (SELECT DISTINCT year, firm FROM dense) JOIN wave USING (year)
), r AS (
    SELECT firm, year, tenure FROM s WHERE wave = entry + tenure - 1 AND next_year IS NOT NULL
)
SELECT r.firm, r.year, r.tenure, coalesce((SELECT bool_or(connected) FROM r e JOIN fflags f ON f.firm = e.firm AND f.year = e.year WHERE e.firm = r.firm AND e.tenure = 1), false) AS connected_at_entry FROM r""",
    "mple_score_equations": _GRID + _scores(DYAD_TERMS, "tie"),
    "mple_interaction_score_equations": _GRID.replace("political::INT AS office\n", "political::INT AS office, memory * political::INT AS memory_office\n") + _scores([*DYAD_TERMS, "memory_office"], "tie"),
    "retention_by_office": _GRID + "SELECT office::BIGINT AS office, count(*) AS held, sum(tie)::BIGINT AS kept, round(avg(tie), 6) AS rate FROM z WHERE memory = 1 GROUP BY 1",
    "centrality_comparison": """, e AS (
    SELECT a.year, a.person AS a, b.person AS b, count(*) AS weight FROM dense a JOIN dense b ON a.year = b.year AND a.firm = b.firm AND a.person <> b.person GROUP BY ALL
), g AS (SELECT year, a AS person, count(*) AS degree, sum(weight) AS strength FROM e GROUP BY ALL), v AS (
    SELECT year, person, political::INT AS x, unnest(['seats', 'degree', 'strength']) AS measure, unnest([seats, coalesce(degree, 0), coalesce(strength, 0)])::DOUBLE AS m FROM valued LEFT JOIN g USING (year, person)
), z AS (
    SELECT measure, person, x, (m - avg(m) OVER (PARTITION BY measure, year)) / coalesce(nullif(stddev_pop(m) OVER (PARTITION BY measure, year), 0), 1) AS z FROM v
), f AS (SELECT measure, regr_slope(z, x) AS b, regr_intercept(z, x) AS a, count(*) AS n, avg(x) AS mx, sum(power(x, 2)) - count(*) * power(avg(x), 2) AS sxx, count(DISTINCT person) AS g FROM z GROUP BY measure),
s AS (SELECT measure, person, sum((x - mx) * (z - a - b * x)) AS s FROM z JOIN f USING (measure) GROUP BY ALL),
t AS (SELECT measure, any_value(b) AS b, sqrt(sum(s * s)) / any_value(sxx) * sqrt(any_value(g / (g - 1) * (n - 1) / (n - 2))) AS error FROM s JOIN f USING (measure) GROUP BY measure)
SELECT measure, round(b, 5) AS coefficient, round(error, 5) AS error, round(b - 1.959963984540054 * error, 5) AS lo, round(b + 1.959963984540054 * error, 5) AS hi FROM t""",
    "brokerage_poisson_score_equations": _BROKERS + _scores(["one", "seats", "office"], "new_seats"),
}
#: SQL that follows the affiliation view and walks its graph.
RECURSIVE = {
    "formed_at_distance": f""", {_STEP}, e AS (
    SELECT year, person * 2 AS a, firm * 2 + 1 AS b FROM dense UNION ALL SELECT year, firm * 2 + 1, person * 2 FROM dense
), asked AS (
    SELECT w.before, n.year, n.person, n.firm FROM dense n JOIN w ON w.year = n.year
    WHERE (w.before, n.person) IN (SELECT (year, person) FROM dense) AND (w.before, n.firm) IN (SELECT (year, firm) FROM dense)
), r AS (
    SELECT DISTINCT before, person * 2 AS source, person * 2 AS node, 0 AS steps FROM asked
    UNION SELECT r.before, r.source, e.b, r.steps + 1 FROM r JOIN e ON e.year = r.before AND e.a = r.node WHERE r.steps < 9
), far AS (SELECT before, source, node, min(steps) AS steps FROM r GROUP BY ALL)
SELECT year, person, firm, CAST(coalesce(steps, -1) AS BIGINT) AS distance
FROM asked LEFT JOIN far ON far.before = asked.before AND far.source = person * 2 AND far.node = firm * 2 + 1""",
}

_KEY = "regexp_replace(x, '[^a-z]', '', 'g')"
for _from, _to in (("aou", "au"), ("eou", "eu"), ("ou", "u"), ("aw", "au"), ("ow", "u"), ("w", "u"), ("ch", "sh"), ("ph", "f"), ("q", "k"), ("c([eiy])", r"s\1"), ("c", "k"), ("y", "i")):
    _KEY = f"regexp_replace({_KEY}, '{_from}', '{_to}', 'g')"
_SINGLE = "(SELECT coalesce(string_agg(t[i], '' ORDER BY i), '') FROM (SELECT {0} AS t, unnest(range(1, length({0}) + 1)) AS i) WHERE i = 1 OR t[i] <> t[i - 1])"
#: SQL that stands alone.
ALONE = {
    "company_records": """
WITH s AS (
    SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n, translate(lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), '0123456789', 'abdefgilmo') AS word FROM supplier
)
SELECT s_nationkey, CAST(n // 5 + 1 AS BIGINT) AS page, upper(word) || ' MILLS' AS name, word || ' mills' AS name_key, '12 rue Neuve, ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Le Caire' ELSE 'Alexandrie' END AS seat,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Cairo' ELSE 'Alexandria' END AS city, '5 mai 19' || lpad(CAST(s_suppkey % 50 AS VARCHAR), 2, '0') AS founded, (s_suppkey % 90 + 1) || ' ans' AS duration, 'filature et tissage' AS purpose,
    'LE' AS currency, CAST(s_suppkey * 1000 AS DOUBLE) AS amount, '1:president:' || upper(word[1]) || word[2:] || ':bey;2:director:Omar Hassan;3:director:Klein Jules;4:director:Guido' AS board FROM s
""",
    "name_key": f"""
WITH n AS (SELECT DISTINCT p_name FROM part), w AS (
    SELECT p_name, unnest(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 1 AND t NOT IN ('de', 'di', 'da', 'del', 'della', 'van', 'von', 'el', 'al', 'abu', 'abou', 'ibn', 'ben'))) AS x,
        generate_subscripts(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 1 AND t NOT IN ('de', 'di', 'da', 'del', 'della', 'van', 'von', 'el', 'al', 'abu', 'abou', 'ibn', 'ben')), 1) AS i FROM n
), a AS (SELECT p_name, i, {_KEY} AS k FROM w), b AS (SELECT p_name, i, {_SINGLE.format("a.k")} AS k FROM a),
c AS (SELECT p_name, i, regexp_replace(replace(regexp_replace(regexp_replace(k, '([aeiou])h([aeiou])', '\\1\\2', 'g'), '([aeiou])h([aeiou])', '\\1\\2', 'g'), 'j', 'g'), 'e$', '') AS k FROM b),
d AS (SELECT p_name, i, {_SINGLE.format("c.k")} AS k FROM c)
SELECT p_name, string_agg(k, ' ' ORDER BY i) AS name_key, translate(replace(lower(p_name), ' ', ''), 'ltjfeoaumhkqwy', 'iiiicccnnnbgvv') AS skeleton FROM d GROUP BY p_name
""",
}
