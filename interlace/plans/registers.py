"""Queries of register reading, classification and linkage, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from interlace.functions import registers, text
from interlace.operators import linkage, panel, stats
from interlace.sources.affiliations import persons, seats, table

LEXICON = (("red", 1, 1, "warm"), ("blue", 1, 2, "cool"), ("cold", 2, 1, "cool"), ("ring", 3, 1, "small"), ("bolt", 3, 2, "small"), ("anvil", 3, 3, "large"))
OFFICES = (("and", "and"), ("der", "der"), ("que", "que"))
ROLES = (("director", "Director"), ("auditor", "Auditor"))


def page_split(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    marked = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: F.concat(F.lit("<<<PAGE "), t["turn"].cast("string"), F.lit(">>> "), t["text"])), "")
    return registers.pages(turns.groupBy("conv_id").agg(marked.alias("volume")), "conv_id", "volume").select("conv_id", "page", F.length("body").cast("long").alias("chars"), F.md5("body").alias("body_md5"))


def page_asof(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    mark = F.col("event_type") == "signup"
    return registers.page_of(e.where(~mark), e.where(mark).withColumnRenamed("event_id", "page"), "user_id").fillna(-1, ["page"])


def labelled_fields(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    printed = F.concat(F.col("s_name"), F.lit("\nSeat : "), F.col("n_name"), F.lit("\nCapital : L.E. "), F.regexp_replace(F.floor(F.abs("s_acctbal")).cast("string"), r"(\d)(\d{3})$", "$1 $2"), F.lit("\nPurpose :\n"))
    t = j.select("s_suppkey", printed.alias("t"))
    money = registers.money(registers.field(F.col("t"), "Capital"))
    return t.select("s_suppkey", registers.field(F.col("t"), "Seat").alias("seat"), registers.field(F.col("t"), "Purpose").alias("purpose"), money["currency"].alias("currency"), money["amount"].alias("amount"))


def name_lists(s: SparkSession, d: str) -> DataFrame:
    names = registers.name_list(F.coalesce("text", F.lit("")))
    return table(s, d, "documents").select("doc_id", names.alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "|")).alias("names_md5"))


def printed_names(s: SparkSession, d: str) -> DataFrame:
    """Ranks are popped from names that end in none, one or two of them."""
    k = F.col("c_custkey") % 4
    printed = F.concat(F.col("c_name"), F.when(k == 1, " Bey").when(k == 2, " Bey Pasha").when(k == 3, " EFFENDI").otherwise(""))
    return table(s, d, "customer").select("c_custkey", registers.person_name(printed).alias("x")).select("c_custkey", "x.display", "x.rank")


def joined_entries(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    e = registers.entries(lines, "doc_id", "pos", "line", "^[A-D]")
    return e.select("doc_id", "entry", "n_lines", F.length("text").cast("long").alias("chars"))


def roster_spans(s: SparkSession, d: str) -> DataFrame:
    months = table(s, d, "orders").select(F.col("o_custkey").alias("custkey"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("page"))
    return registers.spans(months.groupBy("custkey", "page").agg(F.count("*").alias("n")), "custkey", "page", "n", 2, 3)


def clause_roles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("firm") % 3
    clause = F.concat(F.when(k == 0, "Director ").when(k == 1, "Auditor of ").otherwise("de "), F.col("firm").cast("string"))
    t = seats(s, d).select("year", "person", F.struct("firm", clause.alias("c")).alias("x")).groupBy("year", "person").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "; ").alias("t"))
    t = t.select((F.col("year") * 10000000 + F.col("person")).alias("entry"), "t")
    return registers.clauses(t, "entry", "t", ROLES)


def person_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", registers.is_person(F.col("p_name"), "anvil", "ring|rod", "old|new|the", "widget|cold").alias("is_person"))


def offices_named(s: SparkSession, d: str) -> DataFrame:
    return registers.offices(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", OFFICES, "thand|under|quel", "(?:on|en) ")


def lexicon(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(LEXICON), "term string, pass int, prio int, label string")


def lexicon_class(s: SparkSession, d: str) -> DataFrame:
    return text.lexicon_class(table(s, d, "part"), "p_partkey", "p_name", lexicon(s))


def lexicon_report(s: SparkSession, d: str) -> DataFrame:
    n = lexicon_class(s, d).groupBy("label").agg(F.count("*").alias("n"))  # one row for each label
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def part_mentions(s: SparkSession, d: str) -> DataFrame:
    """Names as printed, under the key of their last word, in one of five waves."""
    return table(s, d, "part").select(F.substring_index("p_name", " ", -1).alias("root"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5 + 1930).alias("year"))


def person_linkage(s: SparkSession, d: str) -> DataFrame:
    m = part_mentions(s, d).select("name", "year", text.name_key(F.col("name")).alias("name_key"))
    return linkage.summary(linkage.person_roots(m, "name_key", "name").select("root", "name", "year"), "P")


def company_linkage(s: SparkSession, d: str) -> DataFrame:
    m = part_mentions(s, d).select("name", "year")
    return linkage.summary(linkage.company_roots(m, "name").select("root", "name", "year"), "C")


def bootstrap_mean(s: SparkSession, d: str, replicates: int = 50) -> DataFrame:
    h = panel.seats_per_person(seats(s, d)).join(persons(s, d), "person")
    return stats.bootstrap_mean(h, ["year", "political"], "person", "seats", replicates)


def median_split(s: SparkSession, d: str) -> DataFrame:
    h = panel.seats_per_person(seats(s, d)).join(persons(s, d), "person")
    cut = h.groupBy("year", "rank").agg(F.percentile("seats", F.lit(0.5)).alias("median"))
    return h.join(cut, ["year", "rank"]).select("year", "person", "seats", (F.col("seats") > F.col("median")).alias("above"))


def percentile_gap(s: SparkSession, d: str) -> DataFrame:
    p = panel.percent_rank_average(panel.seats_per_person(seats(s, d)), "year", "seats", "pct").join(persons(s, d), "person")
    mean = lambda c: F.avg(F.when(c, F.col("pct")))
    return p.groupBy("year").agg(F.count_if("political").alias("members"), F.round(mean(F.col("political")) - mean(~F.col("political")), 5).alias("gap"))


QUERIES = {f.__name__: f for f in (page_split, page_asof, labelled_fields, name_lists, printed_names, joined_entries, roster_spans, clause_roles, person_filter, offices_named, lexicon_class, lexicon_report, person_linkage, company_linkage, median_split, percentile_gap)}
QUERIES["entity_summary"] = lambda s, d: linkage.summary(part_mentions(s, d), "E")
QUERIES["audit_variants"] = lambda s, d: linkage.audit(part_mentions(s, d))
QUERIES["bootstrap_mean"] = lambda s, d: bootstrap_mean(s, d)
#: As often as the reference; the SQL of bootstrap_mean has 50 replicates.
QUERIES["bootstrap_mean_2000"] = lambda s, d: bootstrap_mean(s, d, 2000)
QUERIES["skeleton_groups"] = lambda s, d: table(s, d, "part").select("p_name", text.skeleton(F.col("p_name")).alias("skeleton")).groupBy("skeleton").agg(F.countDistinct("p_name").alias("names"), F.count("*").alias("mentions"))


def _named(office: str, pattern: str) -> str:
    rule = f"'(thand|under|quel)|((?:on|en) )?({pattern})'"
    return f"SELECT doc_id, '{office}' AS office, list_bool_and(list_transform(list_filter(list_zip(m, p), lambda x: x[1] <> ''), lambda x: coalesce(x[2], '') <> '')) AS former FROM (SELECT doc_id, regexp_extract_all(text, {rule}, 3) AS m, regexp_extract_all(text, {rule}, 2) AS p FROM documents) WHERE len(list_filter(m, lambda x: x <> '')) > 0"


_LEX = "WITH lex(term, pass, prio, label) AS (VALUES " + ", ".join(f"('{t}', {p}, {q}, '{v}')" for t, p, q, v in LEXICON) + "), tok AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part), best AS (SELECT p_partkey, label, row_number() OVER (PARTITION BY p_partkey ORDER BY pass, place, prio) AS r FROM tok JOIN lex USING (term)), classed AS (SELECT p_partkey, coalesce(label, 'unknown') AS label FROM part LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (p_partkey)) "
_MENTIONS = "WITH m AS (SELECT string_split(p_name, ' ')[-1] AS root, p_name AS name, p_partkey % 5 + 1930 AS year FROM part) "

#: SQL that stands alone.
ORACLES = {
    "page_split": "SELECT conv_id, CAST(turn AS BIGINT) AS page, length(trim(coalesce(text, ''), ' ')) AS chars, md5(trim(coalesce(text, ''), ' ')) AS body_md5 FROM conversations",
    "page_asof": "SELECT user_id, epoch_us(ts) AS at, coalesce((SELECT max_by(m.event_id, m.ts) FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'signup' AND m.ts <= e.ts), -1) AS page FROM events e WHERE event_type <> 'signup'",
    "labelled_fields": "SELECT s_suppkey, n_name AS seat, CAST(NULL AS VARCHAR) AS purpose, 'LE' AS currency, floor(abs(s_acctbal)) AS amount FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "name_lists": r"SELECT doc_id, len(x) AS n, md5(array_to_string(x, '|')) AS names_md5 FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\([^)]*\)', '', 'g'), '\bMM?\.\s*', '', 'g'), '\s+et\s+', ',', 'g'), '[;,]'), lambda v: trim(v, ' ')), lambda v: length(v) >= 3 AND regexp_matches(v, '\p{L}')) AS x FROM documents)",
    "printed_names": "SELECT c_custkey, c_name AS display, CASE c_custkey % 4 WHEN 1 THEN 'bey' WHEN 2 THEN 'bey' WHEN 3 THEN 'effendi' END AS rank FROM customer",
    "joined_entries": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), e AS (SELECT *, sum(regexp_matches(line, '^[A-D]')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS entry FROM l) SELECT doc_id, entry::BIGINT AS entry, count(*) AS n_lines, CAST(sum(length(trim(line, ' '))) + count(*) - 1 AS BIGINT) AS chars FROM e WHERE entry > 0 GROUP BY ALL",
    "roster_spans": "WITH c AS (SELECT o_custkey AS custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS page, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT *, coalesce((page - lag(page) OVER (PARTITION BY custkey ORDER BY page) > 3)::INT, 0) AS new FROM c), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY custkey ORDER BY page) AS BIGINT) AS span FROM g), o AS (SELECT *, min(page) FILTER (WHERE n >= 2) OVER (PARTITION BY custkey, span) AS first FROM r) SELECT custkey, span, min(page) AS first_page, max(page) AS last_page, count(*) AS pages, CAST(sum(n) AS BIGINT) AS entries FROM o WHERE page >= first GROUP BY ALL",
    "person_filter": r"SELECT p_partkey, length(regexp_replace(p_name, '[^\p{L}]', '', 'g')) >= 4 AND NOT contains(p_name, 'anvil') AND NOT regexp_matches(p_name, '(ring|rod)\.?\s*$') AND NOT regexp_matches(regexp_replace(p_name, '^((old|new|the)\s+){1,3}', ''), '^(widget|cold)') AS is_person FROM part",
    "offices_named": " UNION ALL ".join(_named(*o) for o in OFFICES),
    "lexicon_class": _LEX + "SELECT * FROM classed",
    "lexicon_report": _LEX + "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM classed GROUP BY label",
    "entity_summary": _MENTIONS + ", n AS (SELECT root, name, count(*) AS c FROM m GROUP BY ALL) SELECT root, (SELECT name FROM n WHERE n.root = m.root ORDER BY c DESC, length(name) DESC, name LIMIT 1) AS label, count(*) AS n_mentions, string_agg(DISTINCT name, ' ;; ' ORDER BY name) AS name_variants, array_to_string(list_sort(list(DISTINCT year)), ';') AS years_present, format('E{:05d}', dense_rank() OVER (ORDER BY root)) AS id FROM m GROUP BY root",
    "audit_variants": _MENTIONS + "SELECT root, count(DISTINCT name) AS variants FROM m GROUP BY root HAVING variants > 2",
    "skeleton_groups": "SELECT translate(replace(lower(p_name), ' ', ''), 'ltjfeoaumhkqwy', 'iiiicccnnnbgvv') AS skeleton, count(DISTINCT p_name) AS names, count(*) AS mentions FROM part GROUP BY ALL",
}

#: SQL that follows the affiliation view.
ON_VIEW = {
    "clause_roles": ", k AS (SELECT year * 10000000 + person AS entry, firm, row_number() OVER (PARTITION BY year, person ORDER BY firm) - 1 AS clause, CASE firm % 3 WHEN 0 THEN 'director' WHEN 1 THEN 'auditor' END AS own FROM dense), c AS (SELECT entry, clause, last_value(own IGNORE NULLS) OVER (PARTITION BY entry ORDER BY clause ROWS UNBOUNDED PRECEDING) AS role, CAST(firm AS VARCHAR) AS organisation FROM k) SELECT * FROM c WHERE role IS NOT NULL",
    "median_split": ", c AS (SELECT year, rank_, quantile_cont(seats, 0.5) AS median FROM valued GROUP BY ALL) SELECT year, person, seats, seats > median AS above FROM valued JOIN c USING (year, rank_)",
    "percentile_gap": ", r AS (SELECT *, round((rank() OVER (PARTITION BY year ORDER BY seats) + (count(*) OVER (PARTITION BY year, seats) - 1) / 2) / count(*) OVER (PARTITION BY year) * 100, 6) AS pct FROM valued) SELECT year, count(*) FILTER (WHERE political) AS members, round(avg(pct) FILTER (WHERE political) - avg(pct) FILTER (WHERE NOT political), 5) AS gap FROM r GROUP BY year",
    "bootstrap_mean": ", u AS (SELECT year, political, seats, b, CAST('0x' || left(md5(person || ':' || b), 8) AS BIGINT) / 4294967296 AS u FROM valued, range(1, 51) t(b)), w AS (SELECT *, (u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.91969860)::INT + (u >= 0.98101184)::INT + (u >= 0.99634015)::INT + (u >= 0.99940582)::INT AS w FROM u), r AS (SELECT year, political, b, sum(w * seats) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL), q AS (SELECT year, political, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM r GROUP BY ALL) SELECT year, political, count(*) AS n, round(avg(seats), 6) AS mean, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi FROM valued JOIN q USING (year, political) GROUP BY ALL",
}
