"""Queries of the roster chain from page text to the affiliation table, and of word repair, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from interlace.functions import repair
from interlace.operators import rosters
from interlace.sources.affiliations import seats, table

#: Syllables in the place of digits, so that numbers become names: of persons, and of firms (with consonants that no scan confuses).
PERSON, FIRM = "ba de fi go lu mi no pa re ti".split(), "ta na sa ba ga va ra da pa za".split()
#: Entries on a page.
PAGE = 20
#: A prime: firms' keys are spelt by remainders of it, which differ.
MODULUS = 999999999989


def spelt(digits: Column, syllables: list[str]) -> Column:
    return F.initcap(reduce(lambda c, x: F.replace(c, F.lit(str(x[0])), F.lit(x[1])), enumerate(syllables), digits))


def printed_volumes(s: SparkSession, d: str) -> DataFrame:
    """year, page, body: the boards of each wave as a roster would print them, from its heading on.

    Names are plain, inverted or with honorific and rank; clauses name one or two roles, none (and so inherit
    them), a public body or two firms; some words are broken by lines or blanks or misread.
    """
    ties = seats(s, d)
    surname = spelt(F.lpad(F.col("person").cast("string"), 6, "0"), PERSON)
    given = spelt(F.reverse(F.lpad((F.col("person") * 7).cast("string"), 6, "0")), PERSON)
    k = F.col("person") % 3
    name = F.when(k == 0, F.concat(surname, F.lit(" "), given, F.lit(" Bey"))).when(k == 1, F.concat(surname, F.lit(", "), given, F.lit(" (Pacha)"))).otherwise(F.concat(F.lit("S.E. "), surname, F.lit(" "), given))
    # a remainder after each factor, as the whole product outgrows 64 bits from firm 20,935 on
    key = F.col("firm") + 37
    cube = key * key % MODULUS * key % MODULUS
    firm = spelt(F.lpad((cube * 1000003 % MODULUS).cast("string"), 12, "0"), FIRM)
    m = F.col("firm") % 5
    clause = (
        F.when(m == 0, F.concat(F.lit("Administrateur de la Société "), firm))
        .when(m == 1, F.concat(F.lit("Président du Conseil d'Administration et Administrateur-Délégué de The "), firm, F.lit(" Cy")))
        .when(m == 2, F.concat(F.lit("de la Compagnie "), firm))
        .when(m == 3, F.concat(F.lit("Membre du Comité des "), firm))
        .otherwise(F.concat(F.lit("Adm. Sté. "), firm, F.lit(" et la Compagnie "), firm))
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("firm", clause.alias("c")))), lambda x: x["c"]), "; ")
    rows = ties.groupBy("year", "person").agg(body.alias("body")).withColumn("text", F.concat(name, F.when(k == 1, ", Rentier; ").otherwise(", "), F.col("body"), F.lit(".")))
    damaged = F.when(F.col("person") % 5 == 0, F.replace("text", F.lit("Administrateur de"), F.lit("Adrninistrateur de"))).otherwise(F.col("text"))
    damaged = F.when(F.col("person") % 2 == 0, F.replace(damaged, F.lit("nistrateur de"), F.lit("nis\ntrateur de"))).otherwise(damaged)
    damaged = F.when(F.col("person") % 4 == 1, F.replace(F.replace(damaged, F.lit("Compagnie"), F.lit("Com pagnie")), F.lit("; de"), F.lit(";\nde"))).otherwise(damaged)
    page = 3 + F.floor((F.row_number().over(Window.partitionBy("year").orderBy("person")) - 1) / PAGE)
    pages = rows.select("year", page.alias("page"), F.struct("person", damaged.alias("t")).alias("x")).groupBy("year", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("t"))
    head = F.concat(F.col("page").cast("string"), F.lit(" ANNUAIRE DES SOCIÉTÉS ÉGYPTIENNES PAR ACTIONS\n"))
    front = ties.select("year").distinct().select("year", F.lit(1).cast("long").alias("page"), F.lit("LES ADMINISTRATEURS DES SOCIÉTÉS\nBANQUES, 7").alias("body"))
    return front.union(pages.select("year", "page", F.concat(head, "t").alias("body")))


def roster_mentions(s: SparkSession, d: str) -> DataFrame:
    return rosters.roster_mentions(printed_volumes(s, d), "year", firms_only=False)


def affiliation_table(s: SparkSession, d: str) -> DataFrame:
    mentions = rosters.roster_mentions(printed_volumes(s, d), "year")
    return rosters.affiliation_table(mentions.withColumn("printed", F.concat_ws(" ", "honorific", "name")))


def rank_by_person(s: SparkSession, d: str) -> DataFrame:
    found = rosters.highest_rank(affiliation_table(s, d))
    return found.select("person_id", "highest_rank", F.array_join(F.transform(F.map_entries("rank_by_year"), lambda x: F.concat_ws(":", x["key"], x["value"])), ";").alias("rank_by_year"))


def roster_section(s: SparkSession, d: str) -> DataFrame:
    """Customers as volumes, months as pages: those with an open order are headed, and orders are entries."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("custkey"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("page"), (F.col("o_orderstatus") == "O").alias("open"))
    return rosters.section(o.groupBy("custkey", "page").agg(F.max("open").alias("heading"), F.count("*").alias("n")), "custkey", 2, 4, 2)


def damaged_words(s: SparkSession, d: str) -> DataFrame:
    """part, word: words of the grammar with a letter exchanged, and one more left out, by the part's key."""
    k = F.col("p_partkey")
    term = F.get(F.array(*[F.lit(w.replace("-", "")) for w in repair.STRUCTURAL]), (k % len(repair.STRUCTURAL)).cast("int"))
    letter = F.substring(F.lit("abcdefghilmnoprstuvxz"), (k % 21 + 1).cast("int"), F.lit(1))
    at = (F.floor(k / 19) % F.length("t")).cast("int")
    word = F.concat(F.left("t", at), letter, F.substring("t", at + 2, F.length("t")))
    return table(s, d, "part").select("p_partkey", term.alias("t")).select("p_partkey", F.when(k % 3 == 0, F.substring(word, 2, 40)).otherwise(word).alias("word"))


def repaired_words(s: SparkSession, d: str) -> DataFrame:
    words = damaged_words(s, d)
    terms = s.createDataFrame(list(enumerate(repair.STRUCTURAL)), "place int, term string")
    return words.join(repair.nearest(words, terms), "word", "left").select("p_partkey", "word", "found", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (roster_mentions, affiliation_table, rank_by_person, roster_section, repaired_words)}


def _spelt(digits: str, syllables: list[str]) -> str:
    for i, x in enumerate(syllables):
        digits = f"replace({digits}, '{i}', '{x}')"
    return digits


_NAMES = f""", t AS (
    SELECT DISTINCT year, person, firm,
        {_spelt("lpad(CAST(person AS VARCHAR), 6, '0')", PERSON)} AS sur,
        {_spelt("reverse(lpad(CAST(person * 7 AS VARCHAR), 6, '0'))", PERSON)} AS given,
        {_spelt("lpad(CAST((firm + 37) * (firm + 37) * (firm + 37) * 1000003 % 999999999989 AS VARCHAR), 12, '0')", FIRM)} AS spelt
    FROM dense
), u AS (
    SELECT year, person, firm, upper(sur[1]) || sur[2:] || ' ' || upper(given[1]) || given[2:] AS display, upper(spelt[1]) || spelt[2:] AS x,
        CASE firm % 5 WHEN 0 THEN ['director'] WHEN 1 THEN ['president', 'managing_director'] WHEN 3 THEN ['committee_member'] WHEN 4 THEN ['director'] END AS own
    FROM t
), c AS (
    SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY year, person ORDER BY firm ROWS UNBOUNDED PRECEDING) AS roles,
        CASE firm % 5 WHEN 0 THEN ['Société ' || x] WHEN 1 THEN ['The ' || x || ' Cy'] WHEN 2 THEN ['Compagnie ' || x] WHEN 3 THEN [x] ELSE ['Sté. ' || x, 'Compagnie ' || x] END AS orgs
    FROM u
), p AS (
    SELECT year, person, firm, display, unnest(orgs) AS organisation, generate_subscripts(orgs, 1) AS o, roles FROM c WHERE roles IS NOT NULL
), q AS (
    SELECT year, person, firm, display, organisation, o, unnest(roles) AS role, generate_subscripts(roles, 1) AS r FROM p
), pos AS (
    SELECT *, row_number() OVER (PARTITION BY year, person ORDER BY firm, o, r) - 1 AS position FROM q
), places AS (
    SELECT year, person, 3 + (row_number() OVER (PARTITION BY year ORDER BY person) - 1) // {PAGE} AS page,
        (row_number() OVER (PARTITION BY year ORDER BY person) - 1) % {PAGE} AS place,
        EXISTS (SELECT 1 FROM pos WHERE pos.year = s.year AND pos.person = s.person) AS counts
    FROM (SELECT DISTINCT year, person FROM dense) s
), full_pages AS (
    SELECT year, page FROM places WHERE counts GROUP BY year, page HAVING count(*) >= 3
), mentions AS (
    SELECT year, page, place, position, CASE WHEN person % 3 = 2 THEN 'S.E.' END AS honorific,
        display || CASE person % 3 WHEN 0 THEN ' Bey' WHEN 1 THEN ' Pacha' ELSE '' END AS name, role, organisation, person, firm, display
    FROM pos JOIN places USING (year, person) JOIN full_pages USING (year, page)
)"""
_TABLE = (
    _NAMES
    + """, m AS (
    SELECT *, row_number() OVER (ORDER BY year, page, place, position) - 1 AS mention_id FROM mentions WHERE firm % 5 <> 3
), spelling AS (
    SELECT firm, organisation, count(DISTINCT year) AS n FROM m GROUP BY ALL
), best AS (
    SELECT firm, organisation AS company_label FROM spelling QUALIFY row_number() OVER (PARTITION BY firm ORDER BY n DESC, length(organisation) DESC, organisation) = 1
), people AS (
    SELECT person, format('P{:05d}', row_number() OVER (ORDER BY min(mention_id))) AS person_id FROM m GROUP BY person
), firsts AS (
    SELECT firm, min({'year': year, 'organisation': organisation}) AS first FROM m GROUP BY firm
), companies AS (
    SELECT firm, format('C{:05d}', row_number() OVER (ORDER BY first)) AS company_id FROM firsts
), aff_table AS (
    SELECT mention_id, year, person_id, display AS person_label, coalesce(honorific || ' ', '') || name AS person_printed,
        CASE person % 3 WHEN 0 THEN 'bey' WHEN 1 THEN 'pasha' END AS rank, CASE person % 3 WHEN 2 THEN 's.e.' END AS honorific,
        company_id, company_label, organisation AS company_printed, role, page AS source_page
    FROM m JOIN people USING (person) JOIN best USING (firm) JOIN companies USING (firm)
)"""
)

#: SQL that follows the affiliation view.
ON_VIEW = {
    "roster_mentions": _NAMES + " SELECT year, page, place, position, honorific, name, role, organisation FROM mentions",
    "affiliation_table": _TABLE + " SELECT * FROM aff_table",
    "rank_by_person": _TABLE + " SELECT person_id, max(rank) AS highest_rank, coalesce(string_agg(DISTINCT year || ':' || rank, ';' ORDER BY year || ':' || rank), '') AS rank_by_year FROM aff_table GROUP BY person_id",
}

#: SQL that stands alone.
ALONE = {
    "roster_section": """
WITH c AS (
    SELECT o_custkey AS custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS page, bool_or(o_orderstatus = 'O') AS heading, count(*) AS n FROM orders GROUP BY ALL
), r AS (
    SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY page) AS nth FROM c
), h AS (
    SELECT a.custkey, a.nth AS head, min(b.nth) AS start FROM r a JOIN r b ON b.custkey = a.custkey AND b.nth BETWEEN a.nth + 1 AND a.nth + 4 AND b.n >= 2 WHERE a.heading GROUP BY ALL
), s AS (
    SELECT custkey, min_by(start, head) AS start FROM h GROUP BY custkey
), g AS (
    SELECT custkey, page, nth, nth - lag(nth) OVER (PARTITION BY custkey ORDER BY nth) AS step FROM r WHERE n >= 2
), stops AS (
    SELECT s.custkey, s.start, min(g.nth) AS stop FROM s LEFT JOIN g ON g.custkey = s.custkey AND g.nth > s.start AND g.step > 3 GROUP BY ALL
)
SELECT x.custkey, min(g.page) AS first_page, max(g.page) AS last_page
FROM stops x JOIN g ON g.custkey = x.custkey AND g.nth >= x.start AND g.nth < coalesce(x.stop, 1000000000) GROUP BY x.custkey
""",
    "repaired_words": f"""
WITH terms AS (
    SELECT unnest({[w.replace("-", "") for w in repair.STRUCTURAL]}) AS plain, unnest({repair.STRUCTURAL}) AS term, unnest(range(0, {len(repair.STRUCTURAL)})) AS place
), t AS (
    SELECT p_partkey, plain AS t, CAST(floor(p_partkey / 19) AS BIGINT) % length(plain) AS hit, 'abcdefghilmnoprstuvxz'[p_partkey % 21 + 1] AS letter
    FROM part JOIN terms ON place = p_partkey % {len(repair.STRUCTURAL)}
), w AS (
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (t[1:hit] || letter || t[hit + 2:])[2:] ELSE t[1:hit] || letter || t[hit + 2:] END AS word FROM t
), pairs AS (
    SELECT word, term, place, translate(word, 'ltjfeoaumhkqwy', 'iiiicccnnnbgvv') AS a, translate(plain, 'ltjfeoaumhkqwy', 'iiiicccnnnbgvv') AS b
    FROM (SELECT DISTINCT word FROM w) JOIN terms ON abs(length(word) - length(term)) <= 2 AND length(word) >= 6
), scored AS (
    SELECT word, term, place, 200.0 * list_last(list_reduce(string_split(a, ''), lambda row, x: list_reduce(CAST(range(1, length(b) + 1) AS BIGINT[]),
        lambda new, j: CAST(list_append(new, CASE WHEN b[j] = x THEN row[j] + 1 ELSE greatest(row[j + 1], new[j]) END) AS BIGINT[]), CAST([0] AS BIGINT[])),
        CAST(list_transform(range(0, length(b) + 1), lambda z: 0) AS BIGINT[]))) / (length(a) + length(b)) AS score
    FROM pairs
), best AS (
    SELECT word, term AS found, score FROM scored WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, place) = 1
)
SELECT p_partkey, word, found, round(score, 6) AS score FROM w LEFT JOIN best USING (word)
""",
}
