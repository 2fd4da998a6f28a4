"""Register reading and linkage on small fixtures, against brute force where rules interact."""

import itertools
import random

from pyspark.sql import functions as F

from interlace.functions import registers, text
from interlace.functions.text import distance, indel_ratio
from interlace.operators import linkage

NAMES = ["alpha mining", "alpha minning", "alfa mining", "delta bank", "delta banc", "delta banco", "omega", "", "omega land works", "omega lend works"]


def test_scan_candidates_are_all_pairs_above_the_ratio(spark):
    got = {tuple(r) for r in linkage.scan_candidates(spark.createDataFrame([(n,) for n in NAMES + NAMES], "k string")).collect()}
    names = sorted({n for n in NAMES if n})
    assert got == {(a, b) for a, b in itertools.combinations(names, 2) if indel_ratio(a, b) >= 80}


def test_complete_linkage_does_not_chain(spark):
    names = ["aaaaaaaaaa", "aaaaaaaabb", "aaaaaabbbb"]
    assert distance(names[0], names[1]) <= 0.3 < distance(names[0], names[2])
    pairs = spark.createDataFrame([(names[0], names[1], 0.2), (names[1], names[2], 0.2)], "a string, b string, distance double")
    got = dict(map(tuple, linkage.complete_linkage(pairs, spark.createDataFrame([(n,) for n in names], "k string")).collect()))
    assert got == {names[0]: names[0], names[1]: names[0], names[2]: names[2]}


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(60)], "node string")
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(49)], "a string, b string")
    got = dict(map(tuple, linkage.components(nodes, links).collect()))
    assert all(got[f"{i:03d}"] == ("000" if i < 50 else f"{i:03d}") for i in range(60))


def test_initials_gate_and_subset(spark):
    names = spark.createDataFrame([("karl marten",), ("k marten",), ("hugo marten",), ("marten",), ("karl otto marten",)], "name_key string")
    got = {tuple(r) for r in linkage.accepted(linkage.blocked_pairs(names)).collect()}
    assert ("karl marten", "karl otto marten") in got and ("hugo marten", "karl marten") not in got
    assert ("karl marten", "marten") in got


def test_labelled_fields_and_money(spark):
    df = spark.createDataFrame([("Seat : Cairo\nCapital : L.E. 1 250 000",), ("nothing",), (None,)], "t string")
    got = df.select(registers.field(F.col("t"), "Seat"), registers.money(registers.field(F.col("t"), "Capital"))).collect()
    assert got[0][0] == "Cairo" and tuple(got[0][1]) == ("LE", 1250000.0)
    assert got[1][0] is None and got[2][0] is None
    printed = {"L.E. 500,000": ("LE", 500000.0), "£E 5": ("LE", 5.0), "P.T. 40": ("PT", 40.0), "£ 1.200": ("GBP", 1200.0), "Fr. 7'500": ("FRF", 7500.0), "none": (None, None)}
    rows = spark.createDataFrame([(k,) for k in printed], "t string").select("t", registers.money(F.col("t")).alias("m")).collect()
    assert {r.t: tuple(r.m) for r in rows} == printed


def test_scanned_company_names(spark):
    names = ["Minet Valley Collan Co", "Minet Valley Cotton Co", "Minet Va lley Cotton Company Ltd", "Minet Valley Land Co", "Port Harbour Insurance", "Port Harbour Life Insurance", "The Co. Ltd."]
    rows = {r.n: r for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.skeleton(F.col("n")).alias("s"), text.company_letters(F.col("n")).alias("l"), text.company_tokens(F.col("n")).alias("t")).collect()}
    assert rows[names[0]].s == rows[names[1]].s == rows[names[2]].s != rows[names[3]].s
    assert rows[names[2]].l == "minetvalleycotton"[:7] + "lleycotton" and rows[names[6]].l == ""
    far = lambda a, b: distance(rows[a].l, rows[b].l)
    assert far(names[0], names[1]) < 0.1 < 0.2 < far(names[1], names[3])
    assert far(names[4], names[5]) <= 0.2 and text.extra_word(rows[names[4]].t, rows[names[5]].t) and not text.extra_word(rows[names[0]].t, rows[names[1]].t)
    firms = spark.createDataFrame([(r.s, r.l, r.t) for n, r in rows.items() if r.l], "k string, letters string, tokens array<string>").dropDuplicates(["k"])
    near = {frozenset((r.a, r.b)) for r in linkage.confirmed(linkage.scan_candidates(firms), firms).collect()}
    assert not any({rows[names[4]].l, rows[names[5]].l} == pair or {rows[names[1]].l, rows[names[3]].l} == pair for pair in near)


def test_distance_is_the_textbook_recurrence():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("ilcoen1t") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        d = [[max(i, j) + 0.0 if 0 in (i, j) else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost = 0.0 if a[i - 1] == b[j - 1] else 0.3 if frozenset((a[i - 1], b[j - 1])) in text.CHEAP else 1.0
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + cost)
        assert abs(distance(a, b) - d[-1][-1] / max(len(a), len(b))) < 1e-9


def test_bare_clauses_inherit_and_others_go(spark):
    df = spark.createDataFrame([(1, "Director of Alpha; de Beta; banker; Auditor Gamma")], "k long, t string")
    got = [tuple(r) for r in registers.clauses(df, "k", "t", (("director", "Director"), ("auditor", "Auditor"))).orderBy("clause").collect()]
    assert got == [(1, 0, "director", "Alpha"), (1, 1, "director", "Beta"), (1, 3, "auditor", "Gamma")]


def test_former_needs_every_mention(spark):
    df = spark.createDataFrame([(1, "ex minister"), (2, "ex minister, minister"), (3, "prime ministerial hat"), (4, None)], "k long, t string")
    got = {tuple(r) for r in registers.offices(df, "k", "t", (("cabinet", "minister"),), "ministerial", "(?:ex) ").collect()}
    assert got == {(1, "cabinet", True), (2, "cabinet", False)}


def test_pages_and_ranks(spark):
    v = spark.createDataFrame([(1, "head<<<PAGE 7>>> a <<<PAGE 8>>>b"), (2, "none"), (3, None)], "k long, t string")
    assert [tuple(r) for r in registers.pages(v, "k", "t").orderBy("page").collect()] == [(1, 7, "a"), (1, 8, "b")]
    n = spark.createDataFrame([("Ali Bey Pasha",), ("Bey",), ("Omar",)], "n string")
    assert [tuple(r[0]) for r in n.select(registers.person_name(F.col("n"))).collect()] == [("Ali", "bey"), ("Bey", None), ("Omar", None)]


def test_forms_of_ranks(spark):
    printed = ["Ali Sadek Pacha", "Omar BACHA.", "Hassan Beik", "Riad Bek Pacha", "Nessim Effendy", "Murad Agha", "Agha Khan", "Zaki", None]
    got = [tuple(r[0]) for r in spark.createDataFrame([(n,) for n in printed], "n string").coalesce(1).select(registers.person_name(F.col("n"))).collect()]
    assert got == [("Ali Sadek", "pasha"), ("Omar", "pasha"), ("Hassan", "bey"), ("Riad", "bey"), ("Nessim", "effendi"), ("Murad", "agha"), ("Agha Khan", None), ("Zaki", None), (None, None)]
