"""Names without a key, and spellings whose letters are none, are not one entity."""

from interlace.operators import linkage, rosters


def test_names_without_a_key_stay_apart(spark):
    rows = [(1, "123", ""), (2, "45 6", ""), (3, "...", ""), (4, "Omar Hassan", "omar hasan"), (5, "Hassan", "hasan"), (6, "O. Hassan", "hasan"), (7, "7", None)]
    got = {r.id: r.root for r in linkage.person_roots(spark.createDataFrame(rows, "id long, name string, key string"), "key", "id").collect()}
    assert len(got) == 7 and len({got[i] for i in (1, 2, 3, 7)}) == 4 and got[4] == got[5] == got[6] not in {got[i] for i in (1, 2, 3, 7)}


def test_firms_of_stopwords_stay_apart(spark):
    names = ["The Co. Ltd.", "Egypt Company", "Societe", "Cie Limited d Egypte", "...", "!", "Minet Collan Co", "Minet Cotton Co"]
    got = {r.name: r.root for r in linkage.company_roots(spark.createDataFrame([(n,) for n in names * 2], "name string"), "name").collect()}
    assert got["Minet Collan Co"] == got["Minet Cotton Co"] and len(set(got.values())) == len(names) - 1


def test_affiliations_of_a_few_mentions(spark):
    rows = [
        (1932, 1, 0, 0, "S.E. Omar Hassan Bey", "Minet Cotton Co", "director"), (1938, 1, 0, 0, "Omar Hassan Pacha", "The Minet Collan Co", "president"),
        (1938, 1, 1, 0, "O. Hassan", "Banque Verte", "auditor"), (1938, 1, 2, 0, "Klein Jules", "Banque Verte", "auditor"), (1938, 1, 2, 1, "...", "Societe", "auditor"),
    ]
    mentions = spark.createDataFrame(rows, "year int, page int, place int, position int, printed string, organisation string, role string")
    got = [tuple(r)[:6] + (r.honorific, r.company_id, r.company_label) for r in rosters.affiliation_table(mentions).orderBy("mention_id").collect()]
    assert [g[2] for g in got] == ["P00001", "P00001", "P00001", "P00002", "P00003"] and {g[3] for g in got[:3]} == {"Omar Hassan"}
    assert [g[5] for g in got] == ["bey", "pasha", None, None, None] and [g[6] for g in got] == ["s.e.", None, None, None, None]
    assert got[0][7] == got[1][7] and got[0][8] == "The Minet Collan Co" and got[2][7] == got[3][7] != got[4][7]
    ranks = {r.person_id: (r.highest_rank, dict(r.rank_by_year)) for r in rosters.highest_rank(rosters.affiliation_table(mentions)).collect()}
    assert ranks == {"P00001": ("pasha", {1932: "bey", 1938: "pasha"}), "P00002": (None, {}), "P00003": (None, {})}
    assert rosters.affiliation_table(mentions.limit(0)).count() == 0


def test_mentions_of_pages_without_entries(spark):
    pages = spark.createDataFrame([(1, 1, None), (1, 2, ""), (2, 1, "nomenclature\nno entries")], "year int, page int, body string")
    assert rosters.roster_mentions(pages, "year").count() == 0 and rosters.roster_mentions(pages.limit(0), "year").count() == 0
