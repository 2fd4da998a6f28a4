"""Entries of a roster as printed: names, roles, clauses, joined lines, repaired words."""

import random

import pytest
from pyspark.sql import functions as F

from interlace.functions import entries, repair
from interlace.functions.text import indel_ratio
from interlace.operators import rosters


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column(F.col("t"))).first()[0]


def positions(spark, entry):
    pages = spark.createDataFrame([(1, 1, entry)], "year int, page int, body string")
    return [(p.role, p.organisation, p.firm) for r in rosters.roster_entries(pages, "year").collect() for p in r.positions]


@pytest.mark.parametrize(
    ("entry", "want"),
    [
        ("Marelli Guido Bey, Directeur Général de la S. A. du Canal Vert.", [("general_manager", "S. A. du Canal Vert")]),
        ("Marelli, Guido, Administrateur de la S.A. du Delta.", [("director", "S.A. du Delta")]),
        ("Marelli, G., Administrateur-Délégué de la Banque Verte.", [("managing_director", "Banque Verte")]),
        ("Hassan Omar Aly, Adm. Sté. Al Nour pour la Laine.", [("director", "Sté. Al Nour pour la Laine")]),
        ("Stone Henry, Président du Conseil d'Administration de The New Harbour Cy.", [("president", "The New Harbour Cy")]),
        ("Stone Henry, Président du Conseil d'Administration et Administrateur-Délégué de The Harbour Hotels Ltd.", [("president", "The Harbour Hotels Ltd"), ("managing_director", "The Harbour Hotels Ltd")]),
        ("Stone Henry, Membre du Conseil d'Administration de The Harbour Water Cy; de la Filature du Nord.", [("director", "The Harbour Water Cy"), ("director", "Filature du Nord")]),
        ("Stone Henry, banquier; de la Filature du Nord; rentier.", []),
        ("Stone Henry, Adm. de la Filature du Nord et de la Banque du Sud; Censeur: Union", [("director", "Filature du Nord"), ("director", "Banque du Sud")]),
        ("Klein Jules, Membre du Tribunal de Tanta.", [("member", "Tribunal de Tanta")]),
        ("Klein Jules, Directeur de l'Administration des Douanes.", [("manager", "Administration des Douanes")]),
        ("Klein Jules, Adrninistrateur de la Ban que du Nord, Le Caire.", [("director", "Banque du Nord")]),
    ],
)
def test_positions(spark, entry, want):
    got = positions(spark, entry)
    assert [p[:2] for p in got] == want
    assert all(p[2] == (not p[1].startswith(("Tribunal", "Administration"))) for p in got)


def test_names(spark):
    parts = lambda t: tuple(one(spark, entries.entry_parts, t))
    assert parts("Omar, Hassan (Bey), Membre de X.") == (None, "Omar Hassan Bey", "Membre de X.")
    assert parts("S. E. Omar, Hassan, Membre de X.") == ("S. E.", "Omar Hassan", "Membre de X.")
    assert parts("Omar Hassan, Adm. Sté. X, Y.") == (None, "Omar Hassan", "Adm. Sté. X, Y.")
    assert parts("Omar, Hassan (Pacha),Sénateur, Membre de X.") == (None, "Omar Hassan Pacha", "Sénateur, Membre de X.")
    assert parts("Chevalier Guido ancien ministre, Membre de X.")[1] == "Chevalier Guido"
    assert one(spark, entries.entry_parts, "no entry here") is None
    for name in ("Copper Works", "Enterprise & Development Co", "Land Cy", "Textile", "Propriétaire National Hotel", "a word", "Al"):
        assert not one(spark, entries.like_person, name), name
    for name in ("Marelli Guido Bey", "Omar", "Klein Jules", "Abou el Nour"):
        assert one(spark, entries.like_person, name), name


def test_person(spark):
    who = lambda t: tuple(one(spark, entries.person, t))
    assert who("S.E. Omar Hassan Bey Pacha") == ("Omar Hassan", "bey", "s.e.", "omar hasan", "hasan")
    assert who("Omar Effendy.") == ("Omar", "effendi", None, "omar", "omar")
    assert who("Bek") == ("", "bey", None, "", "")
    assert who("Dr. Zoë d'Agha") == ("Zoë d'Agha", None, "dr.", "zo agha", "agha")
    assert one(spark, entries.person, None).key is None


def test_lines_are_joined(spark):
    text = "12 ANNUAIRE DES SOCIÉTÉS ÉGYPTIENNES PAR ACTIONS\nA\n\nMarelli Guido, Administrateur de la Na\ntional Mills Cy.\n 17 \nOmar, Hassan, Membre du Conseil\nd'Administration de The Mills;\nCopper Works, Adm. de X.\n"
    assert one(spark, entries.joined_entries, text) == ["Marelli Guido, Administrateur de la National Mills Cy.", "Omar, Hassan, Membre du Conseil d'Administration de The Mills; Copper Works, Adm. de X."]
    assert one(spark, entries.joined_entries, "") == [] and one(spark, entries.joined_entries, "no\nentry") == []
    assert one(spark, entries.joined_entries, None) is None


def test_mended_words(spark):
    assert one(spark, entries.mend_words, "de Ia Ban que de CRÉDIT, So ciété") == "de la Banque de Crédit, Société"


def test_sections(spark):
    page = lambda v, p, heading, n: (v, p, heading, n)
    rows = [page(1, p, p in (1, 30), 5 if p in (4, 5, 8, 12) else 2) for p in range(1, 41)]  # a run broken by three pages
    rows += [page(2, p, p == 1, 9 if p >= 12 else 0) for p in range(1, 20)]  # too far from the heading
    rows += [page(3, p, p in (1, 11), 9 if p >= 12 else 0) for p in range(1, 20)]
    got = {tuple(r) for r in rosters.section(spark.createDataFrame(rows, "v int, page int, heading boolean, n long"), "v").collect()}
    assert got == {(1, 4, 8), (3, 12, 19)}


def test_nearest_words_are_those_of_brute_force(spark):
    rng = random.Random(4)
    damage = []
    for _ in range(150):
        w = list(rng.choice(repair.STRUCTURAL).replace("-", ""))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = rng.choice(["", "l", "e", "rn", "x", "n"])
        damage.append("".join(w))
    words = spark.createDataFrame([(w,) for w in [*damage, *damage[:5], "", None, "achille", "x" * 40]], "word string")
    terms = spark.createDataFrame(list(enumerate(repair.STRUCTURAL)), "place int, term string")
    skeletons = {r.word: r.s for r in words.union(terms.select("term")).distinct().select("word", repair.word_skeleton(F.col("word")).alias("s")).collect()}
    want = {}
    for w in {w for w in damage + ["achille"] if len(w) >= 6}:
        near = [(indel_ratio(skeletons[w], skeletons[t]), -i, t) for i, t in enumerate(repair.STRUCTURAL) if abs(len(t) - len(w)) <= 2]
        if near and max(near)[0] >= 85:
            want[w] = (max(near)[2], round(max(near)[0], 6))
    got = {r.word: (r.found, round(r.score, 6)) for r in repair.nearest(words, terms).collect()}
    assert got == want and len(want) > 50


def test_repair_keeps_case_and_rows(spark):
    rows = [(1, "CONSElL et Dirccteur, d'Adminislration"), (1, "CONSElL et Dirccteur, d'Adminislration"), (2, None), (3, "Zamalek"), (4, "")]
    terms = spark.createDataFrame(list(enumerate(repair.STRUCTURAL)), "place int, term string")
    got = sorted((tuple(r) for r in repair.repaired(spark.createDataFrame(rows, "k int, t string"), "t", terms).collect()), key=str)
    fixed = "Conseil et Directeur, d'Administration"
    assert [g[1] for g in got] == [fixed, fixed, None, "Zamalek", ""]
