"""Quantiles, densities, joint tests and robust errors against direct computation; graphs and volumes as files."""

import itertools
import math
import os
import random
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from interlace.functions import companies
from interlace.operators import curves, stats
from interlace.sources import graphs


def loss(x, y, b, tau):
    r = y - x @ b
    return float((r * (tau - (r < 0))).sum())


def test_quantiles_reach_the_least_check_loss(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 6, 40)
    y = np.round(1 + 0.5 * a + rng.exponential(1 + a, 40), 2)
    x = np.stack([np.ones(40), a], 1)
    df = spark.createDataFrame([(1, int(v), float(o)) for v, o in zip(a, y, strict=True)] + [(1, None, 3.0), (1, 2, None)], "one int, a int, y double")
    levels = [0.25, 0.5, 0.9]
    got = curves.quantile_fit(df, ["one", "a"], "y", levels)
    for tau, b in zip(levels, got, strict=True):  # the linear programme has a solution through two of the points
        lines = [np.linalg.solve(x[[i, j]], y[[i, j]]) for i, j in itertools.combinations(range(40), 2) if a[i] != a[j]]
        assert loss(x, y, b, tau) == pytest.approx(min(loss(x, y, c, tau) for c in lines), rel=2e-4)
    groups = spark.createDataFrame([(1, g, float(v)) for g, vs in ((0, (1, 2, 4, 8, 9)), (1, (3, 5, 6, 7, 20))) for v in vs], "one int, g int, y double")
    table = {(r.level, r.term): r.estimate for r in curves.quantile_regression(groups, ["one", "g"], "y", (0.5,), 2).collect()}
    assert table == {(0.5, "one"): 4.0, (0.5, "g"): 2.0}


def test_densities_are_the_direct_sum(spark):
    rng = random.Random(1)
    rows = [("a", round(rng.gauss(0, 2) * 4) / 4) for _ in range(60)] + [("b", 1.0)] * 9 + [("c", 2.0), ("a", None)]
    got = curves.densities(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 0.25).collect()
    assert {r.g for r in got} == {"a"}  # no spread, and too few
    v = np.array([x for g, x in rows if g == "a" and x is not None])
    h = v.std(ddof=1) * len(v) ** -0.2
    for r in got:
        z = (r.point - v) / h
        assert r.density == pytest.approx(np.where(np.abs(z) <= 4, np.exp(-z * z / 2), 0).sum() / len(v) / h / math.sqrt(2 * math.pi), abs=2e-6)
    assert {r.point for r in got} == {p / 4 for p in range(int(v.min() * 4), int(v.max() * 4) + 1)}


def test_chi_square_tails():
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.344867, 3, 0.01), (18.307038, 10, 0.05), (0, 4, 1.0), (40, 2, math.exp(-20)), (1.5, 2, math.exp(-0.75))):
        assert curves.chi_square_tail(x, df) == pytest.approx(p, rel=1e-5)


def sandwich(x, y, g, link):
    b = np.zeros(x.shape[1])
    for _ in range(80):
        eta = x @ b
        if link == "cloglog":
            mu = 1 - np.exp(-np.exp(eta))
            d = np.exp(eta - np.exp(eta))
            w, s = d * d / (mu * (1 - mu)), (y - mu) * d / (mu * (1 - mu))
        elif link == "poisson":
            mu = np.exp(eta)
            w, s = mu, y - mu
        else:
            mu = 1 / (1 + np.exp(-eta))
            w, s = mu * (1 - mu), y - mu
        bread = np.linalg.inv((x * w[:, None]).T @ x)
        b = b + bread @ (x.T @ s)
    scores = np.stack([(x * s[:, None])[g == c].sum(0) for c in np.unique(g)])
    n = len(scores)
    return b, bread @ scores.T @ scores @ bread * n / (n - 1)


@pytest.mark.parametrize("link", ["logit", "poisson", "cloglog"])
def test_clustered_errors_and_joint_tests(spark, link):
    rng = np.random.default_rng(5)
    g, a, c = rng.integers(0, 25, 300), rng.normal(size=300).round(2), rng.integers(0, 2, 300)
    y = rng.poisson(np.exp(0.2 + 0.3 * a)) if link == "poisson" else (rng.random(300) < 1 / (1 + np.exp(0.5 - a))).astype(int)
    df = spark.createDataFrame([(int(i), 1.0, float(u), float(v), float(o)) for i, u, v, o in zip(g, a, c, y, strict=True)], "g int, one double, a double, c double, y double")
    b, cov = sandwich(np.stack([np.ones(300), a, c], 1), y, g, link)
    got = stats.glm(df, ["one", "a", "c"], "y", "g", link).collect()
    assert [r.estimate for r in got] == pytest.approx(b, abs=3e-6) and [r.error for r in got] == pytest.approx(np.sqrt(np.diag(cov)), abs=3e-6)
    test = stats.wald_tests(df, ["one", "a", "c"], "y", "g", {"both": ["a", "c"]}, link).first()
    chi2 = b[1:] @ np.linalg.inv(cov[1:, 1:]) @ b[1:]
    assert test.chi2 == pytest.approx(chi2, rel=1e-4) and test.df == 2 and test.p == pytest.approx(math.exp(-chi2 / 2), abs=2e-6)


def files(folder, year):
    part = [f for f in os.listdir(f"{folder}/year={year}") if f.startswith("part-")]
    assert len(part) == 1
    return ET.parse(f"{folder}/year={year}/{part[0]}").getroot()


def test_graphs_are_read_back_by_an_xml_parser(spark, tmp_path):
    nodes = spark.createDataFrame([(1932, "P1", 'Ali & "Sons" <x>\n', ["a", "b"]), (1932, "C1", None, None), (1938, "P2", "é", [])], "year int, id string, label string, waves array<string>")
    edges = spark.createDataFrame([(1932, "P1", "C1", 2), (1950, "P9", "C9", 1)], "year int, a string, b string, weight int")
    for form, node, edge in (("gexf", "node", "edge"), ("graphml", "node", "edge")):
        folder = f"{tmp_path}/{form}"
        graphs.write_graphs(nodes, edges, folder, form)
        assert {d for d in os.listdir(folder) if d.startswith("year")} == {"year=1932", "year=1938"}
        one = files(folder, 1932)
        found = {n.get("id"): [x.get("value") if form == "gexf" else (x.text or "") for x in n.iter() if x.tag.endswith(("attvalue", "data"))] for n in one.iter() if n.tag.endswith("}" + node)}
        assert found == {"P1": ['Ali & "Sons" <x>\n', "a;b"], "C1": ["", ""]}
        ends = [(e.get("source"), e.get("target")) for e in one.iter() if e.tag.endswith("}" + edge)]
        assert ends == [("P1", "C1")] and not [e for e in files(folder, 1938).iter() if e.tag.endswith("}" + edge)]
    with pytest.raises(ValueError, match="no such form"):
        graphs.write_graphs(nodes, edges, f"{tmp_path}/x", "dot")


def test_hand_off_tables(spark, tmp_path):
    ties = spark.createDataFrame([(1, 7, 9), (2, 7, 8)], "year int, person int, firm int")
    graphs.hand_off(ties, spark.createDataFrame([(7, "x,y")], "person int, origin string"), spark.createDataFrame([(9, "land")], "firm int, sector string"), str(tmp_path))
    back = {n: {tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/{n}").collect()} for n in ("edges", "persons", "firms")}
    assert back == {"edges": {("1", "7", "9"), ("2", "7", "8")}, "persons": {("1", "7", "x,y"), ("2", "7", "x,y")}, "firms": {("1", "9", "land"), ("2", "8", None)}}


def test_volumes_on_disk(spark, tmp_path):
    for name, text in (("volume_1932.txt", "<<<PAGE 1>>>a\nb"), ("volume_1932.pdf", "%PDF"), ("volume_1938.pdf", "%PDF-1"), ("notes.txt", "no")):
        (tmp_path / name).write_text(text)
    got = {r.year: (r.form, r.bytes) for r in graphs.listing(spark, str(tmp_path), [1932, 1938, 1942]).collect()}
    assert got == {1932: ("txt", 15), 1938: ("pdf", 6), 1942: (None, None)}
    assert [tuple(r) for r in graphs.read_volumes(spark, str(tmp_path), [1932]).collect()] == [(1932, "<<<PAGE 1>>>a\nb")]
    with pytest.raises(FileNotFoundError, match="1938, 1942"):
        graphs.read_volumes(spark, str(tmp_path), [1932, 1938, 1942])


def test_companies_over_pages(spark):
    pages = [
        (1, 1, "front matter\nGREEN MILLS S.A.\nSiège social : Port-Saïd\nPrésident : Omar Bey"),
        (1, 2, None),
        (1, 3, "Censeur : Klein\nCAPITAL : L.E. 5\nNOT A COMPANY\nprose only\nBLUE BANK\nConseil d'Administration :\nnobody yet"),
        (2, 1, "RED LAND CY\nAdministrateurs-Délégués : A. Stone; B. Stone"),
    ]
    rows = companies.company_records(spark.createDataFrame(pages, "v int, page int, body string"), "v").orderBy("v", "block").collect()
    assert [(r.v, r.page, r.name, r.city) for r in rows] == [(1, 1, "GREEN MILLS S.A", "Port Said"), (1, 3, "BLUE BANK", None), (2, 1, "RED LAND CY", None)]
    assert [[(b.role, b.display, b.rank) for b in r.board] for r in rows] == [[("president", "Omar", "bey"), ("auditor", "Klein", None)], [], [("managing_director", "A. Stone", None), ("managing_director", "B. Stone", None)]]
    assert (rows[0].currency, rows[0].amount) == ("LE", 5.0)
