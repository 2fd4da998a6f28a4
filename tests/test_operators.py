"""Toy graphs and texts with results worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from interlace.functions import text
from interlace.operators import network, panel, stats

KEYS = ["ashil ruseau", "ahmed bor", ""]
TIES = [(t, p, f) for t in (1, 2) for p, f in ((1, 1), (2, 1), (4, 1), (2, 2), (3, 3))]


def ties(spark, rows=TIES):
    return spark.createDataFrame(rows, "year long, person long, firm long")


def test_closure_and_distance(spark):
    got = {(r.person, r.firm): r.closure for r in network.closure(ties(spark)).collect()}
    assert got[1, 2] == 1 and got[1, 1] == 0 and got[3, 1] == 0


def test_open_share(spark):
    got = {r.node: r.open_share for r in network.open_share(network.projection(ties(spark), "person", "firm")).where("year = 1").collect()}
    assert got == {1: 0.0, 2: 0.0, 4: 0.0}


def test_change_statistics(spark):
    who = spark.createDataFrame([(1, "x", True), (2, "x", False)], "person long, origin string, political boolean")
    rows = [(t, p, f) for t in (1, 2) for p, f in ((1, 1), (1, 2), (2, 1))]
    got = {(r.person, r.firm): (r.b1star2, r.b2star2, r.origin_match) for r in network.change_statistics(ties(spark, rows), who).collect()}
    assert got[1, 1] == (1, 1, 1) and got[2, 1][1] == 1 and got[2, 2] == (1, 1, 1) and got[1, 2][2] == 0


def test_only_the_broker_lies_between(spark):
    got = {r.node: r.betweenness for r in network.centralities(ties(spark, [(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 3, 2)])).collect()}
    assert got[2] > 0 and got[4] == got[6] == 0


def test_life_table(spark):
    risk = spark.createDataFrame([(1, int(i < 10)) for i in range(20)] + [(2, int(i < 2)) for i in range(10)], "tenure long, exit long")
    assert [(r.hazard, r.survival) for r in panel.life_table(risk).orderBy("tenure").collect()] == [(0.5, 0.5), (0.2, 0.4)]


def test_gap_finds_a_planted_effect_and_no_other(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), bool(i % 2), float(rng.normal() + 5 * (i % 3)), int(i)) for i in range(600)]
    d = spark.createDataFrame(rows, "cell int, g boolean, y double, id long")
    assert abs(stats.stratified_gap(d, ["cell"], "g", "y").first().gap) < 0.3
    hit = stats.permutation_null(d.withColumn("y", F.col("y") + F.col("g").cast("double")), ["cell"], "g", "y", ["id"]).first()
    assert hit.gap > 0.7 and hit.p == 0


def test_logit_recovers_coefficients(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(0.5 + x)))
    d = spark.createDataFrame([(1.0, float(a), float(b), i % 300) for i, (a, b) in enumerate(zip(x, y, strict=True))], "one double, x double, y double, c long")
    got = {r.term: r.estimate for r in stats.glm(d, ["one", "x"], "y", "c").collect()}
    assert abs(got["one"] - 0.5) < 0.2 and abs(got["x"] - 1) < 0.2


def test_names(spark):
    d = spark.createDataFrame([("Achille Rousseau",), ("Ahmed de Bohor",), ("",)], "n string")
    assert [r.k for r in d.select(text.name_key(F.col("n")).alias("k")).collect()] == KEYS
    assert text.distance("abc", "abc") == 0 and text.distance("", "a") == 1 and abs(text.distance("bill", "bi1l") - 0.075) < 1e-9 and abs(text.distance("bill", "bizl") - 0.25) < 1e-9
    assert text.indel_ratio("abcd", "abd") > 85


def test_empty_input_keeps_its_schema(spark):
    none = ties(spark, [])
    for f in (panel.seats_per_person, panel.risk_set, network.transitions, network.brokerage_outcomes, network.summary):
        assert f(none).count() == 0
