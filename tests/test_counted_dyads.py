"""Dyads without ties are counted, not made, wherever only sums of them are asked for."""

import random

import pytest
from pyspark.sql import functions as F

from interlace.operators import dyadic, network
from interlace.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def board(spark):
    rng = random.Random(5)
    rows = sorted({(y, rng.randrange(9), rng.randrange(7)) for y in (1, 2, 4) for _ in range(22)})
    who = [(p, ["x", "z", "unknown", None][p % 4], p % 3 == 0) for p in range(8)]  # one person is in no list
    return spark.createDataFrame(rows, "year long, person long, firm long"), spark.createDataFrame(who, "person long, origin string, political boolean")


def test_counts_are_those_of_the_rows(board):
    ties, who = board
    terms = ["person", "tie", "memory", "b1star2", "b2star2", "origin_match", "office"]
    tally = lambda df, cols, n: {tuple(r)[:-1]: r[-1] for r in df.groupBy(*cols).agg(n.alias("n")).where("n <> 0").collect()}
    assert tally(network.change_counts(ties, who), terms, F.sum("n")) == tally(network.change_statistics(ties, who), terms, F.count("*"))
    sizes = [ties.groupBy(F.col("year").alias("before"), k).agg(F.count("*").alias(n)) for k, n in (("person", "prior_seats"), ("firm", "prior_board"))]
    c = network.closure(ties).withColumn("before", F.when(F.col("year") == 4, 2).otherwise(1)).join(sizes[0], ["before", "person"]).join(sizes[1], ["before", "firm"])
    terms = ["year", "person", "prior_seats", "prior_board", "tie", "memory", "closure", "cycles"]
    assert tally(network.closure_counts(ties), terms, F.sum("n")) == tally(c, terms, F.count("*"))


def test_fits_of_counts_are_those_of_rows(board):
    ties, who = board
    one = lambda df: df.withColumn("edges", F.lit(1))
    x = ["edges", "memory", "b1star2"]
    a = dyadic.fit(one(network.change_statistics(ties, who)), x, "tie", "person", 6)
    b = dyadic.fit(one(network.change_counts(ties, who)), x, "tie", "person", 6, count="n")
    assert (a["rows"], a["ties"]) == (b["rows"], b["ties"]) and b["beta"][0] == pytest.approx(a["beta"][0], abs=1e-7)
    assert (a["settled"] == b["settled"]).all() and b["beta"][b["settled"]] == pytest.approx(a["beta"][a["settled"]], abs=1e-6)


@pytest.mark.parametrize("name", ["retention_by_office", "distance_table", "mple_score_equations", "closure_forms"])
def test_no_dyads_are_made_for_sums(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("dyads made")

    for f in ("dyads", "unmarked"):
        monkeypatch.setattr(network, f, none, raising=False)
    assert QUERIES[name](spark, SF).count() > 0


def test_the_pairs_of_the_grid_are_not_shuffled(board):
    persons, firms, marked, _ = network.at_risk(board[0])
    plan = network.unmarked(persons, firms, marked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(theirs") < plan.index("Join")  # pairs are made last
    assert network.dyads(board[0]).groupBy("year", "person", "firm").count().where("count > 1").count() == 0
