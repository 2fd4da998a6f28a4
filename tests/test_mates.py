"""Measures of projections from the ties themselves, against those from the edges, and fits whose rows are made once."""

import random

import pytest
from pyspark.sql import functions as F

from interlace.operators import network, stats
from interlace.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_burt_and_open_share_without_paths(spark):
    rng = random.Random(6)
    rows = sorted({(y, rng.randrange(15), rng.randrange(9)) for y in (1, 2) for _ in range(32)} | {(3, 1, 1), (3, 2, 1), (4, 1, 1)})
    ties = spark.createDataFrame(rows, "year long, person long, firm long")
    edges = network.projection(ties, "person", "firm")
    for new, old in ((network.burt, network.constraint_and_size), (network.open_pairs, network.open_share)):
        got, want = ({tuple(r)[:2]: tuple(r)[2:] for r in df.collect()} for df in (new(ties, "person", "firm"), old(edges)))
        assert got.keys() == want.keys() and len(got) > 20
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=2e-6) if None not in v else got[k] == v


@pytest.mark.parametrize("name", ["burt_and_effective_size_whole", "open_share_whole", "returns_to_brokerage"])
def test_queries_walk_no_edges(spark, monkeypatch, name):
    def none(*_):
        raise AssertionError("edges doubled")

    monkeypatch.setattr(network, "both_ways", none)
    assert QUERIES[name](spark, SF).count() > 0


def test_a_fit_makes_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i % 10, 1.0, float(i % 3), float(i % 2)) for i in range(60)], "c long, one double, x double, y double").mapInArrow(seen, "c long, one double, x double, y double")
    stats.glm(df, ["one", "x"], "y", "c").collect()
    assert read.value == 60


def test_a_unit_draws_once_for_its_rows(spark):
    df = spark.createDataFrame([(y, p, p + y) for y in (1, 2, 3) for p in range(9)], "year long, person long, v long")
    plan = stats.bootstrap_mean(df, ["year"], "person", "v", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline(rows" in plan
    assert stats.bootstrap_mean(df, ["year"], "person", "v", 20).where(F.col("n") == 9).count() == 3


def test_expected_closure_makes_pairs_last(spark, monkeypatch):
    def none(*_):
        raise AssertionError("the grid was joined again")

    monkeypatch.setattr(network, "closure", none)
    assert QUERIES["closure_expected"](spark, SF).count() > 0
