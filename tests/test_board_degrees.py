"""Degrees from the members of common firms: as the projection has them, and without a row for each pair."""

import random

from interlace.operators import network
from interlace.plans.queries import QUERIES


def test_same_as_the_projection(spark):
    rng = random.Random(4)
    ties = {(y, rng.randrange(40), rng.randrange(25)) for y in (1, 2) for _ in range(90)} | {(3, 1, 1), (3, 2, 2), (3, 2, 3)}
    df = spark.createDataFrame(sorted(ties), "year long, person long, firm long")
    got = sorted(map(tuple, network.board_degrees(df, "person", "firm").collect()))
    assert got == sorted(map(tuple, network.degrees(network.projection(df, "person", "firm")).collect())) and len(got) > 50


def test_no_pairs_of_mates(spark):
    plan = QUERIES["degree"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1  # lines with their orders
