"""Resampling draws as often as the reference."""

import duckdb
import pytest

from interlace.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_permutation_null_draws_two_thousand_times(spark):
    assert QUERIES["permutation_null"](spark, SF).first().draws == 2000


def test_bootstrap_of_two_thousand_replicates(spark):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = ORACLES["bootstrap_mean"]
    assert sql.count("range(1, 51)") == 1
    want = db.execute(sql.replace("range(1, 51)", "range(1, 2001)")).df().sort_values(["year", "political"])
    got = QUERIES["bootstrap_mean_2000"](spark, SF).toPandas()[list(want.columns)].sort_values(["year", "political"])
    assert got.astype(float).to_numpy() == pytest.approx(want.astype(float).to_numpy(), abs=2e-6)
