"""Printed rosters at keys of large tables, and how their pages are dealt."""

import datetime

import duckdb

from interlace.operators import rosters
from interlace.plans import chain


def test_firms_of_large_keys_are_spelt(spark, tmp_path):
    firms = [1, 20926, 60000, 400000]
    day = datetime.datetime(1995, 5, 1)
    spark.createDataFrame([(1, 7, "F", day, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, f, "R") for f in firms], "l_orderkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    body = " ".join(r.body for r in chain.printed_volumes(spark, str(tmp_path)).collect())
    for f in firms:
        digits = str((f + 37) ** 3 * 1000003 % 999999999989).zfill(12)
        assert "".join(chain.FIRM[int(c)] for c in digits).capitalize() in body
    # as the SQL spells those that it can
    sql = "SELECT CAST((f + 37) * (f + 37) * (f + 37) * 1000003 % 999999999989 AS VARCHAR) FROM (SELECT CAST(20800 AS BIGINT) AS f)"
    assert duckdb.connect().execute(sql).fetchall()[0][0] == str(20837**3 * 1000003 % 999999999989)


def test_few_pages_keep_all_tasks_busy(spark):
    pages = spark.createDataFrame([(1, p, f"Marelli Guido{'abcdefgh'[p]}, Adm. Sté. Al Nour.") for p in range(8)], "year int, page int, body string")
    out = rosters.roster_entries(pages, "year")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.count() == 8
