"""The affiliation view: who sits on which board in which wave, over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOARD_ROLES = ("1-URGENT", "2-HIGH")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, person, firm, role, status and month of every returned line of an order."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_custkey").cast("long").alias("person"), F.col("l_suppkey").cast("long").alias("firm"), F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("status"), F.month("o_orderdate").cast("long").alias("month"))


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (year, person, firm) ties in a board role: the edges of the two-mode graph of each wave."""
    return affiliations(spark, sf_dir).where(F.col("role").isin(*BOARD_ROLES)).select("year", "person", "firm").distinct()


def sparse_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thinner graph of several components in each wave."""
    a = affiliations(spark, sf_dir).where("role = '1-URGENT' and status = 'F' and month = 3")
    return a.select("year", "person", "firm").distinct()


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person, rank, origin (one region counts as unknown) and political, from customers."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    origin = F.when(F.col("r_name") == "AFRICA", "unknown").otherwise(F.col("r_name"))
    return j.select(F.col("c_custkey").cast("long").alias("person"), F.col("c_mktsegment").alias("rank"), origin.alias("origin"), (F.col("c_acctbal") > 5000).alias("political"))


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """firm and sector, from suppliers."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_nationkey")
    return s.select(F.col("s_suppkey").cast("long").alias("firm"), F.when(k < 8, "finance").when(k < 14, "land").when(k < 18, "agriculture").otherwise("other").alias("sector"))
