"""Queries by similarity and by ranges, each with its SQL for the oracle where results are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.intervals import band_join, overlap_join
from tidewater.operators.similarity import similar
from tidewater.sources.tables import table


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for each whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return similar(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def open_order_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders that are open at one time: from the order's date to the last shipping date of its lines."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("opened")).join(last, "o_orderkey")
    pairs = overlap_join(orders, orders, ("opened", "closed"), ("opened", "closed"), ("o_custkey",), suffix="_2")
    pairs = pairs.where(F.col("o_orderkey") < F.col("o_orderkey_2"))
    days = F.timestamp_diff("DAY", F.greatest("opened", "opened_2"), F.least("closed", "closed_2"))
    return pairs.select("o_custkey", F.col("o_orderkey").alias("order_1"), F.col("o_orderkey_2").alias("order_2"), days.alias("days_both_open"))


def prices_near_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the lines of any order whose price is within a cent of the order's total: a band join without an equality."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    cent = F.lit("0.01").cast("decimal(18,2)")
    wide = orders.withColumns({"low": F.col("total") - cent, "high": F.col("total") + cent})
    found = overlap_join(wide, lines, ("low", "high"), ("price", "price"), unit=0.02)
    return found.select("o_orderkey", "l_orderkey", "l_linenumber", "l_partkey", (F.col("price") - F.col("total")).cast("double").alias("off_by"))


def shipped_while_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the lines of the same part as one of its own that others had shipped within three days of it, or null."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.unix_date(F.col("l_shipdate").cast("date")).alias("day"))
    found = band_join(lines, lines, "day", "day", 3, 3, ("l_partkey",), "left", "_2")
    other = F.when(F.col("l_orderkey") != F.col("l_orderkey_2"), 1)
    return found.groupBy("l_orderkey").agg(F.count(other).alias("n_near"), F.count_distinct(F.when(other == 1, F.col("l_orderkey_2"))).alias("n_orders_near"))


QUERIES = {
    "similar_vectors": similar_vectors,
    "open_order_overlaps": open_order_overlaps,
    "prices_near_totals": prices_near_totals,
    "shipped_while_open": shipped_while_open,
}

ORACLE: dict[str, str] = {
    "open_order_overlaps": """
        with o as (select o_custkey, o_orderkey, o_orderdate as opened, max(l_shipdate) as closed
                   from orders join lineitem on l_orderkey = o_orderkey group by all having max(l_shipdate) >= o_orderdate)
        select a.o_custkey, a.o_orderkey as order_1, b.o_orderkey as order_2,
               datesub('day', greatest(a.opened, b.opened), least(a.closed, b.closed)) as days_both_open
        from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.opened <= b.closed and b.opened <= a.closed""",
    "prices_near_totals": """
        with o as (select o_orderkey, cast(o_totalprice as decimal(18,2)) as total from orders),
        l as (select l_orderkey, l_linenumber, l_partkey, cast(l_extendedprice as decimal(18,2)) as price from lineitem)
        select o_orderkey, l_orderkey, l_linenumber, l_partkey, cast(price - total as double) as off_by
        from o join l on price between total - 0.01 and total + 0.01""",
    "shipped_while_open": """
        with l as (select l_orderkey, l_partkey, cast(l_shipdate as date) as day from lineitem)
        select a.l_orderkey, count(*) filter (where a.l_orderkey <> b.l_orderkey) as n_near,
               count(distinct b.l_orderkey) filter (where a.l_orderkey <> b.l_orderkey) as n_orders_near
        from l a left join l b on a.l_partkey = b.l_partkey and b.day between a.day - 3 and a.day + 3
        group by a.l_orderkey""",
}
