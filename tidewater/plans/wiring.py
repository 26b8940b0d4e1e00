"""Queries over the relational tables, each with its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.asof import asof_last
from tidewater.sources.tables import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by return flag and line status. Inputs are cast to decimal first: sums of doubles depend on their order."""
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    shipped = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.sum(price).cast("double").alias("sum_base"),
        F.sum(price * (1 - discount)).cast("double").alias("sum_disc"),
        F.count("*").alias("n"),
    )


def purchase_after_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest view event of the same user."""
    events = table(spark, sf_dir, "events")
    kind = lambda k: events.where(F.col("event_type") == k).select("event_id", "user_id", "ts")
    return asof_last(kind("purchase"), kind("view"), "user_id", "ts", "event_id", "prev_id").select("event_id", "prev_id")


QUERIES = {"pricing_summary": pricing_summary, "purchase_after_view": purchase_after_view}

ORACLE = {
    "pricing_summary": """
        select l_returnflag, l_linestatus,
               cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty,
               cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_base,
               cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as sum_disc,
               count(*) as n
        from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00'
        group by l_returnflag, l_linestatus""",
    "purchase_after_view": """
        select p.event_id, v.event_id as prev_id
        from (select * from events where event_type = 'purchase') p
        asof left join (select * from events where event_type = 'view') v
        on p.user_id = v.user_id and p.ts >= v.ts""",
}
