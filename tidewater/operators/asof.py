"""As-of join, which Spark's SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a window may hold; a key beyond it is cut into slices of `at` with about as many each, SLICES at most.
KEY_ROWS, SLICES = 1_000_000, 256


def asof_last(left: DataFrame, right: DataFrame, by: str, at: str, value: str, alias: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """`left` with the `value` of the latest `right` row of the same `by` whose `at` is not after its own.

    Both sides go through one shuffle on `by` and one sort, instead of an inequality join. A key with over `key_rows` rows
    is cut at quantiles of its own `at`, and what the slices before hold last is carried over, so a busy key is spread over
    tasks even if its rows are of one hour. Which keys are busy is found when the result is, not when it is asked for;
    where none is, adaptive execution leaves that part out. Rows of `left` without a match get null; so do rows whose `by`
    or `at` is null, as an equality or an order with null never holds: they pass by the shuffle. The latest row counts even
    if its value is null. Of right rows with the same `by` and `at`, the one with the largest `value` counts, and null only
    where there is no other, so results don't depend on row order. `at` must be a number, date or timestamp; rows of one
    key at one time are never cut apart. Other columns of `left` may have any names but `alias`.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row")
    known = F.col(by).isNotNull() & F.col(at).isNotNull()
    side = lambda n: F.lit(n).alias("side")
    some = F.struct(F.col(value).isNotNull().alias("any"), F.col(value).alias("v")).alias("value")
    rows = left.where(known).select(F.col(by).alias("by"), F.col(at).alias("at"), whole, F.lit(None).cast(_type_of(right, value)).alias("value"), side(1))
    seen = right.where(known).select(F.col(by).alias("by"), F.col(at).alias("at"), F.lit(None).cast(left.select(whole).schema["row"].dataType).alias("row"), some, side(0))
    merged = rows.unionByName(seen)
    order = [F.col("at"), F.col("side"), F.col("value")]
    before = lambda window, last: window.rowsBetween(Window.unboundedPreceding, last)
    last = lambda *keys: F.last("value", ignorenulls=True).over(before(Window.partitionBy(*keys).orderBy(*order), 0))
    slices = F.least(F.lit(SLICES), F.ceil(F.col("n") / key_rows)).cast("int")
    busy = merged.groupBy("by").agg(F.count("*").alias("n")).where(F.col("n") > key_rows).select("by", slices.alias("slices"))
    calm = merged.join(busy, "by", "left_anti").withColumn("found", last("by"))
    # The key's own quantiles, of which as many are taken as it has slices.
    ranks = [i / SLICES for i in range(1, SLICES)]
    cuts = merged.select("by", "at").join(busy, "by").groupBy("by", "slices").agg(F.percentile_approx("at", ranks, 10_000).alias("ranks"))
    taken = F.expr(f"transform(filter(sequence(0, slices - 1), i -> i > 0), i -> element_at(ranks, cast(i * {SLICES} div slices as int)))")
    cuts = cuts.select("by", taken.alias("cuts"))
    cut = merged.join(cuts, "by").withColumn("slice", F.size(F.filter("cuts", lambda b: b <= F.col("at")))).drop("cuts")
    ends = cut.groupBy("by", "slice").agg(F.max(F.when(F.col("side") == 0, F.struct("at", "value"))).alias("end"))
    carried = F.last("end", ignorenulls=True).over(before(Window.partitionBy("by").orderBy("slice"), -1))  # a row for each slice
    cut = cut.withColumn("last", last("by", "slice")).join(ends.select("by", "slice", carried.alias("end")), ["by", "slice"])
    found = calm.unionByName(cut.withColumn("found", F.coalesce("last", "end.value")).select(calm.columns))
    joined = found.where("side = 1").select("row.*", F.col("found.v").alias(alias))
    return joined.unionByName(left.where(~known).select("*", F.lit(None).cast(right.schema[value].dataType).alias(alias)))


def _type_of(right: DataFrame, value: str) -> str:
    return f"struct<any: boolean, v: {right.schema[value].dataType.simpleString()}>"
