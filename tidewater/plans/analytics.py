"""Queries with frames, grouping sets, frequent items and NOT IN, each with its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.antijoin import not_in
from tidewater.operators.distincts import cube, grouping_sets_distinct
from tidewater.operators.frames import Frame, groups_frame, groups_frames
from tidewater.operators.frequent import top_items
from tidewater.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    price, quantity = F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity")
    return lines.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"), price, quantity)


def months_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line beside what its supplier shipped in three months that it shipped in: the two before its own, and its own."""
    wanted = {"quantity_3": ("sum", "quantity"), "lines_3": ("count", "*"), "least_3": ("min", "price"), "most_3": ("max", "price")}
    out = groups_frame(_lines(spark, sf_dir), ["l_suppkey"], ["month"], -2, 0, wanted)
    doubles = {c: F.col(c).cast("double") for c in ("quantity_3", "least_3", "most_3")}
    return out.withColumns(doubles).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "month", *wanted)


def other_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line beside the others of its supplier in the months around it, its own line, month, or month's others left out."""
    frames = []
    for short, exclude in (("row", "current row"), ("group", "group"), ("ties", "ties")):
        wanted = {f"quantity_{short}": ("sum", "quantity"), f"lines_{short}": ("count", "*"), f"least_{short}": ("min", "price"), f"most_{short}": ("max", "price")}
        frames.append(Frame(-1, 1, wanted, exclude))
    out = groups_frames(_lines(spark, sf_dir), ["l_suppkey"], ["month"], frames)
    named = [c for c in out.columns if c.startswith(("quantity_", "lines_", "least_", "most_"))]
    doubles = {c: F.col(c).cast("double") for c in named if not c.startswith("lines_")}
    return out.withColumns(doubles).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "month", *named)


def sales_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different orders, parts and suppliers by return flag, status and year, for all subsets of these."""
    lines = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    keys = ["l_returnflag", "l_linestatus", "year"]
    sums = {"quantity": F.col("l_quantity").cast("decimal(18,2)")}
    out = grouping_sets_distinct(lines, keys, cube(keys), {"n_orders": "l_orderkey", "n_parts": "l_partkey", "n_suppliers": "l_suppkey"}, sums)
    return out.withColumn("quantity", F.col("quantity").cast("double"))


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent words of all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return top_items(words, "word", 100).withColumnRenamed("item", "word")


def top_event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty users with the most events."""
    return top_items(table(spark, sf_dir, "events"), "user_id", 20).withColumnRenamed("item", "user_id")


def never_returned_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose (part, supplier) is NOT IN those of large returned lines, where either may be unknown."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.when(F.col("l_discount") > 0.005, F.col("l_partkey")).alias("part")
    supplier = F.when(F.col("l_tax") > 0.005, F.col("l_suppkey")).alias("supplier")
    returned = lines.where("l_returnflag = 'R' AND l_quantity >= 50 AND l_discount > 0.005").select(part, supplier)
    found = not_in(lines.select("l_orderkey", "l_linenumber", part, supplier), returned, ["part", "supplier"])
    return found


QUERIES = {
    "months_around": months_around,
    "other_lines": other_lines,
    "sales_cube": sales_cube,
    "top_words": top_words,
    "top_event_users": top_event_users,
    "never_returned_together": never_returned_together,
}

_LINES = """l as (select l_orderkey, l_suppkey, l_partkey, l_linenumber, cast(date_trunc('month', l_shipdate) as timestamp) as month,
            cast(l_extendedprice as decimal(18,2)) as price, cast(l_quantity as decimal(18,2)) as quantity from lineitem)"""


def _framed(suffix: str, frame: str) -> str:
    over = f"over (partition by l_suppkey order by month {frame})"
    return f"""cast(sum(quantity) {over} as double) as quantity_{suffix}, count(*) {over} as lines_{suffix},
               cast(min(price) {over} as double) as least_{suffix}, cast(max(price) {over} as double) as most_{suffix}"""


ORACLE: dict[str, str] = {
    "months_around": f"with {_LINES} select l_orderkey, l_partkey, l_linenumber, l_suppkey, month, {_framed('3', 'groups between 2 preceding and current row')} from l",
    "other_lines": f"""with {_LINES} select l_orderkey, l_partkey, l_linenumber, l_suppkey, month,
        {_framed('row', 'groups between 1 preceding and 1 following exclude current row')},
        {_framed('group', 'groups between 1 preceding and 1 following exclude group')},
        {_framed('ties', 'groups between 1 preceding and 1 following exclude ties')} from l""",
    "sales_cube": """
        select l_returnflag, l_linestatus, cast(year(l_shipdate) as integer) as year, cast(grouping(l_returnflag, l_linestatus, year(l_shipdate)) as bigint) as grouping_id,
               count(*) as n_rows, count(distinct l_orderkey) as n_orders, count(distinct l_partkey) as n_parts, count(distinct l_suppkey) as n_suppliers,
               cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity
        from lineitem group by cube (l_returnflag, l_linestatus, year(l_shipdate))""",
    "top_words": r"""
        select word, count(*) as n from (select unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word from documents)
        group by word order by n desc, word limit 100""",
    "top_event_users": "select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 20",
    "never_returned_together": """
        with l as (select l_orderkey, l_linenumber, case when l_discount > 0.005 then l_partkey end as part, case when l_tax > 0.005 then l_suppkey end as supplier,
                          l_returnflag = 'R' and l_quantity >= 50 and l_discount > 0.005 as back from lineitem),
        r as (select distinct part, supplier from l where back)
        select l_orderkey, l_linenumber, part, supplier from l
        where not exists (select 1 from r where (r.part = l.part or r.part is null or l.part is null)
                                            and (r.supplier = l.supplier or r.supplier is null or l.supplier is null))""",
}
