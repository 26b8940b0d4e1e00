"""Frequent items: a mergeable summary with a stated bound on its error, merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.storage import Scratch

#: Counters of a summary, and summaries that are merged into one.
COUNTERS, FANIN = 10_000, 16


def _trimmed(table: pa.Table, counters: int) -> tuple[pa.Table, int]:
    """The `counters` largest counts (item, n), each less the next one, and that one: what any item may have lost by it."""
    if len(table) <= counters:
        return table, 0
    order = pc.sort_indices(table, sort_keys=[("n", "descending"), ("item", "ascending")])
    lost = table["n"][order[counters].as_py()].as_py()
    top = table.take(order[:counters])
    top = top.set_column(1, "n", pc.subtract(top["n"], lost))
    return top.filter(pc.greater(top["n"], 0)), lost


def _added(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by("item").aggregate([("n", "sum")])
    return found.rename_columns(["item", "n"])


class Summary:
    """Counts of the items of a stream in bounded memory (Misra and Gries).

    No count is above the true one, and none is below it by more than `lost`, which is at most the number of rows over
    `counters`; what has no count occurs `lost` times at most. Both hold for summaries that were merged, too.
    """

    def __init__(self, counters: int, kind: pa.DataType):
        self.counters, self.lost = counters, 0
        self.table = pa.table({"item": pa.array([], kind), "n": pa.array([], pa.int64())})

    def add(self, counts: pa.Table, lost: int = 0) -> None:
        """Takes in (item, n), an Arrow batch's counts or another summary's with what that has lost."""
        self.table, more = _trimmed(_added([self.table, counts]), self.counters)
        self.lost += lost + more


def _rows(summary: Summary, group: int) -> pa.Table:
    """A summary as rows; the row of no item has what is lost."""
    items = pa.concat_arrays([*summary.table["item"].chunks, pa.nulls(1, summary.table.schema.field("item").type)])
    n = pa.concat_arrays([*summary.table["n"].chunks, pa.array([summary.lost], pa.int64())])
    return pa.table({"part": pa.array([group] * len(items), pa.int64()), "item": items, "n": n, "lost": pa.array([False] * (len(items) - 1) + [True])})


def _read(rows: pa.Table, counters: int) -> Summary:
    kind = rows.schema.field("item").type
    out = Summary(counters, kind)
    marks = rows["lost"]
    out.add(rows.filter(pc.invert(marks)).select(["item", "n"]), pc.sum(rows.filter(marks)["n"]).as_py() or 0)
    return out


def summarize(df: DataFrame, item: str, counters: int = COUNTERS, fanin: int = FANIN) -> DataFrame:
    """(item, n, lost): a summary of the values of column `item`, at most `counters` of them.

    A value occurs n times at least and n + lost at most, and one without a row `lost` times at most; lost is at most the
    number of rows over `counters`. Nulls are no items; an empty table gives no rows. Repeated rows count as they come.

    Each task keeps one summary of what it reads, whatever that is; summaries are merged `fanin` at a time, by jobs whose
    results are kept, so no task and no driver ever holds more than `fanin` of them.
    """
    scratch = Scratch(df.sparkSession, "frequent")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            values = batch.column(0)
            held = held or Summary(counters, values.type)
            counts = pc.value_counts(values.drop_null())
            held.add(pa.table({"item": counts.field(0), "n": counts.field(1)}))
        if held:
            yield from _rows(held, TaskContext.get().partitionId()).to_batches()

    kind = df.schema[item].dataType.simpleString()
    schema = f"part bigint, item {kind}, n bigint, lost boolean"
    level, now = 0, scratch.keep(df.select(item).where(F.col(item).isNotNull()).mapInArrow(each, schema), "level-0")
    while (most := now.agg(F.max("part")).first()[0]) is not None and most > 0:

        def merge(key: tuple, rows: pa.Table) -> pa.Table:
            return _rows(_read(rows, counters), key[0].as_py())

        level += 1
        merged = now.withColumn("up", F.floor(F.col("part") / fanin)).groupBy("up").applyInArrow(merge, schema)
        now = scratch.keep(merged, f"level-{level}")
        scratch.drop(f"level-{level - 1}")
    lost = now.where("lost").agg(F.sum("n")).first()[0] or 0
    return now.where("NOT lost").select("item", "n", F.lit(lost).cast("bigint").alias("lost"))


def top_items(df: DataFrame, item: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """(item, n): the `k` most frequent values of `item` with their exact counts; of equal counts the smaller values.

    Candidates come from a summary: every value that may be among the first `k`, of which there are `counters` at most.
    Their counts come from a second look at the rows, by a semi join. Where the summary lost nothing, or the k-th count is
    above what it lost, no other value can be among them. Else (many values of about the same frequency) all values are
    counted, each task's before the shuffle, so the result is exact either way. Nulls are no items.
    """
    scratch = Scratch(df.sparkSession, "top")
    found = scratch.keep(summarize(df, item, counters), "summary")
    few = found.select("item")  # `counters` rows at most
    rows = df.select(F.col(item).alias("item")).where("item IS NOT NULL")
    top = scratch.keep(_first(rows.join(F.broadcast(few), "item", "left_semi"), k), "candidates")
    lost = found.agg(F.max("lost")).first()[0]  # null without candidates: then nothing is known of any value
    n_top, least = top.agg(F.count("*"), F.min("n")).first()
    if lost is None or (lost > 0 and (n_top < k or least <= lost)):
        return _first(rows, k)
    return top.orderBy(F.col("n").desc(), "item")


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The `k` most frequent values of `item` in `rows`, counted."""
    return rows.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item").limit(k)
