"""What the operators share: tables kept between jobs, Arrow batches cut by size, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.storage import shared_dir

#: ASCII white space; what bytes.split() and bytes.strip() take, too.
SPACE = " \t\n\x0b\x0c\r"
#: Characters that a task handles at once.
SLICE_BYTES = 4_000_000
#: Rows (node, least) up to which components() broadcasts them, some 24 MB; links of a node beyond which it is hot, and rows
#: of another key.
BROADCAST_NODES, HOT_LINKS, HOT_ROWS = 500_000, 1000, 100_000


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; on one machine alone one under the warehouse will do."""
    return shared_dir(spark)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """`df` written to the shared folder (in folders by the columns `by`) and read again, which cuts its lineage and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstored(df: DataFrame) -> None:
    """Deletes the files of a table that stored() made and that nothing needs any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {re.sub(r"(/[^/]*=[^/]*)*/[^/]*\Z", "", f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def byte_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts batches to rows whose texts hold about SLICE_BYTES (a longer text comes alone), with the texts' UTF-8; null: empty."""
    for batch in batches:
        column = batch.column(text)
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > SLICE_BYTES:
                yield batch.slice(start, i - start), [x or b"" for x in column.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start), [x or b"" for x in column.slice(start).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(df: DataFrame, make: Callable[[list[bytes]], dict[str, list]], schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """For each row the columns `keep` and those that `make` gives for the UTF-8 texts of a slice of rows."""
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    own = [x.strip().split()[0] for x in schema.split(",")]
    types = dict(zip(own, [_arrow(x.strip().split()[1]) for x in schema.split(",")], strict=True))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, text):
            made = make(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(made[c], types[c]) for c in own)], names=[*keep, *own])

    return df.select(*dict.fromkeys((*keep, text))).mapInArrow(each, f"{kept}, {schema}")


def _arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]


def components(edges: DataFrame, broadcast: int = BROADCAST_NODES, hot: int = HOT_LINKS) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b), all long: root is the component's smallest node.

    Large-star and small-star steps in turn until nothing changes, each two aggregations and two joins with their results.
    Nodes' least neighbours are pre-aggregated before a shuffle; they are broadcast while the links can't have more than
    `broadcast` nodes, and beyond it only those of nodes with over `hot` links are, so no node's links ever meet in one
    task. The tables of the steps are written to the shared folder, so a lost executor never costs more than a step.
    Links from a node to itself and repeated links count for nothing; without links there are no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen, scrap = None, []
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (found.n, found.h) == seen or not found.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = (found.n, found.h)
        small = 2 * found.n <= broadcast
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_unique(both, least, "a", scrap, small, broadcast, hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        linked = join_unique(large, least, "a", scrap, small, broadcast, hot).select(F.col("b").alias("x"), "m").where("x <> m")
        step = linked.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = stored(step.where("a <> b").distinct(), "links")
        for table in (now, *scrap):
            unstored(table)
        scrap.clear()
        now = after


def join_unique(rows: DataFrame, unique: DataFrame, key: str, scrap: list[DataFrame], small: bool = False, broadcast: int = BROADCAST_NODES, hot: int = HOT_ROWS) -> DataFrame:
    """`rows` with the columns of `unique`, which has one row for every `key` of theirs, and in n how many of them there are.

    With `small`, all of it is broadcast. Else only the keys of over `hot` rows are, so that the rows of such a key stay
    where they are and never meet in one task; where those are over `broadcast`, the hottest of them. The others are
    joined by a shuffle. The table that this writes is added to `scrap`.
    """
    if small:
        return rows.join(F.broadcast(unique.drop("n")), key)
    scrap.append(unique := stored(unique, "unique"))
    busy = unique.where(F.col("n") > hot)
    many = busy.count()
    if not many or not broadcast:
        return rows.join(unique.drop("n"), key)
    if many > broadcast:
        hot = busy.orderBy(F.desc("n")).limit(broadcast).agg(F.min("n")).first()[0]  # of those with as many rows none is taken
        busy = unique.where(F.col("n") > hot)
    busy, rest = F.broadcast(busy.drop("n")), unique.where(F.col("n") <= hot).drop("n")
    return rows.join(busy, key).unionByName(rows.join(busy, key, "left_anti").join(rest, key))
