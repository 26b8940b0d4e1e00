"""Lines that many documents share, by levelled sorted runs of line hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import SPACE, byte_slices, free_name, stored, unstored, work_dir

#: Documents in which a line's key must occur for its lines to go.
MIN_DOCS = 10
#: Batches in which a corpus is taken in, and runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 4, 3

_STRIP = SPACE.encode()


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of a line stripped of ASCII white space with A-Z lower-cased; None if nothing is left."""
    key = line.strip(_STRIP).lower()
    return xxhash.xxh3_128_digest(key) if key else None


class LineRuns:
    """Levels of runs (key, n_docs), each bucketed and sorted by key, so that joins with them merge without a shuffle.

    A key that reaches `min_docs` in one run is settled: later batches anti-join it away instead of counting it again.
    Every other key's documents are the sum over all runs, so no order or number of batches changes what is frequent.

    Runs are folders under the shared folder, each named by its level, the first and last batch that it holds, and its
    buckets; what lies there is what there is. A session only registers them, under names of its own, as tables that leave
    their files alone. With a name given, runs of that name from earlier calls, jobs and sessions are taken up again, and
    new batches are added to them; one caller at a time may write to a name. A folder without the mark of a finished write
    is what a job that died left, and goes. So does a run whose batches another holds as well: it was compacted by a job
    that died before it deleted it.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, name: str | None = None):
        self.spark, self.min_docs, self.fanout, self.named = spark, min_docs, fanout, name is not None
        # Hashed, so that any name is a folder of its own, whatever its letters and length.
        self.path = f"{work_dir(spark)}/line-runs/{sha256(name.encode()).hexdigest() if self.named else uuid.uuid4().hex}"
        self.levels: list[list[tuple[str, str]]] = []  # (folder, table)
        self.batches = 0
        found = {f: tuple(map(int, m.groups())) for f in self._folders() if (m := re.fullmatch(r"(\d+)_(\d+)_(\d+)_(\d+)", f))} if self.named else {}
        whole = {f: s for f, s in found.items() if self._exists(f"{f}/_SUCCESS")}
        for f, (level, first, last, buckets) in sorted(found.items(), key=lambda x: x[1][1:]):
            if f not in whole or any(o != f and b <= first and last <= c and (b, c, k) != (first, last, level) for o, (k, b, c, _) in whole.items()):
                self._delete(f)
                continue
            self._put(f, self._registered(f, buckets), level)
            self.batches = max(self.batches, last + 1)

    def _fs(self, folder: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}" if folder else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, folder: str) -> bool:
        fs, path = self._fs(folder)
        return fs.exists(path)

    def _folders(self) -> list[str]:
        fs, path = self._fs()
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, folder: str) -> None:
        fs, path = self._fs(folder)
        fs.delete(path, True)

    def _registered(self, folder: str, buckets: int) -> str:
        """A table of this session over a run's files, which knows their buckets and order."""
        table = f"line_run_{uuid.uuid4().hex}"
        place = f"{self.path}/{folder}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {table} (key BINARY, n_docs BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'")
        return table

    def _put(self, folder: str, table: str, level: int) -> None:
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append((folder, table))

    def _write(self, counts: DataFrame, level: int, first: int, last: int) -> None:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folder, table = f"{level}_{first}_{last}_{buckets}", f"line_run_{uuid.uuid4().hex}"
        writer = counts.select("key", "n_docs").repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").format("parquet")
        writer.option("path", f"{self.path}/{folder}").saveAsTable(table)
        self._put(folder, table, level)

    def _forget(self, runs: list[tuple[str, str]], files: bool) -> None:
        for folder, table in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            if files:
                self._delete(folder)

    def _runs(self) -> list[str]:
        return [table for level in self.levels for _, table in level]

    def add(self, counts: DataFrame) -> None:
        """Takes in a batch's (key, n_docs): what no run has settled becomes a run of level 0; full levels are compacted."""
        for run in self._runs():
            counts = counts.join(self._settled(self.spark.table(run)).hint("merge"), "key", "left_anti")
        self._write(counts, 0, self.batches, self.batches)
        self.batches, level = self.batches + 1, 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            ends = [int(x) for folder, _ in old for x in folder.split("_")[1:3]]
            self._write(self._summed([table for _, table in old]), level + 1, min(ends), max(ends))
            self._forget(old, files=True)
            self.levels[level] = []
            level += 1

    def _settled(self, run: DataFrame) -> DataFrame:
        return run.where(F.col("n_docs") >= self.min_docs).select("key")

    def _summed(self, runs: list[str]) -> DataFrame:
        """The runs merged, each key's documents added up. Not by a union: Spark 4.1 takes one of bucketed tables as dealt by key and sums amiss."""
        every = self.spark.table(runs[0])
        for run in runs[1:]:
            more = self.spark.table(run).withColumnRenamed("n_docs", "n_more").hint("merge")
            added = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))
            every = every.join(more, "key", "full").select("key", added.alias("n_docs"))
        return every

    def frequent(self) -> DataFrame:
        """The keys (key) found in at least `min_docs` documents so far, as a table of their own; the runs stay."""
        return stored(self._settled(self._summed(self._runs())), "frequent-lines")

    def close(self) -> None:
        """The session forgets the runs; their files stay if they have a name, for the next call, and go if not."""
        self._forget([run for level in self.levels for run in level], files=False)
        self.levels = []
        if not self.named:
            self._delete("")


def _owner() -> Column:
    """What a document's keys are gathered by. A row without an id goes by its text: sharing an owner only adds frequent keys."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in byte_slices(batches):
        owners, parts, keys = [], [], []
        for owner, part, text in zip(batch.column("owner").to_pylist(), batch.column("batch").to_pylist(), texts, strict=True):
            found = {line_key(line) for line in text.split(b"\n")} - {None}
            owners += [owner] * len(found)
            parts += [part] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.int64())], names=["owner", "key", "batch"])


def _cut(batches: Iterator[pa.RecordBatch], drops_name: str, counts: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Texts that lose nothing pass as they are; only the others are put together anew."""
    for batch, texts in byte_slices(batches):
        at = batch.schema.get_field_index("text")
        old, changed, n_lines, n_dropped = batch.column(at), [], [], []
        for text, drops in zip(texts, batch.column(drops_name).to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = set(drops or ())
            left = [line for line in lines if line_key(line) not in gone] if gone else lines
            changed.append(None if len(left) == len(lines) else b"\n".join(left).decode("utf-8", "replace"))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
        names = [n for n in batch.schema.names if n != drops_name]
        columns = [batch.column(n) for n in names]
        columns[names.index("text")] = pc.coalesce(pa.array(changed, old.type), old)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, *counts])


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, counts: tuple[str, str] = ("_n_lines", "_n_dropped"), name: str | None = None) -> DataFrame:
    """`docs` (doc_id, text and any other columns), each text without its lines whose key is in `min_docs` documents; with `counts`: its lines and those dropped.

    With `name`, the runs of that name from earlier calls count as well, and take these documents in and stay; every call is
    taken to bring new documents. Without it, the runs go when the call ends, however it ends.

    A document is a doc_id: repeated rows and rows of one doc_id count once, and so do rows without a doc_id whose texts are
    equal. Each row is cut by itself. Lines of white space alone have no key and always stay. Null or empty texts are one
    empty line and stay as they are. Long texts are taken whole; bytes that aren't UTF-8 stay in texts that lose no line,
    and become U+FFFD in others. Rows keep their other columns, whatever their names, but for those named as `counts`, which
    give way to them; no row is dropped. An empty table gives an empty table.
    """
    spark, docs = docs.sparkSession, docs.drop(*counts)
    owner, dropped = free_name(docs, "_owner"), free_name(docs, "_drops")
    cut = docs.select(_owner().alias("owner"), "text").withColumn("batch", F.pmod(F.xxhash64("owner"), F.lit(batches)))
    keys = stored(cut.mapInArrow(_keys, "owner long, key binary, batch long"), "line-keys", "batch")
    runs = LineRuns(spark, min_docs, fanout, name)
    try:
        for i in range(batches):
            # Distinct before counting, so that rows of one document count once; a line that all share is summed where it is read.
            batch = keys.where(F.col("batch") == i).select("owner", "key").distinct()
            runs.add(batch.groupBy("key").agg(F.count("*").alias("n_docs")))
        frequent = runs.frequent()
    finally:
        runs.close()
    drops = stored(keys.join(frequent, "key", "left_semi").groupBy("owner").agg(F.collect_set("key").alias(dropped)), "line-drops")
    unstored(keys)
    unstored(frequent)
    # One shuffle of the texts at every size: what is to be dropped grows with the corpus, so it is never broadcast.
    drops = drops.withColumnRenamed("owner", owner).hint("merge")
    joined = docs.withColumn(owner, _owner()).join(drops, owner, "left").select(*docs.columns, dropped)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    return joined.mapInArrow(partial(_cut, drops_name=dropped, counts=counts), schema)
