"""Streams that run over what is there, into a table in the shared folder."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.storage import shared_dir

#: State lies in RocksDB on the executors' disks and is saved to the shared folder; sessions are merged before a shuffle, so
#: a key with many rows sends its sessions and not its rows.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session while a query starts; it keeps them, and the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def event_stream(spark: SparkSession, path: str, at: str = "ts", files: int | None = None) -> DataFrame:
    """The Parquet files of `path` as a stream, `files` in a batch, with `at` as a timestamp that watermarks take.

    A time without a zone is taken as UTC, whatever the session's zone.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may match a single file, which a plain path of a stream may not name
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(pattern)
    if isinstance(stream.schema[at].dataType, T.TimestampNTZType):
        return stream.withColumn(at, F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(at))))
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def without_zone(at: Column) -> Column:
    """A timestamp as its time in UTC without a zone, as event_stream() reads one."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(at), _epoch())


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


@dataclass
class Finished:
    """A stream's rows as a table, and what its batches reported."""

    rows: DataFrame
    batches: list[dict] = field(default_factory=list)

    def late(self) -> int:
        """Rows that stateful operators dropped as too late; those that one task reads of one session count once."""
        return sum(s["numRowsDroppedByWatermark"] for b in self.batches for s in b["stateOperators"])

    def state_rows(self) -> list[int]:
        """Rows held in state after each batch."""
        return [sum(s["numRowsTotal"] for s in b["stateOperators"]) for b in self.batches]


def run_to_end(stream: DataFrame, name: str, folder: str | None = None) -> Finished:
    """Runs `stream` in append mode over all that its source holds, in as many batches as it says, and gives what it wrote.

    Rows and checkpoint lie in `folder` (one of its own by default) under the shared folder. A run in the folder of an
    earlier one goes on where that one stopped, with its state, and its table holds the rows of both, each once.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{folder or f'{name}-{uuid.uuid4().hex}'}"
    with _settings(spark, STATE):
        query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        batches = [json.loads(p.json) for p in query.recentProgress]
    finally:
        query.stop()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    return Finished(spark.read.schema(schema).parquet(f"{base}/rows"), batches)
