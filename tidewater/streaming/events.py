"""Operators over streams of events in event time; each has a batch form that its results are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str, delay: str, *aggregates: Column) -> DataFrame:
    """Sessions of each key: (key, started, ended, n_events, *aggregates); a pause of `gap` or more ends one.

    On a stream a session comes once, when the watermark (the latest `at` less `delay`) has reached its last event and
    `gap`. Rows that come `delay` late at most join sessions, or join two to one, in whatever order they come, so that
    sessions are those of the batch form. A later row may find its session closed and then begins another; once `gap` from
    it lies behind the watermark, too, it counts in nothing. In batch every session comes, and nothing is late.
    Rows with a null `at` are in no session; a null key is one of its own. State holds the open sessions alone.
    """
    marked = events.withWatermark(at, delay) if events.isStreaming else events
    window = F.session_window(at, gap).alias("session")
    found = marked.groupBy(key, window).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n_events"), *aggregates)
    return found.drop("session")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, before: str, delay: str, how: str = "inner") -> DataFrame:
    """Rows of `left` with those of `right` of the same `key` from `before` earlier than left_at up to left_at.

    Sides have no column in common but `key`, which comes once. On streams both sides are marked with `delay`, so a left
    row waits in state until no right row on time can meet it, and a right row until no left row can; with `how` "left" a
    left row that met nothing then comes with nulls. In batch the same condition is an equality join with a filter.
    Null keys and times meet nothing.
    """
    a = left.withWatermark(left_at, delay) if left.isStreaming else left
    b = right.withWatermark(right_at, delay) if right.isStreaming else right
    b = b.withColumnRenamed(key, f"_{key}")
    near = (F.col(right_at) <= F.col(left_at)) & (F.col(right_at) >= F.col(left_at) - F.expr(f"INTERVAL {before}"))
    joined = a.join(b, (F.col(key) == F.col(f"_{key}")) & near, "left_outer" if how == "left" else "inner")
    return joined.drop(f"_{key}")
