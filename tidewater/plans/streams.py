"""Queries over `events` as a stream, each with the SQL of the rows that it has emitted when the stream ends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.streaming.events import interval_join, sessions
from tidewater.streaming.funnel import funnel
from tidewater.streaming.runs import Finished, event_stream, run_to_end, without_zone


def session_run(spark: SparkSession, path: str, files: int | None = None) -> Finished:
    """Sessions with pauses of two hours, rows an hour late at most."""
    events = event_stream(spark, path, files=files)
    kinds = [F.count(F.when(F.col("event_type") == k, 1)).alias(f"n_{k}") for k in ("view", "purchase")]
    return run_to_end(sessions(events, "user_id", "ts", "2 hours", "1 hour", *kinds), "sessions")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions that have ended when the stream does."""
    found = session_run(spark, f"{sf_dir}/events.parquet").rows
    return found.withColumns({c: without_zone(F.col(c)) for c in ("started", "ended")})


def join_run(spark: SparkSession, path: str, how: str, files: int | None = None) -> Finished:
    """Purchases with the views of the same user in the six hours before."""
    kind = lambda k, *names: event_stream(spark, path, files=files).where(F.col("event_type") == k).select("user_id", *(F.col(a).alias(b) for a, b in names))
    purchases, views = kind("purchase", ("event_id", "purchase_id"), ("ts", "bought")), kind("view", ("event_id", "view_id"), ("ts", "viewed"))
    return run_to_end(interval_join(purchases, views, "user_id", "bought", "viewed", "6 hours", "1 hour", how), f"{how}-join")


def views_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a purchase and a view, as two streams meet."""
    return join_run(spark, f"{sf_dir}/events.parquet", "inner").rows.select("purchase_id", "view_id")


def purchases_and_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and purchases that no view can meet any more, with null."""
    return join_run(spark, f"{sf_dir}/events.parquet", "left").rows.select("purchase_id", "view_id")


def funnel_run(spark: SparkSession, path: str, files: int | None = None, folder: str | None = None) -> Finished:
    """Views with the first purchase of the same user in the day after."""
    events = event_stream(spark, path, files=files)
    steps = funnel(events, "user_id", "ts", "event_id", "event_type = 'view'", "event_type = 'purchase'", dt.timedelta(days=1), "1 hour")
    return run_to_end(steps, "funnel", folder)


def view_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view that is decided when the stream ends: bought, with the purchase, or not, with null."""
    return funnel_run(spark, f"{sf_dir}/events.parquet").rows.select("user_id", F.col("first_id").alias("view_id"), F.col("second_id").alias("purchase_id"))


QUERIES = {"event_sessions": event_sessions, "views_before_purchase": views_before_purchase, "purchases_and_views": purchases_and_views, "view_funnel": view_funnel}

#: What the watermark has reached at the end, in milliseconds as Spark keeps it.
_MARK = "(select date_trunc('milliseconds', max(ts)) - interval 1 hour from events {where})"
_PAIRS = """select p.event_id as purchase_id, v.event_id as view_id from events p {} join events v
        on p.user_id = v.user_id and v.event_type = 'view' and v.ts between p.ts - interval 6 hours and p.ts"""

ORACLE: dict[str, str] = {
    "event_sessions": f"""
        with ordered as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 2 hours, true) as starts from events),
        numbered as (select *, count(*) filter (where starts) over (partition by user_id order by ts rows unbounded preceding) as s from ordered)
        select user_id, min(ts) as started, max(ts) as ended, count(*) as n_events,
               count(*) filter (where event_type = 'view') as n_view, count(*) filter (where event_type = 'purchase') as n_purchase
        from numbered group by user_id, s having max(ts) + interval 2 hours <= {_MARK.format(where='')}""",
    "views_before_purchase": _PAIRS.format("") + " where p.event_type = 'purchase'",
    # Decided in slots of a sixteenth of a day, by the millisecond after the window of the slot's last view.
    "view_funnel": f"""
        with v as (select * from events where event_type = 'view'), p as (select * from events where event_type = 'purchase')
        select v.user_id, v.event_id as view_id, arg_min(p.event_id, (p.ts, p.event_id)) as purchase_id
        from v left join p on p.user_id = v.user_id and p.ts between v.ts and v.ts + interval 1 day
        where epoch_us(v.ts) // 5400000000 * 5400000000 + 5400000000 + 86400000000 + 1000 < epoch_us({_MARK.format(where="where event_type in ('view', 'purchase')")})
        group by v.user_id, v.event_id""",
    # The mark is the lesser of the two streams'.
    "purchases_and_views": f"""select * from ({_PAIRS.format("left")} where p.event_type = 'purchase') join (select event_id as purchase_id, ts from events) using (purchase_id)
        where view_id is not null or ts <= least({_MARK.format(where="where event_type = 'purchase'")}, {_MARK.format(where="where event_type = 'view'")})""".replace("select *", "select purchase_id, view_id", 1),
}
