import datetime as dt
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators.intervals import overlap_join
from tidewater.plans import streams
from tidewater.streaming.events import interval_join, sessions
from tidewater.streaming.funnel import BUCKETS, Funnel
from tidewater.streaming.runs import event_stream, run_to_end

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 3, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, path, batches, first=0):
    """A file for each batch of (event_id, minute, user, type), in the order of their times of change."""
    for i, rows in enumerate(batches, first):
        out = f"{path}-{i}"
        data = [(e, None if m is None else START + dt.timedelta(minutes=m), u, k, 1.0, "{}") for e, m, u, k in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(out)
        os.makedirs(path, exist_ok=True)
        (part,) = [f for f in os.listdir(out) if f.endswith(".parquet")]
        os.rename(f"{out}/{part}", f"{path}/b{i:03d}.parquet")
        os.utime(f"{path}/b{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def shuffled(rng, rows, delay):
    """Rows as they come up to `delay` minutes late, in batches."""
    rows = sorted(rows, key=lambda r: (r[1] or 0) + rng.uniform(0, delay))
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]


def within(batches, delay):
    """Whether no row lies behind the mark of the batches before it."""
    mark = -1e9
    for rows in batches:
        if any(m is not None and m < mark for _, m, _, _ in rows):
            return False
        mark = max([mark, *(m - delay for _, m, _, _ in rows if m is not None)])
    return True


def simulate(batches, gap, delay):
    """Sessions as they close, and how many rows are too late: state is (user, first, last, n).

    A batch closes sessions by the mark of the rows before it; it holds rows for too late by the mark of the batch before.
    """
    state, out, late, mark, late_mark = [], [], 0, -1e9, -1e9
    for rows in [*batches, []]:
        for _, m, u, _ in rows:
            if m is None:
                continue
            if m + gap <= late_mark:
                late += 1
                continue
            near = [s for s in state if s[0] == u and s[1] - gap < m < s[2] + gap]
            state = [s for s in state if s not in near]
            state.append((u, min([m, *(s[1] for s in near)]), max([m, *(s[2] for s in near)]), 1 + sum(s[3] for s in near)))
        out += [s for s in state if s[2] + gap <= mark]
        state = [s for s in state if s[2] + gap > mark]
        late_mark, mark = mark, max([mark, *(m - delay for _, m, _, _ in rows if m is not None)])
    return sorted(map(repr, out + [s for s in state if s[2] + gap <= mark])), late


def minute(t):
    return round((t - START).total_seconds() / 60)


def found_sessions(finished):
    return sorted(repr((r.user_id, minute(r.started), minute(r.ended), r.n_events)) for r in finished.rows.collect())


@pytest.mark.parametrize("name", sorted(streams.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    df = streams.QUERIES[name](spark, SF)
    want = con.sql(f"select {', '.join(df.columns)} from ({streams.ORACLE[name]})").fetchall()
    assert len(want) > 10 and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_sessions_of_rows_in_any_order_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 20_000), rng.choice([1, 1, 1, 2, None]), "view") for i in range(400)] + [(900, None, 1, "view")]
    rows += rows[:20]
    batches = shuffled(rng, rows, 55)
    assert within(batches, 60)
    write(spark, f"{tmp_path}/e", batches)
    finished = streams.session_run(spark, f"{tmp_path}/e", 1)
    assert len(finished.batches) > 5 and finished.late() == 0
    batch = sessions(spark.read.parquet(f"{tmp_path}/e").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "2 hours", "1 hour")
    mark = max(m for _, m, _, _ in rows if m is not None) - 60
    want = sorted(repr((r.user_id, minute(r.started), minute(r.ended), r.n_events)) for r in batch.collect() if minute(r.ended) + 120 <= mark)
    assert len(want) > 20 and found_sessions(finished) == want
    assert finished.state_rows()[-1] < 20  # open sessions alone, of 420 rows


def test_sessions_with_late_rows(spark, tmp_path):
    on_time = [[(i, 100 * i + j, 1, "view") for j in (0, 30)] for i in range(1, 12)]
    # Of two users each: hours behind, so a session of them alone is over; and behind the mark by less than a pause.
    late = {6: [(50, 10, 2, "view"), (51, 20, 3, "view")], 9: [(60, 700, 4, "view"), (61, 5, 5, "view")], 10: [(70, 930, 1, "view")]}
    batches = [rows + late.get(i, []) for i, rows in enumerate(on_time)]
    write(spark, f"{tmp_path}/e", batches)
    finished = streams.session_run(spark, f"{tmp_path}/e", 1)
    want, dropped = simulate(batches, 120, 60)
    assert dropped == 3 and finished.late() == 3 and found_sessions(finished) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_streams_is_the_range_join(spark, tmp_path, how):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 4000), rng.choice([1, 1, 2, 3, None]), rng.choice(["view", "purchase", "click"])) for i in range(500)]
    batches = shuffled(rng, rows, 55)
    write(spark, f"{tmp_path}/e", batches)
    finished = streams.join_run(spark, f"{tmp_path}/e", how, 1)
    assert len(finished.batches) > 5
    events = spark.read.parquet(f"{tmp_path}/e")
    bought = events.where("event_type = 'purchase'").selectExpr("user_id", "event_id purchase_id", "ts", "ts - interval 6 hours since")
    viewed = events.where("event_type = 'view'").selectExpr("user_id", "event_id view_id", "ts viewed")
    batch = overlap_join(bought, viewed, ("since", "ts"), ("viewed", "viewed"), ("user_id",), how)
    last = {k: max(m for _, m, _, t in rows if t == k) for k in ("view", "purchase")}
    mark = min(last.values()) - 60
    want = sorted(repr((r.purchase_id, r.view_id)) for r in batch.collect() if r.view_id is not None or (r.user_id is None or minute(r.ts) < mark))
    got = sorted(repr((r.purchase_id, r.view_id)) for r in finished.rows.collect())
    nobody = {repr((e, None)) for e, _, u, k in rows if u is None and k == "purchase"}
    assert [g for g in got if g not in nobody] == [w for w in want if w not in nobody] and len(want) > 50
    assert set(got) & nobody <= nobody and (how == "left" or not set(got) & nobody)
    plain = interval_join(bought.drop("since").withColumnRenamed("ts", "bought"), viewed, "user_id", "bought", "viewed", "6 hours", "1 hour", how)
    assert sorted(repr((r.purchase_id, r.view_id)) for r in plain.collect()) == sorted(repr((r.purchase_id, r.view_id)) for r in batch.collect())
    assert finished.state_rows()[-1] < 0.5 * len(rows)


def brute_funnel(rows, window=1440):
    out = {}
    for e, m, u, k in rows:
        if k == "view" and None not in (m, u):
            after = min(((n, f) for f, n, v, t in rows if t == "purchase" and v == u and n is not None and m <= n <= m + window), default=(None, None))
            out.setdefault((u, e, m), []).append(after[1])
    return out


def test_funnel_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 9000), rng.choice([1, 1, 2, 3, None]), rng.choice(["view", "view", "purchase", "click"])) for i in range(400)] + [(900, None, 1, "view"), (901, 9100, 9, "view")]
    batches = shuffled(rng, rows, 55)
    want = brute_funnel(rows)
    path = f"{tmp_path}/e"
    write(spark, path, batches[:3])
    first = streams.funnel_run(spark, path, 1, "funnel-test")
    n = first.rows.count()
    write(spark, path, batches[3:], 3)
    second = streams.funnel_run(spark, path, 1, "funnel-test")  # goes on from the checkpoint, with its state
    got = [(r.user_id, r.first_id, minute(r.first_at), r.second_id) for r in second.rows.collect()]
    assert 0 < n < len(got) and len(got) == len(set(got))
    mark = max(m for _, m, u, k in rows if None not in (m, u) and k in ("view", "purchase")) - 60
    decided = {key: v for key, v in want.items() if (key[2] // 90 + 1) * 90 + 1440 < mark}
    assert {g[:3]: [g[3]] for g in got} == decided and len(decided) > 50
    assert {v is None for v in (x for (x,) in decided.values())} == {True, False}


def test_state_of_a_funnel_grows_with_slots_and_not_with_keys(spark, tmp_path):
    rows = [(i, i % 80, i, "view") for i in range(4000)] + [(5000 + i, 100 + i % 80, i, "purchase") for i in range(0, 4000, 2)] + [(9999, 9000, 1, "click"), (10_000, 9000, 1, "view")]
    write(spark, f"{tmp_path}/e", [rows[:3000], rows[3000:]])
    finished = streams.funnel_run(spark, f"{tmp_path}/e", 1)
    got = sorted(repr((r.first_id, r.second_id)) for r in finished.rows.collect())
    assert got == sorted(repr((i, None if i % 2 else 5000 + i)) for i in range(4000))
    # Two slots of views and two of purchases at most, and a timer (a row and one by time) for each batch.
    assert 0 < max(finished.state_rows()) <= BUCKETS * (4 + 2 * 2)


class OneState:
    """A bucket's map and timers as a Funnel sees them."""

    def __init__(self):
        self.map, self.timers, self.mark = {}, set(), 0
        self.getMapState = lambda name, key, value: self
        self.getValue, self.removeKey, self.keys = self.map.get, self.map.pop, lambda: iter(list(self.map))
        self.updateValue, self.registerTimer = self.map.__setitem__, self.timers.add
        self.getCurrentWatermarkInMs = lambda: self.mark

    def fire(self, funnel):
        for due in sorted(t for t in self.timers if t < self.mark):
            self.getExpiryTimeInMs = lambda due=due: due
            yield from funnel.handleExpiredTimer((0,), self, self)
            self.timers.discard(due)


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_funnel_in_pieces(at_once):
    """However few steps are taken in or decided at once, and however far apart slots lie, results are the brute force's."""
    for seed in range(20):
        rng = random.Random(seed)
        window, slot = rng.choice([(16_000, 1000), (10_000, 10_000), (5000, 3000)])
        state, funnel, got = OneState(), Funnel(window, slot, at_once), []
        funnel.init(state)
        rows, mark = [], 0
        for _ in range(6):
            new = [(rng.randint(-3, 3), mark * 1000 + rng.choice([1, 40]) * rng.randint(0, 20_000), rng.randint(0, 99), rng.choice([1, 2])) for _ in range(30)]
            rows += new
            table = pd.DataFrame(new, columns=["key", "at", "id", "step"])
            assert not list(funnel.handleInputRows((0,), iter([table[:13], table[13:]]), state))
            state.mark = mark = mark + rng.choice([1, 20, 300])
            got += [tuple(None if pd.isna(x) else int(x) for x in r) for f in state.fire(funnel) for r in f.itertuples(index=False)]
            want = []
            for key, at, id, step in rows:
                if step == 1 and funnel._due(at // slot) < mark:
                    n, e = min(((n, e) for k, n, e, s in rows if s == 2 and k == key and at <= n <= at + window), default=(None, None))
                    want.append((key, id, at, e, n))
            assert sorted(map(repr, got)) == sorted(map(repr, want))
            assert all(funnel._due(s) >= mark for (s,) in state.map) and (not state.map or min(state.timers) <= funnel._due(min(state.map)[0]))


def test_empty_stream(spark, tmp_path):
    write(spark, f"{tmp_path}/e", [[]])
    assert streams.session_run(spark, f"{tmp_path}/e").rows.count() == 0
    assert streams.join_run(spark, f"{tmp_path}/e", "left").rows.count() == 0
    assert streams.funnel_run(spark, f"{tmp_path}/e").rows.count() == 0


def test_settings_of_the_session_stay(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    write(spark, f"{tmp_path}/e", [[(1, 0, 1, "view")]])
    run_to_end(event_stream(spark, f"{tmp_path}/e"), "plain")
    assert spark.conf.get(key, None) == before
