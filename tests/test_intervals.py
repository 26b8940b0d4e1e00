import random

import duckdb
import pytest

from tidewater.operators.intervals import band_join, overlap_join
from tidewater.plans import joins

SF = "/root/testdata/sf0.001"


def brute(left, right, how="inner"):
    """Rows (key, start, end, id) that share a key and a value."""
    ok = lambda r: None not in r[:3] and r[1] == r[1] and r[2] == r[2] and r[1] <= r[2]
    out = []
    for a in left:
        hits = [(*a, *b[1:]) for b in right if ok(a) and ok(b) and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]]
        out += hits or ([(*a, None, None, None)] if how == "left" else [])
    return sorted(map(repr, out))


def spans(rng, n, points=False):
    """Widths from nothing to nearly everything, bounds on edges of bins, nulls, inverted ones, a busy key."""
    out = []
    for i in range(n):
        start = rng.choice([rng.randint(-500, 500), rng.uniform(-500, 500), 8.0 * rng.randint(-60, 60)])
        width = 0 if points else rng.choice([0, 1, 8, rng.uniform(0, 5), rng.uniform(0, 60), rng.uniform(0, 900), -3])
        key, start, end = rng.choice([1, 1, 1, 2, None]), float(start), float(start + width)
        if rng.random() < 0.06:
            start, end = rng.choice([(None, end), (start, None), (float("nan"), end), (start, float("nan"))])
        out.append((key, start, end, i))
    return out


@pytest.mark.parametrize("unit", [None, 0.5, 8.0, 1e6])
@pytest.mark.parametrize("points", [False, True])
def test_against_every_pair(spark, unit, points):
    rng = random.Random(f"{unit}{points}")
    left, right = spans(rng, 150), spans(rng, 150, points)
    left += left[:10]
    a = spark.createDataFrame(left, "k long, s double, e double, level int")
    b = spark.createDataFrame(right, "k long, s double, e double, bin int")
    for how in ("inner", "left"):
        out = overlap_join(a, b, ("s", "e"), ("s", "e"), ("k",), how, unit)
        assert out.columns == ["k", "s", "e", "level", "s_right", "e_right", "bin"]
        assert sorted(map(repr, map(tuple, out.collect()))) == brute(left, right, how)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    assert overlap_join(a.limit(0), b, ("s", "e"), ("s", "e"), ("k",), "left", unit).count() == 0
    assert overlap_join(a, b.limit(0), ("s", "e"), ("s", "e"), ("k",), "left", unit).count() == len(left)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int", "decimal(12,3)", "float"])
def test_types_of_bounds(spark, kind):
    rng = random.Random(kind)
    rows = [(i, rng.randint(0, 4000), rng.choice([0, 1, 30, 900])) for i in range(120)]
    at = {"date": "date_add(date'1960-01-01', {})", "int": "cast({} as int)", "decimal(12,3)": "cast(({}) / 7 as decimal(12,3))", "float": "cast(({}) / 7 as float)"}.get(kind, f"cast(timestamp'1965-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {{}}, 0) as {kind})")
    df = spark.createDataFrame(rows, "id int, s int, w int").selectExpr("id", f"{at.format('s')} s", f"{at.format('s + w')} e")
    want = sorted((a, b) for a, s, w in rows for b, t, v in rows if s <= t + v and t <= s + w)
    got = overlap_join(df, df, ("s", "e"), ("s", "e"))
    assert sorted((r.id, r.id_right) for r in got.collect()) == want


def test_rows_are_not_multiplied_by_width(spark):
    """A span of a million units is in two bins of a coarse level, not in a million of the finest."""
    left = spark.createDataFrame([(i, i * 1.0, i + 0.5) for i in range(200)] + [(999, 0.0, 1e6)], "id int, s double, e double")
    out = overlap_join(left, left, ("s", "e"), ("s", "e"), unit=0.5)
    assert out.count() == 200 + 2 * 200 + 1
    from tidewater.operators import intervals

    own = left.selectExpr("id", "s at", "e to", "case when id = 999 then 7 else 0 end own")
    assert intervals._binned(own, [0, 7], 0.5).where("id = 999").count() <= 2
    assert intervals._binned(own, [0, 7], 0.5).where("id = 5").count() <= 4


def test_band(spark):
    rng = random.Random(9)
    left = [(i, round(rng.uniform(0, 50), 1)) for i in range(100)] + [(200, None)]
    right = [(i, round(rng.uniform(0, 50), 1), "x") for i in range(100)] + [(200, None, "y")]
    a, b = spark.createDataFrame(left, "id int, x double"), spark.createDataFrame(right, "id int, x double, _low string")
    got = band_join(a, b, "x", "x", 0.25, 0.75)
    assert got.columns == ["id", "x", "id_right", "x_right", "_low"]
    want = sorted((i, j) for i, x in left for j, y, _ in right if x is not None and y is not None and x - 0.25 <= y <= x + 0.75)
    assert sorted((r.id, r.id_right) for r in got.collect()) == want
    with pytest.raises(ValueError):
        overlap_join(a, b, ("x", "x"), ("x", "x"), how="full")


@pytest.mark.parametrize("name", sorted(joins.ORACLE))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = joins.QUERIES[name](spark, SF)
    want = con.sql(f"select {', '.join(df.columns)} from ({joins.ORACLE[name]})").fetchall()
    assert len(want) > 0 and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
