import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__
from tidewater.operators.asof import asof_last
from tidewater.plans import wiring

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(wiring.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = wiring.QUERIES[name](spark, SF)
    want = con.sql(f"select {', '.join(df.columns)} from ({wiring.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_asof_nulls_ties_and_empty(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    schema = "k long, at timestamp, v long"
    right = spark.createDataFrame([(1, t[1], 5), (1, t[1], 7), (1, t[1], None), (1, None, 9), (None, t[0], 4), (2, t[0], 3), (2, t[1], None)], schema)
    rows = [(1, t[0], 0), (1, t[1], 1), (1, t[2], 2), (None, t[2], 3), (1, None, 4), (2, t[0], 5), (2, t[2], 6), (3, t[2], 7)]
    left = spark.createDataFrame([(*r, "x", "y") for r in rows], f"{schema}, side string, row string")
    for rows_of_key in (1_000_000, 1, 3):
        out = asof_last(left, right, "k", "at", "v", "got", rows_of_key)
        assert out.columns == [*left.columns, "got"]
        found = {r.v: r.got for r in out.collect()}
        assert found == {0: None, 1: 7, 2: 7, 3: None, 4: None, 5: 3, 6: None, 7: None}
        assert asof_last(left.limit(0), right, "k", "at", "v", "got", rows_of_key).count() == 0
        assert asof_last(left, right.limit(0), "k", "at", "v", "got", rows_of_key).count() == 8


def test_asof_slices_change_nothing(spark):
    rng = random.Random(5)
    rows = lambda n: [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 300), i if rng.random() < 0.9 else None) for i in range(n)]
    left, right = (spark.createDataFrame(rows(500), "k long, at int, v long") for _ in range(2))
    want = sorted(map(repr, asof_last(left, right, "k", "at", "v", "got").collect()))
    for rows_of_key in (1, 50, 300):  # every key cut, some cut, the busiest cut
        assert sorted(map(repr, asof_last(left, right, "k", "at", "v", "got", rows_of_key).collect())) == want
    brute = []
    seen = [tuple(r) for r in right.collect()]
    for k, at, v in map(tuple, left.collect()):
        near = [(t, x is not None, x) for j, t, x in seen if j == k and t <= at]
        brute.append(repr((k, at, v, max(near, key=lambda n: (n[0], n[1], n[2] or 0))[2] if near else None)))
    assert sorted(repr(tuple(r)) for r in asof_last(left, right, "k", "at", "v", "got").collect()) == sorted(brute)


def test_asof_cuts_a_busy_key_at_its_own_times(spark):
    """Rows of one hour beside a key of years: its slices have about as many rows each."""
    busy = spark.range(20_000).selectExpr("1L k", "cast(1000000 + id % 3600 as int) at", "id v")
    calm = spark.range(50).selectExpr("2L k", "cast(id * 100000 as int) at", "id v")
    left, right = busy.union(calm), busy.union(calm)
    plain = asof_last(left, right, "k", "at", "v", "got").selectExpr("sum(got) s", "count(got) n", "sum(got * at) t").first()
    out = asof_last(left, right, "k", "at", "v", "got", 5000)
    assert out.selectExpr("sum(got) s", "count(got) n", "sum(got * at) t").first() == plain and plain.n == 20_050


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_survives_what_is_absent_and_nothing_else(monkeypatch):
    plain = {name for part in __spark_entry__.PARTS for name in part.QUERIES}

    def fails(error):
        def imported(name):
            raise error

        monkeypatch.setattr(__spark_entry__, "import_module", imported)

    for name in ("tidewater.llm", "tidewater.llm.queries", "corpus_pipeline", "tokenizers"):
        fails(ModuleNotFoundError(name=name))
        assert set(__spark_entry__.queries()) == plain
    for error in (ImportError("cannot import name 'x'", name="tidewater.llm.shared"), ModuleNotFoundError(name="misspelt"), ZeroDivisionError()):
        fails(error)
        with pytest.raises(type(error)):
            __spark_entry__.queries()
