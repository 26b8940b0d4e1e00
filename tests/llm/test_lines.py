import hashlib
from collections import Counter

import duckdb
import pytest

from tidewater.llm import lines, queries

SF = "/root/testdata/sf0.01"


def brute(rows, least):
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip(" \t\n\x0b\x0c\r"))
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    found = Counter(k for _, k in {(t if d is None else d, key(x)) for d, t in rows for x in (t or "").split("\n")} if k)
    kept = [(d, len(ls), [x for x in ls if found[key(x)] < least]) for d, ls in docs]
    return sorted(((d, n, n - len(x), hashlib.sha256("\n".join(x).encode()).hexdigest()) for d, n, x in kept), key=repr)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op9_lines(spark, SF)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE['op9_lines']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(want, key=repr) == brute(con.sql("select doc_id, text from documents").fetchall(), 10)


def test_edges(spark):
    rows = [(1, "Same line\nown a"), (2, "same LINE \t\nÄ\nown b"), (3, " same line\nä"), (3, " same line\nä"), (None, "Same line\n\nx"), (None, None), (4, ""), (5, "\n \n"), (6, "z" * 200_000 + "\nsame line")]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, owner int")
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        got = lines.drop_frequent_lines(docs, 3, batches, fanout)
        assert got.columns == [*docs.columns, "_n_lines", "_n_dropped"]
        found = sorted(((r.doc_id, r._n_lines, r._n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=repr)
        assert found == brute(rows, 3)
    assert lines.drop_frequent_lines(docs.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb")] * 12 + [(i, "c\nd") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.text for r in lines.drop_frequent_lines(docs).collect()} == {"a\nb", ""}
    con = duckdb.connect()
    con.sql("create table documents as select unnest(range(1, 13)) as n, 1 as doc_id, 'a' || chr(10) || 'b' as text")
    assert con.sql(queries.ORACLE["op9_lines"]).fetchall()[0][2] == 0


def test_runs_outlive_a_call(spark):
    rows = [(i, f"seen everywhere\nown {i}\n{'late' if i > 7 else 'early'}") for i in range(14)]
    name, docs = "line_runs_of_a_test", [spark.createDataFrame(rows[a : a + 2], "doc_id long, text string") for a in range(0, 14, 2)]
    for k, part in enumerate(docs):
        got = lines.drop_frequent_lines(part, 6, 1, 2, name=name)
        seen = rows[: 2 * k + 2]
        want = brute(seen, 6)
        found = {(r.doc_id, r._n_lines, r._n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()}
        assert found == {w for w in want if w[0] in (2 * k, 2 * k + 1)}
        assert not registered(spark)  # so the next call, like another session, has nothing but the files to go by
    runs = lines.LineRuns(spark, 6, 2, name)
    assert runs.batches == 7 and 1 < len(runs.levels) and len(runs._runs()) == 3
    folders = runs._folders()
    # What jobs leave that die: after they compacted batch 3, and while they wrote batch 7.
    spark.table(runs._runs()[0]).write.parquet(f"{runs.path}/0_3_3_8")
    spark.table(runs._runs()[0]).write.parquet(f"{runs.path}/0_7_7_8")
    fs, path = runs._fs("0_7_7_8/_SUCCESS")
    fs.delete(path, False)
    runs.close()
    runs = lines.LineRuns(spark, 6, 2, name)
    assert len(runs._runs()) == 3 and runs._folders() == folders and runs.batches == 7
    runs.close()
    assert not registered(spark)


def registered(spark):
    return [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_names_of_runs(spark):
    """Any name is one of its own: letters of any case, one that another begins with, quotes, slashes, none at all."""
    names = ["web", "Web", "web_new", "web_0_0_0", "a'b\\c", "x/../y", "é %20", "", "n" * 400]
    for turn in range(2):
        for i, name in enumerate(names):
            docs = spark.createDataFrame([(100 * turn + k, f"shared by {i}\nown") for k in range(2)], "doc_id long, text string")
            got = lines.drop_frequent_lines(docs, 3, 1, 2, name=name).collect()
            assert {r._n_dropped for r in got} == {2 if turn else 0}, name
    assert not registered(spark)


def test_runs_go_when_a_call_fails(spark, monkeypatch):
    monkeypatch.setattr(lines.LineRuns, "frequent", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lines.drop_frequent_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert not registered(spark)


def test_malformed_text(spark):
    docs = spark.range(12).selectExpr("id as doc_id", "cast(concat(X'FF61', cast('\nsame\n' as binary), if(id = 3, X'C3', X'')) as string) as text")
    docs = docs.union(spark.sql("select 50L, cast(X'FFFE' as string)"))
    got = lines.drop_frequent_lines(docs).selectExpr("doc_id", "_n_dropped", "hex(cast(text as binary)) as h").collect()
    assert sorted((r.doc_id, r._n_dropped) for r in got) == [(i, 2 - (i == 3) * 0) for i in range(12)] + [(50, 0)] and {r.h for r in got if r.doc_id == 50} == {"FFFE"}
