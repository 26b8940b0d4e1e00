import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import queries, vector_codes


def brute(rows, parts, entries, rounds, scale):
    """Plain k-means over rows (id, vector, label) in lists of Python integers."""
    kept = sorted((r[0], [int(np.floor(scale * np.float64(x))) for x in r[1]], r[2]) for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), label) for (i, _, label), a in zip(kept, near(), strict=True)]
    return [(i, c, e, sum(x[2] for x in out if x[3] == label)) for i, c, e, label in out], books


def result(coded):
    found = vector_codes.with_label_error(coded)
    return sorted((r.id, r.code, r.error, r.label_error) for r in found.withColumn("code", F.lower(F.hex("codes"))).collect())


@pytest.mark.parametrize("seed,spread", [(1, 2.0), (2, 0.002), (3, 0.0005)])
def test_against_brute_force_with_ties(spark, seed, spread):
    """A small spread leaves few integers, so equal distances and equal entries abound."""
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.uniform(-spread, spread))) for _ in range(6)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 6, 2), (203, [float("inf")] + [0.0] * 5, None)]
    vectors = spark.createDataFrame([(*r, "x", b"y") for r in rows], "vec_id long, embedding array<float>, label int, codes string, vec binary").repartition(5)
    coded, books = vector_codes.compress(vectors, parts=3, entries=7, rounds=4)
    want, want_books = brute(rows, 3, 7, 4, 4096)
    assert result(coded) == sorted(want) and books.tolist() == want_books
    assert sorted(map(tuple, vector_codes.with_label_error(coded, broadcast=0).collect())) == sorted(map(tuple, vector_codes.with_label_error(coded).collect()))


def test_search_is_exact_whatever_it_starts_from():
    rng = np.random.default_rng(4)
    books = rng.integers(-9, 9, (2, 16, 3))
    books[0, 5] = books[0, 3]
    x = rng.integers(-12, 12, (500, 3))
    for p in range(2):
        d = ((x[:, None] - books[p][None]) ** 2).sum(axis=2)
        for start in (np.zeros(500, int), rng.integers(0, 16, 500), d.argmax(axis=1)):
            at, far = vector_codes.Exponion(books).nearest(p, x, start)
            assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    make = lambda rows: spark.createDataFrame(rows, schema)
    coded, books = vector_codes.compress(make([]))
    assert coded.count() == 0 and coded.columns == ["id", "label", "codes", "error"] and books.shape[1] == 0
    # Fewer rows than entries, repeated rows, a null id (last), equal ids (smaller components first).
    rows = [(2, [1.0] * 8, 1), (2, [0.0] * 8, 1), (2, [0.0] * 8, 1), (None, [3.0] * 8, None)]
    coded, books = vector_codes.compress(make(rows), rounds=0)
    assert books[0].tolist() == [[0], [0], [4096], [12288]]
    assert sorted((r.id or 0, r.codes.hex(), r.error) for r in coded.collect()) == [(0, "03" * 8, 0), (2, "00" * 8, 0), (2, "00" * 8, 0), (2, "02" * 8, 0)]
    coded, _ = vector_codes.compress(make([(1, [], 1), (2, [], 1)]))
    assert [(r.codes, r.error) for r in coded.collect()] == [(b"\0" * 8, 0)] * 2
    for bad in ([(1, [0.0] * 7, 1)], [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="components"):
            vector_codes.compress(make(bad))
    with pytest.raises(Exception, match="share codebooks"):
        vector_codes.compress(make([(i, [0.0] * 8, 1) for i in range(20)] + [(99, [0.0] * 16, 1)]))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    got = queries.op11_vector_codes(spark, "/root/testdata/sf0.001")
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE['op11_vector_codes']})").fetchall()
    assert len(want) == 500 and sorted(map(tuple, got.collect())) == sorted(want)
