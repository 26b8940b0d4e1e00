import random

import numpy as np
import pytest

from tidewater.operators.similarity import similar
from tidewater.plans import joins

SCHEMA = "vec_id long, embedding array<float>, row string, vec int, cell int"


def brute(queries, vectors, k):
    out = {}
    for n, (q, v) in enumerate(queries):
        found = sorted((-round(float(np.dot(np.array(v, float), np.array(w, float))), 9), i) for i, w in vectors if i != q)
        out[n] = [(q, r + 1, i, -s + 0.0) for r, (s, i) in enumerate(found[:k])]
    return sorted(x for rows in out.values() for x in rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("recall", [1, 0.95])
def test_ties_copies_and_repeated_queries(spark, recall):
    rng = random.Random(1)
    some = [[float(rng.randint(-2, 2)) for _ in range(4)] for _ in range(60)]
    vectors = [(i, rng.choice(some)) for i in range(300)] + [(1000 + i, some[0]) for i in range(300)]  # half are one vector
    queries = vectors[:20] + [(1000, some[0]), (1000, some[0]), (5000, [0.0, -0.0, 0.0, 0.0])]
    got = sorted(map(tuple, similar(frame(spark, queries), frame(spark, vectors).repartition(5), 4, recall=recall).collect()))
    if recall == 1:
        assert got == brute(queries, vectors, 4)
    else:
        assert len(set(got) & set(brute(queries, vectors, 4))) >= 0.9 * len(set(got))


def test_what_takes_no_part(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (None, [9.0, 9.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0])]
    df = frame(spark, vectors)
    got = sorted(map(tuple, similar(df, df, 10, recall=1).collect()))
    assert got == [(1, 1, 2, 0.5), (1, 2, 7, -1.0), (1, 3, 7, -1.0), (2, 1, 1, 0.5), (2, 2, 7, -0.5), (2, 3, 7, -0.5)] + sorted([(7, 1, 2, -0.5), (7, 2, 1, -1.0)] * 2)
    assert similar(df.limit(0), df).count() == 0 and similar(df, df.limit(0)).count() == 0
    with pytest.raises(Exception, match="other lengths"):
        similar(df.where("vec_id < 3"), frame(spark, [(1, [1.0, 0.0]), (2, [1.0])])).collect()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got: dict = {}
    for r in joins.similar_vectors(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    asked, found = [i for i in ids if i % 100 == 0], 0
    assert sorted(got) == sorted(asked)
    for i in asked:
        products = np.round(x @ x[ids == i][0], 9)
        best = [j for j in ids[np.lexsort((ids, -products))] if j != i][:10]
        own = got[i]
        assert sorted(own) == list(range(1, 11)) and all(abs(s - products[ids == j][0]) < 1e-8 for j, s in own.values())
        assert [s for _, s in (own[r] for r in range(1, 11))] == sorted((s for _, s in own.values()), reverse=True)
        found += len({j for j, _ in own.values()} & set(best))
    assert found >= 0.9 * 10 * len(asked)


def test_blocks_change_nothing(spark, monkeypatch):
    from tidewater.operators import similarity

    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(400)]
    df = frame(spark, vectors)
    want = sorted(map(tuple, similar(df, df, 3, recall=1, cells=2).collect()))
    monkeypatch.setattr(similarity, "BLOCK", 30)
    assert sorted(map(tuple, similar(df, df, 3, recall=1, cells=2).collect())) == want and len(want) == 1200
