import hashlib
import re

import pytest

from tidewater.llm import fingerprint, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(docs, got):
    docs = sorted(docs)
    far = []
    for (doc, text), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        r, n = got[doc], len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 256
        far += [abs(r.near_edited - jaccard(text, edited)), abs(r.near_next - jaccard(text, after))]
    assert len(got) == len(docs)
    assert max(far) < 0.2 and sum(far) / len(far) < 0.02
    same = {}
    for doc, text in docs:
        assert same.setdefault(text, got[doc].fingerprint) == got[doc].fingerprint


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()]
    check(docs, {r.doc_id: r for r in queries.op5_fingerprints(spark, SF).collect()})


def test_groups_and_edges(spark, tmp_path, monkeypatch):
    texts = ["", " \n ", "one", "a b c d", "a b c d e", "ä漢😀 x y z q r", "long " * 3 + " ".join(map(str, range(40_000)))]
    texts += [" ".join(str(i * j) for j in range(1 + i % 50)) for i in range(900)]
    ids = [i * i * 1_000_003 % 9_999_991 - 500 for i in range(len(texts))]
    assert len(set(ids)) == len(ids)
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 2)
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(list(zip(ids, texts, strict=True)), {r.doc_id: r for r in queries.op5_fingerprints(spark, str(tmp_path)).collect()})


def test_groups_are_even_however_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 20)
    runs = [(shard << 40) + i for shard in range(100) for i in range(200)]
    for ids in (runs, list(range(20_000)), [*range(13_000), *[5_000] * 7_000], [i**3 for i in range(20_000)], [None] * 20_000):
        docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
        frame = fingerprint.grouped(docs)
        sizes = [r["count"] for r in frame.groupBy("_group").count().collect()]
        most = 40 if len(set(ids)) == len(ids) else 60  # rows of one id are dealt by a hash
        assert sum(sizes) == 20_000 and max(sizes) <= most, max(sizes)
        rows = sorted((r._place, r._tie, r._group) for r in frame.collect())
        assert [g for _, _, g in rows] == sorted(g for _, _, g in rows)


@pytest.mark.parametrize("rows", [0, 300])
def test_any_cuts_give_the_same_result(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(i * 7919 % 3001, f"some text of {i % 50} and {i} words") for i in range(2000)], "doc_id long, text string")
    want = sorted(map(repr, fingerprint.compare_with_edit(docs).drop("fp", "edited_fp").collect()))
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 5)
    monkeypatch.setattr(fingerprint, "CUT_ROWS", rows)
    assert sorted(map(repr, fingerprint.compare_with_edit(docs).drop("fp", "edited_fp").collect())) == want


def test_texts_without_words_are_unlike_all_others(spark):
    docs = spark.createDataFrame([(1, ""), (2, "a b c d e f"), (3, " \n"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprint.compare_with_edit(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_nulls_ties_and_few_rows(spark):
    rows = [(None, None, 1), (None, "b c", 2), (5, "x y", 3), (5, "x y", 3), (5, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert fingerprint.compare_with_edit(docs).count() == 5
    one = fingerprint.compare_with_edit(docs.where("text = 'b c'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.compare_with_edit(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = queries.op5_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
