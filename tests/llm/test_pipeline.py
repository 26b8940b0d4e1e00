import hashlib
import re

from test_lines import brute as brute_lines
from test_packing import check as check_packing
from test_simhash import brute as brute_simhash

import corpus_pipeline
from tidewater.llm import pii, queries

SF = "/root/testdata/sf0.001"


def stages(spark, docs, folder):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = queries.documents(spark, SF)
    ruled, cut, distinct, clean, packed = stages(spark, docs, tmp_path)
    for df in (ruled, cut, distinct, clean):
        assert df.columns == docs.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before, ruled, cut, distinct, clean = map(rows, (docs, ruled, cut, distinct, clean))
    kept = {r.doc_id for r in queries.op3_quality_rules(spark, SF).collect() if r.kept}
    assert ruled == {d: r for d, r in before.items() if d in kept} and 0 < len(ruled) < len(before)
    want = {d: sha for d, _, _, sha in brute_lines([(d, r.text) for d, r in ruled.items()], 10)}
    assert want == {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in cut.items()}
    groups = brute_simhash([(d, r.text) for d, r in cut.items()])
    assert distinct == {d: cut[d] for d, _, least in groups if d == least} and len(distinct) < len(cut)
    find = pii.finder(pii.default_model())
    for d, r in distinct.items():
        (_, _, spans), = find([r.text.encode()])
        assert clean[d].text == pii.redact(r.text, spans)
        assert not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", clean[d].text)
    assert clean.keys() == distinct.keys() and all(r.n_chars == len(r.text) for r in clean.values())
    check_packing([(d, r.text) for d, r in clean.items()], packed.collect(), 0)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed.collect())


def test_edges(spark, tmp_path):
    prose = "the of and to a in is that it for was on with as be at by this are from "
    rows = [(1, prose + "x", "en", "s", 1), (1, prose + "x", "en", "s", 1), (None, prose + "y", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, prose + "a@b.co z", None, "s", None), (5, "w " * 100_000, "en", "s", 5)]
    docs = spark.createDataFrame([(*r, "own", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, fp int")
    ruled, cut, distinct, clean, packed = stages(spark, docs, tmp_path / "a")
    assert {r.doc_id for r in ruled.collect()} == {1, None, 4} and clean.columns == docs.columns
    assert {r.doc_id for r in distinct.collect()} >= {1, None}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert stages(spark, docs.limit(0), tmp_path / "b")[-1].count() == 0


def test_helper_names_in_the_input(spark, tmp_path):
    names = ("_row", "_owner", "_drops", "_n_lines", "_N_dropped", "_redacted", "row")
    prose = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{prose} x{i} a{i}@b.co\nshared line", "en", 1, *(f"{n}{i}" for n in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, n_chars long, {', '.join(f'{n} string' for n in names)}")
    ruled, cut, distinct, clean, packed = stages(spark, docs, tmp_path)
    for df in (ruled, cut, distinct, clean):
        assert df.columns == docs.columns and df.count() > 0
        assert all(r[n] == f"{n}{r.doc_id}" for r in df.collect() for n in names)
    assert all("shared" not in r.text and r.n_chars == len(r.text) for r in cut.collect())
    assert all("[EMAIL]" in r.text for r in clean.collect())
