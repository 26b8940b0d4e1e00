import random
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.llm import manifest, queries

H = lambda nodes: sha256("".join(nodes).encode()).hexdigest()


def brute_tree(leaves):
    """Root, and for each leaf its siblings (left, right) by level."""
    nodes, at, out = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            out[leaf].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes, at = [H(nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], out


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) to sorted result rows."""
    leaf = lambda r: H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    langs = sorted({r[2] for r in rows}, key=lambda x: b"" if x is None else b"=" + x.encode())
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0], leaf(r)))
        trees[lang] = own, *brute_tree([leaf(r) for r in own])
    root, above = brute_tree([trees[lang][1] for lang in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        for r, path in zip(trees[lang][0], trees[lang][2], strict=True):
            node = leaf((*r[:4], lower(r[4]))) if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for a, b in path + up:
                node = H([a, node, b])
            out.append((r[0], leaf(r), trees[lang][1], root, H(x for level in path + up for x in level), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 72, 73, 511, 512])
def test_paths_of_a_block(n):
    leaves = [H([str(i)]) for i in range(n)]
    root, want = brute_tree(leaves)
    levels = manifest.height(n)
    assert manifest.top(leaves, levels) == root and list(manifest.paths(leaves, levels)) == want


def test_memory_of_a_traversal_is_logarithmic():
    tree = manifest.Treehash(6)
    for i in range(10_000):
        tree.take(str(i))
        assert sum(map(len, tree.open)) <= 6 * (manifest.ARITY - 1)


def run(docs):
    found = manifest.manifest(manifest.leaf_digests(docs))
    found = found.withColumn("folded_root", manifest.folded(F.coalesce("edited_leaf", "leaf"), F.col("path")))
    rows = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")), "folded_root", F.col("folded_root") == F.col("root")).collect()
    return sorted(map(tuple, rows), key=repr)


def test_against_brute_force(spark):
    """Groups of several blocks, of one row and of none; nulls everywhere, repeated rows, names in byte order, long texts."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["s", None, "ü"]), rng.choice(["en"] * 8 + ["de", "d", "Z", None, "é"]), rng.choice([None, i]), rng.choice(["", None, "Ab", f"Text {i} ÄB", "x" * 100_000])) for i in range(6000)]
    rows += [(7, None, "once", 1, "A")] + [(5, "s", "en", 1, "Repeat")] * 40 + [(None, None, None, None, None)] * 3 + [(None, "s", "en", 2, "T")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("x")).withColumn("path", F.lit(1))
    got = run(docs.repartition(7))
    assert got == brute(rows)
    tampered = [r for r in got if not r[-1]]
    assert tampered and all(r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 for r in tampered)
    assert run(docs.limit(0)) == []
    assert run(spark.createDataFrame(rows[:1], docs.drop("leaf", "path").schema)) == brute(rows[:1])


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    got = queries.op12_manifest(spark, "/root/testdata/sf0.01")
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE['op12_manifest']})").fetchall()
    assert len(want) == 1000 and sorted(map(tuple, got.collect())) == sorted(want)
    assert 0 < sum(not r[-1] for r in want) < 1000 / 2
