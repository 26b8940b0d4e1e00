import re
from itertools import combinations

import pytest
import xxhash

from tidewater.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{fp:016x}", least.get(find(i))) for i, ((doc, _), fp) in enumerate(zip(rows, fps, strict=True))), key=repr)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op10_simhash(spark, SF).collect()), key=repr) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (8, "one"), (9, "One"), (None, "one two"), (None, None), (10, "ä Ä x " * 30_000), (11, "a b c d e")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    found = simhash.near_duplicates(docs)
    as_hex = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in found.collect()]
    assert sorted(as_hex, key=repr) == brute(rows)
    for hot in (0, 1):  # every key is heavy, and those of several rows
        assert sorted(map(repr, simhash.near_duplicates(docs, hot=hot).collect())) == sorted(map(repr, found.collect()))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {5, 8, 10, 11} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id in (6, 7, 9)").count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1, 3, 4096])
def test_hot_buckets_lose_no_link(spark, group):
    base = 0x0123456789ABCDEF
    near = [base ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(8, 16)] + [base ^ (0b1111 << 20), base ^ (0b1111111 << 40)]
    fps = sorted(set(near) | {base ^ (0b11111111 << 10), 0, 7, 1 << 63})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), group)).collect()
    got = {}
    for r in roots:
        got.setdefault(r.root, set()).add(r.node)
    groups = []
    for f in signed:
        joined = [g for g in groups if any(((f ^ x) % 2**64).bit_count() <= 3 for x in g)]
        groups = [g for g in groups if g not in joined] + [{f}.union(*joined)]
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups if len(g) > 1)


def test_components_of_chains_and_stars(spark):
    chain = [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)]
    star = [(1000, 2000 + i) for i in range(50)] + [(1000, 1000)]
    edges = spark.createDataFrame([*chain, *star, *chain], "a long, b long")
    for broadcast, hot in ((500_000, 1000), (20, 3), (20, 1000), (2, 1), (0, 3)):
        got = {r.node: r.root for r in simhash.components(edges, broadcast, hot).collect()}
        assert got == {i: 0 for i in range(101)} | {n: 1000 for n in (1000, *range(2000, 2050))}
    assert simhash.components(edges.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, a), (3, b), (3, b), (None, c), (5, c), (5, c), (4, c), (4, d), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "r", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row string, _ROW int")
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.row for r in left.collect()} == {"r"}
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=repr) == sorted([(None, a), (3, b), (4, c), (4, d), (None, "")], key=repr)
