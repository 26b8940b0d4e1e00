import random
import re
import tracemalloc
import zlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import mil, queries
from tidewater.llm.quality_rules import _class_table

SF = "/root/testdata/sf0.1"


def test_gradients():
    rng = np.random.default_rng(0)
    per_text, y = np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(7, mil.N_FEATURES))
    model = mil.train(x, per_text, np.zeros(3))
    model.weights["score"] = rng.normal(size=mil.HIDDEN)
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(model.score(x, per_text), y, strict=True)])
    for name, g in model.gradients(x, per_text, y).items():
        w = np.atleast_1d(model.weights[name]).astype(float)
        at, step = tuple(s // 2 for s in w.shape), 1e-5
        sides = []
        for sign in (1, -1):
            moved = w.copy()
            moved[at] += sign * step
            model.weights[name] = moved if np.ndim(g) else moved[0]
            sides.append(loss())
        model.weights[name] = w if np.ndim(g) else w[0]
        assert np.isclose((sides[0] - sides[1]) / (2 * step), np.atleast_1d(g)[at], atol=1e-6), name


def test_passages_against_brute_force():
    texts = ["", " \n", "One TWO two two, x|y 漢字", "w " * 200 + "last!", "a\x00b " * 64]
    x, per_text = mil.encode(texts)
    at, chars = 0, len(mil.CLASSES) - 1
    for text, n in zip(texts, per_text, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        parts = [words[i : i + mil.PASSAGE] for i in range(0, len(words), mil.PASSAGE)] or [[]]
        assert len(parts) == n
        for part, row in zip(parts, x[at : at + n], strict=True):
            many, size = max(1, len(part)), max(1, sum(map(len, part)))
            assert np.isclose(row[chars], sum(w.count("|") for w in part) / many)
            assert np.isclose(row[chars + len(mil._MARKS) : -7].sum(), len(part) / many)
            repeats = sum(a == b for a, b in zip(part, part[1:], strict=False))
            assert np.allclose(row[-7:-4], [len(set(part)) / many, repeats / many, size / many / 10])
        at += n
    alone = np.concatenate([mil.encode([t])[0] for t in texts])
    assert np.allclose(x, alone)


def brute_passage(part):
    """Features of a passage (words), with plain loops."""
    chars, words = "".join(part), max(1, len(part))
    size = max(1, len(chars))
    kind = lambda c: mil.CLASSES[_class_table()[ord(c)]]
    out = [sum(kind(c) == k for c in chars) / size for k in mil.CLASSES if k != "space"]
    out += [chars.count(m) / words for m in mil._MARKS]

    def word_hash(w):
        h = 0
        for i, c in enumerate(w):
            m = (ord(c) + 1) * 0x9E3779B97F4A7C15 % 2**64 ^ i * 0xC2B2AE3D27D4EB4F % 2**64
            h += (m ^ m >> 31) * 0xBF58476D1CE4E5B9
        h %= 2**64
        return (h ^ h >> 29) * 0x94D049BB133111EB % 2**64

    hashes = [word_hash(w) for w in part]
    out += [sum(h >> 60 == b for h in hashes) / words for b in range(mil.BUCKETS)]
    lengths = [len(w) for w in part]
    spread = sum(n * n for n in lengths) / words - (size / words) ** 2
    upper = sum(len(w) > 1 and all(kind(c) == "upper" for c in w) for w in part)
    return out + [len(set(hashes)) / words, sum(a == b for a, b in pairwise(hashes)) / words, size / words / 10, max(0, spread) ** 0.5 / 10, upper / words, sum(n <= 3 for n in lengths) / words, min(words, 64) / 64]


def brute_bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return np.array([brute_passage(words[i : i + 64]) for i in range(0, len(words), 64)] or [brute_passage([])], np.float32)


def brute_score(weights, bag):
    w, each = weights, []
    for x in bag:
        h = np.maximum(0, (x - w["mean"]) / w["scale"] @ w["embed"] + w["embed_0"])
        each.append((h, float((np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["attend"])))
    top = max(e for _, e in each)
    share = [np.exp(e - top) for _, e in each]
    pooled = sum(s * h for s, (h, _) in zip(share, each, strict=True)) / sum(share)
    return 1 / (1 + np.exp(-(pooled @ w["score"] + w["score_0"])))


def test_query_against_brute_force(spark, tmp_path):
    rng, rows, labels = random.Random(6), [], []
    for i in range(60):
        good = i % 3 > 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) if good or rng.random() < 0.5 else rng.choice(["!!", "BUY", "$$", "|"]) for _ in range(rng.randint(0, 150))]
        rows.append((i, " ".join(words)))
        labels += [(i, int(good), 0)] if i % 4 else []
    rows += [(60, None), (61, ""), (62, "Ä Ö ÉÉ 漢字 " * 2000)]
    labels += [(62, 1, 0), (5, None, 0), (None, 1, 0), (1, 0, 0), (1, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op6_quality(spark, str(tmp_path)).collect()}
    bags = {d: brute_bag(t) for d, t in rows}
    label = {d: max(p for i, p, _ in labels if i == d and p is not None) for d, q, _ in labels if d is not None and q is not None}
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    fit = sorted(label.keys() - held)
    parts = [bags[d] for d in fit]  # all passages, of the one text of 125 as well
    model = mil.train(np.concatenate(parts), np.array([len(p) for p in parts]), np.array([label[d] for d in fit], float))
    for d, r in got.items():
        assert r.score == pytest.approx(brute_score(model.weights, bags[d]), abs=1e-3), d
        assert r.held_out == (d in held) and r.predicted == (r.score >= 0.3)
    assert len(got) == len(rows)


def test_what_the_driver_gets_is_bounded(spark, monkeypatch):
    """By texts: each that is drawn teaches with all its passages, and one that no longer fits isn't drawn."""
    sizes = {i: n for i, n in enumerate([3, 200, 5, 40, 1, 7, 90, 2])}
    docs = spark.createDataFrame([(i, "long text " * (32 * n)) for i, n in sizes.items()], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect()]
    seen = []
    monkeypatch.setattr(mil, "train", lambda x, per_text, y: seen.append((len(x), per_text.tolist(), y.tolist())))
    for most in (10_000, 100, 4, 0):
        want, left = [], most
        for i in order:
            if sizes[i] <= left:
                want.append(i)
                left -= sizes[i]
        mil.fit(docs, labels, passages=most)
        assert seen.pop() == (sum(sizes[i] for i in want), [sizes[i] for i in sorted(want)], [float(i % 2) for i in sorted(want)])


def test_blocks_change_nothing_and_bound_memory(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(0, 900))) + rng.choice(["", " ", "\n\n"]) for _ in range(40)] + ["", " " * 5000, "x" * 5000]
    want = mil.encode(texts)
    monkeypatch.setattr(mil, "BLOCK", 700)
    got = mil.encode(texts)
    assert np.array_equal(got[1], want[1]) and np.array_equal(got[0], want[0])
    monkeypatch.undo()
    for text in ("word another " * 400_000, "y" * 5_000_000):
        tracemalloc.start()
        mil.encode([text])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 10 * len(text) + 60_000_000, most  # the arrays of one block, whatever the text


def test_held_out_accuracy(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op6_quality(spark, SF).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    pairs = [(a, b) for a, i in held for b, j in held if i > j]
    assert len(held) > 500 and sum(a > b for a, b in pairs) >= 0.99 * len(pairs)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "long " * 100_000), (3, "long " * 100_000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")
    twice = spark.createDataFrame([(2, 1), (2, 0), (3, 0)] * 20, "doc_id long, label int")
    once = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, label int")
    fits = [mil.fit(d, x).weights for d, x in ((docs, twice), (docs.dropDuplicates(), once))]
    assert all(np.array_equal(fits[0][k], fits[1][k]) for k in fits[0])
    model = mil.fit(docs, none)
    got = mil.score(docs, model).collect()
    assert sorted(r.n_passages for r in got) == [1, 1, 1, 1563, 1563] and all(r.score == 0.5 for r in got)
    assert mil.score(docs.limit(0), model).count() == 0
