import itertools
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidewater.llm import langid, queries, viterbi

SF = "/root/testdata/sf0.01"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 6, 2, 6, 0])
    emissions, transitions = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    got, at = viterbi.decode(emissions, lengths, transitions), 0
    for n in lengths:
        e = emissions[at : at + n]
        worth = lambda path, e=e: sum(e[t, k] for t, k in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path))
        assert tuple(got[at : at + n]) == max(itertools.product(range(3), repeat=n), key=worth)
        at += n
    uniform = -0.7 * (1 - np.eye(3))
    for e in (emissions, np.round(emissions), np.zeros_like(emissions)):
        assert (viterbi.decode(e, lengths, 0.7) == viterbi.decode(e, lengths, uniform)).all()
    assert len(viterbi.decode(emissions[:0], lengths[:0], transitions)) == 0


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in queries.documents(spark, SF).select("doc_id", "lang").collect()}
    got = queries.op2_language(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def brute(rows):
    """Predictions of op2 for (doc_id, text, lang), with plain loops."""
    word = regex.compile(r"\p{L}+")
    script = lambda c: langid.SCRIPTS.index(max((a, s) for a, s in langid._RANGES if a <= ord(c))[1])

    def buckets(w):
        chars, out = f"\x02{w}\x03", []
        for i in range(len(chars)):
            v = 0
            for n, c in enumerate(chars[i : i + 4], 1):
                v = (v * 0x9E3779B97F4A7C15 + ord(c) + n) % 2**64
                out.append((v ^ v >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 49)
        return out

    train = [(t, k) for d, t, k in rows if zlib.crc32(str(d).encode()) % 4 != 2 and t is not None and k is not None]
    langs = sorted({k for _, k in train})
    hits, seen = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for t, k in train:
        for w in word.findall(t.lower()):
            hits[k].update(buckets(w))
            seen[k].update(map(script, w))
    log = {k: lambda b, k=k: math.log((hits[k][b] + 0.5) / (hits[k].total() + 0.5 * langid.BUCKETS)) for k in langs}
    allowed = {k: {s for s, n in seen[k].items() if n >= max(1, 0.01 * sum(m for x, m in seen[k].items() if x))} for k in langs}

    def scores(w):
        own = buckets(w)
        mean = {b: sum(log[k](b) for k in langs) / len(langs) for b in own}
        kinds = Counter(map(script, w))
        top = min((s for s in kinds if s), key=lambda s: (-kinds[s], s), default=1)
        can = [k for k in langs if top in allowed[k]] or langs
        return {k: max(-4, min(4, sum(log[k](b) - mean[b] for b in own) / math.sqrt(len(own)))) if k in can else -1e6 for k in langs}

    out = {}
    for d, t, _ in rows:
        words = word.findall((t or "").lower())
        if not words:
            out[d] = ("und", 0.0)
            continue
        each, paths = [scores(w) for w in words], []
        best = {k: (each[0][k], [k]) for k in langs}
        for e in each[1:]:
            best = {k: max(((best[j][0] - 6 * (j != k), best[j][1]) for j in langs), key=lambda x: x[0]) for k in langs}
            best = {k: (v + e[k], [*path, k]) for k, (v, path) in best.items()}
        paths = max(best.values(), key=lambda x: x[0])[1]
        share = {k: sum(len(w) for w, p in zip(words, paths, strict=True) if p == k) / sum(map(len, words)) for k in langs}
        lang = max(langs, key=lambda k: share[k] + 0.05 * (k == paths[0]))
        out[d] = (lang, share[lang])
    return out


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    pools = {"en": "the house and water with that thing of is".split(), "de": "das haus und die schwester nicht über ist".split(), "ru": "это дом и вода что как так не".split(), "bg": "това къща и вода че как така не".split()}
    rows = [(i, " ".join(rng.choice(pools[k]) for _ in range(rng.randint(3, 12))), k) for i, k in enumerate(sorted(pools) * 12)]
    rows += [(100, "the house and water это дом и вода так", "en"), (101, None, "de"), (102, "12 --", None), (103, "", "ru"), (104, "das haus the water 漢字", None), (105, "ελληνικά", None)]
    rows += [(106, " ".join([*pools["en"] * 2, "дом", *pools["en"] * 2]), None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_language(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert {d: r.lang_pred for d, r in got.items()} == {d: lang for d, (lang, _) in want.items()}
    assert all(got[d].score == pytest.approx(score) and got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, (_, score) in want.items())


def test_long_sequences_in_blocks(monkeypatch):
    """Equal to the plain walk, ties as well; few different scores make many."""
    rng = np.random.default_rng(7)
    for labels in (1, 2, 4, 6):
        for transitions in (1.0, 0.0, rng.integers(-2, 3, (labels, labels)).astype(float), rng.normal(size=(labels, labels))):
            for scores in (rng.integers(-1, 2, (3000, labels)).astype(np.float32), rng.normal(size=(3000, labels)).astype(np.float32)):
                lengths = np.array([0, 1, 2, 3, 700, 5, 1500, 789])
                want = viterbi.decode(scores, lengths, transitions)
                for long in (1, 4, 600):
                    monkeypatch.setattr(viterbi, "LONG", long)
                    assert np.array_equal(viterbi.decode(scores, lengths, transitions), want)
                monkeypatch.undo()


def test_a_long_text_takes_no_time_of_its_own():
    rng = np.random.default_rng(8)
    for labels, transitions in ((4, 6.0), (6, rng.normal(size=(6, 6)))):
        scores = rng.normal(size=(1_000_000, labels)).astype(np.float32)
        start = time.perf_counter()
        viterbi.decode(scores, np.array([1_000_000]), transitions)
        assert time.perf_counter() - start < 5


def test_letters_are_category_l():
    for c in map(chr, range(0x30000)):
        assert bool(langid.words_of(f"{c}½")) == bool(regex.fullmatch(r"\p{L}", c)) or unicodedata.category(c) == "Cn", hex(ord(c))


def test_numbers_are_no_letters_and_each_language_teaches(spark):
    """Copies of one row are all drawn or none, so one text of each language is taken whatever its hash."""
    many = spark.range(20_000).selectExpr("1L doc_id", "'это дом и вода как так' text", "'ru' lang")
    docs = many.union(spark.createDataFrame([(2, "the house and the water", "en"), (3, "½ ² ① Ⅷ 12 _", None)], "doc_id long, text string, lang string"))
    for i in range(6):
        model = langid.fit(docs.withColumn("doc_id", F.col("doc_id") + 10 * i), sample=50)
        assert model.langs == ["en", "ru"] and (model.scores != 0).any()
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs.where("doc_id > 1").union(many.limit(1)), model).collect()}
        assert got == {1: ("ru", 1.0), 2: ("en", 1.0), 3: ("und", 0.0)}


def test_equal_languages_are_told_apart_by_rule(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["b", "a", "b", "c"])], "doc_id long, text string, lang string")
    got = langid.identify(docs.union(docs), langid.fit(docs)).collect()
    assert len(got) == 8 and len({(r.lang_pred, r.score) for r in got}) == 1


def test_spans_scripts_and_edges(spark):
    english, german, russian = "the house and the water with that thing", "das haus und die schwester nicht über", "это дом и вода что как так"
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(english, "en"), (german, "de"), (russian, "ru"), (english, None), (None, "fr")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "ru"]
    found = langid.Identifier(model)
    text = f"{english}. {russian}! {german}"
    assert [(text[a:b], lang) for a, b, lang in found.spans(text)] == [(english, "en"), (russian, "ru"), (german, "de")]
    odd = [(1, None), (2, ""), (3, "12 -- 3"), (None, "und die"), (4, "дом " * 50_000), (4, "ελληνικά"), (5, "漢字")]
    clash = spark.createDataFrame([(d, t, 1) for d, t in odd], "doc_id long, text string, score int")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(clash, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (4, "ru")} <= got and {k for d, k in got if d in (4, 5)} <= set(model.langs)
    assert langid.identify(clash.limit(0), model).count() == 0
    nothing = langid.fit(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(clash, nothing).collect()} == {"und"}


def test_word_features_depend_on_the_word_alone():
    for words in (["a"], ["a", "bcd", "éè漢"], ["bcd", "a", "a"]):
        buckets, runs = langid.word_features(words)
        cut = np.split(buckets, np.cumsum(runs)[:-1])
        for w, own in zip(words, cut, strict=True):
            assert sorted(own) == sorted(langid.word_features([w])[0])


def test_rare_languages_are_learned(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(70 * 20)]
    text = lambda k: " ".join(rng.choice(words[20 * k : 20 * k + 20]) for _ in range(60))
    rows = [(f"l{k:02}", text(k)) for k in range(70) for _ in range(3 - (k == 69))]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 70
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got == {i: lang for i, (lang, _) in enumerate(rows)}
    assert langid.fit(docs, languages=70).langs == model.langs
    with pytest.raises(ValueError, match="more than 69 values of lang"):
        langid.fit(docs, languages=69)


def test_bounds_on_what_is_held_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], rng.integers(0, 50, (3, langid.BUCKETS)).astype(float), np.full((3, len(langid.SCRIPTS)), 9.0))
    texts = ["", *("".join(rng.choice(list("abcdefg  ß"), 300)) for _ in range(40)), "x"]
    want = langid.Identifier(model).predict(texts)
    monkeypatch.setattr(langid, "HELD_NUMBERS", 300)
    assert langid.Identifier(model).predict(texts) == want
