import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewater.llm import quality_rules as rules
from tidewater.llm import queries

SF = "/root/testdata/sf0.01"


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def plain(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))


def brute_common(fit):
    """The thirty words with the largest mean shares, in millionths, of each language's texts."""
    sums: dict = {}
    for r in fit:
        words = plain(r.text)
        for w, n in Counter(words).items():
            own = sums.setdefault(r.lang, Counter())
            own[w] += 1_000_000 * n // len(words)
    return {lang: sorted(own, key=lambda w: (-own[w], w.encode()))[:30] for lang, own in sorted(sums.items())}


def brute_shares(text, common_words):
    shares, words = [], re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    chars = Counter(rules.CLASSES[rules._class_table()[ord(c)]] for c in text)
    del chars["space"]
    shares.append([chars[c] / max(1, chars.total()) for c in rules.CLASSES if c != "space"])
    for common in common_words.values():
        found = Counter(w for w in words if w in common)
        shares.append([found[w] / max(1, len(words)) for w in common] + [(len(words) - found.total()) / max(1, len(words))])
    return shares


def jsd(p, q):
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2))


def test_query_against_brute_force(spark):
    rows = queries.documents(spark, SF).select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in rules.judge(queries.documents(spark, SF)).collect()}
    base = {r.doc_id: brute_base(r.text) for r in rows}
    fit = [r for r in rows if not base[r.doc_id][5] and base[r.doc_id][0] >= rules.REFERENCE_WORDS]
    common, known = brute_common(fit), {}
    all_shares = {r.doc_id: brute_shares(r.text, common) for r in rows}
    for k, lang in enumerate(common):
        own = [all_shares[r.doc_id] for r in fit if r.lang == lang]
        known[lang] = (np.mean([s[0] for s in own], axis=0), np.mean([s[1 + k] for s in own], axis=0))
    for r in rows:
        n, failed = base[r.doc_id][0], base[r.doc_id][5]
        char = min(jsd(all_shares[r.doc_id][0], c) for c, _ in known.values())
        word = min(jsd(all_shares[r.doc_id][1 + k], known[lang][1]) for k, lang in enumerate(common))
        kept = not failed and not (n >= 20 and char > 0.2 + 1.2 / math.sqrt(n)) and not (n >= 60 and word > 0.12 + 2 / math.sqrt(n))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base[r.doc_id]
        assert g.kept == kept
        assert (g.char_distance is None) == (n < 20) and (g.char_distance is None or g.char_distance == pytest.approx(char))
    assert len(got) == len(rows) and 0 < sum(g.kept for g in got.values()) < len(rows)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op3_quality_rules(spark, SF)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE['op3_quality_rules']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op3_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert all(r.kept for r in found if r.quality == 1)
    assert sum(not r.kept for r in found if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in found)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "a b c d e f g h i j k", "xx"), (3, "x " * 100_000, "en"), (4, "a b\n\na b\n a b\n" * 3, "en"), (4, "a b\n\na b\n a b\n" * 3, "en"), (5, "ab %%% " * 40, None), (6, "\x00 ä漢 \U0001f600 | < 5 6 7 8 9 10", "de")]
    docs = spark.createDataFrame([(d, t, lang, 1) for d, t, lang in rows], "doc_id long, text string, lang string, kept int")
    got = rules.judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=repr) == sorted(((d, *brute_base(t)) for d, t, _ in rows), key=repr)
    left = rules.drop_rejected(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 6]
    assert rules.judge(docs.limit(0)).count() == 0


def test_each_row_is_judged_by_itself(spark):
    good = " ".join(f"w{i}" for i in range(12))
    rows = [(None, None, 1), (42, good, 2), (7, good, 3), (7, "short", 4), (None, good, 5), (None, "short", 6), (9, good, 7), (9, good, 8)]
    docs = spark.createDataFrame([(d, t, None, n, n) for d, t, n in rows], "doc_id long, text string, lang string, _row int, n int")
    left = rules.drop_rejected(docs)
    assert left.columns == docs.columns
    assert sorted((r.n, r._row, r.doc_id, r.text) for r in left.collect()) == [(n, n, d, t) for d, t, n in rows if t == good]


def test_other_languages(spark, tmp_path):
    """A fifth language, one with too few texts, and none; all are learned alike, and SQL says the same."""
    rng = random.Random(3)
    made = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(30)]
    italian, english = "il di che non per una sono con del della anche come più nel alla questo gli dei ma lo".split(), made("aeithnsrd")
    rare = ["".join(rng.choice("abcdeilmnoprstuvz") for _ in range(7)) for _ in range(400)]
    prose = lambda common, n: " ".join(rng.choice(common * 6 + rare) for _ in range(n))
    junk = lambda: " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(6)) for _ in range(400))
    rows = [("it", prose(italian, 400)) for _ in range(80)] + [("it", junk()), ("xx", prose(italian, 400)), (None, prose(italian, 400)), ("xx", "short")]
    rows += [("en", prose(english, 200)) for _ in range(60)] + [("en", "!!! ### " * 30 + prose(english, 50)), ("en", junk()), ("it", None), ("few", prose(english, 100))]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert [i for i, r in sorted(got.items()) if not r.kept] == [80, 83, 144, 145, 146]
    assert got[0].word_distance is not None and got[81].word_distance is None and got[82].word_distance is None
    assert {r.doc_id for r in rules.drop_rejected(docs).collect()} == {i for i, r in got.items() if r.kept}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.op3_quality_rules(spark, str(tmp_path))
    want = con.sql(f"select {', '.join(found.columns)} from ({queries.ORACLE['op3_quality_rules']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == len(rows)


def test_too_many_languages_are_an_error(spark):
    docs = spark.range(50 * 257).selectExpr("id doc_id", "'a b' text", "cast(id % 257 as string) lang")
    with pytest.raises(ValueError, match="values of lang"):
        rules.judge(docs)
    assert rules.vocabulary(docs.where("lang <> '7'")).places == {}
