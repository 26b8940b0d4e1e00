import hashlib
import itertools
import math
import random
import re

from tidewater.llm import queries, secret_scan

SF = "/root/testdata/sf0.01"
RULES = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text):
    fits = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    spans = [(*m.span(), k) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text) if fits[kind](m)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def test_base_spans_on_random_texts():
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "API_KEY", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abc", "x" * 6, "a1" * 11, "a1" * 12, "AKIA", "AKIA" + "Z" * 15, "AKIA" + "Z9" * 8, "é", "\n", "\t", ".", "-_+/", "g"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secret_scan.base_spans(text) == brute(text), text
    for long in ("token" + " " * 300_000, "token:" + " " * 300_000, "token" * 60_000, "a" * 300_000, "AKIA" * 80_000, "token= " * 50_000, "x." * 200_000, "=" * 300_000):
        assert len(secret_scan.base_spans(long)) <= 50_000
        secret_scan.finder(secret_scan.default_formats())([long.encode()])


def test_held_out_credentials_and_plain_runs():
    formats = secret_scan.default_formats()
    find = secret_scan.finder(formats)
    held = secret_scan.labelled(99, 60, 3000)
    plain = held.pop("plain")
    for name, words in held.items():
        texts = [f"und «{w}», then ({w})." for w in words]
        found = sum({w} == {t[a:b] for a, b, _ in spans} for (_, spans, _), t, w in zip(find([t.encode() for t in texts]), texts, words, strict=True))
        assert found >= 0.95 * len(words), name
    assert sum(bool(added) for _, _, added in find([w.encode() for w in plain])) <= 0.002 * len(plain)


def test_inference_merges_states():
    rng = random.Random(2)
    # A letter and then digits, any number of them: two states say it all, for a tree of many.
    words = ["k" + "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    tree, learned = secret_scan.prefix_tree(words), secret_scan.infer(words)
    assert len(tree) > 30 and len(learned) <= 3
    assert learned[0].read.keys() == {0} and set(learned[0].read[0]) == {"k"}
    assert sum(s.ends for s in learned) == len(words) and sum(s.visits for s in learned) == sum(map(len, words)) + len(words)
    # States that behave otherwise stay apart: lower-case and upper-case runs in turn.
    words = ["".join(rng.choice("abc" if i % 2 else "XYZ") for i in range(20)) for _ in range(300)]
    learned = secret_scan.infer(words)
    assert all(len(s.read) <= 1 for s in learned)


def test_scores_against_a_plain_walk():
    """Each run's log-likelihood under each automaton, character by character."""
    formats = secret_scan.default_formats()
    runs = [w for ws in secret_scan.labelled(5, 20, 200).values() for w in ws if formats.shortest <= len(w) <= formats.longest]
    best, odds = formats.score(runs)
    for run, b, o in zip(runs, best, odds, strict=True):
        totals = []
        for f in range(len(formats.names)):
            at, total = int(formats.starts[f]), float(formats.lengths[len(run), f])
            for c in run:
                total += float(formats.log[at, ord(c)])
                at = int(formats.next[at, formats.classes[ord(c)]])
            totals.append(total)
        assert b == max(range(len(totals) - 1), key=totals.__getitem__) and math.isclose(o, max(totals[:-1]) - totals[-1], abs_tol=1e-6)
    sums = [sum(2.718281828459045 ** float(formats.log[s, ord(c)]) for c in itertools.chain(*secret_scan._CLASSES)) for s in range(0, len(formats.log), 7)]
    assert all(abs(x - 1) < 1e-4 for x in sums)  # what follows a state adds up to one


def test_spans_beside_the_patterns():
    find = secret_scan.finder(secret_scan.default_formats())
    key = secret_scan.labelled(21, 1, 1)["code_host"][0]
    long = "/".join(["word"] * 30_000)
    for text in (f"https://a.example.com/x?y={key}&z=1", f'{{"k":"{key}"}}', f"{long}/{key}", f"{key}.", f"é{key}é", f"path/to={key}"):
        (base, spans, added), = find([text.encode()])
        assert base == [] and [(text[a:b], n) for a, b, n in added] == [(key, "code_host")] and spans == [(added[0][0], added[0][1], 3)]
    text = f"token={key} {key}"
    (base, spans, added), = find([text.encode()])
    assert len(base) == 1 and len(added) == 1 and added[0][0] == len(text) - len(key)
    assert secret_scan.written(spans) == f"assign:0:{6 + len(key)},secret:{7 + len(key)}:{len(text)}"
    for clean in ("", "Donaudampfschifffahrtsgesellschaftskapitän", "4111111111111111 4111111111111111", long, "a" * 100_000, "-" * 100_000, "2f1c3d5e-aaaa-bbbb-cccc-0123456789ab"):
        assert find([clean.encode()])[0][2] == [], clean[:60]


def test_query_against_brute_force(spark):
    rows = queries.documents(spark, SF).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_secrets(spark, SF).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        base, r = brute(text), got[doc]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(secret_scan.written(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(secret_scan.written(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added
    assert sum(r.n_added for r in got.values()) == 0  # its documents have no secrets that the patterns miss


def test_null_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "AKIA" + "Q" * 16, "c"), (2, "AKIA" + "Q" * 16, "c")], "doc_id long, text string, spans string")
    got = secret_scan.find_secrets(docs).collect()
    assert sorted((r.doc_id or 0, r.n_access, r.spans) for r in got) == [(0, 0, ""), (1, 0, ""), (2, 1, "access:0:20"), (2, 1, "access:0:20")]
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0
