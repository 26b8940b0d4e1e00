import random
from zlib import crc32

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewater.llm import packing, queries

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "a \n b", "a\xa0 b", "x<|endoftext|> y", "don't we're I'LL", "　 x", "漢字 テ スト 😀", "a\x1c b", "tab\t x", " lead", "trail ", "\r\n x", "a" * 5000]


def check(rows, pieces, most):
    library = Tokenizer.from_file(packing.VOCABULARY)
    ids = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in rows]
    want = sorted(ids, key=lambda x: (repr(x[0]), len(x[1]), crc32(x[1])))
    by_doc, sequences = {}, {}
    for p in pieces:
        assert p.length > 0
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        n = sum(p.length for p in own)
        assert n <= 2048 and len(own) <= packing.SEGMENTS
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    seen = {}
    for doc, raw in want:
        seen.setdefault((doc, len(raw) // 4), []).append(raw)
    assert seen.keys() == by_doc.keys()
    for key, raws in seen.items():
        own = sorted(by_doc[key], key=lambda p: p.start)
        assert sum(p.length for p in own) == key[1] * len(raws)
        if len(raws) == 1:
            at = 0
            for p in own:
                assert p.start == at and p.ids_crc32 == crc32(raws[0][4 * at : 4 * (at + p.length)])
                at += p.length
    assert padding <= most


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    check(rows, queries.op4_packing(spark, SF).collect(), 0)


def test_edges(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "q"), (101, "r s"), (101, "r s")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    check(rows, packing.pack(docs).collect(), 0)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [(50, 4, 30), (64, 100, 64), (10, 1, 10)])
def test_limits(limits):
    rng = random.Random(2)
    for cuttable in (True, False):
        packer, out, items = packing.Packer(*limits, pool=5), [], []
        for i in range(400):
            n = rng.randint(1, limits[0] * (3 if cuttable else 1))
            items.append((i, n, rng.randint(0, min(n, limits[2]) if not cuttable else n)))
            out += packer.add(packing.Piece(*items[-1][:1], 0, *items[-1][1:]), cuttable)
            assert len(packer.open) <= 5
        out += packer.flush(cuttable)
        pieces = [p for s in out for p in s.pieces]
        for s in out:
            assert s.pieces and sum(p.length for p in s.pieces) <= limits[0] and len(s.pieces) <= limits[1] and sum(p.loss for p in s.pieces) <= limits[2]
        for i, n, loss in items:
            own = sorted((p for p in pieces if p.item == i), key=lambda p: p.start)
            assert sum(p.length for p in own) == n and sum(p.loss for p in own) == loss and (cuttable or len(own) == 1)
            assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]


def test_long_runs_of_blanks(spark):
    texts = ["x" + " " * 3_000_000 + "y", "\t" * 3_000_000 + "x", "\n" * 3_000_000 + "z", "a" + " \t\n" * 1_000_000, "\xa0" * 1_000_000 + "b", "ok"]
    check(list(enumerate(texts)), packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), 0)


def test_ids_equal_the_library_on_whole_tables():
    library, encoder = Tokenizer.from_file(packing.VOCABULARY), packing.Encoder()
    texts = [t for (t,) in duckdb.sql("select distinct text from '/root/testdata/sf0.1/documents.parquet' where text is not null").fetchall()]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.ids(text.encode()) == np.array(found.ids, "<u4").tobytes()


def test_conversations(spark):
    library = Tokenizer.from_file(packing.VOCABULARY)
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    check_conversations(library, rows, queries.conversation_packing(spark, SF).collect())


def check_conversations(library, rows, got, limits=(2048, 8, 1536)):
    """Every token in exactly one piece, turns whole but where one is beyond the limits, conversations whole if they can be."""
    turns: dict = {}
    for conv, turn, role, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        turns.setdefault(conv, []).append((turn, role or "", n, n * (role == "assistant")))
    held, pieces = {}, {}
    for r in got:
        held.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.conv_id, []).append(r)
    assert None not in held and pieces.keys() == turns.keys()
    for own in held.values():
        assert len(own) <= limits[1] and sum(r.n_tokens for r in own) <= limits[0] and sum(r.n_loss for r in own) <= limits[2]
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(q.n_tokens for q in own[:i]) for i in range(len(own))]
    for conv, own in turns.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        total, bears = sum(t[2] for t in own), sum(t[3] for t in own)
        parts = sorted(pieces[conv], key=lambda r: (r.first_turn is not None, r.first_turn or 0, r.start))
        assert sum(r.n_tokens for r in parts) == total and sum(r.n_loss for r in parts) == bears
        if total <= limits[0] and bears <= limits[2]:
            assert [(r.first_turn, r.last_turn, r.start) for r in parts] == [(min((t[0] for t in own if t[0] is not None), default=None), max((t[0] for t in own if t[0] is not None), default=None), 0)]
        elif len({t[0] for t in own}) == len(own):
            for r in parts:
                inside = [t for t in own if r.first_turn <= t[0] <= r.last_turn]
                whole = r.n_tokens == sum(t[2] for t in inside) and r.start == 0
                assert whole or len(inside) == 1 and (inside[0][2] > limits[0] or inside[0][3] > limits[2])
    return sorted(max(sum(r.n_tokens for r in own) / limits[0], len(own) / limits[1], sum(r.n_loss for r in own) / limits[2]) for own in held.values())


def test_conversations_are_dense(spark):
    library = Tokenizer.from_file(packing.VOCABULARY)
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    shares = check_conversations(library, rows, queries.conversation_packing(spark, sf).collect())
    assert sum(shares) >= 0.9 * len(shares)  # of the limit that binds


def test_odd_conversations(spark):
    library = Tokenizer.from_file(packing.VOCABULARY)
    rows = [(1, 0, "assistant", None), (None, 0, "user", "a"), (None, None, None, "b"), (2, 1, "assistant", "word " * 5000), (2, 0, "user", "x"), (1, 0, "assistant", None), (3, 5, "user", "y " * 9000)]
    rows += [(4, i, "assistant" if i % 3 else "user", "z " * (i % 40)) for i in range(3000)]  # one with most of the rows
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, n_tokens int")
    check_conversations(library, rows, packing.pack_conversations(turns.repartition(6)).collect())
    assert packing.pack_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 700])
def test_short_texts_need_no_padding(n):
    """Segments run out before tokens do; what is then open keeps a power of two."""
    packer, out = packing.Packer(), []
    for i in range(3000):
        out += packer.add(packing.Piece(i, 0, n, n))
    out += packer.flush()
    for s in out:
        held = sum(p.length for p in s.pieces)
        assert held & (held - 1) == 0 and len(s.pieces) <= packing.SEGMENTS
    seen: dict = {}
    for p in sorted((p for s in out for p in s.pieces), key=lambda p: (p.item, p.start)):
        assert seen.get(p.item, 0) == p.start
        seen[p.item] = p.start + p.length
    assert seen == dict.fromkeys(range(3000), n)


def test_items(spark):
    items = spark.createDataFrame([(i, 100 + i % 900, i % 100) for i in range(300)] + [(300, None, None)], "item_id long, n_tokens long, n_loss long")
    got = packing.pack_items(items.repartition(2)).collect()
    assert sorted(r.item_id for r in got) == list(range(301))
    with pytest.raises(ValueError):
        packing.Packer().add(packing.Piece(0, 0, 2049, 0), cuttable=False)
