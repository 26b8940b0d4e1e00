import hashlib
import random

import duckdb
from tokenizers import Tokenizer

from tidewater.llm import bpe, queries

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n\t ", "Hello, WORLD's 123 don't!!", "x<|endoftext|> y <|startoftext|>z <|end", "É é ÀÇ ñ", "ΟΔΟΣ Σ σς", "İstanbul ẞ ß", "漢字テスト 한국어 😀👍🏽",
    "a\xa0b c　d\x85e", "a\x1cb \x1f c", "\x00\x01", "'S 'LL it'Ve", "½ ² ٣", "ﬁ ǆ", "ré ́x", "...,,,!!! --- <|", "|<>|", "<|ENDOFTEXT|>",
]


def test_against_the_library():
    coder, library = bpe.Coder(), Tokenizer.from_file(bpe.VOCABULARY)
    rng = random.Random(3)
    alphabet = "aeiouthnsr  \n'.,!?éñßüÉ漢😀0123ABĆΣ"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(2000)] + ["ab" * 5000, "a" * 3001]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == want, text
        ids, decoded = coder.both(text.encode())
        assert ids == b"".join(i.to_bytes(4, "little") for i in want), text
        assert decoded.decode() == library.decode(want, skip_special_tokens=False), text


def test_every_code_point():
    """Between letters and alone: Python's tables of characters are of another year than the library's."""
    coder, library = bpe.Coder(), Tokenizer.from_file(bpe.VOCABULARY)
    texts = [f"a{c}b {c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        for text, found in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert coder.encode(text) == found.ids, ascii(text)


def test_round_trip():
    coder = bpe.Coder()
    for text in ("the quick brown fox", "naïve café 7 漢字", "a b"):
        assert coder.text(coder.encode(text)).split() == [x for w in text.split() for x in coder.CUT.findall(w)]


def test_query_against_the_library(spark):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.op8_bpe(spark, SF).collect())) == sorted(want)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "b" * 50_000), (3, "b" * 50_000)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, len(r.ids), r.decoded[:3]) for r in bpe.encode_decode(docs).collect()), key=repr)
    assert got[0][:2] == (1, 0) and got[1][:2] == (2, 0) and got[2] == got[3] and got[4] == (None, 2, "x</")
    assert bpe.encode_decode(docs.limit(0)).count() == 0
