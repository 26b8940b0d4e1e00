"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs finds each merge."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidewater.llm.shared import byte_slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words, and pieces of words, kept with their ids in each worker, twice at most; longer ones than KNOWN_BYTES are not kept.
KNOWN, KNOWN_BYTES = 250_000, 64

_NONE = 1 << 62


@cache
def _unassigned() -> re.Pattern:
    """Code points that Python's tables of characters don't know: the vocabulary's own may be of another year."""
    spans, start = [], None
    for c in range(0x110001):
        unknown = c <= 0x10FFFF and unicodedata.category(chr(c)) == "Cn"
        if unknown and start is None:
            start = c
        elif not unknown and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(spans)}]")


def merged(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """The symbols after all merges; `ranks` has for each pair, as first << 20 | second, its rank << 32 and its result.

    Leaf i of the tree holds the rank of the pair that starts at symbol i, with i in its lower bits, so the root is the
    leftmost pair of the lowest rank. A merge updates three leaves, each upwards as far as anything changes, so a run of
    n symbols takes n log n steps however long it is.
    """
    n = len(symbols)
    width = n - 1  # leaves: one for each pair
    if not width:
        return symbols
    get = ranks.get
    tree = [_NONE] * (2 * width)
    for i in range(width):
        found = get(symbols[i] << 20 | symbols[i + 1])
        if found:
            tree[width + i] = found[0] | i
    for k in range(width - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] = symbol = ranks[symbols[i] << 20 | symbols[j]][1]
        symbols[j] = -1
        after[i] = k = after[j]
        # The two pairs beside change first; what stands above them and is the root's is renewed with the root.
        new = None
        if k < n:
            before[k] = i
            new = get(symbol << 20 | symbols[k])
            at = width + j
            old, tree[at] = tree[at], _NONE
            while tree[at >> 1] == old:
                at >>= 1
                x, y = tree[2 * at], tree[2 * at + 1]
                tree[at] = x if x < y else y
        h = before[i]
        if h >= 0:
            found = get(symbols[h] << 20 | symbol)
            value = found[0] | h if found else _NONE
            at = width + h
            old, tree[at] = tree[at], value
            if value < old:
                while value < tree[at := at >> 1]:
                    tree[at] = value
            elif value > old:
                while tree[at >> 1] == old:
                    at >>= 1
                    x, y = tree[2 * at], tree[2 * at + 1]
                    tree[at] = x if x < y else y
        at = width + i
        tree[at] = new[0] | i if new else _NONE
        while at := at >> 1:
            x, y = tree[2 * at], tree[2 * at + 1]
            tree[at] = x if x < y else y
    return [s for s in symbols if s >= 0]


class Coder:
    """Encodes and decodes with the vocabulary at `path`: lower case, NFC, byte symbols, and an end mark on each word's last."""

    #: How the vocabulary's text is cut: fixed values of the file.
    CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    END = "</w>"

    def __init__(self, path: str = VOCABULARY):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in (vocabulary | self.special).items()}
        self.ranks = {vocabulary[a] << 20 | vocabulary[b]: (r << 32, vocabulary[a + b]) for r, (a, b) in enumerate(data["model"]["merges"])}
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves
        chars = [chr(b) if b in shown else None for b in range(256)]
        spare = iter(range(256, 512))
        chars = [c or chr(next(spare)) for c in chars]
        self.inner, self.last = [vocabulary[c] for c in chars], [vocabulary[c + self.END] for c in chars]
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # What is known, and what was before that got too much: whatever is asked for again moves on.
        self.pieces: dict[str, list[int]] = {}
        self.old_pieces: dict[str, list[int]] = {}
        self.words = Known(self.word)
        self.old_words: dict[bytes, tuple[bytes, bytes]] = {}

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            found = self.old_pieces.get(piece)
            if found is None:
                raw = piece.encode()
                inner = self.inner
                found = merged([*[inner[b] for b in raw[:-1]], self.last[raw[-1]]], self.ranks)
                if len(raw) > KNOWN_BYTES:
                    return found
            if len(self.pieces) >= KNOWN:
                self.pieces, self.old_pieces = {}, self.pieces
            self.pieces[piece] = found
        return found

    def _by_library(self, part: str) -> list[int]:
        """Ids of a part with code points that only the library knows: it normalizes and cuts, the tree merges."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        ids: list[int] = []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
            ids += self._piece(bytes(self.byte_of[c] for c in piece).decode())
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text. The special tokens' own text becomes their ids, before anything else is done to it."""
        ids: list[int] = []
        for part in self.split.split(text) if "<|" in text else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            if not part.isascii() and _unassigned().search(part):
                ids += self._by_library(part)
                continue
            plain = unicodedata.normalize("NFC", part)
            # Character by character where it matters: a sigma at a word's end is no special case here.
            plain = "".join(c.lower() for c in plain) if "Σ" in plain else plain.lower()
            for piece in self.CUT.findall(plain):
                ids += self._piece(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The ids' tokens with a space between, as the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def text(self, ids: list[int]) -> str:
        """What the ids stand for: bytes put together, a space after each word."""
        out = bytearray()
        for i in ids:
            token = self.tokens[i]
            body, end = (token, True) if token in self.special else (token.removesuffix(self.END), token.endswith(self.END))
            out += token.encode() if token in self.special else bytes(self.byte_of[c] for c in body)
            out += b" " * end
        return out.decode("utf-8", "replace").rstrip(" ")

    def word(self, word: bytes) -> tuple[bytes, bytes]:
        """Ids (little-endian 32-bit) and decoded text of a word between ASCII white space."""
        found = self.old_words.get(word) or self.words.get(word)
        if found is None:
            ids = self._piece(word.decode().lower()) if word.isalpha() else self.encode(word.decode("utf-8", "replace"))  # ASCII letters are one piece
            found = (pack(f"<{len(ids)}i", *ids), self.decode(ids).encode())
            if len(word) > KNOWN_BYTES:
                return found
        if len(self.words) >= KNOWN:
            self.words, self.old_words = Known(self.word), self.words
        self.words[word] = found
        return found

    def both(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids and decoded text of a whole text. No token crosses white space, so each word is looked up by itself."""
        found = list(map(self.words.__getitem__, text.split()))
        return b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[1]])


class Known(dict):
    """Words with what Coder.word() gives for them, found when first asked for."""

    def __init__(self, word: Callable[[bytes], tuple[bytes, bytes]]):
        super().__init__()
        self.word = word

    def __missing__(self, word: bytes) -> tuple[bytes, bytes]:
        return self.word(word)


@cache
def coder(path: str) -> Coder:
    """One for each worker and vocabulary: what is known serves all tasks that the worker runs."""
    return Coder(path)


def encode_decode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded) for every row of `docs` (doc_id, text): the ids of the whole text, and what they decode to.

    A map over rows, each by itself, so equal and repeated rows have equal results. Null and empty texts, and those of
    white space alone, have no ids and decode to an empty text. A text of any length is encoded whole; a word without a break
    takes n log n steps. Of pairs of equal rank the leftmost merges first. Bytes that aren't UTF-8 count as U+FFFD. Other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coder(path).both
        for batch, texts in byte_slices(batches):
            found = [both(t) for t in texts]
            ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in found)])
            values = np.frombuffer(b"".join([ids for ids, _ in found]), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([d for _, d in found], pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {id_type}, ids array<int>, decoded string")
