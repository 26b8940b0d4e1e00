"""Vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.shared import byte_slices, map_texts, stored

#: Limits of a sequence: tokens, segments, and tokens that bear loss; for conversations fewer segments and loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 2048, 512, 2048
#: The loss of a sequence is a mean over its loss-bearing tokens, so three quarters of a sequence bear it at most: no few
#: sequences of answers alone weigh more than the rest.
CONVERSATIONS, CONVERSATION_LOSS = 8, 1536
#: Open sequences in a task, of texts that may be cut and of whole items, which need more of a choice.
OPEN, ITEMS_OPEN = 64, 1024
#: The id that ends a document, and the text of the vocabulary's special token with its id.
END, SPECIAL, SPECIAL_ID = 1, "<|endoftext|>", 50256
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@dataclass
class Piece:
    """Tokens `start` to `start + length` of an item; the last `loss` of them bear loss."""

    item: object
    start: int
    length: int
    loss: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        rest = self.length - n
        return Piece(self.item, self.start, n, max(0, self.loss - rest)), Piece(self.item, self.start + n, rest, min(self.loss, rest))


@dataclass
class Sequence:
    pieces: list[Piece] = field(default_factory=list)

    def split(self, size: int) -> tuple[Sequence, list[Piece]]:
        """A sequence of the first `size` tokens, and the pieces that are left over."""
        taken, rest, held = Sequence(), list(self.pieces), 0
        rest.reverse()
        while held < size:
            piece = rest.pop()
            part, more = piece.cut(min(piece.length, size - held))
            taken.pieces.append(part)
            held += part.length
            if more.length:
                rest.append(more)
        rest.reverse()
        return taken, rest

    def unpadded(self, tokens: int) -> tuple[Sequence, list[Piece]]:
        """As it is if it has `tokens`, else of as many as the largest power of two within it, and what is left over."""
        held = sum(p.length for p in self.pieces)
        return (self, []) if held in (0, tokens) else self.split(1 << (held.bit_length() - 1))


class Packer:
    """Puts pieces into a bounded pool of open sequences under three limits.

    Each piece goes where the dot product of its demands and what is left, as shares of the limits, is largest. Where it
    fits nowhere, an item that may be cut tops up the fullest sequence that takes a token; one that mustn't be cut
    closes the fullest. A sequence of cuttable items that has run out of segments or of loss before tokens keeps as many
    tokens as the largest power of two within it, which needs no padding, and gives the rest back.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = OPEN):
        self.limits, self.pool = np.array([tokens, segments, loss], float), pool
        self.open: list[Sequence] = []
        self.left = np.zeros((0, 3))
        self.back: list[Piece] = []

    def _put(self, i: int, piece: Piece) -> list[Sequence]:
        self.open[i].pieces.append(piece)
        self.left[i] -= (piece.length, 1, piece.loss)
        return [self._close(i)] if self.left[i, 0] == 0 or self.left[i, 1] == 0 else []

    def _close(self, i: int) -> Sequence:
        self.left = np.delete(self.left, i, axis=0)
        return self.open.pop(i)

    def add(self, piece: Piece, cuttable: bool = True) -> list[Sequence]:
        """Takes in a piece and gives the sequences that are now full. An uncuttable piece beyond a limit is an error."""
        done = self._add(piece, cuttable)
        return self._unpadded(done) if cuttable else done

    def _unpadded(self, done: list[Sequence]) -> list[Sequence]:
        out = []
        while done:
            for sequence in done:
                kept, rest = sequence.unpadded(int(self.limits[0]))
                out.append(kept)
                self.back += rest
            done = []
            while self.back and not done:
                done = self._add(self.back.pop(), True)
        return out

    def _add(self, piece: Piece, cuttable: bool) -> list[Sequence]:
        done = []
        while True:
            need = np.array([piece.length, 1, piece.loss], float)
            if not cuttable and (need > self.limits).any():
                raise ValueError(f"an item of {piece.length} tokens, {piece.loss} with loss, is beyond the limits")
            if cuttable and (need > self.limits).any():
                n = int(min(self.limits[0], piece.length))
                while piece.cut(n)[0].loss > self.limits[2]:
                    n -= piece.cut(n)[0].loss - int(self.limits[2])
                part, piece = piece.cut(n)
                done += self._add(part, True)
                continue
            fits = (self.left >= need).all(axis=1)
            if fits.any():
                scores = np.where(fits, (self.left / self.limits) @ (need / self.limits), -1)
                return done + self._put(int(scores.argmax()), piece)
            if len(self.open) < self.pool:
                self.open.append(Sequence())
                self.left = np.vstack([self.left, self.limits])
                return done + self._put(len(self.open) - 1, piece)
            fullest = int(self.left[:, 0].argmin())
            if cuttable:
                n = int(min(self.left[fullest, 0], piece.length - 1))
                part, rest = piece.cut(n)
                if n > 0 and part.loss <= self.left[fullest, 2]:
                    closed = self._put(fullest, part)
                    done += closed or [self._close(fullest)]
                    piece = rest
                    continue
            done.append(self._close(fullest))

    def flush(self, cuttable: bool = True) -> list[Sequence]:
        """The rest. Cuttable pieces are moved from the emptiest to the fullest; what is left at the end is cut to powers of two."""
        if not cuttable:
            out, self.open, self.left = self.open, [], np.zeros((0, 3))
            return out
        pieces = [p for i in np.argsort(self.left[:, 0], kind="stable") for p in self.open[i].pieces]
        self.open, self.left = [], np.zeros((0, 3))
        out, now, room = [], Sequence(), self.limits.copy()
        for piece in pieces:
            while piece:
                n = int(min(piece.length, room[0]))
                part, rest = piece.cut(n)
                if part.loss > room[2]:
                    n -= part.loss - int(room[2])
                    part, rest = piece.cut(n) if n > 0 else (None, piece)
                if part:
                    now.pieces.append(part)
                    room -= (part.length, 1, part.loss)
                piece = rest if rest.length else None
                if part is None or not room[0] or not room[1]:
                    kept, more = now.unpadded(int(self.limits[0]))
                    out.append(kept)
                    now, room = Sequence(), self.limits.copy()
                    pieces += more  # at the end, so that each turn gives out half of what it holds at least
        while now.pieces:
            kept, more = now.unpadded(int(self.limits[0]))
            out.append(kept)
            now = Sequence(more)
        return out


class Encoder:
    """Ids of whole texts under the byte-level vocabulary at `path`, as little-endian unsigned 32-bit integers.

    The vocabulary file is the tokenizers library's; its merges are applied by tiktoken, which takes a third of the time
    and gives the same ids, as the vocabulary's ids are in the order of its merges. The tests hold one against the other.
    A text that tiktoken gives up, as one with a million blanks in a row, goes to the tokenizers library itself.
    """

    def __init__(self, path: str = VOCABULARY):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if token != SPECIAL}
        self.tokens = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

    def ids(self, text: bytes) -> bytes:
        plain = text.decode("utf-8", "replace")
        try:
            ids = self.tokens.encode_to_numpy(plain, allowed_special={SPECIAL}, disallowed_special=())
        except ValueError:
            self.library = self.library or Tokenizer.from_file(self.path)
            ids = np.array(self.library.encode(plain, add_special_tokens=False).ids)
        return ids.astype("<u4").tobytes()


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str = VOCABULARY, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = OPEN) -> DataFrame:
    """The pieces of all rows of `docs` (doc_id, text) in sequences, with the contract's columns.

    Each task packs what it reads: no shuffle, nothing at the driver, and the pool and a slice of texts in memory. A
    document's ids end with END; null texts count as empty and so have one id; rows with the same or a null doc_id, and
    repeated rows, are documents of their own. A text of any length is encoded whole. Documents are cut freely and all
    their tokens bear loss. Where two sequences suit a piece alike, the older takes it. A task's last sequences have lengths
    that are powers of two. sequence_id holds the task's partition in its upper bits, so no two tasks share one. Other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, number = Encoder(path), Packer(tokens, segments, loss, pool), TaskContext.get().partitionId() << 33
        end = np.array([END], "<u4").tobytes()

        def rows(done: list[Sequence]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in range(7)]
            for sequence in done:
                offset = 0
                for p in sequence.pieces:
                    doc_id, ids, at, n = p.item
                    values = (doc_id, p.start, p.length, crc32(ids[4 * (p.start - at) : 4 * (p.start - at + p.length)]), n, number, offset)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    offset += p.length
                number += 1
            names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        kind = pa.int64()
        for batch, texts in byte_slices(batches):
            kind, done = batch.column("doc_id").type, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = encoder.ids(text) + end
                n, at = len(ids) // 4, 0
                while n - at >= tokens and loss >= tokens:
                    done.append(Sequence([Piece((doc_id, ids, 0, n), at, tokens, tokens)]))
                    at += tokens
                if n > at:
                    done += packer.add(Piece((doc_id, ids[4 * at :], at, n), at, n - at, n - at))  # only the tail's ids stay
            yield rows(done)
        yield rows(packer.flush())

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {id_type}, {PIECES}")


def pack_items(items: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = ITEMS_OPEN) -> DataFrame:
    """`items` (item_id, n_tokens long, n_loss long) of instruction data, each whole, as (item_id, n_tokens, n_loss, sequence_id, offset).

    Each task packs what it reads, under all three limits, the largest items of each Arrow batch first. Null counts are 0. An item beyond a limit by itself is in no
    sequence: its sequence_id and offset are null, as dropping or cutting it would change its loss. Repeated items and
    those without an id are items of their own; an empty table gives no rows.
    """
    id_type = items.schema["item_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, kind = Packer(tokens, segments, loss, pool), TaskContext.get().partitionId() << 33, None

        def rows(done: list[Sequence], alone: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            out = alone
            for sequence in done:
                offset = 0
                for p in sequence.pieces:
                    out.append((p.item, p.length, p.loss, number, offset))
                    offset += p.length
                number += 1
            names = ["item_id", "n_tokens", "n_loss", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i else kind) for i in range(5)], names=names)

        for batch in batches:
            done, alone, kind = [], [], batch.column(0).type
            for item, n, bears in sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), key=lambda r: (-(r[1] or 0), -(r[2] or 0))):
                if (n or 0) > tokens or (bears or 0) > loss:
                    alone.append((item, n, bears or 0, None, None))
                else:
                    done += packer.add(Piece(item, 0, n or 0, bears or 0), cuttable=False)
            yield rows(done, alone)
        if kind is not None:
            yield rows(packer.flush(cuttable=False), [])

    return items.select("item_id", "n_tokens", "n_loss").mapInArrow(each, f"item_id {id_type}, n_tokens long, n_loss long, sequence_id long, offset long")


def pack_conversations(turns: DataFrame, path: str = VOCABULARY, tokens: int = TOKENS, segments: int = CONVERSATIONS, loss: int = CONVERSATION_LOSS) -> DataFrame:
    """The conversations of `turns` (conv_id, turn, role, text) in sequences: (conv_id, first_turn, last_turn, start, n_tokens, n_loss, sequence_id, offset).

    A turn's tokens are its text's ids and END; those of the assistant's turns bear loss. A conversation within the limits
    is one row, and stays whole. One beyond them is cut into chains of whole turns, and a turn that is beyond them by
    itself into pieces of its tokens, so every token is in exactly one row; `start` has the tokens of first_turn before it,
    0 but for such pieces. Null texts are empty; turns without a conv_id make up one conversation without an id; turns
    ascend, nulls first, and those with one number by role and tokens. Other columns are not read; an empty table gives no rows.

    No text is shuffled. Sums of a conversation meet in one row, whatever its size; turns of those beyond the limits are
    dealt by ranges of (conv_id, turn), so that one of any size is spread; a chain ends where a task does.
    """
    made: list[Encoder] = []

    def each(texts: list[bytes]) -> dict[str, list]:
        if not made:
            made.append(Encoder(path))
        return {"n_tokens": [len(made[0].ids(t)) // 4 + 1 for t in texts]}

    counted = map_texts(turns, each, "n_tokens long", ("conv_id", "turn", "role"))
    bears = F.when(F.col("role") == "assistant", F.col("n_tokens")).otherwise(0)
    counted = stored(counted.select("conv_id", "turn", "role", "n_tokens", bears.alias("n_loss")), "turn-tokens")
    ends = (F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.lit(0).cast("long").alias("start"))
    totals = counted.groupBy("conv_id").agg(*ends, F.sum("n_tokens").alias("n_tokens"), F.sum("n_loss").alias("n_loss"))
    beyond = (F.col("n_tokens") > tokens) | (F.col("n_loss") > loss)
    long = totals.where(beyond).select(F.col("conv_id").alias("of"))
    apart = counted.join(long.hint("merge"), counted["conv_id"].eqNullSafe(long["of"]), "left_semi")
    # Stored before it is dealt by range, so that a task that runs again sees the same rows.
    order = ("conv_id", "turn", "role", "n_tokens", "tie")
    dealt = stored(apart.withColumn("tie", F.rand(5)), "long-turns").repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    names = ("conv_id", "first_turn", "last_turn", "start", "n_tokens", "n_loss")
    schema = ", ".join(f"{c} {totals.schema[c].dataType.simpleString()}" for c in names)
    chains = dealt.mapInArrow(partial(_chains, tokens=tokens, loss=loss), schema)
    items = totals.where(~beyond).select(*names).unionByName(chains)
    packed = pack_items(items.select(F.struct(*names[:4]).alias("item_id"), "n_tokens", "n_loss"), tokens, segments, loss)
    return packed.select("item_id.*", "n_tokens", "n_loss", "sequence_id", "offset")


def _chains(batches: Iterator[pa.RecordBatch], tokens: int, loss: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to chains of one conversation's consecutive turns, or pieces of a turn, within the limits."""
    chain: list | None = None
    for batch in batches:
        out = []
        for conv, turn, _, n, bears in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chain and (chain[0] != conv or chain[4] + n > tokens or chain[5] + bears > loss):
                out.append(chain)
                chain = None
            most, at = min(tokens, loss) if bears else tokens, 0
            while n - at > most:  # all of a turn's tokens bear loss, or none
                out.append([conv, turn, turn, at, most, most if bears else 0])
                at += most
            if at:
                out.append([conv, turn, turn, at, n - at, bears - at if bears else 0])
            elif chain:
                chain[2], chain[4], chain[5] = turn, chain[4] + n, chain[5] + bears
            else:
                chain = [conv, turn, turn, 0, n, bears]
        yield _chain_rows(out, batch)
        last = batch.slice(0, 0)
    if chain:
        yield _chain_rows([chain], last)


def _chain_rows(rows: list, like: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [like.schema.field(0).type, *[like.schema.field(1).type] * 2, *[pa.int64()] * 3]
    names = ["conv_id", "first_turn", "last_turn", "start", "n_tokens", "n_loss"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
