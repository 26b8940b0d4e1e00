"""Vector code compression: a codebook for each part of the vectors, by integer k-means with exponion search."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import stored, unstored

#: Parts of a vector, entries of each part's codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels up to which their sums are broadcast, some 2 MB; more are joined by a shuffle.
BROADCAST_LABELS = 100_000

Books = np.ndarray  # parts x entries x width


def whole_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, vec) of the rows whose vector is there with finite components alone; vec holds floor(scale * x) of each."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    kept = vectors.where(F.col(vector).isNotNull() & finite)
    return kept.select(F.col(id).alias("id"), F.col(label).alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).cast("array<bigint>").alias("vec"))


class Exponion:
    """Nearest entries by exponion search: from a part's previous entry outwards.

    An entry as near to x as the previous one, a, lies within 2|x - a| of a. So the other entries are scanned in the order
    of their distance from a, and only while that is within 2|x - a|; squares of integers decide it without rounding.
    """

    def __init__(self, books: Books):
        self.books, self.others, self.gaps = books, [], []
        for book in books:
            apart = ((book[:, None] - book[None]) ** 2).sum(axis=2)
            order = np.argsort(apart, axis=1, kind="stable")
            self.others.append([row[row != a] for a, row in enumerate(order)])
            self.gaps.append([apart[a, row] for a, row in enumerate(self.others[-1])])

    def nearest(self, part: int, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of x the nearest entry, the lower one of two, and its squared distance; `start` has the previous entries."""
        book = self.books[part]
        own = ((x - book[start]) ** 2).sum(axis=1)
        best, at = own.copy(), start.copy()
        for a in np.unique(start):
            rows = np.flatnonzero(start == a)
            for j, gap in zip(self.others[part][a], self.gaps[part][a], strict=True):
                rows = rows[4 * own[rows] >= gap]
                if not len(rows):
                    break
                d = ((x[rows] - book[j]) ** 2).sum(axis=1)
                nearer = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
                best[rows[nearer]], at[rows[nearer]] = d[nearer], j
        return at, best


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors, held against the length and the magnitude that integers of 64 bits allow for."""
    vec = batch.column("vec")
    lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} and of {lengths[lengths != width][0]} components can't share codebooks")
    found = vec.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), width)
    limit = _limit(width)
    if len(found) and width and (found.max() > limit or found.min() < -limit):
        raise ValueError(f"components beyond {limit} once multiplied overflow the squared distances of vectors with {width} components")
    return found


def _limit(width: int) -> int:
    """A magnitude up to which four times the squared distance of two vectors fits a signed 64-bit integer."""
    return min(2**30, isqrt(2**60 // max(1, width)) // 2)


def _assigned(vectors: DataFrame, books: Books, width: int) -> DataFrame:
    """(id, label, vec, codes, error): each part's nearest entry as a byte, and the squared distances summed over parts."""
    search, own = Exponion(books), width // len(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _matrix(batch, width), len(batch)
            codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
            if n and "codes" in batch.schema.names:
                codes[:] = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, -1)
            for p in range(len(books)):
                at, far = search.nearest(p, x[:, p * own : (p + 1) * own], codes[:, p].astype(np.int64))
                codes[:, p] = at
                error += far
            kept = [batch.column(c) for c in ("id", "label", "vec")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)], names=["id", "label", "vec", "codes", "error"])

    types = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label", "vec")}
    return vectors.mapInArrow(each, ", ".join(f"{c} {t}" for c, t in types.items()) + ", codes binary, error bigint")


def _moved(coded: DataFrame, books: Books, width: int) -> Books:
    """The codebooks with every entry that has parts replaced by their componentwise floor(sum / count)."""
    parts, entries, own = len(books), books.shape[1], width // len(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, own + 1), np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(batch), parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], np.hstack([x[:, p * own : (p + 1) * own], np.ones((len(batch), 1), np.int64)]))
        slots = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sums.ravel()[slots])], names=["slot", "total"])

    # A task adds up what it reads, so at most parts x entries x (width + 1) rows of it are shuffled, and as many are collected.
    found = coded.select("vec", "codes").mapInArrow(each, "slot bigint, total bigint").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    sums = np.zeros(parts * entries * (own + 1), np.int64)
    for slot, total in found:
        sums[slot] = total
    sums = sums.reshape(parts, entries, own + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(1, count), books)


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """((id, label, codes, error), codebooks): an entry's index as a byte for each part of each vector, and its squared error.

    Rows whose vector is null, or has a null, infinite or NaN component, go. The codebooks start as the vectors of the
    `entries` smallest ids and move `rounds` times; a round in which nothing moves ends them, as later ones move nothing
    either. Null ids come last; of rows with one id those with smaller components come first. Repeated rows count as
    often as they come. With fewer rows than entries there are as few entries, and without rows there is no result row.
    Empty vectors have codes of zeros. Vectors of different lengths, lengths that `parts` doesn't divide and components
    beyond the range of exact 64-bit arithmetic (16,383 at 64 components, before `scale`) are errors. Other columns are not read.

    A round is one map over the table of the round before, in the shared folder, and one over its result for the sums;
    nothing is shuffled but the sums of tasks. A table goes once the next one is written.
    """
    if entries > 256:
        raise ValueError("a code is a byte, so a codebook has 256 entries at most")
    now = whole_vectors(vectors, id, vector, label, scale)
    seeds = [r.vec for r in now.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()]
    width = len(seeds[0]) if seeds else 0
    if width % parts or len({len(s) for s in seeds}) > 1:
        raise ValueError(f"vectors of {sorted({len(s) for s in seeds})} components can't be cut into {parts} equal parts")
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width // parts).swapaxes(0, 1)
    if not seeds:
        return now.select("id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("bigint").alias("error")), books
    if width and abs(books).max() > _limit(width):
        raise ValueError(f"components beyond {_limit(width)} once multiplied overflow the squared distances")
    for done in range(rounds + 1):
        before, now = now, stored(_assigned(now, books, width), "vector-codes")
        if done:
            unstored(before)
        after = _moved(now, books, width) if done < rounds else books
        if np.array_equal(after, books):
            break
        books = after
    return now.drop("vec"), books


def with_label_error(coded: DataFrame, broadcast: int = BROADCAST_LABELS) -> DataFrame:
    """`coded` with the sum of `error` over all rows of the same label, nulls together: one row a label is joined back."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = sums.limit(broadcast + 1).count() <= broadcast
    sums = sums.withColumnRenamed("label", "of")
    return coded.join(F.broadcast(sums) if few else sums.hint("merge"), coded["label"].eqNullSafe(sums["of"])).drop("of")


def written(books: Books) -> str:
    """All components, by part, entry and position, as decimals with commas between."""
    return ",".join(map(str, books.ravel().tolist()))


def digest(books: Books) -> str:
    return sha256(written(books).encode()).hexdigest()
