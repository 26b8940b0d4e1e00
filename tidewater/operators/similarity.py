"""Similarity join: for each query vector the vectors with the largest dot products, over an inverted file of cells."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.storage import Scratch

#: Cells at most, vectors of the fitting sample for each cell, and rounds of the fit. The sample is the only part of the
#: vectors that reaches the driver: CELLS * FIT vectors at most, some 42 MB at 64 components.
CELLS, FIT, ROUNDS = 4096, 40, 8
#: Share of the true answers that queries are to find, and the drawn vectors that the cells to probe are found with.
RECALL, TRIALS = 0.95, 256
#: Vectors and queries that meet in one task's group; larger cells are cut into blocks.
BLOCK = 4096
#: Decimals of a score, so that ties don't hang on the order of a sum.
DECIMALS = 9


def similar(queries: DataFrame, vectors: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", recall: float = RECALL, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the `k` rows of `vectors` with the largest dot products.

    Both sides have columns `id` and `vector`; a row is no answer to a query of its own id. Of equal scores (to nine
    decimals) the smaller id comes first; a query has fewer than `k` rows where its cells hold fewer vectors. Rows whose id
    or vector is null, or whose vector has null or non-finite components, take no part; repeated queries have an answer
    each; vectors of different lengths are an error. Empty sides give no rows. Other columns are not read.

    Equal vectors are one entry with the k + 1 smallest of their ids, as no answer can hold more of them: a vector that a
    third of all rows share is worked on once. Entries are dealt to cells by the nearest of centres that are fitted on a
    bounded draw of them; every entry is in its cell. A query is held against the entries of its nearest cells, all of
    them, by exact products. A cell of any size is cut into blocks of entries and of queries, so a group is bounded.
    Answers are approximate only in what lies in other cells: as many are probed as a trial on the draw needs for `recall`
    of its own answers, few where vectors lie in clusters, about half where they lie evenly; with `recall` 1 it is all of
    them, and answers are exact.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "similar")
    asked = scratch.keep(_whole(queries, id, vector), "queries")
    # Windows limit their rows before the shuffle, so a vector with many ids sends k + 1 from each task.
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    entries = _whole(vectors, id, vector).withColumn("n", first).where(F.col("n") <= k + 1)
    entries = scratch.keep(entries.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    total = entries.count()
    if not total:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    centres, near = _centres(entries, total, min(cells, max(1, ceil(sqrt(total)))), k, recall)
    placed = scratch.keep(_placed(entries, centres, 1), "placed")
    wanted = scratch.keep(_placed(asked, centres, near), "wanted")
    scratch.drop("entries")
    # Blocks of both sides of each cell: a row for each, so CELLS rows at most are broadcast.
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = scratch.keep(blocks(placed, "n").join(blocks(wanted, "m"), "cell"), "sizes")
    dealt = lambda n, *salt: F.pmod(F.xxhash64(*salt), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("block", dealt("n", "vec")).withColumn("part", every("m"))
    wanted = wanted.join(F.broadcast(sizes), "cell").withColumn("part", dealt("m", "row")).withColumn("block", every("n"))
    by = ("cell", "block", "part")
    id_type = vectors.schema[id].dataType.simpleString()

    def each(entries: pa.Table, queries: pa.Table) -> pa.Table:
        return _best(entries, queries, k)

    # A query row keeps its place, so that repeated queries have an answer each.
    groups = placed.select(*by, "vec", "ids").groupBy(*by).cogroup(wanted.select(*by, "row", "id", "vec").groupBy(*by))
    found = groups.applyInArrow(each, f"row bigint, query_id {asked.schema['id'].dataType.simpleString()}, vec_id {id_type}, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _whole(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(row, id, vec) of rows with an id and a vector of finite components; row tells repeated rows apart."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    kept = df.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite)
    # -0.0 and 0.0 are one value.
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))


def _matrix(vec, width: int) -> np.ndarray:
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    values = vec.flatten().to_numpy(zero_copy_only=False)
    if len(values) != width * len(vec):
        raise ValueError(f"vectors of other lengths than {width} can't be compared")
    return values.reshape(len(vec), width)


def _centres(entries: DataFrame, total: int, cells: int, k: int, recall: float) -> tuple[np.ndarray, int]:
    """Directions of cells, by k-means on a draw of about FIT entries for each, and how many a query is to probe."""
    draw = F.pmod(F.xxhash64("vec"), F.lit(1_000_003)) / 1_000_003
    drawn = entries.where(draw < min(1.0, FIT * cells / total)).select("vec").limit(FIT * cells * 2).toArrow()["vec"]
    if not len(drawn):
        drawn = entries.select("vec").limit(1).toArrow()["vec"]
    x = _matrix(drawn, len(drawn[0].as_py()))
    x = x[np.lexsort(x.T[::-1])] if x.shape[1] else x  # in one order, however rows arrive
    x = x[np.random.default_rng(3).permutation(len(x))]
    unit = _unit(x)
    parts = max(1, len(x) * cells // 20_000_000)
    nearest = lambda: np.concatenate([(p @ centres.T).argmax(axis=1) for p in np.array_split(unit, parts)])
    centres = unit[:cells].copy()
    for _ in range(ROUNDS):
        at, sums = nearest(), np.zeros_like(centres)
        np.add.at(sums, at, unit)
        used = np.bincount(at, minlength=len(centres)) > 0
        centres[used] = _unit(sums[used])
    if recall >= 1 or len(x) < 2:
        return centres, len(centres)
    at, places = nearest(), []
    for i in range(min(TRIALS, len(x))):
        products = x @ x[i]
        products[i] = -np.inf
        best = np.argpartition(-products, min(k, len(x) - 1) - 1)[:k]
        place = np.argsort(np.argsort(-(centres @ unit[i]), kind="stable"), kind="stable")
        places += place[at[best]].tolist()
    # The draw's own answers lie farther off than those among all vectors, so this errs on the safe side.
    return centres, int(np.sort(places)[min(len(places) - 1, ceil(recall * len(places)))]) + 1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _placed(df: DataFrame, centres: np.ndarray, near: int) -> DataFrame:
    """`df` with each row's `near` nearest cells, a row for each."""
    shared, names = df.sparkSession.sparkContext.broadcast(centres), df.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            if len(batch):
                order = np.argsort(-(_unit(_matrix(batch.column("vec"), held.shape[1])) @ held.T), axis=1, kind="stable")[:, :near]
                rows = pa.array(np.repeat(np.arange(len(batch)), near))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in names), pa.array(order.ravel().astype(np.int32))], names=[*names, "cell"])

    return df.mapInArrow(each, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int")


def _best(entries: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The `k` best answers that a block of entries has for each of a block of queries."""
    rows, ids, best, scores = [], [], [], []
    if len(entries) and len(queries):
        width = len(entries["vec"][0].as_py())
        x, q = _matrix(entries["vec"], width), _matrix(queries["vec"], width)
        own = entries["ids"].to_pylist()
        least = np.empty(len(own), np.int64)
        least[sorted(range(len(own)), key=lambda t: own[t][0])] = np.arange(len(own))
        products = (p for a in range(0, len(q), 256) for p in np.round(q[a : a + 256] @ x.T, DECIMALS))
        for row, query, products in zip(queries["row"].to_pylist(), queries["id"].to_pylist(), products, strict=True):
            # The best k + 1 entries, by score and then their least id: no other can have an answer.
            top = np.argpartition(-products, k)[: k + 1] if len(products) > k + 1 else np.arange(len(products))
            edge = products[top].min()
            top = np.flatnonzero(products >= edge)
            top = top[np.lexsort((least[top], -products[top]))][: k + 1]
            answers = sorted((-products[t], i) for t in top.tolist() for i in own[t] if i != query)[:k]
            rows += [row] * len(answers)
            ids += [query] * len(answers)
            best += [i for _, i in answers]
            scores += [-s + 0.0 for s, _ in answers]
    return pa.table({"row": pa.array(rows, pa.int64()), "query_id": pa.array(ids, queries.schema.field("id").type), "vec_id": pa.array(best, entries.schema.field("ids").type.value_type), "score": pa.array(scores, pa.float64())})
