"""Near-duplicates by SimHash: fingerprints, links by pigeonhole blocks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import HOT_ROWS, components, free_name, join_unique, map_texts, stored, unstored

#: A shingle's words, and the seed of its XXH64.
WORDS, SEED = 3, 42
#: Most bits in which linked fingerprints differ.
DISTANCE = 3
#: Blocks at each level. Fingerprints that differ in at most DISTANCE bits agree in all blocks but DISTANCE; each choice of
#: those is one table of keys. A level takes the fingerprints that fill buckets beyond GROUP at the level before, with longer
#: keys; the keys of the last leave 12 bits open, so that its buckets hold 4096 fingerprints at most, whatever the data.
LEVELS = (5, 8, 16)
GROUP = 4096
#: Hot keys up to this count are broadcast (16 MB as rows of 16 bytes); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def fingerprint_texts(texts: list[bytes]) -> np.ndarray:
    """The SimHash of each UTF-8 text as int64: a bit is 1 if it is set in over half of the shingles' hashes."""
    digest = xxhash.xxh64_intdigest
    hashes: list[np.ndarray] = []
    for text in texts:
        words = text.lower().split()
        if len(words) > WORDS:
            parts = map(b" ".join, zip(*(islice(words, k, None) for k in range(WORDS)), strict=False))
            hashes.append(np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(words) - WORDS + 1))
        else:
            hashes.append(np.array([digest(b" ".join(words), SEED)] if words else [0], np.uint64))
    out = np.empty(len(texts), np.uint64)
    for i, h in enumerate(hashes):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 65_536):
            ones += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp) for every row; a null text counts as empty, and a text without words has fingerprint 0."""
    return map_texts(docs, lambda texts: {"fp": fingerprint_texts(texts)}, "fp long", (key,))


def masks(blocks: int) -> list[int]:
    """For each choice of all blocks but DISTANCE the bits that these blocks hold, as signed 64-bit integers."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    sums = (sum(chosen) for chosen in combinations(parts, blocks - DISTANCE))
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def forest(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the links between the fingerprints of a bucket; verified by Hamming distance."""
    if len(group) == 2:
        near = (int(group[0]) ^ int(group[1])).bit_count() <= DISTANCE if group[0] >= 0 <= group[1] else np.bitwise_count((group[:1] ^ group[1:]).view(np.uint64))[0] <= DISTANCE
        return (group[:1], group[1:]) if near else (group[:0], group[:0])
    left = group.view(np.uint64)
    froms, tos = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= DISTANCE
            if near.any():
                found, left = left[near], left[~near]
                froms.append(np.full(len(found), at))
                tos.append(found)
                queue.extend(found)
    if not froms:
        return group[:0], group[:0]
    return np.concatenate(froms).view(np.int64), np.concatenate(tos).view(np.int64)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(lists).to_numpy())
        pairs = [forest(values[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs]), pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(distinct: DataFrame, group: int = GROUP, levels: tuple[int, ...] = LEVELS, scrap: list[DataFrame] | None = None) -> DataFrame:
    """Links (a, b) that join up the same fingerprints as all pairs of `distinct` (fp) within DISTANCE bits do.

    Buckets beyond `group` fingerprints never meet in a task: their members go to the next level, with longer keys. Each
    fingerprint so costs a row for each table of a level at most, and a bucket gives less links than it has members.
    Tables that the result reads are added to `scrap`.
    """
    found, scrap = [], [] if scrap is None else scrap
    for level, blocks in enumerate(levels):
        tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(blocks))))
        keyed = distinct.select("fp", F.explode(tables).alias("at")).select("fp", "at.t", "at.key")
        cold = keyed
        if level < len(levels) - 1:
            hot = stored(keyed.groupBy("t", "key").count().where(F.col("count") > group).select("t", "key"), "hot")
            scrap.append(hot)
            n = hot.count()
            if n:
                hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
                cold = keyed.join(hot, ["t", "key"], "left_anti")
        buckets = cold.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        found.append(buckets.mapInArrow(_forests, "a long, b long"))
        if level == len(levels) - 1 or not n:
            break
        distinct = stored(keyed.join(hot, ["t", "key"], "left_semi").select("fp").distinct(), "hot-fps")
        scrap.append(distinct)
        distinct = distinct.repartition("fp")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _rooted(distinct: DataFrame, group: int = GROUP, levels: tuple[int, ...] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """`distinct` (fp, ..) with root, the smallest fingerprint of fp's component; and the table that it reads."""
    scrap: list[DataFrame] = []
    found = components(links(distinct.select("fp"), group, levels, scrap))
    roots = stored(found, "roots")
    for table in (found, *scrap):
        unstored(table)
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root")), roots


def near_duplicates(docs: DataFrame, group: int = GROUP, levels: tuple[int, ...] = LEVELS, hot: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text): component_id is the smallest doc_id reachable.

    Rows whose texts are empty or null have fingerprint 0 and link like any other. Repeated rows stay, each with the same
    component. A null doc_id never is the smallest unless its whole component has no other. Of exact copies one fingerprint
    goes on. A bit that half of the hashes have is 0. Texts are taken whole, whatever their length. Other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    marked, scrap = stored(fingerprints(docs), "fingerprints"), []
    found, roots = _rooted(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows")), group, levels)
    rooted = stored(found, "rooted")
    unstored(roots)
    # A giant component and the copies of one text stay spread: see join_unique().
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    by_fp = join_unique(rooted, least, "root", scrap, hot=hot).select("fp", "component_id", F.col("n_rows").alias("n"))
    return join_unique(marked, by_fp, "fp", scrap, hot=hot).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id, nulls last, then by a hash of the text, then any.

    Rows are written with a number of their own first, so that repeated rows and rows without a doc_id are told apart. Null
    and empty texts make up a component like any other. All columns pass as they are, whatever their names; an empty table
    gives an empty table.
    """
    row = free_name(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(row).alias("row"))
    marked = stored(fingerprints(rows.select(key.alias("key"), "text"), "key"), "fingerprints")
    rooted, _ = _rooted(marked.groupBy("fp").agg(F.min("key").alias("least_id")))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("key")).select(F.col("key.row").alias(row))
    return rows.join(least.hint("merge"), row, "left_semi").select(*docs.columns)
