"""Merkle manifest of a dataset: a digest for each row, a tree over each group's rows, and a path to the root for each."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import byte_slices, stored

#: Nodes under one node, and levels of a block: ARITY ** LEVELS leaves, aligned, whose paths one task makes in turn.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
#: A level of a path: the siblings to the left and to the right, each as joined hex digests.
PATH = "array<struct<left:string,right:string>>"


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """Nodes of one level, from leaves that it takes one at a time; it holds fewer than ARITY nodes for each level below."""

    def __init__(self, level: int):
        self.open: list[list[str]] = [[] for _ in range(level)]

    def take(self, leaf: str) -> str | None:
        """The node that this leaf completes, if any."""
        node = leaf
        for run in self.open:
            run.append(node)
            if len(run) < ARITY:
                return None
            node = digest(run)
            run.clear()
        return node

    def rest(self) -> str | None:
        """The node over the leaves since the last complete one, if there are any: no more leaves follow."""
        node = None
        for run in self.open:
            if node:
                run.append(node)
            node = digest(run) if run else None
            run.clear()
        return node


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def top(leaves: list[str], levels: int) -> str:
    """The node `levels` above all of the leaves."""
    tree = Treehash(levels)
    for leaf in leaves:
        node = tree.take(leaf)
    return node or tree.rest()


def paths(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For one leaf after another its (left, right) siblings at each of the `levels` below the block's top.

    Each level keeps the run of nodes that the leaf's own ancestor is in, and a treehash stack that takes one leaf at each
    step, the one a run's width ahead: the next run is there when this one ends. So a step costs a few digests a level,
    and besides the leaves themselves no more than about 3 x ARITY nodes a level are held.
    """
    spans = [ARITY ** (k + 1) for k in range(levels)]
    runs, after, ahead = [], [[] for _ in spans], [Treehash(k) for k in range(levels)]
    for k, span in enumerate(spans):
        run = [node for leaf in leaves[:span] if (node := ahead[k].take(leaf))]
        runs.append(run + [node for node in [ahead[k].rest()] if node])
    for i in range(len(leaves)):
        out = []
        for k, span in enumerate(spans):
            own = i * ARITY // span % ARITY
            out.append(("".join(runs[k][:own]), "".join(runs[k][own + 1 :])))
        yield out
        for k, span in enumerate(spans):
            if i + span < len(leaves) and (node := ahead[k].take(leaves[i + span])):
                after[k].append(node)
            if (i + 1) % span == 0:
                if node := ahead[k].rest():
                    after[k].append(node)
                runs[k], after[k] = after[k], []


def leaf_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, edited_leaf) for each row of `docs` (doc_id, source, lang, n_chars, text).

    A leaf is the digest of the five columns, each `-` if null, else its length in bytes, a colon and itself. Where the
    crc32 of doc_id in decimal is divisible by 3, edited_leaf is that of the row with A-Z of its text lower-cased, as
    somebody who tampers might; else, and for null ids, it is null. Malformed UTF-8 counts byte for byte.
    """
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    cast = docs.select("doc_id", "lang", *(F.col(c).cast("string").cast("binary").alias(f"c{i}") for i, c in enumerate(columns[:-1])), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang {docs.schema['lang'].dataType.simpleString()}, leaf string, edited_leaf string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = lambda v: b"-" if v is None else b"%d:%b" % (len(v), v)
        for batch, texts in byte_slices(batches):
            heads = list(zip(*(batch.column(f"c{i}").to_pylist() for i in range(4)), strict=True))
            there = batch.column("text").is_valid().to_pylist()
            leaves, edited = [], []
            for head, text, some in zip(heads, texts, there, strict=True):
                start = sha256(b"".join(map(field, head)))
                changed = start.copy() if head[0] is not None and crc32(head[0]) % 3 == 0 else None
                start.update(field(text if some else None))
                leaves.append(start.hexdigest())
                if changed:
                    changed.update(field(text.lower() if some else None))
                edited.append(changed and changed.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(leaves, pa.string()), pa.array(edited, pa.string())], names=["doc_id", "lang", "leaf", "edited_leaf"])

    return cast.mapInArrow(each, schema)


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """`nodes` with `at`, its place from 0 among those of its `key`, and `total`, their number; `nodes` is a stored table.

    Rows are dealt by ranges of (key, *order) and sorted there, so a key of any size is spread; a row's place is its place
    in its part after the rows of the same key in earlier parts, of which a small table tells.
    """
    spread = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = stored(spread.withColumn("place", F.monotonically_increasing_id()), "manifest-places")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    spans = placed.groupBy("key", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("key", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("key")).alias("total"))
    return placed.join(spans, ["key", "part"]).withColumn("at", F.col("place") - F.col("first") + F.col("before")).drop("part", "place", "first", "before")


def _levels(total: int) -> int:
    return LEVELS if total > BLOCK else height(total)


def _tops(nodes: DataFrame) -> DataFrame:
    """The blocks of `nodes` (key, at, total, leaf) as nodes themselves."""

    def each(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        total = block.column("total")[0].as_py()
        node = top(block.column("leaf").to_pylist(), _levels(total))
        return pa.table({"key": [key[0].as_py()], "at": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([-(-total // BLOCK)], pa.int64()), "leaf": [node]})

    of = F.floor(F.col("at") / BLOCK).alias("block")
    return nodes.select("key", of, "at", "total", "leaf").groupBy("key", "block").applyInArrow(each, "key string, at bigint, total bigint, leaf string")


def _upper(nodes: DataFrame) -> DataFrame:
    """(key, at, leaf, root, path) for a few nodes, path leading from each to the root of its key's tree."""
    if nodes.where("total > 1").isEmpty():
        return nodes.select("key", "at", "leaf", F.col("leaf").alias("root"), F.array().cast(PATH).alias("path"))
    blocks = stored(_tops(nodes), "manifest-blocks")
    return stored(_with_paths(nodes, _upper(blocks)).select("key", "at", "leaf", "root", "path"), "manifest-paths")


def _with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """`nodes` with the columns of `above` (a row for each block), whose path each leaf's own path in its block goes before."""
    nodes = nodes.withColumn("block", F.floor(F.col("at") / BLOCK))
    above = above.drop("leaf").withColumnsRenamed({"at": "block"})
    shared = [f.name for f in above.schema if f.name not in ("key", "block", "path")]
    names = [c for c in nodes.columns if c != "block"]

    def each(leaves: pa.Table, upper: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("at")
        ahead = upper.column("path")[0].as_py()
        found = [[*({"left": a, "right": b} for a, b in path), *ahead] for path in paths(leaves.column("leaf").to_pylist(), _levels(leaves.column("total")[0].as_py()))]
        out = {c: leaves.column(c) for c in names} | {c: [upper.column(c)[0].as_py()] * len(leaves) for c in shared}
        return pa.table(out | {"path": pa.array(found, pa.list_(pa.struct({"left": pa.string(), "right": pa.string()})))})

    schema = ", ".join([*(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in names), *(f"`{c}` string" for c in shared), f"path {PATH}"])
    return nodes.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(each, schema)


def manifest(leaves: DataFrame, by: str = "lang", order: str = "doc_id") -> DataFrame:
    """`leaves` (with `by`, `order` and leaf, a hex digest) with subroot, root and path, an array of (left, right) siblings.

    In each group of equal `by`, nulls being one, leaves ascend by `order`, and every eight consecutive nodes (the last run
    may have fewer, even one) become the digest of their joined hex digests while there are several. Groups' nodes, null
    first and then bytewise, likewise give the root. A path leads from a leaf over its group's node to the root, with empty
    siblings where a node has none. Null `order` comes first, and rows with equal `order` ascend by leaf; repeated rows
    have leaves of their own, equal but for their places. An empty table gives no rows.

    Rows are numbered by ranges, whatever a group's size, and paths are made by aligned blocks of 512 leaves; what lies above
    is worked out from the blocks' nodes alone, again by blocks, and is handed to each block in one row.
    """
    key = F.when(F.col(by).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(by).cast("string")))
    # Stored before anything is dealt by range, so texts are hashed once, and a task that runs again sees the same rows.
    given = stored(leaves.withColumns({"key": key, "tie": F.rand(7)}), "manifest-leaves")
    nodes = stored(numbered(given, order, "leaf", "tie").drop("tie"), "manifest-numbered")
    blocks = _upper(stored(_tops(nodes), "manifest-blocks"))
    groups = stored(blocks.where("at = 0").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("leaf")), "manifest-groups")
    ranked = stored(numbered(groups, "name"), "manifest-groups-numbered")
    roots = ranked.select("at", "name").join(_upper(ranked).select("at", "root", F.col("path").alias("rest")), "at").drop("at")
    above = blocks.withColumnRenamed("root", "subroot").join(roots.withColumnRenamed("name", "key"), "key")
    above = stored(above.select("key", "at", "leaf", "subroot", "root", F.concat("path", "rest").alias("path")), "manifest-above")
    return _with_paths(nodes, above).drop("key", "at", "total")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path; a level without siblings still counts."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "").cast("binary"), 256)
