"""Document fingerprints by one-permutation MinHash, in DataFrame expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import stored
from tidewater.llm.shingles import shingle_hashes, with_words

#: Bins, from a hash's upper 8 bits; low-order bits kept of each bin's least hash.
BINS, BITS = 256, 4
#: Bins that an empty bin tries in turn before it takes the one that comes first among all that are filled.
TRIES = 4
#: Documents that stand together when each meets the next; coarse ranges of ids, and most groups in each.
GROUP_ROWS, RANGES, FINE = 128, 200, 200
#: Rows whose ids tell where to cut, about, drawn by a hash; the cuts only even out groups, so any draw gives the same result.
CUT_ROWS = 1_000_000

_OPEN = (1 << 56) - 1  # the bits below the bin; all set: no hash fell into the bin


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the packed fingerprint of column `text` as `name`: 16 longs of 16 bins with 4 bits each.

    Each shingle of five words is hashed once; its upper bits are the bin, and each bin keeps its least hash. One marker
    for each bin, larger than all hashes in it, is sorted along with them, so that the first of each bin, in order, are
    all bins, and those that kept their marker are empty. An empty bin takes another's value by optimal densification:
    bins drawn by hashing its own number, the same for every document, until a filled one turns up. It keeps bits of the
    value hashed with its own number: else all bins of a text of one shingle would agree with another's by one chance. A
    text without words has all bits zero; fewer than five words are one shingle.
    """
    rest = df.columns
    markers = f"transform(sequence(-128, 127), b -> shiftleft(CAST(b AS bigint), 56) + {_OPEN}L)"
    empty = lambda v: f"({v} & {_OPEN}L) = {_OPEN}L"
    low = (1 << BITS) - 1
    tries = [f"pmod(hash(b, {t}), {BINS})" for t in range(TRIES)]
    drawn = "".join(f" WHEN NOT {empty(f'_full[{at}]')} THEN xxhash64(_full[{at}], b) & {low}L" for at in tries)
    first = f"array_min(transform(_filled, u -> (xxhash64(b, shiftright(u, 56)) & {~low}L) | (xxhash64(u, b) & {low}L))) & {low}L"
    dense = f"transform(_full, (v, b) -> CASE WHEN size(_filled) = 0 THEN 0L WHEN NOT {empty('v')} THEN v & {low}L{drawn} ELSE {first} END)"
    lanes = 64 // BITS
    lane = " | ".join(f"shiftleft(_low[{lanes} * w + {k}], {BITS * (lanes - 1 - k)})" for k in range(lanes))
    packed = f"transform(sequence(0, {BINS // lanes - 1}), w -> {lane})"
    return (
        with_words(df, text, *rest)
        .select(*rest, F.sort_array(F.concat(shingle_hashes("_words"), F.expr(markers))).alias("_sorted"))
        .select(*rest, F.expr("filter(_sorted, (h, i) -> i = 0 OR shiftright(h, 56) != shiftright(_sorted[i - 1], 56))").alias("_full"))
        .select(*rest, "_full", F.expr(f"filter(_full, v -> NOT {empty('v')})").alias("_filled"))
        .select(*rest, F.expr(dense).alias("_low"))
        .select(*rest, F.expr(f"CASE WHEN size(_low) = {BINS} THEN {packed} END").alias(name))
    )


def likeness(a: str, b: str) -> Column:
    """Estimate of the shingles' Jaccard similarity from two packed fingerprints: the share of equal bins, less what chance gives.

    A fingerprint of zeros is of a text without words: alike to another such (1), to none else (0).
    """
    spread = " | ".join(f"shiftrightunsigned(x ^ y, {k})" for k in range(BITS))
    ones = sum(1 << k for k in range(0, 64, BITS))
    differing = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(({spread}) & {ones}L)), 0, (s, n) -> s + n)")
    chance = 2.0**-BITS
    words = lambda c: F.exists(c, lambda x: x != 0)
    return F.when(words(a) != words(b), 0.0).otherwise(F.greatest(F.lit(0.0), ((1 - differing / BINS) - chance) / (1 - chance)))


def as_text(packed: str) -> Column:
    """A packed fingerprint as 256 hexadecimal digits, one for each bin."""
    return F.expr(f"array_join(transform({packed}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def _at(bounds: Column, place: str, share: str) -> tuple[Column, Column]:
    """The place of each row among sorted `bounds`, and its share within it.

    A bound that stands there several times takes rows of its own value by their share, in turn: so a value that many rows
    have is cut into as many parts as it has bounds.
    """
    below, equal = F.size(F.filter(bounds, lambda b: b < F.col(place))), F.size(F.filter(bounds, lambda b: b == F.col(place)))
    part = F.col(share) * equal
    return F.when(equal == 0, below).otherwise(below + 1 + F.floor(part)).cast("long"), F.when(equal == 0, F.col(share)).otherwise(part - F.floor(part))


def grouped(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with _place and _tie, by which rows are in order, and _range and _group, which keep that order.

    Groups have about GROUP_ROWS rows, or as many as RANGES times FINE groups need, however ids lie: ids are cut at
    quantiles of all ids, and those ranges at quantiles of their own. A row without a doc_id takes the place of a hash of
    its text. Rows of one id are in the order of a hash of their texts and are cut by it, too; only rows that are equal
    throughout stay together, where Spark's windows spill.
    """
    frame = docs.select("*", F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("_place"), F.shiftrightunsigned(F.xxhash64("text"), 11).alias("_tie"))
    shares = lambda n: [i / n for i in range(n + 1)]
    n = docs.select().count()
    fine = min(FINE, max(1, round(n / RANGES / GROUP_ROWS)))
    drawn = F.pmod(F.xxhash64("_place", "_tie"), F.lit(1_000_003)) < 1_000_003 * CUT_ROWS / max(1, n)
    seen = frame.where(drawn).agg(F.percentile_approx("_place", shares(RANGES)).alias("at")).first()
    bounds, share = _at(F.array(*(F.lit(x).cast("long") for x in seen.at or [0])), "_place", "_share")
    frame = frame.withColumn("_share", F.col("_tie") / float(1 << 53)).withColumns({"_range": bounds, "_part": share})
    cuts = frame.where(drawn).groupBy("_range").agg(F.percentile_approx("_place", shares(fine)[:-1]).alias("_cuts"))
    cuts = F.broadcast(cuts)  # RANGES times FINE numbers; a range of which no row is drawn is one group
    group, _ = _at(F.coalesce("_cuts", F.array().cast("array<bigint>")), "_place", "_part")
    return frame.join(cuts, "_range", "left").select(*docs.columns, "_place", "_tie", "_range", (F.col("_range") * (FINE + 1) + group).alias("_group"))


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """`derive` of `docs` (doc_id, text), with `next_<column>` of the row with the next doc_id; of the last, that of the first.

    One shuffle brings each group of neighbouring ids together. The first rows of groups are derived once more, for the
    last rows of those before: one row in GROUP_ROWS. Of rows with the same place a hash of the texts and then the texts
    decide.
    """
    frame = grouped(docs)
    order = Window.partitionBy("_group").orderBy("_place", "_tie", "text")
    rows = derive(frame).withColumns({f"_next_{c}": F.lead(c).over(order) for c in columns}).withColumn("_last", F.lead("_place").over(order).isNull())
    # The group after each: within its range, or the first of the next range that has one.
    groups = stored(frame.groupBy("_range", "_group").agg(F.min(F.struct("_place", "_tie")).alias("_first")), "groups")
    within = Window.partitionBy("_range").orderBy("_group")
    firsts = groups.groupBy("_range").agg(F.min("_group").alias("g"))
    over = Window.orderBy("_range")  # RANGES + 1 rows at most
    after = firsts.select("_range", F.coalesce(F.lead("g").over(over), F.first("g").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_range_next"))
    followed = groups.withColumn("_in_range", F.lead("_group").over(within)).join(after, "_range").select("_group", F.coalesce("_in_range", "_range_next").alias("_head"))
    heads = frame.join(groups.select("_group", "_first._place", "_first._tie"), ["_group", "_place", "_tie"], "left_semi")
    heads = heads.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    heads = derive(heads).select(F.col("_group").alias("_head"), *(F.col(c).alias(f"_head_{c}") for c in columns))
    joined = rows.join(followed.join(heads, "_head"), "_group", "left")
    kept = [c for c in rows.columns if not c.startswith("_")]
    return joined.select(*kept, *(F.when(F.col("_last"), F.col(f"_head_{c}")).otherwise(F.col(f"_next_{c}")).alias(f"next_{c}") for c in columns))


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, text): its packed fingerprint, that of its edited text, and their likeness.

    The edited text has the last quarter of the code points replaced by as many of the next document's first (or all).
    A null text counts as empty; two texts without words are alike (1), and one without is unlike any other (0). Texts are
    taken whole. Repeated rows, rows of one doc_id and rows without one are documents of their own, one after another; a
    table of one row follows itself, and an empty table gives no rows. Other columns are not read, whatever their names.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(texts, lambda df: with_fingerprint(df, "text", "fp"), ["text", "fp"]).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, CAST(n_chars - n_chars DIV 4 AS int)), substring(next_text, 1, CAST(n_chars DIV 4 AS int)))")
    pairs = pairs.select("doc_id", "n_chars", "fp", edited.alias("edited"), "next_fp")
    both = with_fingerprint(pairs, "edited", "edited_fp")
    return both.withColumns({"near_edited": likeness("fp", "edited_fp"), "near_next": likeness("fp", "next_fp")})
