"""Grouping sets with several distinct counts, by bitmaps that merge across sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets_distinct(df: DataFrame, keys: list[str], sets: list[tuple[str, ...]], distinct: dict[str, str], sums: dict[str, Column] | None = None) -> DataFrame:
    """A row for each grouping set and each of its groups: (*keys, grouping_id, n_rows, *distinct, *sums).

    Keys that a set lacks are null, and grouping_id has a bit for each, the last key's lowest, as in SQL. `distinct` maps a
    new column to an integer column whose different values are counted; `sums` maps one to an expression that is added up,
    exact for decimals and integers. Nulls are values of keys, but are not counted and not added. A set that is listed
    twice comes once; the empty set has no row for an empty table, as with GROUP BY. Repeated rows count as they come.

    Values are bits of bitmaps of 32,768, and the finest groups hold them: rows are read once, aggregated where they are
    read, and shuffled as bitmaps. All sets, and all distinct counts in them, are made from these few bitmaps, instead of
    from a copy of each row for each set and each count. Bitmaps are full where values are dense, such as keys that
    are numbered; sparse values are counted as well, by as many bitmaps as they touch.
    """
    sums = sums or {}
    names = list(distinct)
    wide = ("bit", "part", "which")  # Which distinct count a row is for (none: the measures), and the bitmap it is in.
    k = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*(F.col(c).alias(n) for c, n in zip(keys, k, strict=True)), *(F.col(distinct[n]).cast("bigint").alias(f"_d{i}") for i, n in enumerate(names)), *(e.alias(f"_s{i}") for i, e in enumerate(sums.values())))
    bit = lambda i: F.struct(F.lit(i).alias("which"), F.bitmap_bucket_number(f"_d{i}").alias("part"), F.bitmap_bit_position(f"_d{i}").alias("bit"))
    value = base.select(*k, F.explode(F.array(*(bit(i) for i in range(len(names))))).alias("v")).select(*k, *(F.col(f"v.{c}").alias(c) for c in wide)).where("bit IS NOT NULL")
    maps = value.groupBy(*k, "which", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    measures = base.groupBy(*k).agg(F.count("*").alias("n_rows"), *(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in measures.schema if f.name not in k]
    no_map = [F.lit(None).cast(f.dataType).alias(f.name) for f in maps.schema if f.name not in k]
    finest = measures.select(*k, *no_map, *[f for f in measures.columns if f not in k]).unionByName(maps.select(*k, "which", "part", "bits", *empty))
    # Each set from the finest groups, a few rows; bitmaps of a set's group are merged part by part, then bits are counted.
    ids = dict.fromkeys(sum((key not in one) << (len(keys) - 1 - i) for i, key in enumerate(keys)) for one in sets)
    rows = finest.withColumn("grouping_id", F.explode(F.array(*(F.lit(i).cast("bigint") for i in ids))))
    rows = rows.withColumns({n: F.when(F.col("grouping_id").bitwiseAND(1 << (len(keys) - 1 - i)) == 0, F.col(n)) for i, n in enumerate(k)})
    merged = rows.groupBy(*k, "grouping_id", "which", "part").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n_rows").alias("n_rows"), *(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))))
    counts = [F.coalesce(F.sum(F.when(F.col("which") == i, F.bitmap_count("bits"))), F.lit(0)).cast("bigint").alias(n) for i, n in enumerate(names)]
    out = merged.groupBy(*k, "grouping_id").agg(F.sum("n_rows").alias("n_rows"), *counts, *(F.sum(f"_s{i}").alias(n) for i, n in enumerate(sums)))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), "grouping_id", "n_rows", *names, *sums)


def cube(keys: list[str]) -> list[tuple[str, ...]]:
    """All subsets of the keys, as sets to group by."""
    return [tuple(key for i, key in enumerate(keys) if bits >> i & 1) for bits in range(2 ** len(keys) - 1, -1, -1)]


def rollup(keys: list[str]) -> list[tuple[str, ...]]:
    """The keys, without the last, without the last two, and so on."""
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]
