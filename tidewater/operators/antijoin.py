"""NOT IN over several columns, with SQL's rule for nulls, as equality joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns at most: each may be null or not, so there are as many as 2 ** COLUMNS kinds of rows on a side.
COLUMNS = 6


def not_in(left: DataFrame, right: DataFrame, columns: list[str], of: list[str] | None = None) -> DataFrame:
    """The rows of `left` whose `columns` are NOT IN the rows of `right`'s columns `of` (by default the same names).

    SQL's rule: a row stays only if its comparison with every right row is false. A null on either side makes one
    comparison unknown, and then the row goes unless another column differs. So a right row of nulls alone empties the
    result, a left row of nulls alone stays only beside an empty right side, and without right rows all rows stay. NaN
    equals NaN, as in Spark. Repeated left rows stay as often as they come, with all columns, whatever their names.

    Rows are told apart by which of their columns are null. Those of one kind meet the right rows of each kind by
    equality on the columns that neither has null, one left anti join for each set of such columns; a kind of right row
    that shares none removes the kind of left rows. Right rows are made distinct first, so a frequent one costs a row.
    """
    of = of or columns
    if not 0 < len(columns) == len(of) <= COLUMNS:
        raise ValueError(f"as many columns on both sides, {COLUMNS} at most")
    names = [f"_in{i}" for i in range(len(columns))]
    kind = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(names)))
    keys = right.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(of, names, strict=True))).distinct().withColumn("_kind", kind)
    # Numbered columns, so that no name of the caller's clashes.
    own = [f"_l{i}" for i in range(len(left.columns))]
    rows = left.toDF(*own).withColumns({n: F.col(own[left.columns.index(c)]) for c, n in zip(columns, names, strict=True)}).withColumn("_kind", kind)
    kinds = lambda df: sorted(r[0] for r in df.select("_kind").distinct().collect())  # noqa: E731  2 ** columns at most
    there = kinds(keys)
    kept = []
    for k in kinds(rows):
        part = rows.where(F.col("_kind") == k)
        shared: dict[int, list[int]] = {}
        for r in there:
            shared.setdefault(k & r, []).append(r)
        if 0 in shared:
            continue
        for bits, those in shared.items():
            on = [n for i, n in enumerate(names) if bits >> i & 1]
            part = part.join(keys.where(F.col("_kind").isin(those)).select(*on), on, "left_anti")
        kept.append(part.select(*own))
    found = reduce(DataFrame.unionByName, kept) if kept else rows.select(*own).limit(0)
    return found.toDF(*left.columns)
