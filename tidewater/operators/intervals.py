"""Joins by ranges: intervals or points that overlap, without comparing every pair."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.storage import Scratch

#: How much wider the bins of a level are than those of the level below.
FACTOR = 8


def _axis(c: Column, kind: T.DataType) -> Column:
    """Where a value lies on a line of numbers, in its order: microseconds, days, or the value itself."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    return (F.unix_date(c) if isinstance(kind, T.DateType) else c).cast("double")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: tuple[str, ...] = (), how: str = "inner", unit: float | None = None, suffix: str = "_right") -> DataFrame:
    """Rows of `left` and `right` whose spans (start, end), ends included, have a value in common, and whose `on` are equal.

    A point is a span with one column twice. Spans with a null or NaN bound, or with the end before the start, hold nothing
    and meet nothing; nor do rows with a null in `on`. With `how` "left" each left row without a partner comes once with
    nulls. Columns of `right` that `left` has as well (`on` apart, which come once) get `suffix`. Repeated rows count as
    often as they come; other columns may have any names. Numbers, dates and timestamps may be bounds, of one type.

    Widths differ, so bins do: a span's level is the first whose bins are as wide as it is, each level's FACTOR times as
    wide as the one below; level 0's are `unit` wide (by default the median width of what has one). A row is put into its
    bins, two at most, on its own level and on each coarser level that the other side has, and pairs meet by an equality
    join on (on, level, bin) on the coarser of their levels, so a span that covers years isn't cut into days. They count in
    the bin of the later start alone, so no pair is found twice and nothing needs to be made distinct. Keys and bins that
    many rows share are split by adaptive execution, as in every equality join.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    taken, more = left.columns, right.columns
    # Numbered columns, so that no name clashes with those that are made on the way.
    left, right = (df.toDF(*(f"{side}{i}" for i in range(len(df.columns)))) for df, side in ((left, "l"), (right, "r")))
    left_span, right_span = (tuple(f"{side}{names.index(c)}" for c in span) for side, names, span in (("l", taken, left_span), ("r", more, right_span)))
    if how == "left":
        # Stored, so that the numbers that tell matched rows from others stay the same.
        left = Scratch(left.sparkSession, "overlap").keep(left.withColumn("n", F.monotonically_increasing_id()), "left")
    a = _spanned(left, left_span, [f"l{taken.index(c)}" for c in on])
    b = _spanned(right, right_span, [f"r{more.index(c)}" for c in on])
    width = lambda df: df.select((F.col("to") - F.col("at")).alias("w"))
    if unit is None:
        widths = width(a).unionByName(width(b)).where("w > 0")
        unit = widths.agg(F.percentile_approx("w", 0.5, 1000)).first()[0] or 1.0
    # A numeric axis is coarse where numbers are large, so a bin may be a little narrower than a span of its level: a row
    # is in every bin from its start's to its end's, which is right for any width.
    level = lambda w: F.greatest(F.lit(0), F.ceil(F.log(w / F.lit(unit)) / F.lit(log(FACTOR)))).cast("int")
    leveled = lambda df: df.withColumn("own", F.when(F.col("to") > F.col("at"), level(F.col("to") - F.col("at"))).otherwise(0))
    a, b = leveled(a), leveled(b)
    levels = lambda df: sorted(r[0] for r in df.select("own").distinct().collect())  # noqa: E731  a few dozen at most
    of_a, of_b = levels(a), levels(b)
    a, b = _binned(a, of_b, unit), _binned(b, of_a, unit)
    keys = [f"k{i}" for i in range(len(on))]
    met = a.withColumnsRenamed({"at": "a_at", "to": "a_to", "own": "a_own"}).join(b.withColumnsRenamed({"at": "b_at", "to": "b_to", "own": "b_own"}), [*keys, "level", "bin"])
    later = F.greatest("a_at", "b_at")
    met = met.where((F.greatest("a_own", "b_own") == F.col("level")) & (F.floor(later / _size(F.col("level"), unit)) == F.col("bin")))
    met = met.where((F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1])))
    columns = [F.col(f"l{i}").alias(c) for i, c in enumerate(taken)]
    columns += [F.col(f"r{i}").alias(f"{c}{suffix}" if c in taken else c) for i, c in enumerate(more) if c not in on]
    if how == "inner":
        return met.select(*columns)
    alone = left.join(met.select("n").distinct(), "n", "left_anti")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]
    return met.select(*columns).unionByName(alone.select("*", *nulls).select(*columns))


def _spanned(df: DataFrame, span: tuple[str, str], on: list[str]) -> DataFrame:
    """`df` with its span as numbers (at, to) and its keys (k0, k1, ..), without the rows that can meet nothing."""
    start, end = (_axis(F.col(c), df.schema[c].dataType) for c in span)
    keys = {f"k{i}": F.col(c) for i, c in enumerate(on)}
    df = df.withColumns({"at": start, "to": end} | keys)
    some = F.col("at").isNotNull() & F.col("to").isNotNull() & ~F.isnan("at") & ~F.isnan("to") & (F.col("at") <= F.col("to"))
    for k in keys:
        some &= F.col(k).isNotNull()
    return df.where(some)


def _size(level: Column, unit: float) -> Column:
    return F.pow(F.lit(float(FACTOR)), level) * F.lit(unit)


def _binned(df: DataFrame, others: list[int], unit: float) -> DataFrame:
    """A row for each bin of each row: on its own level, and on the coarser ones that the other side has."""
    coarser = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("own"))
    df = df.withColumn("level", F.explode(F.concat(F.array("own"), coarser)))
    size = _size(F.col("level"), unit)
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor(F.col("to") / size))))


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, below: float, above: float, on: tuple[str, ...] = (), how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Rows whose numbers lie close: right_at from left_at - below to left_at + above. Otherwise as overlap_join()."""
    low, high = (_free([*left.columns, *right.columns], name) for name in ("_low", "_high"))
    wide = left.withColumns({low: F.col(left_at) - F.lit(below), high: F.col(left_at) + F.lit(above)})
    found = overlap_join(wide, right, (low, high), (right_at, right_at), on, how, unit=(below + above) or None, suffix=suffix)
    return found.drop(low, high)


def _free(columns: list[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
