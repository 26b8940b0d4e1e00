"""Window frames that Spark's SQL has no words for: GROUPS BETWEEN, and EXCLUDE."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCLUDES = ("no others", "current row", "group", "ties")
#: How the aggregates of groups make that of a frame.
MERGES = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


class Frame(NamedTuple):
    """GROUPS BETWEEN `start` AND `end` EXCLUDE `exclude`, and what is aggregated over it."""

    start: int | None
    end: int | None
    aggregates: dict[str, tuple[str, str]]
    exclude: str = "no others"

    def holds_own(self) -> bool:
        """Whether a row's own group is in the frame, before anything is excluded."""
        return (self.start is None or self.start <= 0) and (self.end is None or self.end >= 0)

    def split(self) -> bool:
        """Whether the own group is left out of the frame's two sides."""
        return self.exclude != "no others" and self.holds_own()


def groups_frame(df: DataFrame, by: list[str], order: list[str], start: int | None, end: int | None, aggregates: dict[str, tuple[str, str]], exclude: str = "no others") -> DataFrame:
    """`df` with aggregates over GROUPS BETWEEN `start` AND `end` EXCLUDE `exclude`, partitioned `by` and ordered by `order`.

    A group holds the rows of one partition that are equal in `order`; frames run from `start` to `end` groups after a
    row's own (negative: before; None: unbounded). `exclude` takes off the row itself, its group, or its group but for
    the row. `aggregates` maps a new column to (function, column), the function one of sum, count, min, max, and
    ("count", "*") for rows. Nulls are ignored as in every aggregate, so a frame without values has a null sum, min and max
    and a count of 0. Nulls in `by` are one partition, in `order` one group, the first. Repeated rows are rows of their own.
    """
    return groups_frames(df, by, order, [Frame(start, end, aggregates, exclude)])


def groups_frames(df: DataFrame, by: list[str], order: list[str], frames: list[Frame]) -> DataFrame:
    """`df` with the aggregates of several frames over the same groups, each as groups_frame() says.

    Rows of a group are aggregated before anything is ordered: the window runs over groups, of which each is one row, so a
    frame of groups is a frame of rows there, and a row costs no window of its own. Rows then take their group's frames by
    one equality join, however many frames there are. What is excluded is left out of a frame's two sides, before and after
    the own group, and the own group's part is added again without the row, from sums less the row's value and from the
    least two values of the group. Of those, each task passes on two for a group at most.
    """
    if any(frame.exclude not in EXCLUDES for frame in frames):
        raise ValueError(f"exclude is one of {EXCLUDES}")
    keys = [f"_k{i}" for i in range(len(by) + len(order))]
    own = [f"_c{i}" for i in range(len(df.columns))]
    at = {c: own[df.columns.index(c)] for c in df.columns}
    rows = df.toDF(*own)
    kinds = list(dict.fromkeys(kind for frame in frames for kind in frame.aggregates.values()))
    if unknown := {function for function, _ in kinds} - MERGES.keys():
        raise ValueError(f"no frame for {unknown}")
    columns = list(dict.fromkeys(column for _, column in kinds))
    v, n = ({c: f"_{x}{i}" for i, c in enumerate(columns)} for x in "vn")
    a, b = ({k: f"_{x}{i}" for i, k in enumerate(kinds)} for x in "ab")
    values = {v[c]: F.lit(1) if c == "*" else F.col(at[c]) for c in columns}
    rows = rows.withColumns({k: F.col(at[c]) for k, c in zip(keys, [*by, *order], strict=True)} | values)
    # Of each group: the aggregates, and how many values they are of.
    parts = [(F.count if f == "count" else MERGES[f])(v[c]).alias(a[f, c]) for f, c in kinds]
    groups = rows.groupBy(*keys).agg(*parts, *(F.count(v[c]).alias(n[c]) for c in columns))
    less_row = {kind for frame in frames if frame.split() and frame.exclude == "current row" for kind in frame.aggregates.values()}
    seconds = [kind for kind in kinds if kind in less_row and kind[0] in ("min", "max")]
    for function, column in seconds:
        # What is the extreme without one of its rows; Spark keeps two values of a group in each task before the shuffle.
        order_of = F.col(v[column]).asc() if function == "min" else F.col(v[column]).desc()
        ranked = rows.where(F.col(v[column]).isNotNull()).select(*keys, v[column]).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order_of)))
        second = ranked.where("_r = 2").select(*keys, F.col(v[column]).alias(b[function, column]))
        groups = _beside(groups, second, keys, "left")
    part = Window.partitionBy(*keys[: len(by)]).orderBy(*keys[len(by) :])
    runs: dict[tuple, str] = {}  # the columns of a kind over runs of groups; frames have them in common

    def run(kind: tuple[str, str], low: int | None, high: int | None) -> str:
        return runs.setdefault((kind, low, high), f"_w{len(runs)}")

    sides = {}  # of (kind, start, end, split): the frame's column, or those of its sides, null where there is none
    for frame in frames:
        for kind in frame.aggregates.values():
            if frame.split():
                before = run(kind, frame.start, -1) if frame.start is None or frame.start < 0 else None
                after = run(kind, 1, frame.end) if frame.end is None or frame.end > 0 else None
                sides[kind, frame.start, frame.end, True] = (before, after)
            else:
                sides[kind, frame.start, frame.end, False] = (run(kind, frame.start, frame.end),)
    edges = lambda low, high: (Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
    typed = {kind: groups.schema[a[kind]].dataType for kind in kinds}
    groups = groups.select("*", *(MERGES[kind[0]](a[kind]).over(part.rowsBetween(*edges(low, high))).alias(name) for (kind, low, high), name in runs.items()))
    merged, names = [], {}
    for (kind, *frame), some in sides.items():
        names[kind, *frame] = f"_f{len(names)}"
        columns_of = [F.col(x) if x else F.lit(None).cast(typed[kind]) for x in some]
        merged.append((columns_of[0] if len(some) == 1 else _merged(kind[0], *columns_of)).alias(names[kind, *frame]))
    kept = [a[k] for k in kinds if k in less_row] + [n[c] for c in columns if ("sum", c) in less_row] + [b[k] for k in seconds]
    found = _beside(rows, groups.select(*keys, *kept, *merged), keys, "inner")
    out = []
    for frame in frames:
        for name, kind in frame.aggregates.items():
            function, column = kind
            value, result = F.col(v[column]), F.col(names[kind, frame.start, frame.end, frame.split()])
            if frame.split() and frame.exclude == "ties":
                result = _merged(function, result, value if function != "count" else F.when(value.isNotNull(), 1).otherwise(0))
            elif frame.split() and frame.exclude == "current row":
                result = _merged(function, result, _without_row(function, value, F.col(a[kind]), n[column], b[kind]))
            out.append((F.coalesce(result, F.lit(0)).cast("long") if function == "count" else result).alias(name))
    return found.select(*(F.col(o).alias(c) for o, c in zip(own, df.columns, strict=True)), *out)


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    """`rows` with the columns of their group; nulls in keys are equal."""
    renamed = groups.withColumnsRenamed({k: f"{k}_g" for k in keys})
    met = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"{k}_g"))
        met = same if met is None else met & same
    return rows.join(renamed, met, how).drop(*(f"{k}_g" for k in keys))


def _merged(function: str, a: Column, b: Column) -> Column:
    """Both parts of a frame, either of which may be empty (null)."""
    if function in ("sum", "count"):
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.least(a, b) if function == "min" else F.greatest(a, b)


def _without_row(function: str, v: Column, a: Column, n: str, b: str) -> Column:
    """A row's group without the row itself: `a` is the group's aggregate, `n` counts its values, `b` is its second extreme."""
    if function == "count":
        return a - F.when(v.isNotNull(), 1).otherwise(0)
    if function == "sum":
        return F.when(v.isNull(), a).when(F.col(n) > 1, a - v)
    return F.when(v.isNull() | (v != a), a).otherwise(F.col(b))
