"""Ordered work inside groups whose size is not known.

A plain window puts a whole group into one task. That is fine for millions of
rows, not for a group that holds a third of the input. Each function here asks
for the size of the largest group first. Up to `max_rows` it uses a plain window.
Beyond that it cuts the groups along their order into slices by range
partitioning, works inside each slice, and carries a one-row summary per slice
to the slices after it. Both ways give the same rows; for sums, as long as the values are integers or
decimals (doubles are rounded differently in another order, so callers cast them).

For `carry_forward` and `previous_value` the order must be ascending, and for
all functions it should end with a unique column so that ties can be cut too.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.plans.shared import settle

MAX_GROUP_ROWS = 5_000_000
_SLICE = "__slice"


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def group_sizes(df: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all), from one map-side combined count."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _sliced(df: DataFrame, group: Sequence[str], order: list[Column], total: int, max_rows: int) -> DataFrame:
    parts = max(2, ceil(2 * total / max_rows))
    ranged = df.repartitionByRange(parts, *[F.col(g) for g in group], *order)
    return settle(ranged.withColumn(_SLICE, F.spark_partition_id()))


def _join_slices(rows: DataFrame, summary: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = [*group, _SLICE]
    renamed = summary.select(*[F.col(k).alias(f"__s_{k}") for k in keys], *[c for c in summary.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(renamed[f"__s_{k}"])
    return rows.join(renamed, same, "left").drop(*[f"__s_{k}" for k in keys])


def _before(group: Sequence[str]) -> Window:
    return Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """1, 2, 3 … along `order` in each group."""
    cols = _columns(order)
    largest, total = group_sizes(df, group)
    if largest <= max_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*cols)).cast("long"))
    cut = _sliced(df, group, cols, total, max_rows)
    here = Window.partitionBy(*group, _SLICE).orderBy(*cols)
    counts = cut.groupBy(*group, _SLICE).agg(F.count(F.lit(1)).alias("__n"))
    start = counts.withColumn("__start", F.coalesce(F.sum("__n").over(_before(group)), F.lit(0))).drop("__n")
    ranked = cut.withColumn(out, F.row_number().over(here).cast("long"))
    return _join_slices(ranked, start, group).withColumn(out, F.col(out) + F.col("__start")).drop("__start", _SLICE)


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    out: str,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Sum of `value` from the start of the group up to and including the row."""
    cols = _columns(order)
    largest, total = group_sizes(df, group)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    if largest <= max_rows:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*group).orderBy(*cols).rowsBetween(*up_to)))
    cut = _sliced(df.withColumn("__v", value), group, cols, total, max_rows)
    here = Window.partitionBy(*group, _SLICE).orderBy(*cols).rowsBetween(*up_to)
    sums = cut.groupBy(*group, _SLICE).agg(F.sum("__v").alias("__n"))
    start = sums.withColumn("__start", F.sum("__n").over(_before(group))).drop("__n")
    summed = cut.withColumn(out, F.sum("__v").over(here))
    joined = _join_slices(summed, start, group)
    zero = F.lit(0)
    total_so_far = F.when(
        F.col(out).isNotNull() | F.col("__start").isNotNull(),
        F.coalesce(F.col(out), zero) + F.coalesce(F.col("__start"), zero),
    )
    return joined.withColumn(out, total_so_far).drop("__start", "__v", _SLICE)


def greatest_before(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    out: str,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Greatest `value` of the rows before the row in its group, null on the first."""
    cols = _columns(order)
    largest, total = group_sizes(df, group)
    before = (Window.unboundedPreceding, -1)
    if largest <= max_rows:
        return df.withColumn(out, F.max(value).over(Window.partitionBy(*group).orderBy(*cols).rowsBetween(*before)))
    cut = _sliced(df.withColumn("__v", value), group, cols, total, max_rows)
    tops = cut.groupBy(*group, _SLICE).agg(F.max("__v").alias("__n"))
    start = tops.withColumn("__start", F.max("__n").over(_before(group))).drop("__n")
    here = Window.partitionBy(*group, _SLICE).orderBy(*cols).rowsBetween(*before)
    joined = _join_slices(cut.withColumn(out, F.max("__v").over(here)), start, group)
    return joined.withColumn(out, F.greatest(out, "__start")).drop("__start", "__v", _SLICE)


def carry_forward(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """For each name in `values`: its last non-null value at or before the row."""
    largest, total = group_sizes(df, group)
    cols = _columns(order)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    if largest <= max_rows:
        win = Window.partitionBy(*group).orderBy(*cols).rowsBetween(*up_to)
        return df.withColumns({name: F.last(v, ignorenulls=True).over(win) for name, v in values.items()})
    seen = {f"__v_{name}": v for name, v in values.items()}
    cut = _sliced(df.withColumns(seen), group, cols, total, max_rows)
    at = F.struct(*cols)
    tails = cut.groupBy(*group, _SLICE).agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(f"{v}_t") for v in seen]
    )
    win = _before(group)
    start = tails.select(
        *group, _SLICE, *[F.last(f"{v}_t", ignorenulls=True).over(win).alias(f"{v}_p") for v in seen]
    )
    here = Window.partitionBy(*group, _SLICE).orderBy(*cols).rowsBetween(*up_to)
    local = cut.withColumns({f"{v}_l": F.last(v, ignorenulls=True).over(here) for v in seen})
    joined = _join_slices(local, start, group)
    filled = joined.withColumns(
        {name: F.coalesce(F.col(f"__v_{name}_l"), F.col(f"__v_{name}_p")) for name in values}
    )
    spare = [f"{v}{end}" for v in seen for end in ("", "_l", "_p")]
    return filled.drop(*spare, _SLICE)


def previous_value(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """`value` of the row just before, null on the first row of a group."""
    largest, total = group_sizes(df, group)
    cols = _columns(order)
    if largest <= max_rows:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*group).orderBy(*cols)))
    cut = _sliced(df.withColumn("__v", F.struct(value.alias("v"))), group, cols, total, max_rows)
    tails = cut.groupBy(*group, _SLICE).agg(F.max_by("__v", F.struct(*cols)).alias("__t"))
    start = tails.withColumn("__p", F.last("__t").over(_before(group))).drop("__t")
    here = Window.partitionBy(*group, _SLICE).orderBy(*cols)
    joined = _join_slices(cut.withColumn("__l", F.lag("__v").over(here)), start, group)
    return joined.withColumn(out, F.coalesce("__l", "__p")["v"]).drop("__l", "__p", "__v", _SLICE)


# partial top-n ships up to n rows per group and map task; from here on they are cut once more
SPREAD_FROM, SPREAD = 32, 64


def first_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each group.

    Spark cuts every map partition to `n` rows per group before the shuffle
    (WindowGroupLimit, for `n` below `spark.sql.optimizer.windowGroupLimitThreshold`),
    so a hot group never reaches one task whole. For a bigger `n` what the tasks ship is
    cut once more in `SPREAD` parts. Beyond the threshold a full rank is taken.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    cols = _columns(order)
    if n > limit:
        return rank_in_group(df, group, cols, "__rank").where(F.col("__rank") <= n).drop("__rank")

    def cut(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*cols))
        return rows.withColumn("__rank", place).where(F.col("__rank") <= n).drop("__rank")

    if n >= SPREAD_FROM:
        # one part per map task: a part per row would let every task ship n rows for each part
        part = F.pmod(F.spark_partition_id(), F.lit(SPREAD))
        df = cut(df.withColumn("__part", part), [*group, "__part"]).drop("__part")
    return cut(df, group)
