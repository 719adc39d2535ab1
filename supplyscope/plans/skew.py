"""Joins of a big table with a lookup that has few rows per key, where a key may be hot.

Adaptive execution splits skewed join partitions, but not when an aggregation on
the same key follows, since splitting would break the partitioning that the
aggregation reuses. `spread_join` salts the hot keys itself: their rows go to
several partitions by a hash of the row, their lookup rows are repeated once per
salt. Cold keys keep salt 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.plans.ordered import MAX_GROUP_ROWS
from supplyscope.plans.shared import settle


def keep_unseen(rows: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner in `seen`, which has one row per key.

    The same as a left anti join, but Spark does not move it below a distinct or an
    aggregation in `rows`: those stay first and combine equal rows before the shuffle.
    """
    marked = seen.select(*on).withColumn("__seen", F.lit(True))
    return rows.join(marked, list(on), "left").where(F.col("__seen").isNull()).drop("__seen")


def join_groups(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """`rows` with the columns of `lookup` for the same group, where null keys are a group like any other."""
    renamed = lookup.withColumnsRenamed({k: f"__g_{k}" for k in on})
    same = F.lit(True)
    for k in on:
        same = same & rows[k].eqNullSafe(renamed[f"__g_{k}"])
    return rows.join(renamed, same, how).drop(*[f"__g_{k}" for k in on])


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """A join of the groups `on` in which hot groups are spread; null keys are a group."""
    on = list(on)
    sizes = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    if sizes.isEmpty():
        return join_groups(facts, lookup, on, how)
    # one row per key above the limit, so at most (rows / hot_rows) rows in all
    hot = settle(sizes.select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__fan")))
    spread = F.when(
        F.col("__fan").isNotNull(), F.pmod(F.xxhash64(*facts.columns), F.col("__fan")).cast("int")
    ).otherwise(F.lit(0))
    salted = join_groups(facts, F.broadcast(hot), on).withColumn("__salt", spread).drop("__fan")
    repeats = F.sequence(F.lit(0), F.coalesce(F.col("__fan") - 1, F.lit(0)))
    fanned = join_groups(lookup, F.broadcast(hot), on).withColumn("__salt", F.explode(repeats)).drop("__fan")
    return join_groups(salted, fanned, [*on, "__salt"], how).drop("__salt")
