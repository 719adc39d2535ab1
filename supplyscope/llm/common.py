"""Shared by the operators of this subpackage: columns, Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyscope.plans.shared import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is (`lower` alone would also change É)."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def per_text(
    docs: DataFrame, id_col: str, text_col: str, out: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[bytes], tuple | list[tuple]]], many: bool = False,
) -> DataFrame:
    """One row (`many`: any number) for each text, from a function of its UTF-8 bytes; null is empty.

    `make` builds the function once for each task. Rows come out while texts go in, so a task
    holds one Arrow batch and what it makes of it, cut again after 20,000 rows.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in out)]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fn, arrow = make(), to_arrow_schema(schema)

        def flush(ids, rows):
            columns = list(zip(*rows)) if rows else [[] for _ in out]
            arrays = [pa.array(ids, type=arrow.field(0).type)]
            arrays += [pa.array(c, type=arrow.field(k + 1).type) for k, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            ids, rows = [], []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = fn(text.as_py() or b"")
                if many:
                    ids += [one] * len(found)
                    rows += found
                else:
                    ids.append(one)
                    rows.append(found)
                if len(ids) >= 20_000:
                    yield flush(ids, rows)
                    ids, rows = [], []
            yield flush(ids, rows)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the undirected edges (a, b), the smallest node that it reaches.

    Large-star and small-star rounds in turn until the edges stay the same; each round is written
    to the shared folder. All is done with minimum by node and equality joins, so no component
    and no list of neighbours ever meets in one task.
    """

    def smallest(half: DataFrame) -> DataFrame:
        return half.groupBy("u").agg(F.min("v").alias("m"))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))

    def mark(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    pairs = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(pairs)
    while True:
        around = both(pairs)
        least = smallest(around).withColumn("m", F.least("u", "m"))
        large = around.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        pairs = settle(large)
        low = smallest(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
        kept = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u")
        small = kept.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        pairs = settle(small)
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
