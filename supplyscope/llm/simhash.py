"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two fingerprints that differ in at most three bits differ in at most three of their eight
bytes, so they share at least five positional bytes. A posting list for each single byte
would hold 1/256 of all fingerprints; so a list is kept for four byte positions at once. The
14 planes of the affine space over {0, 1}^3 are 14 sets of four positions such that any
three positions miss at least one of them: every link meets in some list. Pairs that meet
are tallied by their shared positional bytes, kept from five on, and verified bit by bit.

A posting list of more than `BLOCK` fingerprints is dealt into blocks; every pair of blocks
is one row of work. A row gives the edges of a spanning forest of its links, never all pairs,
which keeps every component whole. Equal fingerprints are one entry of the index.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyscope.llm.common import components, per_text
from supplyscope.plans.shared import settle

SEED, WORDS, BITS, BLOCK = 42, 3, 3, 1024


def planes() -> list[list[int]]:
    points = list(product((0, 1), repeat=3))
    normals = [p for p in points if any(p)]
    return [
        [k for k, x in enumerate(points) if sum(a * b for a, b in zip(n, x)) % 2 == side] for n in normals for side in (0, 1)
    ]


def _fingerprinter():
    import xxhash

    digest, step = xxhash.xxh64_intdigest, 1 << 15

    def of(text: bytes) -> tuple[int]:
        words = text.lower().split()  # both ASCII only for bytes
        if not words:
            return (0,)
        joined = b" ".join(words)
        if len(words) < WORDS:
            h = digest(joined, SEED)
            return (h - (1 << 64) if h >> 63 else h,)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size) + np.arange(len(words))
        first, last = (end - size)[: 1 - WORDS].tolist(), end[WORDS - 1 :].tolist()
        total = np.zeros(64, np.int64)
        for k in range(0, len(first), step):
            some = zip(first[k : k + step], last[k : k + step])
            h = np.array([digest(joined[a:b], SEED) for a, b in some], "<u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        return (int(np.packbits(2 * total > len(first), bitorder="little").view("<i8")[0]),)

    return of


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): 64-bit SimHash over word shingles of the whole text. No word or null: 0."""
    return per_text(docs, id_col, text_col, [("fp", T.LongType())], _fingerprinter)


def _forest(batches):
    """Edges of a spanning forest of the links in each list of fingerprints."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        left, right = [], []
        for fps in batch.column(0):
            rest = np.array(fps.values, dtype=np.int64).view(np.uint64)
            while len(rest) > 1:
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    one = queue.pop()
                    apart = rest ^ one
                    shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                    near = (shared >= 8 - BITS) & (np.bitwise_count(apart) <= BITS)
                    if near.any():
                        found = rest[near]
                        left += [one.view(np.int64)] * len(found)
                        right += found.view(np.int64).tolist()
                        queue += list(found)
                        rest = rest[~near]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints `fp` into their components."""
    masks = [sum(255 << (8 * k) for k in keep) for keep in planes()]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).cast("byte").alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for k, m in enumerate(signed)])
    postings = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    sizes = postings.groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = postings.join(sizes, ["list", "bytes"]).withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    paired = dealt.select("list", "bytes", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = paired.groupBy("list", "bytes", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"))
    return rows.where(F.size("fps") > 1).select("fps").mapInArrow(_forest, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, fp, component): the smallest id that is reached over links of at most three bits.

    A row for each row of `docs`; repeated rows share their component. Rows without id get a
    component too (null if no row of it has an id). An empty table gives an empty table.
    """
    fps = settle(fingerprints(docs, id_col, text_col))
    distinct = settle(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    linked = components(links(distinct, block))
    reps = linked.join(distinct.withColumnRenamed("fp", "node"), "node")
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    joined = linked.join(least, "root").select(F.col("node").alias("fp"), "component")
    by_fp = distinct.join(joined, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(by_fp, "fp").select(id_col, "fp", "component")


def op2_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_duplicates(docs).select("doc_id", text, F.col("component").alias("component_id"))
