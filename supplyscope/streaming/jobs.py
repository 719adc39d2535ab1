"""Structured Streaming jobs and their batch twins.

The functions that take a DataFrame work on streams and tables alike. `MirrorFold` keeps
its state in tables of its micro-batches, so that each batch is folded by a plain
aggregation in which a hot mirror is split like any other hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyscope.functions.moments import at
from supplyscope.operators.telemetry import mirror_current_state
from supplyscope.plans.ordered import MAX_GROUP_ROWS, carry_forward, previous_value, rank_in_group
from supplyscope.plans.shared import settle
from supplyscope.plans.skew import join_groups

#: most subscribers in one cell, a multiple of 8 so that lists follow each other by whole bytes
LISTED = 256
#: most events in one cell
BLOCK = 32


def open_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone; local ones are read in the session zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def route_events(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Event × subscriber for each active subscription (id, types, sources, components, active).

    An empty list accepts everything; an event without component only fits subscriptions
    that do not ask for one. Both sides spell out what they offer or ask for, as pairs
    (any value will do, value), so that the match is an equality join on three pairs.
    An event has a row for every subscriber that it fits, so a small file of events is a lot of work:
    events are dealt over all tasks before, whatever files and row groups they lie in.
    Subscribers that ask for the same are lists of at most `LISTED`, spelled out after the match: rows are joined and shuffled by
    lists only. Events of a table (a stream has no ranks) that offer the same meet a list in blocks of `BLOCK`: the list follows itself, which takes
    little room in files.
    """
    kinds = ("type", "source", "component")
    anything = F.struct(F.lit(True).alias("any"), F.lit("").alias("value"))

    def exactly(value: Column) -> Column:
        return F.struct(F.lit(False).alias("any"), value.alias("value"))

    def asked(column: str) -> Column:
        listed = F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>")))
        return F.explode(F.when(F.size(listed) > 0, F.transform(F.array_compact(listed), exactly)).otherwise(F.array(anything)))

    asks = subscriptions.where("active").select(F.col("id").alias("subscriber"), "types", "sources", "components")
    for kind in kinds:
        asks = asks.withColumn(f"__{kind}", asked(f"{kind}s")).drop(f"{kind}s")
    keys = [f"__{k}" for k in kinds]
    ranked = rank_in_group(settle(asks), keys, ["subscriber"], "__rank")
    part = F.floor((F.col("__rank") - 1) / LISTED).alias("__part")
    lists = settle(ranked.groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct("subscriber"))).alias("__list")).drop("__part"))

    def offers(kind: str) -> Column:
        own = F.coalesce(F.col(kind).cast("string"), F.lit(""))
        given = F.when(own != "", F.array(exactly(own), anything)).otherwise(F.array(anything))
        return F.explode(given)

    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if events.isStreaming:
        blocks = events.repartition(tasks).withColumn("__events", F.array(F.struct(*events.columns)))
    else:
        numbered = rank_in_group(events, kinds, [F.xxhash64(*events.columns)], "__rank")
        block = F.floor((F.col("__rank") - 1) / BLOCK).alias("__block")
        blocks = numbered.groupBy(*kinds, block).agg(F.collect_list(F.struct(*events.columns)).alias("__events")).repartition(tasks)
    for kind in kinds:
        blocks = blocks.withColumn(f"__{kind}", offers(kind))
    routed = blocks.select("__events", *keys).join(lists, keys).select(F.explode("__events").alias("__event"), "__list")
    return routed.select("__event.*", F.explode("__list").alias("__one")).select(*events.columns, F.col("__one.subscriber").alias("subscriber"))


def threshold_alerts(samples: DataFrame, limit: float, value: str = "alloc_bytes") -> DataFrame:
    """Samples above the limit; a limit of 0 switches alerts off."""
    return samples.where(F.col(value) > limit) if limit > 0 else samples.where(F.lit(False))


def windowed_operation_metrics(events: DataFrame, period: str = "30 seconds", watermark: str | None = None) -> DataFrame:
    """Operation metrics per tumbling event-time window; late rows are dropped on a stream."""
    source = events.withWatermark("ts", watermark) if watermark else events
    grouped = source.groupBy(F.window("ts", period).alias("w"), "op").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("duration").alias("total_time"),
        F.avg("duration").alias("avg_time"),
        F.max("duration").alias("max_time"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def idle_keys(events: DataFrame, ttl: str = "5 minutes", key: str = "source", watermark: str | None = None) -> DataFrame:
    """Periods of activity that ended because the key was silent for longer than `ttl`.

    On a stream (append mode) a row comes out, and its state is dropped, once the
    watermark has passed `last_seen` by `ttl`.
    """
    source = events.withWatermark("ts", watermark) if watermark else events
    grouped = source.groupBy(key, F.session_window("ts", ttl).alias("w")).agg(
        F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_events")
    )
    return grouped.select(key, F.col("w.start").alias("first_seen"), "last_seen", "n_events")


def idle_sessions(
    events: DataFrame, ttl: timedelta, key: str = "source", order: Sequence[str] = ("ts", "event_id"), max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """`idle_keys` of a table, with a key of any size.

    `session_window` sorts all events of a key in one task. Here an event opens a session if the one before it is more than `ttl`
    back; the start of its session is carried along, and sessions are counted by key and start with partial sums.
    `ordered` cuts large keys into slices of time, so a session may lie in many of them.
    """
    ts = order[0]
    timed = events.where(F.col(ts).isNotNull())
    gaps = previous_value(timed.select(key, *order), [key], list(order), F.col(ts), "__before", max_rows)
    opens = F.when(F.col("__before").isNull() | (F.col(ts) - F.col("__before") > F.lit(ttl)), F.col(ts))
    marked = carry_forward(gaps, [key], list(order), {"first_seen": opens}, max_rows)
    grouped = marked.groupBy(key, "first_seen").agg(F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n_events"))
    return grouped.select(key, "first_seen", "last_seen", "n_events")


def idle_at(events: DataFrame, as_of: datetime, ttl: timedelta, key: str = "source") -> DataFrame:
    """Keys whose latest event is more than `ttl` before `as_of`."""
    seen = events.groupBy(key).agg(F.max("ts").alias("last_seen"))
    return seen.where(F.col("last_seen") < at(events, "ts", as_of - ttl))


@dataclass
class MirrorFold:
    """State of each mirror over a stream of checks that may come late, for `writeStream.foreachBatch`.

    Checks are held open until the latest check seen is more than `delay` ahead of them, and are then folded, in order, into the settled
    state of their mirror. A check whose time is already settled when it comes, or that has no time, goes to the table of `late` checks.
    The state shown by `latest` is the settled one with the open checks on top.

    A batch writes the states of the mirrors it settled and the checks still open, no others. Every `compact_every` batches the
    written states are put together into a base. Folders are used in turn, so what is older than two bases is overwritten and nothing grows with
    the number of batches. Batch n only reads what batches before n wrote: one that is run again, after a failure,
    replaces its own tables and gives the same state.
    """

    folder: str
    delay: timedelta = timedelta(0)
    compact_every: int = 8

    def _slot(self, batch_id: int) -> str:
        return f"{self.folder}/batch-{batch_id % (2 * self.compact_every):04d}"

    def _base(self, batch_id: int) -> str:
        return f"{self.folder}/base-{batch_id // self.compact_every % 2}"

    def __call__(self, checks: DataFrame, batch_id: int) -> None:
        spark, slot = checks.sparkSession, self._slot(batch_id)
        bound = None  # all checks before it are settled
        if batch_id > 0:
            before = self._slot(batch_id - 1)
            bound = spark.read.parquet(f"{before}/mark").first()["bound"]

        def earlier(moment: datetime | None) -> Column:
            return F.col("ts") < at(checks, "ts", moment) if moment is not None else F.lit(False)

        known = checks.withColumn("__late", F.col("ts").isNull() | earlier(bound))
        if batch_id > 0:
            known = known.unionByName(spark.read.parquet(f"{before}/open").withColumn("__late", F.lit(False)))
        known.write.mode("overwrite").parquet(f"{slot}/seen")
        seen = spark.read.schema(known.schema).parquet(f"{slot}/seen")
        late = seen.where("__late").drop("__late")
        if batch_id == 0 or not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")

        on_time = seen.where("not __late").drop("__late")
        newest = on_time.agg(F.max("ts").alias("t")).first()["t"]
        if newest is not None and (bound is None or newest - self.delay > bound):
            bound = newest - self.delay
        mark = T.StructType([T.StructField("bound", checks.schema["ts"].dataType)])
        spark.createDataFrame([(bound,)], mark).write.mode("overwrite").parquet(f"{slot}/mark")
        ripe = earlier(bound)
        on_time.where(~ripe).write.mode("overwrite").parquet(f"{slot}/open")
        changed = mirror_current_state(on_time.where(ripe))
        if batch_id > 0:
            older = join_groups(self._settled(spark, batch_id - 1), changed.select("mirror"), ["mirror"], "left_semi")
            changed = merge_states(older, changed)
        changed.write.mode("overwrite").parquet(f"{slot}/state")
        if batch_id % self.compact_every == 0:
            self._settled(spark, batch_id).write.mode("overwrite").parquet(self._base(batch_id))

    def _settled(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Settled state after a batch: of each mirror the last one written since the base of the round before."""
        first = batch_id // self.compact_every * self.compact_every
        if batch_id == first:  # this batch's own base may be half written
            first = max(first - self.compact_every, 0)
        parts = [spark.read.parquet(f"{self._slot(b)}/state").withColumn("__batch", F.lit(b)) for b in range(first if first == 0 else first + 1, batch_id + 1)]
        if first > 0:
            parts.append(spark.read.parquet(self._base(first)).withColumn("__batch", F.lit(first)))
        rows = reduce(DataFrame.unionByName, parts)
        names = [c for c in rows.columns if c not in ("mirror", "__batch")]
        last = rows.groupBy("mirror").agg(F.max_by(F.struct(*names), "__batch").alias("s"))
        return last.select("mirror", "s.*")

    def latest(self, spark: SparkSession, last_batch: int) -> DataFrame:
        """State of every mirror after a batch, checks not yet settled included."""
        still_open = spark.read.parquet(f"{self._slot(last_batch)}/open")
        return merge_states(self._settled(spark, last_batch), mirror_current_state(still_open))

    def late(self, spark: SparkSession) -> DataFrame:
        """All checks that came after their time was settled, with the batch that brought them."""
        return spark.read.parquet(f"{self.folder}/late")


def merge_states(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Mirror states of two stretches of a log, one after the other, as one state; a null mirror is one too."""
    names = [c for c in older.columns if c != "mirror"]
    tagged = [t.select("mirror", F.lit(k).alias("side"), F.struct(*names).alias("s")) for k, t in enumerate((older, newer))]
    both = tagged[0].unionByName(tagged[1]).groupBy("mirror").agg(*[F.max(F.when(F.col("side") == k, F.col("s"))).alias(n) for k, n in enumerate("ab")])
    a, b = F.col("a"), F.col("b")

    def count(side: Column, name: str) -> Column:
        return F.coalesce(side[name], F.lit(0))

    broken_before = F.when(b["last_success"].isNull(), count(a, "consecutive_failures")).otherwise(0)
    merged = {
        "consecutive_failures": broken_before + count(b, "consecutive_failures"),
        "total_failures": count(a, "total_failures") + count(b, "total_failures"),
    }
    now = F.coalesce(b, a)
    return both.select(
        "mirror",
        *[
            merged[n].alias(n) if n in merged else (F.coalesce(b[n], a[n]) if n.startswith("last_") else now[n]).alias(n)
            for n in names
        ],
    )
