"""Summaries of installs, operations, memory, mirrors, caches, backups and runs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.moments import at, seconds_between
from supplyscope.plans.ordered import (
    MAX_GROUP_ROWS,
    first_in_group,
    previous_value,
    rank_in_group,
    running_sum,
)
from supplyscope.plans.skew import join_groups, spread_join


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def install_summary(metrics: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts, success rates, mean time per method and the date range, in one pass."""
    binary, source = F.col("method") == "binary", F.col("method") == "source"
    won = F.col("success")
    n_bin, n_src, n_all = F.count_if(binary), F.count_if(source), F.count(F.lit(1))
    ok_bin, ok_src = F.count_if(binary & won), F.count_if(source & won)
    return metrics.groupBy(*group).agg(
        n_all.alias("installs"),
        n_bin.alias("binary_installs"),
        n_src.alias("source_installs"),
        _share(ok_bin, n_bin).alias("binary_success_rate"),
        _share(ok_src, n_src).alias("source_success_rate"),
        _share(ok_bin + ok_src, n_all).alias("overall_success_rate"),
        F.avg(F.when(binary, F.col("duration"))).alias("mean_binary_time"),
        F.avg(F.when(source, F.col("duration"))).alias("mean_source_time"),
        F.min("ts").alias("from_ts"),
        F.max("ts").alias("to_ts"),
    )


def method_comparison(metrics: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Binary against source installs; only the sample sizes when either side is empty."""
    binary, source = F.col("method") == "binary", F.col("method") == "source"
    won = F.col("success")
    sums = metrics.groupBy(*group).agg(
        F.count_if(binary).alias("n_binary"),
        F.count_if(source).alias("n_source"),
        F.count_if(binary & won).alias("ok_binary"),
        F.count_if(source & won).alias("ok_source"),
        F.avg(F.when(binary & won, F.col("duration"))).alias("t_binary"),
        F.avg(F.when(source & won, F.col("duration"))).alias("t_source"),
        F.avg(F.when(binary, F.col("download_size"))).alias("size"),
        F.avg(F.when(binary, F.col("download_time"))).alias("time"),
        F.count_if(binary & F.col("cache_hit")).alias("hits"),
    )
    both = (F.col("n_binary") > 0) & (F.col("n_source") > 0)
    timed = (F.col("t_binary") > 0) & (F.col("t_source") > 0)

    def shown(value: Column, name: str) -> Column:
        return F.when(both, value).alias(name)

    return sums.select(
        *group,
        "n_binary",
        "n_source",
        shown(F.col("ok_binary") / F.col("n_binary"), "binary_success_rate"),
        shown(F.col("ok_source") / F.col("n_source"), "source_success_rate"),
        shown(F.when(timed, F.col("t_source") / F.col("t_binary")), "speedup"),
        shown(F.col("size"), "mean_download_size"),
        shown(F.col("time"), "mean_download_time"),
        shown(F.col("hits") / F.col("n_binary"), "cache_hit_rate"),
    )


# fixed values: substring rules in order, first hit wins; the last entry is the default
ERROR_RULES = {
    "install": (
        ("network_error", ("network", "connection")),
        ("verification_error", ("checksum", "verify")),
        ("permission_error", ("permission", "access")),
        ("storage_error", ("disk", "space")),
        ("timeout_error", ("timeout",)),
        ("not_found_error", ("not found", "404")),
        ("general_error", ()),
    ),
    "update": (
        ("permission_denied", ("permission denied", "access denied")),
        ("filesystem_full", ("no space", "disk full", "file too large")),
        ("checksum_mismatch", ("checksum", "hash", "integrity")),
        ("network_failure", ("network", "connection", "timeout", "dns")),
        ("incompatible_binary", ("exec format", "cannot execute", "incompatible")),
        ("partial_update", ("interrupted", "partial", "incomplete")),
        ("unknown_failure", ()),
    ),
}


def error_category(message: Column, ruleset: str = "install") -> Column:
    """Category of an error text; the install rules ignore case, the update rules do not."""
    text = F.lower(message) if ruleset == "install" else message
    *rules, (default, _) = ERROR_RULES[ruleset]
    category = F
    for name, words in rules:
        category = category.when(reduce(Column.__or__, [text.contains(w) for w in words]), name)
    return category.otherwise(default)


def categorize_errors(errors: DataFrame, message: str = "message", ruleset: str = "install") -> DataFrame:
    return (
        errors.withColumn("category", error_category(F.col(message), ruleset))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def operation_metrics(events: DataFrame, memory: str | None = None) -> DataFrame:
    """Per operation: count, total, least, most, mean and last duration, and memory change."""
    last = F.max_by("duration", F.struct("ts", "event_id"))
    extra = [F.sum(memory).alias("memory_delta")] if memory else []
    return events.groupBy("op").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("duration").alias("total_time"),
        F.min("duration").alias("min_time"),
        F.max("duration").alias("max_time"),
        F.avg("duration").alias("avg_time"),
        last.alias("last_time"),
        *extra,
    )


def slowest_operations(metrics: DataFrame, n: int) -> DataFrame:
    return metrics.orderBy(F.col("avg_time").desc(), F.col("op")).limit(n)


# fixed values: default thresholds and impact levels, lowest first
THRESHOLDS = {"max_time": 0.5, "max_memory": 100 * 1024 * 1024, "min_hit_rate": 0.8, "max_items": 1000}
HEAP_OBJECTS, MIN_LOOKUPS = 100000, 10
IMPACTS = ("low", "medium", "high", "critical")


def optimization_suggestions(
    metrics: DataFrame | None = None,
    memory: DataFrame | None = None,
    caches: DataFrame | None = None,
    thresholds: dict | None = None,
) -> DataFrame:
    """One row per broken rule, with its impact level (0 low … 3 critical)."""
    limit = {**THRESHOLDS, **(thresholds or {})}

    def rule(broken: Column, category: str, metric: str, impact: Column | int, current: Column) -> Column:
        level = F.lit(impact) if isinstance(impact, int) else impact
        return F.when(
            broken,
            F.struct(
                F.lit(category).alias("category"),
                F.lit(metric).alias("metric"),
                level.cast("int").alias("impact_level"),
                current.cast("double").alias("current"),
            ),
        )

    def found(df: DataFrame, subject: str, rules: list[Column]) -> DataFrame:
        hits = F.explode(F.array_compact(F.array(*rules)))
        return df.select(F.col(subject).cast("string").alias("subject"), hits.alias("s")).select("subject", "s.*")

    parts = []
    if metrics is not None:
        ratio = F.col("avg_time") / limit["max_time"]
        impact = F.when(ratio > 5, 3).when(ratio > 3, 2).when(ratio > 2, 1).otherwise(0)
        slow = rule(F.col("avg_time") > limit["max_time"], "performance", "average_time", impact, F.col("avg_time"))
        uneven = rule(F.col("max_time") > 3 * F.col("avg_time"), "performance", "time_variance", 1, F.col("max_time"))
        parts.append(found(metrics, "op", [slow, uneven]))
    if memory is not None:
        big = rule(F.col("alloc_bytes") > limit["max_memory"], "memory", "allocation", 2, F.col("alloc_bytes"))
        many = rule(F.col("heap_objects") > HEAP_OBJECTS, "memory", "heap_objects", 1, F.col("heap_objects"))
        parts.append(found(memory, "source", [big, many]))
    if caches is not None:
        lookups = F.col("hits") + F.col("misses")
        rate = _share(F.col("hits"), lookups)
        cold = (rate < limit["min_hit_rate"]) & (lookups > MIN_LOOKUPS)
        low = rule(cold, "caching", "hit_rate", 2, rate)
        full = rule(F.col("items") > limit["max_items"], "caching", "cache_size", 1, F.col("items"))
        parts.append(found(caches, "cache", [low, full]))
    rows = reduce(DataFrame.unionByName, parts)
    names = F.element_at(F.array(*[F.lit(i) for i in IMPACTS]), F.col("impact_level") + 1)
    return rows.withColumn("impact", names).orderBy(F.col("impact_level").desc(), "category", "metric", "subject")


def detect_regressions(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Benchmarks whose time, bytes or allocations per run grew by more than `threshold`."""
    measures = ["ns_per_op", "bytes_per_op", "allocs_per_op"]

    def long(df: DataFrame, value: str) -> DataFrame:
        numbers = [F.col(m).cast("double").alias(m) for m in measures]
        return df.select("name", *numbers).unpivot("name", measures, "metric", value)

    pairs = long(baseline, "old_value").join(long(current, "new_value"), ["name", "metric"])
    usable = (F.col("old_value") != 0) & (
        (F.col("metric") == "ns_per_op") | ((F.col("old_value") > 0) & (F.col("new_value") > 0))
    )
    change = F.col("change")
    severity = F.when(change > 0.5, "critical").when(change > 0.25, "major").otherwise("minor")
    return (
        pairs.where(usable)
        .withColumn("change", (F.col("new_value") - F.col("old_value")) / F.col("old_value"))
        .where(change > threshold)
        .withColumn("severity", severity)
    )


def usage_trend(
    samples: DataFrame, value: str = "alloc_bytes", order: Sequence[str] = ("ts",), max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per source: span, change, rate, direction and the mean of the rising steps."""
    spot = F.struct(*order)
    stepped = previous_value(samples, ["source"], list(order), F.col(value), "__before", max_rows)
    rise = F.col(value) - F.col("__before")
    ends = stepped.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("ts", F.col(value).alias("v")), spot).alias("first"),
        F.max_by(F.struct("ts", F.col(value).alias("v")), spot).alias("last"),
        F.avg(F.when(rise > 0, rise)).alias("rising"),
    )
    span = seconds_between(F.col("first.ts"), F.col("last.ts"))
    delta = F.col("last.v") - F.col("first.v")
    enough = F.col("n") >= 2
    direction = F.when(delta > 0, "increasing").when(delta < 0, "decreasing").otherwise("stable")
    return ends.select(
        "source",
        "n",
        F.when(enough, span).alias("duration_s"),
        F.when(enough, delta).alias("delta"),
        F.when(enough & (span > 0), delta / span).alias("rate_per_s"),
        F.when(enough, direction).otherwise("insufficient_data").alias("direction"),
        F.when(F.col("n") >= 5, F.coalesce("rising", F.lit(0.0))).otherwise(F.lit(0.0)).alias("avg_growth"),
    )


# fixed values: leak rules
MIN_SAMPLES, TAIL, MIN_RUN = 10, 5, 3
GROWTH_BYTES, MAX_GOROUTINES, MAX_PAUSE_NS = 1024 * 1024, 100, 100_000_000


def detect_leaks(samples: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Issue rows for sources with at least ten samples, judged on the latest five."""
    counts = samples.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SAMPLES)
    tail = first_in_group(samples, ["source"], [F.col(o).desc() for o in order], TAIL)
    # at most five rows per source are gathered
    recent = tail.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct(*order, "alloc_bytes", "goroutines", "pause_ns"))).alias("s")
    )
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(TAIL - 1)),
        F.struct(F.lit(0).alias("run"), F.lit(0).cast("double").alias("growth")),
        lambda acc, i: F.when(
            F.col("s")[i]["alloc_bytes"] > F.col("s")[i - 1]["alloc_bytes"],
            F.struct(
                (acc["run"] + 1).alias("run"),
                (acc["growth"] + F.col("s")[i]["alloc_bytes"] - F.col("s")[i - 1]["alloc_bytes"]).alias("growth"),
            ),
        ).otherwise(F.struct(F.lit(0).alias("run"), acc["growth"].alias("growth"))),
    )
    last = F.element_at("s", -1)

    def issue(test: Column, kind: str, severity: str, amount: Column) -> Column:
        return F.when(
            test, F.struct(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), amount.cast("double").alias("amount"))
        )

    pause = F.array_max(last["pause_ns"])
    issues = F.array_compact(
        F.array(
            issue((F.col("g.run") >= MIN_RUN) & (F.col("g.growth") > GROWTH_BYTES), "sustained_growth", "medium", F.col("g.growth")),
            issue(last["goroutines"] > MAX_GOROUTINES, "goroutine_leak", "high", last["goroutines"]),
            issue(pause > MAX_PAUSE_NS, "gc_pressure", "medium", pause),
        )
    )
    judged = recent.join(counts.select("source"), "source").withColumn("g", state)
    return judged.select("source", F.explode(issues).alias("i")).select("source", "i.*")


def health_status(issues: DataFrame, trend: DataFrame, stats: DataFrame) -> DataFrame:
    """critical / warning / healthy per source of `stats` (source, gc_fraction)."""
    counts = issues.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count_if(F.col("severity") == "high").alias("n_high")
    )
    joined = stats.join(counts, "source", "left").join(trend.select("source", "direction", "rate_per_s"), "source", "left")
    n_issues, n_high = F.coalesce("n_issues", F.lit(0)), F.coalesce("n_high", F.lit(0))
    rising = (F.col("direction") == "increasing") & (F.col("rate_per_s") > GROWTH_BYTES)
    status = (
        F.when(n_high > 0, "critical")
        .when((n_issues > 2) | F.coalesce(rising, F.lit(False)) | (F.col("gc_fraction") > 0.1), "warning")
        .otherwise("healthy")
    )
    return joined.select("source", status.alias("status"), n_issues.alias("n_issues"))


def check_rollup(checks: DataFrame, group: Sequence[str]) -> DataFrame:
    """Worst status of a list of checks with counts and a one-line summary."""
    n = {s: F.count_if(F.col("status") == s) for s in ("healthy", "warning", "critical")}
    worst = F.when(n["critical"] > 0, "critical").when(n["warning"] > 0, "warning").otherwise("healthy")
    text = F.format_string("%d checks passed, %d warnings, %d critical issues", *n.values())
    return checks.groupBy(*group).agg(
        worst.alias("status"),
        *[c.alias(f"n_{s}") for s, c in n.items()],
        text.alias("summary"),
        F.count_if(F.col("suggestion") != "").alias("n_next_steps"),
    )


def next_steps(checks: DataFrame) -> DataFrame:
    """The suggestions of a list of checks, one per row."""
    return checks.where(F.col("suggestion") != "")


def keep_last_n(samples: DataFrame, n: int, group: Sequence[str] = ("source",), order: Sequence[str] = ("ts",)) -> DataFrame:
    return first_in_group(samples, list(group), [F.col(o).desc() for o in order], n)


def mirror_current_state(checks: DataFrame, order: Sequence[str] = ("ts", "event_id"), hot_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Fold of a check log: latest status, failures since the last success, totals."""
    spot = F.struct(*order)
    healthy = F.col("healthy")
    last_ok = checks.where(healthy).groupBy("mirror").agg(F.max(spot).alias("__ok"))
    joined = spread_join(checks, last_ok, ["mirror"], "left", hot_rows)
    since = ~healthy & (F.col("__ok").isNull() | (spot > F.col("__ok")))
    latest = F.max_by(F.struct("healthy", "latency", "priority", "enabled"), spot)
    folded = joined.groupBy("mirror").agg(
        latest.alias("now"),
        F.count_if(since).alias("consecutive_failures"),
        F.count_if(~healthy).alias("total_failures"),
        F.max(F.when(healthy, F.col("ts"))).alias("last_success"),
        F.max(F.when(~healthy, F.col("ts"))).alias("last_failure"),
    )
    return folded.select("mirror", "now.*", *[c for c in folded.columns if c not in ("mirror", "now")])


def rank_mirrors(
    state: DataFrame, group: Sequence[str] = (), best_only: bool = False, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Failover chain of the enabled mirrors, or only the best healthy one per group."""
    usable = state.where(F.col("enabled"))
    if best_only:
        order = [F.col("priority"), F.col("latency"), F.col("mirror")]
        return first_in_group(usable.where(F.col("healthy")), list(group), order)
    order = [F.col("priority"), F.col("healthy").desc(), F.col("latency"), F.col("mirror")]
    return rank_in_group(usable, list(group), order, "chain_pos", max_rows)


def select_mirror(
    state: DataFrame,
    strategy: str,
    group: Sequence[str],
    tick: int = 0,
    seed: int = 0,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """One mirror per group among the available ones, or among all if none is available.

    Sorting available mirrors first gives the fallback without a second look at the group.
    """
    there = F.col("available").desc()
    orders = {
        "first": [there, F.col("mirror")],
        "fastest": [there, F.col("latency").asc_nulls_last(), F.col("mirror")],
        "random": [there, F.md5(F.concat_ws("-", F.lit(seed), F.col("mirror"))), F.col("mirror")],
    }
    if strategy in orders:
        return first_in_group(state, list(group), orders[strategy])
    if strategy != "round_robin":
        raise ValueError(f"unknown strategy {strategy!r}")
    up = F.count_if(F.col("available"))
    sizes = state.groupBy(*group).agg(F.when(up > 0, up).otherwise(F.count(F.lit(1))).alias("__n"))
    ranked = rank_in_group(state, list(group), [there, F.col("mirror")], "__pos", max_rows)
    turn = F.lit(tick) % F.col("__n") + 1
    return ranked.join(sizes, list(group)).where(F.col("__pos") == turn).drop("__pos", "__n")


def cache_stats(entries: DataFrame, as_of: datetime, group: Sequence[str] = ()) -> DataFrame:
    """Files, bytes, expired and valid entries, oldest, newest and mean age at `as_of`."""
    age = seconds_between(F.col("created_at"), at(entries, "created_at", as_of))
    return entries.groupBy(*group).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if(F.col("expired")).alias("n_expired"),
        F.count_if(~F.col("expired")).alias("n_valid"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.avg(age).alias("mean_age_s"),
    )


def hit_ratio(lookups: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """hits / (hits + misses) of each group, 0 without lookups."""
    hits, misses = F.sum("hits"), F.sum("misses")
    return lookups.groupBy(*group).agg(
        hits.alias("hits"), misses.alias("misses"), _share(hits, hits + misses).alias("hit_ratio")
    )


def expire_entries(
    entries: DataFrame, as_of: datetime, max_age: timedelta | None = None, expires: str | None = None, since: str = "created_at"
) -> DataFrame:
    """Adds `evicted`: older than `max_age`, or at or past its own expiry time."""
    gone = F.lit(False)
    if max_age is not None:
        gone = gone | (F.col(since) < at(entries, since, as_of - max_age))
    if expires is not None:
        gone = gone | F.coalesce(F.col(expires) <= at(entries, expires, as_of), F.lit(False))
    return entries.withColumn("evicted", gone)


def evict_by_size(entries: DataFrame, limit: float, pool: Sequence[str] = ("pool",), max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The least recently used entries that have to go until each pool fits `limit`.

    Sizes are added up as decimals with six places, so that the sum does not depend on how a pool is cut.
    """
    newest = [F.col("last_accessed").desc(), F.col("entry_key").desc()]
    summed = running_sum(entries, list(pool), newest, F.col("size").cast("decimal(28,6)"), "__kept", max_rows)
    return summed.where(F.col("__kept") > limit).drop("__kept")


def evict_all(entries: DataFrame, as_of: datetime, max_age: timedelta, limit: float, pool: Sequence[str] = ("pool",)) -> DataFrame:
    """First by age, then by size among the rest; adds the `reason`."""
    aged = expire_entries(entries, as_of, max_age, since="last_accessed")
    old = aged.where("evicted").drop("evicted").withColumn("reason", F.lit("age"))
    rest = aged.where("not evicted").drop("evicted")
    return old.unionByName(evict_by_size(rest, limit, pool).withColumn("reason", F.lit("size")))


def _past_newest(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Adds `__past`: whether the row comes after the newest `n` of its group.

    The n-th newest row of each group is found by partial top-n and compared with
    every row, so that no group is sorted whole.
    """
    spot = F.struct(*order)
    top = first_in_group(df.select(*group, *order), list(group), [F.col(o).desc() for o in order], n)
    edge = top.groupBy(*group).agg(F.min(spot).alias("__edge"))
    return join_groups(df, edge, group).withColumn("__past", F.coalesce(spot < F.col("__edge"), F.lit(False))).drop("__edge")


def evict_by_count(entries: DataFrame, n: int, pool: Sequence[str] = ("pool",)) -> DataFrame:
    """The entries beyond the `n` most recently used of each pool."""
    return _past_newest(entries, pool, ["last_accessed", "entry_key"], n).where("__past").drop("__past")


def apply_retention(
    backups: DataFrame, as_of: datetime, days: int, max_backups: int, group: Sequence[str] = ("project",), order: Sequence[str] = ("mod_time", "name")
) -> DataFrame:
    """Adds `keep` and `reason`; 0 days or 0 backups means no such limit."""
    stamp = order[0]
    old = F.col(stamp) < at(backups, stamp, as_of - timedelta(days=days)) if days > 0 else F.lit(False)
    marked = backups.withColumn("__old", old)
    fresh = marked.where(~F.col("__old"))
    if max_backups > 0:
        fresh = _past_newest(fresh, group, order, max_backups)
    else:
        fresh = fresh.withColumn("__past", F.lit(False))
    all_rows = fresh.unionByName(marked.where("__old").withColumn("__past", F.lit(False)))
    reason = F.when(F.col("__old"), "age").when(F.col("__past"), "count")
    return all_rows.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull()).drop("__old", "__past")


def backup_files(names: DataFrame, name: str = "name") -> DataFrame:
    """Backup files with the session, operation and time that their names carry."""
    rest = F.split(F.col(name), r"\.backup-")[1]
    epoch = F.regexp_extract(rest, r"^([+-]?\d+)-([^-]*)", 1).try_cast("long")
    op = F.regexp_extract(rest, r"^([+-]?\d+)-([^-]*)", 2)
    marked = names.where(F.col(name).contains(".backup-")).withColumn("__epoch", epoch)
    return (
        marked.where(F.col("__epoch").isNotNull())
        .withColumn("op", op)
        .withColumn("session", F.regexp_extract(rest, r"^([+-]?\d+-[^-]*)", 1))
        .withColumn("ts", F.timestamp_seconds("__epoch"))
        .drop("__epoch")
    )


def group_sessions(names: DataFrame, group: Sequence[str] = (), name: str = "name", latest_only: bool = False) -> DataFrame:
    """Backup sessions with their file count (`backup_files` lists the files)."""
    sessions = backup_files(names, name).groupBy(*group, "session", "op", "ts").agg(F.count(F.lit(1)).alias("n_files"))
    if latest_only:
        return first_in_group(sessions, list(group), [F.col("ts").desc(), F.col("session")])
    return sessions


def freshness(entries: DataFrame, as_of: datetime, ttl: timedelta, honour_max_age: bool = True) -> DataFrame:
    """Adds `expires`, `is_expired` and `needs_validation` from response headers."""
    directives = F.transform(F.split(F.col("cache_control"), ","), lambda d: F.trim(d))
    deciding = F.filter(directives, lambda d: d.isin("no-cache", "no-store") | d.rlike(r"^max-age=\d+$"))
    first = F.get(deciding, F.lit(0))
    stored = F.col("stored_at")
    kind = entries.schema["stored_at"].dataType

    def after(seconds: Column) -> Column:
        return stored + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

    stamp = F.regexp_extract("expires_header", r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) [A-Z]{3,4}$", 1)
    dated = F.try_to_timestamp(stamp, F.lit("dd MMM yyyy HH:mm:ss")).cast(kind)
    default = after(F.lit(ttl.total_seconds()))
    from_headers = F.when(first.isin("no-cache", "no-store"), after(F.lit(300)))
    if honour_max_age:
        age = F.regexp_extract(first, r"=(\d+)$", 1).try_cast("long")
        from_headers = from_headers.when(age.isNotNull(), after(age))
    now = at(entries, "stored_at", as_of)
    validator = (F.coalesce("etag", F.lit("")) != "") | (F.coalesce("last_modified", F.lit("")) != "")
    stale = stored < at(entries, "stored_at", as_of - timedelta(hours=1))
    return (
        entries.withColumn("expires", F.coalesce(from_headers, dated, default))
        .withColumn("is_expired", now >= F.col("expires"))
        .withColumn("needs_validation", F.when(validator, stale).otherwise(F.col("is_expired")))
    )


def invalidate_by_pattern(entries: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """The entries left after dropping those whose name contains `pattern`."""
    return entries.where(~F.col(name).contains(pattern))


def operation_progress(ops: DataFrame, as_of: datetime, batch: Sequence[str] = ("batch",)) -> DataFrame:
    """Per batch: counts by status, mean progress, remaining time, throughput, mean item time."""
    status = F.col("status")
    sums = ops.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "running").alias("running"),
        F.avg("progress").alias("mean_progress"),
        seconds_between(F.min("start"), at(ops, "start", as_of)).alias("elapsed_s"),
        F.avg(F.when(status == "completed", seconds_between(F.col("start"), F.col("end")))).alias("mean_item_s"),
    )
    left = F.col("total") - F.col("completed") - F.col("failed")
    busy = (F.col("completed") > 0) & (F.col("running") > 0)
    return sums.withColumn(
        "eta_s", F.when(busy, F.col("elapsed_s") / F.col("completed") * left).otherwise(F.lit(0.0))
    ).withColumn("throughput_per_s", _share(F.col("completed"), F.col("elapsed_s")))


def worker_stats(tasks: DataFrame) -> DataFrame:
    """Per worker and, in the row with `is_total`, over all workers."""
    return tasks.rollup("worker").agg(
        (F.grouping("worker") == 1).alias("is_total"),
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("retries") > 0).alias("retried"),
        F.sum("duration").alias("total_time"),
        F.avg("duration").alias("mean_time"),
        F.max("ended").alias("last_task"),
    )


def install_results(results: DataFrame) -> DataFrame:
    """One row per module: success, duration and first error."""
    return results.withColumn("first_error", F.get("errors", F.lit(0))).drop("errors")


def install_totals(results: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    return results.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_modules"),
        F.count_if(F.col("success")).alias("n_ok"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.sum("duration").alias("total_time"),
    )
