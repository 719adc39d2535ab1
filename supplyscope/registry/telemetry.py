"""Queries over telemetry."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.adapters import define, relation
from supplyscope.operators import telemetry as ops
from supplyscope.registry.base import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


define(
    "install_metric",
    """select e.*, event_id % 1000 as download_size, duration / 4 as download_time, event_id % 3 = 0 as cache_hit from op_event e""",
)
define(
    "error_message",
    """select event_id, concat(case event_id % 9 when 0 then 'Network down' when 1 then 'bad CHECKSUM' when 2 then 'access denied: x'
    when 3 then 'no space left on disk' when 4 then 'timeout' when 5 then 'HTTP 404' when 6 then 'exec format error'
    when 7 then 'partial write' else 'odd' end, ' in ', event_type) as message from events""",
)
define(
    "benchmark_old",
    """select l_orderkey * 10 + l_linenumber as name, max(l_extendedprice) as ns_per_op, max(l_quantity) - 10 as bytes_per_op,
    max(l_discount) as allocs_per_op from lineitem group by l_orderkey * 10 + l_linenumber""",
)
define(
    "benchmark_new",
    """select l_orderkey * 10 + l_linenumber as name, max(l_extendedprice * (0.803 + l_tax * 10)) as ns_per_op,
    max(l_quantity * (1 + l_discount * 3.03)) - 10 as bytes_per_op, max(l_tax * 1.003) as allocs_per_op from lineitem group by l_orderkey * 10 + l_linenumber""",
)
define(
    "memory_sample",
    """select event_id, user_id as source, ts, cast(round(value * 100) as bigint) * 1000 as alloc_bytes, event_id % 120 as goroutines,
    event_id * 10007 % 110000000 as pause_a, event_id * 20011 % 110000000 as pause_b, (user_id % 8) / 50.0 as gc_fraction from events""",
)
define(
    "health_check",
    """select user_id % 40 as project, event_id as check_id, case when event_type = 'error' and user_id % 3 = 0 then 'critical'
    when event_type in ('error', 'signup') and user_id % 2 = 0 then 'warning' else 'healthy' end as status,
    case when event_type = 'error' then concat('look at ', cast(user_id as varchar(9))) else '' end as suggestion from events""",
)
define(
    "backup_row",
    """select o_custkey as project, concat('f', cast(o_orderkey % 7 as varchar(9)), '.backup-', cast(1700000000 + o_orderkey % 50 as varchar(19)),
    '-', case o_orderkey % 3 when 0 then 'add' when 1 then 'remove' else 'sync' end, '-', cast(o_orderkey as varchar(19))) as name,
    o_orderdate as mod_time from orders union all
    select c_custkey, concat('note', c_name), timestamp '2000-01-01 00:00:00' from customer""",
)
define(
    "http_entry",
    """select o_orderkey as entry_key, concat('k', cast(o_orderkey as varchar(19))) as name, o_orderdate as stored_at,
    case o_orderkey % 6 when 0 then 'no-cache' when 1 then concat('public, max-age=', cast(o_custkey * 60 as varchar(19)))
    when 2 then 'max-age=30, no-store' when 3 then 'private' when 4 then 'no-store, max-age=9' else '' end as cache_control,
    case when o_orderkey % 4 = 0 then 'Fri, 02 Jan 1998 03:04:05 GMT' when o_orderkey % 4 = 1 then 'soon' else '' end as expires_header,
    case when o_orderkey % 5 = 0 then 'abc' else '' end as etag, case when o_orderkey % 7 = 0 then 'x' end as last_modified from orders""",
)
define(
    "batch_op",
    """select o_custkey as batch, o_orderkey as id, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status,
    o_orderkey % 101 as progress, o_orderdate as start, o_orderdate + interval '1' day * cast(o_orderkey % 9 as int) as "end" from orders""".replace('"end"', "finish"),
)
define(
    "worker_task",
    """select user_id as worker, value as duration, event_type <> 'error' as ok, event_id % 4 as retries, ts as ended from events""",
)
define(
    "install_result",
    """select o_custkey as run, o_orderkey as module, o_orderstatus <> 'F' as success, o_totalprice as duration, o_orderpriority as err from orders""",
)

SUMMARY = """select count(*) as installs, count(*) filter (where method = 'binary') as binary_installs,
    count(*) filter (where method = 'source') as source_installs,
    round(avg(case when success then 1.0 else 0.0 end) filter (where method = 'binary'), 6) as binary_success_rate,
    round(avg(case when success then 1.0 else 0.0 end) filter (where method = 'source'), 6) as source_success_rate,
    round(count(*) filter (where success and method <> 'unknown') / count(*), 6) as overall_success_rate,
    round(avg(duration) filter (where method = 'binary'), 6) as mean_binary_time,
    round(avg(duration) filter (where method = 'source'), 6) as mean_source_time, min(ts) as from_ts, max(ts) as to_ts from op_event"""


@book.query("e1_install_summary", ("op_event",), SUMMARY)
def e1(spark, sf):
    rates = ["binary_success_rate", "source_success_rate", "overall_success_rate"]
    return rounded(ops.install_summary(relation(spark, sf, "op_event")), *rates, "mean_binary_time", "mean_source_time")


@book.query(
    "e2_method_comparison",
    ("install_metric",),
    """with s as (select op, method, count(*) as n, sum(success::int) as ok, avg(duration) filter (where success) as t, avg(download_size) as size,
      avg(download_time) as dt, avg(cache_hit::int) as hit from install_metric group by op, method)
    select op, b.n as n_binary, s2.n as n_source, round(b.ok / b.n, 6) as binary_success_rate, round(s2.ok / s2.n, 6) as source_success_rate,
      round(s2.t / b.t, 6) as speedup, round(b.size, 6) as mean_download_size, round(b.dt, 6) as mean_download_time, round(b.hit, 6) as cache_hit_rate
    from (select * from s where method = 'binary') b join (select * from s where method = 'source') s2 using (op)""",
)
def e2(spark, sf):
    df = ops.method_comparison(relation(spark, sf, "install_metric"), group=["op"])
    return rounded(df, *[c for c in df.columns if c not in ("op", "n_binary", "n_source")])


@book.query(
    "e3_categorize_errors",
    ("error_message",),
    """select case when regexp_matches(m, 'network|connection') then 'network_error' when regexp_matches(m, 'checksum|verify') then 'verification_error'
      when regexp_matches(m, 'permission|access') then 'permission_error' when regexp_matches(m, 'disk|space') then 'storage_error'
      when m like '%timeout%' then 'timeout_error' when regexp_matches(m, 'not found|404') then 'not_found_error' else 'general_error' end as category,
      count(*) as n from (select lower(message) as m from error_message) group by 1""",
)
def e3(spark, sf):
    return ops.categorize_errors(relation(spark, sf, "error_message"))


@book.query(
    "e3_update_failures",
    ("error_message",),
    """select case when regexp_matches(m, 'permission denied|access denied') then 'permission_denied'
      when regexp_matches(m, 'no space|disk full|file too large') then 'filesystem_full' when regexp_matches(m, 'checksum|hash|integrity') then 'checksum_mismatch'
      when regexp_matches(m, 'network|connection|timeout|dns') then 'network_failure'
      when regexp_matches(m, 'exec format|cannot execute|incompatible') then 'incompatible_binary'
      when regexp_matches(m, 'interrupted|partial|incomplete') then 'partial_update' else 'unknown_failure' end as category,
      count(*) as n from (select message as m from error_message) group by 1""",
)
def e3_update(spark, sf):
    return ops.categorize_errors(relation(spark, sf, "error_message"), ruleset="update")


METRICS = """select op, count(*) as n, round(sum(duration), 4) as total_time, min(duration) as min_time, max(duration) as max_time,
    round(avg(duration), 6) as avg_time, arg_max(duration, (ts, event_id)) as last_time from op_event group by op"""


@book.query("e4_operation_metrics", ("op_event",), METRICS)
def e4(spark, sf):
    df = ops.operation_metrics(relation(spark, sf, "op_event"))
    return rounded(rounded(df, "total_time", places=4), "avg_time")


@book.query(
    "e5_slowest_operations",
    ("op_event",),
    "select source, round(avg(duration), 6) as avg_time from op_event group by source order by avg(duration) desc, source limit 10",
)
def e5(spark, sf):
    per_source = relation(spark, sf, "op_event").drop("op").withColumnRenamed("source", "op")
    slow = ops.slowest_operations(ops.operation_metrics(per_source), 10)
    return rounded(slow.select(F.col("op").alias("source"), "avg_time"), "avg_time")


@book.query(
    "e6_optimization_suggestions",
    ("op_event", "memory_sample"),
    """with m as (select source, avg(duration) as a, max(duration) as x from op_event group by source),
    mem as (select source, max(alloc_bytes) as alloc, max(event_id) * 12 as heap from memory_sample group by source),
    c as (select source, sum(success::int) as h, sum((not success)::int) as mi, count(*) * 20 as items from op_event group by source),
    u as (select source, 'performance' as category, 'average_time' as metric, case when a / 20 > 5 then 3 when a / 20 > 3 then 2 when a / 20 > 2 then 1 else 0 end as lvl, a as cur from m where a > 20
      union all select source, 'performance', 'time_variance', 1, x from m where x > 3 * a
      union all select source, 'memory', 'allocation', 2, alloc from mem where alloc > 15000000
      union all select source, 'memory', 'heap_objects', 1, heap from mem where heap > 100000
      union all select source, 'caching', 'hit_rate', 2, h / (h + mi) from c where h / (h + mi) < 0.8 and h + mi > 10
      union all select source, 'caching', 'cache_size', 1, items from c where items > 1000)
    select cast(source as varchar) as subject, category, metric, lvl as impact_level, round(cur, 6) as current,
      ['low','medium','high','critical'][lvl + 1] as impact from u""",
)
def e6(spark, sf):
    events = relation(spark, sf, "op_event")
    metrics = ops.operation_metrics(events.drop("op").withColumnRenamed("source", "op"))
    memory = (
        relation(spark, sf, "memory_sample")
        .groupBy("source")
        .agg(F.max("alloc_bytes").alias("alloc_bytes"), (F.max("event_id") * 12).alias("heap_objects"))
    )
    caches = events.groupBy(F.col("source").alias("cache")).agg(
        F.count_if("success").alias("hits"), F.count_if(~F.col("success")).alias("misses"), (F.count("*") * 20).alias("items")
    )
    limits = {"max_time": 20, "max_memory": 15000000}
    return rounded(ops.optimization_suggestions(metrics, memory, caches, limits), "current")


@book.query(
    "e7_detect_regressions",
    ("benchmark_old", "benchmark_new"),
    """with p as (select o.name, unnest(['ns_per_op','bytes_per_op','allocs_per_op']) as metric,
      unnest([o.ns_per_op, o.bytes_per_op, o.allocs_per_op]) as old_value, unnest([n.ns_per_op, n.bytes_per_op, n.allocs_per_op]) as new_value
      from benchmark_old o join benchmark_new n using (name)),
    c as (select *, (new_value - old_value) / old_value as change from p where old_value <> 0 and (metric = 'ns_per_op' or (old_value > 0 and new_value > 0)))
    select name, metric, round(old_value, 6) as old_value, round(new_value, 6) as new_value, round(change, 9) as change,
      case when change > 0.5 then 'critical' when change > 0.25 then 'major' else 'minor' end as severity from c where change > 0.1""",
)
def e7(spark, sf):
    def steady(df):
        return df.select("name", *[F.col(c).cast("double").alias(c) for c in df.columns if c != "name"])

    df = ops.detect_regressions(steady(relation(spark, sf, "benchmark_old")), steady(relation(spark, sf, "benchmark_new")))
    return rounded(rounded(df, "old_value", "new_value"), "change", places=9)


TREND = """with s as (select *, alloc_bytes - lag(alloc_bytes) over (partition by source order by ts, event_id) as step from memory_sample),
    a as (select source, count(*) as n, arg_min(alloc_bytes, (ts, event_id)) as v0, arg_max(alloc_bytes, (ts, event_id)) as v1,
      epoch(max(ts)) - epoch(min(ts)) as secs, avg(step) filter (where step > 0) as g from s group by source)
    select source, n, case when n >= 2 then round(secs, 3) end as duration_s, case when n >= 2 then v1 - v0 end as delta,
      case when n >= 2 and secs > 0 then round((v1 - v0) / secs, 3) end as rate_per_s,
      case when n < 2 then 'insufficient_data' when v1 > v0 then 'increasing' when v1 < v0 then 'decreasing' else 'stable' end as direction,
      round(case when n >= 5 then coalesce(g, 0) else 0 end, 3) as avg_growth from a"""


@book.query("e8_usage_trend", ("memory_sample",), TREND)
def e8(spark, sf):
    df = ops.usage_trend(relation(spark, sf, "memory_sample"), order=["ts", "event_id"])
    return rounded(df, "duration_s", "rate_per_s", "avg_growth", places=3)


LEAKS = """r as (select *, row_number() over (partition by source order by ts desc, event_id desc) as back,
      count(*) over (partition by source) as n, alloc_bytes - lag(alloc_bytes) over (partition by source order by ts, event_id) as step from memory_sample),
    t as (select source, sum(step) filter (where back <= 4 and step > 0) as growth, coalesce(min(back) filter (where back <= 4 and step <= 0), 5) - 1 as run,
      max(goroutines) filter (where back = 1) as gor, max(greatest(pause_a, pause_b)) filter (where back = 1) as pause from r where n >= 10 group by source),
    iss as (select source, 'sustained_growth' as issue, 'medium' as severity, growth::double as amount from t where run >= 3 and growth > 1048576
      union all select source, 'goroutine_leak', 'high', gor from t where gor > 100
      union all select source, 'gc_pressure', 'medium', pause from t where pause > 100000000)"""


def _samples(spark, sf):
    return relation(spark, sf, "memory_sample").withColumn("pause_ns", F.array("pause_a", "pause_b"))


@book.query("e9_detect_leaks", ("memory_sample",), f"with {LEAKS} select * from iss")
def e9(spark, sf):
    return ops.detect_leaks(_samples(spark, sf), order=["ts", "event_id"])


@book.query(
    "e10_health_status",
    ("memory_sample",),
    f"""with {LEAKS}, a as (select source, arg_min(alloc_bytes, (ts, event_id)) as v0, arg_max(alloc_bytes, (ts, event_id)) as v1,
      epoch(max(ts)) - epoch(min(ts)) as secs, max(gc_fraction) as gc from memory_sample group by source),
    k as (select source, count(*) as n, count(*) filter (where severity = 'high') as hi from iss group by source)
    select a.source, coalesce(k.n, 0) as n_issues, case when k.hi > 0 then 'critical'
      when k.n > 2 or (v1 > v0 and (v1 - v0) / secs > 1048576) or gc > 0.1 then 'warning' else 'healthy' end as status
    from a left join k on a.source = k.source""",
)
def e10(spark, sf):
    samples = _samples(spark, sf)
    stats = samples.groupBy("source").agg(F.max("gc_fraction").alias("gc_fraction"))
    order = ["ts", "event_id"]
    return ops.health_status(ops.detect_leaks(samples, order), ops.usage_trend(samples, order=order), stats)


@book.query(
    "e10_check_rollup",
    ("health_check",),
    """select project, case when c > 0 then 'critical' when w > 0 then 'warning' else 'healthy' end as status, h as n_healthy, w as n_warning, c as n_critical,
      concat(h, ' checks passed, ', w, ' warnings, ', c, ' critical issues') as summary, s as n_next_steps
    from (select project, count(*) filter (where status = 'healthy') h, count(*) filter (where status = 'warning') w,
      count(*) filter (where status = 'critical') c, count(*) filter (where suggestion <> '') s from health_check group by project)""",
)
def e10_checks(spark, sf):
    return ops.check_rollup(relation(spark, sf, "health_check"), ["project"])


@book.query("e10_next_steps", ("health_check",), "select project, check_id, suggestion from health_check where suggestion <> ''")
def e10_steps(spark, sf):
    return ops.next_steps(relation(spark, sf, "health_check")).select("project", "check_id", "suggestion")


@book.query(
    "e11_keep_last_n",
    ("memory_sample",),
    """select source, event_id, alloc_bytes from memory_sample qualify row_number() over (partition by source order by ts desc, event_id desc) <= 20""",
)
def e11(spark, sf):
    kept = ops.keep_last_n(relation(spark, sf, "memory_sample"), 20, order=["ts", "event_id"])
    return kept.select("source", "event_id", "alloc_bytes")


STATE = """o as (select mirror, max((ts, event_id)) as ok_at from mirror_check where healthy group by mirror),
    st as (select m.mirror, arg_max(healthy, (ts, event_id)) as healthy, arg_max(latency, (ts, event_id)) as latency, arg_max(priority, (ts, event_id)) as priority,
      arg_max(enabled, (ts, event_id)) as enabled, count(*) filter (where not healthy and (ok_at is null or (ts, event_id) > ok_at)) as consecutive_failures,
      count(*) filter (where not healthy) as total_failures, max(ts) filter (where healthy) as last_success, max(ts) filter (where not healthy) as last_failure
      from mirror_check m left join o on m.mirror = o.mirror group by m.mirror)"""


@book.query("e12_mirror_current_state", ("mirror_check",), f"with {STATE} select * from st")
def e12(spark, sf):
    return ops.mirror_current_state(relation(spark, sf, "mirror_check"))


# checks, entries and backups without a key are a group of their own
define("loose_check", "select event_id, case when mirror % 10 <> 0 then mirror end as mirror, ts, healthy, latency, priority, enabled from mirror_check")
define("loose_entry", "select entry_key, case when pool % 4 <> 0 then pool end as pool, size, created_at, last_accessed, expired from cache_entry")
define("loose_backup", "select case when project % 9 <> 0 then project end as project, name, mod_time from backup_row")
LOOSE = STATE.replace("mirror_check", "loose_check").replace("m.mirror = o.mirror", "m.mirror is not distinct from o.mirror")


@book.query("e12_checks_without_mirror", ("loose_check",), f"with {LOOSE} select * from st")
def e12_loose(spark, sf):
    return ops.mirror_current_state(relation(spark, sf, "loose_check"))


@book.query(
    "e13_rank_mirrors",
    ("mirror_check",),
    f"""with {STATE} select mirror % 6 as region, mirror, row_number() over (partition by mirror % 6
      order by priority, healthy desc, latency, mirror)::bigint as chain_pos from st where enabled""",
)
def e13(spark, sf):
    state = ops.mirror_current_state(relation(spark, sf, "mirror_check")).withColumn("region", F.col("mirror") % 6)
    return ops.rank_mirrors(state, ["region"]).select("region", "mirror", "chain_pos")


@book.query(
    "e13_best_mirror",
    ("mirror_check",),
    f"""with {STATE} select mirror % 6 as region, mirror from st where enabled and healthy
      qualify row_number() over (partition by mirror % 6 order by priority, latency, mirror) = 1""",
)
def e13_best(spark, sf):
    state = ops.mirror_current_state(relation(spark, sf, "mirror_check")).withColumn("region", F.col("mirror") % 6)
    return ops.rank_mirrors(state, ["region"], best_only=True).select("region", "mirror")


PICK = """with {state}, g as (select mirror % 9 as region, mirror, healthy and enabled as available, latency from st),
    f as (select g.* from g where available or not exists (select 1 from g h where h.region = g.region and h.available))
    select region, mirror from f qualify {how}"""


def _choose(spark, sf, strategy):
    state = ops.mirror_current_state(relation(spark, sf, "mirror_check")).select(
        (F.col("mirror") % 9).alias("region"), "mirror", (F.col("healthy") & F.col("enabled")).alias("available"), "latency"
    )
    return ops.select_mirror(state, strategy, ["region"], tick=7).select("region", "mirror")


@book.query("e14_select_mirror_first", ("mirror_check",), PICK.format(state=STATE, how="row_number() over (partition by region order by mirror) = 1"))
def e14_first(spark, sf):
    return _choose(spark, sf, "first")


@book.query(
    "e14_select_mirror_fastest", ("mirror_check",), PICK.format(state=STATE, how="row_number() over (partition by region order by latency, mirror) = 1")
)
def e14_fastest(spark, sf):
    return _choose(spark, sf, "fastest")


@book.query(
    "e14_select_mirror_round_robin",
    ("mirror_check",),
    PICK.format(
        state=STATE, how="row_number() over (partition by region order by mirror) = 7 % count(*) over (partition by region) + 1"
    ),
)
def e14_round_robin(spark, sf):
    return _choose(spark, sf, "round_robin")


@book.query(
    "e14_select_mirror_random",
    ("mirror_check",),
    PICK.format(state=STATE, how="row_number() over (partition by region order by md5(concat('0-', mirror)), mirror) = 1"),
)
def e14_random(spark, sf):
    return _choose(spark, sf, "random")


NOW = datetime(1998, 6, 1)
NOW_SQL = "timestamp '1998-06-01 00:00:00'"
STATS = f"""count(*) as files, round(sum(size), 2) as bytes, count(*) filter (where expired) as n_expired, count(*) filter (where not expired) as n_valid,
    min(created_at) as oldest, max(created_at) as newest, round(avg(epoch({NOW_SQL}) - epoch(created_at)), 3) as mean_age_s from cache_entry"""


@book.query("e15_cache_stats", ("cache_entry",), f"select pool, {STATS} group by pool")
def e15(spark, sf):
    df = ops.cache_stats(relation(spark, sf, "cache_entry"), NOW, ["pool"])
    return rounded(rounded(df, "bytes", places=2), "mean_age_s", places=3)


@book.query("e15_cache_totals", ("cache_entry",), f"select {STATS}")
def e15_total(spark, sf):
    df = ops.cache_stats(relation(spark, sf, "cache_entry"), NOW)
    return rounded(rounded(df, "bytes", places=2), "mean_age_s", places=3)


@book.query(
    "e15_hit_ratio",
    ("op_event",),
    """select source, sum(success::int)::bigint as hits, sum((not success)::int)::bigint as misses, round(avg(success::int), 6) as hit_ratio from op_event group by source""",
)
def e15_ratio(spark, sf):
    lookups = relation(spark, sf, "op_event").select(
        "source", F.col("success").cast("long").alias("hits"), (~F.col("success")).cast("long").alias("misses")
    )
    return rounded(ops.hit_ratio(lookups, ["source"]), "hit_ratio")


@book.query(
    "e16_expire_entries",
    ("cache_entry",),
    f"""select entry_key, created_at < {NOW_SQL} - interval '400' day or last_accessed <= {NOW_SQL} as evicted from cache_entry""",
)
def e16(spark, sf):
    df = ops.expire_entries(relation(spark, sf, "cache_entry"), NOW, timedelta(days=400), expires="last_accessed")
    return df.select("entry_key", "evicted")


CUM = "sum(cast(size as decimal(18,2))) over (partition by pool order by last_accessed desc, entry_key desc)"


@book.query("e17_evict_by_size", ("cache_entry",), f"select pool, entry_key from cache_entry qualify {CUM} > 20000000")
def e17(spark, sf):
    entries = relation(spark, sf, "cache_entry").withColumn("size", F.col("size").cast("decimal(18,2)"))
    return ops.evict_by_size(entries, 20000000).select("pool", "entry_key")


@book.query(
    "e17_evict_all",
    ("cache_entry",),
    f"""select pool, entry_key, 'age' as reason from cache_entry where last_accessed < {NOW_SQL} - interval '900' day union all
    (select pool, entry_key, 'size' from cache_entry where last_accessed >= {NOW_SQL} - interval '900' day qualify {CUM} > 20000000)""",
)
def e17_all(spark, sf):
    entries = relation(spark, sf, "cache_entry").withColumn("size", F.col("size").cast("decimal(18,2)"))
    return ops.evict_all(entries, NOW, timedelta(days=900), 20000000).select("pool", "entry_key", "reason")


@book.query(
    "e18_evict_by_count",
    ("cache_entry",),
    "select pool, entry_key from cache_entry qualify row_number() over (partition by pool order by last_accessed desc, entry_key desc) > 100",
)
def e18(spark, sf):
    return ops.evict_by_count(relation(spark, sf, "cache_entry"), 100).select("pool", "entry_key")


@book.query(
    "e18_entries_without_pool",
    ("loose_entry",),
    "select pool, entry_key from loose_entry qualify row_number() over (partition by pool order by last_accessed desc, entry_key desc) > 100",
)
def e18_loose(spark, sf):
    return ops.evict_by_count(relation(spark, sf, "loose_entry"), 100).select("pool", "entry_key")


@book.query(
    "e19_apply_retention",
    ("backup_row",),
    f"""with o as (select *, mod_time < {NOW_SQL} - interval '700' day as old from backup_row),
    r as (select *, row_number() over (partition by project, old order by mod_time desc, name desc) as rn from o)
    select project, name, case when old then 'age' when rn > 3 then 'count' end as reason, not old and rn <= 3 as keep from r""",
)
def e19(spark, sf):
    df = ops.apply_retention(relation(spark, sf, "backup_row"), NOW, 700, 3)
    return df.select("project", "name", "reason", "keep")


@book.query(
    "e19_backups_without_project",
    ("loose_backup",),
    f"""with o as (select *, mod_time < {NOW_SQL} - interval '700' day as old from loose_backup),
    r as (select *, row_number() over (partition by project, old order by mod_time desc, name desc) as rn from o)
    select project, name, case when old then 'age' when rn > 3 then 'count' end as reason, not old and rn <= 3 as keep from r""",
)
def e19_loose(spark, sf):
    df = ops.apply_retention(relation(spark, sf, "loose_backup"), NOW, 700, 3)
    return df.select("project", "name", "reason", "keep")


SESSIONS = """select project, regexp_extract(name, '\\.backup-(\\d+-[a-z]+)', 1) as session, regexp_extract(name, '\\.backup-\\d+-([a-z]+)', 1) as op,
    regexp_extract(name, '\\.backup-(\\d+)', 1)::bigint as epoch, count(*) as n_files from backup_row where contains(name, '.backup-') group by all"""


@book.query("e20_group_sessions", ("backup_row",), SESSIONS)
def e20(spark, sf):
    df = ops.group_sessions(relation(spark, sf, "backup_row"), ["project"])
    return df.withColumn("epoch", F.unix_seconds("ts")).drop("ts")


@book.query(
    "e20_backup_files",
    ("backup_row",),
    """select project, name, regexp_extract(name, '\\.backup-(\\d+-[^-]*)', 1) as session, regexp_extract(name, '\\.backup-\\d+-([^-]*)', 1) as op,
    regexp_extract(name, '\\.backup-(\\d+)', 1)::bigint as epoch from backup_row where contains(name, '.backup-')""",
)
def e20_files(spark, sf):
    df = ops.backup_files(relation(spark, sf, "backup_row"))
    return df.select("project", "name", "session", "op", F.unix_seconds("ts").alias("epoch"))


@book.query(
    "e20_latest_session",
    ("backup_row",),
    f"select * from ({SESSIONS}) qualify row_number() over (partition by project order by epoch desc, session) = 1",
)
def e20_latest(spark, sf):
    df = ops.group_sessions(relation(spark, sf, "backup_row"), ["project"], latest_only=True)
    return df.withColumn("epoch", F.unix_seconds("ts")).drop("ts")


@book.query(
    "e21_freshness",
    ("http_entry",),
    f"""with e as (select *, case entry_key % 6 when 0 then stored_at + interval '5' minute when 4 then stored_at + interval '5' minute
      when 2 then stored_at + interval '30' second when 1 then stored_at + to_seconds(regexp_extract(cache_control, '=(\\d+)', 1)::bigint)
      else case when entry_key % 4 = 0 then timestamp '1998-01-02 03:04:05' else stored_at + interval '24' hour end end as expires from http_entry)
    select entry_key, expires, expires <= {NOW_SQL} as is_expired, case when etag <> '' or last_modified <> '' then stored_at < {NOW_SQL} - interval '1' hour
      else expires <= {NOW_SQL} end as needs_validation from e""",
)
def e21(spark, sf):
    df = ops.freshness(relation(spark, sf, "http_entry"), NOW, timedelta(hours=24))
    return df.select("entry_key", "expires", "is_expired", "needs_validation")


@book.query("e21_invalidate_by_pattern", ("http_entry",), "select entry_key, name from http_entry where not contains(name, '42')")
def e21_pattern(spark, sf):
    return ops.invalidate_by_pattern(relation(spark, sf, "http_entry"), "42").select("entry_key", "name")


@book.query(
    "e22_operation_progress",
    ("batch_op",),
    f"""with s as (select batch, count(*) as total, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed,
      count(*) filter (where status = 'running') as running, avg(progress) as mean_progress, epoch({NOW_SQL}) - epoch(min(start)) as elapsed_s,
      avg(epoch(finish) - epoch(start)) filter (where status = 'completed') as mean_item_s from batch_op group by batch)
    select batch, total, completed, failed, running, round(mean_progress, 6) as mean_progress, round(elapsed_s, 3) as elapsed_s, round(mean_item_s, 3) as mean_item_s,
      round(case when completed > 0 and running > 0 then elapsed_s / completed * (total - completed - failed) else 0 end, 3) as eta_s,
      round(case when elapsed_s > 0 then completed / elapsed_s else 0 end, 9) as throughput_per_s from s""",
)
def e22(spark, sf):
    df = ops.operation_progress(relation(spark, sf, "batch_op").withColumnRenamed("finish", "end"), NOW)
    df = rounded(df, "elapsed_s", "mean_item_s", "eta_s", places=3)
    return rounded(rounded(df, "mean_progress"), "throughput_per_s", places=9)


@book.query(
    "e23_worker_stats",
    ("worker_task",),
    """select worker, grouping(worker) = 1 as is_total, count(*) as processed, count(*) filter (where not ok) as failed, count(*) filter (where retries > 0) as retried,
    round(sum(duration), 4) as total_time, round(avg(duration), 6) as mean_time, max(ended) as last_task from worker_task group by rollup (worker)""",
)
def e23(spark, sf):
    df = ops.worker_stats(relation(spark, sf, "worker_task"))
    return rounded(rounded(df, "total_time", places=4), "mean_time")


def _results(spark, sf):
    errors = F.when(F.col("success"), F.array().cast("array<string>")).otherwise(F.array("err", F.lit("later")))
    return relation(spark, sf, "install_result").withColumn("errors", errors).drop("err")


@book.query(
    "e24_install_results",
    ("install_result",),
    "select run, module, success, duration, case when not success then err end as first_error from install_result",
)
def e24(spark, sf):
    return ops.install_results(_results(spark, sf))


@book.query(
    "e24_install_totals",
    ("install_result",),
    """select run, count(*) as n_modules, count(*) filter (where success) as n_ok, count(*) filter (where not success) as n_failed,
    round(sum(duration), 2) as total_time from install_result group by run""",
)
def e24_totals(spark, sf):
    return rounded(ops.install_totals(_results(spark, sf)), "total_time", places=2)
