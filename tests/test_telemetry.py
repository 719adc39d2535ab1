from datetime import datetime, timedelta

from pyspark.sql import functions as F

from supplyscope.operators import telemetry as ops

NOON = datetime(2024, 1, 1, 12)


def test_rates_keep_unknown_methods_in_the_denominator(frame):
    rows = [("binary", True, 2.0), ("binary", False, 4.0), ("source", True, 10.0), ("unknown", True, 1.0)]
    df = frame("method string, success boolean, duration double, ts timestamp", *[(*r, NOON) for r in rows])
    r = ops.install_summary(df).first()
    assert (r.installs, r.binary_success_rate, r.source_success_rate, r.overall_success_rate, r.mean_binary_time) == (4, 0.5, 1.0, 0.5, 3.0)
    empty = ops.install_summary(df.where("false")).first()
    assert (empty.installs, empty.overall_success_rate) == (0, 0.0)


def test_comparison_needs_both_sides(frame):
    schema = "method string, success boolean, duration double, download_size long, download_time double, cache_hit boolean"
    df = frame(schema, ("binary", True, 2.0, 100, 1.0, True), ("binary", False, 50.0, 300, 3.0, False), ("source", True, 10.0, 0, 0.0, False))
    r = ops.method_comparison(df).first()
    assert (r.speedup, r.mean_download_size, r.cache_hit_rate) == (5.0, 200.0, 0.5)
    alone = ops.method_comparison(df.where("method = 'binary'")).first()
    assert (alone.n_binary, alone.n_source, alone.speedup, alone.cache_hit_rate) == (2, 0, None, None)


def test_severity_order(frame):
    schema = "name string, ns_per_op double, bytes_per_op double, allocs_per_op double"
    old = frame(schema, ("a", 100.0, 100.0, 0.0), ("b", 0.0, 10.0, 10.0), ("c", 100.0, 100.0, 100.0))
    new = frame(schema, ("a", 160.0, 130.0, 9.0), ("b", 5.0, 11.5, 10.0), ("c", 110.0, 50.0, 100.0))
    got = sorted((r.name, r.metric, r.severity) for r in ops.detect_regressions(old, new).collect())
    assert got == [("a", "bytes_per_op", "major"), ("a", "ns_per_op", "critical"), ("b", "bytes_per_op", "minor")]


def samples(frame, *series, goroutines=1, pause=0):
    rows = [(s, NOON + timedelta(seconds=i), v, goroutines, [pause]) for s, values in series for i, v in enumerate(values)]
    return frame("source string, ts timestamp, alloc_bytes long, goroutines int, pause_ns array<long>", *rows)


def test_trend(frame):
    df = samples(frame, ("up", [0, 10, 5, 25, 30, 60]), ("one", [5]), ("flat", [7, 9, 7]))
    for limit in (10**9, 3):
        got = {r.source: (r.n, r.delta, r.rate_per_s, r.direction, r.avg_growth) for r in ops.usage_trend(df, max_rows=limit).collect()}
        assert got["up"] == (6, 60, 12.0, "increasing", 16.25)
        assert got["one"] == (1, None, None, "insufficient_data", 0.0)
        assert got["flat"] == (3, 0, 0.0, "stable", 0.0)


def test_leaks(frame):
    mib = 1024 * 1024
    steady = [0] * 6 + [mib * i for i in range(4)]
    broken = [0] * 7 + [mib * 5, 0, mib]
    got = sorted((r.source, r.issue) for r in ops.detect_leaks(samples(frame, ("steady", steady), ("broken", broken), ("short", steady[:9]))).collect())
    assert got == [("steady", "sustained_growth")]
    noisy = ops.detect_leaks(samples(frame, ("n", [0] * 10), goroutines=101, pause=100_000_001)).collect()
    assert sorted(r.issue for r in noisy) == ["gc_pressure", "goroutine_leak"]


def checks(frame, *rows):
    full = [(i, m, NOON + timedelta(seconds=t), ok, float(t), 1, True) for i, (m, t, ok) in enumerate(rows)]
    return frame("event_id int, mirror string, ts timestamp, healthy boolean, latency double, priority int, enabled boolean", *full)


def test_mirror_state(frame):
    df = checks(frame, ("a", 1, True), ("a", 3, False), ("a", 2, False), ("b", 1, False), ("c", 1, False), ("c", 2, True))
    for hot in (10**9, 1):
        got = {r.mirror: (r.healthy, r.consecutive_failures, r.total_failures, r.last_success is None) for r in ops.mirror_current_state(df, hot_rows=hot).collect()}
        assert got == {"a": (False, 2, 2, False), "b": (False, 1, 1, True), "c": (True, 0, 1, False)}


def test_strategies_fall_back_to_all(frame):
    state = frame(
        "region int, mirror string, available boolean, latency double",
        (1, "a", False, 1.0), (1, "b", True, 9.0), (1, "c", True, 5.0), (2, "x", False, 3.0), (2, "y", False, 2.0),
    )

    def pick(strategy, **more):
        return {r.region: r.mirror for r in ops.select_mirror(state, strategy, ["region"], **more).collect()}

    assert pick("first") == {1: "b", 2: "x"}
    assert pick("fastest") == {1: "c", 2: "y"}
    assert pick("round_robin", tick=3) == {1: "c", 2: "y"}
    assert pick("round_robin", tick=3, max_rows=1) == {1: "c", 2: "y"}
    assert pick("random", seed=1)[1] in ("b", "c")


def entries(frame):
    rows = [(k, 1, 10.0, NOON - timedelta(hours=k)) for k in range(6)]
    return frame("entry_key int, pool int, size double, last_accessed timestamp", *rows)


def test_evictions(frame):
    df = entries(frame)
    for limit in (10**9, 2):
        assert sorted(r.entry_key for r in ops.evict_by_size(df, 30, max_rows=limit).collect()) == [3, 4, 5]
    assert sorted(r.entry_key for r in ops.evict_by_count(df, 4).collect()) == [4, 5]
    assert ops.evict_by_count(df, 6).count() == 0
    both = ops.evict_all(df, NOON, timedelta(hours=4), 20)
    assert sorted((r.entry_key, r.reason) for r in both.collect()) == [(2, "size"), (3, "size"), (4, "size"), (5, "age")]


def test_expiry_is_inclusive(frame):
    df = frame("k int, created_at timestamp, expires timestamp", (1, NOON, NOON), (2, NOON, NOON + timedelta(seconds=1)), (3, NOON, None))
    got = ops.expire_entries(df, NOON, expires="expires").collect()
    assert [r.evicted for r in sorted(got)] == [True, False, False]


def test_retention_zero_is_no_limit(frame):
    rows = [(1, f"b{i}", NOON - timedelta(days=i)) for i in range(5)]
    df = frame("project int, name string, mod_time timestamp", *rows)

    def kept(days, most):
        return sorted(r.name for r in ops.apply_retention(df, NOON, days, most).where("keep").collect())

    assert kept(0, 0) == ["b0", "b1", "b2", "b3", "b4"]
    assert kept(2, 0) == ["b0", "b1", "b2"]
    assert kept(0, 2) == ["b0", "b1"]
    assert kept(3, 3) == ["b0", "b1", "b2"]


def test_sessions(frame):
    df = frame("name string", *[(n,) for n in ("f.backup-100-add-1", "g.backup-100-add-2", "f.backup-200-rm-1", "f.backup-x-rm-1", "plain", "f.backup-300")])
    got = sorted((r.session, r.op, r.n_files) for r in ops.group_sessions(df).collect())
    assert got == [("100-add", "add", 2), ("200-rm", "rm", 1)]
    assert ops.group_sessions(df, latest_only=True).first().session == "200-rm"


def test_freshness(frame):
    schema = "k int, stored_at timestamp, cache_control string, expires_header string, etag string, last_modified string"
    rows = [
        (1, "no-cache", "", "", ""), (2, "max-age=60", "", "", ""), (3, "max-age=60, no-store", "", "e", ""), (4, "", "Mon, 01 Jan 2024 12:00:00 GMT", "", ""),
        (5, "", "rubbish", "", "lm"), (6, None, None, None, None),
    ]
    df = frame(schema, *[(k, NOON - timedelta(minutes=90), *rest) for k, *rest in rows])
    got = {r.k: ((r.expires - (NOON - timedelta(minutes=90))).total_seconds(), r.is_expired, r.needs_validation) for r in ops.freshness(df, NOON, timedelta(hours=24)).collect()}
    assert got == {
        1: (300, True, True), 2: (60, True, True), 3: (60, True, True), 4: (5400, True, True), 5: (86400, False, True), 6: (86400, False, False),
    }
    ignored = ops.freshness(df, NOON, timedelta(hours=24), honour_max_age=False).where("k = 2").first()
    assert not ignored.is_expired


def test_progress_and_workers(frame):
    schema = "batch int, status string, progress double, start timestamp, end timestamp"
    rows = [(1, "completed", 1.0, NOON - timedelta(seconds=20), NOON - timedelta(seconds=10)), (1, "running", 0.5, NOON, None), (1, "failed", 0.0, NOON, None), (1, "pending", 0.0, NOON, None)]
    r = ops.operation_progress(frame(schema, *rows), NOON).first()
    assert (r.completed, r.failed, r.running, r.mean_progress, r.eta_s, r.throughput_per_s, r.mean_item_s) == (1, 1, 1, 0.375, 40.0, 0.05, 10.0)
    tasks = frame("worker int, duration double, ok boolean, retries int, ended timestamp", (1, 1.0, True, 0, NOON), (1, 3.0, False, 2, NOON), (2, 5.0, True, 0, NOON))
    got = {r.worker: (r.is_total, r.processed, r.failed, r.retried, r.mean_time) for r in ops.worker_stats(tasks).collect()}
    assert got == {1: (False, 2, 1, 1, 2.0), 2: (False, 1, 0, 0, 5.0), None: (True, 3, 1, 1, 3.0)}


def test_categories(frame):
    texts = ["Connection reset", "checksum bad", "no ACCESS", "disk full", "timeout", "HTTP 404", "huh"]
    df = frame("message string", *[(t,) for t in texts])
    got = df.select(ops.error_category(F.col("message"))).collect()
    assert [r[0] for r in got] == ["network_error", "verification_error", "permission_error", "storage_error", "timeout_error", "not_found_error", "general_error"]


def test_null_keys_are_groups(frame):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    checks = frame(
        "event_id long, mirror string, ts timestamp, healthy boolean, latency double, priority int, enabled boolean",
        *[(k, m, start + timedelta(seconds=k), ok, 1.0, 1, True) for k, (m, ok) in enumerate([(None, False), (None, False), (None, True), (None, False), ("a", False)])],
    )
    for hot_rows in (1, 1000):
        got = {r.mirror: (r.consecutive_failures, r.total_failures) for r in ops.mirror_current_state(checks, hot_rows=hot_rows).collect()}
        assert got == {None: (1, 3), "a": (1, 1)}
    entries = frame("entry_key long, pool string, last_accessed timestamp", *[(k, "p" if k % 2 else None, start + timedelta(days=k)) for k in range(6)])
    assert sorted(r.entry_key for r in ops.evict_by_count(entries, 2).collect()) == [0, 1]
    backups = frame("project string, name string, mod_time timestamp", *[("p" if k % 2 else None, f"b{k}", start + timedelta(days=k)) for k in range(6)])
    kept = ops.apply_retention(backups, start + timedelta(days=9), 0, 2).where("keep").collect()
    assert sorted(r.name for r in kept) == ["b2", "b3", "b4", "b5"]
