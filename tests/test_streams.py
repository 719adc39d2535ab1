from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from supplyscope.operators.telemetry import mirror_current_state
from supplyscope.sources import metric_files, text_trees
from supplyscope.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, op string, source string, ts timestamp, duration double, success boolean"


def write(frame, folder, name, *rows):
    df = frame(SCHEMA, *[(i, "op", s, START + timedelta(seconds=t), float(t), t % 3 != 0) for i, s, t in rows])
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(stream, base, mode="append"):
    sink = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/cp")
    query = sink.trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def test_late_rows_are_dropped_and_a_rerun_goes_on(spark, frame, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")

    def stream():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        return jobs.windowed_operation_metrics(source, "30 seconds", "1 minute")

    write(frame, folder, "a", (1, "s", 5), (2, "s", 10), (3, "s", 40))
    run(stream(), base)
    write(frame, folder, "b", (4, "s", 300))
    run(stream(), base)
    write(frame, folder, "c", (5, "s", 6), (6, "s", 1000))  # second 6 is long past the watermark
    got = run(stream(), base)
    counts = {int((r.window_start - START).total_seconds()): r.n for r in got.collect()}
    assert counts == {0: 2, 30: 1, 300: 1}


def test_mirror_fold_equals_one_pass(spark, frame, tmp_path):
    schema = "event_id long, mirror string, ts timestamp, healthy boolean, latency double, priority int, enabled boolean"
    pattern = [("a", True), ("a", False), ("b", False), ("a", False), ("b", True), ("b", False), ("c", True), ("b", False), ("a", False), ("d", False)]
    rows = [(i, m, START + timedelta(seconds=i), ok, float(i), 1, True) for i, (m, ok) in enumerate(pattern)]
    folder = str(tmp_path / "in")
    for at in range(0, len(rows), 3):
        frame(schema, *rows[at : at + 3]).coalesce(1).write.mode("append").parquet(folder)
    fold = jobs.MirrorFold(str(tmp_path / "state"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = source.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert last >= 3
    want = mirror_current_state(frame(schema, *rows))
    state = fold.latest(spark, last).select(want.columns)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, want.collect()))
    # a batch that is run again leaves the same state
    fold(frame(schema, *rows[9:]), last)
    assert sorted(map(tuple, fold.latest(spark, last).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_idle_keys(spark, frame, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")
    write(frame, folder, "a", (1, "s", 0), (2, "s", 60), (3, "t", 30))
    write(frame, folder, "b", (4, "t", 2000), (5, "s", 2100))
    source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/*")
    closed = run(jobs.idle_keys(source, "5 minutes", watermark="10 seconds"), base)
    assert sorted((r.source, r.n_events) for r in closed.collect()) == [("s", 2), ("t", 1)]
    table = spark.read.parquet(f"{folder}/*")
    assert sorted((r.source, r.n_events) for r in jobs.idle_keys(table, "5 minutes").collect()) == [("s", 1), ("s", 2), ("t", 1), ("t", 1)]
    assert [r.source for r in jobs.idle_at(table, START + timedelta(seconds=2350), timedelta(minutes=5)).collect()] == ["t"]


@pytest.mark.parametrize(
    "types,sources,components,active,want",
    [
        ([], [], [], True, [1, 2, 3]), (["x"], [], [], True, [1, 2]), (["x", "y", "x"], ["s"], [], True, [1, 3]), ([], [], ["c"], True, [1]),
        (["x"], ["s"], ["c", "d"], True, [1]), ([], [], [], False, []), (None, None, None, True, [1, 2, 3]),
    ],
)
def test_routes(frame, types, sources, components, active, want):
    events = frame("event_id int, type string, source string, component string", (1, "x", "s", "c"), (2, "x", "t", ""), (3, "y", "s", None))
    subs = frame("id int, types array<string>, sources array<string>, components array<string>, active boolean", (9, types, sources, components, active))
    assert sorted(r.event_id for r in jobs.route_events(events, subs).collect()) == want


def test_routes_join_by_equality(frame):
    events = frame("event_id int, type string, source string, component string", (1, "x", "s", "c"))
    subs = frame("id int, types array<string>, sources array<string>, components array<string>, active boolean", (9, ["x"], [], [], True))
    assert "NestedLoop" not in jobs.route_events(events, subs)._jdf.queryExecution().toString()


def test_routes_are_made_by_all_tasks(spark, frame):
    events = frame("event_id int, type string, source string, component string", *[(k, "x", "s", "c") for k in range(800)]).coalesce(1)
    subs = frame("id int, types array<string>, sources array<string>, components array<string>, active boolean", (9, ["x"], [], [], True), (8, [], [], [], True))
    task = F.spark_partition_id().alias("task")
    made = [r["count"] for r in jobs.route_events(events, subs.hint("broadcast")).groupBy(task).count().collect()]
    assert sum(made) == 1600 and len(made) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_routes_are_spelled_out_after_the_match(spark):
    """Only blocks of events and lists of subscribers are joined: a task that holds both sides has one row for many pairs."""
    events = spark.range(600).selectExpr("id as event_id", "concat('t', id % 3) as type", "'s' as source", "'' as component")
    subs = spark.range(2999).selectExpr("id * 7919 % 30011 as id", "if(id % 2 = 0, array(), array('t1', 't2')) as types", "cast(array() as array<string>) as sources", "cast(null as array<string>) as components", "true as active")
    routed = jobs.route_events(events, subs).select("event_id", "subscriber")
    assert routed.count() == routed.distinct().count() == 200 * 1500 + 400 * 2999
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("explode(__list") < plan.find("Join")


def test_routes_keep_equal_rows_and_nulls(frame):
    events = frame("event_id int, type string, source string, component string", *[(None, "x", None, None)] * 70, (2, None, "s", "c"))
    subs = frame("id int, types array<string>, sources array<string>, components array<string>, active boolean", *[(None, ["x"], [], None, True)] * 2, (3, None, [], [], True), (4, [], [], [], False))
    got = [(r.event_id, r.subscriber) for r in jobs.route_events(events, subs).collect()]
    assert sorted(got, key=str) == sorted([(None, None)] * 140 + [(None, 3)] * 70 + [(2, 3)], key=str)


def test_alerts_can_be_off(frame):
    df = frame("alloc_bytes long", (1,), (100,))
    assert jobs.threshold_alerts(df, 50).count() == 1
    assert jobs.threshold_alerts(df, 0).count() == 0


def test_metric_files(spark, tmp_path):
    texts = {
        "metrics-1.json": '{"timestamp": 20, "method": "binary", "success": true, "total_time": 1500, "download_size": 7, "cache_hit": true}',
        "metrics-2.json": '{\n "timestamp": 10,\n "method": "source"\n}',
        "metrics-3.json": '{"timestamp": ', "metrics-4.json": "[1]", "metrics-5.json": '{"timestamp": 30, "success": "odd"}', "other.json": '{"timestamp": 1}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = metric_files.read_metric_files(spark, str(tmp_path)).select(F.unix_seconds("ts").alias("t"), "method", "success", "total_time", "download_size", "cache_hit").collect()
    assert [tuple(r) for r in got] == [(10, "source", False, 0.0, 0, False), (20, "binary", True, 1.5, 7, True), (30, "", False, 0.0, 0, False)]


def test_cache_index(spark, tmp_path):
    (tmp_path / "a").write_text('{"metadata": {"key": "k", "timestamp": "2024-01-01T00:00:00Z", "expires": "2024-01-02T00:00:00Z"}, "data": {}}')
    (tmp_path / "b").write_text("{")
    (tmp_path / "c").write_text('{"metadata": {"timestamp": "2024-01-01T00:00:00Z"}}')
    (tmp_path / "d").write_text('{"metadata": {"key": "k"}}')
    got = metric_files.read_cache_index(spark, str(tmp_path))
    assert {r.file_path[-1]: r.problem for r in got.collect()} == {"a": None, "b": "invalid JSON structure", "c": "missing cache key", "d": "missing timestamp"}
    assert got.where("is_valid").first().size > 0


def test_source_tree(spark, tmp_path):
    for name in ("a.pl", "lib/B.PM", "t/c.t", "x.txt", "y.plx"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"file {name}\nend")
    got = text_trees.read_source_tree(spark, str(tmp_path))
    assert sorted(r.text.split("\n")[0] for r in got.collect()) == ["file a.pl", "file lib/B.PM", "file t/c.t"]


def test_lock_text(spark, frame, tmp_path):
    schema = "project string, interpreter string, dist string, pathname string, section string, module string, version string"
    rows = [
        ("p", "5.36.0", "Moose-2", "M/oose.tgz", "provides", "Moose", "2"), ("p", "5.36.0", "Moose-2", "M/oose.tgz", "provides", "Moose::Util", "2"),
        ("p", "5.36.0", "Moose-2", "M/oose.tgz", "requirements", "Carp", "0"), ("p", "5.36.0", "Bare-1", "B/are.tgz", None, None, None), ("q", None, "Z-1", "Z.tgz", "provides", "Z", "1"),
    ]
    path = str(tmp_path / "locks")
    text_trees.write_lock_text(text_trees.lock_lines(frame(schema, *rows), "2024-01-01 00:00:00"), path)
    texts = {r.project: r.text for r in text_trees.read_lock_text(spark, path).collect()}
    assert texts["q"].splitlines() == ["# carton snapshot format v1.0", "# Generated on 2024-01-01 00:00:00", "DISTRIBUTIONS", "  Z-1", "    pathname: Z.tgz", "    provides:", "      Z 1", ""]
    assert texts["p"].splitlines()[2:8] == ["# Perl version: 5.36.0", "DISTRIBUTIONS", "  Bare-1", "    pathname: B/are.tgz", "", "  Moose-2"]
    from supplyscope.operators.corpus import parse_lockfiles

    again = parse_lockfiles(text_trees.read_lock_text(spark, path), key="project")
    assert sorted(map(str, again.collect())) == sorted(map(str, frame(schema, *rows).select(again.columns).collect()))


CHECKS = "event_id long, mirror string, ts timestamp, healthy boolean, latency double, priority int, enabled boolean"


def checks_of(*rows):
    return [(i, m, None if t is None else START + timedelta(seconds=t), ok, float(i), 1, True) for i, (m, t, ok) in enumerate(rows)]


def states(df, columns):
    return sorted(map(str, df.select(columns).collect()))


def test_mirror_fold_takes_late_checks(spark, frame, tmp_path):
    import random

    rng = random.Random(2)
    rows = checks_of(*[(rng.choice(["a", "b", None]), t + rng.choice([0, 0, -15]), rng.random() < 0.4) for t in range(20, 200)])
    fold = jobs.MirrorFold(str(tmp_path / "state"), timedelta(seconds=30), compact_every=2)
    batches = [rows[k : k + 20] for k in range(0, len(rows), 20)]
    for n, batch in enumerate(batches):
        fold(frame(CHECKS, *batch), n)
        want = mirror_current_state(frame(CHECKS, *rows[: 20 * (n + 1)]))
        assert states(fold.latest(spark, n), want.columns) == states(want, want.columns), n
        if n in (3, 4):  # a batch that is run again, with and without a new base
            fold(frame(CHECKS, *batch), n)
            assert states(fold.latest(spark, n), want.columns) == states(want, want.columns)
    assert fold.late(spark).count() == 0
    # folders are used in turn, whatever the number of batches
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["base-0", "base-1", *[f"batch-{k:04d}" for k in range(4)], "late"]


def test_mirror_fold_keeps_what_comes_too_late(spark, frame, tmp_path):
    rows = checks_of(("a", 0, True), ("a", 100, False), ("a", 50, True), ("a", None, False), ("a", 80, False), ("b", 100, False))
    fold = jobs.MirrorFold(str(tmp_path / "state"), timedelta(seconds=30))
    fold(frame(CHECKS, *rows[:2]), 0)
    fold(frame(CHECKS, *rows[2:]), 1)
    assert sorted((r.event_id, r.batch) for r in fold.late(spark).collect()) == [(2, 1), (3, 1)]
    got = {r.mirror: (r.consecutive_failures, r.total_failures) for r in fold.latest(spark, 1).collect()}
    assert got == {"a": (2, 2), "b": (1, 1)}


@pytest.mark.parametrize("max_rows", [7, 1000])
def test_idle_sessions_are_session_windows(spark, frame, max_rows):
    import random

    rng = random.Random(4)
    rows = [(k, "op", rng.choice(["hot", "hot", "hot", "x", None]), START + timedelta(seconds=rng.randrange(3000)), 1.0, True) for k in range(150)]
    rows += [(200, "op", "x", None, 1.0, True), (201, "op", "hot", START, 1.0, True), (202, "op", "edge", START, 1.0, True), (203, "op", "edge", START + timedelta(seconds=60), 1.0, True)]
    events = frame(SCHEMA, *rows)
    got = jobs.idle_sessions(events, timedelta(seconds=60), max_rows=max_rows)
    want = jobs.idle_keys(events, "60 seconds")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_documents_by_line(spark, tmp_path):
    (tmp_path / "metrics-1.json").write_text('{"timestamp": 20, "method": "a"}\n\n{"timestamp": \n[1]\n{"timestamp": 10}\n')
    (tmp_path / "metrics-2.json").write_text('{"timestamp": 30}')
    read = metric_files.read_metric_files(spark, str(tmp_path), lines=True).select(F.unix_seconds("ts").alias("t"), "method").collect()
    assert [tuple(r) for r in read] == [(10, ""), (20, "a"), (30, "")]
    bad = metric_files.bad_metric_records(spark, str(tmp_path), lines=True).collect()
    assert sorted((r.file_path[-14:], r.record) for r in bad) == [("metrics-1.json", "[1]"), ("metrics-1.json", '{"timestamp": ')]
    (tmp_path / "index").write_text('{"metadata": {"key": "k", "timestamp": "2024-01-01T00:00:00Z"}}\n{')
    got = metric_files.read_cache_index(spark, str(tmp_path), "index", lines=True).collect()
    assert sorted((r.entry_key or "", r.problem or "", r["size"]) for r in got) == [("", "invalid JSON structure", 1), ("k", "", 63)]


def test_many_texts_in_a_file(spark, tmp_path):
    (tmp_path / "a.pl").write_text("one\ntwo\x1ethree\x1e")
    assert [r.text for r in text_trees.read_source_tree(spark, str(tmp_path), text_end="\x1e").collect()] == ["one\ntwo", "three"]
