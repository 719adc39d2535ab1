"""Inputs on which results once depended on size, partitions or a magic word."""

import pytest

from supplyscope.functions.version_keys import triple_key
from supplyscope.operators import corpus, index, settings, telemetry
from supplyscope.sources import text_trees
from supplyscope.streaming import jobs


def test_entity_with_only_null_values_misses_its_required_keys(frame):
    rows = frame("entity string, key string, val string", ("e1", "a", None), ("e1", "b", None), ("e2", "a", "x"))
    rule = "key string, required boolean, type string, allowed array<string>, min long, max long, pattern string"
    rules = frame(rule, ("a", True, "string", None, None, None, None), ("b", True, "string", None, None, None, None))
    found = {(r["entity"], r["key"]) for r in settings.validate_rows(rows, rules).where("violation = 'required'").collect()}
    assert found == {("e1", "a"), ("e1", "b"), ("e2", "b")}


def test_a_star_is_an_ordinary_value(frame):
    events = frame("event_id int, type string, source string, component string", (1, "a", "s", "*"), (2, "*", "s", ""))
    lists = "id string, types array<string>, sources array<string>, components array<string>, active boolean"
    asks = frame(lists, ("all", [], [], [], True), ("star", ["*"], [], [], True))
    routed = sorted((r["event_id"], r["subscriber"]) for r in jobs.route_events(events, asks).collect())
    assert routed == [(1, "all"), (2, "all"), (2, "star")]


def test_a_number_too_long_for_a_bigint_is_no_version(frame):
    got = frame("v string", ("5.99999999999999999999.1",), ("5.3.1",)).select(triple_key(triple_col()).alias("k")).collect()
    assert got[0]["k"] is None and tuple(got[1]["k"]) == (5, 3, 1)


def triple_col():
    from pyspark.sql import functions as F

    return F.col("v")


def test_two_missing_modules_are_two_failures_and_lines_outside_failures_count(frame):
    lines = ["# Testing t/1.t", "Can't locate A.pm in @INC", "Can't locate B.pm in @INC", "Compilation failed x", "Compilation failed y",
             "# Can't locate C.pm in @INC", "not ok 1 - n", "# one", "# two", "# Testing t/2.t", "# Result: FAIL"]
    log = frame("run int, line_no long, line string", *[(1, k, x) for k, x in enumerate(lines)])
    classed = corpus.tap_lines(log)
    failures = corpus.tap_failures(classed)
    assert sorted(r["failure_line"] for r in failures.collect()) == [1, 2, 3, 5, 6]
    assert [r["text"] for r in corpus.tap_failure_lines(classed).orderBy("line_no").collect()] == ["one", "two"]
    assert corpus.tap_results(classed, failures).first()["summary"] == "5 tests failed"


@pytest.mark.parametrize("max_rows", [2, 10_000])
def test_running_sums_of_doubles_do_not_depend_on_the_cut(frame, max_rows):
    sizes = [1e16, 0.1, 0.2, -1e16, 0.3, 0.1, 0.2]
    rows = [(1, k, k, v) for k, v in enumerate(sizes)]
    entries = frame("pool int, entry_key int, last_accessed int, size double", *rows)
    # newest first: 0.2, 0.3, 0.6, -1e16 + 0.6, -1e16 + 0.8, -1e16 + 0.9, 0.9
    gone = telemetry.evict_by_size(entries, 0.55, max_rows=max_rows)
    assert sorted(r["entry_key"] for r in gone.collect()) == [0, 4]


def test_search_limit_is_the_callers(spark):
    rows = spark.range(300).selectExpr(
        "concat('n', id) as name", "'1' as version", "'d' as distribution", "'a' as author", "'' as abstract", "id as score", "'latest' as status",
        "'' as documentation", "timestamp '2024-01-01' as date",
    )
    assert index.search_packages(rows, "n", 250).count() == 250


@pytest.mark.parametrize("parts", ["1", "4", "64"])
def test_lock_text_survives_any_number_of_files(spark, frame, tmp_path, parts):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        modules = spark.range(600).selectExpr(
            "'p' as project", "'5.36' as interpreter", "concat('D-', lpad(id div 5, 4, '0')) as dist", "'A/B.tgz' as pathname",
            "'provides' as section", "concat('M', id) as module", "'1' as version",
        )
        text_trees.write_lock_text(text_trees.lock_lines(modules, "2024-01-01 00:00:00"), str(tmp_path / "lock"))
        again = corpus.parse_lockfiles(text_trees.read_lock_text(spark, str(tmp_path / "lock")), key="project")
        assert sorted(map(tuple, again.select("interpreter", "dist", "module").collect())) == sorted(map(tuple, modules.select("interpreter", "dist", "module").collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
