"""Ordered work and hot keys: the sliced and the salted way give the rows of the plain way."""

from pyspark.sql import functions as F

from supplyscope.plans import ordered
from supplyscope.plans.skew import spread_join


def hot(spark, n=3000):
    """Group 0 holds most rows, one group key is null."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, F.col("id") % 5).alias("g"),
        (F.col("id") * 7919 % n).alias("at"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def both(spark, work):
    df = hot(spark)
    plain, sliced = work(df, 10**9), work(df, 100)
    assert rows(plain.select(sorted(plain.columns))) == rows(sliced.select(sorted(plain.columns)))
    assert plain.count() == df.count()


def test_rank_descending(spark):
    both(spark, lambda df, n: ordered.rank_in_group(df, ["g"], [F.col("at").desc()], "r", n))


def test_rank_without_group(spark):
    both(spark, lambda df, n: ordered.rank_in_group(df, [], ["at"], "r", n))


def test_running_sum(spark):
    both(spark, lambda df, n: ordered.running_sum(df, ["g"], ["at"], F.col("v"), "s", n))


def test_carry_forward(spark):
    values = {"a": F.col("v"), "b": F.when(F.col("at") % 50 == 0, F.struct("at", "v"))}
    both(spark, lambda df, n: ordered.carry_forward(df, ["g"], ["at"], values, n))


def test_previous_value(spark):
    both(spark, lambda df, n: ordered.previous_value(df, ["g"], ["at"], F.col("v"), "p", n))


def test_first_in_group_beyond_the_limit_of_partial_top_n(spark):
    df = hot(spark)
    kept = ordered.first_in_group(df, ["g"], [F.col("at").desc()], 1500)
    assert kept.where("g = 0").count() == 1500


def test_first_in_group_cuts_before_the_shuffle(spark):
    plan = ordered.first_in_group(hot(spark), ["g"], ["at"], 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_first_in_group_in_parts(spark):
    df = hot(spark)
    got = ordered.first_in_group(df, ["g"], [F.col("at").desc()], 200)
    ranked = ordered.rank_in_group(df, ["g"], [F.col("at").desc()], "r").where("r <= 200").drop("r")
    assert rows(got) == rows(ranked)


def test_results_do_not_depend_on_partitions(spark, frame):
    from supplyscope.operators.telemetry import evict_by_size, mirror_current_state
    from supplyscope.operators.versions import best_match, rank_versions

    versions = spark.range(400).select(
        F.concat(F.lit("p"), F.col("id") % 3).alias("package"), F.concat_ws(".", F.col("id") % 5, F.col("id") % 7, F.col("id") % 11).alias("version"), "id"
    )
    checks = spark.range(400).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("mirror"), F.timestamp_seconds(F.col("id") * 37 % 400).alias("ts"),
        (F.col("id") % 5 > 1).alias("healthy"), F.col("id").cast("double").alias("latency"), F.lit(1).alias("priority"), F.lit(True).alias("enabled"),
    )
    entries = checks.select(F.col("event_id").alias("entry_key"), F.col("mirror").alias("pool"), F.lit(1).alias("size"), F.col("ts").alias("last_accessed"))
    asked = versions.select("package", F.concat(F.lit("< "), "version").alias("constraint"), "id")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions, seed in ((1, 1), (4, 2), (64, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            mixed = [df.orderBy(F.xxhash64(*df.columns, F.lit(seed))) for df in (versions, checks, entries, asked)]
            results.append(
                [
                    rows(rank_versions(mixed[0], tie=["id"], max_rows=50).select("id", "ver_rank")),
                    rows(mirror_current_state(mixed[1], hot_rows=50)),
                    rows(evict_by_size(mixed[2], 40, max_rows=50)),
                    rows(best_match(mixed[3], mixed[0], max_rows=50)),
                ]
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_spread_join(spark):
    facts = hot(spark).where("g is not null")
    lookup = spark.range(4).select(F.col("id").alias("g"), (F.col("id") * 10).alias("x"))
    for how in ("left", "inner"):
        assert rows(spread_join(facts, lookup, ["g"], how, 100)) == rows(facts.join(lookup, ["g"], how))


def test_spread_join_splits_the_hot_key(spark):
    facts = hot(spark).where("g is not null")
    lookup = spark.range(4).select(F.col("id").alias("g"))
    plan = spread_join(facts, lookup, ["g"], "inner", 100)._jdf.queryExecution().toString()
    assert "__salt" in plan


def test_shared_folder_follows_the_session(spark):
    from supplyscope.plans import shared

    before = shared.shared_folder(spark)
    spark.conf.set("spark.some.other", "1")
    assert shared.shared_folder(spark) == before


def test_rounds_are_not_broadcast(spark, frame, monkeypatch):
    from supplyscope.operators.graph import _sets_of_core
    from supplyscope.operators.reachability import subtree_sizes
    from supplyscope.plans.doubling import follow
    from supplyscope.plans.shared import Stage, settle

    edges = settle(frame("src long, dst long", (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 5)))
    tree = settle(frame("node long, up long", (1, None), (2, 1), (3, 2), (4, 2)))
    links = settle(frame("node long, next long, n long", (1, 2, 1), (2, 3, 1), (3, None, 1)))
    plans, add = [], Stage.add
    monkeypatch.setattr(Stage, "add", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), add(self, df))[1])
    sets = sorted(map(tuple, _sets_of_core(edges).groupBy("set").agg({"node": "count"}).select("count(node)").collect()))
    sizes = sorted((r.node, r.size) for r in subtree_sizes(tree).collect())
    ended, _ = follow(links, {"n": lambda first, rest: first["n"] + rest["n"]})
    assert (sets, sizes, sorted((r.node, r.n) for r in ended.collect())) == ([(2,), (3,)], [(1, 4), (2, 3), (3, 1), (4, 1)], [(1, 3), (2, 2), (3, 1)])
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
