import pytest
from pyspark.sql import functions as F

from supplyscope.functions.version_keys import constraint_bounds, dotted_key, semver_key, triple_key, unpack_version
from supplyscope.operators import versions as ops

SEMVER_ASCENDING = [
    "0.9.9", "1.0.0-1", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.2", "1.0.0-alpha.10", "1.0.0-alpha.beta",
    "1.0.0-beta", "v1.0.0-rc.1", "1.0.0", "1.0.1", "1.2", "v2", "10.0.0",
]


def test_semver_order(spark):
    df = spark.createDataFrame([(v,) for v in reversed(SEMVER_ASCENDING)], "v string")
    assert [r.v for r in df.orderBy(semver_key(F.col("v"))).collect()] == SEMVER_ASCENDING


@pytest.mark.parametrize("text", ["", "abc", "1.2.3.4", "1..2", None, "99999999999999999999.0.0"])
def test_no_semver(spark, text):
    assert spark.createDataFrame([(text,)], "v string").select(semver_key(F.col("v"))).first()[0] is None


def test_build_metadata_does_not_order(spark):
    row = spark.sql("select '1.0.0+a' a, '1.0.0+b' b").select(semver_key(F.col("a")) == semver_key(F.col("b"))).first()
    assert row[0]


@pytest.mark.parametrize(
    "a,b,sign",
    [("1.0", "1", 0), ("1.10", "1.9", 1), ("v1.2", "1.2", 0), ("1.2_03", "1.2", 0), ("x.1", "0.1", 0), ("1.0.1", "1", 1), ("0.9", "1", -1)],
)
def test_dotted_order(spark, a, b, sign):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = dotted_key(F.col("a")), dotted_key(F.col("b"))
    got = df.select(F.when(x > y, 1).when(x < y, -1).otherwise(0)).first()[0]
    assert got == sign


@pytest.mark.parametrize(
    "text,want",
    [("5.32.1", (5, 32, 1)), (" perl-5.32 ", (5, 32, 0)), ("v5.32.0-RC1", (5, 32, 0)), ("5.32.1_01", (5, 32, 1)), ("5.32-RC1", None), ("5", None), ("5.1.2.3", None)],
)
def test_triple(spark, text, want):
    got = spark.createDataFrame([(text,)], "v string").select(triple_key(F.col("v"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_unpack(spark):
    df = spark.createDataFrame([("5.042000",), ("5.008009",), ("5.36.1",)], "v string")
    assert [r[0] for r in df.select(unpack_version(F.col("v"))).collect()] == ["5.42.0", "5.8.9", "5.36.1"]


AVAILABLE = ["5.30.0", "5.32.0", "5.32.1", "5.34.0", "5.36.0-RC1", "5.36.0", "junk"]


@pytest.mark.parametrize(
    "constraint,best",
    [
        (">= 5.32.0", "5.36.0"), ("> 5.34.0", "5.36.0"), ("< 5.32.0", "5.30.0"), ("<=5.32.1", "5.32.1"), ("5.32", "5.32.0"), ("== 5.34.0", "5.34.0"),
        ("~> 5.32.0", "5.32.1"), ("~> 5.32.1", "5.32.1"), (">= 5.31, < 5.34", "5.32.1"), ("> 5.36.0", None), (">= 5.34, < 5.33", None), ("nonsense", None),
        (">= 5.30, junk", None), ("", "5.36.0"), (", ,", "5.36.0"), (">5.30.0,<5.32.0", None),
    ],
)
def test_best_match(frame, constraint, best):
    asked = frame("package string, constraint string", ("p", constraint), ("q", constraint))
    have = frame("package string, version string", *[("p", v) for v in AVAILABLE])
    for limit in (10**9, 2):
        got = {r.package: (r.best, r.satisfiable) for r in ops.best_match(asked, have, max_rows=limit).collect()}
        assert got == {"p": (best, best is not None), "q": (None, False)}


def test_bounds_of_a_broken_piece_are_null(frame):
    row = frame("c string", (">= x",)).select(constraint_bounds(F.col("c"))).first()
    assert row[0] is None


def test_rank_puts_unparsed_last_and_breaks_ties_by_text(frame):
    df = frame("package string, version string", *[("p", v) for v in ("1.0.0", "zzz", "1.0", "2.0.0-rc.1", "aaa")])
    for limit in (10**9, 2):
        ranked = {r.version: r.ver_rank for r in ops.rank_versions(df, max_rows=limit).collect()}
        assert ranked == {"2.0.0-rc.1": 1, "1.0": 2, "1.0.0": 3, "aaa": 4, "zzz": 5}


def test_outdated(frame):
    have = frame("project int, package string, version string", (1, "A", "1.0"), (1, "A", "1.2"), (1, "B", "2.0"), (1, "C", "1.0"), (2, "A", "1.10"))
    index = frame("package string, version string", ("A", "1.9"), ("A", "1.3"), ("B", "2"))
    assert [tuple(r) for r in ops.outdated_packages(have, index).collect()] == [(1, "A", "1.2", "1.9")]


def test_missing_and_status(frame):
    reqs = frame("project int, package string, c string", (1, "perl", "5"), (1, "A", ">= 2.0"), (1, "B", ">= 1.0"), (2, "perl", "5"))
    have = frame("project int, package string, version string", (1, "A", "1.5.0"))
    assert [r.package for r in ops.missing_requirements(reqs, have).collect()] == ["B"]
    assert sorted(r.package for r in ops.missing_requirements(reqs, have, constraint="c").collect()) == ["A", "B"]
    assert sorted(map(tuple, ops.requirement_status(reqs, have).collect())) == [(1, 1, False), (2, 0, True)]


def test_tags(frame):
    tags = ["v5.40.2", "v5.40.2-1", "v5.38.0-RC2", "my-fork-5.40.2", "v5.40-RC1", "blead", "5.40.0", "v5.36"]
    got = {r.tag: (r.version, r.fork, r.release_no, r.display) for r in ops.classify_tags(frame("remote string, tag string", *[("up", t) for t in tags])).collect()}
    assert got == {
        "v5.40.2": ("5.40.2", "", None, "up/5.40.2"),
        "v5.40.2-1": ("5.40.2", "", 1, "up/5.40.2"),
        "v5.38.0-RC2": ("5.38.0", "", None, "up/5.38.0"),
        "my-fork-5.40.2": ("5.40.2", "my-fork", None, "up/my-fork-5.40.2"),
        "v5.36": ("5.36.0", "", None, "up/5.36.0"),
    }


def test_status_tells_invalid_from_unsatisfiable(frame):
    requests = frame("package string, constraint string", ("a", ">= 1.0.0"), ("a", ">= 9.0.0"), ("a", ">= nonsense"), ("a", None), ("b", "== 1.0.0"))
    matched = ops.best_match(requests, frame("package string, version string", ("a", "1.2.0")))
    got = {(r.package, r["constraint"]): r.status for r in ops.match_status(matched).collect()}
    assert got == {("a", ">= 1.0.0"): "matched", ("a", ">= 9.0.0"): "unsatisfiable", ("a", ">= nonsense"): "invalid", ("a", None): "invalid", ("b", "== 1.0.0"): "unsatisfiable"}


def test_aliases(frame):
    names = frame("name string", *[(n,) for n in ("stable", "@latest", "@dev", "latest-dev", "work", "@work", "@nope", "5.1.0", "system", "stable", None)])
    aliases = frame("name string, version string", ("work", "5.30.0"), ("dev", "5.99.9"))
    releases = frame("version string", ("5.36.0",), ("5.37.2",), ("5.36.10",), ("odd",))
    got = {r.name: (r.version, r.error) for r in ops.resolve_aliases(names, aliases, releases).collect()}
    assert got == {
        "stable": ("5.36.10", None), "@latest": ("5.36.10", None), "@dev": ("5.99.9", None), "latest-dev": ("5.37.2", None), "work": ("5.30.0", None),
        "@work": ("5.30.0", None), "@nope": (None, "unknown version alias: @nope"), "5.1.0": ("5.1.0", None), "system": (None, "no version for system"),
    }
