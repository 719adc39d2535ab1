import pytest
from pyspark.sql import functions as F

from supplyscope.operators import settings as ops


def test_layers(frame):
    rows = frame(
        "layer string, setting_key string, val string, kind string",
        ("default", "a", "d", "string"), ("user", "a", "u", "string"), ("project", "a", "", "string"), ("system", "b", "s", "string"),
        ("default", "n", "4", "int"), ("user", "n", "0", "int"), ("default", "flag", "true", "bool"), ("project", "flag", "false", "bool"), ("nowhere", "a", "x", "string"),
    )
    got = {r.setting_key: (r.val, r.source) for r in ops.merge_layers(rows, kind="kind").collect()}
    assert got == {"a": ("u", "user"), "b": ("s", "system"), "n": ("4", "default"), "flag": ("false", "project")}
    assert [r[0] for r in ops.merge_layers(rows, empty_overrides=True).where("setting_key = 'a'").select("val").collect()] == [""]


def test_arrays(frame):
    rows = frame("layer string, setting_key string, vals array<string>", ("default", "k", ["a", "b"]), ("user", "k", ["b", "c"]), ("project", "k", None), ("user", "e", []))
    assert {r.setting_key: r.vals for r in ops.merge_array_layers(rows).collect()} == {"k": ["b", "c"], "e": []}
    assert {r.setting_key: r.vals for r in ops.merge_array_layers(rows, append=True).collect()} == {"k": ["a", "b", "c"], "e": []}


def test_conflicts_and_diff(frame):
    schema = "layer string, setting_key string, val string, kind string"
    rows = frame(
        schema, ("user", "a", "1", "string"), ("project", "a", "2", "string"), ("user", "b", "", "string"), ("project", "b", "2", "string"),
        ("user", "n", "0", "int"), ("project", "n", "5", "int"), ("user", "f", "true", "bool"), ("project", "f", "false", "bool"),
    )
    got = sorted((r.setting_key, r.target_value, r.source_value) for r in ops.layer_conflicts(rows, "user", "project", kind="kind").collect())
    assert got == [("a", "1", "2"), ("f", "true", "false")]
    a = frame("k string, v string", ("same", "1"), ("gone", "1"), ("nulls", None), ("to_null", "1"))
    b = frame("k string, v string", ("same", "1"), ("new", None), ("nulls", None), ("to_null", None))
    assert sorted((r.k, r.change) for r in ops.diff_tables(a, b, ["k"], "v").collect()) == [("gone", "removed"), ("new", "added"), ("to_null", "changed")]


VARIABLES = {
    "HOME": "/h", "A": "${B}", "B": "b", "LOOP": "x${LOOP2}", "LOOP2": "${LOOP}", "EMPTY": "", **{f"D{i}": f"${{D{i + 1}}}" for i in range(14)},
}


TEMPLATES = [
    ("plain", "plain"), ("${HOME}/x", "/h/x"), ("${ HOME }", "/h"), ("${A}${A}", "bb"), ("${NO}", ""), ("${NO:-d}", "d"), ("${NO:-${A}}", "b"), ("${EMPTY:-e}", "e"),
    ("${NO:-a{b}c}", "a{b}c"), ("${open", "${open"), ("${LOOP}", None), ("${HOME:-${LOOP}}", "/h"), ("${D0}", None), ("${D5}", ""), ("$HOME {x}", "$HOME {x}"),
    ("", ""), ("${}", ""), ("${LOOP:-x} ${NO", None), ("${NO:-${LOOP}}", None), ("${NO:-${NO}}", None), ("${NO:-}x", "x"), ("${open ${A}", "${open ${A}"),
    ("${A}${NO:-{${HOME}}}\n${ A :-x:-y}${B", "b{/h}\nb${B"), ("${NO:-a:-b}", "a:-b"), ("}{${A}}{", "}{b}{"), ("${A}" * 3000, "b" * 3000), ("${NO:-" + "${NO2:-" + "v" + "}}", "v"),
]


def test_templates(spark):
    variables = spark.createDataFrame(list(VARIABLES.items()), "name string, value string")
    df = spark.createDataFrame([(k, text) for text, _ in TEMPLATES for k in (1, 2)], "id int, t string")
    got = ops.expand_templates(df, "t", variables).collect()
    assert len(got) == 2 * len(TEMPLATES)
    assert {r.t: r.expanded for r in got} == dict(TEMPLATES)
    assert all((r.error is None) == (r.expanded is not None) for r in got)


def test_template_errors(spark, frame):
    variables = spark.createDataFrame([*VARIABLES.items(), (None, "x")], "name string, value string")
    df = frame("t string", ("${D0}",), ("a${NO:-${LOOP}}${D0}",), ("${D0}${LOOP}",), (None,))
    got = {r.t: r.error for r in ops.expand_templates(df, "t", variables).collect()}
    circle = "circular reference: LOOP"
    assert got == {"${D0}": "depth exceeded", "a${NO:-${LOOP}}${D0}": circle, "${D0}${LOOP}": "depth exceeded", None: None}
    assert ops.expand_templates(df.limit(0), "t", variables).count() == 0


def test_masking(frame):
    df = frame("name string, value string", ("db_password", "short"), ("ApiKey", "123456789"), ("home", "123456789"), ("TOKEN", None))
    assert [r.value for r in ops.mask_sensitive(df).collect()] == ["***", "12***89", "123456789", None]


def test_validation(frame):
    rules = frame(
        "key string, required boolean, type string, allowed array<string>, min double, max double, pattern string",
        ("url", True, "string", None, None, None, "url"), ("jobs", True, "int", None, 1.0, 8.0, None), ("mode", False, "string", ["a", "b"], None, None, None),
        ("wait", False, "duration", None, 1.0, 60.0, None), ("on", False, "bool", None, None, None, None), ("ver", False, "string", None, None, None, "version"), ("dir", False, "string", None, None, None, "path"),
    )
    good = [("url", "https://x"), ("jobs", "8"), ("mode", "a"), ("wait", "1m"), ("on", "true"), ("ver", "5.36"), ("dir", "/x")]
    bad = [("jobs", "9"), ("mode", "c"), ("wait", "500ms"), ("on", "yes"), ("ver", "5"), ("dir", "rel"), ("other", "?")]
    rows = frame("entity int, key string, val string", *[(1, *r) for r in good], *[(2, *r) for r in bad], (3, "jobs", "many"), (3, "wait", "2h"), (3, "dir", "C:\\x"))
    got = sorted((r.entity, r.key, r.violation) for r in ops.validate_rows(rows, rules).collect())
    assert got == [
        (2, "dir", "pattern"), (2, "jobs", "max"), (2, "mode", "allowed"), (2, "on", "type"), (2, "url", "required"), (2, "ver", "pattern"), (2, "wait", "min"),
        (3, "jobs", "type"), (3, "url", "required"), (3, "wait", "max"),
    ]


def test_precedence_and_named_records(frame):
    c = frame("entity int, source string, value string", (1, "env", ""), (1, "file", "f"), (1, "user", "u"), (2, "other", "x"))
    assert [tuple(r) for r in ops.resolve_precedence(c, ["env", "file", "user"]).collect()] == [(1, "f", "file")]
    merged = ops.merge_named_records(frame("name string, url string", ("a", "1"), ("b", "1")), frame("name string, url string", ("b", "2"), ("c", "2")))
    assert sorted(map(tuple, merged.select("name", F.col("url")).collect())) == [("a", "1"), ("b", "2"), ("c", "2")]


def expand_plain(text, values, max_depth, path=()):
    """Plain recursion: (text, None) or (None, leftmost error)."""
    import re

    if len(path) > max_depth:
        return None, "depth exceeded"
    out = []
    for literal, name, _, default in re.findall(r"([^$]+)|\$\{(\w+)(:-((?:[^{}]|\{[^{}]*\})*))?\}", text):
        if not name:
            out.append(literal)
            continue
        if name in path:
            return None, f"circular reference: {name}"
        inner, error = expand_plain(values.get(name) or default, values, max_depth, (*path, name))
        if error:
            return None, error
        out.append(inner)
    return "".join(out), None


def test_templates_match_recursion(spark):
    import random

    rng = random.Random(6)
    names = [f"V{k}" for k in range(12)]

    def text(low):
        parts = [rng.choice(["a", "/", "x y"])]
        for _ in range(rng.randrange(0, 4)):
            name = rng.choice(names[low:] + ["U1", "U2"])
            parts.append(rng.choice(["${%s}", "${%s:-d}", "${%s:-<${V11}>}", "${%s:-${U2:-u}}"]) % name)
        return "".join(parts)

    values = {n: text(k + 1) for k, n in enumerate(names)}
    values |= {"V5": "${V9}${V3}", "V8": ""}  # V3 may lead back to V5
    templates = sorted({text(0) for _ in range(60)})
    variables = spark.createDataFrame(list(values.items()), "name string, value string")
    df = spark.createDataFrame([(t,) for t in templates], "t string")
    for depth in (10, 2):
        got = {r.t: (r.expanded, r.error) for r in ops.expand_templates(df, "t", variables, depth).collect()}
        assert got == {t: expand_plain(t, values, depth) for t in templates}


def test_nested_values_are_made_once(spark, monkeypatch):
    values = [(f"x{k}", f"${{x{k + 1}}}${{x{k + 1}}}") for k in range(9)] + [("x9", "ab")]
    variables = spark.createDataFrame(values, "name string, value string")
    df = spark.createDataFrame([("${x0}",), ("${x5}!${x7}",), ("plain",)], "t string")
    monkeypatch.setattr(ops, "_walked", None)
    got = {r.t: (r.expanded, r.error) for r in ops.expand_templates(df, "t", variables).collect()}
    assert got == {"${x0}": ("ab" * 512, None), "${x5}!${x7}": ("ab" * 16 + "!" + "ab" * 4, None), "plain": ("plain", None)}
    got = {r.t: (r.expanded, r.error) for r in ops.expand_templates(df, "t", variables, max_text=100).collect()}
    assert got == {"${x0}": (None, "expansion too long"), "${x5}!${x7}": ("ab" * 16 + "!" + "ab" * 4, None), "plain": ("plain", None)}
