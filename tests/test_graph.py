from pyspark.sql import functions as F

from supplyscope.operators import graph as ops


def closure(df):
    return {(r.root, r.pkg): r.depth for r in df.collect()}


def test_closure_ends_on_cycles(frame):
    edges = frame("src string, dst string", ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    got = closure(ops.transitive_closure(edges, roots=frame("root string", ("a",))))
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3}


def test_closure_switches(frame):
    edges = frame("src string, dst string, phase string", ("a", "b", "runtime"), ("a", "t", "test"), ("b", "c", "runtime"), ("c", "d", "runtime"))
    roots = frame("root string", ("a",))
    got = ops.transitive_closure(edges, roots, phases=["runtime"], core=frame("pkg string", ("c",)))
    assert closure(got) == {("a", "a"): 0, ("a", "b"): 1}
    assert set(closure(ops.transitive_closure(edges, roots, max_depth=1))) == {("a", "a"), ("a", "b"), ("a", "t")}


def test_closure_matches_brute_force(spark):
    pairs = [(i, (i * i + 3 * k) % 40) for i in range(40) for k in range(2)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    out = {}
    for s, d in pairs:
        out.setdefault(s, set()).add(d)
    want = {}
    for root in out:
        front, depth = {root}, 0
        while front:
            for n in front:
                want[(root, n)] = depth
            depth += 1
            front = {d for n in front for d in out.get(n, ())} - {n for r, n in want if r == root}
    assert closure(ops.transitive_closure(edges)) == want


def nearest(pairs, keep=lambda e: True):
    """{(root, pkg): (depth, least label of a last edge)} by breadth first."""
    out, want = {}, {}
    for s, d, label in pairs:
        if keep((s, d, label)):
            out.setdefault(s, []).append((d, label))
    for root in out:
        front, depth = {root: None}, 0
        while front:
            want.update({(root, n): (depth, label) for n, label in front.items()})
            depth += 1
            ways = [(d, label) for n in front for d, label in out.get(n, ()) if (root, d) not in want]
            front = {d: min((x for n, x in ways if n == d), key=lambda x: (x is not None, x)) for d, _ in ways}
    return want


def test_closures_of_all_roots_as_breadth_first(spark, monkeypatch):
    """With cycles, edges to oneself, repeated edges, null labels, and more levels than are closed from below."""
    import random

    rng = random.Random(3)
    down = [(n, rng.randrange(n), rng.choice(["x", "y", None])) for n in range(1, 60) for _ in range(rng.randrange(4))]
    loose = [(100 + rng.randrange(20), 100 + rng.randrange(20), rng.choice("abc")) for _ in range(30)]
    mixed = [(130 + k, rng.randrange(60), "z") for k in range(5)] + [(7, 7, "a"), (100, 3, "q"), (3, 2, "w")] + [(200, 200, "a")]
    pairs = down + loose + mixed
    edges = spark.createDataFrame(pairs, "src long, dst long, label string")
    for levels in (64, 3):
        monkeypatch.setattr(ops, "LEVELS", levels)
        rows = ops.transitive_closure(edges, labels=["label"]).collect()
        got = {(r.root, r.pkg): (r.depth, r.label) for r in rows}
        assert got == nearest(pairs) and len(rows) == len(got)
        plain = ops.transitive_closure(edges).collect()
        assert {(r.root, r.pkg): r.depth for r in plain} == {k: d for k, (d, _) in got.items()} and len(plain) == len(got)


def test_closures_do_not_look_up_known_rows(frame, monkeypatch):
    def refuse(*_):
        raise AssertionError("known rows are read again")

    monkeypatch.setattr(ops, "keep_unseen", refuse)
    edges = frame("src long, dst long", *[(n, n // k) for n in range(1, 40) for k in (2, 3) if n >= k])
    assert closure(ops.transitive_closure(edges)) == {k: d for k, (d, _) in nearest([(n, n // k, "") for n in range(1, 40) for k in (2, 3) if n >= k]).items()}


def test_closures_with_null_ends(frame):
    edges = frame("src string, dst string", ("a", "b"), ("b", None), ("a", None), (None, "c"), ("d", None))
    got = sorted(tuple(r) for r in ops.transitive_closure(edges).select("depth", F.coalesce("root", F.lit("?")), F.coalesce("pkg", F.lit("?"))).collect())
    assert got == [(0, "?", "?"), (0, "a", "a"), (0, "b", "b"), (0, "d", "d"), (1, "a", "?"), (1, "a", "b"), (1, "b", "?"), (1, "d", "?"), (2, "a", "?")]
    assert ops.transitive_closure(frame("src string, dst string")).collect() == []


def test_flatten_labels(frame):
    edges = frame("src string, dst string, constraint string, phase string", ("a", "b", ">= 1", "test"), ("a", "c", "0", "runtime"))
    labelled = ops.transitive_closure(edges, frame("root string", ("a",)), labels=["constraint", "phase"])
    assert sorted(r.label for r in ops.flatten_dependencies(labelled).collect()) == ["b (>= 1) [test]", "c"]


def test_levels_and_leftovers(frame):
    nodes = frame("node string", *[(n,) for n in "abcdxyz"])
    edges = frame("src string, dst string", ("a", "b"), ("b", "c"), ("a", "c"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x"))
    got = {r.node: (r.level, r.leftover) for r in ops.topological_levels(nodes, edges).collect()}
    assert got == {
        "c": (0, False), "d": (0, False), "b": (1, False), "a": (2, False), "x": (None, True), "y": (None, True), "z": (None, True),
    }


def test_cycles(frame):
    edges = frame(
        "src string, dst string",
        ("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("p", "a"), ("z", "q"),
    )
    got = {r.node: (r.cycle_id, r.cycle_len) for r in ops.detect_cycles(edges).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "x": ("x", 3), "y": ("x", 3), "z": ("x", 3), "s": ("s", 1)}


def test_two_tools_with_one_module_are_no_cycle(frame):
    assert ops.detect_cycles(frame("src string, dst string", ("t1", "m"), ("t2", "m"))).count() == 0


def test_cycles_match_brute_force(spark):
    pairs = [(i, (i * 7 + k * 11) % 30) for i in range(30) for k in range(1, 3) if (i * k) % 4]
    reach = {i: set() for i in range(30)}
    for s, d in pairs:
        reach[s].add(d)
    for _ in range(30):
        for n in reach:
            reach[n] |= {x for d in reach[n] for x in reach[d]}
    want = {n: frozenset(m for m in reach if m in reach[n] and n in reach[m]) for n in reach if n in reach[n]}
    got = {r.node: (r.cycle_id, r.cycle_len) for r in ops.detect_cycles(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: (min(s), len(s)) for n, s in want.items()}


def test_inheritance(frame):
    profiles = frame("profile string", ("base",), ("mid",), ("other",), ("leaf",))
    inherits = frame("profile string, parent string, pos int", ("mid", "base", 0), ("leaf", "mid", 0), ("leaf", "other", 1), ("other", "base", 0))
    settings = frame(
        "profile string, key string, value string",
        ("base", "k", "base"), ("base", "j", "base"), ("mid", "k", "mid"), ("other", "o", "other"), ("leaf", "own", "leaf"),
    )
    defaults = frame("key string, value string", ("k", "def"), ("d", "def"))
    got = {(r.profile, r.key): (r.value, r.origin) for r in ops.resolve_inheritance(profiles, inherits, settings, defaults).collect()}
    leaf = {k: v for (p, k), v in got.items() if p == "leaf"}
    # the later parent brings base's value of k again, over the one of the earlier parent
    assert leaf == {"own": ("leaf", "leaf"), "o": ("other", "other"), "k": ("base", "base"), "j": ("base", "base"), "d": ("def", "default")}
    assert got[("mid", "k")] == ("mid", "mid")


def test_conflicts_blockers_orphans(frame):
    reqs = frame("module string, requirer string, constraint string", ("m", "a", "1"), ("m", "b", "2"), ("m", "c", ""), ("n", "a", "1"), ("n", "b", "1"))
    assert sorted((r.module, r["constraint"], r.n_requirers) for r in ops.version_conflicts(reqs).collect()) == [("m", "1", 1), ("m", "2", 1)]
    tools = frame("tool string, main_module string", ("t1", "A"), ("t2", "B"), ("t3", "A"))
    edges = frame("tool string, module string", ("t2", "A"), ("t1", "X"))
    got = {r.tool: (r.can_remove, r.n_blockers, r.first_blocker) for r in ops.removal_blockers(tools, edges).collect()}
    assert got == {"t1": (False, 2, "t2"), "t2": (True, 0, None), "t3": (False, 2, "t1")}
    installed = frame("module string", ("A",), ("B",), ("X",), ("lost",))
    assert [r.module for r in ops.orphaned_modules(installed, tools, edges).collect()] == ["lost"]


def scanned_tables(monkeypatch):
    """Counts the tables that are written between steps."""
    from supplyscope.plans import shared

    written, add = [], shared.Stage.add

    def counted(self, df):
        written.append(1)
        return add(self, df)

    monkeypatch.setattr(shared.Stage, "add", counted)
    return written


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 2000, scanned_tables(monkeypatch)
    order = [(k * 7919) % n for k in range(n)]
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(order[0], order[5]), (order[3], order[1000])], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(n)], "node long")
    got = {r.node: r.level for r in ops.topological_levels(nodes, edges).collect()}
    assert got == {v: n - 1 - k for k, v in enumerate(order)}
    assert len(written) < 60


def test_long_cycle_takes_few_rounds(spark, monkeypatch):
    n, written = 2000, scanned_tables(monkeypatch)
    ring = [(k, (k + 1) % n) for k in range(n)]
    got = ops.detect_cycles(spark.createDataFrame(ring, "src long, dst long")).collect()
    assert {(r.cycle_id, r.cycle_len) for r in got} == {(0, n)} and len(got) == n
    # a second ring on the first, a way in and a way out
    more = ring + [(k, k + 3000) for k in range(0, n, 2)] + [(k + 3000, (k + 2) % n) for k in range(0, n, 2)] + [(9000, 9001), (9001, 5), (7, 9002), (9002, 9003)]
    got = ops.detect_cycles(spark.createDataFrame(more, "src long, dst long")).collect()
    assert {(r.cycle_id, r.cycle_len) for r in got} == {(0, n + n // 2)} and len(got) == n + n // 2
    assert len(written) < 120


def test_sets_and_levels_of_random_graphs(spark):
    import random

    for seed in (1, 3):
        rng = random.Random(seed)
        n = 60
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range((40, 60, 80, 120)[seed])}
        pairs |= {(k, k + 1) for k in range(100, 130)} | {(130, rng.randrange(n)), (rng.randrange(n), 100)}
        nodes = sorted({v for p in pairs for v in p})
        reach = {v: {d for s, d in pairs if s == v} for v in nodes}
        for _ in nodes:
            for v in nodes:
                reach[v] = reach[v].union(*(reach[d] for d in reach[v]))
        want = {v: frozenset(m for m in nodes if m in reach[v] and v in reach[m]) for v in nodes if v in reach[v]}
        edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
        got = {r.node: (r.cycle_id, r.cycle_len) for r in ops.detect_cycles(edges).collect()}
        assert got == {v: (min(s), len(s)) for v, s in want.items()}

        def level(v, seen={}):
            key = (seed, v)
            if key not in seen:
                seen[key] = None if v in want or any(d in want for d in reach[v]) else max((1 + level(d) for s, d in pairs if s == v), default=0)
            return seen[key]

        table = spark.createDataFrame([(v,) for v in nodes], "node long")
        assert {r.node: r.level for r in ops.topological_levels(table, edges).collect()} == {v: level(v) for v in nodes}


def test_inheritance_matches_recursion(spark):
    import random

    rng = random.Random(8)
    names = [f"p{k:02d}" for k in range(40)]
    parents = {n: [(rng.choice(names[:k]), pos) for pos in range(rng.randrange(0, 4))] if k else [] for k, n in enumerate(names)}
    own = {n: {rng.choice("abcdef"): f"{n}{v}" for v in range(rng.randrange(0, 3))} for n in names}
    parents["p39"] = [("unlisted", 0), ("p05", 1)]
    own["unlisted"] = {"z": "u"}

    def resolve(n):
        out = {}
        for parent, _ in sorted(parents.get(n, []), key=lambda x: x[1]):
            out.update(resolve(parent))
        return {**out, **{k: (v, n) for k, v in own[n].items()}}

    want = {(n, k): v for n in names for k, v in ({"a": ("da", "default"), "y": ("dy", "default")} | resolve(n)).items()}
    got = ops.resolve_inheritance(
        spark.createDataFrame([(n,) for n in names] * 2, "profile string"),
        spark.createDataFrame([(n, p, pos) for n, ps in parents.items() for p, pos in ps] * 2, "profile string, parent string, pos int"),
        spark.createDataFrame([(n, k, v) for n, ks in own.items() for k, v in ks.items()] + [("p00", "q", "2"), ("p00", "q", "1")], "profile string, key string, value string"),
        spark.createDataFrame([("a", "da"), ("y", "dy")], "key string, value string"),
    )
    rows = {(r.profile, r.key): (r.value, r.origin) for r in got.where("key <> 'q'").collect()}
    assert rows == want and got.where("profile = 'p00' and key = 'q'").first().value == "1"


def test_circular_inheritance_is_an_error(frame):
    profiles = frame("profile string", *[(n,) for n in "abcde"])
    inherits = frame("profile string, parent string, pos int", ("a", "b", 0), ("b", "a", 0), ("c", "a", 0), ("d", "e", 0))
    assert sorted(tuple(r) for r in ops.inheritance_errors(profiles, inherits).collect()) == [(n, "circular inheritance") for n in "abc"]
    settings = frame("profile string, key string, value string", ("a", "k", "1"), ("e", "k", "2"))
    got = ops.resolve_inheritance(profiles, inherits, settings, frame("key string, value string", ("x", "d")))
    assert sorted(tuple(r) for r in got.collect()) == [("d", "k", "2", "e"), ("d", "x", "d", "default"), ("e", "k", "2", "e"), ("e", "x", "d", "default")]
