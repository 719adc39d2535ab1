import json

from pyspark.sql import functions as F

from supplyscope.operators import index as ops


def test_flatten_falls_back(frame):
    docs = [
        ("Foo", {"version": "9", "module": [{"name": "A", "version": "1", "indexed": False}, {"name": "B", "version": "2", "indexed": True}], "date": "2024-01-02T03:04:05Z"}),
        ("Foo", {"version": "9", "module": [{"name": "A", "version": "", "indexed": False}], "date": "2024-01-02"}),
        ("Foo::Bar", {"version": "9", "module": [{"name": "Foo-Bar", "indexed": True}], "stats": {"pass": 3, "fail": 1}}),
        ("Foo-Bar", {"version": "9"}),
    ]
    df = frame("requested string, doc string", *[(n, json.dumps(d)) for n, d in docs], ("Bad", "{not json"))
    got = [(r.requested, r.name, r.version, r.released is not None, r.rating, r.has_tests) for r in ops.flatten_package_metadata(df).collect()]
    assert got == [
        ("Foo", "B", "2", True, 0.0, False), ("Foo", "A", "9", False, 0.0, False), ("Foo::Bar", "Foo::Bar", "9", False, 3.75, True),
        ("Foo-Bar", "Foo-Bar", "9", False, 0.0, False), ("Bad", "Bad", None, False, 0.0, False),
    ]


def test_search_scores_and_cuts(frame):
    long_line = "x" * 200 + " perl"
    docs = frame(
        "id int, name string, description string, text string",
        (1, "Perl guide", "about perl", "\n".join(["perl"] * 9)), (2, "other", "none", f"no\n  {long_line}  \nPERL"), (3, "other", "none", "nothing"),
    )
    got = ops.search_documents(docs, " PeRL ", 10).collect()
    assert [(r.id, r.score, len(r.matches)) for r in got] == [(1, 18, 5), (2, 2, 2)]
    assert got[0].matches[:3] == ["Name: Perl guide", "Description: about perl", "Line 1: perl"]
    assert len(got[1].matches[0]) == 100 and got[1].matches[0].startswith("Line 2: xxx") and got[1].matches[0].endswith("...")
    assert got[1].matches[1] == "Line 3: PERL"


def test_search_is_a_top_k(frame):
    docs = frame("id int, name string, description string, text string", (1, "a", "a", "a"))
    plan = ops.search_documents(docs, "a", 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_matches_brute_force(frame):
    names = ["ack", "tidy", "critic", "cover", "a", "xyz", "Pod"]
    modules = ["App::Ack", "App::Acks", "Perl::Tidy", "Tidy::Perl", "Perl::Critic", "Devel::Cover", "Tidying", "Pod::Text", "PodX", "A", "Test::Podder"]
    want = {}
    for n in names:
        scored = []
        for mod in modules:
            last = mod.lower().split("::")[-1]
            score = 1 - edit_distance(n.lower(), last) / max(len(n), len(last))
            if n.lower() in mod.lower() and score > 0.5:
                scored.append((-score, mod))
        if scored:
            want[n] = min(scored)[1]
    got = {r.name: r.best for r in ops.fuzzy_match(frame("name string", *[(n,) for n in names]), frame("module string", *[(x,) for x in modules])).collect()}
    assert got == want


def similarity(a, b):
    if a == b:
        return 1.0
    placed = sum(x == y for x, y in zip(a, b))
    shared = sum(min(a.count(c), b.count(c)) for c in set(a))
    return 0.7 * placed / max(len(a), len(b)) + 0.3 * shared / max(len(a), len(b))


def test_suggestions_match_brute_force(frame):
    words = ["install", "uninstall", "instal", "list", "lint", "search", "version", "versions", "config", "conflict", "help"]
    bad = ["instlal", "lst", "serach", "versoin", "confgi", "hlep", "list", "zzzz", "i"]
    want = {b: [w for _, w in sorted((-round(similarity(b, w), 9), w) for w in words if similarity(b, w) > 0.6)][:3] for b in bad}
    got = ops.suggest_similar(frame("name string", *[(b,) for b in bad]), frame("word string", *[(w,) for w in words]))
    by_name = {}
    for r in got.orderBy("name", F.col("score").desc(), "word").collect():
        by_name.setdefault(r.name, []).append(r.word)
    assert by_name == {k: v for k, v in want.items() if v}


def test_names_take_the_first_tier(frame):
    two = "name string, module string"
    got = ops.resolve_names(
        frame("name string", *[(n,) for n in ("A::B", "Perl-Tidy", "Module-With", "ack", "prove", "run", "my-app", "tid", "none")]),
        frame(two, ("ack", "Mine::Ack"), ("A::B", "Other")),
        frame(two, ("ack", "App::Ack"), ("prove", "Test::Harness")),
        frame(two + ", status string", ("run", "App::Run", "latest"), ("my-app", "Old", "old"), ("prove", "No", "latest")),
        frame("module string, status string", ("App::My-App", "latest"), ("Perl::Tid", "old"), ("Perl::Tidy", "latest")),
    )
    assert {r.name: (r.module, r.source) for r in got.collect()} == {
        "A::B": ("A::B", "explicit"), "Perl-Tidy": ("Perl-Tidy", "explicit"), "Module-With": (None, None), "ack": ("Mine::Ack", "config"),
        "prove": ("Test::Harness", "builtin"), "run": ("App::Run", "executable"), "my-app": ("App::My-App", "pattern"), "tid": ("Perl::Tidy", "fuzzy"), "none": (None, None),
    }


def test_executables(frame):
    files = frame(
        "name string, distribution string, author string, version string, abstract string, directory boolean, executable boolean",
        ("ack.pl", "D1", "a", "1", "", False, True), ("ack-grep", "D2", "a", "1", "", False, True), ("ack", "D3", "a", "1", "", True, True), ("ackx", "D4", "a", "1", "", False, True), ("ack", "D5", "a", "1", "", False, False),
    )
    got = ops.find_executables(files, frame("tool string", ("ack",), ("ack",)))
    assert sorted((r.file_name, r.tool_name, r.is_exact_match) for r in got.collect()) == [("ack-grep", "ack-grep", False), ("ack.pl", "ack", True)]


def test_suggestions_of_random_words(spark):
    import random

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 22))) for _ in range(150)})
    bad = sorted({"".join(c if rng.random() < 0.7 else rng.choice("abcd") for c in w)[: rng.randrange(1, 25)] for w in words[::3]})
    for least in (0.45, 0.6, 0.8, 0.95):
        share = (least - 0.3) / 0.7
        pairs = ops.similar_pairs(spark.createDataFrame([(b,) for b in bad], "name string"), spark.createDataFrame([(w,) for w in words], "word string"), share)
        got = {tuple(r) for r in pairs.collect()}
        for b in bad:
            for w in words:
                if sum(x == y for x, y in zip(b, w)) > share * max(len(b), len(w)) + 1e-9:
                    assert (b, w) in got, (least, b, w)


def test_suggestion_pairs_grow_with_the_vocabulary(spark):
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def made(n):
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 16))) for _ in range(n)]

    bad = spark.createDataFrame([(w,) for w in made(200)], "name string")
    counts = [ops.similar_pairs(bad, spark.createDataFrame([(w,) for w in made(n)], "word string"), 3 / 7).count() for n in (2000, 8000)]
    assert counts[1] < 5 * counts[0] and counts[1] < 0.01 * 200 * 8000


def test_module_postings_are_as_long_as_the_module(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ops, "settle", lambda df: written.append(df) or df)
    long = "App::" + "abcdefghij" * 30
    modules = spark.createDataFrame([(long,), ("A",), ("Ab",), ("X::Abc",)], "module string")
    names = spark.createDataFrame([("abcdefghij" * 20,), ("a",), ("ab",), ("AB",), ("abc",), ("zz",), ("",)], "name string")
    got = {r.name: r.best for r in ops.fuzzy_match(names, modules).collect()}
    assert got == {"abcdefghij" * 20: long, "a": "A", "ab": "Ab", "AB": "Ab", "abc": "X::Abc"}
    assert written[0].where(F.col("module") == long).count() <= len(long)


def test_maps_without_module_leave_the_name_open(frame):
    two = "name string, module string"
    got = ops.resolve_names(
        frame("name string", ("a",), ("b",), (None,)), frame(two, ("a", None), (None, "N")), frame(two, ("a", "Second")),
        frame(two + ", status string", ("b", "Third", "latest")), frame("module string, status string"),
    )
    assert {r.name: (r.module, r.source) for r in got.collect()} == {"a": ("Second", "builtin"), "b": ("Third", "executable")}
