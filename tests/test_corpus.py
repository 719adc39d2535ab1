import hashlib

from pyspark.sql import functions as F

from supplyscope.functions import masks as m
from supplyscope.operators import checks, corpus


def one(frame, text):
    return frame("file_id int, text string", (1, text))


def test_imports(frame):
    text = "\n".join(
        [
            "use strict;", "  use Moose;", "# use Hidden;", "use v5.36;", "use vars qw(x);", "use 5.010;", "use X();", "use List::Util qw(first);",
            "require Foo::Bar;", "require 'My/Mod.pm';", 'require "x.pl";', "use Moose;", "useful Thing;", "use\tTabbed;", "require 5.010;",
        ]
    )
    got = sorted(r.module for r in corpus.extract_imports(one(frame, text)).collect())
    assert got == ["Foo::Bar", "List::Util", "Moose", "My::Mod", "X", "x.pl"]


def test_imports_need_no_shuffle(frame):
    plan = corpus.extract_imports(one(frame, "use A;"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_metadata_pod_wins_when_it_says_something(frame):
    pod = '=begin tag\ndependencies = [\n  "DBI",\n  \'JSON::PP >= 4.0\',\n]\nperl_version = "5.30"\nexclude_newer = "2024"\n=end tag\n'
    note = '# /// tag\n# dependencies = ["A", "B"]\n# description = "d"\n# ///\n'
    rows = [
        corpus.extract_inline_metadata(one(frame, t), "tag").first()
        for t in (pod + note, "=begin tag\n=end tag\n" + note, "print 1;", '# /// tag\n# dependencies = [\n#   "X",\n# ]\n# perl_version = "5.8"\n# ///')
    ]
    assert (rows[0].dependencies, rows[0].perl_version, rows[0].exclude_newer) == (["DBI", "JSON::PP >= 4.0"], "5.30", "2024")
    assert (rows[1].dependencies, rows[1].description) == (["A", "B"], "d")
    assert (rows[2].dependencies, rows[2].perl_version) == ([], None)
    assert (rows[3].dependencies, rows[3].perl_version) == (["X"], "5.8")


MANIFEST = """# comment requires 'No';
requires 'perl', '5.10';
requires "Double", "1";
on 'test' => sub {
    requires 'Test::More', '>= 0.98';
    recommends 'Test::X';
};
feature 'sqlite', 'SQLite' => sub {
    on 'develop' => sub {
        requires 'Nested';
    };
};
on 'MSWin32' => sub {
    suggests 'Win32';
};
build_requires 'ExtUtils::MakeMaker';
test_requires 'Test::Deep', '1';
"""


def test_manifest(frame):
    got = {r.module: (r.version, r.relationship, r.phase, r.feature, r.platform) for r in corpus.parse_manifests(one(frame, MANIFEST)).collect()}
    assert got == {
        "perl": ("5.10", "requires", "runtime", None, None),
        "Double": ("1", "requires", "runtime", None, None),
        "Test::More": (">= 0.98", "requires", "test", None, None),
        "Test::X": (None, "recommends", "test", None, None),
        "Nested": (None, "requires", "develop", "sqlite", None),
        "Win32": (None, "suggests", "runtime", None, "MSWin32"),
        "ExtUtils::MakeMaker": (None, "build_requires", "build", None, None),
        "Test::Deep": ("1", "test_requires", "test", None, None),
    }


LOCK = """# carton snapshot format: version 1.0
# Perl version: 5.36.0
DISTRIBUTIONS
  Class-MOP-2.0
    pathname: S/ST/MOP.tar.gz
    provides:
      Class::MOP 2.0
      Class::MOP::Attr undef
    requirements:
      Carp 0
      perl 5.008
  Moose-2.2
    pathname: E/ET/Moose.tar.gz
  Test-Simple-1.3
    provides:
      Test::More 1.3
"""


def test_lock(frame):
    got = sorted((r.dist, r.pathname, r.section, r.module, r.version) for r in corpus.parse_lockfiles(one(frame, LOCK)).fillna("").collect())
    assert got == [
        ("Class-MOP-2.0", "S/ST/MOP.tar.gz", "provides", "Class::MOP", "2.0"),
        ("Class-MOP-2.0", "S/ST/MOP.tar.gz", "provides", "Class::MOP::Attr", "undef"),
        ("Class-MOP-2.0", "S/ST/MOP.tar.gz", "requirements", "Carp", "0"),
        ("Class-MOP-2.0", "S/ST/MOP.tar.gz", "requirements", "perl", "5.008"),
        ("Moose-2.2", "E/ET/Moose.tar.gz", "", "", ""),
        ("Test-Simple-1.3", "", "provides", "Test::More", "1.3"),
    ]
    assert corpus.parse_lockfiles(one(frame, LOCK)).first().interpreter == "5.36.0"


def test_declarations_at_byte_positions(frame):
    text = "package Café;\n# my $no;\nmy $é; my $x = 1;\nsub f { my ($a, @b) = @_; our %h; }\nif ($x == 1) { my $y == 2 }\n".replace("$é", "$e")
    for limit in (10**9, 2):
        got = corpus.extract_declarations(one(frame, text), max_rows=limit).collect()
        raw = text.encode()
        for r in got:
            assert raw[r.start :].startswith((b"package", b"my", b"our", b"sub"))
        assert {(r.kind, r.name, r.type_mask) for r in got if r.kind != "package"} == {
            ("variable", "$e", m.UNDEF), ("variable", "$x", m.SCALAR), ("sub", "f", m.CODE), ("variable", "$a", m.SCALAR),
            ("variable", "@b", m.ARRAY), ("variable", "%h", m.HASH), ("variable", "$y", m.UNDEF),
        }


def test_long_text_without_declarations_is_read_in_one_pass(frame):
    assert corpus.extract_declarations(one(frame, "nothing here\n" * 200_000)).count() == 0


def test_offsets(frame):
    text = "ab\n\nçd\nlast"
    raw = text.encode()
    diags = frame("file_id int, diag_id long, start int, severity string, message string, code string", *[(1, i, i, "error", "m", "c") for i in range(len(raw) + 5)])
    for limit in (10**9, 3):
        got = {r.diag_id: (r.line, r.col) for r in checks.locate_offsets(diags, one(frame, text), max_rows=limit).collect()}
        for offset in range(len(raw) + 5):
            head = raw[: min(offset, len(raw))]
            assert got[offset] == (head.count(b"\n") + 1, len(head) - (head.rfind(b"\n") + 1) + 1)


def test_cross_file(frame):
    refs = frame("ref string", ("Foo::Bar::run",), ("Foo::Bar::run",), ("Gone::x",), ("plain",))
    files = frame("path string", ("lib/Foo/Bar.pm",), ("local/Foo/Bar.pm",))
    symbols = frame("path string, name string, return_mask long", ("lib/Foo/Bar.pm", "run", 4), ("local/Foo/Bar.pm", "run", 1))
    got = sorted((r.ref, r.path or "", r.symbol or "", r.return_mask or 0) for r in checks.resolve_cross_file(refs, files, symbols, ["local", "lib"]).collect())
    assert got == [("Foo::Bar::run", "local/Foo/Bar.pm", "run", 1)] * 2 + [("Gone::x", "", "", 0), ("plain", "", "", 0)]


def test_masks(spark):
    cases = [
        (m.INT, m.NUM, True), (m.NUM, m.STR, True), (m.STR, m.INT, False), (m.SCALAR, m.INT, True), (m.UNKNOWN, m.HASH, True), (m.NONE, m.INT, True),
        (m.OBJECT | m.LEAVES["HashRef"], m.OBJECT, True), (m.REF, m.LEAVES["HashRef"], False), (m.LIST, m.ARRAY, True), (m.HASH, m.ANY, True),
    ]
    df = spark.createDataFrame(cases, "a long, r long, want boolean")
    assert df.where(m.satisfies(F.col("a"), F.col("r")) != F.col("want")).count() == 0
    names = {m.STR: "Str", m.INT | m.UNDEF: "Undef|Int", 0: "Unknown", m.NONE: "None", m.ANY: "Any", 1 << 20: "0x100000"}
    df = spark.createDataFrame(list(names.items()), "a long, want string")
    assert df.where(m.mask_name(F.col("a")) != F.col("want")).count() == 0


def test_guards(frame):
    facts = frame(
        "mask long, guard string, ref_type string, negated boolean, want long, changes boolean",
        (m.SCALAR, "defined", "", False, m.SCALAR & ~m.UNDEF, True), (m.INT, "defined", "", False, m.INT, False), (m.INT, "defined", "", True, m.NONE, True),
        (0, "ref", "HASH", False, m.LEAVES["HashRef"], True), (m.ANY, "ref", "My::Class", False, m.OBJECT, True), (m.ANY, "ref", "HASH", True, m.ANY, False),
        (m.STR, "isa", "", False, m.NONE, True), (m.BOOL | m.INT, "bool", "", True, m.INT, True), (m.ANY, "ref", "REF", False, m.REF, True),
    )
    assert checks.narrow_masks(facts).where("narrowed <> want or changed <> changes").count() == 0
    hint = m.guard_suggestion(F.lit("$x"), m.bits(m.SCALAR & ~0 | m.UNDEF), m.bits(m.INT))
    assert facts.select(hint).first()[0] == "Add guard: if (defined($x)) { ... }"


def test_signatures(spark, frame):
    calls = frame(
        "call_id int, name string, n_args int, arg_no int, mask long, var string",
        (1, "push", 1, 0, m.INT, "@a"), (2, "keys", 0, None, None, None), (3, "push", 3, 0, m.ARRAY, "@a"), (3, "push", 3, 1, m.INT, ""), (3, "push", 3, 2, m.HASH, ""),
        (4, "length", 1, 0, m.HASH, "%h"), (5, "unknown", 1, 0, m.HASH, ""), (6, "substr", 2, 1, m.STR, "$s"), (7, "chr", 1, 0, m.UNDEF | m.INT, "$n"),
    )
    got = sorted((r.call_id, r.code, r.message) for r in checks.check_signatures(calls, checks.builtin_signatures(spark)).collect())
    assert got == [
        (1, "arity-mismatch", "call to push: expected at least 2 argument(s), got 1"),
        (2, "arity-mismatch", "call to keys: expected at least 1 argument(s), got 0"),
        (4, "type-mismatch", "call to length: argument 1 expects Str, got Hash"),
        (6, "type-mismatch", "call to substr: argument 2 expects Num, got Str"),
    ]


def test_checksums(frame):
    good = hashlib.sha256(b"data").hexdigest()
    artifacts = frame("name string, content string", *[(f"d/{n}", "data") for n in ("ok.tgz", "bad.tgz", "short.tgz", "none.tgz", "perl-5.36.0.tar.xz", "over.tgz.tmp")])
    lines = ["", "# x", f"{good}  *pool/ok.tgz", f"{'0' * 64} bad.tgz", "abc short.tgz", f"{good} perl-5.36.0.tar.xz", f"{'0' * 64} over.tgz"]
    lists = frame("priority int, line_no int, line string", *[(2, i, t) for i, t in enumerate(lines)], (1, 0, f"{good} over.tgz"))
    got = {r.name: (r.status, r.interpreter_version) for r in corpus.verify_checksums(artifacts, lists).collect()}
    assert got == {
        "d/ok.tgz": ("ok", None), "d/bad.tgz": ("mismatch", None), "d/short.tgz": ("malformed", None), "d/none.tgz": ("missing", None),
        "d/perl-5.36.0.tar.xz": ("ok", "5.36.0"), "d/over.tgz.tmp": ("ok", None),
    }


def test_tap(frame):
    text = ["1..4", "# Testing t/a.t", "ok 1 - fine", "not ok 2 - broke", "# Failed", "# got 1", "not ok 3", "ok 4", "Can't locate X.pm in @INC", "# stray"]
    logs = frame("run int, line_no int, line string", *[(1, i, t) for i, t in enumerate(text)], (2, 0, "ok 1"), (2, 1, "Result: PASS"))
    for limit in (10**9, 3):
        lines = corpus.tap_lines(logs, limit)
        failures = corpus.tap_failures(lines)
        assert sorted((r.file, r.test_name, r.error) for r in failures.collect()) == [
            ("t/a.t", "Build/Compilation", "Can't locate X.pm in @INC"), ("t/a.t", "Test 3", "Test failed"), ("t/a.t", "broke", "Failed"),
        ]
        got = {r.run: (r.total, r.passed, r.failed, r.skipped, r.summary, r.cause) for r in corpus.tap_results(lines, failures).collect()}
        assert got[1] == (5, 2, 3, 0, "3 out of 5 tests failed", corpus.CAUSES["missing"])
        assert got[2] == (0, 1, 0, 0, "All tests passed", "")


def test_upsert_and_archive_root(frame):
    now = frame("module string, phase string, version string", ("A", "runtime", "1"), ("B", "test", "1"))
    change = frame("module string, phase string, version string", ("A", "runtime", "2"), ("A", "test", "3"))
    assert sorted(map(tuple, corpus.upsert_requirements(now, change, ["module", "phase"]).collect())) == [("A", "runtime", "2"), ("A", "test", "3"), ("B", "test", "1")]
    entries = frame("archive int, dir string, entry string", (1, "b", "b/Makefile.PL"), (1, "a", "a/Makefile"), (1, "c", "c/x/Build.PL"), (2, "z", "z/R"), (2, "y", "y/R"))
    assert sorted((r.archive, r.root, r.build_file) for r in corpus.pick_archive_root(entries).collect()) == [(1, "b", "Makefile.PL"), (2, "y", None)]


def test_declarations_between_marks(frame):
    text = "\u0001my $a;\u0002 sub \u0001f {}\nour ($b, @c)\u0002= 1;\n# sub no\nsub g {}"
    got = {(r.name, r.start) for r in corpus.extract_declarations(one(frame, text)).collect()}
    assert got == {("$a", 1), ("$b", text.index("our")), ("@c", text.index("our")), ("g", text.index("sub g")), ("f", text.index("sub"))}
