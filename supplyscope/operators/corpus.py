"""Fact tables from source text, manifests, lock files, checksum lists, archives and test logs.

A text is one cell. Everything that depends only on the text itself is read inside
the row, without a shuffle; only facts that need order across rows are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.functions.facts import DETECTION_CORE, PRAGMAS
from supplyscope.functions import masks as m
from supplyscope.plans.ordered import MAX_GROUP_ROWS, carry_forward, first_in_group
from supplyscope.plans.shared import settle

_BLANK = " \t\r\f"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def extract_imports(files: DataFrame, key: str = "file_id", text: str = "text", drop_core: bool = False) -> DataFrame:
    """Distinct packages that each file uses or requires, pragmas left out."""
    lines = F.filter(
        F.transform(_lines(F.col(text)), _trimmed), lambda x: x.startswith("use ") | x.startswith("require ")
    )

    def name(line: Column) -> Column:
        used = F.regexp_extract(line, r"^use\s+([A-Za-z_][\w:]*)", 1)
        used = F.when(used.startswith("v"), "").otherwise(used)
        required = F.regexp_extract(line, r"""^require\s+["']?([^"';\s]+)""", 1)
        as_package = F.replace(F.regexp_replace(required, r"\.pm$", ""), F.lit("/"), F.lit("::"))
        required = F.when(required.rlike(r"^\d"), "").when(required.endswith(".pm"), as_package).otherwise(required)
        return F.when(line.startswith("use "), used).otherwise(required)

    skipped = PRAGMAS + DETECTION_CORE if drop_core else PRAGMAS
    wanted = F.filter(F.array_distinct(F.transform(lines, name)), lambda x: (x != "") & ~x.isin(skipped))
    return files.select(key, F.explode(wanted).alias("module"))


def extract_inline_metadata(files: DataFrame, tag: str, key: str = "file_id", text: str = "text") -> DataFrame:
    """The metadata block of a script: the POD form if it says anything, else the comment form.

    `tag` is the word after `=begin` and after `# ///`. Files without a block give nulls.
    """
    body = F.col(text)
    pod = F.regexp_extract(body, rf"(?ms)^[ \t]*=begin {tag}[ \t\r]*$(.*?)(?:^[ \t]*=end {tag}[ \t\r]*$|\z)", 1)
    note = F.regexp_extract(body, rf"(?ms)^[ \t]*# /// {tag}[ \t\r]*$(.*?)(?:^[ \t]*# ///[ \t\r]*$|\z)", 1)
    note = F.regexp_replace(note, r"(?m)^[ \t]*# ?[ \t]*", "")

    def facts(block: Column) -> Column:
        listed = F.regexp_extract(block, r"(?ms)^[ \t]*dependencies = \[(.*?)(?:\]|\z)", 1)
        rows = F.when(listed.contains("\n"), F.slice(_lines(listed), F.lit(2), F.size(_lines(listed)))).otherwise(
            F.split(listed, ",")
        )

        def quoted(row: Column) -> Column:
            double = F.regexp_extract(row, r'"([^"]+)"', 1)
            return F.trim(F.when(double != "", double).otherwise(F.regexp_extract(row, r"'([^']+)'", 1)))

        def value(field: str) -> Column:
            return F.nullif(F.regexp_extract(block, rf'(?m)^[ \t]*{field}\s*=\s*"([^"]+)"', 1), F.lit(""))

        return F.struct(
            F.filter(F.transform(rows, quoted), lambda d: d != "").alias("dependencies"),
            value("perl_version").alias("perl_version"),
            value("description").alias("description"),
            value("exclude_newer").alias("exclude_newer"),
        )

    both = files.select(key, facts(pod).alias("pod"), facts(note).alias("note"))
    from_pod = (F.size("pod.dependencies") > 0) | F.col("pod.perl_version").isNotNull()
    return both.select(
        key,
        F.when(from_pod, F.col("pod.dependencies")).otherwise(F.col("note.dependencies")).alias("dependencies"),
        F.when(from_pod, F.col("pod.perl_version")).otherwise(F.col("note.perl_version")).alias("perl_version"),
        F.when(from_pod, F.col("pod.description")).otherwise(F.col("note.description")).alias("description"),
        F.when(from_pod, F.col("pod.exclude_newer")).alias("exclude_newer"),
    )


# fixed values: manifest keywords and block targets
RELATIONSHIPS = ("requires", "recommends", "suggests", "test_requires", "build_requires")
PHASES = ("test", "build", "runtime", "develop")
_QUOTED = r"""\s+['"]([^'"]+)['"]"""
_OPENER = rf"(?:feature|on){_QUOTED}"


def parse_manifests(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """Requirement rows with the feature, platform and phase block that they stand in.

    The text is cut after each line that closes blocks, and each piece before each line
    that opens one, so that a line's context follows from the few openers before it.
    """
    rough = F.regexp_replace(F.col(text), r"(?m)^[ \t]*(?:#.*)?\r?$\n?", "")
    closed = F.regexp_replace(rough, rf"(?m)^(?=[^\n]*\}};)(?!.*{_OPENER})(.*)$", "$2\u0001")
    opened = F.transform(
        F.split(closed, "\u0001\n?"),
        lambda piece: F.split(F.regexp_replace(piece, rf"(?m)^(?=.*{_OPENER})", "\u0002"), "\u0002"),
    )
    start = F.struct(
        F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("string").alias("platform"),
        F.lit("runtime").alias("phase"),
    )

    def step(state: Column, segment: Column) -> Column:
        head = F.substring_index(segment, "\n", 1)
        feature = F.regexp_extract(head, rf"feature{_QUOTED}", 1)
        target = F.when(feature == "", F.regexp_extract(head, rf"on{_QUOTED}", 1)).otherwise("")
        return F.struct(
            F.when(feature != "", feature).otherwise(state["feature"]).alias("feature"),
            F.when((target != "") & ~target.isin(*PHASES), target).otherwise(state["platform"]).alias("platform"),
            F.when(target.isin(*PHASES), target).otherwise(state["phase"]).alias("phase"),
        )

    def with_context(segments: Column) -> Column:
        def add(acc: Column, segment: Column) -> Column:
            state = step(acc["state"], segment)
            row = F.struct(segment.alias("segment"), state.alias("state"))
            return F.struct(state.alias("state"), F.concat(acc["rows"], F.array(row)).alias("rows"))

        empty = F.array().cast(
            "array<struct<segment:string,state:struct<feature:string,platform:string,phase:string>>>"
        )
        return F.aggregate(segments, F.struct(start.alias("state"), empty.alias("rows")), add)["rows"]

    rows = files.select(key, F.explode(F.flatten(F.transform(opened, with_context))).alias("s"))
    # only the first line of a segment can open a block
    segment = F.col("s.segment")
    rest = F.when(segment.contains("\n"), F.substr(segment, F.instr(segment, "\n") + 1)).otherwise("")
    body = F.when(F.substring_index(segment, "\n", 1).rlike(_OPENER), rest).otherwise(segment)
    lines = rows.select(key, "s.state.*", F.explode(_lines(body)).alias("line"))
    pattern = rf"""(?:^|\s)({'|'.join(RELATIONSHIPS)}){_QUOTED}(?:\s*,\s*['"]([^'"]+)['"])?"""
    kind = F.regexp_extract("line", pattern, 1)
    phase = F.when(kind == "test_requires", "test").when(kind == "build_requires", "build").otherwise(F.col("phase"))
    named = F.col("line").contains("requires") | F.col("line").contains("recommends") | F.col("line").contains("suggests")
    return lines.where(named & F.col("line").rlike(pattern)).select(
        key,
        F.regexp_extract("line", pattern, 2).alias("module"),
        F.nullif(F.regexp_extract("line", pattern, 3), F.lit("")).alias("version"),
        kind.alias("relationship"),
        phase.alias("phase"),
        "feature",
        "platform",
    )


def parse_lockfiles(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """Rows (interpreter, dist, pathname, section, module, version) from a lock text's indentation.

    A distribution without modules gives one row with a null section.
    """
    body = F.col(text)
    interpreter = F.nullif(F.regexp_extract(body, r"(?m)^\s*#.*?Perl version:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(""))
    dist_line = r"(?m)^(?=  (?!pathname:|provides:|requirements:|#)\S)"
    blocks = F.split(F.regexp_replace(body, dist_line, "\u0001"), "\u0001")
    dists = files.select(key, interpreter.alias("interpreter"), F.explode(F.slice(blocks, F.lit(2), F.size(blocks))).alias("block"))
    section_line = r"(?m)^(?=    (?:provides:|requirements:)[ \t\r]*$)"
    sections = F.split(F.regexp_replace("block", section_line, "\u0002"), "\u0002")
    parts = dists.select(
        key,
        "interpreter",
        _trimmed(F.substring_index("block", "\n", 1)).alias("dist"),
        F.nullif(F.regexp_extract("block", r"(?m)^    pathname:[ \t]*(.*?)[ \t\r]*$", 1), F.lit("")).alias("pathname"),
        F.slice(sections, F.lit(2), F.size(sections)).alias("sections"),
    )

    def modules(section: Column) -> Column:
        name = F.regexp_extract(section, r"^    (provides|requirements):", 1)
        found = F.regexp_extract_all(section, F.lit(r"(?m)^ {6}(?![ #])(\S+[ \t]+\S+)"), F.lit(1))

        def row(pair: Column) -> Column:
            fields = F.split(pair, r"[ \t]+")
            return F.struct(name.alias("section"), fields[0].alias("module"), fields[1].alias("version"))

        return F.transform(found, row)

    entries = F.flatten(F.transform("sections", modules))
    return parts.select(key, "interpreter", "dist", "pathname", F.explode_outer(entries).alias("e")).select(
        key, "interpreter", "dist", "pathname", "e.*"
    )


_DECLARATION = (
    r"^[ \t]*#[^\n]*"
    r"|\bpackage\s+[A-Za-z_][\w:]*"
    r"|\bsub\s+[A-Za-z_]\w*"
    r"|\b(?:my|our|state|local)\s*(?:\([^)]*\)|[$@%][A-Za-z_]\w*)(?:\s*=(?![=~]))?"
)


def extract_declarations(
    files: DataFrame, key: str = "file_id", text: str = "text", max_rows: int | None = None
) -> DataFrame:
    """Packages, subs and variables declared in each file, with type mask and byte position.

    Found by pattern, line comments skipped. One pass of the pattern puts marks around every match; the text is cut at the marks,
    and a position is the sum of byte lengths before it, along the pieces of one file, which came from one cell.
    `max_rows` has no effect any more.
    """
    begin, end = "\u0001", "\u0002"
    plain = F.translate(text, begin + end, "  ")  # a byte for a byte: positions stay
    marked = F.regexp_replace(plain, f"(?ms){_DECLARATION}", f"{begin}$0{end}")
    rows = files.select(key, F.posexplode(F.split(marked, begin)).alias("pos", "piece"))
    # the first piece is what comes before any match; every other one is a match, the end mark and what follows
    hit = F.when(F.col("pos") > 0, F.substring_index("piece", end, 1))
    span = F.octet_length("piece") - F.when(F.col("pos") > 0, 1).otherwise(0)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(key, "pos", hit.alias("hit"), span.cast("long").alias("span")).withColumn("start", F.sum("span").over(before))
    hit = F.col("hit")
    word = F.regexp_extract(hit, r"^(package|sub)\s+([\w:]+)", 1)
    variables = F.transform(
        F.regexp_extract_all(hit, F.lit(r"([$@%][A-Za-z_]\w*)"), F.lit(1)),
        lambda v: F.struct(
            F.lit("variable").alias("kind"),
            v.alias("name"),
            F.when(v.startswith("@"), m.bits(m.ARRAY))
            .when(v.startswith("%"), m.bits(m.HASH))
            .when(hit.endswith("="), m.bits(m.SCALAR))
            .otherwise(m.bits(m.UNDEF))
            .alias("type_mask"),
        ),
    )
    named = F.array(
        F.struct(
            word.alias("kind"),
            F.regexp_extract(hit, r"^(package|sub)\s+([\w:]+)", 2).alias("name"),
            F.when(word == "sub", m.bits(m.CODE)).otherwise(m.bits(m.UNKNOWN)).alias("type_mask"),
        )
    )
    declared = placed.where(hit.isNotNull() & ~_trimmed(hit).startswith("#")).select(
        key,
        "start",
        F.explode(F.when(word != "", named).otherwise(variables)).alias("d"),
    )
    return declared.select(key, "d.kind", "d.name", "d.type_mask", "start")


# --- checksum lists, archives, manifests, locks -------------------------------------------


def verify_checksums(artifacts: DataFrame, lists: DataFrame) -> DataFrame:
    """ok / mismatch / missing / malformed per artifact (name, content).

    `lists` holds lines (priority, line_no, line); the lowest priority number wins, so a
    user's list overrides a built-in one. Names are matched by their last path part.
    """
    line = _trimmed(F.col("line"))
    fields = F.split(line, r"\s+")
    listed = F.regexp_replace(F.get(fields, F.lit(1)), r"^\*", "")
    entries = lists.where((line != "") & ~line.startswith("#") & (F.size(fields) >= 2)).select(
        "priority", "line_no", fields[0].alias("expected"), F.substring_index(listed, "/", -1).alias("base")
    )
    chosen = first_in_group(entries, ["base"], ["priority", "line_no"])
    base = F.substring_index(F.regexp_replace("name", r"\.tmp$", ""), "/", -1)
    checked = artifacts.select("name", base.alias("base"), F.sha2("content", 256).alias("actual")).join(
        chosen.select("base", "expected"), "base", "left"
    )
    expected = F.col("expected")
    status = (
        F.when(expected.isNull(), "missing")
        .when(~expected.rlike("^[0-9a-fA-F]{64}$"), "malformed")
        .when(F.col("actual") == expected, "ok")
        .otherwise("mismatch")
    )
    version = F.nullif(F.regexp_extract("base", r"^perl-(.*?)(?:\.tar\.gz|\.tar\.xz|\.tgz)?$", 1), F.lit(""))
    return checked.select("name", status.alias("status"), version.alias("interpreter_version"))


# fixed values: build files by rank
BUILD_FILES = {"Build.PL": 300, "Makefile.PL": 200, "Makefile": 100}


def pick_archive_root(entries: DataFrame) -> DataFrame:
    """The root directory of each archive (archive, dir, entry): best build file, then path."""
    rank = F.lit(0)
    for name, points in BUILD_FILES.items():
        rank = F.when(F.col("entry") == F.concat_ws("/", "dir", F.lit(name)), points).otherwise(rank)
    dirs = entries.groupBy("archive", "dir").agg(F.max(rank).alias("rank"))
    best = first_in_group(dirs, ["archive"], [F.col("rank").desc(), F.col("dir")])
    build_file = F
    for name, points in BUILD_FILES.items():
        build_file = build_file.when(F.col("rank") == points, name)
    return best.select("archive", F.col("dir").alias("root"), build_file.alias("build_file"))


def upsert_requirements(current: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace the rows of `current` with the same key, append the others.

    When `changes` has a `seq` column, the highest one of a key counts.
    """
    newest = changes
    if "seq" in changes.columns:
        newest = first_in_group(changes, list(key), [F.col("seq").desc()]).drop("seq")
    untouched = current.join(newest.select(*key).distinct(), list(key), "left_anti")
    return untouched.unionByName(newest.select(*current.columns))


def remove_requirements(current: DataFrame, modules: DataFrame, key: Sequence[str]) -> DataFrame:
    return current.join(modules.select(*key).distinct(), list(key), "left_anti")


def build_lock_table(reqs: DataFrame, installed: DataFrame, key: Sequence[str] = ("project", "module")) -> DataFrame:
    """Locked distributions of the required modules that are installed."""
    wanted = reqs.select(*key).distinct()
    locked = wanted.join(installed, list(key))
    module = key[-1]
    dist = F.concat_ws("-", F.replace(F.col(module), F.lit("::"), F.lit("-")), "version")
    return locked.select(*key, "version", dist.alias("distribution"))


def bundle_rows(locked: DataFrame, key: Sequence[str] = ("project", "module")) -> DataFrame:
    """Bundle export: module name and `>=version`."""
    return locked.select(*key, F.concat(F.lit(">="), "version").alias("constraint"))


def bundle_json(bundle: DataFrame, key: Sequence[str] = ("project", "module")) -> DataFrame:
    """One JSON text per bundled module, ready for a text sink."""
    entry = F.struct(F.col(key[-1]).alias("name"), F.col("constraint").alias("version"))
    return bundle.select(*key[:-1], F.to_json(entry).alias("value"))


# --- test logs ----------------------------------------------------------------------------

# fixed values: line forms of a test log, and the error texts looked for in other lines
TAP_FILE = r"^#\s+(?:Running|Testing)\s+(.+\.t)"
TAP_FAILED_FILE = r"^(.+\.t)\s+.*\(Wstat:"
TAP_PLAN = r"^1\.\.(\d+)"
TAP_OK = r"^ok\s+(\d+)"
TAP_NOT_OK = r"^not ok\s+(\d+)\s*-?\s*(.*)"
TAP_DIAG = r"^#\s+(.+)"
TAP_SUMMARY = r"^Files=(\d+),\s*Tests=(\d+)"
TAP_RESULT = r"Result:\s*(\w+)"
ERROR_TEXTS = (
    ("Can't locate module", r"Can't locate (.+\.pm) in @INC"),
    ("Undefined symbol", r"Undefined symbol:?\s*(.+)"),
    ("Compilation failed", r"Compilation failed"),
    ("Permission denied", r"Permission denied"),
    ("No such file", r"No such file or directory"),
    ("Syntax error", r"syntax error"),
    ("XS compilation failed", r"error:.*XS"),
    ("Version mismatch", r"Version mismatch"),
)


def tap_lines(logs: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Log lines (run, line_no, line) with kind, current test file and the failure they belong to, as a written table.

    The operators below read the lines several times; writing them once keeps the patterns and the carried values from running again.
    """
    line = F.col("line")
    kind = (
        F.when(line.rlike(TAP_FILE), "file")
        .when(line.rlike(TAP_FAILED_FILE), "failed_file")
        .when(line.rlike(TAP_PLAN), "plan")
        .when(line.rlike(TAP_OK), "ok")
        .when(line.rlike(TAP_NOT_OK), "not_ok")
        .when(line.rlike(TAP_DIAG), "diag")
        .when(line.rlike(TAP_SUMMARY), "summary")
        .when(line.rlike(TAP_RESULT), "result")
        .otherwise("other")
    )
    named = F.when(F.col("kind") == "file", F.regexp_extract(line, TAP_FILE, 1)).when(
        F.col("kind") == "failed_file", F.regexp_extract(line, TAP_FAILED_FILE, 1)
    )
    opened = F.when(F.col("kind") == "not_ok", F.col("line_no")).when(F.col("kind").isin("ok", "file"), F.lit(-1))
    carried = carry_forward(
        logs.withColumn("kind", kind),
        ["run"],
        ["line_no"],
        {"file": named, "failure_line": opened.cast("long")},
        max_rows,
    )
    inside = F.col("kind").isin("not_ok", "diag") & F.coalesce(F.col("failure_line") >= 0, F.lit(False))
    # a `#` line outside a failure is read like any other line
    outside = F.when(line.rlike(TAP_RESULT), "result").otherwise("other")
    settled = F.when((F.col("kind") == "diag") & ~inside, outside).otherwise(F.col("kind"))
    return settle(carried.withColumns({"failure_line": F.when(inside, F.col("failure_line")), "kind": settled}))


def tap_failure_lines(lines: DataFrame) -> DataFrame:
    """(run, failure_line, line_no, text): every diagnostic line of a failed test."""
    rows = lines.where((F.col("kind") == "diag") & F.col("failure_line").isNotNull())
    return rows.select("run", "failure_line", "line_no", F.regexp_replace("line", r"^# ", "").alias("text"))


def tap_failures(lines: DataFrame) -> DataFrame:
    """Failed tests (run, failure_line, file, test_name, error, kinds of cause).

    `error` is the first diagnostic line; `tap_failure_lines` has all of them. Outside failed tests
    every line with an error text is a failure of its file, unless an earlier failure of the file
    has the error's name in its text.
    """
    text = F.regexp_replace("line", r"^# ", "")
    low = F.lower("line")
    is_diag = F.col("kind") == "diag"
    test = F.max(F.when(F.col("kind") == "not_ok", F.col("line")))
    name = F.regexp_extract(test, TAP_NOT_OK, 2)
    title = F.when(name == "", F.concat(F.lit("Test "), F.regexp_extract(test, TAP_NOT_OK, 1))).otherwise(name)
    flags = {
        "missing": low.contains("can't locate") | low.contains("@inc"),
        "xs": low.contains("xs") | low.contains("undefined symbol"),
        "compile": low.contains("compilation failed") | low.contains("syntax error"),
        "permission": low.contains("permission denied"),
    }
    failed = (
        lines.where(F.col("failure_line").isNotNull())
        .groupBy("run", "failure_line")
        .agg(
            F.max(F.when(F.col("kind") == "not_ok", F.col("file"))).alias("file"),
            title.alias("test_name"),
            F.coalesce(F.min_by(F.when(is_diag, text), F.when(is_diag, F.col("line_no"))), F.lit("Test failed")).alias("error"),
            *[F.coalesce(F.bool_or(is_diag & f), F.lit(False)).alias(n) for n, f in flags.items()],
        )
    )
    error_type = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), n) for n, p in ERROR_TEXTS]))
    named = lines.where(F.col("kind").isin("other", "diag") & F.col("file").isNotNull())
    told = F.array_compact(F.array(*[F.when(F.contains(F.col("line"), F.lit(n)), F.lit(n)) for n, _ in ERROR_TEXTS]))
    counted = (F.col("kind") == "diag") | (F.size(error_type) > 0)
    first = named.where(counted).select("run", "file", "line_no", F.explode(told).alias("error_type"))
    first = first.groupBy("run", "file", "error_type").agg(F.min("line_no").alias("first"))
    broken = (
        named.where("kind = 'other'")
        .withColumn("error_type", F.explode(error_type))
        .join(first, ["run", "file", "error_type"], "left")
        .where("first is null or line_no <= first")
        .select("run", F.col("line_no").alias("failure_line"), "file", F.lit("Build/Compilation").alias("test_name"), "line")
        .select("run", "failure_line", "file", "test_name", F.col("line").alias("error"), *[f.alias(n) for n, f in flags.items()])
    )
    return failed.unionByName(broken)


# fixed values: causes by rank, first hit wins
CAUSES = {
    "missing": "Missing dependencies - some required modules are not installed",
    "xs": "XS compilation issue - C extensions failed to build properly",
    "compile": "Build failure - module failed to compile",
    "permission": "Permission issue - insufficient permissions for testing",
}
CAUSE_MOST = "Multiple test failures - likely environment or dependency issue"
CAUSE_SOME = "Some tests failed - module may still work correctly"


def tap_results(lines: DataFrame, failures: DataFrame) -> DataFrame:
    """Per run: total, passed, failed, skipped, summary and likely cause."""
    kind = F.col("kind")

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract("line", pattern, group).try_cast("long")

    counts = lines.groupBy("run").agg(
        F.coalesce(F.sum(F.when(kind == "plan", number(TAP_PLAN, 1))), F.lit(0)).alias("planned"),
        F.max_by(F.when(kind == "summary", number(TAP_SUMMARY, 2)), F.when(kind == "summary", F.col("line_no"))).alias("stated"),
        F.count_if(kind == "ok").alias("passed"),
        F.max_by(
            F.when(kind == "result", F.regexp_extract("line", TAP_RESULT, 1)), F.when(kind == "result", F.col("line_no"))
        ).alias("verdict"),
    )
    causes = failures.groupBy("run").agg(
        F.count(F.lit(1)).alias("failed"),
        F.count_if(F.col("test_name") == "Build/Compilation").alias("broken"),
        *[F.bool_or(c).alias(c) for c in CAUSES],
    )
    joined = counts.join(causes, "run", "left")
    failed = F.coalesce("failed", F.lit(0))
    total = F.coalesce("stated", "planned") + F.coalesce("broken", F.lit(0))
    summary = (
        F.when((F.col("verdict") == "PASS") | (F.col("verdict").isNull() & (F.col("failed") == 0)), "All tests passed")
        .when(F.col("verdict").isNotNull(), F.format_string("%d tests failed", "failed"))
        .otherwise(F.format_string("%d out of %d tests failed", "failed", "total"))
    )
    cause = F.when(F.col("failed") == 0, "")
    for name, text in CAUSES.items():
        cause = cause.when(F.col(name), text)
    cause = cause.when(F.col("failed") > F.floor(F.col("total") / 2), CAUSE_MOST).otherwise(CAUSE_SOME)
    skipped = F.greatest(F.col("total") - F.col("passed") - F.col("failed"), F.lit(0))
    return (
        joined.withColumn("total", total)
        .withColumn("failed", failed)
        .withColumn("skipped", skipped)
        .select("run", "total", "passed", "failed", "skipped", summary.alias("summary"), cause.alias("cause"))
    )
