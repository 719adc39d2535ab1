"""Checks over fact tables of source code: references, positions, signatures, type masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.functions import masks as m
from supplyscope.plans.ordered import first_in_group


def resolve_cross_file(
    refs: DataFrame, files: DataFrame, symbols: DataFrame, lib_dirs: Sequence[str] = ("lib",)
) -> DataFrame:
    """`Pkg::name` references to the file of Pkg, and the symbol's return mask there.

    The first library directory that has the file wins; unresolved references are kept.
    """
    cut = F.length("ref") - F.length(F.substring_index("ref", "::", -1)) - 2
    names = (
        refs.select("ref")
        .distinct()
        .withColumn("package", F.expr("substring(ref, 1, length(ref) - length(substring_index(ref, '::', -1)) - 2)"))
        .withColumn("name", F.substring_index("ref", "::", -1))
        .where(cut > 0)
    )
    rel = F.concat(F.replace(F.col("package"), F.lit("::"), F.lit("/")), F.lit(".pm"))
    tries = names.select("package", rel.alias("rel")).distinct().select(
        "package", F.posexplode(F.array(*[F.concat(F.lit(f"{d}/"), "rel") for d in lib_dirs])).alias("dir_no", "path")
    )
    found = first_in_group(tries.join(files.select("path").distinct(), "path"), ["package"], ["dir_no"])
    hits = (
        names.join(found.select("package", "path"), "package", "left")
        .join(symbols.select("path", "name", "return_mask"), ["path", "name"], "left")
        .select("ref", "path", F.when(F.col("return_mask").isNotNull(), F.col("name")).alias("symbol"), "return_mask")
    )
    return refs.join(hits, "ref", "left")


def locate_offsets(diagnostics: DataFrame, files: DataFrame, key: str = "file_id", text: str = "text", max_rows: int | None = None) -> DataFrame:
    """Line and column of byte offsets, and the report line of each diagnostic.

    Each diagnostic meets its file's text once and counts the line ends in the bytes before its offset: one join, no
    row for a line, and no list of lines. An offset behind the text is at its end. `files` has one row for each key;
    without a file, a text or an offset from 0 on, line, column and report are null. `max_rows` has no effect any more.
    """
    texts = files.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    joined = diagnostics.join(texts, F.col(key) == F.col("__key"), "left").drop("__key")
    size = F.octet_length("__text")
    offset = F.least(F.col("start").cast("long"), size.cast("long")).cast("int")
    before = F.when(F.col("start") >= 0, F.substring(F.col("__text").cast("binary"), F.lit(1), offset).cast("string"))
    ends = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit("")))
    last = F.octet_length(F.substring_index(before, "\n", -1))
    places = joined.withColumns({"line": (ends + 1).cast("long"), "col": (last + 1).cast("long")}).drop("__text")
    report = F.format_string("%s:%d:%d: %s: %s [%s]", F.col(key).cast("string"), "line", "col", "severity", "message", "code")
    return places.withColumn("report", F.when(F.col("line").isNotNull(), report))


def builtin_signatures(spark: SparkSession) -> DataFrame:
    rows = [(n, least, args, result) for n, (least, args, result) in m.BUILTINS.items()]
    return spark.createDataFrame(rows, "name string, min_arity int, arg_masks array<bigint>, return_mask bigint")


def operator_signatures(spark: SparkSession) -> DataFrame:
    rows = [(op, left, right) for op, (left, right, _) in m.OPERATORS.items()]
    return spark.createDataFrame(rows, "name string, left_mask bigint, right_mask bigint")


def check_signatures(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """Arity and argument type diagnostics of call facts.

    `calls` has one row per argument (call_id, name, n_args, arg_no from 0, mask, var) and
    one row with null `arg_no` for a call without arguments. A call with too few
    arguments gives one arity row and no type rows. Unknown names are not checked.
    """
    known = calls.join(signatures.select("name", "min_arity", "arg_masks"), "name")
    short = F.col("n_args") < F.col("min_arity")
    expected = F.element_at("arg_masks", F.least(F.col("arg_no") + 1, F.size("arg_masks")))
    wrong = ~m.satisfies(F.col("mask"), expected)
    first = F.coalesce("arg_no", F.lit(0)) == 0
    code = F.when(short & first, "arity-mismatch").when(~short & F.col("arg_no").isNotNull() & wrong, "type-mismatch")
    arity_text = F.format_string("call to %s: expected at least %d argument(s), got %d", "name", "min_arity", "n_args")
    type_text = F.format_string(
        "call to %s: argument %d expects %s, got %s",
        F.col("name"), F.col("arg_no") + 1, m.mask_name(expected), m.mask_name(F.col("mask")),
    )
    hint = F.when(F.col("code") == "type-mismatch", m.guard_suggestion(F.coalesce("var", F.lit("")), F.col("mask"), expected))
    return known.withColumn("code", code).where(F.col("code").isNotNull()).select(
        "call_id",
        F.when(F.col("code") == "type-mismatch", F.col("arg_no")).alias("arg_no"),
        "code",
        F.lit("error").alias("severity"),
        F.when(F.col("code") == "type-mismatch", type_text).otherwise(arity_text).alias("message"),
        F.coalesce(hint, F.lit("")).alias("suggestion"),
    )


def check_operands(operands: DataFrame, signatures: DataFrame) -> DataFrame:
    """Coercion diagnostics of operand facts (op_id, name, side left|right, mask)."""
    known = operands.join(signatures, "name").withColumn(
        "expected", F.when(F.col("side") == "left", F.col("left_mask")).otherwise(F.col("right_mask"))
    )
    wrong = (F.col("mask") != m.UNKNOWN) & (F.col("expected") != m.ANY) & ~m.satisfies(F.col("mask"), F.col("expected"))
    text = F.format_string(
        '%s operand of "%s": expected %s, got %s', "side", "name", m.mask_name(F.col("expected")), m.mask_name(F.col("mask"))
    )
    severity = F.when(F.col("name").isin(m.NUMERIC_COMPARISONS), "warning").otherwise("error")
    return known.where(wrong).select(
        "op_id", "side", F.lit("coercion-mismatch").alias("code"), severity.alias("severity"), text.alias("message")
    )


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def merge_branch_masks(branches: DataFrame, prior: DataFrame, key: Sequence[str] = ("file_id", "var")) -> DataFrame:
    """Join of masks over the branches of a statement; without an else the mask before joins in.

    `branches` has key, mask and has_else; `prior` has key and mask.
    """
    open_keys = branches.where(~F.col("has_else")).select(*key).distinct()
    before = prior.join(open_keys, list(key), "left_semi")
    rows = branches.select(*key, "mask").unionByName(before.select(*key, "mask"))
    return rows.groupBy(*key).agg(F.bit_or("mask").alias("mask"))


def infer_parameter_masks(constraints: DataFrame, key: Sequence[str] = ("file_id", "sub", "param")) -> DataFrame:
    """Meet of the masks that the uses of a parameter ask for; Any means unknown."""
    meet = F.bit_and("mask").bitwiseAND(m.bits(m.ANY))
    return constraints.groupBy(*key).agg(F.when(meet == m.ANY, m.bits(m.UNKNOWN)).otherwise(meet).alias("mask"))


def narrow_masks(facts: DataFrame) -> DataFrame:
    """Adds `narrowed` and `changed` for guard facts (mask, guard, ref_type, negated)."""
    mask, changed = m.narrowed(F.col("mask"), F.col("guard"), F.col("ref_type"), F.col("negated"))
    return facts.withColumn("narrowed", mask).withColumn("changed", changed)


def suggest_guards(facts: DataFrame) -> DataFrame:
    """Adds `suggestion` for facts (var, mask, expected): the guard that would make them fit."""
    return facts.withColumn("suggestion", m.guard_suggestion(F.col("var"), F.col("mask"), F.col("expected")))


def mask_in_context(mask: Column, context: Column) -> Column:
    """Mask of a value in scalar, list or void context; null where void discards it."""
    return F.when(context == "scalar", m.in_scalar_context(mask)).when(context != "void", mask)
