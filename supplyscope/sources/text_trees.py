"""Source trees in, lock texts out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: extensions of source files
EXTENSIONS = ("pl", "pm", "t")


def read_source_tree(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, text_end: str | None = None) -> DataFrame:
    """(path, text) of the files below `root` with one of the extensions, in any case.

    Other files are left out when the folders are listed, before anything is read. With `text_end`, a character, a file holds any
    number of texts that end with it, a row for each; such a file is read in splits by many tasks.
    """

    def any_case(word: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)

    wanted = "*.{" + ",".join(any_case(e.lstrip(".")) for e in extensions) + "}"
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", wanted)
    files = reader.text(root, lineSep=text_end) if text_end else reader.text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


# fixed value: first line of a lock text
LOCK_HEADER = "# carton snapshot format v1.0"


def lock_lines(modules: DataFrame, generated: str, project: str = "project") -> DataFrame:
    """The lines of one lock text per project, with the columns that order them.

    `modules` has (project, interpreter, dist, pathname, section, module, version), as the
    lock parser gives them.
    """
    blank, zero = F.lit(""), F.lit(0)

    def lines(df: DataFrame, dist: Column, part: Column, module: Column, text: Column) -> DataFrame:
        return df.select(project, dist.alias("dist"), part.cast("int").alias("part"), module.alias("module"), text.alias("line"))

    projects = modules.groupBy(project).agg(F.max("interpreter").alias("interpreter"))
    perl = F.when(F.col("interpreter").isNotNull(), F.concat(F.lit("# Perl version: "), "interpreter"))
    head = F.array_compact(F.array(F.lit(LOCK_HEADER), F.lit(f"# Generated on {generated}"), perl, F.lit("DISTRIBUTIONS")))
    top = projects.select(project, F.posexplode(head).alias("no", "text"))
    dists = modules.groupBy(project, "dist").agg(F.max("pathname").alias("pathname"))
    place = F.coalesce("pathname", blank)
    name_and_path = F.array(F.concat(F.lit("  "), "dist"), F.concat(F.lit("    pathname: "), place))
    opened = dists.select(project, "dist", F.posexplode(name_and_path).alias("no", "text"))
    rank = F.when(F.col("section") == "provides", 2).otherwise(4)
    listed = modules.where(F.col("section").isNotNull())
    heads = listed.select(project, "dist", "section").distinct()
    return (
        lines(top, blank, F.col("no"), blank, F.col("text"))
        .unionByName(lines(opened, F.col("dist"), F.col("no"), blank, F.col("text")))
        .unionByName(lines(heads, F.col("dist"), rank, blank, F.concat(F.lit("    "), "section", F.lit(":"))))
        .unionByName(
            lines(listed, F.col("dist"), rank + 1, F.col("module"), F.concat(F.lit("      "), "module", F.lit(" "), "version"))
        )
        .unionByName(lines(dists, F.col("dist"), zero + 9, blank, blank))
    )


def write_lock_text(lines: DataFrame, path: str, project: str = "project") -> None:
    """One folder `project=…` per project with its lock text.

    Lines are range partitioned by project and distribution and sorted, never gathered: the text of a
    very large project is split over several files in name order, and never inside a distribution.
    """
    order = [project, "dist", "part", "module"]
    lines.repartitionByRange(project, "dist").sortWithinPartitions(*order).select(project, "line").write.partitionBy(project).text(path)


def read_lock_text(spark: SparkSession, path: str) -> DataFrame:
    """(project, text) of the folders that `write_lock_text` made, one row per file.

    The interpreter's line stands in a project's first file only; the others get it in front.
    """
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    own = F.nullif(F.regexp_extract("text", r"(?m)^# Perl version: (.*)$", 1), F.lit(""))
    perl = files.groupBy(F.col("project").alias("__project")).agg(F.max(own).alias("__perl"))
    met = files.join(perl, F.col("project").eqNullSafe(F.col("__project")), "left")
    line = F.concat(F.lit("# Perl version: "), F.col("__perl"), F.lit("\n"))
    return met.select("project", F.when(own.isNull() & F.col("__perl").isNotNull(), F.concat(line, "text")).otherwise(F.col("text")).alias("text"))
