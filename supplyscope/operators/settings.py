"""Layered settings as long tables: merging, conflicts, differences, templates, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.operators.graph import topological_levels
from supplyscope.plans.ordered import first_in_group
from supplyscope.plans.shared import Stage, settle

# fixed values: layers from weakest to strongest
LAYERS = ("default", "system", "user", "project")


def precedence(column: Column, order: Sequence[str]) -> Column:
    """Place of a name in `order`, from 1; null for other names."""
    return F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), column).cast("int"), F.lit(0))


def is_unset(value: Column, kind: Column | None = None) -> Column:
    """Nulls and empty strings, and zero for ints; booleans always count as set."""
    empty = value.isNull() | (value == "")
    return empty if kind is None else empty | ((kind == "int") & (value == "0"))


def merge_layers(
    rows: DataFrame,
    key: Sequence[str] = ("setting_key",),
    value: str = "val",
    layers: Sequence[str] = LAYERS,
    kind: str | None = None,
    empty_overrides: bool = False,
) -> DataFrame:
    """Effective value of each key and the layer that gave it.

    Map settings are merged key by key when their entries are rows and the map key is part
    of `key`; for those an empty text is a value too (`empty_overrides`).
    """
    rank = precedence(F.col("layer"), layers)
    given = rows.where(rank.isNotNull())
    if not empty_overrides:
        given = given.where(~is_unset(F.col(value), F.col(kind) if kind else None))
    best = given.groupBy(*key).agg(F.max_by(F.struct(value, "layer"), rank).alias("b"))
    return best.select(*key, F.col(f"b.{value}").alias(value), F.col("b.layer").alias("source"))


def merge_array_layers(
    rows: DataFrame,
    key: Sequence[str] = ("setting_key",),
    value: str = "vals",
    layers: Sequence[str] = LAYERS,
    append: bool = False,
) -> DataFrame:
    """Array settings: the strongest layer's array, or all arrays joined without repeats."""
    each = [F.max(F.when(F.col("layer") == layer, F.col(value))).alias(f"l{i}") for i, layer in enumerate(layers)]
    wide = rows.groupBy(*key).agg(*each)
    columns = [F.col(f"l{i}") for i in range(len(layers))]
    if append:
        nothing = F.array().cast(rows.schema[value].dataType)
        merged = F.array_distinct(F.concat(*[F.coalesce(c, nothing) for c in columns]))
    else:
        merged = F.coalesce(*reversed(columns))
    return wide.select(*key, merged.alias(value))


def replace_map_layers(
    rows: DataFrame, key: Sequence[str] = ("setting_key",), layers: Sequence[str] = LAYERS
) -> DataFrame:
    """Map settings under the replace strategy: all entries of the strongest layer that has the map.

    `rows` has one row per map entry; the map key and value columns are kept as they are.
    """
    ranked = rows.withColumn("__rank", precedence(F.col("layer"), layers)).where(F.col("__rank").isNotNull())
    top = ranked.groupBy(*key).agg(F.max("__rank").alias("__rank"))
    return ranked.join(top, [*key, "__rank"], "left_semi").select(rows.columns)


def resolve_precedence(
    candidates: DataFrame, order: Sequence[str], entity: Sequence[str] = ("entity",), source: str = "source", value: str = "value"
) -> DataFrame:
    """First non-empty candidate of each entity in the source order, with its source."""
    rank = precedence(F.col(source), order)
    given = candidates.where(rank.isNotNull() & ~is_unset(F.col(value)))
    best = given.groupBy(*entity).agg(F.min_by(F.struct(value, source), rank).alias("b"))
    return best.select(*entity, "b.*")


def layer_conflicts(
    rows: DataFrame,
    target: str,
    source: str,
    key: Sequence[str] = ("setting_key",),
    value: str = "val",
    kind: str | None = None,
) -> DataFrame:
    """Keys that two layers set to different values; the source layer wins."""
    kinds = [kind] if kind else []

    def of(layer: str, name: str) -> DataFrame:
        return rows.where(F.col("layer") == layer).select(*key, *kinds, F.col(value).alias(name))

    both = of(target, "target_value").join(of(source, "source_value").drop(*kinds), list(key))
    set_both = ~is_unset(F.col("target_value"), F.col(kind) if kind else None) & ~is_unset(
        F.col("source_value"), F.col(kind) if kind else None
    )
    if kind:
        set_both = set_both | (F.col(kind) == "bool")
    differ = both.where(set_both & (F.col("target_value") != F.col("source_value")))
    return differ.withColumn("resolution", F.lit("source overrides target")).drop(*kinds)


def diff_tables(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Added, removed and changed keys between two versions of a table."""
    old = a.select(*key, F.col(value).alias("old_value"), F.lit(True).alias("__a"))
    new = b.select(*key, F.col(value).alias("new_value"), F.lit(True).alias("__b"))
    both = old.join(new, list(key), "full_outer")
    change = (
        F.when(F.col("__a").isNull(), "added")
        .when(F.col("__b").isNull(), "removed")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull()).drop("__a", "__b")


# fixed value: nesting allowed in templates
MAX_DEPTH = 10
#: braces nested deeper than this inside one reference count as unclosed
MAX_BRACES = 40


def _reference_pattern(levels: int = MAX_BRACES) -> str:
    """A `${…}` with its own closing brace; possessive, so a text is read once and never backtracked."""
    inside = "[^{}]*+"
    for _ in range(levels):
        inside = rf"[^{{}}]*+(?:\{{{inside}\}}[^{{}}]*+)*+"
    return rf"\$\{{{inside}\}}"


def _pieces(text: Column) -> Column:
    """Array of (idx, text, name, fallback): literals at even places, references at odd ones.

    A reference that is never closed makes the rest of the text a literal.
    """
    closed = _reference_pattern()
    either = rf"(?s){closed}|\$\{{.*"
    between = F.split(text, either, -1)
    found = F.regexp_extract_all(text, F.lit(either), F.lit(0))
    inner = lambda x: F.substring(x, F.lit(3), F.length(x) - 3)
    name = lambda x: F.regexp_replace(F.substring_index(inner(x), ":-", 1), r"^\s+|\s+$", "")
    fallback = lambda x: F.when(F.locate(":-", x) > 0, F.regexp_replace(inner(x), "(?s)^.*?:-", ""))
    is_closed = lambda x: x.rlike(f"(?s)^{closed}$")
    literals = F.transform(
        between, lambda x, i: F.struct((2 * i).alias("idx"), x.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("fallback"))
    )
    references = F.transform(
        found, lambda x, i: F.struct((2 * i + 1).alias("idx"), x.alias("text"), F.when(is_closed(x), name(x)).alias("name"), F.when(is_closed(x), fallback(x)).alias("fallback"))
    )
    return F.filter(F.concat(literals, references), lambda p: (p["idx"] == 0) | (p["text"] != ""))


#: longest expansion; a longer one is an error
MAX_TEXT = 10_000_000


def expand_templates(df: DataFrame, column: str, variables: DataFrame, max_depth: int = MAX_DEPTH, max_text: int = MAX_TEXT) -> DataFrame:
    """Adds `expanded` and `error` for `${NAME}` and `${NAME:-default}` in a text column.

    Every distinct template, value and default is cut once into literals and references, a row for each. Names get
    levels, those without references first, and each is put together once from the finished texts of the names in it, so ten levels
    of `${x}${x}` are ten rows of work. Sizes are added up before texts: one of more than `max_text` characters is never made.

    Unset variables without a default become empty; a name inside itself or more than `max_depth`
    names around a text is an error, and the leftmost error of a template is the one reported. Only templates that meet such names
    are walked name by name to find it.
    """
    given = settle(variables.where(F.coalesce("value", F.lit("")) != "").groupBy("name").agg(F.max("value").alias("value")))
    texts = df.select(F.col(column).alias("text")).where(F.col(column).isNotNull()).distinct()
    templates = settle(texts.select(F.sha2("text", 256).alias("template"), "text"))
    pieces, levels = _cut_texts(templates, given)
    fits = settle(levels.where(F.col("level") < max_depth))
    owner = F.when(F.col("kind") != "template", F.col("name"))
    leveled = pieces.withColumn("owner", owner).join(fits.select(F.col("name").alias("owner"), "level"), "owner", "left")
    bad = pieces.where("kind = 'template' and target_name is not null").join(fits.select(F.col("name").alias("target_name")), "target_name", "left_anti")
    lost = settle(bad.select(F.col("node").alias("template")).distinct())

    made = Stage(df.sparkSession)
    deepest = fits.agg(F.max("level")).first()[0]
    made.add(_assembled(pieces.limit(0), None, max_text))
    for level in range(-1 if deepest is None else deepest + 1):
        made.add(_assembled(leveled.where(F.col("level") == level), made.all(), max_text))
    top = pieces.where("kind = 'template'").join(lost.withColumnRenamed("template", "node"), "node", "left_anti")
    done = _assembled(top, made.all(), max_text).select(F.col("node").alias("template"), F.col("text").alias("expanded"), "error")
    rest = templates.join(lost, "template", "left_semi")
    if not rest.isEmpty():
        done = done.unionByName(_walked(rest, given, max_depth))
    return df.withColumn("template", F.sha2(column, 256)).join(done, "template", "left").drop("template")


def _cut_texts(templates: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, levels): the pieces of every template, value and default, and the level of each name.

    A piece has the `node` it belongs to, `idx`, its literal `text` or the `target` node and `target_name` of its reference.
    """
    rounds = Stage(templates.sparkSession)
    set_names = given.select(F.col("name").alias("ref"), F.lit(True).alias("is_set"))
    start = templates.select(F.col("template").alias("node"), F.lit("template").alias("kind"), F.lit(None).cast("string").alias("name"), "text")
    front = start.unionByName(given.select(F.concat(F.lit("v:"), "name").alias("node"), F.lit("value").alias("kind"), "name", F.col("value").alias("text")))
    while True:
        cut = front.select("node", "kind", "name", F.explode(_pieces(F.col("text"))).alias("p"))
        cut = cut.select("node", "kind", "name", "p.idx", "p.text", F.col("p.name").alias("ref"), "p.fallback").join(set_names, "ref", "left")
        by_default = F.concat(F.lit("d:"), "ref", F.lit(":"), F.sha2(F.coalesce("fallback", F.lit("")), 256))
        target = F.when(F.col("is_set"), F.concat(F.lit("v:"), "ref")).when(F.col("ref").isNotNull(), by_default)
        opens = F.col("ref").isNotNull() & F.col("is_set").isNull()
        rows, seen = rounds.add_counted(
            cut.select("node", "kind", "name", "idx", "text", target.alias("target"), F.col("ref").alias("target_name"), F.when(opens, F.coalesce("fallback", F.lit(""))).alias("inner")),
            inner=F.count("inner"),
        )
        if not seen["inner"]:
            break
        fresh = rows.where("inner is not null").select(F.col("target").alias("node"), F.lit("default").alias("kind"), F.col("target_name").alias("name"), F.col("inner").alias("text"))
        known = rounds.all().select("node").distinct()
        front = fresh.distinct().join(known, "node", "left_anti")
        if front.isEmpty():
            break
    pieces = rounds.all().drop("inner")
    # names by what they refer to; a name with several defaults is taken for all of them
    within = pieces.where("kind <> 'template' and target_name is not null").select(F.col("name").alias("src"), F.col("target_name").alias("dst"))
    names = pieces.select("name").union(pieces.select("target_name")).where("name is not null").distinct()
    levels = topological_levels(names.withColumnRenamed("name", "node"), within).where("not leftover")
    return pieces, settle(levels.select(F.col("node").alias("name"), "level"))


def _assembled(pieces: DataFrame, made: DataFrame | None, max_text: int) -> DataFrame:
    """(node, text, size, error) of the nodes of `pieces` from the finished texts `made`."""
    if made is None:
        made = pieces.select("node", "text", F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("error"))
    inner = made.select(F.col("node").alias("target"), F.col("size").alias("inner_size"), F.col("error").alias("inner_error"))
    length = F.when(F.col("target").isNull(), F.char_length("text")).otherwise(F.coalesce("inner_size", F.lit(0)))
    sized = pieces.join(inner, "target", "left").groupBy("node").agg(
        F.sum(length.cast("long")).alias("size"),
        F.min(F.when(F.col("inner_error").isNotNull(), F.struct("idx", "inner_error")))["inner_error"].alias("inner_error"),
    )
    error = F.coalesce("inner_error", F.when(F.col("size") > max_text, F.lit("expansion too long")))
    judged = sized.select("node", "size", error.alias("error"))
    sound = pieces.join(judged.where("error is null").select("node"), "node", "left_semi")
    filled = sound.join(made.select(F.col("node").alias("target"), F.col("text").alias("inner")), "target", "left")
    text = F.when(F.col("target").isNull(), F.col("text")).otherwise(F.coalesce("inner", F.lit("")))
    parts = filled.select("node", "idx", text.alias("text")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("parts"))
    joined = parts.select("node", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
    return judged.join(joined, "node", "left").select("node", "text", "size", "error")


def _walked(templates: DataFrame, given: DataFrame, max_depth: int) -> DataFrame:
    """(template, expanded, error) by following every reference on its own, with the names around it as its path."""
    nothing = F.array()
    current = templates.select("template", nothing.cast("array<int>").alias("place"), nothing.cast("array<string>").alias("path"), "text")
    rounds = Stage(templates.sparkSession)
    too_deep = F.size("path") > max_depth
    whole = F.array(F.struct(F.lit(0).alias("idx"), F.lit("").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("fallback")))
    for _ in range(max_depth + 2):
        cut = current.withColumn("too_deep", too_deep).withColumn("p", F.explode(F.when(too_deep, whole).otherwise(_pieces(F.col("text")))))
        error = F.when(F.col("too_deep"), "depth exceeded").when(
            F.array_contains("path", F.col("p.name")), F.concat(F.lit("circular reference: "), F.col("p.name"))
        )
        place = F.concat("place", F.array("p.idx")).alias("place")
        known = rounds.add(cut.select("template", place, "path", "p.text", "p.name", "p.fallback", error.alias("error")))
        front = known.where(F.col("name").isNotNull() & F.col("error").isNull())
        if front.isEmpty():
            break
        inside = F.concat("path", F.array("name")).alias("path")
        current = front.join(given, "name", "left").select("template", "place", inside, F.coalesce("value", "fallback", F.lit("")).alias("text"))
    closed = rounds.all().where(F.col("name").isNull() | F.col("error").isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct("place", "text")))
    done = closed.groupBy("template").agg(
        ordered.alias("parts"), F.min(F.when(F.col("error").isNotNull(), F.struct("place", "error")))["error"].alias("error")
    )
    joined = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    return done.select("template", F.when(F.col("error").isNull(), joined).alias("expanded"), "error")


# fixed values: words that mark a secret, and the length up to which nothing of it is shown
SECRET_WORDS = ("PASSWORD", "SECRET", "KEY", "TOKEN", "API_KEY")
HIDE_ALL = 8


def mask_sensitive(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    text = F.col(value)
    secret = F.upper(name).rlike("|".join(SECRET_WORDS))
    hidden = F.when(F.length(text) <= HIDE_ALL, "***").otherwise(
        F.concat(F.substring(text, 1, 2), F.lit("***"), F.substring(text, -2, 2))
    )
    return df.withColumn(value, F.when(secret, hidden).otherwise(text))


def _fits_pattern(text: Column, pattern: Column) -> Column:
    path = text.startswith("/") | text.contains("$") | (F.substring(text, 2, 1) == ":") | text.startswith("\\\\")
    return (
        F.when(pattern == "url", text.rlike("^https?://"))
        .when(pattern == "memory", text.rlike("[KMGT]B$"))
        .when(pattern == "version", text.isin("latest", "stable") | text.rlike(r"^[+-]?\d+(\.[+-]?\d+){1,2}$"))
        .when(pattern == "path", path & (text != ""))
        .otherwise(True)
    )


def duration_seconds(text: Column) -> Column:
    """Whole seconds of texts such as 90, 30s, 5m, 1h, 250ms."""
    number = F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)(ms|s|m|h)?$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)(ms|s|m|h)?$", 2)
    size = F.when(unit == "ms", 0.001).when(unit == "m", 60.0).when(unit == "h", 3600.0).otherwise(1.0)
    return (number * size).cast("long")


def validate_rows(rows: DataFrame, rules: DataFrame, entity: str = "entity") -> DataFrame:
    """Violations (entity, key, violation) of a rule table.

    `rows` has (entity, key, val); `rules` has (key, required, type, allowed, min, max, pattern)
    with one row per key. A required key is missing where the entity has no row of it, or only null
    values; an entity with nothing but nulls misses them all.
    """
    val, kind = F.col("val"), F.col("type")
    number = F.when(kind == "int", val.try_cast("long")).when(kind == "duration", duration_seconds(val))
    wrong_type = (kind.isin("int", "duration") & number.isNull()) | ((kind == "bool") & ~val.isin("true", "false"))
    has_list = F.size(F.coalesce("allowed", F.array().cast("array<string>"))) > 0
    checks = {
        "type": wrong_type,
        "allowed": kind.isin("string", "int") & has_list & ~F.array_contains("allowed", val),
        "min": number < F.col("min"),
        "max": number > F.col("max"),
        "pattern": (kind == "string") & (F.coalesce("pattern", F.lit("")) != "") & ~_fits_pattern(val, F.col("pattern")),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    found = rows.join(rules, "key").select(entity, "key", F.explode(broken).alias("violation"))
    needed = rules.where("required").select("key")
    wanted = needed.agg(F.array_sort(F.collect_set("key")))
    present = rows.join(needed.withColumn("__need", F.lit(True)), "key", "left")
    # at most as many keys per entity as there are required rules
    have = present.groupBy(entity).agg(F.collect_set(F.when(F.col("__need") & val.isNotNull(), F.col("key"))).alias("have"))
    missing = have.select(entity, F.explode(F.array_except(wanted.scalar(), "have")).alias("key"))
    return found.unionByName(missing.withColumn("violation", F.lit("required")))


def merge_named_records(target: DataFrame, source: DataFrame, name: Sequence[str] = ("name",), order: str | None = None) -> DataFrame:
    """List merge by name: records of `source` replace those of the same name, others stay.

    With `order`, the record of `source` with the highest value counts if a name repeats.
    """
    newest = source
    if order is not None:
        newest = first_in_group(source, list(name), [F.col(order).desc()])
    kept = target.join(newest.select(*name), list(name), "left_anti")
    return kept.unionByName(newest.select(*target.columns))

