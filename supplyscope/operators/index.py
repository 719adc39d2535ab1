"""The package index: flattening documents, search, name resolution, listings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations, groupby
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.facts import CORE_PACKAGES, DISTRIBUTION_PREFIXES, PRAGMAS
from supplyscope.operators.versions import newest_row
from supplyscope.plans.ordered import first_in_group
from supplyscope.plans.shared import settle

# the parts of an index document that the operators read
DOCUMENT = """
name string, version string, author string, abstract string, description string, distribution string, download_url string,
date string, status string, module array<struct<name:string,version:string,indexed:boolean>>,
metadata struct<license:array<string>>,
resources struct<repository:struct<url:string,web:string>,bugtracker:struct<web:string>,homepage:string>,
dependency array<struct<phase:string,module:string,requires:string>>,
stats struct<pass:bigint,fail:bigint,na:bigint,unknown:bigint>, stats_recent struct<downloads_30d:bigint>
"""
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def _filled(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def rfc3339(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def flatten_package_metadata(docs: DataFrame, requested: str = "requested", json: str = "doc") -> DataFrame:
    """One flat row per index document, with the fallbacks for name, version and links."""
    read = docs.select(F.col(requested).alias("requested"), F.from_json(json, DOCUMENT).alias("d"))
    indexed = F.filter("d.module", lambda x: F.coalesce(x["indexed"], F.lit(False)) & (F.coalesce(x["name"], F.lit("")) != ""))
    primary = F.coalesce(F.get(indexed, F.lit(0)), F.get("d.module", F.lit(0)))
    name = _filled(F.col("p.name"), F.col("requested"))
    is_dist = F.col("__name").contains("-") & ~F.col("requested").contains("-")
    passed, failed = F.coalesce("d.stats.pass", F.lit(0)), F.coalesce("d.stats.fail", F.lit(0))
    rating = F.when(passed + failed > 0, passed / (passed + failed) * 5.0).otherwise(F.lit(0.0))
    return (
        read.withColumn("p", primary)
        .withColumn("__name", name)
        .select(
            "requested",
            F.when(is_dist, F.col("requested")).otherwise(F.col("__name")).alias("name"),
            _filled(F.col("p.version"), F.col("d.version")).alias("version"),
            F.col("d.author").alias("author"),
            F.col("d.abstract").alias("abstract"),
            F.col("d.description").alias("description"),
            F.col("d.distribution").alias("distribution"),
            F.col("d.version").alias("distribution_version"),
            F.col("d.download_url").alias("distribution_file"),
            F.array_join("d.metadata.license", ", ").alias("license"),
            _filled(F.col("d.resources.repository.url"), F.col("d.resources.repository.web")).alias("repository"),
            _filled(F.col("d.resources.homepage")).alias("homepage"),
            _filled(F.col("d.resources.bugtracker.web")).alias("bugtracker"),
            rfc3339(F.col("d.date")).alias("released"),
            rating.alias("rating"),
            (passed > 0).alias("has_tests"),
            F.coalesce("d.stats_recent.downloads_30d", F.lit(0)).alias("downloads"),
        )
    )


def explode_dependencies(docs: DataFrame, package: str = "requested", json: str = "doc") -> DataFrame:
    """Dependency edges of index documents, without empty names."""
    only = "dependency array<struct<phase:string,module:string,requires:string>>"
    deps = F.filter(F.from_json(json, only)["dependency"], lambda d: F.coalesce(d["module"], F.lit("")) != "")
    return docs.select(F.col(package).alias("package"), F.explode(deps).alias("d")).select(
        "package",
        F.col("d.module").alias("dep"),
        F.col("d.requires").alias("constraint"),
        F.col("d.phase").alias("phase"),
        F.lit("requires").alias("type"),
    )


# fixed values: points and limits of the document search
NAME_POINTS, DESCRIPTION_POINTS, MAX_MATCHES, MAX_TEXT, CUT = 10, 5, 5, 100, 97


def search_documents(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Top documents (id, name, description, text) that contain `query`, ignoring case."""
    if not query.strip():
        raise ValueError("the query must not be empty")
    wanted = query.strip().lower()

    def has(column: Column) -> Column:
        return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(wanted))

    in_name, in_description = has(F.col("name")), has(F.col("description"))
    hits = docs.where(in_name | in_description | has(F.col("text")))

    def shown(item: Column) -> Column:
        text = F.format_string("Line %d: %s", item["no"], F.btrim(item["row"], F.lit(" \t\r\f")))
        return F.when(F.length(text) > MAX_TEXT, F.concat(F.substring(text, 1, CUT), F.lit("..."))).otherwise(text)

    numbered = F.transform(F.split("text", "\n"), lambda row, i: F.struct((i + 1).alias("no"), row.alias("row")))
    found = F.filter(numbered, lambda item: has(item["row"]))
    head = F.array_compact(
        F.array(
            F.when(in_name, F.concat(F.lit("Name: "), "name")),
            F.when(in_description, F.concat(F.lit("Description: "), "description")),
        )
    )
    lines = F.slice(F.col("found"), F.lit(1), F.lit(MAX_MATCHES) - F.size("head"))
    points = F.when(in_name, NAME_POINTS).otherwise(0) + F.when(in_description, DESCRIPTION_POINTS).otherwise(0)
    scored = hits.withColumn("head", head).withColumn("found", found)
    return (
        scored.select(
            "id",
            (points + F.size(lines)).alias("score"),
            F.concat("head", F.transform(lines, shown)).alias("matches"),
        )
        .orderBy(F.col("score").desc(), "id")
        .limit(limit)
    )


def list_by_category(docs: DataFrame, category: str | None = None) -> DataFrame:
    """Documents ordered by category and name, or those of one category by name."""
    if category is not None:
        return docs.where(F.col("category") == category).orderBy("name")
    return docs.orderBy("category", "name")


def categories(docs: DataFrame) -> DataFrame:
    return docs.select("category").distinct().orderBy("category")


# fixed value: default number of search results
DEFAULT_HITS = 20


def search_packages(index: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """Best scored index rows whose name or abstract contains `query`, with the total number."""
    size = limit if limit > 0 else DEFAULT_HITS
    wanted = F.lit(query.lower())
    hits = index.where(
        F.contains(F.lower("name"), wanted) | F.contains(F.lower(F.coalesce("abstract", F.lit(""))), wanted)
    )
    total = hits.agg(F.count(F.lit(1)))
    return (
        hits.select(
            "name", "version", "distribution", "author", "abstract", "score",
            (F.col("status") == "latest").alias("is_latest"),
            (F.coalesce("documentation", F.lit("")) != "").alias("has_documentation"),
            rfc3339(F.col("date")).alias("released"),
        )
        .orderBy(F.col("score").desc(), "name", "version")
        .limit(size)
        .withColumn("total", total.scalar())
    )


def find_executables(files: DataFrame, tools: DataFrame, limit: int = 10) -> DataFrame:
    """Executable files whose name has the tool's name as a word, exact names first.

    Names are cut into words, so the match is an equality join; each word of a file meets
    at most one distinct tool.
    """
    runnable = files.where(F.col("executable") & ~F.col("directory"))
    words = F.array_distinct(F.concat(F.split(F.lower("name"), r"[^a-z0-9_]+"), F.array(F.lower(F.regexp_replace("name", r"\.pl$", "")))))
    spoken = runnable.withColumn("word", F.explode(F.filter(words, lambda w: w != "")))
    asked = tools.select("tool").distinct().withColumn("word", F.lower("tool"))
    tool_name = F.regexp_replace("name", r"\.pl$", "")
    found = spoken.join(asked, "word").select(
        "tool", F.col("name").alias("file_name"), tool_name.alias("tool_name"), "distribution", "author", "version", "abstract",
        (tool_name == F.col("tool")).alias("is_exact_match"),
    )
    order = [F.col("is_exact_match").desc(), F.col("file_name"), F.col("distribution"), F.col("version")]
    return first_in_group(found, ["tool"], order, limit)


def looks_explicit(name: Column) -> Column:
    """Package names and hyphenated distribution names, which need no lookup."""
    prefixes = "|".join(DISTRIBUTION_PREFIXES)
    return name.contains("::") | name.rlike(rf"^(?:{prefixes})(?:-[A-Z][A-Za-z0-9]*)+$")


def _titled(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), lambda w: F.initcap(w)), "-")


def resolve_names(
    names: DataFrame, config_map: DataFrame, builtin_map: DataFrame, executables: DataFrame, index: DataFrame
) -> DataFrame:
    """Package of each distinct tool name and the source of the answer.

    Each tier only sees the names that the tiers before it left open. The maps have
    (name, module); `executables` has (name, module, status); `index` has (module, status).
    Names without an answer come out with nulls.
    """
    asked = names.select("name").where(F.col("name") != "").distinct()
    latest = executables.where(F.col("status") == "latest")
    tiers = [(config_map, "config"), (builtin_map, "builtin"), (latest, "executable")]
    given = [
        t.where(F.col("module").isNotNull()).select("name", F.struct(F.lit(k).alias("tier"), "module", F.lit(source).alias("source")).alias("answer"))
        for k, (t, source) in enumerate(tiers)
    ]
    best = reduce(DataFrame.unionByName, given).groupBy("name").agg(F.min("answer").alias("answer"))
    explicit = looks_explicit(F.col("name"))
    # the later tiers are the costly ones: they get a written table of the names still open
    state = settle(
        asked.join(best, "name", "left").select(
            "name", F.when(explicit, F.col("name")).otherwise(F.col("answer.module")).alias("module"), F.when(explicit, "explicit").otherwise(F.col("answer.source")).alias("source")
        )
    )
    open_names = state.where(F.col("module").isNull()).select("name")
    title = _titled(F.col("name"))
    shapes = F.array(
        F.concat(F.lit("App::"), title), F.concat(F.lit("App::"), F.upper("name")), title, F.concat(F.lit("Perl::"), title)
    )
    known = index.where(F.col("status") == "latest").select("module").distinct()
    tried = open_names.select("name", F.posexplode(shapes).alias("shape", "module")).join(known, "module")
    patterned = settle(tried.groupBy("name").agg(F.min_by("module", "shape").alias("module")).withColumn("source", F.lit("pattern")))
    rest = open_names.join(patterned, "name", "left_anti")
    similar = fuzzy_match(rest, known).select("name", F.col("best").alias("module"), F.lit("fuzzy").alias("source"))
    late = patterned.unionByName(similar).withColumnsRenamed({"module": "__m", "source": "__s"})
    found = state.join(late, "name", "left")
    return found.select("name", F.coalesce("module", "__m").alias("module"), F.coalesce("source", "__s").alias("source"))


#: letters in a gram; shorter names use grams of their own length
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of `size` letters of a text."""
    places = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - size + 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def fuzzy_match(names: DataFrame, index: DataFrame, least: float = 0.5) -> DataFrame:
    """Most similar module that contains the name: 1 − edit distance / longer length.

    A module that contains a name contains all its grams, so one gram of the name is key enough: the one that the fewest
    modules have. Modules list their grams of `GRAM` letters, as many as the module is long. The distance is to the module's last
    `::` part, so a score above `least` bounds its length, and only modules with a last part that short list shorter grams
    for shorter names. Pairs outside those lengths or without the name inside go before any distance is taken.
    """
    asked = names.select(F.col("name"), F.lower("name").alias("low")).where(F.col("low") != "").distinct()
    modules = index.select("module").distinct().withColumn("lower_module", F.lower("module"))
    modules = modules.withColumn("last", F.substring_index("lower_module", "::", -1))
    short = [F.when(F.char_length("last") * least < n, _grams(F.col("lower_module"), n)) for n in range(1, GRAM)]
    listed = F.flatten(F.array_compact(F.array(*short, _grams(F.col("lower_module"), GRAM))))
    postings = settle(modules.select("module", "lower_module", "last", F.explode(listed).alias("gram")))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = asked.select("name", "low", F.explode(F.when(F.char_length("low") < GRAM, F.array("low")).otherwise(_grams(F.col("low"), GRAM))).alias("gram"))
    rarest = own.join(counts, "gram").groupBy("name", "low").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    n, m = F.char_length("low"), F.char_length("last")
    near = (F.least(n, m) > least * F.greatest(n, m)) & F.contains("lower_module", "low")
    pairs = rarest.join(postings, "gram").where(near)
    score = 1 - F.levenshtein("low", "last") / F.greatest(n, m)
    scored = pairs.select("name", "module", score.alias("score")).where(F.col("score") > least)
    best = first_in_group(scored, ["name"], [F.col("score").desc(), F.col("module")])
    return best.select("name", F.col("module").alias("best"), "score")


# fixed values: weights of the suggestion score
SAME_PLACE, SAME_LETTER = 0.7, 0.3


def suggestion_score(a: Column, b: Column) -> Column:
    """0.7 · letters at the same place + 0.3 · letters in common, both over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    shorter = F.least(F.length(a), F.length(b))
    placed = F.aggregate(
        F.sequence(F.lit(1), shorter),
        F.lit(0),
        lambda n, i: n + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 1).otherwise(0),
    )

    def times(text: Column, letter: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    shared = F.aggregate(
        F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")),
        F.lit(0),
        lambda n, c: n + F.least(times(a, c), times(b, c)),
    )
    score = placed / longer * SAME_PLACE + shared / longer * SAME_LETTER
    return F.when(shorter == 0, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(score)


#: (letters of a segment, letters that agree in it), from the choosiest to the one that always holds
SEGMENTS = ((6, 5), (6, 4), (6, 3), (3, 2), (4, 2), (6, 2), (1, 1))


def _agreeing(longer: int, share: float) -> int:
    """Least number of letters at the same place for a longer word of this length."""
    return floor(longer * share + 1e-9) + 1


#: longer words all follow the last plan
PLANNED = 256


def segment_plans(share: float) -> list[tuple[tuple[int, int], int, int | None]]:
    """(plan, shortest, longest) for ranges of the longer word's length: the first of `SEGMENTS` that two such words must meet.

    With letters equal at n places over s segments, some segment has n / s of them or more.
    """

    def holds(plan: tuple[int, int], longer: int) -> bool:
        return ceil(_agreeing(longer, share) / ceil(longer / plan[0])) >= plan[1]

    def holds_beyond(plan: tuple[int, int]) -> bool:
        width, agree = plan
        spare = share - (agree - 1) / width
        return agree == 1 or (spare > 0 and (agree - 1) * (width - 1) / width / spare <= PLANNED)

    each = [(n, next(p for p in SEGMENTS if holds(p, n))) for n in range(1, PLANNED + 1)]
    ranges = [(plan, [n for n, _ in some]) for plan, some in groupby(each, key=lambda x: x[1])]
    last = next(p for p in SEGMENTS if holds_beyond(p))
    return [(plan, lengths[0], lengths[-1]) for plan, lengths in ranges] + [(last, PLANNED + 1, None)]


def _keys_of_segment(letters: Column, size: Column, width: int, agree: int) -> Callable[[Column], Column]:
    """For the number of a segment its keys, null where a place lies behind the word."""
    choices = list(combinations(range(width), agree))

    def keys(segment: Column) -> Column:
        first = segment * width
        made = [
            F.when(first + choice[-1] < size, F.xxhash64(F.lit(width), F.lit(agree), F.lit(k), segment, *[F.get(letters, first + at) for at in choice]))
            for k, choice in enumerate(choices)
        ]
        return F.array(*made)

    return keys


def _segment_keys(word: Column, share: float) -> Column:
    """A key for each choice of places in each segment, with the letters there, for all plans that the word can need.

    A word takes part in pairs whose longer word has any length that its own letters can still satisfy. Keys carry the plan,
    so a word lists at most a fixed number of keys for each letter and plan.
    """
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    size = F.char_length(word)
    plans = segment_plans(share)
    lists = []
    for width, agree in sorted({plan for plan, *_ in plans}):
        needed = F.lit(False)
        for plan, low, high in plans:
            if plan == (width, agree):
                needed = needed | ((size >= _agreeing(low, share)) & (size <= high if high else F.lit(True)))
        lists.append(F.when(needed, F.flatten(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / width).cast("int")), _keys_of_segment(letters, size, width, agree)))))
    return F.array_distinct(F.array_compact(F.flatten(F.array_compact(F.array(*lists)))))


def similar_pairs(bad: DataFrame, words: DataFrame, share: float) -> DataFrame:
    """(name, word): the pairs that agree in a segment, among them all with more than `share` of the longer word's letters in place."""
    listed = words.select("word", F.explode(_segment_keys(F.col("word"), share)).alias("key"))
    asked = bad.select("name", F.explode(_segment_keys(F.col("name"), share)).alias("key"))
    shorter, longer = F.least(F.char_length("name"), F.char_length("word")), F.greatest(F.char_length("name"), F.char_length("word"))
    return asked.join(listed, "key").where(shorter > longer * share).select("name", "word").distinct()


def suggest_similar(bad_names: DataFrame, vocabulary: DataFrame, k: int = 3, least: float = 0.6) -> DataFrame:
    """The `k` most similar vocabulary words of each distinct name, scores above `least`.

    Letters in common are at most all of them, so a score above `least` needs more than
    (least − 0.3) / 0.7 of the longer word at the same place. Words are cut into segments, and words with so many letters
    in place agree in several letters of one segment: only those are joined, by segment, places and letters.
    """
    share = (least - SAME_LETTER) / SAME_PLACE
    if share <= 0:
        raise ValueError("the least score must be above the weight of letters in common")
    words = vocabulary.select("word").where(F.col("word") != "").distinct()
    bad = bad_names.select("name").where(F.col("name") != "").distinct()
    scored = similar_pairs(bad, words, share).withColumn("score", suggestion_score(F.col("name"), F.col("word"))).where(F.col("score") > least)
    return first_in_group(scored, ["name"], [F.col("score").desc(), F.col("word")], k)


def flag_core(df: DataFrame, name: str = "name", core: Sequence[str] = CORE_PACKAGES) -> DataFrame:
    return df.withColumn("is_core", F.col(name).isin(list(core)))


def drop_core(df: DataFrame, name: str = "name", core: Sequence[str] = CORE_PACKAGES, pragmas: bool = True) -> DataFrame:
    """Rows whose package is neither core nor, unless kept, a pragma."""
    gone = [*core, *(PRAGMAS if pragmas else [])]
    return df.where(~F.col(name).isin(gone))


def availability_split(wanted: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """The distinct wanted packages, with whether the index has them."""
    known = index.select(name).distinct().withColumn("__there", F.lit(True))
    joined = wanted.select(name).distinct().join(known, name, "left")
    return joined.select(name, F.col("__there").isNotNull().alias("available"))


def installed_listing(
    installed: DataFrame,
    pattern: str | None = None,
    include_core: bool = True,
    dev: bool = False,
    latest_only: bool = False,
    owner: Sequence[str] = ("project",),
    scheme: str = "dotted",
) -> DataFrame:
    """Installed packages (name, version, is_core, phase) after the listing filters, by name."""
    kept = installed
    if pattern:
        kept = kept.where(F.col("name").rlike(f"(?i){pattern}"))
    if not include_core:
        kept = kept.where(~F.col("is_core"))
    if not dev:
        kept = kept.where(F.col("phase") == "runtime")
    if latest_only:
        kept = newest_row(kept, [*owner, "name"], "version", scheme, tie=["phase"]).drop("ver_key")
    return kept.orderBy(*owner, "name", "version")

