"""Ordering, choosing and matching of package versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.version_keys import (
    constraint_bounds,
    is_stable,
    unpack_version,
    version_key,
    version_spot,
)
from supplyscope.plans.ordered import MAX_GROUP_ROWS, carry_forward, first_in_group, rank_in_group
from supplyscope.plans.shared import settle


def rank_versions(
    df: DataFrame,
    pkg: str = "package",
    ver: str = "version",
    scheme: str = "semver",
    tie: Sequence[str] = (),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds `ver_key` and `ver_rank` (1 = newest); strings that do not parse come last."""
    keyed = df.withColumn("ver_key", version_key(F.col(ver), scheme))
    order = [F.col("ver_key").desc_nulls_last(), F.col(ver).asc(), *[F.col(t).asc() for t in tie]]
    return rank_in_group(keyed, [pkg], order, "ver_rank", max_rows)


def newest_row(df: DataFrame, group: Sequence[str], ver: str, scheme: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row with the highest version of each group, with its `ver_key`."""
    keyed = df.withColumn("ver_key", version_key(F.col(ver), scheme))
    order = [F.col("ver_key").desc_nulls_last(), F.col(ver).asc(), *[F.col(t).asc() for t in tie]]
    return first_in_group(keyed, group, order)


def latest_per_package(
    df: DataFrame, pkg: str = "package", ver: str = "version", scheme: str = "semver", tie: Sequence[str] = ()
) -> DataFrame:
    """One row per package, the newest, with the number of distinct versions."""
    known = df.groupBy(pkg).agg(F.count_distinct(ver).alias("n_versions"))
    return newest_row(df, [pkg], ver, scheme, tie).drop("ver_key").join(known, pkg)


def package_versions(df: DataFrame, pkg: str = "package", ver: str = "version") -> DataFrame:
    """The distinct versions of each package, one per row (a package may have any number)."""
    return df.select(pkg, ver).distinct()


def outdated_packages(
    installed: DataFrame,
    index: DataFrame,
    owner: Sequence[str] = ("project",),
    pkg: str = "package",
    ver: str = "version",
    pattern: str | None = None,
    core: Sequence[str] | None = None,
    scheme: str = "dotted",
) -> DataFrame:
    """Installed packages for which the index has a strictly higher version."""
    wanted = installed
    if pattern:
        wanted = wanted.where(F.col(pkg).rlike(f"(?i){pattern}"))
        index = index.where(F.col(pkg).rlike(f"(?i){pattern}"))
    if core is not None:
        wanted = wanted.where(~F.col(pkg).isin(list(core)))
    have = newest_row(wanted.select(*owner, pkg, ver), [*owner, pkg], ver, scheme)
    offered = newest_row(index.select(pkg, ver), [pkg], ver, scheme)
    have = have.withColumnsRenamed({ver: "installed", "ver_key": "have_key"})
    offered = offered.withColumnsRenamed({ver: "latest", "ver_key": "index_key"})
    newer = have.join(offered, pkg).where(F.col("index_key") > F.col("have_key"))
    return newer.select(*owner, pkg, "installed", "latest")


def best_match(
    requests: DataFrame,
    available: DataFrame,
    group: Sequence[str] = ("package",),
    constraint: str = "constraint",
    ver: str = "version",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds `best` (highest version inside the constraint, or null) and `satisfiable`.

    A constraint set is an interval, so its best version is the last one below the
    upper bound, if that one is above the lower bound. That is a lookup of the
    predecessor: distinct versions and distinct upper bounds are sorted together per
    package and the last version is carried forward. No request meets every version,
    and each distinct constraint is parsed once.
    """
    group = list(group)
    # few distinct constraint texts, however many requests: each is parsed once. They are
    # written before the parsed form is filtered, or the filter would be pushed below the
    # distinct and parse every request.
    texts = requests.select(constraint).distinct().withColumn("__b", constraint_bounds(F.col(constraint)))
    parsed = settle(texts).where(F.col("__b").isNotNull())
    parsed = parsed.select(constraint, F.col("__b.lo").alias("__lo"), F.col("__b.hi").alias("__spot"))
    asked = settle(requests.select(*group, constraint).distinct().join(parsed, constraint))
    named = available.select(*group, F.col(ver).alias("__version")).distinct()
    spots = settle(named.withColumn("__spot", version_spot(F.col("__version"))))
    versions = spots.where(F.col("__spot").isNotNull()).groupBy(*group, "__spot").agg(F.min("__version").alias("__version"))
    ends = asked.select(*group, "__spot").distinct().withColumn("__version", F.lit(None).cast("string"))
    line = carry_forward(
        versions.unionByName(ends),
        group,
        ["__spot"],
        {"__found": F.when(F.col("__version").isNotNull(), F.struct("__spot", "__version"))},
        max_rows,
    )
    found = line.where(F.col("__version").isNull()).select(*group, "__spot", "__found")
    answers = (
        asked.join(found, [*group, "__spot"])
        .where(F.col("__found.__spot") > F.col("__lo"))
        .select(*group, constraint, F.col("__found.__version").alias("best"))
    )
    matched = requests.join(answers, [*group, constraint], "left")
    return matched.withColumn("satisfiable", F.col("best").isNotNull())


def match_status(matched: DataFrame, constraint: str = "constraint") -> DataFrame:
    """Adds `status` to the rows of `best_match`: matched, unsatisfiable, or invalid where the constraint does not parse.

    A null constraint is invalid. Only constraints without a match are parsed again.
    """
    broken = F.col(constraint).isNull() | constraint_bounds(F.col(constraint)).isNull()
    status = F.when(F.col("satisfiable"), "matched").when(broken, "invalid").otherwise("unsatisfiable")
    return matched.withColumn("status", status)


# fixed values: names that stand for a version
STABLE_ALIASES, DEV_ALIASES, SYSTEM_ALIAS = ("stable", "latest-stable", "latest"), ("dev", "latest-dev"), "system"


def resolve_aliases(
    names: DataFrame, aliases: DataFrame, releases: DataFrame, system: str | None = None, ver: str = "version", scheme: str = "triple"
) -> DataFrame:
    """(name, version, error) of each distinct name: an alias, with or without `@` before it, or a version.

    The user's `aliases` (name, version; of several the smallest version) come first, then the built-in ones: the newest stable release,
    the newest release at all, and `system`. Any other name with `@` is an error, without it it is the version itself.
    """
    asked = names.select("name").where(F.col("name").isNotNull()).distinct()
    marked = F.col("name").startswith("@")
    alias = F.when(marked, F.substring("name", F.lit(2), F.char_length("name"))).otherwise(F.col("name"))
    given = aliases.groupBy(F.col("name").alias("__alias")).agg(F.min("version").alias("__given"))
    key = version_key(F.col(ver), scheme)
    newest = releases.where(key.isNotNull()).agg(F.max_by(ver, key).alias("dev"), F.max_by(F.when(is_stable(F.col(ver)), F.col(ver)), F.when(is_stable(F.col(ver)), key)).alias("stable"))
    known = asked.withColumn("__alias", alias).join(given, "__alias", "left")
    built_in = (
        F.when(F.col("__alias").isin(*STABLE_ALIASES), newest.select("stable").scalar())
        .when(F.col("__alias").isin(*DEV_ALIASES), newest.select("dev").scalar())
        .when(F.col("__alias") == SYSTEM_ALIAS, F.lit(system))
    )
    special = F.col("__alias").isin(*STABLE_ALIASES, *DEV_ALIASES, SYSTEM_ALIAS)
    version = F.when(F.col("__given").isNotNull(), F.col("__given")).when(special, built_in).when(~marked, F.col("name"))
    error = F.when(F.col("__given").isNull() & marked & ~special, F.concat(F.lit("unknown version alias: "), "name")).when(
        F.col("__given").isNull() & special & built_in.isNull(), F.concat(F.lit("no version for "), "name")
    )
    return known.select("name", version.alias("version"), error.alias("error"))


def missing_requirements(
    reqs: DataFrame,
    installed: DataFrame,
    owner: Sequence[str] = ("project",),
    pkg: str = "package",
    constraint: str | None = None,
    ver: str = "version",
    interpreter: str = "perl",
) -> DataFrame:
    """Declared requirements that no installed package meets."""
    owner = list(owner)
    declared = reqs.where(F.col(pkg) != interpreter)
    if constraint is None:
        return declared.join(installed.select(*owner, pkg).distinct(), [*owner, pkg], "left_anti")
    matched = best_match(declared, installed, [*owner, pkg], constraint, ver)
    return matched.where(~F.col("satisfiable")).drop("best", "satisfiable")


def requirement_status(
    reqs: DataFrame, installed: DataFrame, owner: Sequence[str] = ("project",), pkg: str = "package", interpreter: str = "perl"
) -> DataFrame:
    """Per project: distinct required packages that are missing, and whether all are there."""
    owner = list(owner)
    declared = reqs.select(*owner, pkg).distinct()
    have = installed.select(*owner, pkg).distinct().withColumn("__there", F.lit(True))
    counted = F.col(pkg) != interpreter
    gone = F.count_if(counted & F.col("__there").isNull())
    return (
        declared.join(have, [*owner, pkg], "left")
        .groupBy(*owner)
        .agg(gone.alias("n_missing"), (gone == 0).alias("ok"))
    )


def select_channel_releases(
    releases: DataFrame, include_dev: bool = False, product: Sequence[str] = ()
) -> DataFrame:
    """Authorized releases with normalised versions; the newest row of each version."""
    kept = releases.where(F.col("authorized"))
    if not include_dev:
        kept = kept.where(F.col("maturity") == "released")
    kept = kept.withColumn("version", unpack_version(F.col("version"))).where(F.col("version") != "")
    if not include_dev:
        kept = kept.where(is_stable(F.col("version")))
    return first_in_group(kept, [*product, "version"], [F.col("date").desc(), F.col("maturity")])


def asset_matches(prefix: str, system: str, arch: str):
    """Asset names such as prefix-os-arch and prefix-1.2.0-os-arch.tar.gz."""
    name = F.col("name")
    return name.startswith(f"{prefix}-") & name.contains(f"-{system}-{arch}")


def pick_release(releases: DataFrame, assets: DataFrame, prefix: str, system: str, arch: str) -> DataFrame:
    """Per product the newest stable release with a fitting asset, else the newest pre-release."""
    fitting = assets.where(asset_matches(prefix, system, arch)).select("product", "tag")
    usable = releases.where(~F.col("draft")).join(fitting, ["product", "tag"], "left_semi")
    order = [F.col("prerelease").asc(), F.col("created_at").desc(), F.col("tag").asc()]
    return first_in_group(usable, ["product"], order)


def canonical_version_order(
    df: DataFrame,
    group: Sequence[str],
    ver: str = "version",
    tie: Sequence[str] = (),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds `pos`: versions that parse newest first, then the other strings alphabetically."""
    keyed = df.withColumn("__key", version_key(F.col(ver), "triple"))
    order = [F.col("__key").desc_nulls_last(), F.col(ver).asc(), *[F.col(t).asc() for t in tie]]
    return rank_in_group(keyed, group, order, "pos", max_rows).drop("__key")


# fixed values: tag forms, tried in this order
RELEASE_TAG = r"^v(\d+\.\d+(?:\.\d+)?(?:-RC\d+|_\d+)?)(?:-(\d+))?$"
FORK_TAG = r"^([a-z][a-z0-9-]*?)-(\d+\.\d+(?:\.\d+)?)$"


def classify_tags(tags: DataFrame, home_remote: str = "origin") -> DataFrame:
    """Tags that name a version: base version, fork, release number and display name."""
    tag = F.col("tag")
    upstream = tag.rlike(RELEASE_TAG)
    raw = F.when(upstream, F.regexp_extract(tag, RELEASE_TAG, 1)).otherwise(F.regexp_extract(tag, FORK_TAG, 2))
    spot = version_key(raw, "triple")
    fork = F.when(upstream, F.lit("")).otherwise(F.regexp_extract(tag, FORK_TAG, 1))
    number = F.when(upstream, F.regexp_extract(tag, RELEASE_TAG, 2).try_cast("int"))
    named = F.when(F.col("fork") == "", F.col("version")).otherwise(F.concat_ws("-", "fork", "version"))
    display = F.when(F.col("remote").isin("", home_remote), F.col("version")).otherwise(
        F.concat_ws("/", F.col("remote"), named)
    )
    return (
        tags.withColumn("__spot", spot)
        .where(F.col("__spot").isNotNull())
        .withColumn("version", F.concat_ws(".", "__spot.major", "__spot.minor", "__spot.patch"))
        .withColumn("fork", fork)
        .withColumn("release_no", number)
        .withColumn("display", display)
        .drop("__spot")
    )
