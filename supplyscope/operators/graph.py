"""Dependency graphs as edge tables: an edge (src, dst) says that src needs dst.

Walks go in rounds. A round is one DataFrame job over the rows that are new since the
round before; its result is written to the shared folder and the set of known rows is
the list of those tables. Nothing but the number of new rows comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.plans.doubling import follow
from supplyscope.plans.ordered import first_in_group, rank_in_group
from supplyscope.plans.shared import Stage, by_shuffle, settle
from supplyscope.plans.skew import keep_unseen

#: levels of a graph that are closed one by one before the rest is walked from its roots
LEVELS = 64
#: a step in a number of depth and label
STEP = 1 << 40


def clean_edges(edges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct edges; with `keep`, the smallest values of those columns per edge."""
    if not keep:
        return edges.select("src", "dst").distinct()
    least = edges.groupBy("src", "dst").agg(F.min(F.struct(*keep)).alias("k"))
    return least.select("src", "dst", "k.*")


def _walk(starts: DataFrame, step: DataFrame, max_depth: int = 0) -> DataFrame:
    """(root, pkg, depth, label): what each of `starts` (root) reaches along `step` (src, dst, label), round by round."""
    known = Stage(step.sparkSession)
    front = known.add(starts.select("root", F.col("root").alias("pkg"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("label")))
    depth = 0
    while not front.isEmpty() and (max_depth == 0 or depth < max_depth):
        depth += 1
        reached = front.select("root", F.col("pkg").alias("src")).join(step, "src")
        # one row per (root, package), combined before the shuffle
        fresh = reached.groupBy("root", F.col("dst").alias("pkg")).agg(F.min("label").alias("label"))
        front = known.add(keep_unseen(fresh.select("root", "pkg", F.lit(depth).alias("depth"), "label"), known.all(), ["root", "pkg"]))
    return known.all()


def _closed_from_below(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(root, pkg, depth, label): what each src of `edges` (src, dst, label) with a level of its own reaches, itself at 0.

    A node's rows are the rows of its dst, one step further, so that each row is shuffled once for each edge that it passes and no
    known row is looked up again. A round closes a level: of the rows that came for a node the least counts, which is kept
    and sent to the node's users, in folders by the level at which they wait. Depth and label are one number, the depth first.
    """
    spark = edges.sparkSession
    base = f"{Stage(spark).base}-levels"
    above = levels.select(F.col("node").alias("src"), F.col("level").alias("at"))
    below = levels.select(F.col("node").alias("dst"), "level")
    users = edges.join(by_shuffle(above), "src").join(by_shuffle(below), "dst").select("level", "dst", F.col("src").alias("user"), "label", "at")
    kept = levels.select("level", F.col("node").alias("dst"), F.lit(None).cast(edges.schema["src"].dataType).alias("user"), F.lit(0).cast("long").alias("label"), F.lit(-1).alias("at"))
    users = settle(users.unionByName(kept))
    own = levels.select("level", F.col("node").alias("root"), F.col("node").alias("pkg"), F.lit(0).cast("long").alias("best"))
    rows = None
    for level in range((levels.agg(F.max("level")).first()[0] or 0) + 1):
        waiting = own.where(F.col("level") == level).drop("level")
        if rows is not None:
            waiting = waiting.unionByName(spark.read.schema(rows).parquet(base).where(F.col("at") == level).select("root", "pkg", "best"))
        # by the root alone: the join below finds the rows where they are
        closed = waiting.repartition("root").groupBy("root", "pkg").agg(F.min("best").alias("best"))
        sent = closed.join(by_shuffle(users.where(F.col("level") == level)), F.col("root") == F.col("dst"))
        further = F.when(F.col("best") == 0, F.col("label")).otherwise(F.col("best")) + STEP
        out = sent.select(
            F.when(F.col("at") < 0, F.col("root")).otherwise(F.col("user")).alias("root"), "pkg", F.when(F.col("at") < 0, F.col("best")).otherwise(further).alias("best"), "at"
        )
        out.write.partitionBy("at").parquet(f"{base}/round={level}")
        rows = rows or out.withColumn("round", F.lit(level)).schema
    done = spark.read.schema(rows).parquet(base).where("at = -1 and round > 0")
    return done.select("root", "pkg", F.floor(F.col("best") / STEP).cast("int").alias("depth"), F.pmod("best", F.lit(STEP)).alias("label"))


def _all_closures(starts: DataFrame, step: DataFrame) -> DataFrame:
    """`_walk` from all nodes that need any: what leads to no cycle is closed from below, up to `LEVELS` levels, and the rest walked."""
    edges = settle(step.where("src <> dst"))
    levels = settle(_place(_ends(edges, "dst", "src"), edges.select("src", "dst", F.lit(1).alias("weight")), LEVELS))
    rest = settle(starts.join(by_shuffle(levels.where("level > 0").select(F.col("node").alias("root"))), "root", "left_anti"))
    closed = _closed_from_below(edges, levels)
    return closed if rest.isEmpty() else closed.unionByName(_walk(rest, edges))


def transitive_closure(
    edges: DataFrame,
    roots: DataFrame | None = None,
    phases: Sequence[str] | None = None,
    core: DataFrame | None = None,
    max_depth: int = 0,
    labels: Sequence[str] = (),
) -> DataFrame:
    """All packages reachable from each root with their least depth (root itself at 0).

    `phases` keeps edges of those phases only, `core` (pkg) leaves out core packages,
    `max_depth` 0 is no bound, `labels` are edge columns to report for the edge by which
    a package was first reached (the smallest if several are).
    """
    used = edges
    if phases is not None:
        used = used.where(F.col("phase").isin(list(phases)))
    if core is not None:
        used = used.join(core.select(F.col("pkg").alias("dst")), "dst", "left_anti")
    step = settle(clean_edges(used, labels))
    starts = roots.select("root").distinct() if roots is not None else step.select(F.col("src").alias("root")).distinct()
    numbered = step.select("src", "dst", F.lit(0).cast("long").alias("label"))
    if labels:
        # labels are numbered in their order and walk as numbers
        names = settle(rank_in_group(step.select(*labels).distinct(), [], list(labels), "__label"))
        same = F.lit(True)
        for c in labels:
            same = same & step[c].eqNullSafe(names[c])
        numbered = settle(step.join(names, same).select("src", "dst", F.col("__label").alias("label")))
    whole = roots is None and max_depth == 0
    reached = _all_closures(starts, numbered) if whole else _walk(starts, numbered, max_depth)
    if whole and not (unknown := numbered.where("dst is null and src is not null")).isEmpty():
        # a null dst is no node: it is reached anew at each depth
        ways = reached.join(unknown.select(F.col("src").alias("pkg"), F.col("label").alias("own")), "pkg")
        last = ways.groupBy("root", (F.col("depth") + 1).alias("depth")).agg(F.min("own").alias("label"))
        reached = reached.unionByName(last.select("root", F.lit(None).cast(step.schema["dst"].dataType).alias("pkg"), "depth", "label"))
    if not labels:
        return reached.drop("label")
    return reached.withColumnRenamed("label", "__label").join(names, "__label", "left").select("root", "pkg", "depth", *labels)


def flatten_dependencies(closure: DataFrame, constraint: str = "constraint", phase: str = "phase") -> DataFrame:
    """The closure as a list without the roots: name, constraint label, phase label if not runtime."""
    named = F.coalesce(constraint, F.lit(""))
    with_constraint = F.when(named.isin("", "0"), F.col("pkg").cast("string")).otherwise(
        F.concat(F.col("pkg").cast("string"), F.lit(" ("), named, F.lit(")"))
    )
    in_phase = F.when(F.coalesce(phase, F.lit("runtime")) == "runtime", "").otherwise(
        F.concat(F.lit(" ["), F.col(phase), F.lit("]"))
    )
    return closure.where(F.col("depth") > 0).select("root", "pkg", "depth", F.concat(with_constraint, in_phase).alias("label"))


def _run_links(edges: DataFrame) -> DataFrame:
    """(node, next, to, weight): nodes with one way in and one way out; `next` is set where that leads to another such node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("to"), F.min("weight").alias("weight"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    single = out.join(by_shuffle(into), "node").where((F.col("n_out") == 1) & (F.col("n_in") == 1) & (F.col("to") != F.col("node")))
    run = single.select("node", "to", "weight")
    return run.join(by_shuffle(run.select(F.col("node").alias("next"))), F.col("to") == F.col("next"), "left").select("node", "next", "to", "weight")


@dataclass
class _Runs:
    """One contraction: `nodes` (node, tail, steps, last), `bridges` (head, last, tail), `circles` (node, least)."""

    nodes: DataFrame
    bridges: DataFrame
    circles: DataFrame


def contract_runs(edges: DataFrame) -> tuple[DataFrame, list[_Runs]]:
    """Runs of nodes with one way in and one way out become single edges, until there are none longer than a node.

    `edges` are distinct (src, dst) pairs. The result's edges (src, dst, weight) have the length of the longest run between their ends;
    a run of any length takes the logarithm of its length in rounds. Circles without any other edge go whole.
    """
    edges, done = settle(edges.withColumn("weight", F.lit(1))), []
    while True:
        stage = Stage(edges.sparkSession)
        links, seen = stage.add_counted(_run_links(edges), linked=F.count("next"))
        if not seen["linked"]:
            return edges, done
        start = links.select("node", "next", F.col("weight").alias("steps"), F.col("to").alias("tail"), F.col("node").alias("last"), F.col("node").alias("least"))
        ended, circling = follow(
            start,
            {
                "steps": lambda a, b: a["steps"] + b["steps"],
                "tail": lambda a, b: b["tail"],
                "last": lambda a, b: b["last"],
                "least": lambda a, b: F.least(a["least"], b["least"]),
            },
        )
        ends = ended.select(F.col("node").alias("dst"), "tail", "steps", "last")
        outside = edges.join(by_shuffle(links.select(F.col("node").alias("src"))), "src", "left_anti").join(by_shuffle(ends), "dst", "left")
        length = F.col("weight") + F.coalesce("steps", F.lit(0))
        passed = settle(outside.select("src", F.coalesce("tail", "dst").alias("dst"), length.alias("weight"), "last"))
        bridges = passed.where(F.col("last").isNotNull()).select(F.col("src").alias("head"), "last", F.col("dst").alias("tail"))
        done.append(_Runs(ended.select("node", "tail", "steps", "last"), bridges, circling.select("node", "least")))
        edges = settle(passed.groupBy("src", "dst").agg(F.max("weight").alias("weight")))


def _place(starts: DataFrame, edges: DataFrame, rounds: int = 0) -> DataFrame:
    """(node, level): `starts` at 0, then every node of `edges` (src, dst, weight) all of whose dst are placed, by its longest way.

    Each edge knows how many edges leave its src. A round counts the edges that the nodes of the round before close,
    together with the counts of nodes that are closed in part, in one job: nodes not yet reached are not touched. A node is
    in front once, so that fronts small enough for a broadcast are no more than the nodes in all rounds together.
    `rounds` 0 is no bound; with one, the nodes placed by then come out.
    """
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("needs"))
    known = settle(edges.join(by_shuffle(counts), "src"))
    states = Stage(edges.sparkSession)
    first = starts.select("node", F.lit(0).cast("long").alias("closed"), F.lit(0).cast("long").alias("needs"), F.lit(0).alias("level"))
    state, seen = states.add_counted(first, placed=F.count(F.lit(1)))
    while seen["placed"] and (not rounds or len(states.paths) <= rounds):
        front = state.where("closed = needs").select(F.col("node").alias("dst"), "level")
        reached = known.join(front, "dst").select(F.col("src").alias("node"), F.lit(1).cast("long").alias("closed"), "needs", (F.col("level") + F.col("weight")).cast("int").alias("level"))
        waiting = state.where("closed < needs").unionByName(reached)
        merged = waiting.groupBy("node").agg(F.sum("closed").alias("closed"), F.max("needs").alias("needs"), F.max("level").alias("level"))
        state, seen = states.add_counted(merged, placed=F.count_if(F.expr("closed = needs")))
    return states.all().where("closed = needs").select("node", "level")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each node, dependencies first; `leftover` nodes depend on a cycle.

    Edges to unknown nodes are ignored. Runs of nodes with one dependency and one user are contracted to one edge of their
    length, the rest is placed level by level, and the nodes of a run follow from the level at its end.
    """
    ids = settle(nodes.select("node").distinct())
    src, dst = ids.withColumnRenamed("node", "src"), ids.withColumnRenamed("node", "dst")
    needs = edges.select("src", "dst").distinct().join(src, "src", "left_semi").join(dst, "dst", "left_semi")
    core, runs = contract_runs(needs)
    free = ids.join(core.select(F.col("src").alias("node")), "node", "left_anti")
    for r in runs:
        free = free.join(r.nodes.select("node").union(r.circles.select("node")), "node", "left_anti")
    levels = _place(free, core)
    for r in reversed(runs):
        below = settle(levels).withColumnsRenamed({"node": "tail", "level": "below"})
        inside = r.nodes.join(below, "tail").select("node", (F.col("below") + F.col("steps")).cast("int").alias("level"))
        levels = levels.unionByName(inside)
    return ids.join(levels, "node", "left").withColumn("leftover", F.col("level").isNull())


def _spread_least(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color): the least (mark, node) from which the node can be reached along `edges`.

    `nodes` has (node, mark). A round follows the edges of the rows that changed, and every changed row also takes the color of
    its color's node, from which it can be reached as well: ways get twice as long in a round.
    """
    states = Stage(nodes.sparkSession)
    own = F.struct("mark", "node")
    state, seen = states.add_counted(nodes.select("node", own.alias("color"), F.lit(True).alias("fresh")), fresh=F.count(F.lit(1)))
    while seen["fresh"]:
        front = state.where("fresh").select(F.col("node").alias("src"), "color")
        offers = edges.join(by_shuffle(front), "src").select(F.col("dst").alias("node"), F.lit(None).cast(state.schema["color"].dataType).alias("old"), "color")
        both = state.select("node", F.col("color").alias("old"), "color").unionByName(offers)
        least = both.groupBy("node").agg(F.max("old").alias("old"), F.min("color").alias("color"))
        ahead = state.select(F.col("node").alias("__node"), F.col("color").alias("__color"))
        jumped = least.join(by_shuffle(ahead), F.col("color.node") == F.col("__node")).select("node", "old", F.least("color", "__color").alias("color"))
        state, seen = states.add_counted(jumped.select("node", "color", (F.col("color") < F.col("old")).alias("fresh")), fresh=F.count_if("fresh"))
    return state.select("node", "color")


def _sets_of_core(edges: DataFrame) -> DataFrame:
    """(node, set): nodes that reach each other along `edges` (src, dst), without single nodes that have no edge to themselves.

    Every node takes the least node, by a random mark, that reaches it; among the nodes of one color it then takes the least that it
    reaches. The nodes where both are the same node form a set. Edges between nodes that differ in either are in no set and go, found
    nodes too, and the rest is colored again: with random marks a way through many sets falls apart in a logarithm of rounds.
    """
    found = Stage(edges.sparkSession)
    rest = edges.select("src", "dst")
    found.add(rest.select(F.col("src").alias("node"), F.col("src").alias("set")).limit(0))
    looped = settle(rest.where("src = dst").select(F.col("src").alias("node")).distinct())
    rest = settle(rest.where("src <> dst"))
    found.add(looped.select("node", F.col("node").alias("set")))

    def same(rows: DataFrame, colors: DataFrame) -> DataFrame:
        """The edges whose ends have one color."""
        a = colors.select(F.col("node").alias("src"), F.col("color").alias("__a"))
        b = colors.select(F.col("node").alias("dst"), F.col("color").alias("__b"))
        return rows.join(by_shuffle(a), "src").join(by_shuffle(b), "dst").where("__a = __b").select("src", "dst")

    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        marked = settle(nodes.withColumn("mark", F.xxhash64("node")))
        down = _spread_least(marked, rest)
        inside = settle(same(rest, down))
        up = _spread_least(marked, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        known = settle(down.withColumnRenamed("color", "down").join(by_shuffle(up.withColumnRenamed("color", "up")), "node"))
        closed = known.where("down = up").select("node", F.col("down.node").alias("set"))
        many = closed.groupBy("set").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("set")
        found.add(closed.join(by_shuffle(many), "set", "left_semi").select("node", "set"))
        open_rows = known.where("down <> up").select("node", F.struct("down", "up").alias("color"))
        rest = settle(same(inside, open_rows))
    # a node with an edge to itself may be in a larger set as well
    return found.all().groupBy("node").agg(F.max_by("set", F.col("set") != F.col("node")).alias("set"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges (src, dst, weight) with no end among the nodes `gone`."""
    left = edges.join(by_shuffle(gone.select(F.col("node").alias("src"))), "src", "left_anti")
    return settle(left.join(by_shuffle(gone.select(F.col("node").alias("dst"))), "dst", "left_anti"))


def _ends(edges: DataFrame, side: str, other: str) -> DataFrame:
    """Nodes that are a `side` of some edge and an `other` of none."""
    return edges.select(F.col(side).alias("node")).distinct().join(by_shuffle(edges.select(F.col(other).alias("node"))), "node", "left_anti")


def detect_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: (node, cycle_id, cycle_len).

    Nodes are on a cycle together if each reaches the other; `cycle_id` is the smallest
    node of such a set and `cycle_len` its size. Runs of nodes with one way in and one way out are contracted, nodes that reach no cycle
    or are reached by none are taken off by counts of their edges, and the sets of the rest are found by coloring in both directions.
    A node of a run is on a cycle if both ends of the run are in one set. No table of reachable pairs is made.
    """
    core, runs = contract_runs(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct())
    core = _without(core, _place(_ends(core, "dst", "src"), core))
    turned = core.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    core = _without(core, _place(_ends(core, "src", "dst"), turned))
    sets = settle(_sets_of_core(core))
    for r in reversed(runs):
        a = sets.select(F.col("node").alias("head"), "set")
        b = sets.select(F.col("node").alias("tail"), F.col("set").alias("__set"))
        closed = r.bridges.join(by_shuffle(a), "head").join(by_shuffle(b), "tail").where(F.col("set") == F.col("__set")).select("last", "set")
        inside = r.nodes.join(by_shuffle(closed), "last").select("node", "set")
        sets = settle(sets.unionByName(inside).unionByName(r.circles.select("node", F.col("least").alias("set"))))
    named = sets.groupBy("set").agg(F.min("node").alias("cycle_id"), F.count(F.lit(1)).alias("cycle_len"))
    return sets.join(by_shuffle(named), "set").select("node", "cycle_id", "cycle_len")


def module_users(edges: DataFrame) -> DataFrame:
    """(module, user), one row per distinct user: a module may have any number of users."""
    return edges.select(F.col("dst").alias("module"), F.col("src").alias("user")).distinct()


def reverse_dependents(edges: DataFrame) -> DataFrame:
    """Number of distinct users of each module; `module_users` lists them."""
    return edges.groupBy(F.col("dst").alias("module")).agg(F.count_distinct("src").alias("n_users"))


def version_conflicts(requirements: DataFrame) -> DataFrame:
    """Constraints of the modules that are required with more than one distinct constraint.

    One row per (module, constraint) with its number of requirers.
    """
    stated = requirements.where(F.coalesce("constraint", F.lit("")) != "")
    each = stated.groupBy("module", "constraint").agg(F.count_distinct("requirer").alias("n_requirers"))
    many = each.groupBy("module").agg(F.count(F.lit(1)).alias("n_constraints")).where("n_constraints > 1")
    return each.join(many, "module")


def conflict_requirers(requirements: DataFrame) -> DataFrame:
    """(module, constraint, requirer) of the conflicting constraints."""
    stated = requirements.where(F.coalesce("constraint", F.lit("")) != "")
    differ = stated.groupBy("module").agg(F.min("constraint").alias("a"), F.max("constraint").alias("b")).where("a <> b")
    # distinct first: the join on the module alone then has nothing to combine and can be split
    return stated.select("module", "constraint", "requirer").distinct().join(differ.select("module"), "module")


def constraints_compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a == "") | (b == "")


def main_module_users(tools: DataFrame, edges: DataFrame) -> DataFrame:
    """(main_module, tool): all tools that need the main module of some tool, or any other module.

    The blockers of a tool are the rows of its main module other than its own.
    """
    own = tools.select("main_module", "tool")
    used = edges.select(F.col("module").alias("main_module"), "tool")
    return own.unionByName(used).distinct()


def removal_blockers(tools: DataFrame, edges: DataFrame) -> DataFrame:
    """Per tool (tool, main_module): can it be removed, how many tools block it, and the first.

    A tool is blocked by the users of its main module other than itself. The number and the
    two smallest users are kept per module, so tools and users never meet as pairs;
    `main_module_users` has the full lists.
    """
    users = main_module_users(tools, edges)
    counts = users.groupBy("main_module").agg(F.count(F.lit(1)).alias("n"))
    two = first_in_group(users, ["main_module"], ["tool"], 2)
    lowest = two.groupBy("main_module").agg(F.min("tool").alias("low"), F.max("tool").alias("next"))
    known = tools.join(counts, "main_module").join(lowest, "main_module")
    return known.select(
        "tool",
        "main_module",
        (F.col("n") == 1).alias("can_remove"),
        (F.col("n") - 1).alias("n_blockers"),
        F.when(F.col("tool") != F.col("low"), F.col("low"))
        .when(F.col("next") != F.col("low"), F.col("next"))
        .alias("first_blocker"),
    )


def orphaned_modules(installed: DataFrame, tools: DataFrame, edges: DataFrame) -> DataFrame:
    """Installed modules that no tool needs, neither as its main module nor as a dependency."""
    used = edges.select("module").union(tools.select("main_module")).distinct()
    return keep_unseen(installed.select("module").distinct(), used, ["module"])


def orphaned_directories(directories: DataFrame, tools: DataFrame) -> DataFrame:
    """Tool directories without a metadata row."""
    return directories.join(tools.select("tool").distinct(), "tool", "left_anti")


def dependency_report(tools: DataFrame, edges: DataFrame) -> DataFrame:
    """Per tool: main module and number of dependencies; the edges list them."""
    counts = edges.groupBy("tool").agg(F.count_distinct("module").alias("n_dependencies"))
    joined = tools.join(counts, "tool", "left")
    return joined.select("tool", "main_module", F.coalesce("n_dependencies", F.lit(0)).alias("n_dependencies"))


def _inheritance_levels(profiles: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, level, leftover): every profile and parent, parents first."""
    nodes = profiles.select(F.col("profile").alias("node")).union(steps.select("profile")).union(steps.select("parent"))
    known = nodes.where(F.col("node").isNotNull())
    return topological_levels(known, steps.select(F.col("profile").alias("src"), F.col("parent").alias("dst")))


def inheritance_errors(profiles: DataFrame, inherits: DataFrame) -> DataFrame:
    """(profile, error): the profiles that inherit in a circle or from one that does. They have no settings."""
    steps = inherits.select("profile", "parent").distinct()
    left = _inheritance_levels(profiles, steps).where("leftover").select(F.col("node").alias("profile"))
    return profiles.select("profile").distinct().join(left, "profile").withColumn("error", F.lit("circular inheritance"))


def resolve_inheritance(
    profiles: DataFrame, inherits: DataFrame, settings: DataFrame, defaults: DataFrame | None = None
) -> DataFrame:
    """Effective settings of each profile: (profile, key, value, origin).

    defaults ← parents in listed order, each resolved first ← own keys; only keys that are
    explicitly set count. `settings` has (profile, key, value), `defaults` (key, value). Of two values of one own key the smaller
    counts, of two parents at one position the greater name. Profiles are resolved level by level, so a profile reads the
    finished settings of its parents and nothing behind them. Profiles in `inheritance_errors` are left out.
    """
    steps = settle(inherits.select("profile", "parent", F.col("pos").cast("int").alias("pos")).distinct())
    placed = settle(_inheritance_levels(profiles, steps).where("not leftover").select(F.col("node").alias("profile"), "level"))
    given = settings.groupBy("profile", "key").agg(F.min("value").alias("value"))
    own = settle(given.join(placed, "profile").select("profile", "key", "value", F.col("profile").cast("string").alias("origin"), "level"))
    ways = settle(steps.join(placed, "profile").select("profile", "parent", "pos", "level"))
    resolved = Stage(profiles.sparkSession)
    resolved.add(own.where("level = 0").select("profile", "key", "value", "origin"))
    nothing = F.lit(None)
    first = F.struct(F.lit(True).alias("own"), nothing.cast("int").alias("pos"), nothing.cast(ways.schema["parent"].dataType).alias("parent"))
    for level in range(1, (placed.agg(F.max("level")).first()[0] or 0) + 1):
        from_parents = resolved.all().withColumnRenamed("profile", "parent").join(ways.where(F.col("level") == level), "parent")
        answers = from_parents.select("profile", "key", F.struct(F.lit(False).alias("own"), "pos", "parent").alias("rank"), "value", "origin")
        mine = own.where(F.col("level") == level).select("profile", "key", first.alias("rank"), "value", "origin")
        best = answers.unionByName(mine).groupBy("profile", "key").agg(F.max_by(F.struct("value", "origin"), "rank").alias("b"))
        resolved.add(best.select("profile", "key", "b.value", "b.origin"))
    asked = profiles.select("profile").distinct()
    rows = resolved.all().join(asked, "profile", "left_semi")
    if defaults is None:
        return rows
    # the defaults apply to every profile, so the result has a row for each pair; they travel as one array value
    base = defaults.select("key", "value").agg(F.array_sort(F.collect_list(F.struct("key", "value")))).scalar()
    filled = asked.join(placed.select("profile"), "profile", "left_semi").select("profile", F.explode(base).alias("d")).select("profile", "d.key", "d.value")
    missing = filled.join(rows.select("profile", "key"), ["profile", "key"], "left_anti")
    return rows.unionByName(missing.withColumn("origin", F.lit("default")))
