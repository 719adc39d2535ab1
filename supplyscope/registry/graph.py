"""Queries over dependency graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from supplyscope.adapters import define, relation
from supplyscope.operators import graph as ops
from supplyscope.operators import reachability as reach
from supplyscope.plans.shared import by_shuffle, shared_folder
from supplyscope.registry.base import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

define(
    "labelled_edge",
    """select src, dst, case when src % 4 = 0 then 'test' when src % 4 = 1 then 'build' else 'runtime' end as phase,
    case when src % 3 = 0 then '' else concat('>= 1.', cast(dst % 9 as varchar(9))) end as constraint_text from dep_edge_dag""",
)
define(
    "cyclic_edge",
    """select p_partkey as src, p_partkey - p_partkey % 5 + (p_partkey % 5 + 1) % 5 as dst from part where floor(p_partkey / 5) % 3 <> 1 or p_partkey % 5 < 4
    union all select p_partkey, cast(floor(p_partkey / 2) as bigint) from part where p_partkey > 1""",
)
define("part_node", "select p_partkey as node from part")
define("stated_requirement", "select package as module, requirer, concat(op, ' ', version) as constraint_text from requirement")
define("tool_row", "select s_suppkey as tool, s_suppkey * 13 % 701 as main_module from supplier")
define("tool_edge", "select distinct l_suppkey as tool, case when l_quantity > 35 then l_partkey % 900 else -1 - l_partkey % 900 end as module from lineitem")
define("module_row", "select p_partkey as module from part")
define("tool_directory", "select c_custkey as tool from customer")
define(
    "profile_parent",
    """select c_custkey as profile, cast(floor(c_custkey / 2) as bigint) as parent, 0 as pos from customer where c_custkey > 0
    union all select c_custkey, cast(floor(c_custkey / 3) as bigint), 1 from customer where c_custkey > 2 and c_custkey % 2 = 0""",
)
define("profile_row", "select c_custkey as profile from customer")
define("profile_setting", "select c_custkey as profile, c_mktsegment as setting_key, concat('v', cast(c_custkey as varchar(19))) as val from customer")
define("default_setting", "select r_name as setting_key, 'd' as val from region union all select 'MACHINERY', 'd'")

REACH = "w(root, pkg, depth) as (select distinct src, src, 0 from dep_edge_dag union select w.root, e.dst, w.depth + 1 from w join dep_edge_dag e on e.src = w.pkg {limit})"


def recursive(uses: str, sql: str) -> str:
    return uses.replace("with ", "with recursive ", 1) + ", " + sql


def _edges(spark, sf, name="dep_edge_dag"):
    return relation(spark, sf, name)


def closure_check(limit: str = "") -> str:
    from supplyscope.adapters import with_relations

    walk = REACH.format(limit=limit)
    return recursive(with_relations("dep_edge_dag").strip(), f"{walk} select root, pkg, min(depth)::int as depth from w group by root, pkg")


book.oracle["c1_transitive_closure"] = closure_check()
book.oracle["c1_closure_depth_3"] = closure_check("where w.depth < 3")


@book.query("c1_transitive_closure")
def c1(spark, sf):
    return ops.transitive_closure(_edges(spark, sf))


@book.query("c1_closure_depth_3")
def c1_depth(spark, sf):
    return ops.transitive_closure(_edges(spark, sf), max_depth=3)


@book.query("c2_flatten_dependencies")
def c2(spark, sf):
    return _flat(spark, sf)


def flat_check(roots: str = "") -> str:
    from supplyscope.adapters import with_relations

    starts = f"select root, root, 0 from {roots}" if roots else "select distinct src, src, 0 from u"
    walk = f"""u as (select * from labelled_edge where phase in ('runtime', 'build')),
    w(root, pkg, depth) as ({starts} union select w.root, e.dst, w.depth + 1 from w join u e on e.src = w.pkg),
    d as (select root, pkg, min(depth) as depth from w group by root, pkg),
    l as (select d.root, d.pkg, d.depth, min((e.constraint_text, e.phase)) as k from d join d p on p.root = d.root and p.depth = d.depth - 1 join u e on e.src = p.pkg and e.dst = d.pkg group by all)
    select root, pkg, depth::int as depth, concat(pkg, case when k[1] = '' then '' else concat(' (', k[1], ')') end, case when k[2] = 'runtime' then '' else concat(' [', k[2], ']') end) as label from l"""
    return recursive(with_relations("labelled_edge", *([roots] if roots else [])).strip(), walk)


book.oracle["c2_flatten_dependencies"] = flat_check()


define("root_tool", "select distinct main_module as root from tool_row")
define("asked_pair", "select distinct l_partkey as src, l_suppkey as dst from lineitem")

# a node's parent is the smallest that needs it; its path from the top, compared as a list, gives its place
PLACES = """e as (select distinct src, dst from dep_edge_dag where src <> dst), n as (select src as node from e union select dst from e),
    p as (select n.node, min(e.src) as up from n left join e on e.dst = n.node group by n.node),
    t(node, path) as (select node, [node] from p where up is null union all select p.node, list_append(t.path, p.node) from t join p on p.up = t.node),
    c(node, above) as (select node, node from p union all select c.node, p.up from c join p on p.node = c.above where p.up is not null),
    z as (select above as node, count(*) as size from c group by above),
    o as (select node, row_number() over (order by path) - 1 as pre from t)
    select o.node, p.up, o.pre, o.pre + z.size - 1 as "end" from o join z using (node) join p using (node)"""


def index_check() -> str:
    from supplyscope.adapters import with_relations

    return recursive(with_relations("dep_edge_dag").strip(), PLACES)


book.oracle["c1_reachability_index"] = index_check()


_indexes: dict[tuple[str, str, str], str] = {}


def _index(spark, sf, name="dep_edge_dag"):
    """The stored index of an edge relation: built once for a session, then read."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _indexes:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        reach.build_index(_edges(spark, sf, name)).write(path)
        _indexes[key] = path
    return reach.ReachIndex.read(spark, _indexes[key])


@book.query("c1_reachability_index")
def c1_index(spark, sf):
    index = _index(spark, sf)
    return index.members.join(by_shuffle(index.places), "place").select("node", "up", "pre", "end")


def reach_check(edges: str, roots: str, last: str) -> str:
    from supplyscope.adapters import with_relations

    walk = f"""w(root, pkg) as (select root, root from ({roots}) union select w.root, e.dst from w join {edges} e on e.src = w.pkg)"""
    return recursive(with_relations(edges, "root_tool", "asked_pair").strip(), f"{walk} {last}")


ASKED = "select a.src, a.dst, w.root is not null as reaches from asked_pair a left join w on w.root = a.src and w.pkg = a.dst"
book.oracle["c1_closure_of_tools"] = reach_check("dep_edge_dag", "select root from root_tool", "select root, pkg from w")
book.oracle["c1_reaches"] = reach_check("dep_edge_dag", "select src as root from asked_pair", ASKED)
book.oracle["c1_reaches_with_cycles"] = reach_check("cyclic_edge", "select src as root from asked_pair", ASKED)


@book.query("c1_closure_of_tools")
def c1_tools(spark, sf):
    return reach.closure(_index(spark, sf), relation(spark, sf, "root_tool"))


@book.query("c1_reaches")
def c1_reaches(spark, sf):
    return reach.reaches(_index(spark, sf), relation(spark, sf, "asked_pair"))


@book.query("c1_reaches_with_cycles")
def c1_reaches_cyclic(spark, sf):
    return reach.reaches(_index(spark, sf, "cyclic_edge"), relation(spark, sf, "asked_pair"))


def _flat(spark, sf, roots=None):
    edges = _edges(spark, sf, "labelled_edge").withColumnRenamed("constraint_text", "constraint")
    closure = ops.transitive_closure(edges, roots, phases=["runtime", "build"], labels=["constraint", "phase"])
    return ops.flatten_dependencies(closure)


book.oracle["c2_flatten_tools"] = flat_check("root_tool")


@book.query("c2_flatten_tools")
def c2_tools(spark, sf):
    return _flat(spark, sf, relation(spark, sf, "root_tool"))


def level_check() -> str:
    from supplyscope.adapters import with_relations

    # in a graph without cycles the level is the longest way down
    walk = """w(node, level) as (select src, 1 from dep_edge_dag union select e.src, w.level + 1 from w join dep_edge_dag e on e.dst = w.node)
    select n.node, coalesce(max(level), 0)::int as level, false as leftover from part_node n left join w on w.node = n.node group by n.node"""
    return recursive(with_relations("dep_edge_dag", "part_node").strip(), walk)


book.oracle["c3_topological_levels"] = level_check()


@book.query("c3_topological_levels")
def c3(spark, sf):
    return ops.topological_levels(relation(spark, sf, "part_node"), _edges(spark, sf))


@book.query("c3_levels_with_cycles")
def c3_cycles(spark, sf):
    return ops.topological_levels(relation(spark, sf, "part_node"), _edges(spark, sf, "cyclic_edge"))


def leftover_check() -> str:
    from supplyscope.adapters import with_relations

    # left over is what is on a cycle or reaches one; the rest has its longest way down
    walk = """e as (select distinct src, dst from cyclic_edge where dst in (select node from part_node)),
    w(a, b) as (select src, dst from e union select w.a, e.dst from w join e on e.src = w.b),
    cyc as (select distinct a from w where a = b), lost as (select a from cyc union select w.a from w join cyc on w.b = cyc.a),
    l(node, level) as (select node, 0 from part_node where node not in (select src from e) union
      select e.src, l.level + 1 from l join e on e.dst = l.node where e.src not in (select a from lost))
    select n.node, max(level)::int as level, max(level) is null as leftover from part_node n left join l on l.node = n.node group by n.node"""
    return recursive(with_relations("cyclic_edge", "part_node").strip(), walk)


book.oracle["c3_levels_with_cycles"] = leftover_check()


def cycle_check() -> str:
    from supplyscope.adapters import with_relations

    walk = """w(a, b) as (select src, dst from cyclic_edge union select w.a, e.dst from w join cyclic_edge e on e.src = w.b),
    m as (select x.a as node, x.b as other from w x join w y on x.a = y.b and x.b = y.a)
    select node, min(other) as cycle_id, count(*) as cycle_len from m group by node"""
    return recursive(with_relations("cyclic_edge").strip(), walk)


book.oracle["c4_detect_cycles"] = cycle_check()


@book.query("c4_detect_cycles")
def c4(spark, sf):
    return ops.detect_cycles(_edges(spark, sf, "cyclic_edge"))


@book.query("c5_reverse_dependents", ("dep_edge_dag",), "select dst as module, count(distinct src) as n_users from dep_edge_dag group by dst")
def c5(spark, sf):
    return ops.reverse_dependents(_edges(spark, sf))


@book.query("c5_module_users", ("dep_edge_dag",), 'select distinct dst as module, src as "user" from dep_edge_dag')
def c5_users(spark, sf):
    return ops.module_users(_edges(spark, sf))


def _stated(spark, sf):
    return relation(spark, sf, "stated_requirement").withColumnRenamed("constraint_text", "constraint")


@book.query(
    "c6_version_conflicts",
    ("stated_requirement",),
    """select module, constraint_text, count(distinct requirer) as n_requirers, any_value(n_constraints) as n_constraints
    from stated_requirement join (select module, count(distinct constraint_text) as n_constraints from stated_requirement group by module having count(distinct constraint_text) > 1) using (module) group by module, constraint_text""",
)
def c6(spark, sf):
    return ops.version_conflicts(_stated(spark, sf)).withColumnRenamed("constraint", "constraint_text")


@book.query(
    "c6_conflict_requirers",
    ("stated_requirement",),
    """select distinct module, constraint_text, requirer from stated_requirement
    where module in (select module from stated_requirement group by module having count(distinct constraint_text) > 1)""",
)
def c6_requirers(spark, sf):
    return ops.conflict_requirers(_stated(spark, sf)).withColumnRenamed("constraint", "constraint_text")


def _tools(spark, sf):
    return relation(spark, sf, "tool_row"), relation(spark, sf, "tool_edge")


@book.query(
    "c7_removal_blockers",
    ("tool_row", "tool_edge"),
    """with u as (select main_module as module, tool from tool_row union select module, tool from tool_edge)
    select t.tool, t.main_module, count(u.tool) = 0 as can_remove, count(u.tool) as n_blockers, min(u.tool) as first_blocker
    from tool_row t left join u on u.module = t.main_module and u.tool <> t.tool group by t.tool, t.main_module""",
)
def c7(spark, sf):
    return ops.removal_blockers(*_tools(spark, sf))


@book.query(
    "c7_module_blockers",
    ("tool_row", "tool_edge"),
    "select main_module, tool from tool_row union select module, tool from tool_edge",
)
def c7_all(spark, sf):
    return ops.main_module_users(*_tools(spark, sf))


@book.query(
    "c8_orphaned_modules",
    ("module_row", "tool_row", "tool_edge"),
    "select module from module_row where module not in (select module from tool_edge) and module not in (select main_module from tool_row)",
)
def c8(spark, sf):
    return ops.orphaned_modules(relation(spark, sf, "module_row"), *_tools(spark, sf))


@book.query("c8_orphaned_directories", ("tool_directory", "tool_row"), "select tool from tool_directory where tool not in (select tool from tool_row)")
def c8_directories(spark, sf):
    return ops.orphaned_directories(relation(spark, sf, "tool_directory"), relation(spark, sf, "tool_row"))


@book.query(
    "c9_dependency_report",
    ("tool_row", "tool_edge"),
    "select t.tool, main_module, count(e.module) as n_dependencies from tool_row t left join tool_edge e on e.tool = t.tool group by t.tool, main_module",
)
def c9(spark, sf):
    return ops.dependency_report(*_tools(spark, sf))


define(
    "tangled_parent",
    """select profile, parent, pos from profile_parent union all select c_custkey, c_custkey * 2 + 1, 7 from customer where c_custkey % 50 = 9 and c_custkey > 100""",
)


def error_check() -> str:
    from supplyscope.adapters import with_relations

    walk = """w(a, b) as (select profile, parent from tangled_parent union select w.a, t.parent from w join tangled_parent t on t.profile = w.b),
    c as (select distinct a from w where a = b), e as (select a from c union select w.a from w join c on w.b = c.a)
    select profile, 'circular inheritance' as error from profile_row where profile in (select a from e)"""
    return recursive(with_relations("profile_row", "tangled_parent").strip(), walk)


book.oracle["c10_inheritance_errors"] = error_check()


@book.query("c10_inheritance_errors")
def c10_errors(spark, sf):
    return ops.inheritance_errors(relation(spark, sf, "profile_row"), relation(spark, sf, "tangled_parent"))


def inheritance_check() -> str:
    from supplyscope.adapters import with_relations

    walk = """w(profile, ancestor, path) as (select profile, profile, [2147483647] from profile_row union all
      select w.profile, p.parent, list_concat(w.path[1:len(w.path) - 1], [p.pos, 2147483647]) from w join profile_parent p on p.profile = w.ancestor),
    r as (select w.profile, s.setting_key, s.val, cast(w.ancestor as varchar) as origin, path from w join profile_setting s on s.profile = w.ancestor),
    b as (select profile, setting_key, val, origin from r qualify row_number() over (partition by profile, setting_key order by path desc) = 1)
    select * from b union all select profile, setting_key, val, 'default' from profile_row, default_setting where (profile, setting_key) not in (select (profile, setting_key) from b)"""
    return recursive(with_relations("profile_row", "profile_parent", "profile_setting", "default_setting").strip(), walk)


book.oracle["c10_resolve_inheritance"] = inheritance_check()


@book.query("c10_resolve_inheritance")
def c10(spark, sf):
    settings = relation(spark, sf, "profile_setting").withColumnsRenamed({"setting_key": "key", "val": "value"})
    defaults = relation(spark, sf, "default_setting").withColumnsRenamed({"setting_key": "key", "val": "value"})
    resolved = ops.resolve_inheritance(relation(spark, sf, "profile_row"), relation(spark, sf, "profile_parent"), settings, defaults)
    return resolved.withColumnsRenamed({"key": "setting_key", "value": "val"})
