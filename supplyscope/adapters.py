"""The driver's tables in the shapes that the operators take.

Each relation is one SELECT that both Spark and the SQL check can run, so a query
and its check start from the same rows. `relation` gives it as a DataFrame,
`with_relations` as a WITH clause. Every relation covers its whole table: rows that must not
meet the other side of a join get keys of their own and stay in. Only the two tables of `f4`, which have to
differ, leave rows out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

RELATIONS: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    if name in RELATIONS:
        raise ValueError(f"relation {name} is defined twice")
    RELATIONS[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(sql: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_]+", sql))


def _needed(names: tuple[str, ...]) -> list[str]:
    """`names` and the relations they build on, each after what it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in sorted(_words(RELATIONS[name]) & RELATIONS.keys() - {name}):
            visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for needed in _needed((name,)):
        for base in _words(RELATIONS[needed]) & set(TABLES):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
        df = spark.sql(RELATIONS[needed])
        df.createOrReplaceTempView(needed)
    return df


def with_relations(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({RELATIONS[n]})" for n in _needed(names)) + " "


define(
    "package_release",
    """select p_partkey as release_id, p_brand as package,
    concat(cast(p_size % 6 as varchar(9)), '.', cast(p_partkey % 40 as varchar(9)), '.', cast((p_partkey * 7) % 11 as varchar(9))) as version,
    p_partkey % 5 = 0 as prerelease, p_type as channel from part""",
)
define(
    "tagged_release",
    """select release_id, package, channel,
    case when prerelease then concat(version, '-rc.', cast(release_id % 13 as varchar(9))) else version end as version
    from package_release""",
)
define(
    "requirement",
    """select l_orderkey as req_id, l_linenumber as line_no, l_suppkey as requirer, p_brand as package,
    case when l_quantity > 40 then '>=' when l_quantity > 30 then '~>' when l_quantity > 20 then '<' else '==' end as op,
    concat(cast(l_linenumber % 6 as varchar(9)), '.', cast(cast(l_quantity as int) % 40 as varchar(9)), '.0') as version,
    l_returnflag as phase from lineitem join part on l_partkey = p_partkey""",
)
define(
    "installed_package",
    """select l_suppkey as project, case when l_returnflag = 'R' and l_quantity > 40 then p_brand else concat('local-', cast(p_partkey % 100 as varchar(9))) end as package,
    concat(cast(p_size % 4 as varchar(9)), '.', cast(p_partkey % 40 as varchar(9)), '.0') as version from lineitem join part on l_partkey = p_partkey""",
)
define(
    "dep_edge_dag",
    """select p_partkey as src, cast(floor(p_partkey / 2) as bigint) as dst from part where p_partkey > 1
    union all select p_partkey, cast(floor(p_partkey / 3) as bigint) from part where p_partkey > 2""",
)
define(
    "op_event",
    """select event_id, event_type as op, user_id as source, ts, value as duration, event_type <> 'error' as success,
    case when user_id % 3 = 0 then 'binary' when user_id % 3 = 1 then 'source' else 'unknown' end as method from events""",
)
define(
    "mirror_check",
    """select event_id, user_id as mirror, ts, event_type <> 'error' as healthy, value as latency,
    user_id % 4 as priority, user_id % 7 <> 0 as enabled from events""",
)
define(
    "cache_entry",
    """select o_orderkey as entry_key, o_custkey % 20 as pool, o_totalprice as size, o_orderdate as created_at,
    o_orderdate + interval '1' day * cast(o_orderkey % 90 as int) as last_accessed, o_orderstatus = 'F' as expired from orders""",
)
define(
    "setting",
    """select 'system' as layer, c_name as setting_key, cast(c_nationkey as varchar(9)) as val from customer
    union all select 'user', c_name, case when c_nationkey % 3 = 0 then '' else cast(c_custkey as varchar(9)) end from customer
    union all select 'project', c_name, 'p' from customer where c_nationkey % 5 = 0""",
)
define(
    "source_file",
    """select doc_id as file_id, concat('# header', chr(10), 'use ', upper(source), '::', upper(lang), ';', chr(10),
    'use strict;', chr(10), 'require ''Lib/', lang, '.pm'';', chr(10), text) as text from documents""",
)
