"""Queries over layered settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplyscope.adapters import define, relation
from supplyscope.operators import settings as ops
from supplyscope.registry.base import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

define(
    "typed_setting",
    """select case l_linenumber when 1 then 'default' when 2 then 'system' when 3 then 'user' when 4 then 'project' else 'other' end as layer, l_orderkey as setting_key,
    case when l_partkey % 2 = 0 then '0' when l_partkey % 5 = 0 then '' else cast(l_suppkey as varchar(19)) end as val, case when l_orderkey % 2 = 0 then 'int' else 'string' end as kind from
    (select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, max(l_suppkey) as l_suppkey from lineitem group by l_orderkey, l_linenumber) x""",
)
define(
    "version_candidate",
    """select o_custkey as entity, case o_orderkey % 5 when 0 then 'explicit' when 1 then 'environment' when 2 then 'project_file' when 3 then 'script' else 'user_config' end as source,
    max(case when o_orderstatus = 'F' then '' else concat('5.', cast(o_orderkey % 40 as varchar(9))) end) as value from orders group by 1, 2""",
)
define("table_before", "select o_orderkey as setting_key, case when o_orderkey % 13 = 0 then null else o_orderstatus end as val from orders where o_totalprice > 60000")
define("table_after", "select o_orderkey as setting_key, case when o_custkey % 9 = 0 then 'Z' when o_orderkey % 13 = 0 then null else o_orderstatus end as val from orders where o_totalprice < 450000")
define(
    "secret_row",
    """select o_orderkey as row_id, case o_orderkey % 5 when 0 then 'db_password' when 1 then 'ApiToken' when 2 then 'PATH' when 3 then 'monkey' else 'home' end as name,
    case when o_custkey % 2 = 0 then 'short' else concat('value-', cast(o_orderkey as varchar(19)), '-end') end as value from orders""",
)
define(
    "config_row",
    """select o_custkey as entity, concat('k', cast(o_orderkey % 6 as varchar(9))) as key, max(case o_orderkey % 6 when 0 then case when o_totalprice > 250000 then 'http://x' else 'ftp://x' end
      when 1 then cast(cast(floor(o_totalprice / 1000) as int) as varchar(19)) when 2 then case when o_orderstatus = 'F' then 'true' else 'maybe' end
      when 3 then o_orderstatus when 4 then concat(cast(o_custkey % 90 as varchar(9)), 'm') else case when o_custkey % 2 = 0 then '5.36' else 'five' end end) as val from orders group by 1, 2""",
)
define(
    "config_rule",
    """select 'k0' as key, true as required, 'string' as type, '' as allowed_text, cast(null as double) as min, cast(null as double) as max, 'url' as pattern
    union all select 'k1', true, 'int', '', 100, 400, '' union all select 'k2', false, 'bool', '', null, null, ''
    union all select 'k3', true, 'string', 'F,O', null, null, '' union all select 'k4', false, 'duration', '', 60, 3600, ''
    union all select 'k5', false, 'string', '', null, null, 'version'""",
)
define("record_target", "select c_custkey as name, c_acctbal as url from customer")
define("record_source", "select case when o_totalprice > 400000 then o_custkey else -1 - o_custkey end as name, o_totalprice as url, o_orderkey as seq from orders")
# "@" stands for "$" below, since Spark SQL replaces ${...} in statements by itself
define(
    "template_row",
    """select o_orderkey as row_id, replace(concat('@{HOME', cast(o_custkey % 50 as varchar(9)), '}/', case when o_orderkey % 3 = 0 then '@{NONE:-d@{X}}'
    when o_orderkey % 3 = 1 then '@{LOOP}' else '@{ gone }' end), '@', '$') as text from orders""",
)
define(
    "template_variable",
    """select name, replace(marked, '@', '$') as value from (select concat('HOME', cast(n_nationkey as varchar(9))) as name, concat('/h/@{USER:-', n_name, '}') as marked from nation
    union all select 'X', '@{Y}@{Y}' union all select 'Y', 'y'
    union all select 'LOOP', 'a@{LOOP2}' union all select 'LOOP2', '@{LOOP}') x""",
)


@book.query(
    "f1_merge_layers",
    ("setting",),
    """select setting_key, arg_max(val, p) as val, arg_max(layer, p) as source from
    (select *, case layer when 'system' then 1 when 'user' then 2 when 'project' then 3 end as p from setting where val <> '') group by setting_key""",
)
def f1(spark, sf):
    return ops.merge_layers(relation(spark, sf, "setting"))


@book.query(
    "f1_merge_typed_layers",
    ("typed_setting",),
    """select setting_key, arg_max(val, p) as val, arg_max(layer, p) as source from
    (select *, list_position(['default','system','user','project'], layer) as p from typed_setting where val <> '' and layer <> 'other' and not (kind = 'int' and val = '0')) group by setting_key""",
)
def f1_typed(spark, sf):
    return ops.merge_layers(relation(spark, sf, "typed_setting"), kind="kind")


ARRAYS = """with p as (select *, list_position(['default','system','user','project'], layer) as p from typed_setting where layer <> 'other')"""


@book.query(
    "f1_merge_arrays_append",
    ("typed_setting",),
    ARRAYS + """, u as (select setting_key, v, min(p * 10 + i) as at1 from (select setting_key, p, unnest([val, 'common']) as v, unnest([1, 2]) as i from p) group by setting_key, v)
    select setting_key, string_agg(v, ',' order by at1) as vals from u group by setting_key""",
)
def f1_append(spark, sf):
    rows = relation(spark, sf, "typed_setting").withColumn("vals", F.array("val", F.lit("common")))
    return ops.merge_array_layers(rows, append=True).where(F.size("vals") > 0).withColumn("vals", F.array_join("vals", ","))


@book.query(
    "f1_merge_arrays_replace",
    ("typed_setting",),
    ARRAYS + " select setting_key, concat(arg_max(val, p), ',common') as vals from p group by setting_key",
)
def f1_replace(spark, sf):
    rows = relation(spark, sf, "typed_setting").withColumn("vals", F.array("val", F.lit("common")))
    return ops.merge_array_layers(rows).where(F.col("vals").isNotNull()).withColumn("vals", F.array_join("vals", ","))


@book.query(
    "f1_merge_maps",
    ("typed_setting",),
    ARRAYS + " select kind, setting_key, arg_max(val, p) as val, arg_max(layer, p) as source from p group by kind, setting_key",
)
def f1_maps(spark, sf):
    return ops.merge_layers(relation(spark, sf, "typed_setting"), key=["kind", "setting_key"], empty_overrides=True)


@book.query(
    "f1_replace_maps",
    ("setting",),
    """select left(setting_key, 17) as map_name, setting_key, layer, val from setting qualify dense_rank() over (partition by left(setting_key, 17)
      order by case layer when 'system' then 1 when 'user' then 2 else 3 end desc) = 1""",
)
def f1_replace_maps(spark, sf):
    rows = relation(spark, sf, "setting").withColumn("map_name", F.substring("setting_key", 1, 17))
    return ops.replace_map_layers(rows, ["map_name"])


@book.query(
    "f2_resolve_precedence",
    ("version_candidate",),
    """select entity, arg_min(value, p) as value, arg_min(source, p) as source from
    (select *, list_position(['explicit','environment','project_file','script','user_config'], source) as p from version_candidate where value <> '') group by entity""",
)
def f2(spark, sf):
    order = ["explicit", "environment", "project_file", "script", "user_config"]
    return ops.resolve_precedence(relation(spark, sf, "version_candidate"), order)


@book.query(
    "f3_layer_conflicts",
    ("typed_setting",),
    """select a.setting_key, a.val as target_value, b.val as source_value, 'source overrides target' as resolution from typed_setting a join typed_setting b using (setting_key)
    where a.layer = 'system' and b.layer = 'user' and a.val <> '' and b.val <> '' and a.val <> b.val and not (a.kind = 'int' and (a.val = '0' or b.val = '0'))""",
)
def f3(spark, sf):
    return ops.layer_conflicts(relation(spark, sf, "typed_setting"), "system", "user", kind="kind")


@book.query(
    "f4_diff_tables",
    ("table_before", "table_after"),
    """select coalesce(a.setting_key, b.setting_key) as setting_key, a.val as old_value, b.val as new_value,
      case when a.setting_key is null then 'added' when b.setting_key is null then 'removed' else 'changed' end as change
    from table_before a full join table_after b on a.setting_key = b.setting_key where a.setting_key is null or b.setting_key is null or a.val is distinct from b.val""",
)
def f4(spark, sf):
    return ops.diff_tables(relation(spark, sf, "table_before"), relation(spark, sf, "table_after"), ["setting_key"], "val")


@book.query(
    "f5_expand_templates",
    ("template_row",),
    """with t as (select row_id, try_cast(regexp_extract(text, 'HOME(\\d+)', 1) as int) as h, row_id % 3 as k from template_row)
    select row_id, case when k = 1 then null else concat(case when h < 25 then concat('/h/NATION_', h) else '' end, '/', case k when 0 then 'dyy' else '' end) end as expanded,
      case when k = 1 then 'circular reference: LOOP' end as error from t""",
)
def f5(spark, sf):
    done = ops.expand_templates(relation(spark, sf, "template_row"), "text", relation(spark, sf, "template_variable"))
    return done.select("row_id", "expanded", "error")


@book.query(
    "f6_mask_sensitive",
    ("secret_row",),
    """select row_id, name, case when regexp_matches(upper(name), 'PASSWORD|SECRET|KEY|TOKEN') then case when length(value) <= 8 then '***'
      else concat(left(value, 2), '***', right(value, 2)) end else value end as value from secret_row""",
)
def f6(spark, sf):
    return ops.mask_sensitive(relation(spark, sf, "secret_row"))


@book.query(
    "f7_validate_rows",
    ("config_row",),
    """select entity, key, case key when 'k0' then 'pattern' when 'k1' then case when val::int < 100 then 'min' else 'max' end when 'k2' then 'type' when 'k3' then 'allowed'
        when 'k4' then case when entity % 90 < 1 then 'min' else 'max' end else 'pattern' end as violation from config_row
      where case key when 'k0' then val not like 'http%' when 'k1' then val::int not between 100 and 400 when 'k2' then val = 'maybe' when 'k3' then val = 'P'
        when 'k4' then entity % 90 not between 1 and 60 else val = 'five' end
    union all select entity, key, 'required' from (select distinct entity from config_row), (values ('k0'), ('k1'), ('k3')) r(key) where (entity, key) not in (select (entity, key) from config_row)""",
)
def f7(spark, sf):
    allowed = F.filter(F.split("allowed_text", ","), lambda a: a != "")
    rules = relation(spark, sf, "config_rule").withColumn("allowed", allowed)
    return ops.validate_rows(relation(spark, sf, "config_row"), rules)


@book.query(
    "f8_merge_named_records",
    ("record_target", "record_source"),
    """with s as (select * from record_source qualify row_number() over (partition by name order by seq desc) = 1)
    select coalesce(s.name, t.name) as name, coalesce(s.url, t.url) as url from record_target t full join s on s.name = t.name""",
)
def f8(spark, sf):
    return ops.merge_named_records(relation(spark, sf, "record_target"), relation(spark, sf, "record_source"), order="seq")
