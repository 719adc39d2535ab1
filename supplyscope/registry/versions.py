"""Queries over package versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplyscope.adapters import define, relation
from supplyscope.operators import versions as ops
from supplyscope.registry.base import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

define(
    "release_feed",
    """select p_partkey as release_id, p_brand as product,
    case when p_partkey % 3 = 0 then concat('5.0', cast(10 + p_size % 30 as varchar(9)), '00', cast(p_partkey % 10 as varchar(9)))
    else concat('5.', cast(p_size as varchar(9)), '.', cast(p_partkey % 10 as varchar(9))) end as version,
    case when p_partkey % 7 = 0 then 'developer' else 'released' end as maturity, p_partkey % 11 <> 0 as authorized,
    p_partkey as date from part""",
)
define(
    "product_release",
    """select o_custkey as product, concat('r', cast(o_orderkey as varchar(19))) as tag, o_orderstatus = 'P' as draft,
    o_orderstatus = 'O' as prerelease, o_orderdate as created_at from orders""",
)
define(
    "product_asset",
    """select o_custkey as product, concat('r', cast(o_orderkey as varchar(19))) as tag,
    case o_orderkey % 4 when 0 then 'tool-linux-amd64' when 1 then 'tool-1.0-rc1-linux-amd64.tar.gz'
    when 2 then 'tool-1.0-darwin-arm64.tar.gz' else 'other-linux-amd64' end as name from orders""",
)
define(
    "version_listing",
    """select p_partkey as row_id, p_type as bucket, case when p_partkey % 6 = 0 then p_name
    when p_partkey % 6 = 1 then concat('v5.', cast(p_size as varchar(9)))
    when p_partkey % 6 = 2 then concat('5.', cast(p_size as varchar(9)), '.2-RC1')
    else concat('perl-5.', cast(p_size as varchar(9)), '.', cast(p_partkey % 9 as varchar(9))) end as version from part""",
)
define(
    "remote_tag",
    """select p_partkey as tag_id, case p_partkey % 3 when 0 then 'origin' when 1 then 'team' else '' end as remote,
    case p_partkey % 5 when 0 then concat('v5.', cast(p_size as varchar(9)), '.', cast(p_partkey % 10 as varchar(9)))
    when 1 then concat('v5.', cast(p_size as varchar(9)), '.0-RC2-', cast(p_partkey % 4 as varchar(9)))
    when 2 then concat('fork-a-5.', cast(p_size as varchar(9)), '.1') when 3 then concat('v5.', cast(p_size as varchar(9)), '-RC1')
    else p_name end as tag from part""",
)

PARTS = "split_part({v},'.',1)::bigint as maj, split_part({v},'.',2)::bigint as mnr, split_part({v},'.',3)::bigint as pat"


@book.query(
    "a1_rank_versions",
    ("tagged_release",),
    f"""with cut as (select release_id, package, version, split_part(version,'-',1) as core,
      case when contains(version,'-rc.') then split_part(version,'-rc.',2)::bigint end as rc from tagged_release),
    num as (select *, {PARTS.format(v='core')} from cut)
    select release_id, package, version, row_number() over (partition by package
      order by maj desc, mnr desc, pat desc, rc desc nulls first, version, release_id)::bigint as ver_rank from num""",
)
def a1(spark, sf):
    ranked = ops.rank_versions(relation(spark, sf, "tagged_release"), tie=["release_id"])
    return ranked.select("release_id", "package", "version", "ver_rank")


@book.query(
    "a1_rank_versions_dotted",
    ("package_release",),
    f"""with num as (select *, {PARTS.format(v='version')} from package_release)
    select release_id, package, version, row_number() over (partition by package
      order by maj desc, mnr desc, pat desc, version, release_id)::bigint as ver_rank from num""",
)
def a1_dotted(spark, sf):
    ranked = ops.rank_versions(relation(spark, sf, "package_release"), scheme="dotted", tie=["release_id"])
    return ranked.select("release_id", "package", "version", "ver_rank")


@book.query(
    "a2_latest_per_package",
    ("tagged_release",),
    f"""with cut as (select *, split_part(version,'-',1) as core,
      case when contains(version,'-rc.') then split_part(version,'-rc.',2)::bigint end as rc from tagged_release),
    num as (select *, {PARTS.format(v='core')} from cut),
    best as (select package, version, row_number() over (partition by package
      order by maj desc, mnr desc, pat desc, rc desc nulls first, version, release_id) as rn from num)
    select b.package, b.version, n.n_versions from best b
    join (select package, count(distinct version) as n_versions from tagged_release group by package) n using (package) where rn = 1""",
)
def a2(spark, sf):
    latest = ops.latest_per_package(relation(spark, sf, "tagged_release"), tie=["release_id"])
    return latest.select("package", "version", "n_versions")


@book.query("a2_package_versions", ("tagged_release",), "select distinct package, version from tagged_release")
def a2_versions(spark, sf):
    return ops.package_versions(relation(spark, sf, "tagged_release"))


@book.query(
    "a3_outdated_packages",
    ("package_release", "installed_package"),
    f"""with idx as (select package, version, {PARTS.format(v='version')} from package_release where regexp_matches(lower(package), 'brand#1')),
    top as (select * from (select *, row_number() over (partition by package order by maj desc, mnr desc, pat desc) rn from idx) where rn = 1),
    have as (select * from (select project, package, version, {PARTS.format(v='version')} from installed_package)
      qualify row_number() over (partition by project, package order by maj desc, mnr desc, pat desc) = 1)
    select h.project, h.package, h.version as installed, t.version as latest from have h join top t using (package)
    where (t.maj, t.mnr, t.pat) > (h.maj, h.mnr, h.pat) and h.package <> 'Brand#13'""",
)
def a3(spark, sf):
    return ops.outdated_packages(
        relation(spark, sf, "installed_package"),
        relation(spark, sf, "package_release"),
        pattern="brand#1",
        core=["Brand#13"],
    )


@book.query(
    "a4_best_match",
    ("requirement", "package_release"),
    f"""with avail as (select package, version, {PARTS.format(v='version')} from package_release),
    req as (select req_id, line_no, package, concat(op, ' ', version) as constraint_text, op, {PARTS.format(v='version')} from requirement),
    ask as (select distinct package, op, maj, mnr, pat from req),
    best as (select k.package, k.op, k.maj, k.mnr, k.pat, max((a.maj, a.mnr, a.pat)) as top from ask k join avail a on a.package = k.package
      and case k.op when '>=' then (a.maj, a.mnr, a.pat) >= (k.maj, k.mnr, k.pat)
        when '<' then (a.maj, a.mnr, a.pat) < (k.maj, k.mnr, k.pat)
        when '==' then (a.maj, a.mnr, a.pat) = (k.maj, k.mnr, k.pat)
        else a.maj = k.maj and a.mnr = k.mnr and a.pat >= k.pat end group by all)
    select r.req_id, r.line_no, r.package, r.constraint_text,
      case when top is not null then concat(b.top[1], '.', b.top[2], '.', b.top[3]) end as best, top is not null as satisfiable
    from req r left join best b on r.package = b.package and r.op = b.op and r.maj = b.maj and r.mnr = b.mnr and r.pat = b.pat""",
)
def a4(spark, sf):
    asked = relation(spark, sf, "requirement").select(
        "req_id", "line_no", "package", F.concat_ws(" ", "op", "version").alias("constraint_text")
    )
    return ops.best_match(asked, relation(spark, sf, "package_release"), constraint="constraint_text")


define(
    "rough_requirement",
    """select req_id, line_no, package, op, version, case when req_id % 7 = 0 then concat(op, ' nonsense') when req_id % 7 = 1 then '>= 99.0.0' else concat(op, ' ', version) end as constraint_text
    from requirement""",
)
define(
    "version_name",
    """select case p_partkey % 7 when 0 then 'stable' when 1 then '@latest' when 2 then 'dev' when 3 then concat('@mine', cast(p_partkey % 5 as varchar(9)))
    when 4 then concat('5.', cast(p_partkey % 40 as varchar(9)), '.0') when 5 then '@system' else concat('@none', cast(p_partkey % 9 as varchar(9))) end as name from part""",
)
define("version_alias", "select concat('mine', cast(n_nationkey as varchar(9))) as name, concat('5.', cast(n_nationkey as varchar(9)), '.1') as version from nation where n_nationkey < 4")


@book.query(
    "a4_match_status",
    ("rough_requirement", "package_release"),
    f"""with avail as (select package, version, {PARTS.format(v='version')} from package_release),
    req as (select req_id, line_no, package, op, {PARTS.format(v='version')} from rough_requirement where req_id % 7 > 1),
    ask as (select distinct package, op, maj, mnr, pat from req),
    good as (select distinct k.package, k.op, k.maj, k.mnr, k.pat from ask k join avail a on a.package = k.package
      and case k.op when '>=' then (a.maj, a.mnr, a.pat) >= (k.maj, k.mnr, k.pat)
        when '<' then (a.maj, a.mnr, a.pat) < (k.maj, k.mnr, k.pat)
        when '==' then (a.maj, a.mnr, a.pat) = (k.maj, k.mnr, k.pat)
        else a.maj = k.maj and a.mnr = k.mnr and a.pat >= k.pat end)
    select r.req_id, r.line_no, case when g.op is not null then 'matched' else 'unsatisfiable' end as status
    from req r left join good g on r.package = g.package and r.op = g.op and r.maj = g.maj and r.mnr = g.mnr and r.pat = g.pat
    union all select req_id, line_no, case req_id % 7 when 0 then 'invalid' else 'unsatisfiable' end from rough_requirement where req_id % 7 <= 1""",
)
def a4_status(spark, sf):
    matched = ops.best_match(relation(spark, sf, "rough_requirement"), relation(spark, sf, "package_release"), constraint="constraint_text")
    return ops.match_status(matched, "constraint_text").select("req_id", "line_no", "status")


@book.query(
    "a6_version_aliases",
    ("version_name", "version_alias", "package_release"),
    f"""with v as (select version, {PARTS.format(v='version')} from package_release),
    n as (select distinct name, ltrim(name, '@') as alias from version_name)
    select n.name, coalesce(a.version, case when alias in ('stable', 'latest') then (select arg_max(version, (maj, mnr, pat)) from v where mnr % 2 = 0)
      when alias = 'dev' then (select arg_max(version, (maj, mnr, pat)) from v) when alias = 'system' then '5.1.2' when n.name not like '@%' then n.name end) as version,
      case when a.version is null and n.name like '@%' and alias not in ('stable', 'latest', 'dev', 'system') then concat('unknown version alias: ', n.name) end as error
    from n left join version_alias a on a.name = alias""",
)
def a6_aliases(spark, sf):
    names, aliases, releases = (relation(spark, sf, t) for t in ("version_name", "version_alias", "package_release"))
    return ops.resolve_aliases(names, aliases, releases, system="5.1.2")


@book.query(
    "a5_missing_requirements",
    ("requirement", "installed_package"),
    """select req_id, line_no, requirer as project, package from requirement r where not exists
    (select 1 from installed_package i where i.project = r.requirer and i.package = r.package)""",
)
def a5(spark, sf):
    reqs = relation(spark, sf, "requirement").withColumnRenamed("requirer", "project")
    missing = ops.missing_requirements(reqs, relation(spark, sf, "installed_package"))
    return missing.select("req_id", "line_no", "project", "package")


@book.query(
    "a5_requirement_status",
    ("requirement", "installed_package"),
    """select r.requirer as project, count(*) filter (where i.package is null) as n_missing,
      count(*) filter (where i.package is null) = 0 as ok
    from (select distinct requirer, package from requirement) r
    left join (select distinct project, package from installed_package) i on i.project = r.requirer and i.package = r.package
    group by r.requirer""",
)
def a5_status(spark, sf):
    reqs = relation(spark, sf, "requirement").withColumnRenamed("requirer", "project")
    return ops.requirement_status(reqs, relation(spark, sf, "installed_package"))


@book.query(
    "a5_unmet_constraints",
    ("requirement", "installed_package"),
    f"""with have as (select project, package, {PARTS.format(v='version')} from installed_package),
    req as (select req_id, line_no, requirer, package, op, {PARTS.format(v='version')} from requirement)
    select req_id, line_no, requirer as project, package from req k where not exists (select 1 from have a
      where a.project = k.requirer and a.package = k.package
      and case k.op when '>=' then (a.maj, a.mnr, a.pat) >= (k.maj, k.mnr, k.pat)
        when '<' then (a.maj, a.mnr, a.pat) < (k.maj, k.mnr, k.pat)
        when '==' then (a.maj, a.mnr, a.pat) = (k.maj, k.mnr, k.pat)
        else a.maj = k.maj and a.mnr = k.mnr and a.pat >= k.pat end)""",
)
def a5_constraints(spark, sf):
    reqs = relation(spark, sf, "requirement").select(
        "req_id",
        "line_no",
        F.col("requirer").alias("project"),
        "package",
        F.concat("op", "version").alias("constraint_text"),
    )
    have = relation(spark, sf, "installed_package")
    missing = ops.missing_requirements(reqs, have, constraint="constraint_text")
    return missing.select("req_id", "line_no", "project", "package")


FEED = """with num as (select *, case when regexp_matches(version, '^\\d+\\.\\d{{6}}$')
      then concat('5.', (split_part(version,'.',2)[1:3])::int, '.', (split_part(version,'.',2)[4:6])::int) else version end as v
      from release_feed where authorized),
    one as (select *, row_number() over (partition by product, v order by date desc) rn from num {where})
    select product, v as version, date, maturity from one where rn = 1 {after}"""


@book.query(
    "a6_select_channel_releases",
    ("release_feed",),
    FEED.format(where="where maturity = 'released'", after="and split_part(v,'.',2)::int % 2 = 0"),
)
def a6(spark, sf):
    chosen = ops.select_channel_releases(relation(spark, sf, "release_feed"), product=["product"])
    return chosen.select("product", "version", "date", "maturity")


@book.query("a6_channel_with_dev", ("release_feed",), FEED.format(where="", after=""))
def a6_dev(spark, sf):
    chosen = ops.select_channel_releases(relation(spark, sf, "release_feed"), include_dev=True, product=["product"])
    return chosen.select("product", "version", "date", "maturity")


@book.query(
    "a7_pick_release",
    ("product_release", "product_asset"),
    """select product, tag, prerelease, created_at from (select r.*, row_number() over (partition by product
      order by prerelease, created_at desc, tag) rn from product_release r where not draft and exists (select 1 from product_asset a
      where a.product = r.product and a.tag = r.tag and regexp_matches(a.name, '^tool-(.*-)?linux-amd64'))) where rn = 1""",
)
def a7(spark, sf):
    picked = ops.pick_release(
        relation(spark, sf, "product_release"), relation(spark, sf, "product_asset"), "tool", "linux", "amd64"
    )
    return picked.select("product", "tag", "prerelease", "created_at")


@book.query(
    "a8_canonical_version_order",
    ("version_listing",),
    """with cut as (select *, regexp_extract(version, '^(?:perl-)?v?(\\d+\\.\\d+(?:\\.\\d+)?)(?:-RC\\d+)?$', 1) as core from version_listing),
    num as (select *, core <> '' as ok, try_cast(split_part(core,'.',2) as int) as mnr,
      coalesce(try_cast(nullif(split_part(core,'.',3),'') as int), 0) as pat from cut)
    select row_id, bucket, version, row_number() over (partition by bucket order by ok desc,
      case when ok then mnr end desc, case when ok then pat end desc, version, row_id)::bigint as pos from num""",
)
def a8(spark, sf):
    return ops.canonical_version_order(relation(spark, sf, "version_listing"), ["bucket"], tie=["row_id"])


@book.query(
    "a9_classify_tags",
    ("remote_tag",),
    """with hit as (select tag_id, remote, tag,
      regexp_extract(tag, '^v(\\d+\\.\\d+\\.\\d+)(-RC\\d+)?(-\\d+)?$', 1) as up,
      regexp_extract(tag, '^v\\d+\\.\\d+\\.\\d+(?:-RC\\d+)?-(\\d+)$', 1) as rel,
      regexp_extract(tag, '^([a-z][a-z0-9-]*?)-(\\d+\\.\\d+\\.\\d+)$', 1) as fork,
      regexp_extract(tag, '^([a-z][a-z0-9-]*?)-(\\d+\\.\\d+\\.\\d+)$', 2) as fv from remote_tag)
    select tag_id, remote, tag, case when up <> '' then up else fv end as version,
      case when up <> '' then '' else fork end as fork,
      case when up <> '' then try_cast(nullif(rel, '') as int) end as release_no,
      case when remote in ('', 'origin') then case when up <> '' then up else fv end
        when up <> '' then concat(remote, '/', up) else concat(remote, '/', fork, '-', fv) end as display
    from hit where up <> '' or fv <> ''""",
)
def a9(spark, sf):
    return ops.classify_tags(relation(spark, sf, "remote_tag"))
