"""Queries over the package index."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplyscope.adapters import define, relation
from supplyscope.functions.facts import CORE_PACKAGES, PRAGMAS
from supplyscope.operators import index as ops
from supplyscope.registry.base import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

define(
    "index_document",
    """select p_partkey as doc_no, case when p_partkey % 9 = 0 then concat('Mod-', cast(p_partkey as varchar(19))) else concat('Mod::N', cast(p_partkey as varchar(19))) end as requested,
    concat('{"name":"', p_name, '","version":"1.', cast(p_size as varchar(9)), '","author":"', p_brand, '","abstract":"', p_type, '","distribution":"Mod-', cast(p_partkey as varchar(19)), '",',
    '"date":"', case when p_partkey % 4 = 0 then 'yesterday' else concat('20', cast(10 + p_size % 10 as varchar(9)), '-03-0', cast(1 + p_size % 9 as varchar(9)), 'T10:20:30Z') end, '",',
    case p_partkey % 5 when 0 then '"module":[],' when 1 then '"module":[{"name":"First","version":"7","indexed":false},{"name":"Second","version":"","indexed":true}],'
      when 2 then '"module":[{"name":"Only","version":"3","indexed":false}],' when 3 then '"module":[{"name":"Dist-Name","version":"4","indexed":true}],' else '' end,
    '"metadata":{"license":[', case when p_partkey % 3 = 0 then '"perl_5","mit"' else '' end, ']},',
    '"resources":{"repository":{"url":"', case when p_partkey % 2 = 0 then '' else 'git://u' end, '","web":"http://w', cast(p_size as varchar(9)), '"},"homepage":""},',
    '"dependency":[{"phase":"runtime","module":"', p_brand, '","requires":"', cast(p_size as varchar(9)), '"},{"phase":"test","module":"', case when p_partkey % 2 = 0 then '' else 'Test::More' end, '","requires":"0"}],',
    '"stats":{"pass":', cast(p_size % 7 as varchar(9)), ',"fail":', cast(p_partkey % 3 as varchar(9)), '}}') as doc from part""",
)
define("searchable_document", "select doc_id as id, concat(source, '-', lang) as name, concat('texts in ', lang) as description, text, source as category from documents")
define(
    "index_hit",
    """select concat(p_name, ' ', cast(p_partkey as varchar(19))) as name, concat('1.', cast(p_size as varchar(9))) as version, p_brand as distribution, p_type as author,
    case when p_partkey % 4 = 0 then concat('red ', p_type) end as abstract, case when p_partkey % 3 = 0 then 'latest' else 'cpan' end as status,
    case when p_partkey % 2 = 0 then '2024-05-06T07:08:09Z' else '' end as date, case when p_partkey % 5 = 0 then 'doc' else '' end as documentation, cast(p_partkey * 37 % 1000 as double) as score from part""",
)
define(
    "index_file",
    """select case o_orderkey % 4 when 0 then concat('tool', cast(o_custkey as varchar(19)), '.pl') when 1 then concat('Tool', cast(o_custkey as varchar(19)), '-run')
      when 2 then concat('x.tool', cast(o_custkey as varchar(19))) else concat('tool', cast(o_custkey as varchar(19))) end as name,
    concat('D', cast(o_orderkey as varchar(19))) as distribution, o_orderpriority as author, '1' as version, 'a' as abstract, o_orderstatus = 'P' as directory, o_totalprice > 60000 as executable from orders""",
)
define("wanted_tool", "select concat('tool', cast(c_custkey as varchar(19))) as tool from customer")
define(
    "tool_name",
    """select case c_custkey % 7 when 0 then concat('Perl-T', cast(c_custkey as varchar(19))) when 1 then concat('A::B', cast(c_custkey as varchar(19))) when 2 then concat('cfg', cast(c_nationkey as varchar(9)))
    when 3 then concat('blt', cast(c_nationkey as varchar(9))) when 4 then concat('exe', cast(c_nationkey as varchar(9))) when 5 then concat('tidy', cast(c_custkey as varchar(19)))
    else concat('fuz', cast(c_custkey as varchar(19))) end as name from customer""",
)
define("config_map", "select concat('cfg', cast(n_nationkey as varchar(9))) as name, concat('Cfg::', n_name) as module from nation")
define("builtin_map", "select concat('blt', cast(n_nationkey as varchar(9))) as name, concat('Blt::', n_name) as module from nation union all select 'cfg1', 'No'")
define(
    "tool_executable",
    """select concat('exe', cast(n_nationkey as varchar(9))) as name, concat('Exe::', n_name) as module, case when n_nationkey % 2 = 0 then 'latest' else 'old' end as status from nation""",
)
define(
    "index_module",
    """select case c_custkey % 6 when 5 then concat(case c_nationkey % 3 when 0 then 'App::TIDY' when 1 then 'Tidy' else 'Perl::Tidy' end, cast(c_custkey as varchar(19)))
      else concat('Lib', cast(c_nationkey as varchar(9)), '::MyFuz', cast(c_custkey as varchar(19))) end as module, case when c_custkey % 11 = 0 then 'old' else 'latest' end as status from customer""",
)
define("mistyped", "select replace(replace(p_name, 'i', 'y'), 'et', 'te') as name from part union select concat(substr(p_name, 2, 30), 's') from part")
define("word_list", "select p_name as word from part union select p_type from part")
define(
    "import_name",
    """select l_orderkey as row_id, case l_linenumber when 1 then 'Carp' when 2 then 'strict' when 3 then 'List::Util' when 4 then 'autodie' else concat('X::', l_shipmode_like) end as name
    from (select l_orderkey, l_linenumber, l_returnflag as l_shipmode_like from lineitem) x""",
)
define(
    "installed_module",
    """select l_suppkey as project, concat('Mod', cast(l_partkey % 60 as varchar(9))) as name, concat(cast(l_linenumber as varchar(9)), '.', cast(cast(l_quantity as int) as varchar(9))) as version,
    l_partkey % 60 = 7 as is_core, case when l_returnflag = 'R' then 'test' else 'runtime' end as phase from lineitem""",
)


@book.query(
    "b1_flatten_package_metadata",
    ("index_document",),
    """with j as (select requested, doc, doc->'$.module' as mods, list_filter(from_json(doc->'$.module', '[{"name":"VARCHAR","version":"VARCHAR","indexed":"BOOLEAN"}]'), lambda x: x.indexed) as ix,
      from_json(doc->'$.module', '[{"name":"VARCHAR","version":"VARCHAR","indexed":"BOOLEAN"}]') as al from index_document),
    p as (select *, coalesce(ix[1].name, al[1].name, requested) as nm, coalesce(ix[1].version, al[1].version, '') as vr, (doc->>'$.stats.pass')::int as ok, (doc->>'$.stats.fail')::int as ko from j)
    select requested, case when contains(nm, '-') and not contains(requested, '-') then requested else nm end as name, coalesce(nullif(vr, ''), doc->>'$.version') as version,
      doc->>'$.author' as author, doc->>'$.distribution' as distribution, array_to_string(from_json(doc->'$.metadata.license', '["VARCHAR"]'), ', ') as license,
      coalesce(nullif(doc->>'$.resources.repository.url', ''), doc->>'$.resources.repository.web') as repository,
      case when doc->>'$.date' like '20%' then replace(replace(doc->>'$.date', 'T', ' '), 'Z', '') end as released,
      round(case when ok + ko = 0 then 0 else ok / (ok + ko) * 5.0 end, 6) as rating, ok > 0 as has_tests from p""",
)
def b1(spark, sf):
    flat = ops.flatten_package_metadata(relation(spark, sf, "index_document"))
    kept = ["requested", "name", "version", "author", "distribution", "license", "repository", "has_tests"]
    return flat.select(*kept, F.round("rating", 6).alias("rating"), F.date_format("released", "yyyy-MM-dd HH:mm:ss").alias("released"))


@book.query(
    "b2_explode_dependencies",
    ("index_document",),
    """select requested as package, d->>'$.module' as dep, d->>'$.requires' as constraint_text, d->>'$.phase' as phase, 'requires' as type
    from (select requested, unnest(from_json(doc->'$.dependency', '["JSON"]')) as d from index_document) where d->>'$.module' <> ''""",
)
def b2(spark, sf):
    return ops.explode_dependencies(relation(spark, sf, "index_document")).withColumnRenamed("constraint", "constraint_text")


@book.query(
    "b3_search_documents",
    ("searchable_document",),
    """with l as (select id, unnest(string_split(text, chr(10))) as row, generate_subscripts(string_split(text, chr(10)), 1) as no from searchable_document),
    m as (select id, list(case when length(concat('Line ', no, ': ', trim(row))) > 100 then concat(substr(concat('Line ', no, ': ', trim(row)), 1, 97), '...') else concat('Line ', no, ': ', trim(row)) end order by no) as ms
      from l where contains(lower(row), 'en') group by id),
    d as (select id, name, description, contains(lower(name), 'en')::int as n, contains(lower(description), 'en')::int as de from searchable_document),
    s as (select d.id, n, de, name, description, coalesce(ms, [])[1:5 - n - de] as ls from d left join m on d.id = m.id where n + de > 0 or ms is not null)
    select id, (10 * n + 5 * de + len(ls))::int as score, array_to_string(list_concat(case when n = 1 then [concat('Name: ', name)] else [] end,
      list_concat(case when de = 1 then [concat('Description: ', description)] else [] end, ls)), ' / ') as matches from s order by score desc, id limit 25""",
)
def b3(spark, sf):
    found = ops.search_documents(relation(spark, sf, "searchable_document"), " EN ", 25)
    return found.withColumn("matches", F.array_join("matches", " / "))


@book.query("b4_list_by_category", ("searchable_document",), "select category, name, id from searchable_document")
def b4(spark, sf):
    return ops.list_by_category(relation(spark, sf, "searchable_document")).select("category", "name", "id")


@book.query("b4_categories", ("searchable_document",), "select distinct category from searchable_document")
def b4_categories(spark, sf):
    return ops.categories(relation(spark, sf, "searchable_document"))


@book.query("b4_one_category", ("searchable_document",), "select id, name from searchable_document where category = (select min(category) from searchable_document)")
def b4_one(spark, sf):
    docs = relation(spark, sf, "searchable_document")
    first = docs.agg(F.min("category")).first()[0]
    return ops.list_by_category(docs, first).select("id", "name")


@book.query(
    "b5_search_packages",
    ("index_hit",),
    """select name, version, distribution, author, abstract, score, status = 'latest' as is_latest, documentation <> '' as has_documentation,
      case when date <> '' then '2024-05-06 07:08:09' end as released, count(*) over () as total
    from index_hit where contains(lower(name), 'red') or contains(lower(coalesce(abstract, '')), 'red') order by score desc, name, version limit 50""",
)
def b5(spark, sf):
    found = ops.search_packages(relation(spark, sf, "index_hit"), "Red", 50)
    return found.withColumn("released", F.date_format("released", "yyyy-MM-dd HH:mm:ss"))


@book.query(
    "b6_find_executables",
    ("index_file", "wanted_tool"),
    """with w as (select *, unnest(list_distinct(list_append(regexp_split_to_array(lower(name), '[^a-z0-9_]+'), lower(regexp_replace(name, '\\.pl$', ''))))) as word,
      regexp_replace(name, '\\.pl$', '') as tool_name from index_file where executable and not directory)
    select tool, name as file_name, tool_name, distribution, tool_name = tool as is_exact_match from w join wanted_tool on word = tool
    qualify row_number() over (partition by tool order by tool_name = tool desc, name, distribution, version) <= 10""",
)
def b6(spark, sf):
    found = ops.find_executables(relation(spark, sf, "index_file"), relation(spark, sf, "wanted_tool"))
    return found.select("tool", "file_name", "tool_name", "distribution", "is_exact_match")


FUZZY = """f as (select name, module as best, 1 - levenshtein(lower(name), lower(split_part(module, '::', -1))) / greatest(length(name), length(split_part(module, '::', -1)))::double as score
      from (select distinct name from tool_name) n join (select distinct module from index_module where status = 'latest') i on contains(lower(module), lower(name))),
    fz as (select * from f where score > 0.5 qualify row_number() over (partition by name order by score desc, best) = 1)"""


@book.query(
    "b7_resolve_names",
    ("tool_name", "config_map", "builtin_map", "tool_executable", "index_module"),
    f"""with {FUZZY}, n as (select distinct name from tool_name),
    k as (select distinct module from index_module where status = 'latest'),
    t as (select name, 1 as tier, name as module, 'explicit' as source from n where contains(name, '::') or regexp_matches(name, '^(Perl|App|Test|Data|File|JSON|XML|Web|HTTP|Net|DBI|DBD)(-[A-Z][A-Za-z0-9]*)+$')
      union all select name, 2, module, 'config' from n join config_map using (name) union all select name, 3, module, 'builtin' from n join builtin_map using (name)
      union all select name, 4, module, 'executable' from n join (select * from tool_executable where status = 'latest') using (name)
      union all select name, 5 + s.i, module, 'pattern' from n, (values (0), (1), (2), (3)) s(i), k where module = case s.i when 0 then concat('App::', upper(name[1]), lower(name[2:])) when 1 then concat('App::', upper(name))
        when 2 then concat(upper(name[1]), lower(name[2:])) else concat('Perl::', upper(name[1]), lower(name[2:])) end
      union all select name, 9, best, 'fuzzy' from fz)
    select n.name, arg_min(module, (tier, module)) as module, arg_min(source, (tier, module)) as source from n left join t on n.name = t.name group by n.name""",
)
def b7(spark, sf):
    tables = [relation(spark, sf, t) for t in ("tool_name", "config_map", "builtin_map", "tool_executable", "index_module")]
    return ops.resolve_names(*tables)


@book.query("b8_fuzzy_match", ("tool_name", "index_module"), f"with {FUZZY} select name, best, round(score, 6) as score from fz")
def b8(spark, sf):
    index = relation(spark, sf, "index_module").where(F.col("status") == "latest")
    return ops.fuzzy_match(relation(spark, sf, "tool_name"), index).withColumn("score", F.round("score", 6))


@book.query(
    "b9_suggest_similar",
    ("mistyped", "word_list"),
    """with p as (select name, word, greatest(length(name), length(word)) as lo, least(length(name), length(word)) as sh from mistyped, word_list),
    s as (select name, word, case when name = word then 1.0 else 0.7 * len(list_filter(range(1, sh + 1), lambda i: name[i:i] = word[i:i])) / lo
      + 0.3 * list_sum(list_transform(list_distinct(string_split(name, '')), lambda c: least(length(name) - length(replace(name, c, '')), length(word) - length(replace(word, c, ''))))) / lo end as score from p)
    select name, word, round(score, 6) as score from s where round(score, 12) > 0.6 qualify row_number() over (partition by name order by round(score, 12) desc, word) <= 3""",
)
def b9(spark, sf):
    found = ops.suggest_similar(
        relation(spark, sf, "mistyped"), relation(spark, sf, "word_list")
    )
    return found.withColumn("score", F.round("score", 6))


CORE = ", ".join(f"'{c}'" for c in CORE_PACKAGES)


@book.query(
    "b10_flag_core", ("import_name",), f"select name, name in ({CORE}) as is_core, count(*) as n from import_name group by name"
)
def b10(spark, sf):
    return ops.flag_core(relation(spark, sf, "import_name")).groupBy("name", "is_core").agg(F.count("*").alias("n"))


@book.query(
    "b10_drop_core",
    ("import_name",),
    f"""select row_id, name from import_name where name not in ({CORE}, {', '.join(f"'{p}'" for p in PRAGMAS)})""",
)
def b10_drop(spark, sf):
    return ops.drop_core(relation(spark, sf, "import_name")).select("row_id", "name")


@book.query(
    "b11_availability_split",
    ("tool_name", "config_map"),
    "select distinct name, name in (select name from config_map) as available from tool_name",
)
def b11(spark, sf):
    return ops.availability_split(relation(spark, sf, "tool_name"), relation(spark, sf, "config_map"))


@book.query(
    "b12_installed_listing",
    ("installed_module",),
    """select project, name, version, phase from installed_module where lower(name) like '%mod1%' and not is_core and phase = 'runtime'
    qualify row_number() over (partition by project, name order by split_part(version,'.',1)::int desc, split_part(version,'.',2)::int desc, version) = 1""",
)
def b12(spark, sf):
    listed = ops.installed_listing(relation(spark, sf, "installed_module"), pattern="mod1", include_core=False, latest_only=True)
    return listed.select("project", "name", "version", "phase")


@book.query("b12_full_listing", ("installed_module",), "select project, name, version, phase from installed_module")
def b12_full(spark, sf):
    return ops.installed_listing(relation(spark, sf, "installed_module"), dev=True).select("project", "name", "version", "phase")
