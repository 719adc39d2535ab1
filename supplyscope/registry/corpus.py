"""Queries over source text, manifests, lock files, archives, logs and code facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplyscope.adapters import define, relation, table
from supplyscope.functions import masks as m
from supplyscope.functions.facts import DETECTION_CORE, PRAGMAS
from supplyscope.operators import checks, corpus
from supplyscope.registry.base import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

define(
    "import_source",
    """select doc_id as file_id, concat('# use Hidden;', chr(10), 'use ', upper(source), '::', upper(lang), ' qw(a b);', chr(10), '  use strict;', chr(10),
    'use v5.36;', chr(10), 'use 5.010;', chr(10), 'use List::Util;', chr(10), 'require ''Lib/', lang, '.pm'';', chr(10), 'require Foo::', lang, ';', chr(10),
    'use ', upper(source), '::', upper(lang), ';', chr(10), text) as text from documents""",
)
define(
    "script_source",
    """select doc_id as file_id, case doc_id % 3 when 0 then concat('#!/usr/bin/perl', chr(10), '=begin meta', chr(10), 'dependencies = [', chr(10), '  "DBI",', chr(10),
      '  "X::', source, ' >= ', cast(doc_id % 7 as varchar(9)), '"', chr(10), ']', chr(10), 'perl_version = "5.', cast(doc_id % 30 as varchar(9)), '"', chr(10), '=end meta', chr(10), text)
    when 1 then concat('# /// meta', chr(10), '# dependencies = ["A::', lang, '", "B::', source, '"]', chr(10), '# description = "about ', lang, '"', chr(10), '# ///', chr(10), text)
    else text end as text from documents""",
)
define(
    "manifest_source",
    """select doc_id as file_id, concat('requires ''perl'', ''5.10'';', chr(10), '# requires ''No'';', chr(10), 'requires "', source, '::Core", "', cast(doc_id % 9 as varchar(9)), '.1";', chr(10),
    'on ''test'' => sub {', chr(10), '  requires ''Test::', lang, ''';', chr(10), '  recommends ''Opt::', lang, ''', ''2'';', chr(10), '};', chr(10),
    'feature ''f', cast(doc_id % 4 as varchar(9)), ''', sub {', chr(10), ' suggests ''S::', source, ''';', chr(10), ' on ''develop'' => sub {', chr(10), '  requires ''Dev::X'';', chr(10), ' };', chr(10),
    'on ''MSWin32'' => sub {', chr(10), '  requires ''Win::', lang, ''';', chr(10), '};', chr(10), 'test_requires ''T::', source, ''';', chr(10), text) as text from documents""",
)
define(
    "lock_source",
    """select doc_id as file_id, concat('# carton snapshot format: version 1.0', chr(10), '# Perl version: 5.', cast(doc_id % 30 as varchar(9)), chr(10), 'DISTRIBUTIONS', chr(10),
    '  ', source, '-1.', cast(doc_id % 9 as varchar(9)), chr(10), '    pathname: A/B/', lang, '.tar.gz', chr(10), '    provides:', chr(10), '      ', source, '::P ', cast(doc_id % 5 as varchar(9)), chr(10),
    '      ', source, '::Q undef', chr(10), '    requirements:', chr(10), '      ', lang, '::R 0', chr(10), '  Empty-', lang, chr(10), '    pathname: none.tgz', chr(10)) as text from documents""",
)
define(
    "code_source",
    """select doc_id as file_id, concat('package ', upper(source), '::', upper(lang), ';', chr(10), '# my $hidden;', chr(10), 'my $x', cast(doc_id % 9 as varchar(9)), ' = 1; our @list; my ($a, %h);', chr(10),
    'sub run_', lang, ' { my $y; }', chr(10), text) as text from documents""",
)
define(
    "diagnostic",
    """select event_id as diag_id, event_id % (select count(*) from documents) as file_id, cast(floor(value * 60) as int) as start,
    event_type as severity, concat('c', cast(user_id % 9 as varchar(9))) as code, 'm' as message from events""",
)
define(
    "code_ref",
    """select l_orderkey * 8 + l_linenumber as ref_id, concat(p_brand, '::', p_type, '::f', cast(p_size % 9 as varchar(9))) as ref from lineitem join part on l_partkey = p_partkey""",
)
define(
    "code_file",
    """select distinct concat(case when p_size <= 10 then 'other/' when p_size % 2 = 0 then 'lib/' else 'local/' end, p_brand, '/', p_type, '.pm') as path from part""",
)
define(
    "code_symbol",
    """select path, name, max(return_mask) as return_mask from (select concat(case when p_size % 2 = 0 then 'lib/' else 'local/' end, p_brand, '/', p_type, '.pm') as path,
    concat('f', cast(p_size % 9 as varchar(9))) as name, cast(p_partkey % 5 as bigint) as return_mask from part) x group by path, name""",
)
CALLED = "case l_partkey % 8 when 0 then 'push' when 1 then 'keys' when 2 then 'length' when 3 then 'substr' when 4 then 'chr' when 5 then 'join' when 6 then 'bless' else 'mine' end"
_ARGUMENT = """select l_orderkey * 8 + l_linenumber as call_id, {called} as name, l_linenumber % 4 as n_args, {no} as arg_no, case (l_suppkey + {no}) % 9 when 0 then cast(0 as bigint)
    when 1 then 4 when 2 then 12 when 3 then 28 when 4 then 1 when 5 then 8192 when 6 then 16384 when 7 then 5 else 4608 end as mask from lineitem where {no} < l_linenumber % 4"""
define(
    "call_fact",
    f"""select l_orderkey * 8 + l_linenumber as call_id, {CALLED} as name, l_linenumber % 4 as n_args, cast(null as int) as arg_no, cast(0 as bigint) as mask
    from lineitem where l_linenumber % 4 = 0 union all """
    + " union all ".join(_ARGUMENT.format(called=CALLED, no=no) for no in range(3)),
)
define(
    "operand_fact",
    """select l_orderkey * 8 + l_linenumber as op_id, case l_partkey % 6 when 0 then '+' when 1 then '==' when 2 then '.' when 3 then '&&' when 4 then '=~' else 'x' end as name,
    case when l_suppkey % 2 = 0 then 'left' else 'right' end as side, case l_suppkey % 7 when 0 then cast(0 as bigint) when 1 then 4 when 2 then 28 when 3 then 64 when 4 then 8192 when 5 then 1 else 29 end as mask from lineitem""",
)
define(
    "branch_fact",
    """select o_custkey as file_id, concat('$v', cast(o_orderkey % 3 as varchar(9))) as var, cast(1 as bigint) * case o_orderstatus when 'F' then 4 when 'O' then 28 else 512 end as mask,
    o_custkey % 2 = 0 as has_else from orders""",
)
define(
    "prior_mask",
    """select c_custkey as file_id, '$v1' as var, case when c_nationkey % 2 = 0 then cast(1 as bigint) else 4096 end as mask from customer""",
)
define(
    "param_fact",
    """select l_suppkey as file_id, concat('s', cast(l_partkey % 5 as varchar(9))) as sub, concat('$p', cast(l_linenumber % 4 as varchar(9))) as param,
    case when l_quantity > 10 then cast(28 as bigint) when l_quantity > 5 then 524287 else 12 end as mask from lineitem
    union all select s_suppkey, 'free', '$q', 524287 from supplier""",
)
define(
    "guard_fact",
    """select l_orderkey * 8 + l_linenumber as fact_id, case l_partkey % 4 when 0 then 'defined' when 1 then 'ref' when 2 then 'isa' else 'bool' end as guard,
    case l_linenumber % 4 when 0 then 'HASH' when 1 then '' when 2 then 'My::Class' else 'REF' end as ref_type, l_returnflag = 'R' as negated,
    case l_suppkey % 6 when 0 then cast(0 as bigint) when 1 then 1 when 2 then 5 when 3 then 4610 when 4 then 524287 else 513 end as mask from lineitem""",
)
define(
    "artifact",
    """select doc_id, concat('dl/', case when doc_id % 4 = 0 then 'perl-5.' else 'mod-' end, cast(doc_id as varchar(19)), '.tar.gz') as name, text as content from documents""",
)
define(
    "archive_entry",
    """select o_custkey as archive, concat('d', cast(o_orderkey % 3 as varchar(9))) as dir, concat('d', cast(o_orderkey % 3 as varchar(9)), '/',
    case o_orderkey % 5 when 0 then 'Build.PL' when 1 then 'Makefile.PL' when 2 then 'Makefile' when 3 then 'README' else 'sub/Build.PL' end) as entry from orders""",
)
define(
    "manifest_row",
    """select o_custkey as project, concat('M', cast(o_orderkey % 50 as varchar(9))) as module, case when o_orderstatus = 'P' then 'test' else 'runtime' end as phase,
    min(concat('1.', cast(o_orderkey % 9 as varchar(9)))) as version from orders group by 1, 2, 3""",
)
define(
    "manifest_change",
    """select o_custkey as project, concat(case when o_totalprice > 250000 then 'M' else 'N' end, cast(o_orderkey % 60 as varchar(9))) as module,
    case when o_orderpriority = '5-LOW' then 'test' else 'runtime' end as phase, concat('9.', cast(o_orderkey % 7 as varchar(9))) as version, o_orderkey as seq from orders""",
)
define(
    "locked_install",
    """select o_custkey as project, concat(case when o_totalprice > 100000 then 'M' else 'N' end, cast(o_orderkey % 50 as varchar(9))) as module,
    max(concat('2.', cast(o_orderkey % 9 as varchar(9)))) as version from orders group by 1, 2""",
)
_LOG_LINES = (
    """case when event_type = 'signup' then concat('# Testing t/', cast(event_id % 9 as varchar(9)), '.t') when event_type = 'view' and event_id % 50 = 0 then '1..7'
      else concat('note ', event_type) end""",
    """case when event_type = 'error' then concat('not ok ', cast(event_id as varchar(19)), case when event_id % 3 = 0 then '' else ' - odd' end)
      else concat('ok ', cast(event_id as varchar(19))) end""",
    """case when event_id % 4 = 0 then '#   expected 1' when event_id % 4 = 1 and event_id % 11 = 0 then 'Can''t locate X.pm in @INC'
      when event_id % 97 = 2 then 'syntax error at line 3' else 'plain' end""",
    """case when event_id % 4 = 0 then concat('# got ', cast(event_id % 5 as varchar(9)), case when user_id % 10 = 0 then ' Permission denied' else '' end)
      when event_id % 1009 = 1 then 'Files=3, Tests=40' when event_id % 1013 = 5 then 'Result: FAIL' else '' end""",
)
define(
    "tap_log",
    " union all ".join(
        f"select user_id as run, event_id * 4 + {no} as line_no, {line} as line from events" for no, line in enumerate(_LOG_LINES)
    ),
)


def names(items):
    return ", ".join(f"'{i}'" for i in items)


IMPORTS = f"""with l as (select file_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) as line from import_source),
    n as (select file_id, case when line like 'use %' then case when regexp_matches(line, '^use\\s+v') then '' else regexp_extract(line, '^use\\s+([A-Za-z_][A-Za-z0-9_:]*)', 1) end
      when line like 'require %' then replace(regexp_replace(regexp_extract(line, '^require\\s+[''"]?([^''";\\s]+)', 1), '\\.pm$', ''), '/', '::') else '' end as module from l)
    select distinct file_id, module from n where module <> '' and module not in ({{skip}})"""


@book.query("d1_extract_imports", ("import_source",), IMPORTS.format(skip=names(PRAGMAS)))
def d1(spark, sf):
    return corpus.extract_imports(relation(spark, sf, "import_source"))


@book.query("d1_detected_dependencies", ("import_source",), IMPORTS.format(skip=names(PRAGMAS + DETECTION_CORE)))
def d1_detected(spark, sf):
    return corpus.extract_imports(relation(spark, sf, "import_source"), drop_core=True)


@book.query(
    "d2_extract_inline_metadata",
    sql="""select doc_id as file_id, case doc_id % 3 when 0 then concat('DBI,X::', source, ' >= ', doc_id % 7) when 1 then concat('A::', lang, ',B::', source) else '' end as dependencies,
    case when doc_id % 3 = 0 then concat('5.', doc_id % 30) end as perl_version, case when doc_id % 3 = 1 then concat('about ', lang) end as description,
    cast(null as varchar) as exclude_newer from documents""",
)
def d2(spark, sf):
    df = corpus.extract_inline_metadata(relation(spark, sf, "script_source"), "meta")
    return df.withColumn("dependencies", F.array_join("dependencies", ","))


@book.query(
    "d3_parse_manifests",
    sql="""with r as (select doc_id, source, lang, unnest([
      {'m': 'perl', 'v': '5.10', 'r': 'requires', 'p': 'runtime', 'f': null, 'o': null},
      {'m': concat(source, '::Core'), 'v': concat(doc_id % 9, '.1'), 'r': 'requires', 'p': 'runtime', 'f': null, 'o': null},
      {'m': concat('Test::', lang), 'v': null, 'r': 'requires', 'p': 'test', 'f': null, 'o': null},
      {'m': concat('Opt::', lang), 'v': '2', 'r': 'recommends', 'p': 'test', 'f': null, 'o': null},
      {'m': concat('S::', source), 'v': null, 'r': 'suggests', 'p': 'runtime', 'f': concat('f', doc_id % 4), 'o': null},
      {'m': 'Dev::X', 'v': null, 'r': 'requires', 'p': 'develop', 'f': concat('f', doc_id % 4), 'o': null},
      {'m': concat('Win::', lang), 'v': null, 'r': 'requires', 'p': 'runtime', 'f': null, 'o': 'MSWin32'},
      {'m': concat('T::', source), 'v': null, 'r': 'test_requires', 'p': 'test', 'f': null, 'o': null}]) as x from documents)
    select doc_id as file_id, x.m as module, x.v as version, x.r as relationship, x.p as phase, x.f as feature, x.o as platform from r""",
)
def d3(spark, sf):
    return corpus.parse_manifests(relation(spark, sf, "manifest_source"))


@book.query(
    "d4_parse_lockfiles",
    sql="""with r as (select *, unnest([
      {'d': concat(source, '-1.', doc_id % 9), 'p': concat('A/B/', lang, '.tar.gz'), 's': 'provides', 'm': concat(source, '::P'), 'v': concat(doc_id % 5)},
      {'d': concat(source, '-1.', doc_id % 9), 'p': concat('A/B/', lang, '.tar.gz'), 's': 'provides', 'm': concat(source, '::Q'), 'v': 'undef'},
      {'d': concat(source, '-1.', doc_id % 9), 'p': concat('A/B/', lang, '.tar.gz'), 's': 'requirements', 'm': concat(lang, '::R'), 'v': '0'},
      {'d': concat('Empty-', lang), 'p': 'none.tgz', 's': null, 'm': null, 'v': null}]) as x from documents)
    select doc_id as file_id, concat('5.', doc_id % 30) as interpreter, x.d as dist, x.p as pathname, x.s as section, x.m as module, x.v as version from r""",
)
def d4(spark, sf):
    return corpus.parse_lockfiles(relation(spark, sf, "lock_source"))


@book.query(
    "d5_extract_declarations",
    sql="""with h as (select doc_id, lang, concat('package ', upper(source), '::', upper(lang)) as pkg, concat('$x', doc_id % 9) as x from documents),
    p as (select *, strlen(pkg) + 16 as a, strlen(x) + strlen(pkg) + 16 as b from h),
    u as (select doc_id, unnest([{'k': 'package', 'n': pkg[9:], 'm': 0, 's': 0}, {'k': 'variable', 'n': x, 'm': MASK_SCALAR, 's': a}, {'k': 'variable', 'n': '@list', 'm': 8192, 's': b + 9},
      {'k': 'variable', 'n': '$a', 'm': 1, 's': b + 20}, {'k': 'variable', 'n': '%h', 'm': 16384, 's': b + 20}, {'k': 'sub', 'n': concat('run_', lang), 'm': 32768, 's': b + 33},
      {'k': 'variable', 'n': '$y', 'm': 1, 's': b + 33 + strlen(lang) + 11}]) as d from p)
    select doc_id as file_id, d.k as kind, d.n as name, d.m as type_mask, d.s as start from u""".replace("MASK_SCALAR", str(m.SCALAR)),
)
def d5(spark, sf):
    return corpus.extract_declarations(relation(spark, sf, "code_source"))


@book.query(
    "d6_resolve_cross_file",
    ("code_ref", "code_file", "code_symbol"),
    """with n as (select ref_id, ref, concat(split_part(ref,'::',1), '/', split_part(ref,'::',2), '.pm') as rel, split_part(ref,'::',3) as fn from code_ref),
    p as (select n.*, case when exists (select 1 from code_file c where c.path = concat('lib/', rel)) then concat('lib/', rel)
      when exists (select 1 from code_file c where c.path = concat('local/', rel)) then concat('local/', rel) end as path from n)
    select ref_id, ref, p.path, case when return_mask is not null then fn end as symbol, return_mask from p left join code_symbol s on s.path = p.path and s.name = fn""",
)
def d6(spark, sf):
    return checks.resolve_cross_file(
        relation(spark, sf, "code_ref"), relation(spark, sf, "code_file"), relation(spark, sf, "code_symbol"), ["lib", "local"]
    )


@book.query(
    "d7_locate_offsets",
    ("diagnostic",),
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as row, generate_subscripts(string_split(text, chr(10)), 1) as no from documents),
    s as (select doc_id, no, strlen(row) as w, sum(strlen(row) + 1) over (partition by doc_id order by no) - strlen(row) - 1 as pos0 from l)
    select diag_id, file_id, no::bigint as line, (least(start, pos0 + w) - pos0 + 1)::bigint as col,
      concat(file_id, ':', no, ':', (least(start, pos0 + w) - pos0 + 1)::bigint, ': ', severity, ': m [', code, ']') as report
    from diagnostic d asof join s on d.file_id = s.doc_id and d.start >= s.pos0""",
)
def d7(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    located = checks.locate_offsets(relation(spark, sf, "diagnostic"), docs)
    return located.select("diag_id", "file_id", "line", "col", "report")


CALLS = ("call_fact",)
SIGS = "(values " + ", ".join(f"('{n}', {least}, {args})" for n, (least, args, _) in m.BUILTINS.items()) + ") s(name, min_arity, arg_masks)"
OPEN = f"({m.ANY}, {m.SCALAR}, {m.LIST})"
NAMED = "(" + ", ".join(str(v) for v in sorted(set(m.NAMED.values()))) + ")"


def fits(a: str, r: str) -> str:
    return f"({r} = {m.ANY} or {a} = 0 or ({a} & {r}) = {a} or ({a} not in {NAMED} and ({a} & {r}) = {r}) or ({a} in {OPEN} and ({a} & {r}) = {r}))"


@book.query(
    "d8_check_signatures",
    CALLS,
    f"""with k as (select c.*, min_arity, arg_masks[least(arg_no + 1, len(arg_masks))] as want from call_fact c join {SIGS} using (name))
    select call_id, null::int as arg_no, 'arity-mismatch' as code, 'error' as severity from k where n_args < min_arity and coalesce(arg_no, 0) = 0
    union all select call_id, arg_no, 'type-mismatch', 'error' from k where n_args >= min_arity and arg_no is not null and not {fits('mask', 'want')}""",
)
def d8(spark, sf):
    calls = relation(spark, sf, "call_fact").withColumn("var", F.lit("$x"))
    return checks.check_signatures(calls, checks.builtin_signatures(spark)).select("call_id", "arg_no", "code", "severity")


OPS = "(values " + ", ".join(f"('{o}', {le}, {ri})" for o, (le, ri, _) in m.OPERATORS.items()) + ") s(name, l, r)"


@book.query(
    "d8_check_operands",
    ("operand_fact",),
    f"""with k as (select o.*, case when side = 'left' then l else r end as want from operand_fact o join {OPS} using (name))
    select op_id, side, case when name in ('==','!=','<','>','<=','>=','<=>') then 'warning' else 'error' end as severity from k
    where mask <> 0 and want <> {m.ANY} and not {fits('mask', 'want')}""",
)
def d8_operands(spark, sf):
    found = checks.check_operands(relation(spark, sf, "operand_fact"), checks.operator_signatures(spark))
    return found.select("op_id", "side", "severity")


@book.query(
    "d8_diagnostic_counts",
    CALLS,
    f"""with k as (select c.*, min_arity, arg_masks[least(arg_no + 1, len(arg_masks))] as want from call_fact c join {SIGS} using (name)),
    d as (select 'arity-mismatch' as code from k where n_args < min_arity and coalesce(arg_no, 0) = 0
      union all select 'type-mismatch' from k where n_args >= min_arity and arg_no is not null and not {fits('mask', 'want')})
    select code, 'error' as severity, count(*) as n from d group by code""",
)
def d8_counts(spark, sf):
    calls = relation(spark, sf, "call_fact").withColumn("var", F.lit("$x"))
    return checks.diagnostic_counts(checks.check_signatures(calls, checks.builtin_signatures(spark)))


@book.query(
    "d9_merge_branch_masks",
    ("branch_fact", "prior_mask"),
    """select file_id, var, bit_or(mask) as mask from (select file_id, var, mask from branch_fact union all
    select p.file_id, p.var, p.mask from prior_mask p where exists (select 1 from branch_fact b where b.file_id = p.file_id and b.var = p.var and not has_else)) group by file_id, var""",
)
def d9(spark, sf):
    return checks.merge_branch_masks(relation(spark, sf, "branch_fact"), relation(spark, sf, "prior_mask"))


@book.query(
    "d10_infer_parameter_masks",
    ("param_fact",),
    "select file_id, sub, param, case when bit_and(mask) = 524287 then 0 else bit_and(mask) end as mask from param_fact group by all",
)
def d10(spark, sf):
    return checks.infer_parameter_masks(relation(spark, sf, "param_fact"))


@book.query(
    "d11_narrow_masks",
    ("guard_fact",),
    f"""with e as (select *, case when mask = 0 then {m.ANY} else mask end as s, case ref_type when 'HASH' then 512 when 'REF' then {m.REF} else 4096 end as t from guard_fact),
    n as (select *, case when not negated then case guard when 'defined' then s & ~1 when 'ref' then case when ref_type = '' then s & {m.REF} else s & t end
      when 'isa' then s & 4096 else s & 2 end
      else case guard when 'defined' then s & 1 when 'ref' then case when ref_type = '' then s & ~{m.REF} else s end when 'isa' then s else s & ~2 end end as res from e)
    select fact_id, (case when res = 0 then 2147483648 else res end)::bigint as narrowed, res <> s as changed from n""",
)
def d11(spark, sf):
    return checks.narrow_masks(relation(spark, sf, "guard_fact")).select("fact_id", "narrowed", "changed")


def inside(child: str, parent: str) -> str:
    return f"(({child} & {parent}) = {child} and {child} <> 0)"


@book.query(
    "d11_suggest_guards",
    ("guard_fact",),
    f"""with e as (select fact_id, mask, (case fact_id % 3 when 0 then 4 when 1 then {m.REF} else {m.BOOL} end)::bigint as want, mask & ~1 as bare, mask & {m.REF} as refs, mask & 2 as flag from guard_fact)
    select fact_id, case when mask & 1 <> 0 and bare <> 0 and ({fits('bare', 'want')} or {inside('want', 'bare')}) then 'Add guard: if (defined($x)) {{ ... }}'
      when refs <> 0 and ({fits('refs', 'want')} or {inside('want', 'refs')}) then 'Add guard: if (ref($x)) {{ ... }}'
      when flag <> 0 and ({fits('flag', 'want')} or {inside('want', 'flag')}) then 'Add guard: if (builtin::is_bool($x)) {{ ... }}' else '' end as suggestion from e""",
)
def d11_guards(spark, sf):
    kind = F.col("fact_id") % 3
    expected = F.when(kind == 0, m.bits(m.INT)).when(kind == 1, m.bits(m.REF)).otherwise(m.bits(m.BOOL))
    facts = relation(spark, sf, "guard_fact").select("fact_id", "mask", F.lit("$x").alias("var"), expected.alias("expected"))
    return checks.suggest_guards(facts).select("fact_id", "suggestion")


@book.query(
    "d11_mask_in_context",
    ("call_fact",),
    f"""select call_id, arg_no, case when call_id % 3 = 0 then case when mask & {m.LIST} <> 0 then (mask & ~{m.LIST}) | 4 else mask end when call_id % 3 = 1 then mask end as seen from call_fact""",
)
def d11_context(spark, sf):
    kind = F.col("call_id") % 3
    context = F.when(kind == 0, "scalar").when(kind == 1, "list").otherwise("void")
    return relation(spark, sf, "call_fact").select("call_id", "arg_no", checks.mask_in_context(F.col("mask"), context).alias("seen"))


@book.query(
    "d12_verify_checksums",
    ("artifact",),
    """select name, case when doc_id % 5 = 0 then 'missing' when doc_id % 5 = 1 then 'malformed' when doc_id % 5 = 2 and doc_id % 7 <> 0 then 'mismatch' else 'ok' end as status,
    case when doc_id % 4 = 0 then concat('5.', doc_id) end as interpreter_version from artifact""",
)
def d12(spark, sf):
    artifacts = relation(spark, sf, "artifact")
    base = F.substring_index("name", "/", -1)
    good = F.sha2("content", 256)
    nothing = F.concat(F.lit("# "), base)
    embedded = F.when(F.col("doc_id") % 5 == 0, nothing).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("12ab  "), base))
    embedded = embedded.when(F.col("doc_id") % 5 == 2, F.concat(F.sha2("name", 256), F.lit(" *pool/"), base))
    embedded = embedded.otherwise(F.concat(good, F.lit("  "), base))
    user = F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 5 == 2), F.concat(good, F.lit(" "), base)).otherwise("")
    lists = artifacts.select(F.lit(2).alias("priority"), F.col("doc_id").alias("line_no"), embedded.alias("line")).union(
        artifacts.select(F.lit(1), "doc_id", user)
    )
    return corpus.verify_checksums(artifacts.select("name", "content"), lists)


@book.query(
    "d13_pick_archive_root",
    ("archive_entry",),
    """with r as (select archive, dir, max(case entry when concat(dir, '/Build.PL') then 300 when concat(dir, '/Makefile.PL') then 200 when concat(dir, '/Makefile') then 100 else 0 end) as k
      from archive_entry group by archive, dir)
    select archive, dir as root, case k when 300 then 'Build.PL' when 200 then 'Makefile.PL' when 100 then 'Makefile' end as build_file from r
    qualify row_number() over (partition by archive order by k desc, dir) = 1""",
)
def d13(spark, sf):
    return corpus.pick_archive_root(relation(spark, sf, "archive_entry"))


NEWEST = "(select * from manifest_change qualify row_number() over (partition by project, module, phase order by seq desc) = 1)"


@book.query(
    "d14_upsert_requirements",
    ("manifest_row", "manifest_change"),
    f"""select coalesce(c.project, r.project) as project, coalesce(c.module, r.module) as module, coalesce(c.phase, r.phase) as phase, coalesce(c.version, r.version) as version
    from manifest_row r full join {NEWEST} c on r.project = c.project and r.module = c.module and r.phase = c.phase""",
)
def d14(spark, sf):
    key = ["project", "module", "phase"]
    return corpus.upsert_requirements(relation(spark, sf, "manifest_row"), relation(spark, sf, "manifest_change"), key)


@book.query(
    "d14_remove_requirements",
    ("manifest_row", "manifest_change"),
    "select * from manifest_row where (project, module) not in (select (project, module) from manifest_change)",
)
def d14_remove(spark, sf):
    return corpus.remove_requirements(
        relation(spark, sf, "manifest_row"), relation(spark, sf, "manifest_change"), ["project", "module"]
    )


@book.query(
    "d15_build_lock_table",
    ("manifest_row", "locked_install"),
    """select project, module, version, concat(module, '-', version) as distribution from locked_install i
    where exists (select 1 from manifest_row r where r.project = i.project and r.module = i.module)""",
)
def d15(spark, sf):
    return corpus.build_lock_table(relation(spark, sf, "manifest_row"), relation(spark, sf, "locked_install"))


@book.query(
    "d15_bundle_rows",
    ("locked_install",),
    "select project, module, concat('>=', version) as constraint_text from locked_install",
)
def d15_bundle(spark, sf):
    return corpus.bundle_rows(relation(spark, sf, "locked_install")).withColumnRenamed("constraint", "constraint_text")


@book.query(
    "d15_bundle_json",
    ("locked_install",),
    """select project, concat('{"name":"', module, '","version":">=', version, '"}') as value from locked_install""",
)
def d15_json(spark, sf):
    return corpus.bundle_json(corpus.bundle_rows(relation(spark, sf, "locked_install")))


TAP = """k as (select *, case when regexp_matches(line, '^# Testing') then 'file' when line like '1..%' then 'plan' when regexp_matches(line, '^ok ') then 'ok'
      when line like 'not ok%' then 'not_ok' when line like '#%' then 'diag' when line like 'Files=%' then 'summary' when line like 'Result:%' then 'result' else 'other' end as kind from tap_log),
    w as (select *, last_value(case when kind = 'file' then regexp_extract(line, '(t/\\d+\\.t)', 1) end ignore nulls) over w as file,
      last_value(case when kind = 'not_ok' then line_no when kind in ('ok', 'file') then -1 end ignore nulls) over w as fl from k
      window w as (partition by run order by line_no rows unbounded preceding)),
    c as (select * replace (case when kind = 'diag' and coalesce(fl, -1) < 0 then case when line like '%Result: %' then 'result' else 'other' end else kind end as kind) from w),
    d as (select run, fl, arg_min(line[3:], line_no) as first_line, bool_or(lower(line) like '%permission denied%') as perm from c where kind = 'diag' and fl >= 0 group by run, fl),
    f as (select c.run, c.line_no as failure_line, c.file, case when line like '%odd' then 'odd' else concat('Test ', regexp_extract(line, '(\\d+)', 1)) end as test_name,
        coalesce(d.first_line, 'Test failed') as error, false as missing, false as comp, coalesce(perm, false) as perm from c left join d on d.run = c.run and d.fl = c.line_no where kind = 'not_ok'
      union all select run, line_no, file, 'Build/Compilation', line, line like 'Can%', line like 'syntax%', false
        from c where kind = 'other' and file is not null and (line like 'Can%' or line like 'syntax%')
      union all select run, line_no, file, 'Build/Compilation', line, false, false, true from c where kind = 'other' and line like '%Permission denied%'
        and (run, file, line_no) in (select (run, file, min(line_no)) from c where kind in ('other', 'diag') and line like '%Permission denied%' and file is not null group by run, file))"""


@book.query("d16_tap_failures", ("tap_log",), f"with {TAP} select run, failure_line, file, test_name, error from f")
def d16_failures(spark, sf):
    failures = corpus.tap_failures(corpus.tap_lines(relation(spark, sf, "tap_log")))
    return failures.select("run", "failure_line", "file", "test_name", "error")


@book.query("d16_failure_lines", ("tap_log",), f"with {TAP} select run, fl as failure_line, line_no, line[3:] as text from c where kind = 'diag' and fl >= 0")
def d16_failure_lines(spark, sf):
    return corpus.tap_failure_lines(corpus.tap_lines(relation(spark, sf, "tap_log")))


@book.query(
    "d16_tap_results",
    ("tap_log",),
    f"""with {TAP}, n as (select run, coalesce(sum(try_cast(regexp_extract(line, '^1\\.\\.(\\d+)', 1) as bigint)) filter (where kind = 'plan'), 0) as planned,
      arg_max(try_cast(regexp_extract(line, 'Tests=(\\d+)', 1) as bigint), line_no) filter (where kind = 'summary') as stated, count(*) filter (where kind = 'ok') as passed,
      bool_or(kind = 'result') as judged from c group by run),
    g as (select run, count(*) as failed, count(*) filter (where test_name = 'Build/Compilation') as broken, bool_or(missing) as mi, bool_or(comp) as co, bool_or(perm) as pe from f group by run),
    t as (select n.run, coalesce(stated, planned) + coalesce(broken, 0) as total, passed, coalesce(failed, 0) as failed, judged, mi, co, pe from n left join g on n.run = g.run)
    select run, total::bigint as total, passed, failed, greatest(total - passed - failed, 0)::bigint as skipped,
      case when judged then concat(failed, ' tests failed') when failed = 0 then 'All tests passed' else concat(failed, ' out of ', total, ' tests failed') end as summary,
      case when failed = 0 then '' when mi then '{corpus.CAUSES["missing"]}' when co then '{corpus.CAUSES["compile"]}' when pe then '{corpus.CAUSES["permission"]}'
        when failed > total // 2 then '{corpus.CAUSE_MOST}' else '{corpus.CAUSE_SOME}' end as cause from t""",
)
def d16(spark, sf):
    lines = corpus.tap_lines(relation(spark, sf, "tap_log"))
    return corpus.tap_results(lines, corpus.tap_failures(lines))
