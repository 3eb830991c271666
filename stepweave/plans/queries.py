"""The engine's registered queries over a derived map, each with its equivalent in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import analytics as A
from ..operators import binding as B
from ..operators import classify as C
from ..operators import graph as G
from ..operators import compare, postings, reach, structural
from ..operators import search as S
from ..operators.storage import Scratch, cut, ensure_folder
from ..sources import csharp, gherkin
from .derived import PRELUDE, Facts, derived_map, whole_map

_FOUND: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None, prelude: bool = True):
    def add(f):
        _FOUND[f.__name__] = (f, (PRELUDE + sql if prelude else sql) if sql else None)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _FOUND.items() if sql}


# binding

TALLY = "count(distinct case when edge_kind = 'binds_to' then step_id end)"


@_query("select step_id, stepdef_id step_definition_id, edge_kind, confidence from m_bind")
def binding_edges(spark, sf):
    return Facts(spark, sf).bind


@_query(f"""select {TALLY} bound, count(distinct case when confidence = 'ambiguous' then step_id end) ambiguous,
  count(*) filter (edge_kind = 'unbound') unbound, count(distinct step_id) total,
  cast(round_even(100.0 * {TALLY} / count(distinct step_id), 0) as integer) coverage from m_bind""")
def binding_coverage(spark, sf):
    f = Facts(spark, sf)
    out = B.binding_tallies(f.bind).crossJoin(f.step.agg(F.count(F.lit(1)).alias("total")))
    return out.withColumn("coverage", B.coverage_percent(F.col("bound"), F.col("total")))


@_query("""select s.id step_id, case when max(b.stepdef_id) is null then 'unbound' when bool_or(confidence = 'ambiguous') then 'ambiguous' else 'bound' end status,
  coalesce(string_agg(d.pattern, ' | ' order by d.pattern), '') targets
  from m_step s join m_bind b on b.step_id = s.id left join m_stepdef d on d.id = b.stepdef_id group by s.id""")
def binding_view(spark, sf):
    f = Facts(spark, sf)
    return B.binding_view(f.step, f.bind, f.stepdef.withColumnRenamed("pattern", "expression"))


@_query("""select id, scenario_id, ordinal, keyword, coalesce(last_value(case keyword when 'Then:' then 'Then' when 'Given' then keyword when 'When' then keyword when 'Then' then keyword end ignore nulls)
  over (partition by scenario_id order by ordinal rows between unbounded preceding and current row), 'Given') effective from m_step""")
def effective_keyword(spark, sf):
    return B.effective_keyword(Facts(spark, sf).step.drop("text"))


@_query("select id, scenario_id, row_number() over (partition by scenario_id order by ordinal) - 1 ordinal from m_step")
def step_ordinal(spark, sf):
    return Facts(spark, sf).step.select("id", "scenario_id", (F.row_number().over(W.partitionBy("scenario_id").orderBy("ordinal")) - 1).cast("long").alias("ordinal"))


@_query("""select q.text, d.id step_definition_id, case when d.pattern like '%(%' then regexp_extract(q.text, d.pattern, 1) else '' end captures,
  case when count(*) over (partition by q.text) = 1 then 'exact' else 'ambiguous' end status from m_pairs q join m_stepdef d on d.pattern = q.pattern""")
def resolve_step(spark, sf):
    f = Facts(spark, sf)
    pairs = B.captures(B.matches(f.step, f.stepdef)).join(f.stepdef.select("id", F.col("pattern").alias("p")), F.col("pattern") == F.col("p"))
    n = F.count(F.lit(1)).over(W.partitionBy("text"))
    return pairs.select("text", F.col("id").alias("step_definition_id"), F.array_join("captures", ",").alias("captures"), F.when(n == 1, "exact").otherwise("ambiguous").alias("status"))


# counts

COUNTS = " union all ".join(f"select '{n}' entity, count(*) n from {t}" for n, t in [("projects", "m_project"), ("classes", "m_class"), ("methods", "m_method"), ("step_definitions", "m_stepdef"), ("features", "m_feature"), ("scenarios", "m_scenario"), ("scenario_steps", "m_step"), ("endpoints", "m_endpoint"), ("edges", "m_edge")])


@_query(COUNTS + " union all select 'meta', 0 union all select 'diagnostics', 0")
def entity_counts(spark, sf):
    return A.entity_counts(derived_map(spark, sf))


@_query("select kind, count(*) n from m_class group by kind")
def class_kind_histogram(spark, sf):
    return A.histogram(Facts(spark, sf).klass, "kind")


@_query("select edge_kind, count(*) n from m_edge group by edge_kind")
def edge_histogram(spark, sf):
    return A.histogram(Facts(spark, sf).edge, "edge_kind")


@_query("""select count(*) filter (edge_kind = 'inherits') inherits, count(*) filter (edge_kind = 'uses_type') uses_type from m_edge""")
def structural_tallies(spark, sf):
    e = Facts(spark, sf).edge
    return e.agg(F.count_if(F.col("edge_kind") == "inherits").alias("inherits"), F.count_if(F.col("edge_kind") == "uses_type").alias("uses_type"))


@_query("""select p.id, p.name, (select count(*) from m_class c where c.project_id = p.id) classes, (select count(*) from m_method m where m.project_id = p.id) methods from m_project p""")
def per_project_counts(spark, sf):
    return A.project_counts(derived_map(spark, sf))


@_query("""select p.id, p.name, (select count(*) from m_class c where c.project_id = p.id) classes, (select count(*) from m_method m where m.project_id = p.id) methods,
  (select count(*) from m_feature f where f.project_id = p.id) features, (select count(*) from m_scenario s join m_feature f on f.id = s.feature_id where f.project_id = p.id) scenarios,
  (select count(*) from m_step t join m_scenario s on s.id = t.scenario_id where s.project_id = p.id) steps from m_project p""")
def project_table(spark, sf):
    return A.project_table(derived_map(spark, sf))


@_query("""select f.id feature_id, (select count(*) from m_scenario s where s.feature_id = f.id) scenarios,
  (select count(*) from m_bind b join m_step t on t.id = b.step_id join m_scenario s on s.id = t.scenario_id where s.feature_id = f.id and edge_kind = 'unbound') unbound from m_feature f""")
def unbound_by_feature(spark, sf):
    return A.unbound_by_feature(derived_map(spark, sf))


@_query("select tag, count(*) n from (select unnest(regexp_split_to_array(trim(tags), '\\s+')) tag from m_scenario where tags is not null) q where tag <> '' group by tag")
def list_tags(spark, sf):
    return A.tag_counts(Facts(spark, sf).scenario)


# edges

@_query("select id from_id, base_id to_id from m_class where base_id is not null")
def inherits_edges(spark, sf):
    return Facts(spark, sf).klass.where("base_id is not null").select(F.col("id").alias("from_id"), F.col("base_id").alias("to_id"))


@_query("select method_id, class_id from m_uses")
def uses_edges(spark, sf):
    return Facts(spark, sf).uses


@_query("select from_id, to_id from m_holds")
def holds_edges(spark, sf):
    f = Facts(spark, sf)
    held = f.holds.groupBy(F.col("from_id").alias("id")).agg(F.collect_set(F.col("to_id").cast("string")).alias("names"))
    return structural.holds(held, f.klass.select("id", F.col("id").cast("string").alias("name"), "kind"))


@_query("select from_id, to_id from m_refs")
def references_edges(spark, sf):
    f = Facts(spark, sf)
    return structural.references(f.refs.select("from_id", F.col("to_id").cast("string").alias("name")), f.project.select("id", F.col("id").cast("string").alias("name")))


@_query("""select c.method_id, e.id endpoint_id from (select distinct * from m_call) c join m_endpoint e on c.verb = e.verb and c.route = e.route""")
def call_edges(spark, sf):
    return Facts(spark, sf).calls


# Ids modulo a number stand for names that several classes share.
@_query("""select a.id from_id, b.id to_id, case when count(*) over (partition by a.id) > 1 then 'ambiguous' else 'exact' end confidence
  from m_class a join m_class b on concat('Supplier', cast(a.id % 7 as varchar)) = concat('Supplier', cast(b.id % 60 as varchar)) and a.id <> b.id where a.base_id is not null""")
def inherits_by_name(spark, sf):
    c = Facts(spark, sf).klass
    base = c.where("base_id is not null").select("id", F.concat(F.lit("Supplier"), (F.col("id") % 7).cast("string")).alias("base_name"))
    return structural.inherits(base, c.select("id", F.concat(F.lit("Supplier"), (F.col("id") % 60).cast("string")).alias("name")))


@_query("""
  select method_id, id class_id, case when bool_or(n > 1) then 'ambiguous' else 'exact' end confidence from
  (select u.method_id, t.id, count(*) over (partition by u.method_id, u.name) n from (select distinct method_id, class_id % 60 name from m_uses) u join m_method m on m.id = u.method_id
   join m_class t on t.id % 60 = u.name and t.kind in ('page_object', 'api_client') and t.id <> m.class_id) q group by 1, 2""")
def uses_by_name(spark, sf):
    f = Facts(spark, sf)
    names = f.uses.groupBy("method_id").agg(F.collect_set((F.col("class_id") % 60).cast("string")).alias("names"))
    m = f.method.select("id", "class_id").join(names, F.col("id") == F.col("method_id")).select("id", "class_id", "names")
    return structural.uses(m, f.klass.select("id", (F.col("id") % 60).cast("string").alias("name"), "kind"))


# closure and impact

REACH = """, seed as (select distinct c.endpoint_id e, m.class_id c from m_calls c join m_method m on m.id = c.method_id),
reach as (select e, c from seed union select r.e, a.dst from reach r join m_adj a on a.src = r.c),
edefs as (select c.endpoint_id e, d.id d from m_calls c join m_stepdef d on d.method_id = c.method_id
  union select r.e, d.id from reach r join m_uses u on u.class_id = r.c join m_stepdef d on d.method_id = u.method_id),
esc as (select distinct x.e, t.scenario_id s from edefs x join m_bind b on b.stepdef_id = x.d join m_step t on t.id = b.step_id) """


@_query(REACH + "select e endpoint_id, c class_id from reach")
def endpoint_reach(spark, sf):
    return G.endpoint_reach(derived_map(spark, sf))


RANKED = REACH + """, rk as (select p.id endpoint_id, p.verb, p.route, (select count(distinct method_id) from m_calls c where c.endpoint_id = p.id) call_sites,
  (select count(*) from esc where esc.e = p.id) scenarios from m_endpoint p) """


@_query(RANKED + "select * from rk order by scenarios desc, call_sites desc, route, verb limit 50")
def list_endpoints(spark, sf):
    return G.endpoint_ranking(derived_map(spark, sf)).orderBy(F.desc("scenarios"), F.desc("call_sites"), "route", "verb").limit(50)


@_query(REACH + "select s scenario_id, count(*) endpoints, string_agg(cast(e as varchar), ',' order by e) endpoint_ids from esc group by s")
def scenario_endpoints(spark, sf):
    e = G.endpoint_scenarios(derived_map(spark, sf))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("endpoint_id")), lambda x: x.cast("string")), ",")
    return e.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("endpoints"), ids.alias("endpoint_ids"))


@_query(REACH + """select x.e endpoint_id, t.scenario_id, string_agg(distinct t.text, ' | ' order by t.text) via from edefs x join m_bind b on b.stepdef_id = x.d join m_step t on t.id = b.step_id
  group by 1, 2""")
def endpoint_details(spark, sf):
    m = derived_map(spark, sf)
    rows = G.endpoint_definitions(m, m.endpoints).join(G.bound_scenarios(m), "step_definition_id")
    return rows.groupBy("endpoint_id", "scenario_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " | ").alias("via"))


def _impact_sql(defs: str) -> str:
    return f""", {defs},
  hit as (select t.scenario_id, t.text from defs join m_bind b on b.stepdef_id = defs.id join m_step t on t.id = b.step_id)
  select h.scenario_id, s.name scenario, f.name feature, string_agg(distinct h.text, ' | ' order by h.text) via
  from hit h join m_scenario s on s.id = h.scenario_id left join m_feature f on f.id = s.feature_id group by 1, 2, 3"""


_FAMILY = """fam as (select id from m_class where lower(name) = lower('{}') union select c.id from fam join m_class c on c.base_id = fam.id),
  rch as (select id from fam union select a.dst from rch join m_adj a on a.src = rch.id),
  defs as (select d.id from m_stepdef d join fam on fam.id = d.class_id union select d.id from m_stepdef d join m_uses u on u.method_id = d.method_id join rch on rch.id = u.class_id)"""


@_query(_impact_sql(_FAMILY.format("Supplier#000000001")))
def impact_class(spark, sf):
    return G.impact(derived_map(spark, sf), "class", "supplier#000000001").scenarios


@_query(_impact_sql("defs as (select d.id from m_stepdef d join m_method m on m.id = d.method_id where lower(m.name) = (select lower(p_name) from part where p_partkey = 2))"))
def impact_method(spark, sf):
    m = derived_map(spark, sf)
    name = m.methods.where("id = 2").select("name").first()
    return G.impact(m, "method", name[0] if name else "").scenarios


@_query(_impact_sql("defs as (select id from m_stepdef where lower(pattern) like '%click by user 1%')"))
def impact_step(spark, sf):
    return G.impact(derived_map(spark, sf), "step", "Click by user 1").scenarios


@_query(_impact_sql(REACH.strip().lstrip(",").strip() + ", defs as (select distinct d id from edefs join m_endpoint p on p.id = e where lower(p.route) like '%/api/%/3%')").replace("'%/api/%/3%'", "'%/3%'"))
def impact_endpoint(spark, sf):
    return G.impact(derived_map(spark, sf), "endpoint", "/3").scenarios


@_query(f""", {_FAMILY.format("Supplier#000000001")}, hit as (select distinct t.scenario_id from defs join m_bind b on b.stepdef_id = defs.id join m_step t on t.id = b.step_id)
  select (select count(*) from defs) definitions, (select count(*) from hit) scenarios,
  (select count(distinct f.name) from hit join m_scenario s on s.id = hit.scenario_id join m_feature f on f.id = s.feature_id) features, (select count(*) from defs) > 0 found""")
def impact_summary(spark, sf):
    return G.impact(derived_map(spark, sf), "class", "Supplier#000000001").summary


# endpoints

@_query("select id, verb, route from m_endpoint")
def endpoint_dedupe(spark, sf):
    return Facts(spark, sf).endpoint


@_query("""select count(*) filter (contains(route, '/')) routes, count(*) filter (not contains(route, '/')) operations, (select count(*) from m_calls) call_sites from m_endpoint""")
def endpoint_split(spark, sf):
    f = Facts(spark, sf)
    return A.endpoint_split(f.endpoint, f.calls)


@_query("""select project_id, verb, route from (select *, row_number() over (partition by project_id order by route, verb) k from
  (select distinct m.project_id, e.verb, e.route from m_calls c join m_method m on m.id = c.method_id join m_endpoint e on e.id = c.endpoint_id)) where k <= 60""")
def project_endpoints(spark, sf):
    return A.project_endpoints(derived_map(spark, sf))


@_query("""select e.id, e.verb, e.route, d.path, d.api target_api from m_endpoint e left join
  (select concat('Get', p_type, 'Request') route, arg_max(concat('api/', lower(p_brand)), p_partkey) path, arg_max(p_brand, p_partkey) api from part group by p_type) d on d.route = e.route""")
def request_enrichment(spark, sf):
    f = Facts(spark, sf)
    d = f.read("part").select(F.concat(F.lit("Get"), "p_type", F.lit("Request")).alias("class_name"), F.concat(F.lit("api/"), F.lower("p_brand")).alias("path"), F.col("p_brand").alias("target_api"), F.col("p_partkey").alias("place"))
    return structural.enrich_endpoints(f.endpoint, d)


@_query("""select c.method_id, c.route from (select distinct method_id, route from m_call where not contains(route, '/')) c where c.method_id % 60 in (select id % 60 from m_class where kind = 'api_client')""")
def operation_gate(spark, sf):
    f = Facts(spark, sf)
    calls = f.call.where(~F.contains("route", F.lit("/"))).select("method_id", "route").distinct().withColumn("wrapper", (F.col("method_id") % 60).cast("string"))
    clients = f.klass.select((F.col("id") % 60).cast("string").alias("name"), "kind")
    return structural.gated_operations(calls, clients).select("method_id", "route")


# projects

@_query("select from_project, to_project, count(*) weight from m_cross group by 1, 2")
def project_dependencies(spark, sf):
    return A.project_dependencies(derived_map(spark, sf))


@_query("""select from_project, to_project, cast(sum(case when edge_kind <> 'references' then n else 0 end) as bigint) semantic,
  string_agg(concat(cast(n as varchar), ' ', edge_kind), ', ' order by n desc, edge_kind) detail, sum(case when edge_kind <> 'references' then n else 0 end) = 0 references_only
  from (select from_project, to_project, edge_kind, count(*) n from m_cross group by 1, 2, 3) group by 1, 2""")
def project_links(spark, sf):
    return A.project_links(derived_map(spark, sf))


@_query("""select p.id project_id, (select count(*) from (select distinct from_project, to_project from m_cross) where to_project = p.id) fan_in,
  (select count(*) from (select distinct from_project, to_project from m_cross) where from_project = p.id) fan_out from m_project p""")
def project_degree(spark, sf):
    return A.project_degree(derived_map(spark, sf))


@_query("""select * from (select *, cast(row_number() over (partition by from_project, to_project order by n desc, class_id, edge_kind) as integer) place from
  (select from_project, to_project, case edge_kind when 'binds_to' then d.class_id else to_id end class_id, edge_kind, count(*) n from m_cross x
   left join m_stepdef d on x.edge_kind = 'binds_to' and d.id = x.to_id where edge_kind in ('binds_to', 'uses_type', 'inherits') group by 1, 2, 3, 4)) where place <= 20""")
def link_class_drilldown(spark, sf):
    return A.link_classes(derived_map(spark, sf))


DEGREE = """, deg as (select p.id project_id, (select count(*) from (select distinct from_project, to_project from m_cross) where to_project = p.id) fan_in from m_project p),
  rk as (select name, fan_in, row_number() over (order by name) - 1 k, count(*) over () n, greatest(max(fan_in) over (), 1) mx from m_project p join deg on deg.project_id = p.id) """


@_query(DEGREE + """select name, round(least(400.0, 150.0 + 9.0 * n) * cos(-pi() / 2 + 2 * pi() * k / n), 6) x, round(least(400.0, 150.0 + 9.0 * n) * sin(-pi() / 2 + 2 * pi() * k / n), 6) y, round(7 + 13 * fan_in / mx, 6) r from rk""")
def layout(spark, sf):
    m = derived_map(spark, sf)
    return A.layout(m.projects.select("id", "name"), A.project_degree(m))


@_query("""select p.id, case when bool_or(c.kind = 'step_class') then 'bdd_tests' when bool_or(c.kind = 'test_class') then 'unit_tests' when count(c.id) > 0 then 'shared_library' else 'other' end kind
  from m_project p left join m_class c on c.project_id = p.id group by p.id""")
def project_kind_summary(spark, sf):
    f = Facts(spark, sf)
    return C.project_kind(f.klass, f.project)


# collaborators

COLLAB = """select c.id, c.name, c.kind, (select count(distinct method_id) from m_uses u where u.class_id = c.id) drivers,
  (select count(*) from m_class s where s.base_id = c.id) subclasses, coalesce((select b.name from m_class b where b.id = c.base_id), '') bases
  from m_class c where c.kind in ('page_object', 'api_client')"""


@_query(f"select * from ({COLLAB}) order by drivers desc, subclasses desc, name limit 60")
def collaborators(spark, sf):
    return A.collaborators(derived_map(spark, sf))


@_query("""select id, name, kind from m_class where kind in ('page_object', 'api_client') and id not in (select class_id from m_uses)
  and id not in (select base_id from m_class where base_id is not null) and id not in (select to_id from m_holds)""")
def unreferenced_collaborators(spark, sf):
    return A.unreferenced_collaborators(derived_map(spark, sf))


# catalogue and lookup

@_query("""select id, keyword, pattern expression, (select count(*) from m_stepdef where keyword = 'Given' and lower(pattern) like '%user%') total from m_stepdef
  where keyword = 'Given' and lower(pattern) like '%user%' order by id limit 100""")
def step_catalog(spark, sf):
    return A.step_catalog(derived_map(spark, sf).step_definitions, "given", "USER")


@_query("""select id, case when regexp_extract(pattern, '\\(([^()]*)\\)', 1) = '' then 0 else 1 end n,
  case when regexp_extract(pattern, '\\(([^()]*)\\)', 1) = '' then '' else concat('free (', regexp_extract(pattern, '\\(([^()]*)\\)', 1), ')') end first from m_stepdef""")
def placeholders(spark, sf):
    p = X.placeholders(F.col("pattern"), F.lit("regex"))
    out = Facts(spark, sf).stepdef.select("id", p.alias("p"))
    first = F.try_element_at("p", F.lit(1))
    return out.select("id", F.size("p").alias("n"), F.coalesce(F.concat(first["kind"], F.lit(" "), F.coalesce(first["type"], first["pattern"])), F.lit("")).alias("first"))


@_query("""select s.id scenario_id, s.name, 'scenario' kind, string_agg(concat(t.keyword, ' ', t.text), chr(10) order by t.ordinal) steps
  from (select * from m_scenario where lower(name) like '%scenario 12%' order by concat('src/', cast(feature_id as varchar)), id limit 10) s join m_step t on t.scenario_id = s.id group by 1, 2""")
def get_scenario(spark, sf):
    return A.scenario_details(derived_map(spark, sf), "scenario 12")


@_query("""select d.id, d.pattern expression, d.keyword, count(u.scenario_id) usage, coalesce(string_agg(cast(u.scenario_id as varchar), ',' order by u.scenario_id) filter (k <= 25), '') scenario_ids
  from (select * from m_stepdef where lower(pattern) like '%click%' order by id limit 20) d left join
  (select *, row_number() over (partition by stepdef_id order by scenario_id) k from (select distinct b.stepdef_id, t.scenario_id from m_bind b join m_step t on t.id = b.step_id)) u on u.stepdef_id = d.id group by 1, 2, 3""")
def get_step_definition(spark, sf):
    return A.step_definition_usage(derived_map(spark, sf), "click")


# search

FOLD = "concat(' ', trim(regexp_replace(strip_accents(lower(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+', ' ', 'g')), ' ')"


@_query(f"select id from m_step where contains({FOLD.format('text')}, ' click ') and contains({FOLD.format('text')}, ' user 12 ') order by id")
def search_steps(spark, sf):
    return S.search(Facts(spark, sf).step, ["text"], 'CLICK user-12 --- ""').select("id")


@_query(f"select doc_id from documents where contains({FOLD.format('text')}, ' licensed ') and contains({FOLD.format('text')}, ' 4 0 ')", prelude=False)
def search_documents(spark, sf):
    return S.search(Facts(spark, sf).read("documents"), ["text"], "Licensed 4.0").select("doc_id")


@_query(f"select conv_id, turn from conversations where contains({FOLD.format('text')}, ' the of ') or contains({FOLD.format('role')}, ' the of ')", prelude=False)
def search_phrase(spark, sf):
    return S.search(Facts(spark, sf).read("conversations"), ["text", "role"], '"the:of"').select("conv_id", "turn")


@_query(f"""select id, trim({FOLD.format('name')}) words, trim({FOLD.format('ptype')}) types from m_method""")
def search_index(spark, sf):
    return Facts(spark, sf).method.select("id", F.trim(X.folded(F.col("name"))).alias("words"), F.trim(X.folded(F.col("ptype"))).alias("types"))


@_query("""select s.id scenario_id, string_agg(t.text, ' ' order by t.ordinal) step_text, coalesce(s.tags, '') tags, f.name feature_name, s.name scenario_name
  from m_scenario s left join m_step t on t.scenario_id = s.id left join m_feature f on f.id = s.feature_id group by s.id, s.tags, f.name, s.name""")
def scenario_index(spark, sf):
    return S.scenario_index(derived_map(spark, sf)).withColumnRenamed("id", "scenario_id")


@_query(f"""select * from (select key, id, score, cast(row_number() over (partition by key order by score desc, first, id) as integer) place from
  (select key, id, count(*) score, min(k) first from (select key, k, token, d.id from
     (select key, generate_subscripts(tk, 1) - 1 k, unnest(tk) token from (values (1, ['click', 'user', '149', 'button']), (2, ['signup', '101', 'user'])) q(key, tk)) w
     join (select id, unnest(list_distinct(string_split(trim({FOLD.format('pattern')}), ' '))) t from m_stepdef) d on d.t = w.token) x group by 1, 2)) where place <= 10""")
def suggestions(spark, sf):
    texts = spark.createDataFrame([(1, "Click (user) 149, button!"), (2, "signup by 101 -- USER")], "key int, text string")
    return S.suggestions(texts, Facts(spark, sf).stepdef, ["pattern"])


@_query("""select id, coalesce(list_aggregate(list_distinct_ordered, 'string_agg', ' '), '') tokens from (select id,
  list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]+', '', 'g')), lambda w: length(w) > 2) list_distinct_ordered from m_step)""")
def salient_tokens(spark, sf):
    return Facts(spark, sf).step.select("id", F.array_join(X.salient_tokens(F.col("text")), " ").alias("tokens"))


# scalar functions

@_query("""select page_id, (url <> '' and not regexp_matches(url, '\\s') and contains(url, '/') and not starts_with(url, '//') and not contains(url, '()')
  and not regexp_matches(replace(url, '://', ''), '/[A-Za-z_][\\w.-]*:[A-Za-z]')) relaxed,
  (contains(url, '://') or starts_with(url, '/') or contains(url, '/{')) and contains(url, '/') and not regexp_matches(url, '\\s') and not contains(url, '()') and not starts_with(url, '//') and not regexp_matches(replace(url, '://', ''), '/[A-Za-z_][\\w.-]*:[A-Za-z]') strict from pages""", prelude=False)
def route_like(spark, sf):
    p = Facts(spark, sf).read("pages")
    return p.select("page_id", X.route_like(F.col("url")).alias("relaxed"), X.route_like(F.col("url"), strict=True).alias("strict"))


_WORDS = ["Get", "Search", "Create", "Update", "Patch", "Remove", "Getter", "Other"]
_NAME = "concat((['" + "','".join(_WORDS) + "'])[1 + id % 8], case when id % 3 = 0 then '' else ptype end)"


@_query(f"select id, name, case id % 8 when 0 then 'GET' when 1 then 'GET' when 2 then 'POST' when 3 then 'PUT' when 4 then 'PATCH' when 5 then 'DELETE' else 'ANY' end verb from (select id, {_NAME} name from (select p_partkey id, p_type ptype from part)) q", prelude=False)
def verb_inference(spark, sf):
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    name = F.concat(word, F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")))
    return Facts(spark, sf).read("part").select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("verb", X.inferred_verb(F.col("name")))


@_query("select n_nationkey id, n_name name from nation where (starts_with(lower(n_name), 'nation_1') or length(n_name) = 8) and right(n_name, 1) <> '4'", prelude=False)
def glob_filter(spark, sf):
    n = Facts(spark, sf).read("nation")
    return n.where(X.glob_filter(F.col("n_name"), F.concat(F.lit("src/"), F.col("n_name")), ["nation_1*", "*N_?"], ["**4"])).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@_query("""select event_id id, regexp_matches(concat('src/', props_dir, '/', cast(event_id as varchar), '.cs'), '(?i)(^|/)(obj|bin)/') generated
  from (select event_id, case event_id % 4 when 0 then 'Obj' when 1 then 'steps' when 2 then 'bin/x' else 'binary' end props_dir from events)""", prelude=False)
def generated_output(spark, sf):
    k = F.col("event_id") % 4
    where = F.when(k == 0, "Obj").when(k == 1, "steps").when(k == 2, "bin\\x").otherwise("binary")
    path = F.concat(F.lit("src\\"), where, F.lit("\\"), F.col("event_id").cast("string"), F.lit(".cs"))
    return Facts(spark, sf).read("events").select(F.col("event_id").alias("id"), X.is_generated(path).alias("generated"))


@_query("""select id, case when regexp_matches(e, '\\{\\w*\\}') then 'cucumber_expression' when regexp_matches(e, '[\\\\^$.|?*+()\\[\\]]') then 'regex' else d end kind
  from (select p_partkey id, case p_partkey % 4 when 0 then concat(p_type, ' {int}') when 1 then concat('^', p_type) when 2 then p_type else concat(p_type, '.') end e,
  case when p_size % 2 = 0 then 'cucumber_expression' else 'regex' end d from part)""", prelude=False)
def expression_kind(spark, sf):
    k = F.col("p_partkey") % 4
    e = F.when(k == 0, F.concat("p_type", F.lit(" {int}"))).when(k == 1, F.concat(F.lit("^"), "p_type")).when(k == 2, F.col("p_type")).otherwise(F.concat("p_type", F.lit(".")))
    usings = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("System"), F.lit("Reqnroll"))).otherwise(F.array(F.lit("TechTalk.SpecFlow"), F.lit("Reqnroll")))
    return Facts(spark, sf).read("part").select(F.col("p_partkey").alias("id"), X.expression_kind(e, X.framework_default(usings)).alias("kind"))


# diagnostics and dumps

@_query("""select case when loaded and code <> 'project_load_failed' then 'warning' else 'error' end severity, code, count(*) n from
  (select case event_id % 5 when 0 then 'nuget_missing_package' when 1 then 'nuget_vulnerability' when 2 then 'reqnroll_orphan_codebehind' when 3 then 'project_load_failed' else 'workspace_load' end code,
   user_id % 2 = 0 loaded from events where event_type = 'error') group by 1, 2""", prelude=False)
def diagnostic_summary(spark, sf):
    k = F.col("event_id") % 5
    message = F.when(k == 0, "Unable to find package X").when(k == 1, "Package X has a known high severity vulnerability").when(k == 2, "No feature file was found for it").when(k == 3, "'a.csproj' could not be loaded").otherwise("something")
    rows = Facts(spark, sf).read("events").where("event_type = 'error'").select(C.diagnostic_of(message, F.col("user_id") % 2 == 0).alias("d")).select("d.*")
    return A.diagnostic_summary(rows)


FACTS = """select id, name, base_id, id % 5 = 2 and id % 10 = 2 steps, id % 7 = 0 ui, id % 11 = 0 api, id % 3 = 0 cons, id % 13 = 0 test from m_class"""


@_query(f""", fx as ({FACTS}), k0 as (select *, case when steps then 'step_class' when ui then 'page_object' when api then 'api_client' when test then 'test_class' else 'other' end kind from fx),
  ch as (select id, id top, 0 d from k0 union all select ch.id, k.base_id, d + 1 from ch join k0 k on k.id = ch.top where k.base_id is not null and d < 10 and (select kind from k0 where k0.id = ch.top) = 'other'),
  inh as (select ch.id, arg_min(k0.kind, d) kind from ch join k0 on k0.id = ch.top where k0.kind in ('page_object', 'api_client') group by 1)
  select k0.id, case when k0.kind = 'other' then coalesce(inh.kind, 'other') else k0.kind end kind from k0 left join inh using (id)""")
def classify_fixpoint(spark, sf):
    c = Facts(spark, sf).klass
    flag = lambda n, r=0: F.col("id") % n == r
    name = lambda i: F.concat(F.lit("C"), i.cast("string"))
    no = F.lit(False)
    facts = c.select(
        "id", name(F.col("id")).alias("name"), name(F.col("base_id")).alias("base_type_name"), F.when(flag(10, 2), 1).otherwise(0).alias("step_method_count"),
        F.when(flag(13), 1).otherwise(0).alias("test_method_count"), F.lit(0).alias("hook_method_count"), F.lit(2).alias("method_count"), F.lit(4).alias("instance_member_count"),
        F.when(flag(7), 2).otherwise(1).alias("ui_referencing_members"), F.when(flag(11), 1).otherwise(0).alias("api_referencing_members"), no.alias("references_ui_type"), no.alias("references_api_type"),
        no.alias("holds_or_constructs_api_marker"), no.alias("has_test_class_attribute"), no.alias("is_static"), F.array().cast("array<string>").alias("constructed_type_names"),
    )
    return C.classify(facts).select("id", "kind")


@_query("""select sha256(string_agg(concat(n_name, chr(0), cast(n_regionkey as varchar), chr(0)), '' order by n_name)) input_hash from nation""", prelude=False)
def input_hash(spark, sf):
    return A.input_hash(Facts(spark, sf).read("nation").select(F.col("n_name").alias("path"), F.col("n_regionkey").cast("string").alias("content")))


@_query("select concat_ws('|', cast(id as varchar), cast(project_id as varchar), name, kind, coalesce(cast(base_id as varchar), '')) line from m_class")
def logical_dump(spark, sf):
    return A.logical_dump(Facts(spark, sf).klass)


@_query("""select cast(row_number() over (order by name, ptype, id desc) as bigint) id, name from m_method""")
def id_assignment(spark, sf):
    return structural.numbered(Facts(spark, sf).method, [F.col("name"), F.col("ptype"), F.col("id").desc()]).select("id", "name")


# stored search

def _stored(spark, df, key, columns):
    """An index of df in a folder of its own below the checkpoint folder."""
    return postings.write_index(df, key, columns, f"{ensure_folder(spark).rstrip('/')}/stepweave-index-{uuid.uuid4().hex}")


@_query(f"select doc_id from documents where contains({FOLD.format('text')}, ' licensed ') and contains({FOLD.format('text')}, ' 4 0 ')", prelude=False)
def stored_search_documents(spark, sf):
    return _stored(spark, Facts(spark, sf).read("documents"), "doc_id", ["text"]).ids("Licensed 4.0").withColumnRenamed("id", "doc_id")


@_query(f"""select distinct conv_id from conversations where contains({FOLD.format('text')}, ' the of ') or contains({FOLD.format('role')}, ' the of ')""", prelude=False)
def stored_search_phrase(spark, sf):
    return _stored(spark, Facts(spark, sf).read("conversations"), "conv_id", ["text", "role"]).ids('"the:of"').withColumnRenamed("id", "conv_id")


@_query(f"""select s.id from m_scenario s join (select scenario_id, string_agg(text, ' ' order by ordinal) x from m_step group by 1) t on t.scenario_id = s.id left join m_feature f on f.id = s.feature_id
  where (contains({FOLD.format('t.x')}, ' click ') or contains({FOLD.format('f.name')}, ' click ') or contains({FOLD.format('s.name')}, ' click ') or contains({FOLD.format('s.tags')}, ' click '))
  and (contains({FOLD.format('t.x')}, ' feature 12 ') or contains({FOLD.format('f.name')}, ' feature 12 ') or contains({FOLD.format('s.name')}, ' feature 12 ') or contains({FOLD.format('s.tags')}, ' feature 12 '))""")
def stored_search_scenarios(spark, sf):
    m = derived_map(spark, sf)
    return _stored(spark, S.scenario_index(m), "id", S.SCENARIO_COLUMNS).ids("click feature-12")


@_query(f"""select term, id, 0 as column, string_agg(cast(k as varchar), ',' order by k) positions from
  (select id, unnest(t) term, generate_subscripts(t, 1) - 1 k from (select id, list_filter(string_split(trim({FOLD.format('text')}), ' '), lambda x: x <> '') t from m_step)) group by 1, 2""")
def search_postings(spark, sf):
    return postings.postings(Facts(spark, sf).step, "id", ["text"]).select("term", "id", "column", F.array_join("positions", ",").alias("positions"))


# cycles, and reach by components

@_query(""", m_way(src, dst) as (select src, dst from m_adj union select w.src, a.dst from m_way w join m_adj a on a.src = w.dst)
select a.src class_id, least(a.src, min(a.dst)) cycle, cast(count(distinct a.dst) + 1 as bigint) classes from m_way a join m_way b on b.src = a.dst and b.dst = a.src where a.src <> a.dst group by 1""")
def class_cycles(spark, sf):
    """Classes that need each other in a circle, by the least of them."""
    with Scratch(spark) as scratch:
        return cut(reach.cycles(scratch.cut, G.class_adjacency(derived_map(spark, sf))).toDF("class_id", "cycle", "classes"))


@_query("""select r.e endpoint_id, r.c class_id from (with recursive w(e, c) as (select distinct k.endpoint_id, m.class_id from m_calls k join m_method m on m.id = k.method_id
  union select w.e, a.dst from w join m_adj a on a.src = w.c) select e, c from w) r""")
def condensed_reach(spark, sf):
    """What endpoint_reach() finds, by the way of graphs that are too large to broadcast."""
    m = derived_map(spark, sf)
    return reach.closure(G.endpoint_seeds(m), G.class_adjacency(m)).select(F.col("seed").alias("endpoint_id"), F.col("node").alias("class_id"))


# dumps and comparisons

DUMP = """, m_lines as (
  select 'version' tab, 'user_version=5' line
  union all select 'projects', concat_ws('|', 'project', id, name, concat('src/', name), '', '') from m_project
  union all select 'classes', concat_ws('|', 'class', id, project_id, name, '', '', kind, '', 0, 0) from m_class
  union all select 'methods', concat_ws('|', 'method', id, class_id, project_id, name, '', '', '', '', 0, 0) from m_method
  union all select 'step_definitions', concat_ws('|', 'stepdef', id, method_id, class_id, project_id, keyword, pattern, 'regex', '', '', 0) from m_stepdef
  union all select 'features', concat_ws('|', 'feature', id, project_id, name, '', '') from m_feature
  union all select 'scenarios', concat_ws('|', 'scenario', id, feature_id, name, 'scenario', coalesce(tags, ''), 0, 1) from m_scenario
  union all select 'scenario_steps', concat_ws('|', 'step', id, scenario_id, keyword, text, ordinal, 0) from m_step
  union all select 'endpoints', concat_ws('|', 'endpoint', id, verb, route) from m_endpoint
  union all select 'edges', concat_ws('|', 'edge', from_kind, from_id, to_kind, coalesce(cast(to_id as varchar), ''), edge_kind, coalesce(confidence, '')) from m_edge)
"""


@_query(DUMP + "select line from m_lines")
def map_dump(spark, sf):
    return A.map_dump(whole_map(spark, sf)).select("line")


@_query(DUMP + """select tab "table", count(*) n, concat_ws('-', sum(a), sum(b), sum(c), sum(d)) digest from (select tab, cast(concat('0x', substr(h, 1, 15)) as bigint) a, cast(concat('0x', substr(h, 16, 15)) as bigint) b,
  cast(concat('0x', substr(h, 31, 15)) as bigint) c, cast(concat('0x', substr(h, 46, 15)) as bigint) d from (select tab, sha256(line) h from m_lines)) group by 1""")
def map_digests(spark, sf):
    return compare.digests(whole_map(spark, sf))


@_query("""select 'classes' "table", s.side, id "at", concat_ws('|', 'class', id, project_id, concat(name, case when s.side = '+' then 'X' else '' end), '', '', kind, '', 0, 0) line
  from m_class, (values ('-'), ('+')) s(side) where id % 23 = 5
  union all select 'scenario_steps', '-', id, concat_ws('|', 'step', id, scenario_id, keyword, text, ordinal, 0) from m_step where id % 211 = 7
  union all select 'features', '+', 100000 + id, concat_ws('|', 'feature', 100000 + id, project_id, name, '', '') from m_feature where id % 7 = 3""")
def map_differences(spark, sf):
    """A map against itself with classes renamed, steps left out and features added."""
    with Scratch(spark) as scratch:
        left = whole_map(spark, sf)
        left.edges = scratch.cut(left.edges)  # both maps have them, and binding is most of the work
        return compare.differences(left, _changed(left))


def _changed(left):
    right = replace(left)
    right.classes = right.classes.withColumn("name", F.when(F.col("id") % 23 == 5, F.concat("name", F.lit("X"))).otherwise(F.col("name")))
    right.scenario_steps = right.scenario_steps.where("id % 211 <> 7")
    right.features = right.features.unionByName(right.features.where("id % 7 = 3").withColumn("id", F.col("id") + 100_000))
    return right


# files: features and classes written out as their authors would, and read back

@_query("""select id scenario_id, name, feature_name, tags, n steps, texts from (select s.id, s.name, f.name feature_name, coalesce(replace(s.tags, ' ', ','), '') tags,
  (select count(*) from m_step t where t.scenario_id = s.id) n, (select string_agg(concat(case when keyword = 'Then:' then 'Then' else keyword end, ' ', text), '; ' order by ordinal) from m_step t where t.scenario_id = s.id) texts
  from m_scenario s join m_feature f on f.id = s.feature_id)""")
def gherkin_files(spark, sf):
    """Feature files of the map, parsed in the tasks: the scenarios with tags and steps. A feature has a file for each FILE_IDS ids of its scenarios,
    so that a file doesn't grow with the map, and a task holds what it read from one file at a time."""
    f = Facts(spark, sf)
    keyword = F.when(F.col("keyword") == "Then:", "Then").otherwise(F.col("keyword"))
    step = F.struct("ordinal", F.concat(F.lit("    "), keyword, F.lit(" "), "text").alias("line"))
    steps = f.step.groupBy(F.col("scenario_id").alias("c_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["line"]), "\n").alias("body"))
    written = f.scenario.join(steps, F.col("id") == F.col("c_id")).select("feature_id", F.floor(F.col("id") / FILE_IDS).alias("file"), "id", F.concat(F.coalesce(F.concat(F.lit("  "), "tags", F.lit("\n")), F.lit("")), F.lit("  Scenario: "), "name", F.lit("\n"), "body").alias("block"))
    whole = written.groupBy("feature_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    texts = whole.join(f.feature, F.col("feature_id") == F.col("id")).select(F.concat(F.lit("Feature: "), "name", F.lit("\n\n"), "body", F.lit("\n")).alias("content"))
    read = texts.mapInArrow(_scenarios, "feature_name string, name string, tags array<string>, steps array<struct<keyword:string,text:string>>")
    own = F.array_join(F.transform("steps", lambda x: F.concat(x["keyword"], F.lit(" "), x["text"])), "; ")
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    return read.select(number.alias("scenario_id"), "name", "feature_name", F.array_join("tags", ",").alias("tags"), F.size("steps").cast("long").alias("steps"), own.alias("texts"))


#: Ids of scenarios that one feature file spans.
FILE_IDS = 8192


def _scenarios(batches):
    """A batch of scenarios for each file."""
    names = pa.schema([("feature_name", pa.string()), ("name", pa.string()), ("tags", pa.list_(pa.string())), ("steps", pa.list_(pa.struct([("keyword", pa.string()), ("text", pa.string())])))])
    for batch in batches:
        for content in batch.column(0):
            f = gherkin.parse_feature(content.as_py())
            if f:
                rows = [{"feature_name": f["name"], "name": s["name"], "tags": s["tags"], "steps": [{"keyword": x["keyword"], "text": x["text"]} for x in s["steps"]]} for s in f["scenarios"]]
                yield pa.RecordBatch.from_pylist(rows, names)


@_query("""select c.id class_id, c.name, coalesce(b.name, '') base, cast((select count(*) from m_method m where m.class_id = c.id) as bigint) methods,
  coalesce((select string_agg(concat(d.keyword, ' ', d.pattern), '; ' order by d.id) from m_stepdef d where d.class_id = c.id), '') definitions
  from (select id, replace(name, '#', '_') as name, base_id from m_class) c left join (select id, replace(name, '#', '_') as name from m_class) b on b.id = c.base_id""")
def csharp_files(spark, sf):
    """A source file for each class of the map, scanned in the tasks: its base, methods and step definitions."""
    f = Facts(spark, sf)
    named = F.replace("name", F.lit("#"), F.lit("_"))
    classes = f.klass.select("id", named.alias("name"), "base_id")
    bases = classes.select(F.col("id").alias("b_id"), F.col("name").alias("base"))
    defs = f.stepdef.select(F.col("id").alias("d_id"), "keyword", "pattern")
    attribute = F.when(F.col("pattern").isNotNull(), F.concat(F.lit("  ["), "keyword", F.lit('(@"'), "pattern", F.lit('")]\n'))).otherwise(F.lit(""))
    methods = f.method.join(defs, F.col("id") == F.col("d_id"), "left").select("class_id", "id", F.concat(attribute, F.lit("  public void M"), F.col("id").cast("string"), F.lit("() { }\n")).alias("code"))
    body = methods.groupBy("class_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda x: x["code"]), "").alias("body"))
    files = classes.join(bases, F.col("base_id") == F.col("b_id"), "left").join(body, F.col("id") == F.col("class_id"), "left")
    head = F.concat(F.lit("using Reqnroll;\n\npublic class "), "name", F.coalesce(F.concat(F.lit(" : "), "base"), F.lit("")), F.lit("\n{\n"))
    content = files.select("id", F.concat(head, F.coalesce("body", F.lit("")), F.lit("}\n")).alias("content"))
    return content.select(F.col("id").alias("class_id"), F.udf(_class_facts, "name string, base string, methods long, definitions string", useArrow=True)("content").alias("c")).select("class_id", "c.*")


def _class_facts(content):
    (t,), _ = csharp.scan(content)
    found = [f"{keyword} {text}" for m in t.methods for keyword, text in m.steps]
    return t.name, t.base_name or "", len(t.methods), "; ".join(found)
