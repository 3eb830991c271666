"""A test map derived from star-schema tables, so that the operators can run on generated data of any size.

PRELUDE says the same in SQL, as common table expressions over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import call_edges, deduplicated_endpoints
from ..operators.binding import binding_edges
from ..schema import TABLES, aligned, empty
from ..testmap import TestMap

PRELUDE = """
with recursive m_project as (select cast(n_nationkey as bigint) id, n_name name, n_regionkey region from nation),
m_class as (select s_suppkey id, cast(s_nationkey as bigint) project_id, s_name name,
  case s_suppkey % 5 when 0 then 'page_object' when 1 then 'api_client' when 2 then 'step_class' when 3 then 'test_class' else 'other' end kind,
  case when s_suppkey % 5 in (0, 1) and s_suppkey % 3 = 0 and s_suppkey >= 5 then s_suppkey - 5 end base_id from supplier),
m_method as (select p.p_partkey id, c.id class_id, c.project_id, p.p_name name, p.p_size size, p.p_type ptype
  from part p join m_class c on c.id = p.p_partkey % (select count(*) from supplier)),
m_stepdef as (select m.id id, m.id method_id, m.class_id, m.project_id,
  case m.size % 3 when 0 then 'Given' when 1 then 'When' else 'Then' end keyword,
  concat('^', case m.size % 5 when 0 then 'click' when 1 then 'error' when 2 then 'purchase' when 3 then 'signup' else 'view' end,
    ' by user ', case when m.id % 500 = 2 then '(1[0-4].)' else cast(m.id % 150 as varchar) end, '$') pattern
  from m_method m join m_class c on c.id = m.class_id where c.kind = 'step_class'),
m_step as (select event_id id, cast((event_id - event_id % 5) / 5 as bigint) scenario_id, cast(event_id % 5 as integer) ordinal,
  case event_id % 7 when 0 then 'Given' when 1 then 'When' when 2 then 'Then' when 3 then 'And' when 4 then 'But' when 5 then '*' else 'Then:' end keyword,
  concat(event_type, ' by user ', cast(user_id as varchar)) text from events),
m_scenario as (select distinct scenario_id id, scenario_id % 40 feature_id, scenario_id % 25 project_id,
  concat('Scenario ', cast(scenario_id as varchar)) name,
  case when scenario_id % 3 = 0 then concat('@smoke @area', cast(scenario_id % 7 as varchar)) when scenario_id % 3 = 1 then concat('@area', cast(scenario_id % 7 as varchar), ' @area', cast(scenario_id % 40 % 7 as varchar)) end tags
  from m_step),
m_feature as (select distinct feature_id id, feature_id % 25 project_id, concat('Feature ', cast(feature_id % 38 as varchar)) name from m_scenario),
m_uses as (select distinct l.l_partkey method_id, l.l_suppkey class_id from lineitem l join m_method m on m.id = l.l_partkey
  where l.l_suppkey % 5 in (0, 1) and l.l_linenumber = 1 and l.l_quantity >= 49 and m.class_id <> l.l_suppkey),
m_holds as (select distinct m.class_id from_id, l.l_suppkey to_id from lineitem l join m_method m on m.id = l.l_partkey
  where l.l_suppkey % 5 in (0, 1) and l.l_linenumber = 2 and l.l_quantity >= 49 and m.class_id <> l.l_suppkey),
m_refs as (select distinct cast(c.c_nationkey as bigint) from_id, cast((c.c_nationkey + c.c_custkey % 4) % 25 as bigint) to_id from customer c where c.c_custkey % 4 > 0),
m_call as (select m.id method_id, case m.size % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' else 'DELETE' end verb,
  case when m.size % 10 = 9 then concat('Get', m.ptype, 'Request') else concat('/api/', lower(m.ptype), '/', cast(m.size % 10 as varchar)) end route
  from m_method m where m.id % 5 = 1 or m.id % 40 = 2),
m_endpoint as (select row_number() over (order by route, verb) id, verb, route from (select distinct verb, route from m_call) q),
m_calls as (select distinct c.method_id, e.id endpoint_id from m_call c join m_endpoint e on e.verb = c.verb and e.route = c.route),
m_pairs as (select t.text, p.pattern from (select distinct text from m_step) t join (select distinct pattern from m_stepdef) p
  on case when p.pattern like '%(%' then regexp_matches(t.text, p.pattern) else t.text = substr(p.pattern, 2, length(p.pattern) - 2) end),
m_bound as (select s.id step_id, d.id stepdef_id, count(d.id) over (partition by s.id) n
  from m_step s left join m_pairs q on q.text = s.text left join m_stepdef d on d.pattern = q.pattern),
m_bind as (select step_id, stepdef_id, case when stepdef_id is null then 'unbound' else 'binds_to' end edge_kind,
  case when n = 0 then '' when n = 1 then 'exact' else 'ambiguous' end confidence from m_bound),
m_adj as (select u.class_id src, m.class_id dst from m_uses u join m_method m on m.id = u.method_id
  union select base_id, id from m_class where base_id is not null),
m_edge as (
  select 'scenario_step' from_kind, step_id from_id, 'step_definition' to_kind, stepdef_id to_id, edge_kind, confidence from m_bind
  union all select 'class', id, 'class', base_id, 'inherits', 'exact' from m_class where base_id is not null
  union all select 'method', method_id, 'class', class_id, 'uses_type', 'exact' from m_uses
  union all select 'class', from_id, 'class', to_id, 'holds', 'exact' from m_holds
  union all select 'project', from_id, 'project', to_id, 'references', '' from m_refs
  union all select 'method', method_id, 'endpoint', endpoint_id, 'calls_endpoint', '' from m_calls),
m_node as (select 'project' kind, id, id project_id from m_project union all select 'class', id, project_id from m_class
  union all select 'method', id, project_id from m_method union all select 'step_definition', id, project_id from m_stepdef
  union all select 'scenario_step', s.id, c.project_id from m_step s join m_scenario c on c.id = s.scenario_id),
m_cross as (select a.project_id from_project, b.project_id to_project, e.edge_kind, e.to_kind, e.to_id from m_edge e
  join m_node a on a.kind = e.from_kind and a.id = e.from_id join m_node b on b.kind = e.to_kind and b.id = e.to_id
  where e.edge_kind <> 'unbound' and a.project_id <> b.project_id)
"""


class Facts:
    """The tables of PRELUDE, each planned when it is asked for and kept."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = getattr(type(self), f"_{name}")(self)
        return self._made[name]

    def _project(self):
        return self.read("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))

    def _klass(self):
        k = F.col("s_suppkey") % 5
        kind = F.when(k == 0, "page_object").when(k == 1, "api_client").when(k == 2, "step_class").when(k == 3, "test_class").otherwise("other")
        base = F.when(k.isin(0, 1) & (F.col("s_suppkey") % 3 == 0) & (F.col("s_suppkey") >= 5), F.col("s_suppkey") - 5)
        return self.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("project_id"), F.col("s_name").alias("name"), kind.alias("kind"), base.alias("base_id"))

    def _method(self):
        n = self.read("supplier").count()
        owner = self.klass.select(F.col("id").alias("class_id"), "project_id")
        parts = self.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("ptype"))
        return parts.join(owner, F.col("id") % F.lit(n) == F.col("class_id")).select("id", "class_id", "project_id", "name", "size", "ptype")

    def _stepdef(self):
        steps = self.klass.where("kind = 'step_class'").select(F.col("id").alias("c_id"))
        k, w = F.col("size") % 5, F.col("size") % 3
        word = F.when(k == 0, "click").when(k == 1, "error").when(k == 2, "purchase").when(k == 3, "signup").otherwise("view")
        who = F.when(F.col("id") % 500 == 2, "(1[0-4].)").otherwise((F.col("id") % 150).cast("string"))
        pattern = F.concat(F.lit("^"), word, F.lit(" by user "), who, F.lit("$"))
        keyword = F.when(w == 0, "Given").when(w == 1, "When").otherwise("Then")
        return self.method.join(steps, F.col("class_id") == F.col("c_id")).select("id", F.col("id").alias("method_id"), "class_id", "project_id", keyword.alias("keyword"), pattern.alias("pattern"))

    def _step(self):
        k = F.col("event_id") % 7
        keyword = F.when(k == 0, "Given").when(k == 1, "When").when(k == 2, "Then").when(k == 3, "And").when(k == 4, "But").when(k == 5, "*").otherwise("Then:")
        return self.read("events").select(
            F.col("event_id").alias("id"), F.expr("cast((event_id - event_id % 5) / 5 as bigint)").alias("scenario_id"), (F.col("event_id") % 5).cast("int").alias("ordinal"),
            keyword.alias("keyword"), F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("text"),
        )

    def _scenario(self):
        s = self.step.select(F.col("scenario_id").alias("id")).distinct()
        area = lambda c: F.concat(F.lit("@area"), (c % 7).cast("string"))
        tags = F.when(F.col("id") % 3 == 0, F.concat(F.lit("@smoke "), area(F.col("id")))).when(F.col("id") % 3 == 1, F.concat(area(F.col("id")), F.lit(" "), area(F.col("id") % 40)))
        return s.select("id", (F.col("id") % 40).alias("feature_id"), (F.col("id") % 25).alias("project_id"), F.concat(F.lit("Scenario "), F.col("id").cast("string")).alias("name"), tags.alias("tags"))

    def _feature(self):
        f = self.scenario.select(F.col("feature_id").alias("id")).distinct()
        return f.select("id", (F.col("id") % 25).alias("project_id"), F.concat(F.lit("Feature "), (F.col("id") % 38).cast("string")).alias("name"))

    def _mentions(self, line: int):
        items = self.read("lineitem").where(F.expr(f"l_suppkey % 5 in (0, 1) and l_linenumber = {line} and l_quantity >= 49")).select("l_partkey", "l_suppkey")
        return items.join(self.method.select("id", "class_id"), F.col("l_partkey") == F.col("id")).where("class_id <> l_suppkey")

    def _uses(self):
        return self._mentions(1).select(F.col("id").alias("method_id"), F.col("l_suppkey").alias("class_id")).distinct()

    def _holds(self):
        return self._mentions(2).select(F.col("class_id").alias("from_id"), F.col("l_suppkey").alias("to_id")).distinct()

    def _refs(self):
        c = self.read("customer").where("c_custkey % 4 > 0")
        return c.select(F.col("c_nationkey").cast("long").alias("from_id"), F.expr("cast((c_nationkey + c_custkey % 4) % 25 as bigint)").alias("to_id")).distinct()

    def _call(self):
        k = F.col("size") % 4
        verb = F.when(k == 0, "GET").when(k == 1, "POST").when(k == 2, "PUT").otherwise("DELETE")
        route = F.when(F.col("size") % 10 == 9, F.concat(F.lit("Get"), "ptype", F.lit("Request"))).otherwise(F.concat(F.lit("/api/"), F.lower("ptype"), F.lit("/"), (F.col("size") % 10).cast("string")))
        return self.method.where("id % 5 = 1 or id % 40 = 2").select(F.col("id").alias("method_id"), verb.alias("verb"), route.alias("route"))

    def _endpoint(self):
        return deduplicated_endpoints(self.call)

    def _calls(self):
        return call_edges(self.call, self.endpoint)

    def _bind(self):
        return binding_edges(self.step, self.stepdef)

    def _edge(self):
        def part(df, from_kind, from_id, to_kind, to_id, kind, confidence):
            return df.select(F.lit(from_kind).alias("from_kind"), F.col(from_id).alias("from_id"), F.lit(to_kind).alias("to_kind"), F.col(to_id).alias("to_id"), kind.alias("edge_kind"), confidence.alias("confidence"))

        return (
            part(self.bind, "scenario_step", "step_id", "step_definition", "step_definition_id", F.col("edge_kind"), F.col("confidence"))
            .unionByName(part(self.klass.where("base_id is not null"), "class", "id", "class", "base_id", F.lit("inherits"), F.lit("exact")))
            .unionByName(part(self.uses, "method", "method_id", "class", "class_id", F.lit("uses_type"), F.lit("exact")))
            .unionByName(part(self.holds, "class", "from_id", "class", "to_id", F.lit("holds"), F.lit("exact")))
            .unionByName(part(self.refs, "project", "from_id", "project", "to_id", F.lit("references"), F.lit("")))
            .unionByName(part(self.calls, "method", "method_id", "endpoint", "endpoint_id", F.lit("calls_endpoint"), F.lit("")))
        )


def derived_map(spark: SparkSession, sf_dir: str) -> TestMap:
    """The tables of a map with the columns that the queries read; Facts plans each once."""
    f = Facts(spark, sf_dir)
    line = F.lit(1).alias("line_start")
    file = lambda c: F.concat(F.lit("src/"), F.col(c).cast("string")).alias("file_path")
    owner = f.scenario.select(F.col("id").alias("o_id"), "project_id")
    return TestMap(
        meta=empty(spark, "meta"),
        projects=f.project.select("id", "name", F.concat(F.lit("src/"), "name").alias("path")),
        classes=f.klass.select("id", "project_id", "name", "kind", "base_id"),
        methods=f.method.select("id", "class_id", "project_id", "name", "size", "ptype"),
        step_definitions=f.stepdef.select("id", "method_id", "class_id", "project_id", "keyword", F.col("pattern").alias("expression"), F.lit("regex").alias("expression_kind"), "pattern"),
        features=f.feature,
        scenarios=f.scenario.select("*", F.lit("scenario").alias("kind"), file("feature_id"), line),
        scenario_steps=f.step.join(owner, F.col("scenario_id") == F.col("o_id")).drop("o_id"),
        endpoints=f.endpoint,
        edges=f.edge,
        diagnostics=empty(spark, "diagnostics"),
    )


def whole_map(spark: SparkSession, sf_dir: str) -> TestMap:
    """The derived map with all columns of the schema; those that it has no facts for are empty texts, zeros, false or null."""
    m = derived_map(spark, sf_dir)
    blank = {"string": "", "long": 0, "integer": 0, "boolean": False}
    tables = {}
    for name, df in m.tables().items():
        new = {f.name: F.lit(None if f.nullable else blank[f.dataType.typeName()]) for f in TABLES[name] if f.name not in df.columns}
        tables[name] = aligned(df.withColumns(new), name)
    return TestMap(**tables)
