"""Counts, histograms, rankings and joins over a test map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import COLLABORATORS, SCHEMA_VERSION
from ..testmap import TestMap
from . import structural


def entity_counts(m: TestMap) -> DataFrame:
    """(entity, n) for each table of the map."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in m.tables().items()]
    return reduce(DataFrame.unionByName, parts)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def _counted(base: DataFrame, *parts: tuple[str, DataFrame]) -> DataFrame:
    """base (id, name) with the number of rows of each part (project_id), zero kept."""
    out = base
    for name, df in parts:
        n = df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name)).withColumnRenamed("project_id", f"{name}_of")
        out = out.join(n, F.col("id") == F.col(f"{name}_of"), "left").drop(f"{name}_of").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def project_counts(m: TestMap) -> DataFrame:
    return _counted(m.projects.select("id", "name"), ("classes", m.classes), ("methods", m.methods))


def project_table(m: TestMap) -> DataFrame:
    """Classes, methods, features, scenarios and steps of each project; scenarios count for their feature's project."""
    owned = m.scenarios.drop("project_id").join(m.features.select(F.col("id").alias("f_id"), "project_id"), F.col("feature_id") == F.col("f_id"))
    return _counted(m.projects.select("id", "name"), ("classes", m.classes), ("methods", m.methods), ("features", m.features), ("scenarios", owned), ("steps", m.scenario_steps))


def endpoint_split(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """(routes, operations, call_sites): a route has a slash."""
    slash = F.contains(F.col("route"), F.lit("/"))
    kinds = endpoints.agg(F.count_if(slash).alias("routes"), F.count_if(~slash).alias("operations"))
    return kinds.crossJoin(calls.agg(F.count(F.lit(1)).alias("call_sites")))


def deduplicated_endpoints(calls: DataFrame) -> DataFrame:
    """(id, verb, route) of the distinct (verb, route) of calls, numbered by route and verb."""
    return structural.numbered(calls.select("verb", "route").distinct(), ["route", "verb"]).select("id", "verb", "route")


def call_edges(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(method_id, endpoint_id), distinct, of call sites (method_id, verb, route)."""
    e = endpoints.select(F.col("id").alias("endpoint_id"), "verb", "route")
    return calls.join(e, ["verb", "route"]).select("method_id", "endpoint_id").distinct()


def diagnostic_summary(diagnostics: DataFrame) -> DataFrame:
    """(severity, code, n), errors first, then by number."""
    rows = diagnostics.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), F.desc("n"), "code")


def tag_counts(scenarios: DataFrame, limit: int = 200) -> DataFrame:
    """(tag, n): tags are counted as often as they stand at scenarios, feature tags repeated there included."""
    words = scenarios.select(F.explode(F.split(F.trim(F.coalesce("tags", F.lit(""))), r"\s+")).alias("tag")).where("tag <> ''")
    return histogram(words, "tag").limit(limit)


def cross_project_edges(m: TestMap) -> DataFrame:
    """(from_project, to_project, edge_kind, to_kind, to_id) of edges whose ends lie in two projects."""
    nodes = m.node_projects()
    a = nodes.select(F.col("kind").alias("a_kind"), F.col("id").alias("a_id"), F.col("project_id").alias("from_project"))
    b = nodes.select(F.col("kind").alias("b_kind"), F.col("id").alias("b_id"), F.col("project_id").alias("to_project"))
    e = m.edges.where("edge_kind <> 'unbound' and to_id is not null")
    out = e.join(a, (F.col("from_kind") == F.col("a_kind")) & (F.col("from_id") == F.col("a_id")))
    out = out.join(b, (F.col("to_kind") == F.col("b_kind")) & (F.col("to_id") == F.col("b_id")))
    return out.where("from_project <> to_project").select("from_project", "to_project", "edge_kind", "to_kind", "to_id")


def project_dependencies(m: TestMap) -> DataFrame:
    """(from_project, to_project, weight): all edges between two projects."""
    return cross_project_edges(m).groupBy("from_project", "to_project").agg(F.count(F.lit(1)).alias("weight"))


def project_links(m: TestMap) -> DataFrame:
    """Links with the number of edges other than references, whether references are all, and the kinds in words."""
    kinds = cross_project_edges(m).groupBy("from_project", "to_project", "edge_kind").agg(F.count(F.lit(1)).alias("n"))
    words = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "edge_kind"))), lambda x: F.concat((-x["o"]).cast("string"), F.lit(" "), x["edge_kind"]))
    out = kinds.groupBy("from_project", "to_project").agg(
        F.sum(F.when(F.col("edge_kind") != "references", F.col("n")).otherwise(0)).alias("semantic"), F.array_join(words, ", ").alias("detail")
    )
    return out.withColumn("references_only", F.col("semantic") == 0)


def project_degree(m: TestMap) -> DataFrame:
    """(project_id, fan_in, fan_out) over distinct pairs of projects, zero kept."""
    links = cross_project_edges(m).select("from_project", "to_project").distinct()
    one = lambda c, name: links.groupBy(c).agg(F.count(F.lit(1)).alias(name)).withColumnRenamed(c, f"{name}_of")
    out = m.projects.select(F.col("id").alias("project_id")).join(one("to_project", "fan_in"), F.col("project_id") == F.col("fan_in_of"), "left")
    out = out.join(one("from_project", "fan_out"), F.col("project_id") == F.col("fan_out_of"), "left")
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out")])


def link_classes(m: TestMap, top: int = 20) -> DataFrame:
    """The `top` target classes of each link: bindings count for the definition's class; holds and others for none."""
    crossing = cross_project_edges(m)
    owner = m.step_definitions.select(F.col("id").alias("d_id"), F.col("class_id").alias("d_class"))
    out = crossing.join(owner, (F.col("edge_kind") == "binds_to") & (F.col("to_id") == F.col("d_id")), "left")
    target = F.when(F.col("edge_kind") == "binds_to", F.col("d_class")).when(F.col("edge_kind").isin("uses_type", "inherits"), F.col("to_id"))
    counted = out.withColumn("class_id", target).where("class_id is not null").groupBy("from_project", "to_project", "class_id", "edge_kind").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("from_project", "to_project").orderBy(F.desc("n"), "class_id", "edge_kind"))
    return counted.withColumn("place", rank).where(F.col("place") <= top)


def _top(df: DataFrame, by: str, order: list[Column | str], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= n).drop("place")


def project_endpoints(m: TestMap, top: int = 60) -> DataFrame:
    """The first `top` distinct (route, verb) that each project's methods call."""
    calls = m.edge("calls_endpoint").join(m.methods.select(F.col("id").alias("m_id"), "project_id"), F.col("from_id") == F.col("m_id"))
    hit = calls.join(m.endpoints.select("id", "verb", "route"), F.col("to_id") == F.col("id")).select("project_id", "verb", "route").distinct()
    return _top(hit, "project_id", ["route", "verb"], top)


def collaborators(m: TestMap, top: int | None = 60) -> DataFrame:
    """Page objects and API clients with the methods that use them, their subclasses and bases."""
    c = m.classes.where(F.col("kind").isin(*COLLABORATORS)).select("id", "name", "kind")
    users = m.edge("uses_type").groupBy(F.col("to_id").alias("u_id")).agg(F.count_distinct("from_id").alias("drivers"))
    subs = m.edge("inherits").groupBy(F.col("to_id").alias("s_id")).agg(F.count_distinct("from_id").alias("subclasses"))
    names = m.classes.select(F.col("id").alias("n_id"), F.col("name").alias("base"))
    bases = m.edge("inherits").join(names, F.col("to_id") == F.col("n_id")).groupBy(F.col("from_id").alias("b_id")).agg(F.array_join(F.array_sort(F.collect_set("base")), ", ").alias("bases"))
    out = c.join(users, F.col("id") == F.col("u_id"), "left").join(subs, F.col("id") == F.col("s_id"), "left").join(bases, F.col("id") == F.col("b_id"), "left")
    out = out.select("id", "name", "kind", F.coalesce("drivers", F.lit(0)).cast("long").alias("drivers"), F.coalesce("subclasses", F.lit(0)).cast("long").alias("subclasses"), F.coalesce("bases", F.lit("")).alias("bases"))
    out = out.orderBy(F.desc("drivers"), F.desc("subclasses"), "name")
    return out if top is None else out.limit(top)


def unreferenced_collaborators(m: TestMap) -> DataFrame:
    """Page objects and API clients that nothing uses, inherits or holds."""
    used = m.edge("uses_type", "inherits", "holds").where("to_kind = 'class'").select(F.col("to_id").alias("t_id")).distinct()
    return m.classes.where(F.col("kind").isin(*COLLABORATORS)).select("id", "name", "kind").join(used, F.col("id") == F.col("t_id"), "left_anti")


def unbound_by_feature(m: TestMap) -> DataFrame:
    """(feature_id, scenarios, unbound) of every feature."""
    counted = m.scenarios.groupBy(F.col("feature_id").alias("c_id")).agg(F.count(F.lit(1)).alias("scenarios"))
    steps = m.edge("unbound").join(m.scenario_steps.select("id", "scenario_id"), F.col("from_id") == F.col("id")).drop("id")
    owned = steps.join(m.scenarios.select("id", "feature_id"), F.col("scenario_id") == F.col("id")).groupBy(F.col("feature_id").alias("u_id")).agg(F.count(F.lit(1)).alias("unbound"))
    out = m.features.select(F.col("id").alias("feature_id")).join(counted, F.col("feature_id") == F.col("c_id"), "left").join(owned, F.col("feature_id") == F.col("u_id"), "left")
    return out.select("feature_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("scenarios", "unbound")])


def step_definition_usage(m: TestMap, query: str, limit: int = 20, scenarios: int = 25) -> DataFrame:
    """Definitions whose expression has the query, by id, with usage and the first scenarios that use them."""
    hit = m.step_definitions.where(F.contains(F.lower("expression"), F.lit(query.lower()))).orderBy("id").limit(limit)
    bound = m.edge("binds_to").join(m.scenario_steps.select(F.col("id").alias("st_id"), "scenario_id"), F.col("from_id") == F.col("st_id")).select("to_id", "scenario_id").distinct()
    used = bound.groupBy("to_id").agg(F.count(F.lit(1)).alias("usage"), F.slice(F.array_sort(F.collect_list("scenario_id")), 1, scenarios).alias("ids"))
    out = hit.select("id", "expression", "keyword").join(used, F.col("id") == F.col("to_id"), "left")
    return out.select("id", "expression", "keyword", F.coalesce("usage", F.lit(0)).cast("long").alias("usage"), F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("scenario_ids"))


def scenario_details(m: TestMap, name: str, limit: int = 10) -> DataFrame:
    """Scenarios whose name has the text, by file and line, with their steps in order."""
    hit = m.scenarios.where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("file_path", "line_start", "id").limit(limit)
    steps = m.scenario_steps.select("scenario_id", "ordinal", F.concat_ws(" ", "keyword", "text").alias("step"))
    rows = hit.select(F.col("id").alias("h_id"), "name", "kind").join(steps, F.col("h_id") == F.col("scenario_id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "step"))), lambda x: x["step"]), "\n")
    return rows.groupBy(F.col("h_id").alias("scenario_id"), "name", "kind").agg(joined.alias("steps"))


def step_catalog(definitions: DataFrame, keyword: str | None = None, query: str | None = None, limit: int = 100) -> DataFrame:
    """Definitions by id, of a keyword and with a text if given, with the total number found."""
    hit = definitions
    if keyword:
        hit = hit.where(F.lower("keyword") == keyword.lower())
    if query:
        hit = hit.where(F.contains(F.lower("expression"), F.lit(query.lower())))
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy("id").limit(limit).select("id", "keyword", "expression").crossJoin(F.broadcast(total))


def layout(names: DataFrame, degree: DataFrame) -> DataFrame:
    """Projects by name on a circle: angle, place and node radius by fan-in."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    rows = names.join(degree, F.col("id") == F.col("project_id")).withColumn("k", F.row_number().over(W.orderBy("name")) - 1).withColumn("n", n)
    radius = F.when(F.col("n") <= 1, 0.0).otherwise(F.least(F.lit(400.0), 150.0 + 9.0 * F.col("n")))
    angle = -F.pi() / 2 + 2 * F.pi() * F.col("k") / F.col("n")
    most = F.greatest(F.max("fan_in").over(W.partitionBy()), F.lit(1))
    return rows.select("name", F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"), F.round(7 + 13 * F.col("fan_in") / most, 6).alias("r"))


def logical_dump(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a table as pipe-joined text, nulls empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    out = df.select(F.concat_ws("|", *cells).alias("line"))
    return out.orderBy("line") if not order else out


#: The word before a table's lines in a map's dump, and the columns in them.
DUMPED = {
    "projects": ("project", "id name path target_framework kind"),
    "classes": ("class", "id project_id name namespace base_type kind file_path line_start line_end"),
    "methods": ("method", "id class_id project_id name signature visibility kind file_path line_start line_end"),
    "step_definitions": ("stepdef", "id method_id class_id project_id keyword expression expression_kind parameters file_path line_start"),
    "features": ("feature", "id project_id name tags file_path"),
    "scenarios": ("scenario", "id feature_id name kind tags example_row_count line_start"),
    "scenario_steps": ("step", "id scenario_id keyword text ordinal line_start"),
    "endpoints": ("endpoint", "id verb route"),
    "edges": ("edge", "from_kind from_id to_kind to_id edge_kind confidence"),
    "diagnostics": ("diag", "severity code message location"),
}


def map_dump(m: TestMap) -> DataFrame:
    """(part, at, line) of a whole map in canonical order: its version, its meta without the time, and each table's rows by id.

    Maps of equal inputs have equal dumps. Rows without an id are in order of their line; nulls are empty.
    """
    return dump_lines(m).orderBy("part", "at", "line")


def dump_lines(m: TestMap) -> DataFrame:
    """The rows of map_dump() in no order."""
    spark, none = m.meta.sparkSession, F.lit(0).cast("long").alias("at")
    out = spark.range(1).select(F.lit(0).alias("part"), none, F.lit(f"user_version={SCHEMA_VERSION}").alias("line"))
    meta = m.meta.where("key <> 'generated_utc'")
    out = out.unionByName(meta.select(F.lit(1).alias("part"), none, F.concat(F.lit("meta:"), "key", F.lit("="), F.coalesce("value", F.lit(""))).alias("line")))
    for k, (table, (word, columns)) in enumerate(DUMPED.items(), 2):
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns.split()]
        at = F.col("id").alias("at") if columns.startswith("id ") else none
        out = out.unionByName(m.tables()[table].select(F.lit(k).alias("part"), at, F.concat_ws("|", F.lit(word), *cells).alias("line")))
    return out


def input_hash(files: DataFrame) -> DataFrame:
    """SHA-256 over the files (path, content) in order of path, each as path and content with a zero after both.

    A hash over an order is one stream by nature: the rows are sorted, with spill, and pass through one state; none are held.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        state = hashlib.sha256()
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                if path.is_valid and content.is_valid:
                    state.update(f"{path.as_py()}\0{content.as_py()}\0".encode())
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], ["input_hash"])

    return files.select("path", "content").repartition(1).sortWithinPartitions("path", "content").mapInArrow(run, "input_hash string")
