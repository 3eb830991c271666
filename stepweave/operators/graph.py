"""Transitive closure and change impact over the edges of a test map."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..testmap import TestMap
from . import reach

#: Edges up to which a graph is broadcast and each seed is followed inside one task.
SMALL_GRAPH = 500_000


def closure(seeds: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(seed, node): every node that a seed's nodes reach along adjacency (src, dst), the start included.

    seeds: (seed, node). The graph of a code base is small, so it is counted and broadcast, and seeds are spread over
    the tasks. Beyond SMALL_GRAPH edges it is condensed, and bits of seeds travel through its components.
    """
    seeds = seeds.select("seed", "node").distinct()
    edges = adjacency.select("src", "dst").where("src <> dst").distinct()
    found = edges.limit(SMALL_GRAPH + 1).collect()
    if len(found) > SMALL_GRAPH:
        return reach.closure(seeds, edges)
    out: dict = {}
    for s, d in found:
        out.setdefault(s, []).append(d)
    shared = seeds.sparkSession.sparkContext.broadcast(out)

    def run(key, table):
        graph, start = shared.value, table.column("node").to_pylist()
        seen, todo = set(start), list(start)
        while todo:
            for d in graph.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        nodes = sorted(seen)
        return pa.table({"seed": pa.array([key[0].as_py()] * len(nodes), table.schema.field("seed").type), "node": pa.array(nodes, table.schema.field("node").type)})

    return seeds.groupBy("seed").applyInArrow(run, seeds.schema)


def inherit_adjacency(m: TestMap) -> DataFrame:
    """Base class to derived class."""
    return m.edge("inherits").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))


def class_adjacency(m: TestMap) -> DataFrame:
    """Used class to the class of the using method, and base class to derived class."""
    uses = m.edge("uses_type").join(m.methods.select(F.col("id").alias("m_id"), "class_id"), F.col("from_id") == F.col("m_id"))
    return uses.select(F.col("to_id").alias("src"), F.col("class_id").alias("dst")).unionByName(inherit_adjacency(m)).distinct()


def endpoint_seeds(m: TestMap, endpoints: DataFrame | None = None) -> DataFrame:
    """(seed, node): the classes whose methods call an endpoint."""
    calls = m.edge("calls_endpoint").select(F.col("to_id").alias("seed"), F.col("from_id").alias("method_id"))
    if endpoints is not None:
        calls = calls.join(endpoints.select(F.col("id").alias("e_id")), F.col("seed") == F.col("e_id"), "left_semi")
    return calls.join(m.methods.select(F.col("id").alias("m_id"), "class_id"), F.col("method_id") == F.col("m_id")).select("seed", F.col("class_id").alias("node")).distinct()


def endpoint_reach(m: TestMap, endpoints: DataFrame | None = None) -> DataFrame:
    """(endpoint_id, class_id): classes from which an endpoint's callers are reached, for all endpoints at once."""
    return closure(endpoint_seeds(m, endpoints), class_adjacency(m)).select(F.col("seed").alias("endpoint_id"), F.col("node").alias("class_id"))


def endpoint_definitions(m: TestMap, endpoints: DataFrame | None = None) -> DataFrame:
    """(endpoint_id, step_definition_id): definitions that call an endpoint, or use a class that reaches it."""
    calls = m.edge("calls_endpoint").select(F.col("to_id").alias("endpoint_id"), F.col("from_id").alias("method_id"))
    if endpoints is not None:
        calls = calls.join(endpoints.select(F.col("id").alias("e_id")), F.col("endpoint_id") == F.col("e_id"), "left_semi")
    defs = m.step_definitions.select(F.col("id").alias("step_definition_id"), F.col("method_id").alias("d_method"))
    direct = calls.join(defs, F.col("method_id") == F.col("d_method")).select("endpoint_id", "step_definition_id")
    uses = m.edge("uses_type").select(F.col("from_id").alias("u_method"), F.col("to_id").alias("u_class"))
    through = endpoint_reach(m, endpoints).join(uses, F.col("class_id") == F.col("u_class")).join(defs, F.col("u_method") == F.col("d_method"))
    return direct.unionByName(through.select("endpoint_id", "step_definition_id")).distinct()


def bound_scenarios(m: TestMap) -> DataFrame:
    """(step_definition_id, scenario_id, text) of all bound steps, ambiguous ones too."""
    b = m.edge("binds_to").select(F.col("from_id").alias("step_id"), F.col("to_id").alias("step_definition_id"))
    return b.join(m.scenario_steps.select("id", "scenario_id", "text"), F.col("step_id") == F.col("id")).select("step_definition_id", "scenario_id", "text")


def endpoint_scenarios(m: TestMap, endpoints: DataFrame | None = None) -> DataFrame:
    """(endpoint_id, scenario_id), distinct; read by either key."""
    return endpoint_definitions(m, endpoints).join(bound_scenarios(m), "step_definition_id").select("endpoint_id", "scenario_id").distinct()


def endpoint_ranking(m: TestMap) -> DataFrame:
    """(endpoint_id, verb, route, call_sites, scenarios): distinct calling methods and distinct reached scenarios."""
    sites = m.edge("calls_endpoint").groupBy(F.col("to_id").alias("c_id")).agg(F.count_distinct("from_id").alias("call_sites"))
    reached = endpoint_scenarios(m).groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("scenarios"))
    out = m.endpoints.join(sites, F.col("id") == F.col("c_id"), "left").join(reached, F.col("id") == F.col("endpoint_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias("endpoint_id"), "verb", "route", zero("call_sites"), zero("scenarios"))


@dataclass
class Impact:
    """What a change affects: the definitions, the scenarios with the steps through which they are reached, a summary."""

    definitions: DataFrame
    scenarios: DataFrame
    summary: DataFrame


def affected_definitions(m: TestMap, target: str, value: str) -> DataFrame:
    """(step_definition_id) that a change to a class, method, step or endpoint affects."""
    defs = m.step_definitions
    same = lambda c: F.lower(F.col(c)) == value.lower()
    holds = lambda c: F.contains(F.lower(F.col(c)), F.lit(value.lower()))
    uses = m.edge("uses_type").select(F.col("from_id").alias("u_method"), F.col("to_id").alias("u_class"))
    if target == "class":
        seeds = m.classes.where(same("name")).select(F.lit(0).alias("seed"), F.col("id").alias("node"))
        family = closure(seeds, inherit_adjacency(m))
        reach = closure(family, class_adjacency(m)).select(F.col("node").alias("r_id"))
        own = defs.join(family.select(F.col("node").alias("f_id")), F.col("class_id") == F.col("f_id"), "left_semi").select("id")
        through = defs.join(uses.join(reach, F.col("u_class") == F.col("r_id")), F.col("method_id") == F.col("u_method"), "left_semi").select("id")
        out = own.unionByName(through).distinct()
    elif target == "method":
        named = m.methods.where(same("name")).select(F.col("id").alias("n_id"))
        out = defs.join(named, F.col("method_id") == F.col("n_id"), "left_semi").select("id")
    elif target == "step":
        out = defs.where(holds("expression")).select("id")
    elif target == "endpoint":
        hit = m.endpoints.where(holds("route"))
        out = endpoint_definitions(m, hit).select(F.col("step_definition_id").alias("id")).distinct()
    else:
        raise ValueError("target must be class, method, step or endpoint")
    return out.select(F.col("id").alias("step_definition_id"))


def impact(m: TestMap, target: str, value: str) -> Impact:
    """Scenarios affected by a change: bound to an affected definition; `via` lists the distinct step texts in order."""
    defs = affected_definitions(m, target, value)
    hit = defs.join(bound_scenarios(m), "step_definition_id")
    via = hit.groupBy("scenario_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " | ").alias("via"))
    named = via.join(m.scenarios.select(F.col("id").alias("s_id"), F.col("name").alias("scenario"), "feature_id"), F.col("scenario_id") == F.col("s_id"))
    named = named.join(m.features.select(F.col("id").alias("f_id"), F.col("name").alias("feature")), F.col("feature_id") == F.col("f_id"), "left")
    rows = named.select("scenario_id", "scenario", F.coalesce("feature", F.lit("?")).alias("feature"), "via")
    summary = defs.agg(F.count(F.lit(1)).alias("definitions")).crossJoin(rows.agg(F.count(F.lit(1)).alias("scenarios"), F.count_distinct("feature").alias("features")))
    return Impact(defs, rows, summary.withColumn("found", F.col("definitions") > 0))
