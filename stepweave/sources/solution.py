"""A test-automation solution as a map: project files, C# sources and feature files, read and parsed by Spark.

Files are parsed in the tasks that read them; what follows are joins over facts tables.
"""

from __future__ import annotations

import datetime
import json
import os
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import expression_kind, glob_filter, inferred_verb, is_generated, quoted_project
from ..functions.options import ClassifierOptions
from ..operators import analytics, binding, classify, structural
from ..operators.storage import cut
from ..schema import TABLES, aligned, empty
from ..testmap import TestMap
from .csharp import scan
from .gherkin import FEATURE, LANGUAGES, read

TOOL_VERSION = "1"

_FACTS = (
    "name string, base_type_name string, has_binding_attribute boolean, has_test_class_attribute boolean, method_count int, step_method_count int, test_method_count int, hook_method_count int, "
    "instance_member_count int, ui_referencing_members int, api_referencing_members int, references_ui_type boolean, references_api_type boolean, holds_or_constructs_api_marker boolean, "
    "constructed_type_names array<string>, is_static boolean"
)
_PAIR = "array<struct<a:string,b:string>>"
_METHOD = f"name:string,signature:string,parameters:string,visibility:string,line_start:int,line_end:int,steps:{_PAIR},used:array<string>,calls:{_PAIR},operations:{_PAIR},has_step:boolean,has_hook:boolean,has_test:boolean"
_TYPE = f"struct<name:string,namespace:string,base_type:string,line_start:int,line_end:int,facts:struct<{_FACTS.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' array<', ':array<').replace(', ', ',')}>,held:array<string>,request:struct<verb:string,route:string,api:string>,methods:array<struct<{_METHOD}>>>"


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text, modified) of the files below a folder whose names match; paths are relative to it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return df.select(F.substring(path, len(base) + 1, 10_000).alias("path"), text.alias("text"), F.col("modificationTime").alias("modified"))


def solution_projects(text: str) -> list[str]:
    """Paths of the C# projects that a solution file lists."""
    found = re.findall(r'^Project\("\{[^}]+\}"\)\s*=\s*"[^"]*",\s*"([^"]+)"', text, re.M)
    return [p.replace("\\", "/") for p in found if p.lower().endswith(".csproj")]


def target_framework(text):
    """The target framework, or frameworks, that a project file names."""
    one = lambda tag: F.nullif(F.trim(F.regexp_extract(text, f"<{tag}>([^<]+)</{tag}>", 1)), F.lit(""))
    return F.coalesce(one("TargetFramework"), one("TargetFrameworks"))


def project_references(projects: DataFrame) -> DataFrame:
    """(path, name): the names of the projects that each project file refers to."""
    listed = F.regexp_extract_all("text", F.lit(r'<ProjectReference\s[^>]*Include\s*=\s*"([^"]+)"'), F.lit(1))
    rows = projects.select("path", F.explode(F.array_distinct(listed)).alias("to"))
    return rows.select("path", F.regexp_extract(F.replace("to", F.lit("\\"), F.lit("/")), r"([^/]+)\.csproj$", 1).alias("name"))


def _types(sources: DataFrame, options: ClassifierOptions) -> DataFrame:
    """(path, project, type) of sources (path, project, text); a file that can't be scanned gives a class `<parse-error>`."""

    def plain(t) -> dict:
        pair = lambda xs: [{"a": a, "b": b} for a, b in xs]
        ms = [{**{k: getattr(m, k) for k in ("name", "signature", "parameters", "visibility", "line_start", "line_end", "used", "has_step", "has_hook", "has_test")}, "steps": pair(m.steps), "calls": pair(m.calls), "operations": pair(m.operations)} for m in t.methods]
        request = t.request and dict(zip(("verb", "route", "api"), t.request, strict=True))
        return {**{k: getattr(t, k) for k in ("name", "namespace", "base_type", "line_start", "line_end", "facts", "held")}, "request": request, "methods": ms}

    def run(batches):
        for batch in batches:
            rows = []
            for path, project, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    types, kind = scan(text or "", options)
                    rows += [(path, project, kind, json.dumps(plain(t))) for t in types]
                except Exception:
                    rows.append((path, project, "regex", json.dumps({"name": "<parse-error>", "namespace": "", "line_start": 0, "line_end": 0, "held": [], "methods": [], "facts": {"name": "<parse-error>"}})))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["path", "project", "default_kind", "json"])

    raw = sources.select("path", "project", "text").mapInArrow(run, "path string, project string, default_kind string, json string")
    return raw.select("path", "project", "default_kind", F.from_json("json", _TYPE).alias("t"))


def _features(sources: DataFrame, languages: dict) -> DataFrame:
    """(path, project, f, problems): f is null where there are problems."""

    def run(batches):
        for batch in batches:
            read_ = [read(x, languages) for x in batch.column(2).to_pylist()]
            got = [json.dumps(None if wrong else f) for f, wrong in read_]
            told = [[f"line {n}: {what}" for n, what in wrong] for _, wrong in read_]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array(told, pa.list_(pa.string()))], ["path", "project", "json", "problems"])

    raw = sources.select("path", "project", "text").mapInArrow(run, "path string, project string, json string, problems array<string>")
    return raw.select("path", "project", F.when(F.col("json") != "null", F.from_json("json", FEATURE)).alias("f"), "problems")


def index(spark: SparkSession, target: str, include: list[str] | None = None, exclude: list[str] | None = None, messages: list[str] | None = None, now: str | None = None, options: ClassifierOptions = ClassifierOptions(), languages: dict = LANGUAGES) -> tuple[TestMap, str]:  # noqa: B008
    """The map of a solution or project file, and the outcome: success, warnings or fatal.

    messages: what a build reported, classified as diagnostics. Files in obj and bin are left out. One bad file or
    project never ends the run.
    """
    root = os.path.dirname(os.path.abspath(target)) or "."
    try:
        listed = solution_projects(open(target, encoding="utf-8-sig").read()) if target.lower().endswith(".sln") else [os.path.basename(target)]
    except (OSError, UnicodeDecodeError) as e:
        m = TestMap(**{t: empty(spark, t) for t in TABLES})
        m.diagnostics = spark.createDataFrame([("error", "open_failed", str(e), target)], TABLES["diagnostics"])
        return m, "fatal"
    found = files(spark, root, "*.csproj").where(F.col("path").isin(listed) & F.contains("text", F.lit("<Project")))
    found = found.withColumn("name", F.regexp_extract("path", r"([^/]+)\.csproj$", 1))
    chosen = cut(found.where(glob_filter(F.col("name"), F.col("path"), include or [], exclude or [])))
    projects = cut(structural.numbered(chosen, [F.col("name"), F.col("path")]).withColumn("dir", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)))
    sources = _owned(files(spark, root, "*.cs"), projects)
    types = cut(_types(sources, options))
    features = cut(_features(_owned(files(spark, root, "*.feature"), projects), languages))

    of = projects.select(F.col("id").alias("project_id"), F.col("path").alias("project_path"))
    rows = types.join(of, F.col("project") == F.col("project_path")).select("project_id", F.col("path").alias("file_path"), "default_kind", "t.*")
    rows = cut(structural.numbered(rows, ["project_id", "namespace", "name", "file_path", "line_start"]))
    kinds = classify.classify(rows.select("id", "facts.*").fillna(0).fillna(False).withColumn("constructed_type_names", F.coalesce("constructed_type_names", F.array().cast("array<string>"))), options)
    classes = cut(rows.join(kinds.select(F.col("id").alias("k_id"), "kind"), F.col("id") == F.col("k_id")).drop("k_id"))

    m_rows = classes.select(F.col("id").alias("class_id"), "project_id", F.col("kind").alias("class_kind"), "file_path", "default_kind", F.explode("methods").alias("m")).select("class_id", "project_id", "class_kind", "file_path", "default_kind", "m.*")
    methods = structural.numbered(m_rows, ["class_id", "name", "signature", "line_start"])
    methods = cut(methods.withColumn("kind", classify.method_kind(F.col("has_step"), F.col("has_hook"), F.col("has_test"), F.col("class_kind"))))
    d_rows = methods.select(F.col("id").alias("method_id"), "class_id", "project_id", "file_path", "line_start", "parameters", "default_kind", F.explode("steps").alias("s"))
    d_rows = d_rows.select("*", F.col("s.a").alias("keyword"), F.col("s.b").alias("expression"))
    definitions = cut(structural.numbered(d_rows.withColumn("expression_kind", expression_kind(F.col("expression"), F.col("default_kind"))), ["method_id", "keyword", "expression"]))

    f_rows = features.where("f is not null").join(of, F.col("project") == F.col("project_path")).select("project_id", F.col("path").alias("file_path"), "f.*")
    f_rows = cut(structural.numbered(f_rows, ["project_id", "file_path"]))
    s_rows = f_rows.select(F.col("id").alias("feature_id"), "project_id", "file_path", F.col("tags").alias("f_tags"), F.posexplode("scenarios").alias("at", "s"))
    s_rows = cut(structural.numbered(s_rows, ["feature_id", "at"]))
    joined = F.concat_ws(" ", F.concat("f_tags", "s.tags"))
    scenarios = s_rows.select("id", "feature_id", "project_id", "s.name", "s.kind", joined.alias("tags"), "s.example_row_count", "file_path", F.col("s.line").alias("line_start"))
    t_rows = s_rows.select(F.col("id").alias("scenario_id"), "project_id", "file_path", F.explode("s.steps").alias("s")).select("scenario_id", "project_id", "file_path", "s.*", F.col("s.line").alias("line_start"))
    steps = cut(structural.numbered(t_rows, ["scenario_id", "ordinal"]))

    clients = classes.select("name", "kind")
    plain = methods.select(F.col("id").alias("method_id"), F.explode("calls").alias("c")).select("method_id", F.col("c.a").alias("verb"), F.col("c.b").alias("route"))
    operations = methods.select(F.col("id").alias("method_id"), F.explode("operations").alias("o")).select("method_id", F.col("o.a").alias("wrapper"), F.col("o.b").alias("route"))
    described = classes.where("request is not null").select(F.col("name").alias("class_name"), F.col("request.verb").alias("known_verb"), F.col("request.route").alias("path"), F.col("request.api").alias("target_api"), F.col("id").alias("place"))
    last = described.groupBy("class_name").agg(F.max_by("known_verb", "place").alias("known_verb"))
    gated = structural.gated_operations(operations, clients).join(last, F.col("route") == F.col("class_name"), "left")
    gated = gated.select("method_id", F.coalesce("known_verb", inferred_verb(F.col("route"))).alias("verb"), "route")
    calls = cut(plain.unionByName(gated))
    endpoints = cut(structural.enrich_endpoints(analytics.deduplicated_endpoints(calls), described))

    bound = binding.binding_edges(steps.select("id", "text"), binding.compiled(definitions).select("id", "pattern"))
    simple = F.regexp_extract(F.regexp_replace("base_type", "<.*", ""), r"([^.]+)$", 1)
    inherits = structural.inherits(classes.where("base_type is not null").select("id", simple.alias("base_name")), classes)
    uses = structural.uses(methods.select("id", "class_id", F.col("used").alias("names")), classes)
    held = structural.holds(classes.select("id", F.col("held").alias("names")), classes)
    refs = structural.references(project_references(chosen).join(of, F.col("path") == F.col("project_path")).select(F.col("project_id").alias("from_id"), "name"), projects)
    sites = analytics.call_edges(calls, endpoints)
    edges = _edges(bound, inherits, uses, held, refs, sites)

    summary = classify.project_kind(classes, projects).withColumnRenamed("id", "k_id")
    diagnostics, errors = _diagnostics(spark, features, projects, classes, listed, messages or [])
    now = now or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    every = sources.select("path", F.col("text").alias("content")).unionByName(_owned(files(spark, root, "*.feature"), projects).select("path", F.col("text").alias("content")))
    digest = analytics.input_hash(every).first()[0]
    meta = [("tool_version", TOOL_VERSION), ("generated_utc", now), ("solution_path", os.path.basename(target)), ("input_hash", digest)]
    out = TestMap(
        meta=spark.createDataFrame(meta, TABLES["meta"]),
        projects=aligned(projects.join(summary, F.col("id") == F.col("k_id")).withColumn("target_framework", target_framework(F.col("text"))), "projects"),
        classes=aligned(classes, "classes"), methods=aligned(methods, "methods"), step_definitions=aligned(definitions, "step_definitions"),
        features=aligned(f_rows.withColumn("tags", F.concat_ws(" ", "tags")), "features"), scenarios=aligned(scenarios, "scenarios"), scenario_steps=aligned(steps, "scenario_steps"),
        endpoints=aligned(endpoints, "endpoints"), edges=aligned(edges, "edges"), diagnostics=diagnostics,
    )
    return out, classify.outcome(projects.count(), errors)


def _owned(found: DataFrame, projects: DataFrame) -> DataFrame:
    """Files with the path of the project in whose folder (the innermost) they lie, those in obj and bin left out."""
    p = projects.select(F.col("path").alias("project"), "dir")
    parts = F.split(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = found.withColumn("up", F.explode(F.array_distinct(F.transform(above, lambda d: F.when(d == "", "").otherwise(F.concat(d, F.lit("/")))))))
    hit = up.join(p, F.col("up") == F.col("dir")).groupBy("path").agg(F.max_by("project", F.length("dir")).alias("project"), F.max(F.length("dir")).alias("depth"))
    out = found.join(hit.withColumnRenamed("path", "h_path"), F.col("path") == F.col("h_path"))
    return out.where(~is_generated(F.expr("substring(path, depth + 1)"))).select("path", "project", "text", "modified")


def _edges(bound, inherits, uses, held, refs, sites) -> DataFrame:
    def part(df, from_kind, from_id, to_kind, to_id, kind, confidence):
        return df.select(F.lit(from_kind).alias("from_kind"), F.col(from_id).alias("from_id"), F.lit(to_kind).alias("to_kind"), F.col(to_id).alias("to_id"), kind.alias("edge_kind"), confidence.alias("confidence"))

    c = F.col("confidence")
    return (
        part(bound, "scenario_step", "step_id", "step_definition", "step_definition_id", F.col("edge_kind"), c)
        .unionByName(part(inherits, "class", "from_id", "class", "to_id", F.lit("inherits"), c))
        .unionByName(part(uses, "method", "method_id", "class", "class_id", F.lit("uses_type"), c))
        .unionByName(part(held, "class", "from_id", "class", "to_id", F.lit("holds"), F.lit("exact")))
        .unionByName(part(refs, "project", "from_id", "project", "to_id", F.lit("references"), F.lit("")))
        .unionByName(part(sites, "method", "method_id", "endpoint", "endpoint_id", F.lit("calls_endpoint"), F.lit("")))
    )


def _diagnostics(spark: SparkSession, features: DataFrame, projects: DataFrame, classes: DataFrame, listed: list[str], messages: list[str]) -> tuple[DataFrame, int]:
    bad = features.where("f is null").select(F.lit("warning").alias("severity"), F.lit("feature_parse_error").alias("code"), F.explode("problems").alias("message"), F.col("path").alias("location"))
    n = projects.count()
    lost = [("error", "project_not_loaded", f"{len(listed) - n} of {len(listed)} projects were not loaded", None)] if n < len(listed) else []
    said = spark.createDataFrame([(x,) for x in messages], T.StructType().add("message", "string"))
    loaded = projects.join(classes.select("project_id").distinct(), F.col("id") == F.col("project_id"), "left_semi").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
    said = said.withColumn("named", F.regexp_extract(F.replace(quoted_project(F.col("message")), F.lit("\\"), F.lit("/")), "([^/]+)$", 1))
    said = said.join(loaded, F.col("named") == F.col("file"), "left").withColumn("d", classify.diagnostic_of(F.col("message"), F.col("file").isNotNull()))
    said = said.select("d.severity", "d.code", "message", F.lit(None).cast("string").alias("location"))
    out = cut(bad.unionByName(said).unionByName(spark.createDataFrame(lost, TABLES["diagnostics"])))
    return aligned(out, "diagnostics"), out.where("severity = 'error'").count()


def stale_files(spark: SparkSession, root: str, generated_utc: str, limit: int = 10) -> DataFrame:
    """The newest authored sources and features changed after a map was made.

    Generated files, obj, bin and folders that have a solution of their own are left out.
    """
    found = files(spark, root, "*.cs").unionByName(files(spark, root, "*.feature")).where(~is_generated(F.col("path")))
    # Endings of generated sources.
    made = (".feature.cs", ".g.cs", ".designer.cs", ".generated.cs", ".assemblyattributes.cs")
    written = ~reduce(lambda a, b: a | b, [F.lower("path").endswith(x) for x in made])
    nested = files(spark, root, "*.sln").where(F.contains("path", F.lit("/"))).select(F.regexp_replace("path", "[^/]+$", "").alias("below")).distinct()
    found = found.join(F.broadcast(nested), F.startswith("path", "below"), "left_anti")
    return found.where(written & (F.col("modified") > F.to_timestamp(F.lit(generated_utc)))).orderBy(F.desc("modified"), "path").limit(limit).select("path", "modified")
