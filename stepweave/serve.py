"""Queries over a map as JSON-RPC 2.0 tools, one message a line; answers are small collected frames."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import functions as F

from .functions.expressions import clamp_limit, placeholders
from .operators import analytics, binding, graph, search
from .schema import SCHEMA_VERSION
from .testmap import TestMap

MOST = 200

TOOLS: dict[str, tuple[str, list[str], list[str]]] = {  # name: what it answers, needed arguments, further arguments
    "stats": ("Entity counts and histograms of the map.", [], []),
    "impact": ("Scenarios that a change to a class, method, step or endpoint affects.", ["target", "value"], []),
    "search_steps": ("Step definitions that have all words of a query.", ["query"], []),
    "search_scenarios": ("Scenarios that have all words of a query.", ["query"], []),
    "list_endpoints": ("Endpoints by the scenarios that reach them.", [], ["limit"]),
    "resolve_step": ("The definitions that a step's text binds to, or near ones.", ["text"], ["keyword"]),
    "get_scenario": ("Scenarios by name, with their steps.", ["name"], ["limit"]),
    "get_step_definition": ("Step definitions by expression, with their usage.", ["query"], ["limit"]),
    "list_tags": ("Tags by how often they occur.", [], ["limit"]),
    "step_catalog": ("Reusable step definitions with their placeholders.", [], ["keyword", "query", "limit"]),
    "project_dependencies": ("What projects depend on, by number of edges.", [], ["project", "limit"]),
}


class Server:
    def __init__(self, m: TestMap):
        self.m = m
        self.spark = m.classes.sparkSession

    # protocol

    def handle(self, line: str) -> str | None:
        """The answer to a message, or None for a notification."""
        try:
            message = json.loads(line)
        except ValueError:
            return self._error(None, -32700, "parse error")
        if not isinstance(message, dict) or "method" not in message:
            return self._error(message.get("id") if isinstance(message, dict) else None, -32600, "invalid request")
        if "id" not in message:
            return None
        id_, method, params = message["id"], message["method"], message.get("params") or {}
        try:
            if method == "initialize":
                return self._result(id_, {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "stepweave", "version": str(SCHEMA_VERSION)}})
            if method == "ping":
                return self._result(id_, {})
            if method == "tools/list":
                return self._result(id_, {"tools": [self._described(n) for n in TOOLS]})
            if method == "tools/call":
                if params.get("name") not in TOOLS:
                    return self._error(id_, -32602, f"unknown tool {params.get('name')}")
                got = self.call(params["name"], params.get("arguments") or {})
                return self._result(id_, {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False)}]})
            return self._error(id_, -32601, f"unknown method {method}")
        except Exception as e:
            return self._error(id_, -32603, str(e)[:500])

    @staticmethod
    def _result(id_, result) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": id_, "result": result}, ensure_ascii=False)

    @staticmethod
    def _error(id_, code: int, message: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}})

    @staticmethod
    def _described(name: str) -> dict:
        what, need, more = TOOLS[name]
        kind = lambda a: {"type": "integer" if a == "limit" else "string"}
        return {"name": name, "description": what, "inputSchema": {"type": "object", "properties": {a: kind(a) for a in need + more}, "required": need}}

    def call(self, name: str, args: dict) -> dict:
        """A tool's payload; a missing argument gives {'error': ...}."""
        for a in TOOLS[name][1]:
            if not isinstance(args.get(a), str) or not args[a].strip():
                return {"error": f"{name} requires {', '.join(TOOLS[name][1])}"}
        tool: Callable[[dict], dict] = getattr(self, f"_{name}")
        return tool(args)

    # tools

    @staticmethod
    def _rows(df) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _stats(self, args: dict) -> dict:
        out = {r["entity"]: r["n"] for r in analytics.entity_counts(self.m).collect()}
        out["classKinds"] = {r["kind"]: r["n"] for r in analytics.histogram(self.m.classes, "kind").collect()}
        out["edgeKinds"] = {r["edge_kind"]: r["n"] for r in analytics.histogram(self.m.edges, "edge_kind").collect()}
        return out | {"schemaVersion": SCHEMA_VERSION, "solution": next((r["value"] for r in self.m.meta.where("key = 'solution_path'").collect()), None)}

    def _impact(self, args: dict) -> dict:
        if args["target"] not in ("class", "method", "step", "endpoint"):
            return {"error": "impact requires target (class, method, step or endpoint) and value"}
        got = graph.impact(self.m, args["target"], args["value"])
        total = got.summary.first()
        rows = self._rows(got.scenarios.orderBy("feature", "scenario", "scenario_id").limit(MOST).select("scenario", "feature", "via"))
        for r in rows:
            r["via"] = r["via"].split(" | ")
        return {"found": total["found"], "target": label(self.m, args["target"], args["value"]), "stepDefinitions": total["definitions"], "features": total["features"], "scenarios": total["scenarios"], "affected": rows, "truncated": max(0, total["scenarios"] - MOST)}

    def _search_steps(self, args: dict) -> dict:
        hit = search.search_steps(self.m, args["query"])
        more = self.m.step_definitions.select(F.col("id").alias("d_id"), "keyword", "file_path", "line_start")
        rows = hit.limit(MOST).join(more, F.col("id") == F.col("d_id")).orderBy("id")
        return {"count": hit.count(), "hits": self._rows(rows.select("expression", "keyword", F.col("class_name").alias("class"), self._place()))}

    def _search_scenarios(self, args: dict) -> dict:
        hit = search.search_scenarios(self.m, args["query"])
        more = self.m.scenarios.select(F.col("id").alias("s_id"), "file_path", "line_start")
        rows = hit.limit(MOST).join(more, F.col("id") == F.col("s_id")).orderBy("id")
        return {"count": hit.count(), "hits": self._rows(rows.select(F.col("scenario_name").alias("scenario"), F.col("feature_name").alias("feature"), F.nullif("tags", F.lit("")).alias("tags"), self._place()))}

    @staticmethod
    def _place():
        return F.concat_ws(":", "file_path", F.col("line_start").cast("string")).alias("location")

    def _list_endpoints(self, args: dict) -> dict:
        known = self.m.endpoints.select(F.col("id").alias("e_id"), "path", "target_api")
        ranked = graph.endpoint_ranking(self.m).join(known, F.col("endpoint_id") == F.col("e_id"))
        rows = ranked.orderBy(F.desc("scenarios"), F.desc("call_sites"), "route", "verb").limit(clamp_limit(args.get("limit"), 50))
        shown = rows.select("verb", F.coalesce("path", "route").alias("route"), F.when(F.col("path").isNotNull(), F.col("route")).alias("requestType"), F.col("target_api").alias("targetApi"), F.col("call_sites").alias("callSites"), "scenarios")
        return {"total": self.m.endpoints.count(), "endpoints": self._rows(shown)}

    def _resolve_step(self, args: dict) -> dict:
        text = self.spark.createDataFrame([(args["text"],)], "text string")
        defs = binding.compiled(self.m.step_definitions)
        pairs = binding.captures(binding.matches(text, defs)).withColumnRenamed("pattern", "p")
        hit = pairs.join(defs, F.col("p") == F.col("pattern")).orderBy("id")
        seen, rows = set(), []
        for r in self._rows(hit.select("expression", "keyword", "captures", "file_path", "line_start")):
            place = (r["file_path"], r["line_start"], r["expression"])
            if place not in seen:
                seen.add(place)
                rows.append({"expression": r["expression"], "keyword": r["keyword"], "captures": r["captures"], "location": f"{place[0]}:{place[1]}"})
        out = {"status": "none" if not rows else "exact" if len(rows) == 1 else "ambiguous", "matches": rows}
        if not rows:
            near = search.suggestions(text.select(F.lit(1).alias("key"), "text"), search.step_index(self.m), ["expression", "method_name", "class_name"])
            named = near.join(self.m.step_definitions.select(F.col("id").alias("d_id"), "expression"), F.col("id") == F.col("d_id")).orderBy("place")
            out["suggestions"] = self._rows(named.select("expression", "score"))
        return out

    def _get_scenario(self, args: dict) -> dict:
        rows = self._rows(analytics.scenario_details(self.m, args["name"], clamp_limit(args.get("limit"), 10)).orderBy("scenario_id"))
        return {"count": len(rows), "scenarios": [{"scenario": r["name"], "kind": r["kind"], "steps": r["steps"].split("\n")} for r in rows]}

    def _get_step_definition(self, args: dict) -> dict:
        rows = self._rows(analytics.step_definition_usage(self.m, args["query"], clamp_limit(args.get("limit"), 20)).orderBy("id"))
        wanted = {int(x) for r in rows for x in r["scenario_ids"].split(",") if x}
        names = {r["id"]: r["name"] for r in self.m.scenarios.where(F.col("id").isin(sorted(wanted))).select("id", "name").collect()} if wanted else {}
        return {"count": len(rows), "stepDefinitions": [{"expression": r["expression"], "keyword": r["keyword"], "usageCount": r["usage"], "usedByScenarios": [names[int(x)] for x in r["scenario_ids"].split(",") if x and int(x) in names]} for r in rows]}

    def _list_tags(self, args: dict) -> dict:
        return {"tags": [{"tag": r["tag"], "count": r["n"]} for r in analytics.tag_counts(self.m.scenarios, clamp_limit(args.get("limit"), MOST)).collect()]}

    def _step_catalog(self, args: dict) -> dict:
        limit = clamp_limit(args.get("limit"), 100)
        rows = analytics.step_catalog(self.m.step_definitions, args.get("keyword"), args.get("query"), limit)
        kinds = self.m.step_definitions.select(F.col("id").alias("d_id"), "expression_kind")
        rows = rows.join(kinds, F.col("id") == F.col("d_id")).orderBy("id").select("keyword", "expression", "total", placeholders(F.col("expression"), F.col("expression_kind")).alias("placeholders"))
        got = self._rows(rows)
        for r in got:
            r["placeholders"] = [{"kind": p["kind"], "values": p["type"].split("|")} if p["kind"] == "enum" else {k: v for k, v in p.items() if v is not None} for p in r["placeholders"]]
        total = got[0]["total"] if got else 0
        return {"total": total, "shown": min(total, limit), "steps": [{k: v for k, v in r.items() if k != "total"} for r in got]}

    def _project_dependencies(self, args: dict) -> dict:
        names = {r["id"]: r["name"] for r in self.m.projects.collect()}
        links = analytics.project_dependencies(self.m).orderBy(F.desc("weight"), "from_project", "to_project").collect()
        out = []
        for id_, name in sorted(names.items(), key=lambda x: x[1]):
            if args.get("project") and args["project"].lower() not in name.lower():
                continue
            on = [{"project": names[r["to_project"]], "weight": r["weight"]} for r in links if r["from_project"] == id_]
            by = [{"project": names[r["from_project"]], "weight": r["weight"]} for r in links if r["to_project"] == id_]
            out.append({"project": name, "dependsOn": on, "dependedOnBy": by})
        return {"projects": out[: clamp_limit(args.get("limit"), MOST)]}


def label(m: TestMap, target: str, value: str) -> str:
    """What an impact query was about, with the number of things its value named."""
    if target == "class":
        named = m.classes.where(F.lower("name") == value.lower())
        first = named.orderBy("id").select("kind").first()
        if first is None:
            return f"class {value} (not found)"
        seeds = named.select(F.lit(0).alias("seed"), F.col("id").alias("node"))
        derived = graph.closure(seeds, graph.inherit_adjacency(m)).count() - named.count()
        return f"class {value} ({first[0]}{f', {derived} derived' if derived else ''})"
    if target == "method":
        n = m.methods.where(F.lower("name") == value.lower()).count()
        return f"method {value} ({n} match{'' if n == 1 else 'es'})"
    if target == "step":
        n = m.step_definitions.where(F.contains(F.lower("expression"), F.lit(value.lower()))).count()
        return f'step matching "{value}" ({n} definition{"" if n == 1 else "s"})'
    hit = m.endpoints.where(F.contains(F.lower("route"), F.lit(value.lower()))).orderBy("id")
    n, first = hit.count(), [f"{r['verb']} {r['route']}" for r in hit.limit(3).collect()]
    return f'endpoint matching "{value}" ({n} endpoint{"" if n == 1 else "s"}{": " + ", ".join(first) if first else ""}{f" … +{n - 3} more" if n > 3 else ""})'


def run(m: TestMap) -> None:
    """Answers the messages on standard input, one a line."""
    server = Server(m)
    for line in sys.stdin:
        if line.strip() and (answer := server.handle(line)) is not None:
            print(answer, flush=True)


