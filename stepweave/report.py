"""HTML reports of a map: an overview with coverage and rankings, and a drawing of how projects depend on each other."""

from __future__ import annotations

import json
import math
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import analytics, binding, graph
from .operators.storage import Scratch, located
from .testmap import TestMap

_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}.unbound{color:#b00}.ambiguous{color:#a60}"
_FILTER = "function f(q){q=q.toLowerCase();document.querySelectorAll('[data-t]').forEach(e=>{let own=e.dataset.t.toLowerCase().includes(q);let any=own;e.querySelectorAll('li').forEach(s=>{let h=own||s.textContent.toLowerCase().includes(q);s.hidden=!h;any=any||h});e.hidden=!any})}"


def _table(title: str, rows: list[dict]) -> str:
    if not rows:
        return f"<h2>{escape(title)}</h2><p>none</p>"
    head = "".join(f"<th>{escape(k)}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def _escaped(text: Column) -> Column:
    """What html.escape gives, as a column."""
    out = F.coalesce(text, F.lit(""))
    for c in "&<>\"'":
        out = F.replace(out, F.lit(c), F.lit(escape(c)))
    return out


#: The end of a scenario's fragment, which parts out the lines of the files that tasks write.
_END = "</ul></div>"


def _fragments(m: TestMap, view: DataFrame) -> DataFrame:
    """(fragment) of every scenario in order, less _END."""
    steps = view.join(m.scenario_steps, F.col("step_id") == F.col("id")).select("scenario_id", "ordinal", "keyword", "text", "status", "targets")
    names = m.scenarios.select(F.col("id").alias("s_id"), F.col("name").alias("scenario"), "feature_id").join(m.features.select(F.col("id").alias("f_id"), F.col("name").alias("feature")), F.col("feature_id") == F.col("f_id"), "left")
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "keyword", "text", "status", "targets"))).alias("steps")
    tree = steps.join(names, F.col("scenario_id") == F.col("s_id")).groupBy("feature", "scenario_id", "scenario").agg(listed)
    item = lambda s: F.concat(F.lit('<li class="'), s["status"], F.lit('" title="'), _escaped(s["targets"]), F.lit('">'), _escaped(s["keyword"]), F.lit(" "), _escaped(s["text"]), F.lit("</li>"))
    feature = F.when(F.col("feature") != "", F.col("feature")).otherwise("?")
    name = _escaped(F.col("scenario"))
    whole = F.concat(F.lit('<div data-t="'), name, F.lit('"><b>'), _escaped(feature), F.lit("</b>: "), name, F.lit("<ul>"), F.array_join(F.transform("steps", item), ""))
    return tree.orderBy("feature", "scenario_id").select(whole.alias("fragment"))


def _overview(m: TestMap) -> tuple[str, DataFrame, str]:
    """(what stands before the scenarios, their fragments, what stands after)."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    edges = m.edge("binds_to", "unbound").select(F.col("from_id").alias("step_id"), F.col("to_id").alias("step_definition_id"), "edge_kind", "confidence")
    view = binding.binding_view(m.scenario_steps, edges, m.step_definitions)
    states = {r["status"]: r["n"] for r in view.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(states.values())
    percent = round(100 * (total - states.get("unbound", 0)) / total) if total else 0
    ranked = graph.endpoint_ranking(m).orderBy(F.desc("scenarios"), F.desc("call_sites"), "route", "verb").limit(80)
    head = "".join(
        [
            f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Test map</title><style>{_STYLE}</style><script>{_FILTER}</script></head><body><h1>Test map</h1>",
            f"<p>Step coverage: <b>{percent} %</b> of {total} steps ({states.get('ambiguous', 0)} ambiguous, {states.get('unbound', 0)} unbound)</p>",
            _table("Projects", rows(analytics.project_table(m).orderBy("name"))),
            _table("Class kinds", rows(analytics.histogram(m.classes, "kind"))),
            _table("Endpoints", rows(ranked)),
            _table("Collaborators", rows(analytics.collaborators(m))),
            _table("Unreferenced collaborators", rows(analytics.unreferenced_collaborators(m).orderBy("name"))),
            _table("Tags", rows(analytics.tag_counts(m.scenarios))),
            _table("Features", rows(analytics.unbound_by_feature(m).orderBy(F.desc("unbound"), "feature_id"))),
            _table("Diagnostics", rows(analytics.diagnostic_summary(m.diagnostics))),
            "<h2>Scenarios</h2><input oninput='f(this.value)' placeholder='filter'>",
        ]
    )
    return head, _fragments(m, view), "</body></html>"


def overview(m: TestMap) -> str:
    """Coverage, counts, endpoints, collaborators, tags, diagnostics, and all scenarios with their steps' bindings, as one text."""
    head, fragments, tail = _overview(m)
    return head + "".join(r["fragment"] + _END for r in fragments.collect()) + tail


def write_overview(m: TestMap, path: str) -> None:
    """overview() as a file on any Hadoop path. Tasks write the scenarios by ranges; the parts are copied one after the other, so the
    driver holds a buffer, whatever their number."""
    spark = m.meta.sparkSession
    head, fragments, tail = _overview(m)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(located(path, spark))
    with Scratch(spark) as scratch:
        folder = f"{scratch.folder}/report"
        fragments.write.option("lineSep", _END).text(folder)
        at = hadoop.fs.Path(folder)
        fs = at.getFileSystem(conf)
        parts = sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        out = target.getFileSystem(conf).create(target, True)
        try:
            out.write(bytearray(head.encode()))
            for part in parts:
                stream = fs.open(part)
                try:
                    hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                finally:
                    stream.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()


def arc(x0: float, y0: float, x1: float, y1: float, r0: float, r1: float) -> str:
    """The path of a curve between two circles' rims, bent by 14 % of its length."""
    dx, dy = x1 - x0, y1 - y0
    length = math.hypot(dx, dy) or 1.0
    ux, uy = dx / length, dy / length
    cx, cy = (x0 + x1) / 2 - uy * 0.14 * length, (y0 + y1) / 2 + ux * 0.14 * length
    return f"M{x0 + ux * r0:.1f},{y0 + uy * r0:.1f} Q{cx:.1f},{cy:.1f} {x1 - ux * r1:.1f},{y1 - uy * r1:.1f}"


def project_map(m: TestMap) -> str:
    """Projects on a circle, links by weight; links of references alone are dashed."""
    places = {r["id"]: r for r in analytics.layout(m.projects.select("id", "name"), analytics.project_degree(m)).join(m.projects.select("id", F.col("name").alias("n")), F.col("name") == F.col("n")).collect()}
    links = analytics.project_links(m).orderBy("from_project", "to_project").collect()
    most = max([r["semantic"] for r in links], default=1) or 1
    out = []
    for r in links:
        a, b = places[r["from_project"]], places[r["to_project"]]
        dash = ' stroke-dasharray="4"' if r["references_only"] else ""
        width = 1 + 3.5 * r["semantic"] / most
        out.append(f'<path d="{arc(a["x"], a["y"], b["x"], b["y"], a["r"], b["r"])}" fill="none" stroke="#888" stroke-width="{width:.2f}"{dash}><title>{escape(a["name"])} → {escape(b["name"])}: {escape(r["detail"])}</title></path>')
    for p in places.values():
        out.append(f'<circle cx="{p["x"]}" cy="{p["y"]}" r="{p["r"]}" fill="#48c"/><text x="{p["x"]}" y="{p["y"] - p["r"] - 3}" text-anchor="middle">{escape(p["name"])}</text>')
    counts = {"projects": len(places), "semantic": sum(not r["references_only"] for r in links), "build_only": sum(r["references_only"] for r in links)}
    data = json.dumps(counts).replace("<", "\\u003c")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Project map</title></head><body><svg viewBox='-480 -480 960 960' width='960'>{''.join(out)}</svg><script type='application/json'>{data}</script></body></html>"
