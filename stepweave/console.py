"""What the command line prints: counts, search hits and impact as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from .operators import analytics, binding, graph, search
from .schema import SCHEMA_VERSION
from .serve import label
from .testmap import TestMap

#: Rows of a list that are printed; how many more there are is said.
ERRORS, SCENARIOS = 20, 200


def columns(rows: list[tuple], heads: tuple[str, ...]) -> Iterator[str]:
    """Lines of a table: texts to the left, numbers to the right, as wide as their widest cell up to 40."""
    cells = [heads, *[tuple("" if v is None else str(v) for v in r) for r in rows]]
    wide = [min(40, max(len(r[k]) for r in cells)) for k in range(len(heads))]
    right = [bool(rows) and isinstance(rows[0][k], int) for k in range(len(heads))]
    for r in cells:
        cut = [c if len(c) <= w else c[: w - 1] + "…" for c, w in zip(r, wide, strict=True)]
        yield "  ".join(c.rjust(w) if to_right else c.ljust(w) for c, w, to_right in zip(cut, wide, right, strict=True)).rstrip()


def more(shown: int, total: int, what: str) -> Iterator[str]:
    if total > shown:
        yield f"  … {total - shown} more {what}"


def old(version: int) -> Iterator[str]:
    if version != SCHEMA_VERSION:
        yield f"The map has schema {version}, this program {SCHEMA_VERSION}: index again for what is new since."


def stats(m: TestMap, path: str, version: int) -> Iterator[str]:
    made = m.meta.where("key = 'generated_utc'").first()
    yield f"{path}: schema {version}" + (f", made {made['value']}" if made else "")
    yield from old(version)
    yield ""
    yield from columns([(r["name"], r["classes"], r["methods"]) for r in analytics.project_counts(m).orderBy("name").select("name", "classes", "methods").collect()], ("project", "classes", "methods"))
    yield ""
    yield from columns([(r["entity"], r["n"]) for r in analytics.entity_counts(m).collect()], ("table", "rows"))
    yield ""
    kinds = [(k, n) for k, n in analytics.histogram(m.classes, "kind").orderBy(F.desc("n"), "kind").select("kind", "n").collect()]
    yield from columns(kinds, ("class kind", "classes"))
    yield ""
    t = binding.binding_tallies(m.edges.withColumnsRenamed({"from_id": "step_id"})).first()
    yield f"steps: {t['bound']} bound, {t['ambiguous']} of them ambiguous, {t['unbound']} unbound"
    edges = {r["edge_kind"]: r["n"] for r in analytics.histogram(m.edges, "edge_kind").collect()}
    yield "edges: " + (", ".join(f"{n} {k}" for k, n in sorted(edges.items())) or "none")
    said = analytics.diagnostic_summary(m.diagnostics).collect()
    yield "diagnostics: " + (", ".join(f"{r['n']} {r['severity']} {r['code']}" for r in said) or "none")
    errors = m.diagnostics.where("severity = 'error'")
    for r in errors.orderBy("code", "message").limit(ERRORS).collect():
        yield f"  - {r['message']}"
    yield from more(ERRORS, errors.count(), "errors")


def found(m: TestMap, query: str, steps: bool, scenarios: bool) -> Iterator[str]:
    if steps:
        hit = search.search_steps(m, query)
        rows = hit.join(m.step_definitions.select(F.col("id").alias("d_id"), "keyword", "file_path", "line_start"), F.col("id") == F.col("d_id")).orderBy("id").toLocalIterator()
        lines = [f"  [{r['keyword']}] {r['expression']}  ({r['class_name']}, {r['file_path'].rsplit('/', 1)[-1]}:{r['line_start']})" for r in rows]
        yield f"{len(lines)} step definitions have {query!r}"
        yield from lines
    if scenarios:
        hit = search.search_scenarios(m, query)
        rows = hit.join(m.scenarios.select(F.col("id").alias("s_id"), "file_path", "line_start"), F.col("id") == F.col("s_id")).orderBy("id").toLocalIterator()
        lines = [f"  {r['feature_name'] or '?'}: {r['scenario_name']}  ({r['file_path'].rsplit('/', 1)[-1]}:{r['line_start']})" for r in rows]
        yield f"{len(lines)} scenarios have {query!r}"
        yield from lines


def affected(m: TestMap, target: str, value: str) -> Iterator[str]:
    yield label(m, target, value)
    got = graph.impact(m, target, value)
    n = got.summary.first()
    if not n["scenarios"]:
        yield "No scenario is affected, as far as the map's edges tell."
        return
    yield f"{n['definitions']} step definitions, {n['scenarios']} scenarios, {n['features']} features"
    feature = None
    for r in got.scenarios.orderBy("feature", "scenario", "scenario_id").limit(SCENARIOS).collect():
        if r["feature"] != feature:
            feature = r["feature"]
            yield feature
        yield f"  {r['scenario']}  by " + ", ".join(f'"{v}"' for v in r["via"].split(" | "))
    yield from more(SCENARIOS, n["scenarios"], "scenarios")
