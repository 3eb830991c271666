from pyspark.sql import functions as F

from stepweave.functions import expressions as X
from stepweave.operators import classify as C
from stepweave.operators import graph as G
from stepweave.operators import search as S
from stepweave.operators import structural
from stepweave.schema import TABLES, empty
from stepweave.testmap import TestMap


def frame(spark, table, rows):
    names = [f.name for f in TABLES[table]]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table])


# An observatory: drivers with a common base that needs a clock which needs the base, a tower that uses both drivers, two classes of steps.
CLASSES = {21: ("NightSteps", "step_class"), 22: ("DaySteps", "step_class"), 31: ("Axis", "page_object"), 32: ("Mount", "page_object"), 33: ("Dome", "page_object"), 34: ("Clock", "api_client"), 35: ("Tower", "helper")}
METHODS = {41: (21, "Point"), 42: (21, "Shut"), 43: (22, "Tick"), 44: (22, "Climb"), 45: (31, "Turn"), 46: (34, "Read"), 47: (35, "Lift")}
EXPRESSIONS = {51: (41, "the dome is (open|shut)"), 52: (42, "the dome is shut"), 53: (43, "it strikes {int}"), 54: (44, "we climb")}
USES = [(41, 32), (42, 33), (44, 35), (45, 34), (46, 31), (47, 32), (47, 33)]
INHERITS = [(32, 31), (33, 31)]
CALLS = [(43, 71), (46, 72)]
STEPS = {61: (1, "the dome is shut"), 62: (2, "it strikes 9"), 63: (3, "we climb"), 64: (3, "we sleep")}
BINDS = [(61, 51), (61, 52), (62, 53), (63, 54)]
SCENARIOS = {1: 81, 2: 81, 3: 82}


def observatory(spark):
    place = {"file_path": "o.cs", "line_start": 1, "line_end": 2, "project_id": 9}
    t = {n: empty(spark, n) for n in TABLES}
    t["classes"] = frame(spark, "classes", [{"id": i, "name": n, "namespace": "", "kind": k, **place} for i, (n, k) in CLASSES.items()])
    t["methods"] = frame(spark, "methods", [{"id": i, "class_id": c, "name": n, "signature": n, "visibility": "public", "kind": "other", **place} for i, (c, n) in METHODS.items()])
    t["step_definitions"] = frame(spark, "step_definitions", [{"id": i, "method_id": m, "class_id": METHODS[m][0], "keyword": "When", "expression": e, "expression_kind": "regex", **place} for i, (m, e) in EXPRESSIONS.items()])
    t["features"] = frame(spark, "features", [{"id": i, "project_id": 9, "name": n, "file_path": "o.feature"} for i, n in ((81, "Night"), (82, "Day"))])
    t["scenarios"] = frame(spark, "scenarios", [{"id": i, "feature_id": f, "name": f"Watch {i}", "kind": "scenario", "example_row_count": 0, **place} for i, f in SCENARIOS.items()])
    t["scenario_steps"] = frame(spark, "scenario_steps", [{"id": i, "scenario_id": c, "keyword": "When", "text": x, "ordinal": i, "has_docstring": False, "has_table": False, **place} for i, (c, x) in STEPS.items()])
    t["endpoints"] = frame(spark, "endpoints", [{"id": 71, "verb": "POST", "route": "/bell"}, {"id": 72, "verb": "GET", "route": "/time"}])
    e = [("scenario_step", a, "step_definition", b, "binds_to", "ambiguous" if a == 61 else "exact") for a, b in BINDS] + [("scenario_step", 64, "step_definition", None, "unbound", "")]
    e += [("method", a, "class", b, "uses_type", "exact") for a, b in USES] + [("class", a, "class", b, "inherits", "exact") for a, b in INHERITS] + [("method", a, "endpoint", b, "calls_endpoint", "") for a, b in CALLS]
    t["edges"] = spark.createDataFrame(e, TABLES["edges"])
    return TestMap(**t)


def followed(start, ways):
    seen = set(start)
    while more := {b for a, b in ways if a in seen} - seen:
        seen |= more
    return seen


def affected(classes=(), family=True, methods=(), definitions=(), endpoints=()):
    """Definitions by the rules of impact, from the lists above."""
    derived = [(b, a) for a, b in INHERITS]
    ways = derived + [(c, METHODS[m][0]) for m, c in USES]
    out = set(definitions) | {d for d, (m, _) in EXPRESSIONS.items() if m in methods}
    own = followed(classes, derived) if family else set()
    reach = followed(own | {METHODS[m][0] for m, e in CALLS if e in endpoints}, ways)
    out |= {d for d, (m, _) in EXPRESSIONS.items() if METHODS[m][0] in own or (m, True) in {(u, c in reach) for u, c in USES}}
    return out | {d for d, (m, _) in EXPRESSIONS.items() if any((m, e) in CALLS for e in endpoints)}


TARGETS = [("class", n.swapcase(), affected(classes=[i])) for i, (n, _) in CLASSES.items()]
TARGETS += [("method", n.upper(), affected(methods=[i])) for i, (_, n) in METHODS.items()]
TARGETS += [("step", "DOME is", affected(definitions=[51, 52])), ("step", "strike", affected(definitions=[53])), ("step", "sleep", set())]
TARGETS += [("endpoint", "/BELL", affected(endpoints=[71])), ("endpoint", "/", affected(endpoints=[71, 72])), ("endpoint", "/time", affected(endpoints=[72])), ("class", "Moon", set())]


def test_impact_of_every_target(spark):
    m = observatory(spark)
    assert {len(d) for _, _, d in TARGETS} >= {0, 1, 2, 3}
    for target, value, defs in TARGETS:
        assert {r["step_definition_id"] for r in G.affected_definitions(m, target, value).collect()} == defs, (target, value)
    hit = G.impact(m, "class", "clock")
    assert {(r["scenario_id"], r["feature"], r["via"]) for r in hit.scenarios.collect()} == {(1, "Night", "the dome is shut"), (3, "Day", "we climb")}
    assert hit.summary.first().asDict() == {"definitions": 3, "scenarios": 2, "features": 2, "found": True}
    assert G.impact(m, "class", "Moon").summary.first()["found"] is False
    ranked = {r["endpoint_id"]: (r["call_sites"], r["scenarios"]) for r in G.endpoint_ranking(m).collect()}
    assert ranked == {71: (1, 1), 72: (1, 2)}


def test_closures_agree_on_cycles(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 1), (1, 5), (2, 9)], "seed long, node long")
    small = {tuple(r) for r in G.closure(seeds, edges).collect()}
    monkeypatch.setattr(G, "SMALL_GRAPH", 1)
    assert small == {tuple(r) for r in G.closure(seeds, edges).collect()} == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (1, 6), (2, 9)}


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert [one(X.inferred_verb(lit(n))) for n in ("GetBerthRequest", "CreateBerth", "Getter", "Patch", "Thing")] == ["GET", "POST", "ANY", "PATCH", "ANY"]
    assert one(X.route_like(lit("/p:Letter/x"))) is False and one(X.route_like(lit("a/b"))) is True and one(X.route_like(lit("a/b"), strict=True)) is False
    assert [one(X.expression_kind(lit(e), lit("regex"))) for e in ("a {int}", "a.*", "plain")] == ["cucumber_expression", "regex", "regex"]
    for parts in (["up|down"], ["\\\\d+", "a b|c.d|e-f"], ["x|(y)"], ["[a-z]", "?:on", "left|right|"], []):
        p = one(X.placeholders(lit("turn " + " to ".join(f"({x})" for x in parts)), lit("regex")))
        flat = [x.removeprefix("?:") for x in parts if "(" not in x] + ["y" for x in parts if "(" in x]
        listed = [set(x) <= set("abcdefghijklmnopqrstuvwxyz .-|") and "|" in x and all(x.split("|")) for x in flat]
        assert [(r["kind"], r["type"], r["pattern"]) for r in p] == [("enum", x, None) if e else ("free", None, f"({x})") for x, e in zip(flat, listed, strict=True)]
    for kinds in (["float"], ["", "word", "colour"], []):
        assert [r["type"] for r in one(X.placeholders(lit(" by ".join(f"{{{k}}}" for k in kinds) + " (s)"), lit("cucumber_expression")))] == [k or "any" for k in kinds]
    hit = lambda n, inc, exc: one(X.glob_filter(lit(n), lit("src/" + n), inc, exc))
    assert hit("Web.Tests", ["*.tests"], []) and hit("Web.Tests", ["src/*"], []) and not hit("Web.Tests", ["src"], []) and not hit("Web.Tests", [], ["web*"])
    for words in (["Öl", "m-3"], ["--", "a.b_c"], ['"x', '"'], []):
        want = [" ".join("".join(c if c.isalnum() else " " for c in w.replace("Ö", "o").lower()).split()) for w in words]
        assert X.search_phrases("  ".join(words)) == [w for w in want if w]
    assert (X.clamp_limit(None, 50), X.clamp_limit(0, 50), X.clamp_limit(999, 50)) == (50, 1, 200)


def test_search_needs_a_phrase_in_one_column(spark):
    cells = ["", "tide", "low tide", "tide-low", "Low, TIDE low", "below tide"]
    rows = [(10 * i + k, x, y) for i, x in enumerate(cells) for k, y in enumerate(cells)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    parts = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    held = lambda t, phrase: any(parts(t)[k : k + len(phrase)] == phrase for k in range(len(parts(t))))
    for query in ("tide", "LOW-tide", "tide/low low", "tide low", "low-tide-low", "?"):
        phrases = [parts(w) for w in query.split() if parts(w)]
        want = {i for i, x, y in rows if phrases and all(held(x, p) or held(y, p) for p in phrases)}
        assert {r["id"] for r in S.search(df, ["a", "b"], query).collect()} == want, query


def facts(spark, *rows):
    base = dict(id=0, name="X", base_type_name=None, step_method_count=0, test_method_count=0, hook_method_count=0, method_count=1, instance_member_count=1, ui_referencing_members=0, api_referencing_members=0,
                references_ui_type=False, references_api_type=False, holds_or_constructs_api_marker=False, has_test_class_attribute=False, is_static=False, constructed_type_names=[])
    schema = ", ".join(f"{k} {'string' if k in ('name', 'base_type_name') else 'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'long'}" for k, v in base.items())
    return spark.createDataFrame([tuple((base | {"id": i} | r).values()) for i, r in enumerate(rows)], schema)


def test_classification_reaches_a_fixpoint(spark):
    rows = [
        {"name": "Steps", "step_method_count": 1, "ui_referencing_members": 1},
        {"name": "BasePage", "ui_referencing_members": 1},
        {"name": "TicketPage", "base_type_name": "BasePage"},
        {"name": "RefundPage", "base_type_name": "TicketPage"},
        {"name": "BaseRequest", "holds_or_constructs_api_marker": True},
        {"name": "BerthService", "constructed_type_names": ["BaseRequest"]},
        {"name": "FareMath", "constructed_type_names": ["BaseRequest"]},
        {"name": "UiHelper", "is_static": True, "ui_referencing_members": 1},
        {"name": "T", "test_method_count": 1}, {"name": "H", "hook_method_count": 1},
    ]
    got = {r["name"]: r["kind"] for r in C.classify(facts(spark, *rows)).collect()}
    assert got == {"Steps": "step_class", "BasePage": "page_object", "TicketPage": "page_object", "RefundPage": "page_object", "BaseRequest": "api_client", "BerthService": "api_client", "FareMath": "other", "UiHelper": "other", "T": "test_class", "H": "hook_class"}


def test_diagnostics(spark):
    d = lambda m, loaded: tuple(spark.range(1).select(C.diagnostic_of(F.lit(m), F.lit(loaded)).alias("d")).first()["d"])
    assert d("Unable to find package A", True) == ("warning", "nuget_missing_package")
    assert d("'x.csproj' could not be loaded", True) == ("error", "project_load_failed")
    assert d("whatever", False) == ("error", "workspace_load")
    assert (C.outcome(0, 0), C.outcome(2, 1), C.outcome(2, 0)) == ("fatal", "warnings", "success")


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in "hgfedcba"], "name string")
    assert [(r["name"], r["id"]) for r in structural.numbered(df, [F.col("name")]).orderBy("id").collect()] == [(x, k + 1) for k, x in enumerate("abcdefgh")]


def test_uses_by_name_list_edges_without_sorting_them(spark, monkeypatch):
    from stepweave.operators import structural

    classes = [(k, f"n{k % 3}", "page_object" if k % 4 else "other") for k in range(40)] + [(5, "n0", "page_object"), (7, "n7", "api_client")]
    methods = [(100 + k, k % 40, [f"n{k % 3}", "n7", "n7", "none"][: 1 + k % 4]) for k in range(50)] + [(200, 2, None), (201, 2, [])]
    t = {(i, n) for i, n, kind in classes if kind != "other"}
    want = {}
    for m, own, names in methods:
        for n in set(names or ()):
            hit = {i for i, x in t if x == n and i != own}
            for i in hit:
                want[m, i] = want.get((m, i), False) or len(hit) > 1
    want = sorted((m, i, "ambiguous" if u else "exact") for (m, i), u in want.items())
    m, c = spark.createDataFrame(methods, "id long, class_id long, names array<string>"), spark.createDataFrame(classes, "id long, name string, kind string")
    out = structural.uses(m, c)
    assert sorted(map(tuple, out.collect())) == want and "ambiguous" in {w[2] for w in want} and "exact" in {w[2] for w in want}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(structural, "FEW_TARGETS", 1)
    assert sorted(map(tuple, structural.uses(m, c).collect())) == want
