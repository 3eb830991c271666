import json
import os

import pytest

from stepweave.operators import graph
from stepweave.report import overview, project_map
from stepweave.serve import Server
from stepweave.sources import csharp, gherkin, store
from stepweave.sources.solution import index

PROJECT = '<Project Sdk="x"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup>{}</ItemGroup></Project>'
FILES = {
    "Shop.sln": 'Project("{9A19103F}") = "Web.Tests", "Web\\Web.Tests.csproj", "{1}"\nEndProject\nProject("{9A19103F}") = "Api.Tests", "Api\\Api.Tests.csproj", "{2}"\nEndProject\n',
    "Web/Web.Tests.csproj": PROJECT.format('<ProjectReference Include="..\\Api\\Api.Tests.csproj" />'),
    "Api/Api.Tests.csproj": PROJECT.format(""),
    "Web/Pages.cs": """namespace Web;
public abstract class Base { protected IWebDriver Driver; public void Go() { } }
public class HomePage : Base { private By _title; public IWebElement Title => Driver.FindElement(_title); public void Open() { } }
public class UnusedPage { private readonly IPage _page = null; }
""",
    "Web/Steps.cs": '''using TechTalk.SpecFlow;
namespace Web {
  [Binding]
  public class HomeSteps {
    private readonly HomePage _home = new HomePage();
    [Given(@"the home page is (open|closed)")]
    public void Home(string state) { _home.Open(); }
    [Given(@"the home page is open")]
    public void HomeOpen() { }
    [When(@"I log in as ""(.*)""")] [StepDefinition("I sign in")]
    public void LogIn(string name) => _home.Open();
  }
}
''',
    "Web/obj/Made.cs": "class Made { void X() { } }",
    "Web/Features/Home.feature": '@web\nFeature: Home\n  About it\n\n  Background:\n    Given something\n\n  @fast @web\n  Scenario: Log in\n    Given the home page is open\n    When I log in as "Ann"\n    And pigs fly\n      """\n      | x |\n      """\n\n  Rule: r\n    Scenario Outline: Order\n      Given a cart with <n> items\n        | a | b |\n\n      Examples:\n        | n |\n        | 1 |\n        | 2 |\n',
    "Web/Features/Bad.feature": "this is no feature\n",
    "Api/Steps.cs": """using Reqnroll;
namespace Api;
[Binding]
public class CartSteps {
  private readonly HttpClient _http = new HttpClient();
  [Given("a cart with {int} item(s)")] public async Task Cart(int n) { await _http.PostAsync($"/api/carts/{n}", null); new Call<GetCart>().Run(); }
  [Given("a cart with <n> items")] public void Raw() { }
}
public class Call<T> { private readonly IRestClient _c; public string Run() => _c.ToString(); }
public class GetCart { public string ServiceName { get { return "api/carts/{0}"; } } public Method Method => Method.GET; public string TargetAPI { get => "Carts"; } }
""",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, text in FILES.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    m, outcome = index(spark, str(root / "Shop.sln"), messages=["'C:\\x\\Web.Tests.csproj' has a known high severity vulnerability"], now="2024-01-01T00:00:00Z")
    path = str(tmp_path_factory.mktemp("maps") / "shop")
    store.save(m, path)
    return store.load(spark, path), outcome, path, root


def test_tables(shop):
    m, outcome, path, _ = shop
    assert outcome == "success" and store.validate(path) == (5, "")
    kinds = {r["name"]: r["kind"] for r in m.classes.collect()}
    assert kinds == {"Base": "page_object", "HomePage": "page_object", "UnusedPage": "page_object", "HomeSteps": "step_class", "CartSteps": "step_class", "Call": "api_client", "GetCart": "other"}
    assert {(r["name"], r["kind"], r["target_framework"]) for r in m.projects.collect()} == {("Api.Tests", "bdd_tests", "net8.0"), ("Web.Tests", "bdd_tests", "net8.0")}
    assert {(r["keyword"], r["expression"], r["expression_kind"]) for r in m.step_definitions.where("keyword <> 'Given'").collect()} == {("When", 'I log in as "(.*)"', "regex"), ("StepDefinition", "I sign in", "regex")}
    scenarios = {r["name"]: r for r in m.scenarios.collect()}
    assert scenarios["Log in"]["tags"] == "@web @fast @web" and scenarios["Order"]["kind"] == "scenario_outline" and scenarios["Order"]["example_row_count"] == 2
    steps = {r["text"]: r for r in m.scenario_steps.collect()}
    assert len(steps) == 4 and steps["pigs fly"]["has_docstring"] and steps["a cart with <n> items"]["has_table"]
    assert {(r["verb"], r["route"], r["path"], r["target_api"]) for r in m.endpoints.collect()} == {("POST", "/api/carts/{n}", None, None), ("GET", "GetCart", "api/carts/{0}", "Carts")}
    assert {(r["severity"], r["code"]) for r in m.diagnostics.collect()} == {("warning", "feature_parse_error"), ("warning", "nuget_vulnerability")}
    edges = {r["edge_kind"]: r["count"] for r in m.edges.groupBy("edge_kind").count().collect()}
    assert edges == {"binds_to": 4, "unbound": 1, "inherits": 1, "uses_type": 3, "holds": 1, "references": 1, "calls_endpoint": 2}
    meta = {r["key"]: r["value"] for r in m.meta.collect()}
    assert meta["generated_utc"] == "2024-01-01T00:00:00Z" and len(meta["input_hash"]) == 64


def test_dump_is_canonical(shop):
    from stepweave.operators.analytics import map_dump

    m = shop[0]
    lines = [r["line"] for r in map_dump(m).collect()]
    assert lines[0] == "user_version=5" and not any(x.startswith("meta:generated_utc") for x in lines)
    assert [x for x in lines if x.startswith("project|")] == sorted(x for x in lines if x.startswith("project|"))
    assert len(lines) == 1 + m.meta.count() - 1 + sum(df.count() for n, df in m.tables().items() if n != "meta")


def test_staleness(spark, shop, tmp_path):
    from stepweave.sources.solution import stale_files

    for name in ("a.cs", "b.feature.cs", "c.generated.cs", "d.AssemblyAttributes.cs", "obj/e.cs", "other/f.cs", "other/Other.sln", "g.g.i.cs"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {r["path"] for r in stale_files(spark, str(tmp_path), "2020-01-01T00:00:00Z").collect()} == {"a.cs", "g.g.i.cs"}
    assert stale_files(spark, str(tmp_path), "2999-01-01T00:00:00Z").count() == 0


def test_impact(shop):
    m = shop[0]
    names = lambda *a: {r["scenario"] for r in graph.impact(m, *a).scenarios.collect()}
    assert names("class", "Base") == {"Log in"} and names("endpoint", "/api/carts") == set() and names("step", "cart with") == {"Order"}


def test_server(shop):
    s = Server(shop[0])
    call = lambda tool, **a: json.loads(json.loads(s.handle(json.dumps({"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": tool, "arguments": a}})))["result"]["content"][0]["text"])
    assert call("stats")["classes"] == 7
    assert call("impact", target="class", value="Base")["target"] == "class Base (page_object, 1 derived)"
    assert call("impact", target="class", value="Nope")["found"] is False and "error" in call("impact", target="x", value="y")
    assert call("resolve_step", text="the home page is open")["status"] == "ambiguous"
    assert call("resolve_step", text='I log in as "Bob"')["matches"][0]["captures"] == ["Bob"]
    near = call("resolve_step", text="the cart page")
    assert near["status"] == "none" and near["suggestions"]
    assert call("search_steps", query="home page")["count"] == 2 and call("search_scenarios", query="log")["hits"][0]["scenario"] == "Log in"
    assert call("get_scenario", name="order")["scenarios"][0]["steps"] == ["Given a cart with <n> items"]
    assert call("get_step_definition", query="log in")["stepDefinitions"][0]["usedByScenarios"] == ["Log in"]
    assert {"tag": "@web", "count": 3} in call("list_tags")["tags"]
    assert {"kind": "enum", "values": ["open", "closed"]} in call("step_catalog", query="home")["steps"][0]["placeholders"] + call("step_catalog", query="home")["steps"][1]["placeholders"]
    assert call("list_endpoints")["total"] == 2
    assert call("project_dependencies", project="web")["projects"][0]["dependsOn"][0]["project"] == "Api.Tests"
    code = lambda text: json.loads(s.handle(text))["error"]["code"]
    assert [code("{"), code('{"id":1,"method":"x"}'), code('{"id":1,"method":"tools/call","params":{"name":"x"}}')] == [-32700, -32601, -32602]
    assert s.handle('{"method":"ping"}') is None and json.loads(s.handle('{"id":"a","method":"ping"}'))["id"] == "a"


def test_reports_escape(shop):
    m = shop[0]
    page = overview(m)
    assert "75 %" in page and "a cart with &lt;n&gt; items" in page and "UnusedPage" in page
    assert project_map(m).count("<circle") == 2


def test_partial_and_missing_input(spark, shop, tmp_path):
    root = shop[3]
    m, outcome = index(spark, str(root / "Shop.sln"), exclude=["Api*"])
    assert outcome == "warnings" and m.diagnostics.where("code = 'project_not_loaded'").count() == 1 and m.projects.count() == 1
    m, outcome = index(spark, str(root / "None.sln"))
    assert outcome == "fatal" and m.diagnostics.first()["code"] == "open_failed"
    assert store.validate(str(tmp_path))[1] and store.discover(str(root)).endswith("Shop.sln")
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path))


def test_sqlite_import_of_an_older_map(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "old.db")
    con.executescript("""create table meta (key text, value text); insert into meta values ('tool_version', '1');
      create table projects (id integer, name text, path text, target_framework text, kind text); insert into projects values (1, 'P', 'p', null, 'other');
      create table classes (id integer, project_id integer, name text, namespace text, base_type text, kind text, file_path text, line_start integer, line_end integer);
      create table methods (id integer, class_id integer, project_id integer, name text, signature text, visibility text, kind text, file_path text, line_start integer, line_end integer);
      create table endpoints (id integer, verb text, route text); insert into endpoints values (1, 'GET', '/a');
      create table edges (from_kind text, from_id integer, to_kind text, to_id integer, edge_kind text, confidence text);
      create table diagnostics (severity text, code text, message text, location text);""")
    con.commit()
    m = store.import_sqlite(spark, str(tmp_path / "old.db"))
    assert m.projects.first()["name"] == "P" and m.endpoints.first()["path"] is None and m.features.count() == 0


# A grid of what is called, how the text is written, and where it stands; what is found follows from the rules of the scan.
CLIENT = [("GetAsync", "GET", False), ("PostAsJsonAsync", "POST", False), ("PutAsync", "PUT", False), ("DeleteAsync", "DELETE", False), ("Get", "GET", True), ("PatchMany", "PATCH", True), ("Getaway", None, True), ("Forget", None, True), ("Print", None, True)]
TEXTS = ["/quay/7", "quay/list", "quay", "two words/x", "//quay", "/quay()", "/a:Quay/b", "https://h/quay", "quay/{id}", ""]
WRITTEN = {"plain": '"{}"', "verbatim": '@"{}"', "named": "Named"}


def looks_like_a_route(text, strict):
    after_scheme = text.replace("://", "")
    name_step = any(a and a[0].isalpha() and a.replace("_", "").isalnum() and b[:1].isalpha() for a, _, b in (part.partition(":") for part in after_scheme.split("/")[1:]))
    ok = bool(text) and not any(c.isspace() for c in text) and "/" in text and text[:2] != "//" and "()" not in text and not name_step
    return ok and (not strict or text[0] == "/" or "://" in text or "/{" in text)


def grid():
    for name, verb, strict in CLIENT:
        for text in TEXTS:
            for form in WRITTEN.values():
                found = [(verb, text)] if verb and looks_like_a_route(text, strict) else []
                yield f"dock.{name}({form.format(text)}, load);", text, found
                yield f"dock.{name}(load, {form.format(text)});", text, []  # the first argument is the route
        yield f"dock.{name}();", "", []
    for text in TEXTS:
        for member in ("Put", "Head"):  # a verb among the arguments: the route may be any of them
            found = [(member.upper(), text)] if looks_like_a_route(text, False) else []
            yield f'dock.Send(HttpMethod.{member}, "{text}");', text, found
            yield f'dock.Send("{text}", load, HttpMethod.{member});', text, found
            yield f'new RestRequest("{text}", Method.{member});', text, found
        yield f'new RestRequest("{text}");', text, [("GET", text)] if looks_like_a_route(text, False) else []
        yield f'call.Resource = "{text}";', text, [("ANY", text)] if looks_like_a_route(text, False) else []


def test_endpoint_calls():
    for body, text, want in grid():
        types, _ = csharp.scan(f'class C {{ const string Named = "{text}"; void M() {{ {body} }} }}')
        assert types[0].methods[0].calls == want, (body, text)
    interpolated, _ = csharp.scan('class C { void M(int n) { dock.GetAsync($"/quay/{n}/log"); } }')
    assert interpolated[0].methods[0].calls == [("GET", "/quay/{n}/log")]


def test_gherkin_dialects_and_failures():
    de = gherkin.parse_feature("# language: de\nFunktionalität: Suche\n  Szenario: Eins\n    Angenommen es gibt etwas\n    Und mehr\n")
    assert [s["keyword"] for s in de["scenarios"][0]["steps"]] == ["Angenommen", "Und"]
    assert gherkin.parse_feature("") is None and gherkin.parse_feature("Scenario: x\n Given y") is None and gherkin.parse_feature(None) is None


def test_gherkin_problems_are_told_by_line():
    text = """Scenario: early
Feature: Tides
  About them
  Examples:
    | n |
  Scenario: Low
    Given it ebbs
      | a |
    whatever this is
    Examples:
      | n |
      | 1 |
Feature: again
  Scenario: High
    Given it flows
"""
    feature, wrong = gherkin.read(text)
    assert [n for n, _ in wrong] == [1, 4, 5, 9, 13] and wrong[4][1] == "a second feature"
    assert [(s["name"], s["kind"], len(s["steps"])) for s in feature["scenarios"]] == [("Low", "scenario_outline", 1), ("High", "scenario", 1)]
    assert gherkin.parse_feature(text) is None and gherkin.problems("Feature: x\n  Scenario: y\n    Given z\n      \"\"\"\n")[0].startswith("line 4:")
    assert gherkin.problems("") == ["line 1: no feature"] and gherkin.problems("# language: xx\nFeature: a") == ["line 1: unknown language xx"]


def test_gherkin_in_dialects_of_a_file():
    own = {"feature": ["Zug", "Zugfahrt"], "scenario": ["Halt"], "scenarioOutline": ["Halte"], "examples": ["Tafel"], "background": ["Depot"], "rule": ["Regel"], "given": ["* ", "Es ", "Es sei "], "when": ["Da "], "then": ["So "], "and": ["Und "], "but": ["Doch "]}
    joined = {**own, "feature": ["機能"], "scenario": ["場合"], "given": ["* ", "前提"]}
    languages = gherkin.read_dialects(json.dumps({"zz": own, "zz-ab": joined}))
    got = gherkin.parse_feature("# language: zz\nZugfahrt: Nord\n  Halte: Ulm\n    Es sei <n> Uhr\n    Es regnet\n    Tafel:\n      | n |\n      | 9 |\n", languages)
    assert got["name"] == "Nord" and got["scenarios"][0]["kind"] == "scenario_outline" and got["scenarios"][0]["example_row_count"] == 1
    assert [(s["keyword"], s["text"]) for s in got["scenarios"][0]["steps"]] == [("Es sei", "<n> Uhr"), ("Es", "regnet")]
    got = gherkin.parse_feature("# language: zz-ab\n機能: 北\n  場合: 一\n    前提雨が降る\n", languages)
    assert [(s["keyword"], s["text"]) for s in got["scenarios"][0]["steps"]] == [("前提", "雨が降る")]
    assert "en" in languages and gherkin.parse_feature("Feature: still", languages)["name"] == "still"


def test_stream_binds_like_a_table(spark, shop, tmp_path):
    from stepweave.operators.binding import compiled
    from stepweave.streaming.binding_stream import watch

    m, _, _, root = shop
    q = watch(spark, str(root / "Web"), compiled(m.step_definitions).select("id", "pattern"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("confidence = ''").count() == 1 and got.where("confidence <> ''").count() == 4
