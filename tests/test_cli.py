"""The command line: options, exit codes, how a map is found, what is printed, reports and differences."""

import html
import json

import pytest
from pyspark.sql import functions as F

from stepweave import __main__ as cli
from stepweave.functions.options import ClassifierOptions, read_config
from stepweave.operators import compare
from stepweave.report import overview, write_overview
from stepweave.sources import csharp, store

from test_solution import FILES


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """A solution, indexed by the command line into a map of the usual name."""
    root = tmp_path_factory.mktemp("cli")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "stepweave.json").write_text(json.dumps({"exclude": ["Api*"], "classifier": {"ui_markers": ["HomePage"], "api_suffixes": []}}))
    with pytest.MonkeyPatch.context() as m:
        m.chdir(root)
        assert cli.main(["index", "--quiet"]) == cli.SUCCESS
    return root


@pytest.fixture
def call(place, monkeypatch, capsys):
    monkeypatch.chdir(place)
    monkeypatch.delenv(cli.VARIABLE, raising=False)

    def run(*words):
        code = cli.main(list(words))
        said = capsys.readouterr()
        return code, said.out, said.err

    return run


@pytest.mark.parametrize("words", [["index", "--colour"], ["index", "a", "b", "c"], ["index", "--verbose", "--quiet"], ["index", "--output"], ["stats", "--js"], ["impact"], ["impact", "--class", "A", "--step", "b"], ["impact", "m", "thing", "x"], ["nothing"], [], ["index", "--config", "none.json"]])
def test_bad_arguments(call, words):
    code, out, err = call(*words)
    assert code == cli.BAD_ARGUMENTS and err.startswith("stepweave: ") and not out


def test_a_map_is_found_by_argument_variable_or_name(call, place, monkeypatch, tmp_path):
    assert call("validate")[:2] == (cli.SUCCESS, "stepweave-map: valid, schema version 5\n")
    monkeypatch.setenv(cli.VARIABLE, str(tmp_path))
    assert call("validate")[0] == cli.FATAL and call("validate", "stepweave-map")[0] == cli.SUCCESS
    monkeypatch.delenv(cli.VARIABLE)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["validate"]) == cli.BAD_ARGUMENTS


def test_tables_for_people(call):
    code, out, _ = call("stats")
    assert code == cli.SUCCESS and "Web.Tests" in out and "page_object" in out and "steps: 3 bound, 1 of them ambiguous, 1 unbound" in out
    code, out, _ = call("search", "home page")
    assert code == cli.SUCCESS and out.startswith("2 step definitions have 'home page'\n  [Given] the home page is") and "scenarios have" in out
    assert "step definitions" not in call("search", "--scenarios", "stepweave-map", "log in")[1]
    code, out, _ = call("impact", "--class", "Base")
    assert code == cli.SUCCESS and out.startswith("class Base (page_object, 1 derived)\n") and "  Log in  by " in out
    assert "No scenario" in call("impact", "--step", "no such step")[1]
    assert json.loads(call("impact", "--json", "stepweave-map", "class", "Base")[1])["found"] is True
    assert call("age", "stepweave-map", ".")[0] == cli.SUCCESS
    code, out, _ = call("age", "stepweave-map", "nowhere")
    assert code == cli.SUCCESS and "made elsewhere" in out


def test_a_configuration_changes_what_is_indexed(call, spark):
    code, out, err = call("index", "--config", "stepweave.json", "-o", "other", "--verbose")
    assert code == cli.WARNINGS and "reading" in err and "commit 1" in out  # a project is left out
    m = store.load(spark, "other")
    assert [r["name"] for r in m.projects.collect()] == ["Web.Tests"]
    assert "HomePage" not in {r["name"] for r in m.classes.where("kind = 'page_object'").collect()}
    code, out, _ = call("diff", "stepweave-map", "other")
    assert code == cli.WARNINGS and any(x.startswith("- project|") and "Api.Tests" in x for x in out.splitlines())
    assert call("diff", "other", "other")[:2] == (cli.SUCCESS, "")


def test_options():
    options, include, exclude = read_config('{"include": ["a*"], "classifier": {"ui_markers": ["Canvas"], "ui_suffixes": ["View", "V+"]}}')
    assert (include, exclude, options.api_markers) == (["a*"], [], ClassifierOptions().api_markers) and options.ending("ui_suffixes") == r"(?:View|V\+)$"
    for wrong in ("[", "[]", '{"exlude": []}', '{"classifier": {"ui": []}}', '{"include": "a"}', '{"classifier": {"ui_markers": [1]}}'):
        with pytest.raises(ValueError, match="configuration"):
            read_config(wrong)
    source = "class Board { Canvas c; void Draw(Canvas x) { } }"
    facts = lambda o: csharp.scan(source, o)[0][0].facts["ui_referencing_members"]
    assert facts(ClassifierOptions()) == 0 and facts(options) == 2


def test_a_target_that_cannot_be_written(call, place):
    (place / "blocked").write_text("a file, not a folder")
    code, _, err = call("index", "-o", "blocked")
    assert code == cli.FATAL and "as it was" in err and (place / "blocked").read_text() == "a file, not a folder"


def test_the_report_that_tasks_write_is_the_same_text(call, spark, tmp_path):
    m = store.load(spark, "stepweave-map")
    odd = """<a href="x">'&amp;' né</a>"""
    m.scenarios = m.scenarios.withColumn("name", F.concat("name", F.lit(odd)))
    m.scenario_steps = m.scenario_steps.withColumn("text", F.concat("text", F.lit(odd)))
    text = overview(m)
    write_overview(m, str(tmp_path / "r.html"))
    assert (tmp_path / "r.html").read_text(encoding="utf-8") == text and html.escape(odd) in text and odd not in text
    assert text.count("<div data-t=") == 2 and text.endswith("</ul></div></body></html>")
    assert call("report", "stepweave-map", "-o", str(tmp_path / "s.html"))[0] == cli.SUCCESS and (tmp_path / "s.html").exists()


def test_digests_and_differences(spark, call):
    m = store.load(spark, "stepweave-map")
    rows = lambda x: {r["table"]: (r["n"], r["digest"]) for r in compare.digests(x).collect()}
    whole = rows(m)
    dealt = store.load(spark, "stepweave-map")
    dealt.edges, dealt.classes = dealt.edges.repartition(7), dealt.classes.orderBy(F.desc("name"))
    assert rows(dealt) == whole and compare.differences(m, dealt).collect() == []
    dealt.methods = dealt.methods.withColumn("name", F.when(F.col("id") == 2, "Other").otherwise(F.col("name")))
    dealt.edges = dealt.edges.unionByName(dealt.edges.where("edge_kind = 'inherits'"))
    changed = rows(dealt)
    assert {t for t in whole if whole[t] != changed[t]} == {"methods", "edges"}
    got = compare.differences(m, dealt).collect()
    assert [(r["table"], r["side"], r["at"]) for r in got if r["table"] == "methods"] in ([("methods", "-", 2), ("methods", "+", 2)], [("methods", "+", 2), ("methods", "-", 2)])
    assert {r["side"] for r in got if r["table"] == "edges"} == {"+"} and all("inherits" in r["line"] for r in got if r["table"] == "edges")
