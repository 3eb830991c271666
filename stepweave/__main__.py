"""Command line: index, stats, search, impact, validate, dump, diff, age, report, map, serve, collect.

A map that isn't named is the one that the variable STEPWEAVE_MAP names, else the folder stepweave-map or test-map here.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

#: Exit codes.
SUCCESS, WARNINGS, FATAL, BAD_ARGUMENTS = 0, 1, 2, 3
VARIABLE, NAMES = "STEPWEAVE_MAP", ("stepweave-map", "test-map")
TARGETS = ("class", "method", "step", "endpoint")


class Arguments(Exception):
    """Arguments that don't make a call."""


class Parser(argparse.ArgumentParser):
    def error(self, message):
        raise Arguments(message)


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("stepweave").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def find_map(named: str | None) -> str:
    """The map meant by an argument, the variable or a folder of a usual name."""
    if path := named or os.environ.get(VARIABLE):
        return path
    for name in NAMES:
        if os.path.isdir(name):
            return name
    raise Arguments(f"name a map, set {VARIABLE}, or have a folder {' or '.join(NAMES)} here")


def parser() -> Parser:
    p = Parser(prog="stepweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True, parser_class=Parser)

    def add(name: str, *words: tuple[str, str], map_: bool = True) -> argparse.ArgumentParser:
        s = sub.add_parser(name, allow_abbrev=False)
        if map_:
            s.add_argument("map", nargs="?")
        for word, many in words:
            s.add_argument(word, nargs=many or None)
        return s

    s = add("index", ("solution", "?"), ("output_map", "?"), map_=False)
    s.add_argument("-o", "--output")
    s.add_argument("--config")
    s.add_argument("--dialects", help="JSON of Gherkin keywords by language")
    s.add_argument("--include", action="append", default=[])
    s.add_argument("--exclude", action="append", default=[])
    loud = s.add_mutually_exclusive_group()
    loud.add_argument("--verbose", action="store_true")
    loud.add_argument("--quiet", action="store_true")
    add("stats").add_argument("--json", action="store_true")
    s = add("search", ("words", "+"), map_=False)
    for option in ("--steps", "--scenarios", "--json"):
        s.add_argument(option, action="store_true")
    s = add("impact", ("words", "*"), map_=False)
    s.add_argument("--json", action="store_true")
    for t in TARGETS:
        s.add_argument(f"--{t}")
    add("validate")
    add("dump")
    add("diff", ("left", ""), ("right", ""), map_=False)
    add("age", ("root", "?"))
    for name in ("report", "map"):
        s = add(name, ("file", "?"))
        s.add_argument("--html", "-o", "--output", dest="html")
    add("serve")
    add("collect").add_argument("--older", type=float, default=24.0, help="hours")
    return p


def impact_of(a: argparse.Namespace) -> tuple[str | None, str, str]:
    """(map, target, value) of `impact [MAP] --class NAME` and the like, or of `impact MAP class NAME`."""
    named = [(t, v) for t in TARGETS if (v := getattr(a, t, None)) is not None]
    if len(named) == 1 and len(a.words) <= 1:
        return (a.words or [None])[0], *named[0]
    if not named and len(a.words) == 3 and a.words[1] in TARGETS:
        return tuple(a.words)
    raise Arguments(f"name one target: {', '.join(f'--{t} VALUE' for t in TARGETS)}")


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
        return _run(a)
    except Arguments as e:
        print(f"stepweave: {e}", file=sys.stderr)
        return BAD_ARGUMENTS


def _index(a: argparse.Namespace) -> int:
    from .functions.options import ClassifierOptions, read_config
    from .sources import store
    from .sources.gherkin import LANGUAGES, read_dialects
    from .sources.solution import index

    options, include, exclude, languages = ClassifierOptions(), [], [], LANGUAGES
    try:
        if a.dialects:
            with open(a.dialects, encoding="utf-8") as f:
                languages = read_dialects(f.read())
        if a.config:
            with open(a.config, encoding="utf-8") as f:
                options, include, exclude = read_config(f.read())
        solution = store.discover(a.solution or ".")
    except (OSError, ValueError) as e:
        raise Arguments(str(e)) from None
    spark, began = session(), time.time()
    say = (lambda text: print(text, file=sys.stderr)) if a.verbose else lambda text: None
    say(f"reading {solution}")
    m, outcome = index(spark, solution, include + a.include, exclude + a.exclude, options=options, languages=languages)
    target = a.output or a.output_map or os.environ.get(VARIABLE) or NAMES[0]
    say(f"writing {target}")
    try:
        commit = store.save(m, target)
    except Exception as e:  # the map that was there stays
        print(f"stepweave: {target} couldn't be written, and is as it was: {str(e)[:500]}\nIs it read-only, or open in another program? Close that, or name another folder with --output.", file=sys.stderr)
        return FATAL
    if not a.quiet:
        from .operators import analytics, binding

        n = {r["entity"]: r["n"] for r in analytics.entity_counts(m).collect()}
        t = binding.binding_tallies(m.edges.withColumnsRenamed({"from_id": "step_id"})).first()
        print(f"{outcome}: " + ", ".join(f"{v} {k.replace('_', ' ')}" for k, v in n.items()) + f"; {t['bound']} steps bound, {t['unbound']} unbound")
        print(f"{target}, commit {commit}, {time.time() - began:.1f} s")
    return {"success": SUCCESS, "warnings": WARNINGS}.get(outcome, FATAL)


def _run(a: argparse.Namespace) -> int:
    from .sources import store

    if a.command == "index":
        return _index(a)
    if a.command == "impact":
        a.map, target, value = impact_of(a)
    if a.command == "search":
        a.map, query = (a.words[0], " ".join(a.words[1:])) if len(a.words) > 1 else (None, a.words[0])
    spark = session()
    paths = [a.left, a.right] if a.command == "diff" else [find_map(a.map)]
    versions = [store.validate(p, spark) for p in paths]
    for path, (_, wrong) in zip(paths, versions, strict=True):
        if wrong:
            print(f"{path}: {wrong}", file=sys.stdout if a.command == "validate" else sys.stderr)
            return FATAL
    if a.command == "validate":
        print(f"{paths[0]}: valid, schema version {versions[0][0]}")
        return SUCCESS
    if a.command == "collect":
        print(f"{store.collect_versions(paths[0], spark, a.older * 3600)} versions removed")
        return SUCCESS
    maps = [store.load(spark, p) for p in paths]
    return _read(a, maps, paths, versions[0][0], (target, value) if a.command == "impact" else query if a.command == "search" else None)


def _read(a: argparse.Namespace, maps: list, paths: list[str], version: int, asked) -> int:
    from . import console
    from .serve import Server, run

    m = maps[0]
    if a.command == "serve":
        run(m)
    elif a.command == "dump":
        from .operators.analytics import map_dump

        for row in map_dump(m).toLocalIterator():
            print(row["line"])
    elif a.command == "diff":  # 0 the same, 1 not
        from .operators import compare

        n = 0
        for r in compare.differences(*maps).orderBy("table", "at", "side", "line").toLocalIterator():
            n += 1
            print(f"{r['side']} {r['line']}")
        return WARNINGS if n else SUCCESS
    elif a.command == "age":
        return _age(m, a.root)
    elif a.command in ("report", "map"):
        from .report import project_map, write_overview

        target = a.html or a.file or f"{paths[0].rstrip('/')}{'' if a.command == 'report' else '-projects'}.html"
        if a.command == "report":
            write_overview(m, target)
        else:
            with open(target, "w", encoding="utf-8") as f:
                f.write(project_map(m))
        print(target)
    elif getattr(a, "json", False):
        name, args = {"stats": ("stats", {}), "impact": ("impact", dict(zip(("target", "value"), asked or (), strict=False))), "search": ("search_scenarios" if getattr(a, "scenarios", False) else "search_steps", {"query": asked})}[a.command]
        print(json.dumps(Server(m).call(name, args), indent=2, ensure_ascii=False))
    else:
        both = a.command == "search" and a.steps == a.scenarios
        lines = {"stats": lambda: console.stats(m, paths[0], version), "impact": lambda: console.affected(m, *asked), "search": lambda: console.found(m, asked, a.steps or both, a.scenarios or both)}
        for line in lines[a.command]():
            print(line)
    return SUCCESS


def _age(m, root: str | None) -> int:
    """0 fresh or not to be told, 1 stale."""
    from .sources.solution import stale_files

    made = m.meta.where("key = 'generated_utc'").first()
    if not made:
        print("made at an unknown time")
        return SUCCESS
    named = m.meta.where("key = 'solution_path'").first()
    root = root or "."
    if not os.path.isdir(root) or (root == "." and named and not os.path.exists(os.path.basename(named["value"]))):
        print(f"made {made['value']} of {named['value'] if named else 'an unknown solution'}, which isn't in {root}: the map was made elsewhere, so its age can't be told")
        return SUCCESS
    newer = stale_files(m.meta.sparkSession, root, made["value"]).collect()
    print(f"{'stale' if newer else 'fresh'}, made {made['value']}", *[f"  {r['modified']:%Y-%m-%dT%H:%M:%S}  {r['path']}" for r in newer], sep="\n")
    return WARNINGS if newer else SUCCESS


if __name__ == "__main__":
    sys.exit(main())
