"""Feature files as nested rows: a line grammar for Gherkin as a table of states.

A few languages are built in; read_dialects() takes all others from a file in the format in which dialects are published. What a line
can't be in its state is told with its number, and reading goes on behind it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

# Keywords by role and language.
LANGUAGES = {
    "en": {"feature": ["Feature", "Business Need", "Ability"], "rule": ["Rule"], "background": ["Background"], "scenario": ["Scenario Outline", "Scenario Template", "Scenario", "Example"], "examples": ["Examples", "Scenarios"], "step": ["Given", "When", "Then", "And", "But", "*"]},
    "de": {"feature": ["Funktionalität", "Funktion"], "rule": ["Rule", "Regel"], "background": ["Grundlage", "Hintergrund", "Voraussetzungen", "Vorbedingungen"], "scenario": ["Szenariogrundriss", "Szenarien", "Szenario", "Beispiel"], "examples": ["Beispiele"], "step": ["Angenommen", "Gegeben seien", "Gegeben sei", "Wenn", "Dann", "Und", "Aber", "*"]},
    "fr": {"feature": ["Fonctionnalité"], "rule": ["Règle"], "background": ["Contexte"], "scenario": ["Plan du scénario", "Plan du Scénario", "Scénario", "Exemple"], "examples": ["Exemples"], "step": ["Étant donné que", "Étant donné", "Soit", "Quand", "Lorsque", "Alors", "Donc", "Et", "Mais", "*"]},
    "es": {"feature": ["Característica", "Necesidad del negocio", "Requisito"], "rule": ["Regla", "Regla de negocio"], "background": ["Antecedentes"], "scenario": ["Esquema del escenario", "Escenario", "Ejemplo"], "examples": ["Ejemplos"], "step": ["Dado", "Dada", "Dados", "Dadas", "Cuando", "Entonces", "Y", "E", "Pero", "*"]},
}

STEP = "struct<keyword:string,text:string,ordinal:int,has_docstring:boolean,has_table:boolean,line:int>"
SCENARIO = f"struct<name:string,kind:string,tags:array<string>,example_row_count:int,line:int,steps:array<{STEP}>>"
FEATURE = f"struct<name:string,description:string,tags:array<string>,scenarios:array<{SCENARIO}>>"


ROLES = ("feature", "rule", "background", "scenario", "examples")
#: What may begin in a state; a feature's description and those of its parts are text.
BEGINS = {
    "top": {"feature"},
    "feature": {"rule", "background", "scenario", "text"},
    "rule": {"rule", "background", "scenario", "text"},
    "background": {"rule", "background", "scenario", "step", "table", "block", "text"},
    "scenario": {"rule", "background", "scenario", "step", "examples", "text"},
    "step": {"rule", "background", "scenario", "step", "examples", "table", "block"},
    "examples": {"rule", "background", "scenario", "examples", "table", "text"},
}


def read_dialects(text: str) -> dict:
    """Languages from JSON: by language, lists of keywords by feature, rule, background, scenario, scenarioOutline, examples, given, when, then, and, but.

    Step keywords end in a blank where one must follow them. The built-in languages that the file lacks stay.
    """
    out = dict(LANGUAGES)
    for name, own in json.loads(text).items():
        get = lambda *keys: [k for key in keys for k in own.get(key, [])]  # noqa: B023, E731
        words = {role: get(role) for role in ROLES if role != "scenario"} | {"scenario": get("scenarioOutline", "scenario")}
        out[name] = words | {"step": list(dict.fromkeys(get("given", "when", "then", "and", "but")))}
    return out


@lru_cache(maxsize=256)
def _lines(words: tuple) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a language's headings and steps. Of keywords that begin alike, the longest is tried first."""
    longest = lambda ks: "|".join(re.escape(k) for k in sorted(ks, key=len, reverse=True)) or "(?!)"
    by_role = dict(words)
    headings = "|".join(f"(?P<{role}>{longest(by_role[role])})" for role in ROLES)
    steps = [k if k.endswith(" ") or not k.isascii() and any(ord(c) > 0x2E7F for c in k) else f"{k} " for k in by_role["step"]]
    return re.compile(f"(?:{headings}):(.*)"), re.compile(f"({longest(steps)})(.*)")


def _language(name: str, languages: dict) -> dict | None:
    return languages.get(name) or languages.get(name.partition("-")[0])


def read(content: str | None, languages: dict = LANGUAGES) -> tuple[dict | None, list[tuple[int, str]]]:
    """(the feature of a file as far as it can be read, what is wrong in which lines).

    Scenarios may stand in rules, whose tags they don't get. Background steps are no scenario. A scenario with examples is an
    outline; rows are counted without their heading.
    """
    pattern = lambda words: _lines(tuple((r, tuple(words[r])) for r in (*ROLES, "step")))
    headings, steps = pattern(languages["en"])
    feature, scenario, state, tags, step = None, None, "top", [], None
    doc, doc_at, header_seen, wrong = "", 0, False, []
    for number, raw in enumerate((content or "").replace("\r\n", "\n").split("\n"), 1):
        line = raw.strip()
        if doc:
            doc = "" if line.startswith(doc) else doc
            continue
        if m := re.match(r"#\s*language\s*:\s*([\w-]+)", line):
            words = _language(m[1], languages)
            if feature is None and words is None:
                wrong.append((number, f"unknown language {m[1]}"))
            elif feature is None:
                headings, steps = pattern(words)
            continue
        if not line or line.startswith("#"):
            continue
        if line.startswith("@"):
            tags += re.findall(r"@[^\s@#]+", line.split(" #")[0])
            continue
        m = headings.match(line)
        s = None if m else steps.match(f"{line} ")
        what = next(r for r in ROLES if m[r]) if m else "block" if line.startswith(('"""', "```")) else "table" if line.startswith("|") else "step" if s and state in ("background", "scenario", "step") else "text"
        if what not in BEGINS[state]:
            wrong.append((number, "a second feature" if what == "feature" else f"{what} in a place for {', '.join(sorted(BEGINS[state]))}"))
            if what == "block":
                doc, doc_at = line[:3], number
            continue
        if m:
            name = m[len(ROLES) + 1].strip()
        if what == "feature":
            feature, state, tags = {"name": name, "description": "", "tags": tags, "scenarios": []}, "feature", []
        elif what in ("rule", "background"):
            state, scenario, step, tags = what, None, None, []
        elif what == "scenario":
            scenario = {"name": name, "kind": "scenario", "tags": tags, "example_row_count": 0, "line": number, "steps": []}
            feature["scenarios"].append(scenario)
            state, tags, step = "scenario", [], None
        elif what == "examples":
            scenario["kind"], state, tags, header_seen = "scenario_outline", "examples", [], False
        elif what == "block":
            doc, doc_at = line[:3], number
            if step:
                step["has_docstring"] = True
        elif what == "table" and state == "examples":
            scenario["example_row_count"] += header_seen
            header_seen = True
        elif what == "table" and step:
            step["has_table"] = True
        elif what == "step" and state != "background":
            step = {"keyword": s[1].strip(), "text": s[2].strip(), "ordinal": len(scenario["steps"]), "has_docstring": False, "has_table": False, "line": number}
            scenario["steps"].append(step)
            state = "step"
        elif what == "text" and state == "feature":
            feature["description"] += ("\n" if feature["description"] else "") + line
    if doc:
        wrong.append((doc_at, "a text block without an end"))
    if feature is None and not wrong:
        wrong.append((1, "no feature"))
    return feature, wrong


def parse_feature(content: str | None, languages: dict = LANGUAGES) -> dict | None:
    """The feature of a file, or None if it has none or anything in it is wrong."""
    feature, wrong = read(content, languages)
    return None if wrong else feature


def problems(content: str | None, languages: dict = LANGUAGES) -> list[str]:
    return [f"line {number}: {what}" for number, what in read(content, languages)[1]]
