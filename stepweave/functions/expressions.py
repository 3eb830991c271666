"""Scalar functions on step expressions, names, routes, globs and search queries."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameter types of cucumber expressions and what they match.
NUMBER = r"(-?\d*\.?\d+)"
PARAMETER_PATTERNS = {"int": r"(-?\d+)", "float": NUMBER, "double": NUMBER, "bigdecimal": NUMBER, "word": r"([^\s]+)", "string": "(\"[^\"]*\"|'[^']*')"}
ANY_PARAMETER = "(.+?)"

# Name prefixes from which a verb is inferred, in order.
VERB_PREFIXES = {
    "GET": ["Get", "Fetch", "List", "Query", "Read", "Search"],
    "POST": ["Create", "Add", "Insert", "Register", "Submit", "Post", "Save", "Send"],
    "PUT": ["Update", "Edit", "Modify", "Replace", "Put"],
    "PATCH": ["Patch"],
    "DELETE": ["Delete", "Remove"],
}


def anchored(pattern: str | None) -> str:
    """A regex expression that starts with ^ and ends with $; what its author anchored stays as it is."""
    p = pattern or ""
    return ("" if p[:1] == "^" else "^") + p + ("" if p[-1:] == "$" else "$")


def anchored_column(pattern: Column) -> Column:
    p = F.coalesce(pattern, F.lit(""))
    return F.concat(F.when(p.startswith("^"), "").otherwise("^"), p, F.when(p.endswith("$"), "").otherwise("$"))


_CUKE = re.compile(r"\\(?P<escaped>.)|\{(?P<type>[^}]*)\}|\((?P<optional>[^)]*)\)|(?P<plain>.)", re.S)
_SLASH = re.compile(r"((?:\\.|[^/\\]|\\$)*)(?:/|$)", re.S)


def _literal(c: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}#\s])", r"\\\1", c) if not c.isspace() else {" ": "\\ ", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\f": "\\f"}.get(c, c)


def _alternative(text: str) -> str:
    out = []
    for m in _CUKE.finditer(text):
        if m["type"] is not None:
            out.append(PARAMETER_PATTERNS.get(m["type"], ANY_PARAMETER))
        elif m["optional"] is not None:
            out.append(f"(?:{_alternative(m['optional'])})?")
        else:
            out.append(_literal(m["escaped"] or m["plain"]))
    return "".join(out)


def cucumber_pattern(expression: str | None) -> str:
    """The anchored regex of a cucumber expression: parameters, optional text, alternatives in a word, escapes."""
    words = []
    for word in (expression or "").split(" "):
        turns = [m[1] for m in _SLASH.finditer(word)]
        if turns and not turns[-1] and not word.endswith("/"):
            turns.pop()
        parts = [_alternative(t) for t in turns or [""]]
        words.append(parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})")
    return f"^{' '.join(words)}$"


def pattern_of(expression: str | None, kind: str) -> str:
    return cucumber_pattern(expression) if kind == "cucumber_expression" else anchored(expression)


def expression_kind(expression: Column, default: Column) -> Column:
    """cucumber if a {type} occurs, regex if a metacharacter does, else the framework's default."""
    e = F.coalesce(expression, F.lit(""))
    return F.when(e.rlike(r"\{\w*\}"), "cucumber_expression").when(e.rlike(r"[\\^$.|?*+()\[\]]"), "regex").otherwise(default)


def framework_default(usings: Column) -> Column:
    """The expression kind that the first known framework among the usings implies."""
    known = F.filter(usings, lambda u: u.startswith("Reqnroll") | u.startswith("TechTalk.SpecFlow"))
    return F.when(F.try_element_at(known, F.lit(1)).startswith("Reqnroll"), "cucumber_expression").otherwise("regex")


def placeholders(expression: Column, kind: Column) -> Column:
    """array<struct<kind, type, pattern>> of an expression's parameters: typed, enum (values in type) or free."""
    e = F.coalesce(expression, F.lit(""))
    typed = F.transform(F.regexp_extract_all(e, F.lit(r"\{([^}]*)\}"), F.lit(1)), lambda t: F.struct(F.lit("typed").alias("kind"), F.when(t == "", "any").otherwise(t).alias("type"), F.lit(None).cast("string").alias("pattern")))
    inner = F.transform(F.regexp_extract_all(e, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda g: F.regexp_replace(g, r"^\?:", ""))
    is_enum = lambda g: g.rlike(r"^[\w .\-]+(\|[\w .\-]+)+$")
    groups = F.transform(
        F.filter(inner, lambda g: g != ""),
        lambda g: F.struct(
            F.when(is_enum(g), "enum").otherwise("free").alias("kind"),
            F.when(is_enum(g), g).alias("type"),
            F.when(~is_enum(g), F.concat(F.lit("("), g, F.lit(")"))).alias("pattern"),
        ),
    )
    return F.when(kind == "cucumber_expression", typed).otherwise(groups)


def inferred_verb(name: Column) -> Column:
    """The HTTP verb that a name's prefix suggests: the prefix must end the name or be followed by a capital."""
    out = F.lit("ANY")
    for verb, prefixes in reversed(VERB_PREFIXES.items()):
        for p in reversed(prefixes):
            out = F.when(name.rlike(rf"^{p}($|\p{{Lu}})"), verb).otherwise(out)
    return out


def route_like(route: Column, strict: bool = False) -> Column:
    """Whether a text looks like a route; strict: with an absolute form or a template after a slash."""
    r = F.coalesce(route, F.lit(""))
    xpath = F.regexp_replace(r, "://", "").rlike(r"/[A-Za-z_][\w.-]*:[A-Za-z]")
    ok = (r != "") & ~r.rlike(r"\s") & r.contains("/") & ~r.startswith("//") & ~r.contains("()") & ~xpath
    return ok & (r.startswith("/") | r.contains("://") | r.contains("/{")) if strict else ok


def glob_pattern(glob: str) -> str:
    """Regex of a glob: ** any text, * any but /, ? one but /; case is ignored, the whole text is matched."""
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[k]) or re.escape(glob[k]))
        k += 1
    return f"(?i)^{''.join(out)}$"


def glob_filter(name: Column, path: Column, include: list[str], exclude: list[str]) -> Column:
    """Included if no include is given or one matches name or path, and no exclude does."""

    def hit(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | name.rlike(glob_pattern(g)) | path.rlike(glob_pattern(g))
        return out

    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def is_generated(path: Column) -> Column:
    """Whether a path relative to its project lies in obj or bin."""
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"(?i)(^|/)(obj|bin)/")


def quoted_project(message: Column) -> Column:
    """The first quoted .csproj path in a message, or null."""
    q = F.regexp_extract(message, "'([^']*)'", 1)
    return F.when(F.lower(q).endswith(".csproj"), q)


def unmarked(text: str) -> str:
    """A text without diacritics: each character less the marks that its canonical decomposition has."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=1)
def _marked() -> tuple[str, str]:
    """Letters that carry marks and the letters below them, then the marks alone, for translate()."""
    letters = [(chr(c), unmarked(chr(c))) for c in range(0xC0, 0x2000) if unicodedata.category(chr(c))[0] == "L"]
    letters = [(c, x) for c, x in letters if x != c and len(x) == 1]
    return "".join(c for c, _ in letters) + "".join(map(chr, range(0x300, 0x370))), "".join(x for _, x in letters)


def search_phrases(query: str) -> list[str]:
    """A query's words as phrases of adjacent tokens; words without a letter or digit are dropped."""
    out = []
    for word in (query or "").split():
        word = word.replace('"', " ").strip()
        tokens = re.findall(r"[^\W_]+", unmarked(word.lower()))
        if tokens:
            out.append(" ".join(tokens))
    return out


def folded(text: Column) -> Column:
    """A text as blank-separated lower-case tokens of letters and digits, less diacritics, with a blank at both ends."""
    t = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *_marked()), r"[^\p{L}\p{N}\p{Co}]+", " "))
    return F.concat(F.lit(" "), t, F.lit(" "))


def salient_tokens(text: Column) -> Column:
    """Distinct words of a text, stripped to letters and digits, lower case, longer than two."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]+", "")))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def clamp_limit(limit, default: int, most: int = 200) -> int:
    """A number within 1 .. most; anything that isn't a number is the default."""
    return max(1, min(most, int(limit))) if isinstance(limit, (int, float)) and not isinstance(limit, bool) else default
