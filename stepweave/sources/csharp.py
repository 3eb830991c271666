"""C# source files as facts about their types and methods, from a token stream; no compiler is needed.

Declarations are recognised by their headers; bodies are scanned for constructions, declarations, calls and assignments.
Whatever isn't recognised yields nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.options import ClassifierOptions

# Attributes of step definitions, bindings and tests.
STEP_ATTRIBUTES = {"Given", "When", "Then", "StepDefinition"}
TEST_METHOD_ATTRIBUTES = {"Test", "TestCase", "Fact", "Theory", "TestMethod", "DataTestMethod"}
TEST_CLASS_ATTRIBUTES = {"TestFixture", "TestClass"}
# Names of HTTP client methods by verb.
CLIENT_METHODS = {
    "GET": ["GetAsync", "GetStringAsync", "GetStreamAsync", "GetByteArrayAsync", "GetFromJsonAsync", "GetJsonAsync"],
    "POST": ["PostAsync", "PostAsJsonAsync", "PostJsonAsync"],
    "PUT": ["PutAsync", "PutAsJsonAsync", "PutJsonAsync"],
    "PATCH": ["PatchAsync", "PatchAsJsonAsync"],
    "DELETE": ["DeleteAsync", "DeleteFromJsonAsync", "DeleteJsonAsync"],
}
VERB_OF_CALL = {name: verb for verb, names in CLIENT_METHODS.items() for name in names}
VERB_ATTRIBUTES = ["Get", "Post", "Put", "Patch", "Delete", "Head"]
# Getters that name a request's route and its API.
ROUTE_GETTERS = {"ServiceName", "Resource", "Route", "Path", "Endpoint", "Url", "Uri", "RequestUri", "Address"}
API_GETTERS = {"TargetAPI", "TargetApi", "Api", "ApiName", "Host", "BaseUrl", "BaseAddress"}

MODIFIERS = set("public private protected internal static readonly const sealed abstract virtual override async partial new unsafe extern volatile required file ref fixed".split())
NO_TYPE = set("return throw await yield new else case goto using in out is as base this null true false if while for foreach switch lock do try catch finally when var2 default typeof nameof checked unchecked sizeof delegate select from where".split())
PREDEFINED = set("bool byte sbyte char decimal double float int uint long ulong object short ushort string void dynamic nint nuint".split())

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|\#[^\n]*)
    |(?P<raw>\$*\"\"\".*?\"\"\")
    |(?P<interp>(?:\$@|@\$)"(?:[^"{]|""|\{\{|\{[^}]*\})*"|\$"(?:[^"\\{]|\\.|\{\{|\{(?:[^{}"]|"[^"]*")*\})*")
    |(?P<verbatim>@"(?:[^"]|"")*")
    |(?P<string>"(?:[^"\\\n]|\\.)*")
    |(?P<char>'(?:[^'\\\n]|\\.)+')
    |(?P<id>@?[^\W\d]\w*)
    |(?P<num>\d[\w.]*)
    |(?P<op>=>|::|\?\.|\?\?=?|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|->|.)""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "'": "'"}


@dataclass
class Token:
    kind: str  # id, str, interp, char, num, op
    value: str
    line: int


def tokens(source: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "id":
            out.append(Token("id", text.lstrip("@"), line))
        elif kind == "string":
            out.append(Token("str", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1]), line))
        elif kind == "verbatim":
            out.append(Token("str", text[2:-1].replace('""', '"'), line))
        elif kind == "raw":
            body = text.strip("$")[3:-3]
            out.append(Token("interp" if text[0] == "$" else "str", body.strip("\n"), line))
        elif kind == "interp":
            body = text[text.index('"') + 1 : -1]
            out.append(Token("interp", re.sub(r"\{\{|\}\}", lambda e: e[0][0], body) if "{{" in body else body, line))
        elif kind != "skip":
            out.append(Token({"char": "char", "num": "num"}.get(kind, "op"), text, line))
        line += text.count("\n")
    return out


@dataclass
class Method:
    name: str
    signature: str
    parameters: str
    visibility: str
    line_start: int
    line_end: int
    steps: list[tuple[str, str]] = field(default_factory=list)
    used: list[str] = field(default_factory=list)
    calls: list[tuple[str, str]] = field(default_factory=list)
    operations: list[tuple[str, str]] = field(default_factory=list)
    has_step: bool = False
    has_hook: bool = False
    has_test: bool = False


@dataclass
class Type:
    name: str
    namespace: str
    base_type: str | None
    base_name: str | None
    line_start: int
    line_end: int = 0
    methods: list[Method] = field(default_factory=list)
    facts: dict = field(default_factory=dict)
    held: list[str] = field(default_factory=list)
    request: tuple[str, str, str | None] | None = None


@dataclass
class _Member:
    kind: str  # field, property, method
    attributes: list[tuple[str, str | None]]
    modifiers: list[str]
    type_at: tuple[int, int]
    names: list[str]
    first: int
    last: int
    params: list[tuple[int, int, str]] = field(default_factory=list)
    body: tuple[int, int] | None = None
    type_params: list[str] = field(default_factory=list)
    name_at: int = 0


class Scanner:
    """One source file."""

    def __init__(self, source: str, options: ClassifierOptions = ClassifierOptions()):  # noqa: B008
        self.t = tokens(source)
        self.ui, self.api = {*options.ui_markers}, {*options.api_markers}
        self.pairs = self._pairs()
        self.types: list[Type] = []
        self.usings: list[str] = []
        self._space(0, len(self.t), "", [])

    # small helpers over the token list

    def v(self, k: int) -> str:
        return self.t[k].value if 0 <= k < len(self.t) and self.t[k].kind in ("id", "op") else ""

    def is_id(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "id"

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        close = {")": "(", "]": "[", "}": "{"}
        for k, x in enumerate(self.t):
            if x.kind == "op" and x.value in "([{":
                stack.append(k)
            elif x.kind == "op" and x.value in close:
                if stack and self.t[stack[-1]].value == close[x.value]:
                    out[stack.pop()] = k
        for k in stack:
            out[k] = len(self.t) - 1
        return out

    def type_end(self, k: int) -> int:
        """The place after a type that begins at k, or k if there is none."""
        start = k
        if self.v(k) == "ref":
            k += 1
        if self.v(k) == "(" and k in self.pairs:
            k = self.pairs[k] + 1
        else:
            while True:
                if not self.is_id(k) or (self.v(k) in NO_TYPE and self.v(k) not in PREDEFINED):
                    return start
                k += 1
                if self.v(k) == "<":
                    end = self._generic_end(k)
                    if end == k:
                        return k
                    k = end
                if self.v(k) in (".", "::") and self.is_id(k + 1):
                    k += 1
                    continue
                break
        while True:
            if self.v(k) == "?":
                k += 1
            elif self.v(k) == "[" and all(self.v(j) == "," for j in range(k + 1, self.pairs.get(k, k))) and k in self.pairs:
                k = self.pairs[k] + 1
            elif self.v(k) == "*" and self.is_id(k + 1):
                k += 1
            else:
                return k

    def _generic_end(self, k: int) -> int:
        """The place after the type arguments that open at k, or k."""
        j = k + 1
        while True:
            if self.v(j) == ">":
                return j + 1
            end = self.type_end(j)
            if end == j and self.v(j) != ",":
                return k
            j = end
            if self.v(j) == ",":
                j += 1
            elif self.v(j) != ">":
                return k

    def names_in(self, a: int, b: int) -> list[str]:
        """Simple names of a type: itself, its qualifiers and its type arguments."""
        return [self.t[k].value for k in range(a, b) if self.is_id(k) and self.v(k) not in PREDEFINED and self.v(k) not in ("var", "ref")]

    def text_of(self, a: int, b: int) -> str:
        out = ""
        for k in range(a, b):
            x = self.t[k].value
            out += x + (" " if x == "," else "")
        return out

    def simple(self, a: int, b: int) -> str:
        """The rightmost simple name of a type, without its type arguments."""
        last, k = "", a
        while k < b:
            if self.is_id(k):
                last = self.t[k].value
                if self.v(k + 1) == "<":
                    k = self._generic_end(k + 1) - 1
            k += 1
        return last

    # declarations

    def _space(self, k: int, end: int, namespace: str, type_params: list[str]) -> None:
        while k < end:
            if self.v(k) == "using" and self.v(k + 1) != "(":
                stop = next((j for j in range(k, end) if self.v(j) == ";"), end)
                names = [self.t[j].value for j in range(k + 1, stop) if self.t[j].value not in ("static", "global")]
                self.usings.append("".join(names).partition("=")[0] if "=" not in names else "".join(names).partition("=")[2])
                k = stop + 1
            elif self.v(k) == "namespace":
                j = k + 1
                while j < end and self.v(j) not in ("{", ";"):
                    j += 1
                name = self.text_of(k + 1, j)
                if self.v(j) == "{":
                    self._space(j + 1, self.pairs.get(j, end), name, type_params)
                    k = self.pairs.get(j, end) + 1
                else:
                    namespace, k = name, j + 1
            else:
                k = self._declaration(k, end, namespace, type_params, None)

    def _attributes(self, k: int) -> tuple[list[tuple[str, str | None]], int]:
        out = []
        while self.v(k) == "[" and k in self.pairs:
            end, j = self.pairs[k], k + 1
            if self.is_id(j) and self.v(j + 1) == ":":
                j += 2
            while j < end:
                stop = self.type_end(j)
                if stop == j:
                    break
                name = self.simple(j, stop)
                name = name[: -len("Attribute")] if name.endswith("Attribute") and name != "Attribute" else name
                first, j = None, stop
                if self.v(j) == "(" and j in self.pairs:
                    if j + 1 < self.pairs[j] and self.t[j + 1].kind in ("str", "char", "num") and self.v(j + 2) in (",", ")"):
                        first = self.t[j + 1].value
                    out.append((name, first, (j + 1, self.pairs[j])))
                    j = self.pairs[j] + 1
                else:
                    out.append((name, None, None))
                if self.v(j) != ",":
                    break
                j += 1
            k = end + 1
        return out, k

    def _declaration(self, k: int, end: int, namespace: str, type_params: list[str], members: list[_Member] | None) -> int:
        """One declaration at k; types are added to self.types, members to the list. Returns the place after it."""
        first = k
        attributes, k = self._attributes(k)
        modifiers = []
        while self.v(k) in MODIFIERS and not (self.v(k) == "new" and self.v(k + 1) == "("):
            modifiers.append(self.v(k))
            k += 1
        word = self.v(k)
        if word in ("class", "struct", "interface") or (word == "record" and self.is_id(k + 1)):
            k += 1
            if word == "record" and self.v(k) in ("class", "struct"):
                k += 1
            return self._type(first, k, end, namespace, type_params, attributes, modifiers)
        if word in ("enum", "delegate", "event") or members is None:
            return self._skip(k, end)
        stop = self.type_end(k)
        if stop == k or self.v(stop) == "(" or self.v(k) in ("implicit", "explicit") or self.v(stop) in ("operator", "this"):
            return self._skip(k, end)
        name_at = stop
        while self.is_id(name_at) and (self.v(name_at + 1) == "." or (self.v(name_at + 1) == "<" and self.v(self._generic_end(name_at + 1)) == ".")):
            name_at = (name_at + 1 if self.v(name_at + 1) == "." else self._generic_end(name_at + 1)) + 1
        if not self.is_id(name_at) or self.v(name_at) in ("this", "operator"):
            return self._skip(k, end)
        after = name_at + 1
        params: list[str] = []
        if self.v(after) == "<":
            params = self.names_in(after, self._generic_end(after))
            after = self._generic_end(after)
        last = self._skip(k, end) - 1
        base = dict(attributes=attributes, modifiers=modifiers, type_at=(k, stop), first=first, last=last, name_at=name_at)
        if self.v(after) == "(":
            close = self.pairs.get(after, last)
            body = next(((j, last + 1) for j in range(close + 1, last + 1) if self.v(j) in ("{", "=>")), None)
            members.append(_Member("method", names=[self.v(name_at)], params=self._params(after + 1, close), body=body, type_params=params, **base))
        elif self.v(after) in ("{", "=>"):
            members.append(_Member("property", names=[self.v(name_at)], body=(after, last + 1), **base))
        else:
            names, j = [], name_at
            while j <= last:
                names.append(self.v(j))
                while j <= last and self.v(j) not in (",", ";"):
                    j = self.pairs.get(j, j) + 1
                j += 1
            members.append(_Member("field", names=names, body=(after, last + 1), **base))
        return last + 1

    def _skip(self, k: int, end: int) -> int:
        """The place after the declaration whose header is at k: its `;`, or its block and what belongs to it."""
        arrow = False
        while k < end:
            v = self.v(k)
            if v == ";":
                return k + 1
            if v == "=>" or v == "=":
                arrow = True
            if v == "{" and not arrow:
                k = self.pairs.get(k, end) + 1
                return self._skip(k, end) if self.v(k) == "=" else k
            if v == "}":
                return k + 1
            k = self.pairs.get(k, k) + 1
        return end

    def _params(self, k: int, end: int) -> list[tuple[int, int, str]]:
        out = []
        for a, b in self.arguments(k, end):
            _, a = self._attributes(a)
            while self.v(a) in ("this", "ref", "out", "in", "params", "scoped"):
                a += 1
            stop = self.type_end(a)
            if stop > a and self.is_id(stop):
                out.append((a, stop, self.v(stop)))
        return out

    def arguments(self, k: int, end: int) -> list[tuple[int, int]]:
        """Places of the comma-separated parts between k and end."""
        out, start = [], k
        while k < end:
            if self.v(k) == ",":
                out.append((start, k))
                start = k + 1
            if self.v(k) == "<" and (g := self._generic_end(k)) != k and self.v(g) in ("(", ")", ",", ">", ".", "?") + ("",) or (self.v(k) == "<" and g != k and self.is_id(g)):
                k = g
                continue
            k = self.pairs.get(k, k) + 1
        if start < end:
            out.append((start, end))
        return out

    def _type(self, first: int, k: int, end: int, namespace: str, outer: list[str], attributes: list, modifiers: list[str]) -> int:
        if not self.is_id(k):
            return k + 1
        name_at, j = k, k + 1
        params = list(outer)
        if self.v(j) == "<":
            params += self.names_in(j, self._generic_end(j))
            j = self._generic_end(j)
        if self.v(j) == "(":
            j = self.pairs.get(j, j) + 1
        base_at = None
        if self.v(j) == ":":
            base_at = (j + 1, self.type_end(j + 1))
        while j < end and self.v(j) not in ("{", ";"):
            j = (self.pairs.get(j, j) if self.v(j) != "{" else j) + 1
        close = self.pairs.get(j, end - 1) if self.v(j) == "{" else j
        base = base_at if base_at and base_at[1] > base_at[0] else None
        out = Type(self.v(name_at), namespace, self.text_of(*base) if base else None, self.simple(*base) if base else None, self.t[name_at].line, self.t[min(close, len(self.t) - 1)].line)
        self.types.append(out)
        members: list[_Member] = []
        p = j + 1
        while self.v(j) == "{" and p < close:
            p = max(p + 1, self._declaration(p, close, namespace, params, members))
        self._facts(out, members, attributes, modifiers, first, close + 1, params)
        return close + 1

    # facts

    def type_slots(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of the types in bodies: constructed, cast to, tested for, of typeof, foreach and local declarations."""
        out, k = [], a
        while k < b:
            v, before = self.v(k), self.v(k - 1)
            if v == "new" and (e := self.type_end(k + 1)) > k + 1:
                out.append((k + 1, e))
            elif v == "typeof" and self.v(k + 1) == "(":
                out.append((k + 2, self.pairs.get(k + 1, k + 2)))
            elif v in ("is", "as"):
                e = self.type_end(k + 1)
                if e > k + 1 and self.v(k + 1) not in ("not", "null"):
                    out.append((k + 1, e))
            elif v == "(" and before not in (")", "]", ">") and not (self.is_id(k - 1) and before not in ("return", "await", "in", "case", "else", "throw")):
                e = self.type_end(k + 1)
                if e > k + 1 and self.v(e) == ")" and (self.is_id(e + 1) or self.v(e + 1) == "(" or (e + 1 < len(self.t) and self.t[e + 1].kind in ("str", "num", "interp"))) and self.v(e + 1) not in ("is", "as"):
                    out.append((k + 1, e))
            if self.is_id(k) and (before in ("{", "}", ";", "const", "await") or (before == ")" and False) or (before == "(" and self.v(k - 2) in ("for", "foreach", "using", "fixed")) or before == "using"):
                e = self.type_end(k)
                if e > k and self.is_id(e) and self.v(e) not in NO_TYPE and (self.v(e + 1) in ("=", ";", ",") or self.v(e + 1) == "in"):
                    out.append((k, e))
            k += 1
        return out

    def member_slots(self, m: _Member) -> list[tuple[int, int]]:
        return [m.type_at, *[(a, b) for a, b, _ in m.params], *(self.type_slots(*m.body) if m.body else [])]

    def _has(self, slots: list[tuple[int, int]], markers: set[str]) -> bool:
        return any(n in markers for a, b in slots for n in self.names_in(a, b))

    def _facts(self, out: Type, members: list[_Member], attributes: list, modifiers: list[str], first: int, end: int, type_params: list[str]) -> None:
        instance = [m for m in members if "static" not in m.modifiers]
        methods = [m for m in members if m.kind == "method"]
        inner = self.type_slots(first, end)
        for m in members:
            inner.append(m.type_at)
            inner += [(a, b) for a, b, _ in m.params]
        header = next((k for k in range(first, end) if self.v(k) == "{"), end)
        colon = next((k for k in range(first, header) if self.v(k) == ":" and self.v(k - 1) != "("), None)
        if colon is not None:
            inner.append((colon + 1, header))
        made = sorted({self.simple(k + 1, e) for k in range(first, end) if self.v(k) == "new" and (e := self.type_end(k + 1)) > k + 1})
        names = {n for n, *_ in attributes}
        of = lambda m: {n for n, *_ in m.attributes}
        hook = lambda ns: any(n.startswith(("Before", "After")) for n in ns)
        holds = [m.type_at for m in members if m.kind in ("field", "property")]
        out.facts = {
            "name": out.name, "base_type_name": out.base_name, "has_binding_attribute": "Binding" in names, "has_test_class_attribute": bool(names & TEST_CLASS_ATTRIBUTES),
            "method_count": len(methods), "step_method_count": sum(bool(of(m) & STEP_ATTRIBUTES) for m in methods), "test_method_count": sum(bool(of(m) & TEST_METHOD_ATTRIBUTES) for m in methods),
            "hook_method_count": sum(hook(of(m)) for m in methods), "instance_member_count": len(instance), "ui_referencing_members": sum(self._has(self.member_slots(m), self.ui) for m in instance),
            "api_referencing_members": sum(self._has(self.member_slots(m), self.api) for m in methods), "references_ui_type": self._has(inner, self.ui), "references_api_type": self._has(inner, self.api),
            "holds_or_constructs_api_marker": bool(set(made) & self.api) or self._has(holds, self.api), "constructed_type_names": made, "is_static": "static" in modifiers,
        }
        out.held = sorted({n for m in members for a, b in [m.type_at, *[(a, b) for a, b, _ in m.params]] for n in self.names_in(a, b)})
        out.request = self._request(members)
        kinds = {n: self.names_in(*m.type_at) for m in members if m.kind in ("field", "property") for n in m.names}
        consts = self._constants(members)
        for m in methods:
            out.methods.append(self._method(m, kinds, consts, type_params))

    def _method(self, m: _Member, kinds: dict[str, list[str]], consts: dict[str, str], type_params: list[str]) -> Method:
        types = [self.text_of(a, b) for a, b, _ in m.params]
        mods = set(m.modifiers)
        open_ = "public" if "public" in mods else "protected internal" if {"protected", "internal"} <= mods else "protected" if "protected" in mods else "internal" if "internal" in mods else "private"
        name = m.names[0]
        out = Method(name, f"{name}({', '.join(types)})", ", ".join(f"{t} {n}" for t, (_, _, n) in zip(types, m.params, strict=True)), open_, self.t[m.name_at].line, self.t[min(m.last, len(self.t) - 1)].line)
        for n, first, args in m.attributes:
            if n in STEP_ATTRIBUTES:
                out.steps.append((n, first or ""))
            if n in VERB_ATTRIBUTES and args:
                parts = self.arguments(*args)
                self._found(out.calls, n.upper(), self._route(*parts[0], consts) if parts else None)
        names = {n for n, *_ in m.attributes}
        out.has_step, out.has_test = bool(names & STEP_ATTRIBUTES), bool(names & TEST_METHOD_ATTRIBUTES)
        out.has_hook = any(n.startswith(("Before", "After")) for n in names)
        used = set(self.names_in(*m.type_at)) | {n for a, b, _ in m.params for n in self.names_in(a, b)}
        if m.body:
            for a, b in self.type_slots(*m.body):
                if self.v(a - 1) not in ("(", "is", "as") or self.v(a - 2) in ("for", "foreach", "using", "fixed"):
                    used |= set(self.names_in(a, b))
            for k in range(*m.body):
                if self.is_id(k) and self.v(k) in kinds:
                    used |= set(kinds[self.v(k)])
            self._calls(m.body, consts, out, set(type_params) | set(m.type_params))
        out.used = sorted(used)
        return out

    def _constants(self, members: list[_Member]) -> dict[str, str]:
        out = {}
        for m in members:
            if m.kind == "field" and ("const" in m.modifiers or {"static", "readonly"} <= set(m.modifiers)):
                for k in range(m.first, m.last):
                    if self.is_id(k) and self.v(k) in m.names and self.v(k + 1) == "=" and self.t[k + 2].kind == "str" and self.v(k + 3) in (",", ";"):
                        out[self.v(k)] = self.t[k + 2].value
        return out

    def _request(self, members: list[_Member]) -> tuple[str, str, str | None] | None:
        verb = route = api = None
        for m in members:
            if m.kind != "property" or not m.body:
                continue
            got = self._getter(*m.body)
            if got is None:
                continue
            name = m.names[0]
            verb = verb or self._verb(*got)
            one = self.t[got[0]].value if got[1] == got[0] + 1 and self.t[got[0]].kind == "str" else None
            if one is not None and name in ROUTE_GETTERS and route is None:
                route = one
            if one is not None and name in API_GETTERS and api is None:
                api = one
        return (verb, route, api) if verb and route is not None else None

    def _getter(self, a: int, b: int) -> tuple[int, int] | None:
        """Places of what a property returns."""
        k = a
        if self.v(a) == "{":
            k = next((j for j in range(a + 1, self.pairs.get(a, b)) if self.v(j) == "get"), None)
            if k is None:
                return None
            k += 1
        if self.v(k) == "{":
            k = next((j for j in range(k, self.pairs.get(k, b)) if self.v(j) == "return"), None)
            if k is None:
                return None
        elif self.v(k) != "=>":
            return None
        stop = next((j for j in range(k + 1, b) if self.v(j) == ";"), b)
        return (k + 1, stop)

    def _verb(self, a: int, b: int) -> str | None:
        return self.v(a + 2).upper() if b == a + 3 and self.v(a) in ("Method", "HttpMethod") and self.v(a + 1) == "." and self.is_id(a + 2) else None

    def _route(self, a: int, b: int, consts: dict[str, str]) -> str | None:
        if self.is_id(a) and self.v(a + 1) == ":" and b > a + 2:
            a += 2
        if b != a + 1:
            return None
        x = self.t[a]
        return x.value if x.kind in ("str", "interp") else consts.get(x.value) if x.kind == "id" else None

    @staticmethod
    def route_like(s: str, strict: bool = False) -> bool:
        if not s or re.search(r"\s", s) or "/" not in s or s.startswith("//") or "()" in s or re.search(r"/[A-Za-z_][\w.-]*:[A-Za-z]", s.replace("://", "")):
            return False
        return not strict or s.startswith("/") or "://" in s or "/{" in s

    def _found(self, calls: list, verb: str, route: str | None, strict: bool = False) -> None:
        if route is not None and self.route_like(route, strict):
            calls.append((verb, route))

    def _calls(self, body: tuple[int, int], consts: dict[str, str], out: Method, type_params: set[str]) -> None:
        for k in range(*body):
            if self.v(k) == "new":
                e = self.type_end(k + 1)
                if e > k + 1:
                    self._made(k + 1, e, consts, out, type_params)
            elif self.is_id(k) and self.v(k) == "Resource" and self.v(k + 1) == "=":
                stop = next((j for j in range(k + 2, body[1]) if self.v(j) in (";", ",", "}")), body[1])
                self._found(out.calls, "ANY", self._route(k + 2, stop, consts))
            elif self.is_id(k) and self.v(k) not in NO_TYPE:
                p = self._generic_end(k + 1) if self.v(k + 1) == "<" else k + 1
                if self.v(p) == "(" and p in self.pairs and not self._is_made(k):
                    self._invoked(self.v(k), self.arguments(p + 1, self.pairs[p]), consts, out)

    def _is_made(self, k: int) -> bool:
        while self.v(k - 1) in (".", "::") and self.is_id(k - 2):
            k -= 2
        return self.v(k - 1) == "new"

    def _invoked(self, name: str, args: list[tuple[int, int]], consts: dict[str, str], out: Method) -> None:
        first = self._route(*args[0], consts) if args else None
        if name in VERB_OF_CALL:
            self._found(out.calls, VERB_OF_CALL[name], first)
            return
        verb = next((v for a, b in args if (v := self._verb(a, b))), None)
        if verb:
            route = next((r for a, b in args if (r := self._route(a, b, consts)) is not None and self.route_like(r)), None)
            self._found(out.calls, verb, route)
            return
        for v in VERB_ATTRIBUTES[:5]:
            if name.lower().startswith(v.lower()) and not name[len(v) : len(v) + 1].islower():
                self._found(out.calls, v.upper(), first, strict=True)
                return

    def _made(self, a: int, e: int, consts: dict[str, str], out: Method, type_params: set[str]) -> None:
        name = self.simple(a, e)
        args = self.arguments(e + 1, self.pairs[e]) if self.v(e) == "(" and e in self.pairs else []
        if name == "RestRequest" and args:
            verb = "GET"
            for x in args[1:]:
                verb = self._verb(*x) or verb
            self._found(out.calls, verb, self._route(*args[0], consts))
        elif name == "HttpRequestMessage":
            verb, route = "ANY", None
            for x in args:
                v, r = self._verb(*x), self._route(*x, consts)
                if v:
                    verb = v
                elif r is not None and self.route_like(r):
                    route = r
            self._found(out.calls, verb, route)
        if self.v(a + 1) == "<" and self.is_id(a + 2) and self.v(a + 3) == ">" and e == a + 4 and self.v(a + 2) not in type_params | PREDEFINED:
            out.operations.append((self.v(a), self.v(a + 2)))


def scan(source: str, options: ClassifierOptions = ClassifierOptions()) -> tuple[list[Type], str]:
    """The types of a file and the expression kind that its usings imply."""
    s = Scanner(source, options)
    kind = "regex"
    for u in s.usings:
        if u.startswith("Reqnroll"):
            kind = "cucumber_expression"
            break
        if u.startswith("TechTalk.SpecFlow"):
            break
    return s.types, kind
