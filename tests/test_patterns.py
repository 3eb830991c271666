"""The pattern dialect: answers that .NET documents, agreement of both engines, required texts, and what is refused."""

import random

import pytest
import regex

from stepweave.functions import patterns as P
from stepweave.operators import binding as B

#: (pattern, text, groups that took part, in .NET's order, or None where it doesn't fit)
ANSWERS = [
    # Named groups are numbered after all unnamed ones, whatever their places.
    (r"^(?<seat>\w)(\d+)$", "C9", ["9", "C"]),
    (r"^(?'to'\w+) via (\w+) and (?<from>\w+)$", "Ulm via Bonn and Kiel", ["Bonn", "Ulm", "Kiel"]),
    (r"^(?<q>['])(x)\k<q>\1?$", "'x'x", ["x", "'"]),
    (r"^(a)(?<n>b)\2$", "abb", ["a", "b"]),
    # $ fits before a last line end only; \z doesn't; . takes all but a line feed.
    ("^fare$", "fare\n", []),
    ("^fare$", "fare\n\n", None),
    (r"^fare\z", "fare\n", None),
    (r"^fare\Z", "fare\n", []),
    ("^a.b$", "a\rb", []),
    ("^a.b$", "a b", []),
    ("^a.b$", "a\nb", None),
    ("(?s)^a.b$", "a\nb", []),
    ("(?m)^b$", "a\nb\nc", []),
    # Classes: decimal digits of all scripts; letters, nonspacing marks, digits and connectors, but no letter-like numbers; blanks.
    (r"^\d$", "٣", []),
    (r"^\d$", "²", None),
    (r"^\w+$", "né_é", []),
    (r"^\w$", "²", None),
    (r"^\w$", "ↈ", None),
    (r"^\s+$", "   \x85 \v", []),
    (r"^\s$", "​", None),
    (r"^x\b.$", "x‍", None),
    (r"^\bx\b.$", "x-", []),
    # Classes less others, brackets that stand for themselves, signs that other engines read as set operations.
    ("^[a-z-[aeiou]]+$", "rhythm", []),
    ("^[a-z-[aeiou]]+$", "rhyme", None),
    (r"^[\w-[\d_]]+$", "abc", []),
    (r"^[\w-[\d_]]+$", "ab1", None),
    ("^[]a]+$", "]a]", []),
    ("^[^]a]$", "b", []),
    ("^[a&&b]+$", "a&b", []),
    ("^[a||b~~c]+$", "a|b~c", []),
    ("^[[x]+$", "[x", []),
    (r"^[^\W\d]+$", "ab", []),
    (r"^[^\W\d]+$", "a1", None),
    (r"^[\D]$", "x", []),
    # Case without culture: one character against one.
    ("(?i)^k$", "K", []),
    ("(?i)^i$", "İ", None),
    ("(?i)^I$", "ı", None),
    ("(?i)^ß$", "ss", None),
    ("(?i)^straSSe$", "STRASSE", []),
    ("^a(?i)b(?-i)c$", "aBc", []),
    ("^a(?i)b(?-i)c$", "aBC", None),
    ("^a(?i:b)c$", "aBc", []),
    ("(?i)^[a-f]+$", "BeEf", []),
    # Braces that aren't quantifiers, escapes, lazy and atomic parts, comments.
    ("^a{x}$", "a{x}", []),
    ("^a{,2}$", "a{,2}", []),
    ("^a{2}$", "aa", []),
    (r"^\x41B\103\t$", "ABC\t", []),
    (r"^a\vb$", "a\x0bb", []),
    ("^(a+?)(a*)$", "aaa", ["a", "aa"]),
    ("^(?>a+)a$", "aaa", None),
    ("^a(?#b)c$", "ac", []),
    ("(?x) ^ a \\ b  # all\n c $", "a bc", []),
    ("(?n)^(a)(?<b>b)$", "ab", ["b"]),
    ("^(a)|(b)$", "b", ["b"]),
    (r"^(?=.*\d)\w+$", "ab1", []),
    (r"^.*(?<!x)y$", "xy", None),
]
REFUSED = ["(a", "a)", "[a", "a++", "a**", "a{2}{3}", "*a", "{2}", "a{3,2}", r"\q", r"\_", "[b-a]", r"[a-\d]", r"\2(a)", r"\k<x>", "(?<a-b>x)", "(?(1)a|b)", r"\p{IsGreek}", r"(?i)\p{Lu}", "(?<=a+)b", "(?<a>x)(?<a>y)", "(?<1>x)", "(?z)", r"(?i)(a)\1"]


def engine_groups(pattern, text):
    r = P.read(pattern)
    m = regex.search(r.text, text)
    return [m[g] for g in r.groups if m[g] is not None] if m else None


@pytest.mark.parametrize(("pattern", "text", "groups"), ANSWERS)
def test_documented_answers(pattern, text, groups):
    assert engine_groups(pattern, text) == groups


def test_java_gives_the_same_answers(spark):
    rows = [(k, P.read(p).text, t) for k, (p, t, _) in enumerate(ANSWERS)]
    got = {r["k"]: r["hit"] for r in spark.createDataFrame(rows, "k int, p string, t string").selectExpr("k", "t rlike p hit").collect()}
    assert got == {k: g is not None for k, (_, _, g) in enumerate(ANSWERS)}


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused_with_a_reason(pattern):
    assert P.problem(pattern)


def generated(rng, depth=3):
    """A random pattern: texts, classes, alternatives, optional and repeated parts, groups, case, assertions."""
    turn = rng.randrange(12) if depth else rng.randrange(4)
    if turn < 3:
        return "".join(rng.choice("abcAB ") for _ in range(rng.randrange(1, 4)))
    if turn == 3:
        return rng.choice(["[ab]", "[^a]", r"\w", ".", r"\d", "[a-c-[b]]", r"\s", r"\b"])
    inner = lambda: generated(rng, depth - 1)
    if turn < 6:
        return inner() + inner()
    if turn < 8:
        return f"(?:{'|'.join(inner() for _ in range(rng.randrange(2, 4)))})"
    if turn == 8:
        return f"({inner()}){rng.choice(['?', '*', '+', '{2}', '{1,2}', '??', ''])}"
    if turn == 9:
        return f"(?i:{inner()})"
    return f"(?:{inner()}){rng.choice(['?', '*', '+'])}" if turn == 10 else f"(?={inner()})"


def test_index_equals_the_nested_loop(spark):
    rng = random.Random(12)
    patterns = sorted({rng.choice(["^{}$", "{}", "^{}", "{}$"]).format(generated(rng)) for _ in range(500)})
    patterns = [p for p in patterns if P.problem(p) is None] + ["^ab c$", "^a$", "(broken"]
    texts = sorted({"".join(rng.choice("abcABC 1\n") for _ in range(rng.randrange(9))) for _ in range(250)}) + ["ab c", "ab c\n", "a"]
    t = spark.createDataFrame([(x,) for x in [*texts, None]], "text string")
    found = B.matches(t, spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string"))
    assert not any(x in found._jdf.queryExecution().toString() for x in ("CartesianProduct", "NestedLoop"))
    read = spark.createDataFrame([(p, P.read(p).text) for p in patterns if p != "(broken"], "pattern string, java string")
    want = {tuple(r) for r in t.where("text is not null").distinct().crossJoin(read).where("text rlike java").select("text", "pattern").collect()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    for row in B.captures(found).limit(2000).collect():
        assert row["captures"] is not None


def test_only_patterns_whose_texts_occur_are_tried():
    """A thousand patterns with optional words and alternatives: a text meets those alone that require what it holds."""
    patterns = [rf"^(?:the|a) (?:red )?item{k}x (?:opens|shuts) in (\d+) days?$" for k in range(1000)] + [r"^\d+$"]
    finder = B.Finder(patterns)
    assert finder.candidates("the item77x opens in 3 days") == [77, 1000]
    assert finder.fitting("the item77x opens in 3 days") == [patterns[77]]
    assert finder.candidates("nothing") == [1000]


def test_patterns_in_turns(spark, monkeypatch):
    patterns = [f"^w{k}+ .*$" for k in range(20)] + ["^.*$", "^w3 x$"]
    t = spark.createDataFrame([("w3 x",), ("w11 y",)], "text string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    whole = sorted(map(tuple, B.matches(t, p).collect()))
    monkeypatch.setattr(B, "PATTERNS", 4)
    assert sorted(map(tuple, B.matches(t, p).collect())) == whole == sorted([("w3 x", "^w3+ .*$"), ("w3 x", "^.*$"), ("w3 x", "^w3 x$"), ("w11 y", "^w1+ .*$"), ("w11 y", "^w11+ .*$"), ("w11 y", "^.*$")])


def test_unreadable_definitions_are_told(spark):
    rows = [(1, "open (the door", "regex"), (2, "open {word}", "cucumber_expression"), (3, r"\p{IsGreek}", "regex"), (4, None, "regex")]
    df = spark.createDataFrame(rows, "id long, expression string, expression_kind string")
    assert {r["id"]: r["problem"] for r in B.unreadable(df).collect()}.keys() == {1, 3}
    assert {r["id"] for r in B.compiled(df).collect()} == {2, 4}
