import pytest

from stepweave.functions.expressions import anchored, cucumber_pattern, pattern_of
from stepweave.operators import binding as B

R, C = "regex", "cucumber_expression"
#: What each kind of placeholder takes and leaves: (expression, kind, [(text, captures or None)]).
TAKES = [
    ("train {int} leaves", C, [("train 17 leaves", ["17"]), ("train -4 leaves", ["-4"]), ("train ten leaves", None)]),
    ("the fare is {float} euro(s)", C, [("the fare is 2.75 euro", ["2.75"]), ("the fare is 12.5 euros", ["12.5"])]),
    ("platform {word} opens/closes", C, [("platform north opens", ["north"]), ("platform north closes", ["north"]), ("platform north floods", None), ("platform far north opens", None)]),
    ("the sign reads {string}", C, [('the sign reads "Mind the gap"', ['"Mind the gap"']), ("the sign reads 'Exit'", ["'Exit'"])]),
    ("announce {}", C, [("announce a delay of two hours", ["a delay of two hours"])]),
    (r"dial 1\/2 \{sic} \(now)", C, [("dial 1/2 {sic} (now)", []), ("dial 1 {sic} (now)", None)]),
    (r"coach (\d+), seat ([A-F])", R, [("coach 9, seat C", ["9", "C"]), ("coach nine, seat C", None)]),
    ("^the doors (?:shut|lock)$", R, [("the doors lock", []), ("the doors lock up", None)]),
    ("whistle", R, [("whistle", []), ("whistle twice", None), ("a whistle", None)]),
    ("grey|gray", R, [("grey", [])]),
    ("toot(oot)*", R, [("toot", []), ("toototoot", None)]),
]
# [(kind, expression, name)], [(text, confidence, names, captures)]
GROUPS = [([(kind, e, "one")], [(text, "unbound" if got is None else "exact", [] if got is None else ["one"], got if got else None) for text, got in texts]) for e, kind, texts in TAKES]
GROUPS += [
    ([(R, "the (guard|driver) waves", "who"), (C, "the guard {word}", "does"), (R, "all aboard", "first"), (R, "all aboard", "again"), (C, "all ashore", "ship"), (R, "bells (ring", "broken"), (R, "bells ring", "whole")],
     [("the guard waves", "ambiguous", ["who", "does"], None), ("the driver waves", "exact", ["who"], ["driver"]), ("all aboard", "ambiguous", ["first", "again"], None), ("bells ring", "exact", ["whole"], [])]),
    ([], [("nothing fits", "unbound", [], None)]),
]


@pytest.mark.parametrize("k", range(len(GROUPS)))
def test_group(spark, k):
    defs, cases = GROUPS[k]
    steps = spark.createDataFrame([(j, c[0]) for j, c in enumerate(cases)], "id long, text string")
    d = B.compiled(spark.createDataFrame([(j, e, kind) for j, (kind, e, _) in enumerate(defs)], "id long, expression string, expression_kind string"))
    edges, pairs = B.binding_edges(steps, d).collect(), B.captures(B.matches(steps, d)).collect()
    for j, (text, confidence, names, captures) in enumerate(cases):
        own = [e for e in edges if e["step_id"] == j]
        assert {e["confidence"] or "unbound" for e in own} == {confidence}
        assert sorted(defs[e["step_definition_id"]][2] for e in own if e["step_definition_id"] is not None) == sorted(names)
        if captures is not None:
            assert [p["captures"] for p in pairs if p["text"] == text] == [captures]


def test_patterns():
    assert anchored("b+") == "^b+$" and anchored("^b+$") == "^b+$" and anchored(r"fare \$") == r"^fare \$"
    assert cucumber_pattern("doors open/shut fast") == r"^doors (?:open|shut) fast$"
    assert pattern_of("{half", C) == r"^\{half$"


def test_prefix_join_equals_nested_loop(spark):
    texts = [f"{a} {b} {c}" for a in ("open", "close", "o") for b in ("the", "a") for c in ("door", "gate", "")]
    patterns = ["^open (.*)$", "^open the door$", "^(open|close) the (.*)$", "^o.*$", "^open the (gate|door)$", "^clo?se a .*$", "^x|a door$", "^.*$"]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    got = {tuple(r) for r in B.matches(t, p).collect()}
    want = {tuple(r) for r in t.distinct().crossJoin(p).where("text rlike pattern").collect()}
    assert got == want and want


KEYWORDS = [("Given", None, "Given"), ("When", "Given", "When"), ("And", "When", "When"), ("But", "Then", "Then"), ("And", None, "Given"), ("*", "Then", "Then"), ("Then:", "When", "Then")]


def test_effective_keyword(spark):
    rows = []
    for k, (raw, before, _) in enumerate(KEYWORDS):
        rows += [(k, 0, before)] * (before is not None) + [(k, 1, raw)]
    df = spark.createDataFrame(rows, "scenario_id int, ordinal int, keyword string")
    got = {r["scenario_id"]: r["effective"] for r in B.effective_keyword(df).where("ordinal = 1").collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(KEYWORDS)}
