"""Binding scenario steps to step definitions by their patterns.

A regex join is a nested loop if taken literally. Here patterns that are plain text join distinct texts by equality. For the others, the
texts that every match must contain are read off the pattern; an automaton over all of them passes once over each distinct text and
names the patterns that can fit it, and only those are tried. Patterns that require no text at all are tried on every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import patterns as P
from ..functions.expressions import pattern_of

#: Patterns that are shipped to the tasks at a time; more are searched for in turns.
PATTERNS = 50_000


def _with_pattern(definitions: DataFrame, expression: str, kind: str, good: bool) -> DataFrame:
    """definitions with `pattern` and without what can't be read, or those that can't be read with `problem`."""
    made = "pattern" if good else "problem"
    definitions = definitions.drop(made)
    e, k = definitions.columns.index(expression), definitions.columns.index(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = [pattern_of(x, y) for x, y in zip(batch.column(e).to_pylist(), batch.column(k).to_pylist(), strict=True)]
            wrong = [P.problem(p) for p in patterns]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(patterns if good else wrong, pa.string())], [*batch.schema.names, made])
            yield out.filter(pa.array([(w is None) == good for w in wrong], pa.bool_()))

    return definitions.mapInArrow(run, StructType([*definitions.schema.fields]).add(made, StringType()))


def compiled(definitions: DataFrame, expression: str = "expression", kind: str = "expression_kind") -> DataFrame:
    """definitions with `pattern`, without those whose pattern can't be read: they fit no step."""
    return _with_pattern(definitions, expression, kind, True)


def unreadable(definitions: DataFrame, expression: str = "expression", kind: str = "expression_kind") -> DataFrame:
    """The definitions that compiled() leaves out, with the `problem` of each."""
    return _with_pattern(definitions, expression, kind, False)


class Finder:
    """Which of many patterns fit a text. Made on the driver as a list, it gets ready in each worker when it is first asked."""

    def __init__(self, patterns: list[str]):
        self.patterns, self._ready = patterns, None

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns, "_ready": None}

    def _prepare(self) -> tuple:
        import ahocorasick

        read = [P.read(p) for p in self.patterns]
        times = Counter(f for r in read for need in r.needs for f in need)
        triggers: dict[str, list[int]] = {}
        rest, always = [], []
        for k, r in enumerate(read):
            # Of a pattern's required texts, those that the fewest other patterns share.
            key = min(r.needs, key=lambda need: (max(times[f] for f in need), -min(map(len, need))), default=None)
            rest.append([need for need in r.needs if need != key])
            for f in key or ():
                triggers.setdefault(f, []).append(k)
            if key is None:
                always.append(k)
        automaton = ahocorasick.Automaton()
        for f, ks in triggers.items():
            automaton.add_word(f, ks)
        if triggers:
            automaton.make_automaton()
        return automaton if triggers else None, rest, always, [None] * len(read), read

    def candidates(self, text: str) -> list[int]:
        """Numbers of the patterns whose required texts are all in a text."""
        self._ready = self._ready or self._prepare()
        automaton, rest, always, _, _ = self._ready
        low = P.fold(text)
        found = {k for _, ks in automaton.iter(low) for k in ks} if automaton is not None else set()
        return sorted([k for k in found if all(any(f in low for f in need) for need in rest[k])] + always)

    def fitting(self, text: str) -> list[str]:
        import regex

        out = []
        for k in self.candidates(text):
            made = self._ready[3]
            made[k] = made[k] or regex.compile(self._ready[4][k].text)
            if made[k].search(text):
                out.append(self.patterns[k])
        return out


def _fits(texts: DataFrame, patterns: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(Finder(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [shared.value.fitting(t) for t in own]
            rows = [t for t, f in zip(own, found, strict=True) for _ in f], [p for f in found for p in f]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], ["text", "pattern"])

    return texts.mapInArrow(run, "text string, pattern string")


def _read(patterns: DataFrame) -> DataFrame:
    """(pattern, literal) of the patterns that can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [p for p in batch.column(0).to_pylist() if P.problem(p) is None]
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.string()), pa.array([P.read(p).literal for p in good], pa.string())], ["pattern", "literal"])

    return patterns.mapInArrow(run, "pattern string, literal string")


def matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) of all pairs of distinct texts and distinct patterns where the pattern is found in the text.

    Null texts and patterns fit nothing, and neither does a pattern that can't be read.
    """
    texts = texts.select("text").where(F.col("text").isNotNull()).distinct()
    p = _read(patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct())
    # $ also fits before a line end that is the text's last character.
    stem = F.when(F.endswith("text", F.lit("\n")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    out = texts.join(p.where("literal is not null"), stem == F.col("literal")).select("text", "pattern")
    rest = p.where("literal is null").select("pattern")
    few = [r[0] for r in rest.limit(PATTERNS + 1).collect()]
    turns = 1 if len(few) <= PATTERNS else -(-rest.count() // PATTERNS) + 1
    for t in range(turns):
        own = few if turns == 1 else [r[0] for r in rest.where(F.pmod(F.xxhash64("pattern"), F.lit(turns)) == t).collect()]
        if own:
            out = out.unionByName(_fits(texts, own))
    return out


def binding_edges(steps: DataFrame, definitions: DataFrame) -> DataFrame:
    """(step_id, step_definition_id, edge_kind, confidence): one row for each definition that a step's text matches.

    steps: (id, text); definitions: (id, pattern). No match: one `unbound` row without a target; one: exact; more: all
    of them ambiguous. The keyword plays no part, nor does the project.
    """
    pairs = matches(steps, definitions).join(definitions.select(F.col("id").alias("step_definition_id"), "pattern"), "pattern")
    counted = pairs.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("text"))).select(F.col("text").alias("m_text"), "step_definition_id", "n")
    out = steps.select(F.col("id").alias("step_id"), "text").join(counted, F.col("text") == F.col("m_text"), "left")
    confidence = F.when(F.col("n").isNull(), "").when(F.col("n") == 1, "exact").otherwise("ambiguous")
    return out.select("step_id", "step_definition_id", F.when(F.col("n").isNull(), "unbound").otherwise("binds_to").alias("edge_kind"), confidence.alias("confidence"))


def binding_tallies(edges: DataFrame) -> DataFrame:
    """(bound, ambiguous, unbound): distinct bound and ambiguous steps, and unbound rows."""
    bound = F.col("edge_kind") == "binds_to"
    return edges.agg(
        F.count_distinct(F.when(bound, F.col("step_id"))).alias("bound"),
        F.count_distinct(F.when(bound & (F.col("confidence") == "ambiguous"), F.col("step_id"))).alias("ambiguous"),
        F.count_if(F.col("edge_kind") == "unbound").alias("unbound"),
    )


def coverage_percent(resolved: Column, total: Column) -> Column:
    """Whole percent, halves to the even neighbour; 0 of nothing is 0."""
    return F.when(total == 0, F.lit(0)).otherwise(F.bround(100.0 * resolved / F.greatest(total, F.lit(1)), 0).cast("int"))


def binding_view(steps: DataFrame, edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """(step_id, status, targets): unbound, ambiguous or bound, with the targets' expressions in order."""
    hit = edges.where("edge_kind = 'binds_to'").join(definitions.select(F.col("id").alias("d_id"), "expression"), F.col("step_definition_id") == F.col("d_id"))
    grouped = hit.groupBy(F.col("step_id").alias("b_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("confidence") == "ambiguous").alias("unclear"),
        F.array_join(F.array_sort(F.collect_list("expression")), " | ").alias("targets"),
    )
    out = steps.select(F.col("id").alias("step_id")).join(grouped, F.col("step_id") == F.col("b_id"), "left")
    status = F.when(F.col("n").isNull(), "unbound").when(F.col("unclear") | (F.col("n") > 1), "ambiguous").otherwise("bound")
    return out.select("step_id", status.alias("status"), F.coalesce("targets", F.lit("")).alias("targets"))


def effective_keyword(steps: DataFrame, scenario: str = "scenario_id", ordinal: str = "ordinal", keyword: str = "keyword") -> DataFrame:
    """Adds `effective`: Given, When, Then; other keywords take the last of these in the scenario, or Given."""
    word = F.lower(F.regexp_replace(F.trim(F.col(keyword)), ":+$", ""))
    primary = F.when(word == "given", "Given").when(word == "when", "When").when(word == "then", "Then")
    before = W.partitionBy(scenario).orderBy(ordinal).rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn("effective", F.coalesce(F.last(primary, ignorenulls=True).over(before), F.lit("Given")))


def captures(pairs: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """Adds `captures`: the groups of each match that took part, unnamed ones first, then named ones, each in order."""
    schema = StructType([*pairs.schema.fields]).add("captures", ArrayType(StringType()))
    t, p = pairs.columns.index(text), pairs.columns.index(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        known: dict = {}
        for batch in batches:
            out = []
            for x, y in zip(batch.column(t).to_pylist(), batch.column(p).to_pylist(), strict=True):
                if y not in known:
                    r = P.read(y) if y is not None and P.problem(y) is None else None
                    known[y] = r and (regex.compile(r.text), r.groups)
                m = known[y][0].search(x) if known[y] and x is not None else None
                out.append([m[g] for g in known[y][1] if m[g] is not None] if m else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, "captures"])

    return pairs.mapInArrow(run, schema)
