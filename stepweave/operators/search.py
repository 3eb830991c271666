"""Phrase search: every phrase of a query must stand, in order, in one of the searched columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import folded, salient_tokens, search_phrases
from ..testmap import TestMap
from .postings import open_index


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of df that have all phrases of the query; a query without a letter or digit finds nothing."""
    phrases = search_phrases(query)
    if not phrases:
        return df.where(F.lit(False))
    names = {c: f"__{c}" for c in columns}
    out = df.withColumns({n: folded(F.col(c)) for c, n in names.items()})
    for p in phrases:
        out = out.where(reduce(lambda a, b: a | b, [F.contains(F.col(n), F.lit(f" {p} ")) for n in names.values()]))
    return out.drop(*names.values())


def step_index(m: TestMap) -> DataFrame:
    """(id, expression, method_name, class_name) of step definitions, for search."""
    out = m.step_definitions.select("id", "expression", "method_id", "class_id")
    out = out.join(m.methods.select(F.col("id").alias("m_id"), F.col("name").alias("method_name")), F.col("method_id") == F.col("m_id"), "left")
    out = out.join(m.classes.select(F.col("id").alias("c_id"), F.col("name").alias("class_name")), F.col("class_id") == F.col("c_id"), "left")
    return out.select("id", "expression", *[F.coalesce(c, F.lit("")).alias(c) for c in ("method_name", "class_name")])


def scenario_index(m: TestMap) -> DataFrame:
    """(id, feature_name, scenario_name, step_text, tags) of scenarios; step texts in order."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ")
    steps = m.scenario_steps.groupBy(F.col("scenario_id").alias("s_id")).agg(texts.alias("step_text"))
    out = m.scenarios.select("id", F.col("name").alias("scenario_name"), "tags", "feature_id").join(steps, F.col("id") == F.col("s_id"), "left")
    out = out.join(m.features.select(F.col("id").alias("f_id"), F.col("name").alias("feature_name")), F.col("feature_id") == F.col("f_id"), "left")
    return out.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("feature_name", "scenario_name", "step_text", "tags")])


STEP_COLUMNS = ["expression", "method_name", "class_name"]
SCENARIO_COLUMNS = ["feature_name", "scenario_name", "step_text", "tags"]
#: What a map stores beside its tables, below FOLDER: the rows that are searched, and their columns.
FOLDER = "search"
INDEXES = {"steps": (step_index, STEP_COLUMNS), "scenarios": (scenario_index, SCENARIO_COLUMNS)}


def _search(m: TestMap, name: str, query: str) -> DataFrame:
    make, columns = INDEXES[name]
    if name not in m.indexes:
        return search(make(m), columns, query).orderBy("id")
    return open_index(m.meta.sparkSession, m.indexes[name]).search(make(m), "id", query).orderBy("id")


def search_steps(m: TestMap, query: str) -> DataFrame:
    """Step definitions that have all phrases of a query, by the map's stored index if it has one."""
    return _search(m, "steps", query)


def search_scenarios(m: TestMap, query: str) -> DataFrame:
    return _search(m, "scenarios", query)


def suggestions(texts: DataFrame, index: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """For each text (key, text) the rows of the index that hold most of its salient tokens.

    Tokens of both sides meet by equality; ties go to the earliest token, then to the least id.
    """
    words = texts.select("key", F.posexplode(salient_tokens(F.col("text"))).alias("at", "token"))
    parts = [F.split(F.trim(folded(F.col(c))), " ") for c in columns]
    postings = index.select("id", F.explode(F.array_distinct(F.concat(*parts))).alias("t_token"))
    hit = words.join(postings, F.col("token") == F.col("t_token")).groupBy("key", "id").agg(F.count(F.lit(1)).alias("score"), F.min("at").alias("first"))
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "first", "id"))
    return hit.withColumn("place", place).where(F.col("place") <= limit).drop("first")
