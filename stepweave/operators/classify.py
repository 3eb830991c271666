"""Kinds of classes, methods and projects, and diagnostics, by first-match rules over facts tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.options import ClassifierOptions
from ..schema import COLLABORATORS
from .storage import cut

PASSES = 10


def class_kind(base_kind: Column, constructs_api: Column, options: ClassifierOptions) -> Column:
    """The kind of a row of class facts; base_kind and constructs_api come from classes already known."""
    c = F.col
    ui, api = c("name").rlike(options.ending("ui_suffixes")), c("name").rlike(options.ending("api_suffixes"))
    members = ~c("is_static")
    return (
        F.when(c("step_method_count") >= 1, "step_class")
        .when(base_kind.isin(*COLLABORATORS), base_kind)
        .when(members & (c("instance_member_count") > 0) & (2 * c("ui_referencing_members") >= c("instance_member_count")), "page_object")
        .when(members & ui & c("references_ui_type"), "page_object")
        .when(members & (c("method_count") > 0) & (2 * c("api_referencing_members") >= c("method_count")), "api_client")
        .when(members & c("holds_or_constructs_api_marker"), "api_client")
        .when(members & api & c("references_api_type"), "api_client")
        .when(members & api & constructs_api, "api_client")
        .when(c("has_test_class_attribute") | (c("test_method_count") >= 1), "test_class")
        .when(c("hook_method_count") >= 1, "hook_class")
        .otherwise("other")
    )


def method_kind(facts_step: Column, facts_hook: Column, facts_test: Column, kind_of_class: Column) -> Column:
    return (
        F.when(facts_step, "step_definition").when(facts_hook, "hook").when(facts_test, "test_method")
        .when(kind_of_class == "page_object", "page_object_method").when(kind_of_class == "api_client", "api_method").when(kind_of_class == "helper", "helper_method")
        .otherwise("other")
    )


def visibility(modifiers: Column, default_private: Column) -> Column:
    """The visibility that an array of modifiers gives; without one, private for members, internal for types."""
    has = lambda m: F.array_contains(modifiers, m)
    return (
        F.when(has("public"), "public").when(has("protected") & has("internal"), "protected internal").when(has("protected"), "protected")
        .when(has("internal"), "internal").when(has("private") | default_private, "private").otherwise("internal")
    )


def classify(facts: DataFrame, options: ClassifierOptions = ClassifierOptions()) -> DataFrame:  # noqa: B008
    """facts (id, name, base_type_name, constructed_type_names, ...) with `kind`.

    A first pass knows no other class. Later ones look only at what is still `other`, with the kinds of page objects and
    API clients by name (the first of a name), until nothing changes or PASSES are done.
    """
    done = cut(facts.withColumn("kind", class_kind(F.lit(None).cast("string"), F.lit(False), options)))
    for _ in range(PASSES):
        first = F.row_number().over(W.partitionBy("name").orderBy("id"))
        named = done.withColumn("n", first).where("n = 1").where(F.col("kind").isin(*COLLABORATORS)).select(F.col("name").alias("known"), F.col("kind").alias("known_kind"))
        open_, closed = done.where("kind = 'other'"), done.where("kind <> 'other'")
        based = open_.join(named.withColumnRenamed("known_kind", "base_kind"), F.col("base_type_name") == F.col("known"), "left").drop("known")
        made = open_.select(F.col("id").alias("made_id"), F.explode("constructed_type_names").alias("t")).join(named.where("known_kind = 'api_client'"), F.col("t") == F.col("known"))
        made = made.select("made_id").distinct()
        next_ = based.join(made, F.col("id") == F.col("made_id"), "left")
        next_ = next_.withColumn("kind", class_kind(F.col("base_kind"), F.col("made_id").isNotNull(), options)).drop("base_kind", "made_id")
        changed = cut(next_)
        if changed.where("kind <> 'other'").isEmpty():
            break
        done = cut(closed.unionByName(changed))
    return done


def project_kind(classes: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, kind): step classes make a project bdd_tests, else test classes unit_tests, else any class shared_library."""
    seen = classes.groupBy("project_id").agg(F.bool_or(F.col("kind") == "step_class").alias("steps"), F.bool_or(F.col("kind") == "test_class").alias("tests"))
    out = projects.select("id").join(seen, F.col("id") == F.col("project_id"), "left")
    return out.select("id", F.when(F.col("steps"), "bdd_tests").when(F.col("tests"), "unit_tests").when(F.col("project_id").isNotNull(), "shared_library").otherwise("other").alias("kind"))


def diagnostic_of(message: Column, loaded: Column) -> Column:
    """struct(severity, code) of a workspace message; loaded: the project it names has content all the same.

    Loaded projects have warnings, but for a project file that couldn't be loaded, which is always an error.
    """
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda x: F.contains(m, F.lit(x))
    code = (
        F.when(has("unable to find package"), "nuget_missing_package")
        .when(has("has a known") & has("vulnerability"), "nuget_vulnerability")
        .when(has("no feature file was found"), "reqnroll_orphan_codebehind")
        .when(has("could not be loaded"), "project_load_failed")
        .otherwise("workspace_load")
    )
    severity = F.when(loaded & (code != "project_load_failed"), "warning").otherwise("error")
    return F.struct(severity.alias("severity"), code.alias("code"))


def outcome(n_projects: int, errors: int) -> str:
    """fatal without a C# project, warnings with an error, else success."""
    return "fatal" if not n_projects else "warnings" if errors else "success"
