"""Edges between classes, methods, endpoints and projects, resolved by name, and dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import COLLABORATORS


def inherits(derived: DataFrame, classes: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence) of classes (id, base_name) to classes (id, name): ambiguous with several targets."""
    t = classes.select(F.col("id").alias("to_id"), "name")
    out = derived.select(F.col("id").alias("from_id"), "base_name").join(t, F.col("base_name") == F.col("name")).where("from_id <> to_id")
    n = F.count(F.lit(1)).over(W.partitionBy("from_id"))
    return out.select("from_id", "to_id", F.when(n > 1, "ambiguous").otherwise("exact").alias("confidence"))


#: Targets (rows of an id and a name) up to which they are broadcast.
FEW_TARGETS = 1_000_000


def uses(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(method_id, class_id, confidence) of methods (id, class_id, names) to page objects and API clients (id, name, kind).

    A target is ambiguous if one of the names that lead to it leads to another class as well; the own class is none. How many
    classes a name leads to is counted before they are listed, so that the edges, which are as many as methods times classes of a
    name, aren't sorted or grouped: only those to classes of several names are.
    """
    spark = methods.sparkSession
    t = classes.where(F.col("kind").isin(*COLLABORATORS)).select(F.col("id").alias("to_id"), "name").distinct()
    named = methods.select(F.col("id").alias("method_id"), F.col("class_id").alias("own"), F.explode("names").alias("used")).distinct()
    sizes = t.groupBy(F.col("name").alias("s_name")).agg(F.count(F.lit(1)).alias("size"))
    mine = t.select(F.col("to_id").alias("o_id"), F.col("name").alias("o_name"))
    named = named.join(sizes, F.col("used") == F.col("s_name")).join(mine, (F.col("own") == F.col("o_id")) & (F.col("used") == F.col("o_name")), "left")
    named = named.select("method_id", "own", "used", (F.col("size") - F.col("o_id").isNotNull().cast("long") > 1).alias("unclear"))
    names = t.groupBy(F.col("to_id").alias("n_id")).agg(F.count(F.lit(1)).alias("names"))
    targets = t.join(names, F.col("to_id") == F.col("n_id")).select("to_id", "name", "names")
    if t.limit(FEW_TARGETS + 1).count() <= FEW_TARGETS:  # a name may lead to very many classes: its methods stay spread over the tasks
        named, targets = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "method_id", "used"), F.broadcast(targets)
    hit = named.join(targets, F.col("used") == F.col("name")).where("own <> to_id")
    one = hit.where("names = 1").select("method_id", F.col("to_id").alias("class_id"), "unclear")
    more = hit.where("names > 1").groupBy("method_id", F.col("to_id").alias("class_id")).agg(F.bool_or("unclear").alias("unclear"))
    return one.unionByName(more).select("method_id", "class_id", F.when(F.col("unclear"), "ambiguous").otherwise("exact").alias("confidence"))


def holds(holders: DataFrame, classes: DataFrame) -> DataFrame:
    """(from_id, to_id), distinct, of classes (id, names) that hold page objects or API clients."""
    t = classes.where(F.col("kind").isin(*COLLABORATORS)).select(F.col("id").alias("to_id"), "name")
    named = holders.select(F.col("id").alias("from_id"), F.explode("names").alias("held"))
    return named.join(t, F.col("held") == F.col("name")).where("from_id <> to_id").select("from_id", "to_id").distinct()


def references(refs: DataFrame, projects: DataFrame) -> DataFrame:
    """(from_id, to_id) of project references (from_id, name); the first project of a name is meant."""
    first = projects.groupBy("name").agg(F.min("id").alias("to_id"))
    return refs.join(first, "name").where("from_id <> to_id").select("from_id", "to_id").distinct()


def enrich_endpoints(endpoints: DataFrame, descriptors: DataFrame) -> DataFrame:
    """endpoints with path and target_api of the request class their route names; the last declared (place) wins."""
    d = descriptors.groupBy("class_name").agg(F.max_by("path", "place").alias("path"), F.max_by("target_api", "place").alias("target_api"))
    return endpoints.select("id", "verb", "route").join(d, F.col("route") == F.col("class_name"), "left").drop("class_name")


def gated_operations(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """The calls whose wrapper is the name of an API client."""
    clients = classes.where("kind = 'api_client'").select(F.col("name").alias("client")).distinct()
    return calls.join(clients, F.col("wrapper") == F.col("client"), "left_semi")


def numbered(df: DataFrame, order: list[Column | str], name: str = "id") -> DataFrame:
    """df with dense ids from 1 in the given order, in place of any column of that name.

    Ranges of the order are sorted and counted apart, then offset by the counts before them: no task sees all rows.
    """
    from .storage import cut

    parts = df.withColumn("__old", F.lit(0)).repartitionByRange(*order) if order else df
    parts = cut(parts.sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__part").orderBy("__row"))
    out = parts.join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(name, (F.col("__before") + place).cast("long"))
    return out.drop("__old", "__part", "__row", "__p", "__before")
