"""Links between items that share buckets, and connected components, with checkpoints in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few, release


#: Edges of a task.
EDGES = 1 << 17


def _are_stars(edges: DataFrame, n: int) -> bool:
    """Whether every u has one v, and no v is a u: then v is the component."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("top")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("top")))
    seen = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("top").alias("top"))
    return few(seen, n, EDGES).where("child > 1 or (child > 0 and top > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (u, v): the component is its least node. Nodes without a link don't occur.

    Alternating large and small stars: every pass groups by node with map-side minima and joins on it; a hub's rows can
    be split. The number of passes grows with the logarithm of the component's size. Tasks are as many as the edges ask for.
    """
    links = links.where("u <> v")
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = edges.count()
    edges = few(edges, n, EDGES)
    while not _are_stars(edges, n):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")), n, EDGES).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = few(both.join(least, F.col("u") == F.col("x")), n, EDGES).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = few(large.groupBy("u").agg(F.min("v").alias("m")), n, EDGES).withColumnRenamed("u", "x")
        joined = few(large.join(low, F.col("u") == F.col("x")), n, EDGES)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        edges = cut(few(small.distinct(), n, EDGES))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def shared_items(buckets: DataFrame) -> DataFrame:
    """The rows (bucket, item, ...) of buckets with more than one item, with the least of them as `lo`."""
    shared = buckets.groupBy("bucket").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo <> hi")
    return cut(buckets.join(shared.select("bucket", "lo"), "bucket").distinct())


def link_items(
    items: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int = 2, last: Callable[[DataFrame], DataFrame] | None = None, near: Callable[[Column, Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(links, groups): verified pairs (u, v) of items that share a bucket, enough to connect all that are similar.

    items: (bucket, item, mark, lo). First the least item lo of every bucket, then in each further round two pivots of it, others each time,
    are compared with the items of other components in it. The last round compares all pairs of different components that
    share a bucket; by then a group of near copies is one component, so their number isn't quadratic in its size.
    verify takes pairs (u, v), u > v, and returns those that are similar. near tells from two marks whether a pair can be
    similar at all. last takes the items (item) that share a bucket with another component after the rounds, and returns more
    selective buckets (bucket, item) for the last comparison.
    """
    near = near or (lambda a, b: F.lit(True))
    links = groups = None
    own = None
    for turn in range(rounds + 1):
        if turn == 0:
            found = items.where("item <> lo").select(F.col("item").alias("u"), F.col("lo").alias("v"))
        else:
            ends = F.min("component").alias("least"), F.max("component").alias("most")
            pivot = F.struct(F.xxhash64("item", F.lit(turn)).alias("h"), F.col("item").alias("pivot"), F.col("component").alias("p_comp"), F.col("mark").alias("p_mark"))
            some = [F.min(pivot).alias("p"), F.max(pivot).alias("q")] if turn < rounds else []
            mixed = own.groupBy("bucket").agg(*ends, *some).where("least <> most").drop("least", "most")
            at = own.join(mixed, "bucket")
        if 0 < turn < rounds:
            each = at.select("item", "component", "mark", F.explode(F.array("p", "q")).alias("p")).where((F.col("component") != F.col("p.p_comp")) & near(F.col("mark"), F.col("p.p_mark")))
            found = each.select(F.greatest("item", "p.pivot").alias("u"), F.least("item", "p.pivot").alias("v"))
        elif turn == rounds:
            if last is not None:
                mixed_items = cut(at.groupBy("item").agg(F.min("component").alias("component"), F.min("mark").alias("mark")))
                finer = last(mixed_items.select("item")).withColumnRenamed("item", "l_item")
                at = finer.join(mixed_items, F.col("l_item") == F.col("item"))
            at = cut(at.select("bucket", "item", "component", "mark"))
            b = at.select(F.col("bucket").alias("b2"), F.col("item").alias("other"), F.col("component").alias("other_comp"), F.col("mark").alias("other_mark"))
            meet = (F.col("bucket") == F.col("b2")) & (F.col("component") < F.col("other_comp")) & near(F.col("mark"), F.col("other_mark"))
            found = at.join(b, meet).select(F.greatest("item", "other").alias("u"), F.least("item", "other").alias("v"))
        found = cut(found.distinct())
        if links is not None and found.isEmpty():
            break
        new = cut(verify(found))
        if links is not None and new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        groups = cut(components(links))
        own = items.join(groups, items["item"] == groups["node"], "left").select("bucket", "item", "mark", F.coalesce("component", "item").alias("component"))
        release(items.sparkSession)
    return links, groups
