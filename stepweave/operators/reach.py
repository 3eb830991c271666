"""Reachability in graphs too large to broadcast: strongly connected components, then bits of seeds through the acyclic rest.

A cycle's nodes reach the same, so the graph is first condensed to its strongly connected components. What can't lie on a cycle is
raked off, chains are contracted by pointer jumping, and the core that is left is split by forward-backward colouring: the highest
node that reaches a node is its colour, and who reaches that one within the colour is its component. In the condensed graph, each
component has a bit for each seed, kept as rows (node, word, bits) of 64 seeds and only where a bit is set. Sinks are set aside and chains
contracted, round by round, before bits travel along what is left, and both get theirs when these have arrived. So a chain, or a tree
of any depth, takes a number of jobs that grows with the logarithm of its size.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, cut

Cut = Callable[[DataFrame], DataFrame]

WORD = 64
#: A round of contraction must leave less than this share of the edges for another one.
SHRINK = 0.9


def _chains(cut: Cut, edges: DataFrame) -> DataFrame:
    """(node, prev, next) of nodes with one edge in and one edge out."""
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("prev")).where("n_in = 1")
    outs = edges.groupBy(F.col("src").alias("o_node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("next")).where("n_out = 1")
    return cut(ins.join(outs, F.col("node") == F.col("o_node")).select("node", "prev", "next"))


def _jumped(cut: Cut, chains: DataFrame, step: str) -> DataFrame:
    """(node, end, open, least): the first node off the chain in the direction of `step`; open: there is none, the chain is a ring
    whose least node is `least`. Each turn doubles the way that is known."""
    on = chains.select(F.col("node").alias("on"))
    at = chains.join(on, F.col(step) == F.col("on"), "left").select("node", F.col(step).alias("end"), F.col("on").isNotNull().alias("open"), F.least("node", F.coalesce("on", "node")).alias("least"))
    at = cut(at)
    for _ in range(int(log2(max(2, at.count()))) + 2):
        if at.where("open").isEmpty():
            break
        then = at.select(F.col("node").alias("t_node"), F.col("end").alias("t_end"), F.col("open").alias("t_open"), F.col("least").alias("t_least"))
        met = at.join(then, F.col("open") & (F.col("end") == F.col("t_node")), "left")
        at = cut(met.select("node", F.coalesce("t_end", "end").alias("end"), F.coalesce("t_open", "open").alias("open"), F.least("least", F.coalesce("t_least", "least")).alias("least")))
    return at


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges neither of whose ends is among nodes (node)."""
    gone = nodes.select(F.col("node").alias("gone"))
    return edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")


def _bridges(cut: Cut, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, u, w) of the nodes of chains between nodes u and w that stay, and (node, least) of those of rings."""
    up, down = _jumped(cut, chains, "prev"), _jumped(cut, chains, "next").select(F.col("node").alias("d_node"), F.col("end").alias("w"))
    between = up.where("not open").join(down, F.col("node") == F.col("d_node")).select("node", F.col("end").alias("u"), "w")
    return cut(between), up.where("open").select("node", "least")


def components(cut: Cut, edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of cycles: the strongly connected component by one of its nodes. Other nodes are their own,
    and some of them are listed so."""
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct())
    stack: list[DataFrame] = []
    found: list[DataFrame] = []
    while (n := edges.count()) > 0:
        chains = _chains(cut, edges)
        if not chains.isEmpty():
            between, rings = _bridges(cut, chains)
            found.append(rings.select("node", F.col("least").alias("component")))
            stack.append(between)
            edges = _without(edges, chains).unionByName(between.select(F.col("u").alias("src"), F.col("w").alias("dst")).where("src <> dst")).distinct()
        # On a cycle, an edge's start has an edge in and its end has one out.
        ends, starts = edges.select(F.col("dst").alias("e")).distinct(), edges.select(F.col("src").alias("s")).distinct()
        edges = cut(edges.join(ends, F.col("src") == F.col("e"), "left_semi").join(starts, F.col("dst") == F.col("s"), "left_semi"))
        if edges.count() > SHRINK * n:
            own, edges = _coloured(cut, edges)
            found.append(own)
    none = edges.where(F.lit(False)).select(F.col("src").alias("node"), F.col("src").alias("component"))
    known = none
    for part in found:
        known = known.unionByName(part)
    known = cut(known)
    while stack:  # a chain from a component back to it is part of it
        between = stack.pop()
        of = lambda c: known.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_own"))  # noqa: B023, E731
        met = between.join(of("u"), F.col("u") == F.col("u_node"), "left").join(of("w"), F.col("w") == F.col("w_node"), "left")
        same = met.where(F.coalesce("u_own", "u") == F.coalesce("w_own", "w")).select("node", F.coalesce("u_own", "u").alias("component"))
        known = cut(known.unionByName(same))
    return known


def cycles(cut: Cut, edges: DataFrame) -> DataFrame:
    """(node, cycle, size) of the nodes that lie on a cycle with others: the least of them, and how many they are."""
    own = cut(components(cut, edges))
    members = own.unionByName(own.select(F.col("component").alias("node"), "component")).distinct()
    sizes = members.groupBy(F.col("component").alias("c")).agg(F.min("node").alias("cycle"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return members.join(sizes, F.col("component") == F.col("c")).select("node", "cycle", "size")


def _coloured(cut: Cut, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components of the highest nodes of each colour, the edges left inside of colours)."""
    ids = edges.select(F.col("src").alias("node")).unionByName(edges.select("dst").withColumnRenamed("dst", "node")).distinct()
    colour = cut(ids.withColumn("colour", F.col("node")))
    fresh = colour
    while not fresh.isEmpty():
        sent = edges.join(fresh, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("s_node")).agg(F.max("colour").alias("sent"))
        new = cut(colour.join(sent, F.col("node") == F.col("s_node"), "left").select("node", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") > F.col("colour")).alias("new")))
        colour, fresh = new.select("node", "colour"), new.where("new").select("node", "colour")
    a, b = (colour.select(F.col("node").alias(f"{c}_node"), F.col("colour").alias(f"{c}_colour")) for c in "ab")
    inside = edges.join(a, F.col("src") == F.col("a_node")).join(b, F.col("dst") == F.col("b_node")).where("a_colour = b_colour")
    inside = cut(inside.select("src", "dst", F.col("a_colour").alias("colour")))
    reached = fresh = cut(colour.where("node = colour"))
    while not fresh.isEmpty():
        back = inside.select("src", "dst").join(fresh, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "colour").distinct()
        fresh = cut(back.join(reached.select(F.col("node").alias("r_node")), F.col("node") == F.col("r_node"), "left_anti"))
        reached = cut(reached.unionByName(fresh))
    return reached.select("node", F.col("colour").alias("component")), cut(_without(inside.select("src", "dst"), reached))


def _joined(cut: Cut, *parts: DataFrame) -> DataFrame:
    """Bits of several tables (node, word, bits) as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))


def spread(cut: Cut, edges: DataFrame, bits: DataFrame) -> DataFrame:
    """(node, word, bits) of all that bits reach along the edges of an acyclic graph, their own nodes included."""
    edges, bits = cut(edges.select("src", "dst").distinct()), _joined(cut, bits)
    stack: list[tuple[DataFrame, DataFrame | None]] = []
    while (n := edges.count()) > 0:
        starts = edges.select(F.col("src").alias("s")).distinct()
        last = cut(edges.join(starts, F.col("dst") == F.col("s"), "left_anti"))
        edges = cut(edges.join(starts, F.col("dst") == F.col("s"), "left_semi"))
        stack.append((last, None))
        chains = _chains(cut, edges)
        if not chains.isEmpty():
            between, held, pushed = _prefixes(cut, chains, bits)
            stack.append((between.select(F.col("u").alias("src"), F.col("node").alias("dst")), held))
            bits = _joined(cut, bits, pushed)
            edges = cut(_without(edges, chains).unionByName(between.select(F.col("u").alias("src"), F.col("w").alias("dst"))).distinct())
        if edges.count() > SHRINK * n:
            break
    fresh = bits
    while not fresh.isEmpty() and not edges.isEmpty():
        sent = edges.join(fresh, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("s_node"), F.col("word").alias("s_word")).agg(F.bit_or("bits").alias("sent"))
        have = bits.select(F.col("node").alias("h_node"), F.col("word").alias("h_word"), F.col("bits").alias("have"))
        met = sent.join(have, (F.col("s_node") == F.col("h_node")) & (F.col("s_word") == F.col("h_word")), "left")
        new = F.col("sent").bitwiseAND(F.bitwise_not(F.coalesce("have", F.lit(0).cast("long"))))
        fresh = cut(met.select(F.col("s_node").alias("node"), F.col("s_word").alias("word"), new.alias("bits")).where("bits <> 0"))
        bits = _joined(cut, bits, fresh)
    while stack:
        ends, held = stack.pop()
        got = ends.join(bits, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "word", "bits")
        bits = _joined(cut, bits, got, *([held] if held is not None else []))
    return bits


def _prefixes(cut: Cut, chains: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((node, u, w) of chains, bits that chain nodes have from the chain up to them, bits that w has from all of it)."""
    between, _ = _bridges(cut, chains)
    on = chains.select(F.col("node").alias("on"))
    back = cut(chains.join(on, F.col("prev") == F.col("on"), "left").select(F.col("node").alias("c"), F.col("on").alias("before")))
    held = cut(bits.join(chains.select(F.col("node").alias("c")), F.col("node") == F.col("c"), "left_semi"))
    while not held.isEmpty() and not back.where("before is not null").isEmpty():
        got = back.join(held, F.col("before") == F.col("node")).select(F.col("c").alias("node"), "word", "bits")
        held = _joined(cut, held, got)
        then = back.select(F.col("c").alias("t"), F.col("before").alias("t_before"))
        back = cut(back.join(then, F.col("before") == F.col("t"), "left").select("c", F.col("t_before").alias("before")))
    last = chains.join(on, F.col("next") == F.col("on"), "left_anti").select(F.col("node").alias("l"), F.col("next").alias("w"))
    return between, held, held.join(last, F.col("node") == F.col("l")).select(F.col("w").alias("node"), "word", "bits")


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node): every node that a seed's nodes (seed, node) reach along edges (src, dst), the start included."""
    with Scratch(seeds.sparkSession) as scratch:
        return cut(_closure(scratch.cut, seeds, edges))


def _closure(cut: Cut, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    seeds = cut(seeds.select("seed", "node").distinct())
    own = cut(components(cut, edges))
    of = lambda c: own.select(F.col("node").alias(f"{c}_of"), F.col("component").alias(f"{c}_top"))
    tops = edges.join(of("s"), F.col("src") == F.col("s_of"), "left").join(of("d"), F.col("dst") == F.col("d_of"), "left")
    acyclic = tops.select(F.coalesce("s_top", "src").alias("src"), F.coalesce("d_top", "dst").alias("dst")).where("src <> dst")
    numbered = _numbered(cut, seeds.select("seed").distinct())
    starts = seeds.join(numbered.withColumnRenamed("seed", "n_seed"), F.col("seed").eqNullSafe(F.col("n_seed"))).join(of("n"), F.col("node") == F.col("n_of"), "left")
    bit = F.expr(f"shiftleft(1L, cast(number % {WORD} as int))")
    bits = starts.select(F.coalesce("n_top", "node").alias("node"), F.floor(F.col("number") / WORD).alias("word"), bit.alias("bits"))
    reached = spread(cut, acyclic, bits)
    each = F.expr(f"filter(sequence(0, {WORD - 1}), b -> getbit(bits, b) = 1)")
    pairs = reached.select(F.col("node").alias("top"), F.explode(F.transform(each, lambda b: F.col("word") * WORD + b)).alias("number"))
    pairs = pairs.join(numbered.withColumnRenamed("number", "k"), F.col("number") == F.col("k")).select("seed", "top")
    members = own.select(F.col("node").alias("m"), F.col("component").alias("c")).unionByName(own.select(F.col("component").alias("m"), F.col("component").alias("c"))).distinct()
    return pairs.join(members, F.col("top") == F.col("c"), "left").select("seed", F.coalesce("m", "top").alias("node")).distinct()


def _numbered(cut: Cut, seeds: DataFrame) -> DataFrame:
    """(seed, number): numbers from 0, dense but for the ends of partitions, so that words are full."""
    spread_out = cut(seeds)
    parts = spread_out.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    first, offsets = 0, {}
    for r in sorted(parts):
        offsets[r["p"]] = first
        first += r["n"]
    start = F.coalesce(*[F.when(F.col("p") == p, F.lit(n)) for p, n in offsets.items()], F.lit(0)) if len(offsets) <= 64 else None
    at = spread_out.withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    if start is None:
        table = spread_out.sparkSession.createDataFrame([(p, n) for p, n in offsets.items()], "o int, start long")
        return cut(at.join(F.broadcast(table), F.col("p") == F.col("o")).select("seed", (F.col("m") + F.col("start")).alias("number")))
    return cut(at.select("seed", (F.col("m") + start).cast("long").alias("number")))
