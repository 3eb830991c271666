"""Reachability by components and bits against a plain search."""

import random

import pytest

from stepweave.operators import graph as G
from stepweave.operators import reach
from stepweave.operators.storage import Scratch


def reached(seeds, edges):
    out, by, ways = set(), {}, {}
    for a, b in edges:
        ways.setdefault(a, []).append(b)
    for s, n in seeds:
        by.setdefault(s, set()).add(n)
    for s, start in by.items():
        seen, todo = set(start), list(start)
        while todo:
            for d in ways.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        out |= {(s, x) for x in seen}
    return out


def strong(edges):
    """Components of more than one node, by search both ways."""
    nodes = {x for e in edges for x in e}
    way = {n: {x for _, x in reached([(n, n)], edges)} for n in nodes}
    return {frozenset(m for m in way[n] if n in way[m]) for n in nodes if any(n in way[m] for m in way[n] - {n})}


def mixed(rng):
    """Rings, a tree with long twigs, a dense cyclic part, parallel ways, a chain into a ring, and edges at random among them."""
    ring = [(100 + k, 100 + (k + 1) % 12) for k in range(12)]
    twigs = [(200 + k, 200 + k + 1) for k in range(25)] + [(200 + k, 300 + k) for k in range(25)] + [(300 + k, 400 + k) for k in range(0, 25, 3)]
    dense = [(500 + rng.randrange(15), 500 + rng.randrange(15)) for _ in range(45)]
    ways = [(600, 601), (601, 605), (600, 602), (602, 603), (603, 605), (605, 600), (605, 605), (410, 100), (224, 500)]
    return ring + twigs + dense + ways + [(rng.choice([112, 210, 605, 505, 700]), rng.choice([105, 220, 603, 701])) for _ in range(5)]


@pytest.fixture(scope="module")
def graph(spark):
    edges = mixed(random.Random(3))
    return edges, spark.createDataFrame(edges, "src long, dst long")


def test_components(spark, graph):
    edges, df = graph
    with Scratch(spark) as scratch:
        rows = reach.components(scratch.cut, df).collect()
    assert len({r["node"] for r in rows}) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(g | {c}) for c, g in groups.items() if g | {c} != {c}} == strong(edges)


def test_a_node_between_cycles_is_on_none(spark):
    """99 has two ways in and two out, so it stays in the core, where it is the highest node of its colour."""
    ring = lambda *n: [(a, b) for a in n for b in n if a != b]
    edges = ring(1, 2, 3) + ring(11, 12, 13) + [(1, 99), (2, 99), (99, 11), (99, 12)]
    with Scratch(spark) as scratch:
        rows = reach.cycles(scratch.cut, spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted(map(tuple, rows)) == [(n, 1, 3) for n in (1, 2, 3)] + [(n, 11, 3) for n in (11, 12, 13)]


def test_both_ways_equal_a_search(spark, graph, monkeypatch):
    edges, df = graph
    rng = random.Random(4)
    nodes = [x for e in edges for x in e] + [999]
    seeds = [(k, rng.choice(nodes)) for k in range(140) for _ in range(1 + k % 2)]  # three words of bits
    s = spark.createDataFrame(seeds, "seed long, node long")
    want = reached(seeds, edges)
    assert {tuple(r) for r in G.closure(s, df).collect()} == want
    monkeypatch.setattr(G, "SMALL_GRAPH", 1)
    got = [tuple(r) for r in G.closure(s, df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_deep_chain_takes_few_tables(spark, monkeypatch):
    made = []
    plain = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df: made.append(1) or plain(self, df))
    numbers = []
    for n in (40, 640):
        made.clear()
        edges, seeds = [(k, k + 1) for k in range(n)], [(0, 3), (1, n // 2)]
        got = reach.closure(spark.createDataFrame(seeds, "seed long, node long"), spark.createDataFrame(edges, "src long, dst long"))
        assert got.count() == len(reached(seeds, edges))
        numbers.append(len(made))
    assert numbers[1] <= numbers[0] + 40  # sixteen times as deep: four doublings more in each of a few loops


def test_no_edges_and_no_seeds(spark):
    none = spark.createDataFrame([], "src long, dst long")
    one = spark.createDataFrame([(7, 1)], "seed long, node long")
    assert [tuple(r) for r in reach.closure(one, none).collect()] == [(7, 1)]
    assert reach.closure(one.where("false"), spark.createDataFrame([(1, 2)], "src long, dst long")).collect() == []
