"""Comparing maps by sums of row hashes, and finding what differs by descending a tree of ranges.

A range's digest is the number of its rows and four sums of parts of their SHA-256, so it doesn't depend on order or partitioning, and
the digest of a range is the sum of those of its parts. Ranges are of FANOUT ids, of FANOUT such ranges, and so on; rows without an id stand where a
hash of their line does. Two maps are equal if their tables' digests are; if not, only parts of ranges that differ are looked at, level
by level, down to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..testmap import TestMap
from .analytics import DUMPED, dump_lines
from .storage import Scratch, cut

FANOUT = 64
#: Places of rows without an id.
PLACES = 1 << 24
_TABLES = ["version", "meta", *DUMPED]
_SUMS = ["n", "h0", "h1", "h2", "h3"]


def lines(m: TestMap) -> DataFrame:
    """(table, at, line) of a map's canonical dump; at: a row's id, or a place that its line gives it."""
    name = F.element_at(F.array(*map(F.lit, _TABLES)), F.col("part") + 1)
    placed = F.pmod(F.xxhash64("line"), F.lit(PLACES)).cast("long")
    has_id = [t for t in DUMPED if DUMPED[t][1].startswith("id ")]
    rows = dump_lines(m).select(name.alias("table"), "at", "line")
    return rows.withColumn("at", F.when(F.col("table").isin(has_id) & F.col("at").isNotNull(), F.col("at")).otherwise(placed))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _leaves(rows: DataFrame) -> DataFrame:
    """(table, range, sums) of the lowest ranges."""
    digest = F.sha2(F.col("line").cast("binary"), 256)
    rows = rows.select("table", F.floor(F.col("at") / FANOUT).alias("range"), digest.alias("digest"))
    # A part is 60 bits: its halves add up in longs, and only a range's sums are decimals.
    part = lambda k: F.conv(F.substring("digest", 15 * k + 1, 15), 16, 10).cast("long").alias(f"h{k}")
    rows = rows.select("table", "range", *map(part, range(4)))
    halves = [f(F.col(f"h{k}")) for k in range(4) for f in (lambda h, k=k: F.sum(F.shiftright(h, 30)).alias(f"a{k}"), lambda h, k=k: F.sum(h.bitwiseAND((1 << 30) - 1)).alias(f"b{k}"))]
    sums = rows.groupBy("table", "range").agg(F.count(F.lit(1)).alias("n"), *halves)
    kind = "decimal(38,0)"
    whole = lambda k: (F.col(f"a{k}").cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.col(f"b{k}")).cast(kind).alias(f"h{k}")
    return sums.select("table", "range", F.col("n").cast(kind).alias("n"), *map(whole, range(4)))


def digests(m: TestMap) -> DataFrame:
    """(table, n, digest) of every table that has rows."""
    whole = _sums(_leaves(lines(m)), "table")
    return whole.select("table", F.col("n").cast("long").alias("n"), F.concat_ws("-", *[F.col(c).cast("string") for c in _SUMS[1:]]).alias("digest"))


def _unlike(left: DataFrame, right: DataFrame) -> DataFrame:
    """(table, range) where the sums aren't the same on both sides."""
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(2)))
    same = [F.count_distinct(c) == 1 for c in _SUMS]
    ok = F.count(F.lit(1)) == 2
    for s in same:
        ok = ok & s
    return both.groupBy("table", "range").agg(ok.alias("same")).where("not same").select("table", "range")


def differences(left: TestMap, right: TestMap) -> DataFrame:
    """(table, side, at, line): rows of one map alone, '-' of the left and '+' of the right; a row that one has more often, as often as it does."""
    with Scratch(left.meta.sparkSession) as scratch:
        sides = [scratch.cut(lines(m)) for m in (left, right)]  # made once, read for the digests and for the rows
        levels = [[scratch.cut(_leaves(rows)) for rows in sides]]
        while any(not x.where("range not in (0, -1)").isEmpty() for x in levels[-1]):
            up = F.floor(F.col("range") / FANOUT).alias("range")
            levels.append([scratch.cut(_sums(x.select("table", up, *_SUMS), "table", "range")) for x in levels[-1]])
        unlike = scratch.cut(_unlike(*levels.pop()))
        while levels:
            above = unlike.select(F.col("table").alias("u_table"), F.col("range").alias("u_range"))
            inside = [x.join(above, (F.col("table") == F.col("u_table")) & (F.floor(F.col("range") / FANOUT) == F.col("u_range")), "left_semi") for x in levels.pop()]
            unlike = scratch.cut(_unlike(*inside))
        found = unlike.select(F.col("table").alias("u_table"), F.col("range").alias("u_range"))
        own = [rows.join(found, (F.col("table") == F.col("u_table")) & (F.floor(F.col("at") / FANOUT) == F.col("u_range")), "left_semi").select("table", "at", "line") for rows in sides]
        own = [scratch.cut(x) for x in own]
        less, more = own[0].exceptAll(own[1]).withColumn("side", F.lit("-")), own[1].exceptAll(own[0]).withColumn("side", F.lit("+"))
        return cut(less.unionByName(more).select("table", "side", "at", "line"))
