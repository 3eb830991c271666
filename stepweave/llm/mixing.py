"""Mixing sources to target weights by a low-discrepancy schedule. Native: DataFrame functions only.

2^m points, SLOTS at least and so many that the least target has BLOCKS blocks, of the van der Corput sequence fall on the line of cumulative targets; each belongs to the source
whose stretch it hits, and the slots of a source are ranked in order. A source's documents lie shuffled on a line of
words, run through at most twice; its slot of rank r takes the block of words [r B, (r + 1) B) of that line, where B
is the same for all sources. So a source takes its line's first words up to its number of slots times B, within the
few slots by which the sequence differs from its target. Each document is told the slots at which its two laps begin; the mix
is the documents in the order of these slots. The first 2^m points are all multiples of 2^-m, each at the slot with its
digits mirrored, so the slot of a rank is found by counting multiples by their last digits, and slots are never listed.

Rows carry no text unless the caller wants it. Places on the lines come from sums over 4096 hash ranges of
each source and running sums inside one range, so no source, however large, is summed by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LAPS = 2
SLOTS = 1 << 16
BLOCKS = 16
CELLS = 1 << 12


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, laps: int = LAPS) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size), one row a source.

    Sources by code point, null last, get the weights in turn. Targets share `share` of all sizes by weight and stop at
    `laps` times their source; what is left over is shared again. In closed form: with sources ordered by the level
    at which they fill up, the first that doesn't at the level of the rest sets the level for all after it.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("at", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * F.lit(laps)).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level, every = W.orderBy("full_at", "at"), W.partitionBy()
    filled = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing))
    out = out.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - filled) / rest)
    out = out.withColumn("place", F.row_number().over(by_level))
    open_ = F.when(F.col("level") < F.col("full_at"), F.struct("place", "level"))
    out = out.withColumn("level", F.min(open_).over(every)["level"])
    target = F.when(F.col("level").isNull() | (F.col("full_at") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return out.select("source", "source_size", "weight", "at", target.alias("target"))


def van_der_corput(i: Column) -> Column:
    """i < 2^32 with its binary digits mirrored at the point."""
    return F.conv(F.reverse(F.lpad(F.bin(i), 32, "0")), 2, 10).cast("long") / F.lit(float(1 << 32))


def schedule(goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, source, rank) of the sources of targets(): which source each slot takes, and its how-manieth it is."""
    spark = goals.sparkSession
    line = W.orderBy("at")
    total = F.sum("target").over(W.partitionBy())
    end = F.sum("target").over(line)
    spans = goals.withColumn("hi", end / total).withColumn("lo", F.coalesce(F.lag("hi").over(line), F.lit(0.0)))
    spans = spans.withColumn("hi", F.when(F.lead("at").over(line).isNull(), F.lit(1.0)).otherwise(F.col("hi"))).where("target > 0 and lo < hi")
    cell = lambda x: F.floor(x * CELLS).cast("int")
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("x")).withColumn("p_cell", cell(F.col("x")))
    hit = points.join(spans, (F.col("p_cell") == F.col("cell")) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    return hit.select("slot", "source", "at", (F.row_number().over(W.partitionBy("at").orderBy("slot")) - 1).alias("rank"))


def shares(goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """goals with slots (a power of two, `slots` at least), the block of words of a slot, and n_slots of each source.

    The least positive target has BLOCKS blocks or more. The first 2^m points of the sequence are the multiples of 2^-m, so
    those in a source's stretch are counted without listing them.
    """
    every, line = W.partitionBy(), W.orderBy("at")
    total, least = F.sum("target").over(every), F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    out = goals.withColumn("__total", total)
    out = out.withColumn("slots", F.greatest(F.lit(float(slots)), F.pow(F.lit(2.0), F.ceil(F.log2(BLOCKS * F.col("__total") / least)))))
    out = out.withColumn("hi", F.sum("target").over(line) / F.nullif(F.col("__total"), F.lit(0.0)))
    out = out.withColumn("lo", F.coalesce(F.lag("hi").over(line), F.lit(0.0)))
    out = out.withColumn("hi", F.when(F.lead("at").over(line).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
    n = F.ceil(F.col("hi") * F.col("slots")) - F.ceil(F.col("lo") * F.col("slots"))
    out = out.withColumn("__a", F.ceil(F.col("lo") * F.col("slots")).cast("long")).withColumn("__b", F.ceil(F.col("hi") * F.col("slots")).cast("long"))
    out = out.withColumn("n_slots", F.when(F.col("target") > 0, n).otherwise(F.lit(0))).withColumn("block", F.col("__total") / F.col("slots"))
    return out.withColumnsRenamed({"__a": "first_point", "__b": "end_point"}).drop("__total", "hi", "lo")


def slot_of(rank: Column, first: Column, end: Column, slots: Column) -> Column:
    """The slot of a rank (from 0) of the source with the points first .. end - 1, in units of 1 / slots.

    Slots are in order of a point's digits from the last on. At each digit the points that go on with 0 are counted: if
    there are more than the rank, the digit is 0, else it is 1 and they are left behind.
    """
    state = F.struct(rank.cast("long").alias("rank"), F.lit(0).cast("long").alias("tail"), F.lit(1).cast("long").alias("unit"), slots.cast("long").alias("place"), F.lit(0).cast("long").alias("slot"))
    upto = lambda x, s: F.floor((x - s["tail"] + 2 * s["unit"] - 1) / (2 * s["unit"])).cast("long")  # noqa: E731  multiples of 2 unit, plus tail, below x

    def step(s: Column, _: Column) -> Column:
        n = upto(end, s) - upto(first, s)
        one = s["rank"] >= n
        half = F.floor(s["place"] / 2).cast("long")
        return F.struct(
            F.when(one, s["rank"] - n).otherwise(s["rank"]).alias("rank"), F.when(one, s["tail"] + s["unit"]).otherwise(s["tail"]).alias("tail"),
            (2 * s["unit"]).alias("unit"), half.alias("place"), F.when(one, s["slot"] + half).otherwise(s["slot"]).alias("slot"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(F.log2(slots)).cast("int"))), state, step, lambda s: s["slot"])


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None, slots: int = SLOTS, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """key, size, source_size, target, taken, slot, slot2 and __lap0, __lap1 (words taken of each lap), with the columns `keep`.

    slot and slot2: where the words of each lap begin in the mix; null for a lap that takes none. Documents without words (null
    and empty texts) are taken 0 times. Rows that share a key, repeated ones too, are documents of their own. Documents of one hash are in order of
    their key and size. A null source is a source, the last. Long texts are one row. Other columns aren't looked at, so their
    names may clash; those of `keep` come back as __keep_name. An empty table gives no rows.
    """
    keep = keep or []
    rows = docs.select(F.col(key).alias("__key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    rows = rows.withColumn("__order", F.md5(F.coalesce(F.col("__key").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("__cell", F.substring("__order", 1, 3))
    # Never null, so that rows and their cells are joined where the window has dealt the rows, and texts aren't shuffled again.
    rows = rows.withColumn("__of", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    cells = rows.groupBy("source", "__of", "__cell").agg(F.sum("size").alias("cell_size"))
    cells = cells.withColumn("cell_start", F.sum("cell_size").over(W.partitionBy("source").orderBy("__cell")) - F.col("cell_size"))
    goals = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share)
    goals = shares(goals, slots)
    goals = goals.withColumn("words", F.least(F.floor(F.coalesce("n_slots", F.lit(0)) * F.col("block") + 0.5).cast("long"), LAPS * F.col("source_size")))
    plan = ["n_slots", "block", "slots", "first_point", "end_point"]
    goals = goals.select(F.col("source").alias("g_source"), "source_size", "target", "words", *plan)
    known = cells.join(goals, F.col("source").eqNullSafe(F.col("g_source"))).select(F.col("__of").alias("c_of"), F.col("__cell").alias("c_cell"), "cell_start", "source_size", "target", "words", *plan)
    inside = W.partitionBy("__of", "__cell").orderBy("__order", "__key", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("__end", F.sum("size").over(inside))
    placed = placed.join(known, (F.col("__of") == F.col("c_of")) & (F.col("__cell") == F.col("c_cell")))
    start = F.col("cell_start") + F.col("__end") - F.col("size")
    lap = lambda upto: F.greatest(F.lit(0), F.least(F.col("size"), upto - start))
    first, second = F.least(F.col("words"), F.col("source_size")), F.greatest(F.lit(0), F.col("words") - F.col("source_size"))
    placed = placed.withColumn("__lap0", lap(first).cast("long")).withColumn("__lap1", lap(second).cast("long"))
    rank = lambda at: F.greatest(F.lit(0), F.least(F.floor(at / F.col("block")).cast("long"), F.col("n_slots").cast("long") - 1))
    slot = lambda at: slot_of(rank(at), F.col("first_point"), F.col("end_point"), F.col("slots"))
    placed = placed.withColumn("slot", F.when(F.col("__lap0") > 0, slot(start))).withColumn("slot2", F.when(F.col("__lap1") > 0, slot(start + F.col("source_size"))))
    return placed.select(F.col("__key").alias(key), "size", "source_size", "target", (F.col("__lap0") + F.col("__lap1")).alias("taken"), "slot", "slot2", "__lap0", "__lap1", *[F.col(f"__keep_{c}") for c in keep])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "slot", "slot2")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's mixing stage: a row for each lap that takes words of a document, with the text that it takes.

    Whole documents stay as they are; the one document of a source at which a lap's last block ends keeps its first words. Rows are
    written in the order of their slots. Documents without words aren't taken; an empty table gives no rows.
    """
    names = docs.columns
    out = mix(docs, keep=names).withColumn("__lap", F.explode(F.array(F.struct(F.col("__lap0").alias("part"), F.col("slot").alias("at")), F.struct(F.col("__lap1").alias("part"), F.col("slot2").alias("at")))))
    out = out.where("__lap.part > 0").withColumn("__part", F.col("__lap.part")).orderBy("__lap.at", "__keep_doc_id")
    text = F.col("__keep_text")
    cut = F.array_join(F.slice(words_of(text), 1, F.greatest(F.col("__part").cast("int"), F.lit(1))), " ")
    out = out.withColumn("__text", F.when(F.col("__part") < F.col("size"), cut).otherwise(text))
    cols = {c: F.col(f"__keep_{c}") for c in names}
    cols["text"], cols["n_chars"] = F.col("__text"), F.length("__text").cast("long")
    return out.select(*[cols[c].alias(c) for c in names])


ORACLE = f"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size, md5(coalesce(cast(doc_id as varchar), '')) o from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by 1),
r as (select *, row_number() over (order by source asc nulls last) - 1 pos from s),
w as (select *, case pos % 3 when 0 then 5 when 1 then 2 else 1 end weight, 2 * source_size cap from r),
l as (select *, cap / weight full_at, row_number() over (order by cap / weight, pos) place from w),
v as (select *, ({SHARE} * sum(source_size) over () - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0))
   / sum(weight) over (order by place rows between current row and unbounded following) level from l),
m as (select arg_min(level, place) lv from v where level < full_at),
t as (select source, source_size, pos, cast(case when lv is null or full_at <= lv then cap else weight * lv end as double) target from v cross join m),
c as (select *, sum(target) over (order by pos) / sum(target) over () hi, sum(target) over () / {SLOTS} block, max(pos) over () mx from t),
e as (select *, coalesce(lag(hi) over (order by pos), 0.0) lo, case when pos = mx then 1.0 else hi end top from c),
p as (select i, list_sum(list_transform(range(32), lambda k: ((i >> k) & 1) / (2.0 ** (k + 1)))) x from range({SLOTS}) g(i)),
n as (select pos, count(*) n from p join e on x >= lo and x < top and target > 0 group by 1),
rk as (select pos, i, row_number() over (partition by pos order by i) - 1 r from p join e on x >= lo and x < top and target > 0),
g as (select e.pos, coalesce(n.n, 0) n, block, e.source, source_size, target, least(cast(floor(coalesce(n.n, 0) * block + 0.5) as bigint), {LAPS} * source_size) words from e left join n using (pos)),
q as (select d.doc_id, size, g.pos, n, block, g.source_size, g.target, words, sum(size) over (partition by d.source order by o, doc_id, size rows unbounded preceding) - size st
   from d join g on d.source is not distinct from g.source),
t2 as (select *, greatest(0, least(size, least(words, source_size) - st)) a, greatest(0, least(size, greatest(0, words - source_size) - st)) b from q)
select doc_id, size, source_size, target, cast(a + b as bigint) taken, r1.i slot, r2.i slot2 from t2
  left join rk r1 on a > 0 and r1.pos = t2.pos and r1.r = greatest(0, least(cast(floor(st / block) as bigint), n - 1))
  left join rk r2 on b > 0 and r2.pos = t2.pos and r2.r = greatest(0, least(cast(floor((st + source_size) / block) as bigint), n - 1))
"""
