"""Document fingerprints: all shingle hashes below a fixed fraction of the hash range. Native.

Whether a hash is kept depends on the hash alone, so sketches of parts merge by union into the sketch of the whole, and the
share of a small document's hashes that a large one has estimates containment, however unequal the two are.
A sketch grows with its text; only texts of few shingles can have an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import cut, table, words_of

SHINGLE = 5
#: Hashes with KEEP_BITS leading zero bits are kept: a fraction of 1 / 2^KEEP_BITS.
KEEP_BITS = 2
CELLS = 1 << 16
BUCKET_BYTES = 12 << 20


def shingle_hashes(words: str, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles of an array column; fewer words than `size` make one shingle, none make none."""
    places = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(
        f"case when size({words}) >= {size} then transform(sequence(0, size({words}) - {size}), i -> xxhash64({places}))"
        f" when size({words}) > 0 then array(xxhash64(array_join({words}, ' '))) else cast(array() as array<bigint>) end"
    )


def with_sketch(df: DataFrame, text: str, name: str, size: int = SHINGLE, keep_bits: int = KEEP_BITS) -> DataFrame:
    """Adds array<bigint> `name`: the sorted distinct kept hashes of a text. A null text counts as empty."""
    rest = [c for c in df.columns if c != name]
    out = df.withColumn("__w", words_of(F.lower(F.col(text))))
    kept = F.filter(shingle_hashes("__w", size), lambda h: F.shiftrightunsigned(h, 64 - keep_bits) == 0)
    return out.select(*rest, F.array_sort(F.array_distinct(kept)).alias(name))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ",")


def merge(a: Column, b: Column) -> Column:
    """The sketch of a corpus from the sketches of its parts."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """The larger of both containments; two empty sketches are alike if the texts are the same, else not at all."""
    least = F.least(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1))
    return F.when(same, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(both.cast("double"))


def with_next(docs: DataFrame, key: str, text: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, text, sketch, next_text, next_sketch): each document with the next by ascending key, the last with the first.

    Keys are dealt into ranges of about bucket_bytes of text in one shuffle. The ranges come from at most CELLS equal
    stretches of the keys, each split further by its own extent if it holds more. Ranges grow beyond bucket_bytes where there
    would be more than about 3 * CELLS of them, so both small tables have a bound and may be broadcast. The first rows of a range also go to the end of the range before. Null keys come
    last; rows of one key are ordered by their text's hash. Keys that aren't numbers are placed by the first 7 bytes of their
    text. Rows of one key, or of keys with the same 7 bytes, are in one range, however many they are.
    """
    place = F.col(key)
    if not isinstance(docs.schema[key].dataType, NumericType):
        place = F.conv(F.rpad(F.hex(F.substring(F.col(key).cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = docs.select(F.col(key).alias("__key"), place.alias("__place"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    lo, hi = rows.agg(F.min("__place"), F.max("__place")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // CELLS + 1)
    cell = F.when(F.col("__place").isNull(), F.lit(CELLS + 1)).otherwise(F.floor((F.col("__place") - F.lit(lo or 0)) / F.lit(width)).cast("int"))
    rows = rows.withColumn("__cell", cell)
    cells = rows.groupBy("__cell").agg(F.sum(F.octet_length("__text") + 64).alias("bytes"), F.min("__place").alias("from"), F.max("__place").alias("to"))
    # At most about 3 * CELLS ranges come of this, so that their first keys may be broadcast too.
    aim = F.greatest(F.lit(float(bucket_bytes)), F.sum("bytes").over(W.partitionBy()) / CELLS)
    cells = cells.withColumn("aim", aim)
    parts = F.ceil(F.col("bytes") / F.col("aim")).cast("long")
    order = W.orderBy("__cell")
    # Cells below the size share a range with their neighbours; a larger one has ranges of its own.
    whole = F.floor((F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1) / F.col("aim"))
    cells = cells.withColumn("parts", parts).withColumn("start", F.when(F.col("parts") > 1, F.col("__cell") * 1.0).otherwise(-1.0 - whole))
    cells = cells.withColumn("group", F.sum(F.when(F.lag("start").over(order) == F.col("start"), 0).otherwise(1)).over(order))
    cells = cells.withColumn("step", F.when(F.col("parts") > 1, F.greatest(F.lit(1), F.floor((F.col("to") - F.col("from")) / F.col("parts")) + 1)).otherwise(F.lit(None)).cast("long"))
    cells = cut(cells.select(F.col("__cell").alias("c"), "group", F.col("from").alias("c_from"), "step"))
    placed = rows.join(F.broadcast(cells), F.col("__cell") == F.col("c"))
    sub = F.coalesce(F.floor((F.col("__place") - F.col("c_from")) / F.col("step")).cast("long"), F.lit(0))
    placed = placed.select("__key", "__text", F.struct(F.col("group").alias("g"), sub.alias("s")).alias("__range"))
    # The first key of each range, and the range before it (before the first: the last).
    firsts = placed.groupBy("__range").agg(F.min("__key").alias("k"))
    line = W.orderBy("__range")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("__range").over(line), F.last("__range").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    firsts = cut(firsts.select(F.col("__range").alias("r"), F.col("k"), F.col("before")))
    is_first = F.col("__key").eqNullSafe(F.col("k"))
    own = F.array(F.struct(F.col("__range").alias("range"), F.lit(0).alias("ghost")))
    ghost = F.array(F.struct(F.col("before").alias("range"), F.lit(1).alias("ghost")))
    dealt = placed.join(F.broadcast(firsts), F.col("__range") == F.col("r")).withColumn("__to", F.explode(F.when(is_first, F.concat(own, ghost)).otherwise(own)))
    dealt = dealt.select("__key", "__text", F.col("__to.range").alias("__range"), F.col("__to.ghost").alias("__ghost"))
    return with_sketch(dealt, "__text", "__sketch")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_likeness(docs)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and how alike they and the next document's are.

    Edited: the last floor(n / 4) code points replaced by as many of the next document's first, or all it has. Null texts count as
    empty; an empty text has an empty sketch, which is like another only if the texts are equal. Equal texts have equal fingerprints. A
    lone document is its own next one; repeated rows follow each other. Long texts are hashed whole. Other columns aren't looked at. An
    empty table gives no rows.
    """
    dealt = with_next(docs, key, text)
    order = W.partitionBy("__range").orderBy("__ghost", F.col("__key").asc_nulls_last(), F.xxhash64("__text"))
    after = dealt.withColumn("__next", F.lead(F.struct(F.col("__text").alias("text"), F.col("__sketch").alias("sketch"))).over(order)).where("__ghost = 0")
    n = F.length("__text")
    after = after.withColumn("n_chars", n).withColumn("__cut", F.floor(n / 4).cast("int"))
    edited = F.concat(F.expr("substring(__text, 1, n_chars - __cut)"), F.expr("substring(__next.text, 1, __cut)"))
    out = with_sketch(after.withColumn("__edited", edited), "__edited", "__edited_sketch")
    return out.select(
        F.col("__key").alias(key),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("__sketch")).alias("fingerprint"),
        fingerprint(F.col("__edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("__sketch"), F.col("__edited_sketch"), F.col("__edited") == F.col("__text")).alias("near_edited"),
        likeness(F.col("__sketch"), F.col("__next.sketch"), F.col("__next.text") == F.col("__text")).alias("near_next"),
    )
