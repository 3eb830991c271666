"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

Every row has a 60-bit hash, read as binary digits. A bucket is a prefix; it splits on one more digit while its bytes
exceed the limit. Bytes of prefixes add up, so the buckets of all depths come from one grouping of the rows at
the first of LEVELS digits (map-side sums first) and roll-ups of that table; a prefix still too large there is grouped at the
next of LEVELS, among its own rows only. Rows with one hash can't be parted by digits: if they alone exceed the limit,
the bucket is filled page by page, and one row above the limit is a shard of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

LIMIT = 8 << 20
#: The registered query's limit: so small that the generated tables of every size split.
QUERY_LIMIT = 64 << 10
#: Buckets of at most 100 bytes each that are broadcast to find those of hashes; more are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
DIGITS = 60
#: Digits at which rows are grouped in turn. The steps grow as fewer prefixes are left too large.
LEVELS = (12, 16, 24, 36, DIGITS)


def hash_digits(key: Column) -> Column:
    """60 binary digits of a key, the same in all engines; a null key has a hash as well."""
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, DIGITS // 4)
    return F.lpad(F.conv(hexed, 16, 2), DIGITS, "0")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(prefix, depth, bytes) of the buckets of rows (digits, bytes): the shortest prefixes within the limit.

    Buckets of 60 digits may exceed it.
    """
    open_, found, base = rows, None, 0
    for top in LEVELS:
        sums = cut(open_.groupBy(F.substring("digits", 1, top).alias("prefix")).agg(F.sum("bytes").alias("bytes")))
        depths = F.sequence(F.lit(base if base == 0 else base + 1), F.lit(top))
        levels = sums.withColumn("depth", F.explode(depths)).withColumn("p", F.expr("substring(prefix, 1, depth)"))
        levels = cut(levels.groupBy("p", "depth").agg(F.sum("bytes").alias("bytes")))
        fits = (F.col("bytes") <= limit) | (F.col("depth") == DIGITS)
        parents = levels.where(F.col("bytes") > limit).select(F.col("p").alias("up"))
        leaves = levels.where(fits)
        if base == 0:
            root = leaves.where("depth = 0")
            leaves = leaves.where("depth > 0").join(parents, F.expr("substring(p, 1, depth - 1)") == F.col("up"), "left_semi").unionByName(root)
        else:
            up = F.expr("substring(p, 1, depth - 1)")
            leaves = leaves.where(F.col("depth") == base + 1).unionByName(leaves.where(F.col("depth") > base + 1).join(parents, up == F.col("up"), "left_semi"))
        found = leaves if found is None else found.unionByName(leaves)
        if top == DIGITS:
            break
        large = cut(levels.where((F.col("depth") == top) & (F.col("bytes") > limit)).select(F.col("p").alias("large")))
        if large.isEmpty():
            break
        open_ = cut(open_.join(large, F.substring("digits", 1, top) == F.col("large"), "left_semi"))
        base = top
    return found.select(F.col("p").alias("prefix"), "depth", "bytes")


MADE = ["shard", "depth", "bytes", "shard_bytes"]


def shard(df: DataFrame, key: str = "doc_id", payload: str = "text", limit: int = LIMIT) -> DataFrame:
    """df with shard (prefix and page), depth, bytes, shard_bytes, in place of columns of these names.

    bytes: of the payload, null and empty 0. Every shard holds at most `limit` bytes unless it is one row, however long.
    Null keys, and rows with one key, share a hash; if they exceed the limit they are paged in order of their bytes, and which of equally long
    rows is on which of two pages is open. An empty table has no shards.
    """
    names = [c for c in df.columns if c not in MADE]
    rows = df.withColumn("__digits", hash_digits(F.col(key))).withColumn("__bytes", F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")).select(*names, "__digits", "__bytes")
    each = cut(rows.groupBy(F.col("__digits").alias("digits")).agg(F.sum("__bytes").alias("bytes")))
    buckets = cut(directory(each, limit))
    # A hash's bucket is found by its prefixes of the depths in use; rows, with all that they carry, then join their hash.
    depths = [r[0] for r in buckets.select("depth").distinct().orderBy("depth").collect()]
    prefixes = F.explode(F.array(*[F.substring("digits", 1, d) for d in depths])) if depths else F.lit(None).cast("string")
    b = buckets.select(F.col("prefix").alias("__prefix"), F.col("depth").alias("__depth"), F.col("bytes").alias("__bucket"))
    b = F.broadcast(b) if buckets.count() <= BROADCAST_BUCKETS else b
    placed = each.select(F.col("digits").alias("__hash"), prefixes.alias("__p")).join(b, (F.col("__p") == F.col("__prefix")) & (F.length("__p") == F.col("__depth"))).drop("__p")
    return _paged(rows.join(placed, F.col("__digits") == F.col("__hash")).drop("__hash"), names, limit)


def _paged(out: DataFrame, names: list[str], limit: int) -> DataFrame:
    """Buckets of one hash above the limit are filled page by page, in the order of the payload's size."""
    fits = out.where(F.col("__bucket") <= limit).withColumn("__page", F.lit(0).cast("long")).withColumn("__shard", F.col("__bucket"))
    over = out.where(F.col("__bucket") > limit)
    before = F.sum("__bytes").over(W.partitionBy("__prefix").orderBy("__bytes").rowsBetween(W.unboundedPreceding, 0)) - F.col("__bytes")
    half = F.lit(max(1, limit // 2))
    over = over.withColumn("__big", F.col("__bytes") > half)
    small = over.where("not __big").withColumn("__page", F.floor(before / half).cast("long"))
    big = over.where("__big").withColumn("__page", -F.row_number().over(W.partitionBy("__prefix").orderBy("__bytes")).cast("long"))
    paged = small.unionByName(big).drop("__big")
    paged = paged.withColumn("__shard", F.sum("__bytes").over(W.partitionBy("__prefix", "__page")))
    got = fits.unionByName(paged)
    name = F.when(F.col("__page") == 0, F.col("__prefix")).otherwise(F.concat("__prefix", F.lit("."), F.col("__page").cast("string")))
    return got.select(*names, name.alias("shard"), F.col("__depth").alias("depth"), F.col("__bytes").alias("bytes"), F.col("__shard").alias("shard_bytes"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", payload: str = "text", limit: int = LIMIT) -> None:
    """Writes a folder of Parquet for each shard; a shard is one task, as it fits the limit."""
    out = shard(df, key, payload, limit)
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, limit=QUERY_LIMIT).select("doc_id", "shard", "depth", "bytes", "shard_bytes")


ORACLE = f"""
with recursive d as (select doc_id, strlen(coalesce(text, '')) bytes, md5(coalesce(cast(doc_id as varchar), 'null')) h from documents),
b as (select doc_id, bytes, array_to_string(list_transform(range(1, {DIGITS // 4 + 1}), lambda k: lpad(bin(cast('0x' || h[k] as integer)), 4, '0')), '') digits from d),
lv as (select l depth, left(digits, l) p, sum(bytes) bytes from b, range(0, {DIGITS + 1}) r(l) group by 1, 2),
leaf as (select * from lv where (bytes <= {QUERY_LIMIT} or depth = {DIGITS}) and (depth = 0 or exists (select 1 from lv u where u.depth = lv.depth - 1 and u.p = left(lv.p, lv.depth - 1) and u.bytes > {QUERY_LIMIT}))),
rs as (select doc_id, p, depth, b.bytes, leaf.bytes whole, b.bytes > {QUERY_LIMIT // 2} big from b join leaf on left(b.digits, leaf.depth) = leaf.p),
pg as (select *, case when whole <= {QUERY_LIMIT} then 0 when big then -row_number() over (partition by p, big order by bytes)
  else (sum(bytes) over (partition by p, big order by bytes rows unbounded preceding) - bytes) // {QUERY_LIMIT // 2} end page from rs)
select doc_id, case when page = 0 then p else p || '.' || cast(cast(page as bigint) as varchar) end shard, cast(depth as integer) depth, cast(bytes as bigint) bytes,
  cast(sum(bytes) over (partition by p, page) as bigint) shard_bytes from pg
"""
