"""A stored positional index for phrase search.

A posting says that a term stands at a place of a column of a row: (term, id, column, at). Postings of a term are kept in blocks: a row's
block comes from a hash of its id, so that blocks are of about equal size however frequent a term is, and a block of a term is one row of a Parquet
table that is partitioned by a hash of the term and sorted by term and block. Texts are dealt by block before they are taken apart, so that a block's
occurrences are grouped where they arise, and only the grouped ones, as an array for each of id, row, column and place, are shuffled and written. A search reads the partitions of its own terms, the rarest
first; of the others only blocks in which the rarest occurs. The places of a phrase's terms, less each one's place in the phrase, must be the same.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import folded, search_phrases

#: Rows of the indexed table in a block, and in the table for each partition by term.
BLOCK_ROWS = 4096
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
#: Blocks of the rarest term that are named in the scan of the others; more are met by a join.
NAMED_BLOCKS = 1000
#: What a posting says of an occurrence.
FIELDS = ["id", "row", "column", "at"]


def tokens(column: Column) -> Column:
    """The terms of a text in order: lower case, without diacritics."""
    return F.array_remove(F.split(F.trim(folded(column)), " "), "")


def occurrences(df: DataFrame, key: str, columns: list[str], others: list[str] | None = None) -> DataFrame:
    """(term, id, row, column, at, others) of df's columns; the column by its place in the list, at from 0.

    row is a hash of a row's texts: of rows that share an id, it tells those apart whose texts differ.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("column"), tokens(F.col(c)).alias("own")) for k, c in enumerate(columns)]))
    others = others or []
    rows = df.select(*others, F.col(key).alias("id"), F.hash(*[F.col(c).cast("string") for c in columns]).alias("row"), each.alias("e"))
    return rows.select(*others, "id", "row", "e.column", F.posexplode("e.own").alias("at", "term"))


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, id, row, column, positions): the occurrences of a term in a text, in order."""
    return occurrences(df, key, columns).groupBy("term", "id", "row", "column").agg(F.array_sort(F.collect_set("at")).alias("positions"))


@dataclass
class SearchIndex:
    """An index that write_index() left at a path."""

    spark: SparkSession
    path: str
    buckets: int

    def _rows(self, terms: set[str]) -> DataFrame:
        """The blocks of some terms: reads their partitions alone."""
        wanted = sorted({_bucket(t, self.buckets) for t in terms})
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(sorted(terms)))
        # Indexes of older writers have the postings as an array of structs.
        return rows if "postings" in rows.columns else rows.select("term", "block", "n", F.arrays_zip(*FIELDS).alias("postings"))

    def ids(self, query: str) -> DataFrame:
        """(id): rows that have all phrases of a query, each in one column or another; a query without a letter or digit finds none."""
        phrases = [p.split(" ") for p in dict.fromkeys(search_phrases(query))]
        terms = {t for p in phrases for t in p}
        rows = self._rows(terms)
        none = rows.where(F.lit(False)).select(F.explode("postings.id").alias("id"))
        if not terms:
            return none
        known = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if len(known) < len(terms):
            return none
        rarest = min(terms, key=lambda t: (known[t], t))
        blocks = self._rows({rarest}).select("block").distinct()
        named = [r[0] for r in blocks.limit(NAMED_BLOCKS + 1).collect()]

        def of(term: str) -> DataFrame:
            own = self._rows({term})
            if term != rarest:
                own = own.where(F.col("block").isin(named)) if len(named) <= NAMED_BLOCKS else own.join(blocks, "block", "left_semi")
            return own.select(F.explode("postings").alias("p")).select("p.*")

        out = None
        for phrase in sorted(phrases, key=lambda p: min(known[t] for t in p)):
            hit = _phrase(phrase, known, of)
            out = hit if out is None else out.join(hit.withColumnRenamed("id", "h_id"), F.col("id").eqNullSafe(F.col("h_id")), "left_semi")
        return out

    def search(self, df: DataFrame, key: str, query: str) -> DataFrame:
        """The rows of the indexed table that ids() finds."""
        hit = self.ids(query).withColumnRenamed("id", "h_id")
        return df.join(hit, F.col(key).eqNullSafe(F.col("h_id")), "left_semi")


def _phrase(phrase: list[str], known: dict[str, int], of) -> DataFrame:
    """(id) of the rows that have the terms of a phrase one after the other in a column; from the rarest term on."""
    order = sorted(range(len(phrase)), key=lambda k: (known[phrase[k]], k))

    def starts(k: int) -> DataFrame:
        return of(phrase[k]).select("id", "row", "column", (F.col("at") - k).alias("start"))

    out = starts(order[0])
    for k in order[1:]:
        other = starts(k).toDF("o_id", "o_row", "o_column", "o_start")
        same = (F.col("row") == F.col("o_row")) & (F.col("column") == F.col("o_column")) & (F.col("start") == F.col("o_start"))
        out = out.join(other, F.col("id").eqNullSafe(F.col("o_id")) & same, "left_semi")
    return out.select("id").distinct()


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def write_index(df: DataFrame, key: str, columns: list[str], path: str) -> SearchIndex:
    """Indexes columns of df at path. A phrase stands in one text of one row; of rows that share a key, each phrase
    of a query may be found in another one. Null texts have no terms."""
    n = df.count()
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    blocks = max(1, -(-n // BLOCK_ROWS))
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")
    dealt = df.select(F.col(key).alias("__id"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(columns)], block.alias("__block")).repartition(blocks, "__block")
    rows = occurrences(dealt, "__id", [f"__{k}" for k in range(len(columns))], ["__block"])
    held = F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("held")
    grouped = rows.groupBy("term", F.col("__block").alias("block")).agg(held, F.count(F.lit(1)).alias("n"))
    grouped = grouped.select("term", "block", "n", *[F.col(f"held.{c}").alias(c) for c in FIELDS])
    grouped = grouped.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int"))
    # Partitions by term of very unequal size are split and joined by Spark as it writes.
    grouped = grouped.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
    grouped.write.partitionBy("bucket").parquet(f"{path}/postings")
    df.sparkSession.createDataFrame([(buckets, n)], "buckets int, rows long").coalesce(1).write.parquet(f"{path}/about")
    return SearchIndex(df.sparkSession, path, buckets)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(spark, path, spark.read.parquet(f"{path}/about").first()["buckets"])
