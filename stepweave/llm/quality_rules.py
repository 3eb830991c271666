"""Quality rules: word statistics of a document, and lines that too many documents of its host share.

Native: DataFrame functions only. Words are never shuffled. What is shuffled is one
(host, line hash) pair for each distinct line of a document, summed map-side first, so that a line
which a third of all rows share costs a row for each task and not one for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HAS_WORD, normal_line, table, without, words_of

#: A line is common in a host when more documents than both of these have it.
MIN_DOCS = 10
MIN_SHARE = 0.02
#: A document is depleted when less than this share of its words is left.
MIN_LEFT = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def line_key(line: Column) -> Column:
    """Hash of a normalised line. A rare line is taken for a common one with odds of (common lines) / 2^64."""
    return F.xxhash64(normal_line(line))


def _repeat_words(h: Column) -> Column:
    """Words covered by windows of three whose hash occurs twice or more; h: a hash for each window.

    Sorted (hash, place) pairs put equal windows side by side, so the cost is n log n for a text of
    n words, however often its windows repeat.
    """
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), pairs)


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, in place of columns of these names.

    A null text counts as an empty one: all counts 0, base_failed true.
    """
    docs, w = without(docs, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]), "__words"
    out = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn(w, words_of(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(HAS_WORD))
    out = out.withColumn("__lines", lines).select(
        *[c for c in out.columns if c not in ("__text", w)],
        F.col(w),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    window = F.expr("transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2]))")
    none = F.expr("cast(array() as array<bigint>)")
    out = out.withColumn("__h", F.when(F.col("n_words") >= 3, window).otherwise(none)).drop(w)
    out = out.withColumn("__p", _repeat_words(F.col("__h"))).drop("__h")
    again = F.expr(
        "array_sort(transform(filter(__p, (x, j) -> (j > 0 and x.h = __p[greatest(j - 1, 0)].h)"
        " or (j < size(__p) - 1 and x.h = __p[least(j + 1, size(__p) - 1)].h)), x -> x.i))"
    )
    out = out.withColumn("__at", again).drop("__p")
    covered = F.expr("aggregate(__at, struct(-9 as last, 0L as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n)).n")
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # A filter on the verdict must not be pushed below the statistics: it would inline their nested expressions many times
    # over. It stops at a projection with a column that isn't deterministic, and `judge` uses that column.
    return out.withColumn("base_failed", failed).withColumn("__barrier", F.monotonically_increasing_id())


def _lines(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD))


def common_lines(docs: DataFrame, host: str, text: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line) of the lines in more documents of a host than min_docs and than min_share of them.

    Each row of docs is a document; a line that it repeats counts once. A null host is a host.
    """
    rows = docs.select(F.col(host).alias("host"), F.array_distinct(F.transform(_lines(text), line_key)).alias("keys"))
    counted = rows.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    hosts = docs.groupBy(F.col(host).alias("of")).agg(F.count(F.lit(1)).alias("size"))
    pairs = counted.where(F.col("n") > min_docs).join(hosts, F.col("host").eqNullSafe(F.col("of")))
    return pairs.where(F.col("n") > min_share * F.col("size")).select("host", "line")


def common_in_documents(docs: DataFrame, key: str, host: str, text: str = "text", **limits) -> DataFrame:
    """(key, total, removed, lines) of each key with common lines: its words, those in them, their hashes.

    Rows that share a key (or have none) are judged together.
    """
    cells = F.transform(_lines(text), lambda x: F.struct(line_key(x).alias("line"), F.size(words_of(x)).alias("n")))
    listed = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.explode(cells).alias("c")).select("key", "host", "c.*")
    common = common_lines(docs, host, text, **limits).select(F.col("host").alias("h"), F.col("line").alias("l"))
    hit = listed.join(common, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")), "left")
    is_hit = F.col("l").isNotNull()
    sums = hit.groupBy("key").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(is_hit, F.col("n")).otherwise(0)).alias("removed"),
        F.collect_set(F.when(is_hit, F.col("l"))).alias("lines"),
    )
    return sums.where("removed > 0")


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """docs with the base statistics, removed_words, __common (hashes of its common lines) and kept.

    A document is kept when its base rules pass and at least min_left of its words are outside common lines. These columns
    take the place of the caller's of the same names. Rows that share a key, or have none, are judged by all their lines together;
    repeated rows each count as a document. Null, empty and blank texts fail; a long text is a row like any other. Limits are
    passed by more, not by as many. An empty table gives no rows.
    """
    docs = without(docs, ["removed_words", "kept"])
    stats = base_statistics(docs, text)
    found = common_in_documents(docs, key, host, text, **limits)
    found = found.select(F.col("key").alias("__key"), F.col("total").alias("__total"), F.col("removed").alias("removed_words"), F.col("lines").alias("__common"))
    out = stats.join(found, F.col(key).eqNullSafe(F.col("__key")), "left")
    left = (F.col("__total") - F.col("removed_words")) >= min_left * F.col("__total")
    kept = ~F.col("base_failed") & (F.col("__barrier") >= 0) & F.coalesce(left, F.lit(True))
    return out.withColumn("kept", kept).withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).drop("__key", "__total", "__barrier")


def without_common_lines(text: Column, common: Column) -> Column:
    """The text without the lines whose hashes are listed; null or empty list: unchanged."""
    stays = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(HAS_WORD) & F.array_contains(common, line_key(x))))
    return F.when(F.size(F.coalesce(common, F.expr("cast(array() as array<bigint>)"))) > 0, F.array_join(stays, "\n")).otherwise(text)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select(*COLUMNS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's first stage: rejected documents go, the others lose their common lines.

    Null, empty and blank texts are rejected; repeated rows are documents each. An empty table gives no rows.
    """
    names = docs.columns
    out = judge(docs).where("kept").withColumn("text", without_common_lines(F.col("text"), F.col("__common")))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*names)


_S = r"[\x20\x09-\x0D]"
ORACLE = rf"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
win as (select doc_id, unnest(range(1, len(w) - 1)) i, w from w),
wk as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] k from win),
wd as (select doc_id, i, count(*) over (partition by doc_id, k) c from wk),
cov as (select distinct doc_id, i + o.o p from wd, (values (0), (1), (2)) o(o) where c > 1),
rep as (select doc_id, count(*) n from cov group by 1),
raw as (select doc_id, source, unnest(string_split(t, chr(10))) l from d),
ln as (select doc_id, source, l, regexp_replace(lower(l), '{_S}+', ' ', 'g') x, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) n from raw where regexp_matches(l, '[^\x20\x09-\x0D]')),
nl as (select doc_id, source, l, n, regexp_replace(x, '^ | $', '', 'g') k from ln),
dl as (select doc_id, count(*) - count(distinct l) n from nl group by 1),
cnt as (select source, k, count(distinct doc_id) c from nl group by 1, 2),
hs as (select source, count(*) s from d group by 1),
com as (select cnt.source, k from cnt join hs on cnt.source is not distinct from hs.source where c > {MIN_DOCS} and c > {MIN_SHARE} * s),
rm as (select nl.doc_id, sum(n) total, sum(case when com.k is null then 0 else n end) removed
       from nl left join com on nl.k = com.k and nl.source is not distinct from com.source group by 1),
b as (select w.doc_id, cast(len(w) as bigint) n_words, cast(length(regexp_replace(t, '{_S}+', '', 'g')) as bigint) word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols, cast(coalesce(dl.n, 0) as bigint) n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) n_repeat_words, cast(coalesce(rm.removed, 0) as bigint) removed_words, coalesce(rm.total, 0) total
  from w left join dl using (doc_id) left join rep using (doc_id) left join rm using (doc_id)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (total - removed_words >= {MIN_LEFT} * total) kept, removed_words from f
"""
