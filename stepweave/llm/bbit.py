"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles; texts of one set form a class and are handled once. Of each of BANDS * ROWS MinHash
values the low BITS bits are kept, packed into a signature of a few machine words; before that, the full values give a key
for each band. Classes that share a band are candidates. Their similarity is estimated from the number of packed values that agree,
less what agrees by chance (2^-BITS of the rest), and pairs are dropped where so few agree that a similar pair would
with odds below TOLERANCE. All links are confirmed on the full sets.

Every bucket's members first meet its least member: each member is compared with the best estimated of its candidates, then with the
others that it isn't yet connected with. What then is left, members of one bucket in different components, meets as pairs, each once for all its buckets,
if the bucket has at most SMALL, or else in blocks, where packed signatures
are compared in arrays and only pairs of components that aren't yet connected are confirmed. So no row is made for each pair of a
group, while no pair that shares a band is passed over but those that are already connected. At the threshold of 0.85 a pair shares
none of 32 bands of 6 values with odds of 3e-7.

Null, empty and blank texts have an empty set and are linked with nothing; fewer words than a shingle are one shingle as a whole.
Rows that share a key are rows of their own, and a component's id is its least key; null keys only name a component
that has no other. An empty table gives no rows. Columns other than key and text aren't looked at, so their names may clash.
Long texts are one row as any other; blocks are bounded by bytes, too. Sets are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, few, shared_folder, table
from .graph import components, shared_items
from .jaccard_join import _slices, all_pairs
from .shingles import mix
from .tokens import BETWEEN_WORDS, shingles, tokens

SHINGLE = 3
#: Similarity in percent from which documents are linked.
PERCENT = 85
BANDS, ROWS = 32, 6
BITS = 2
TOLERANCE = 1e-9
BLOCK = 1024
SMALL = 16  # members of a bucket up to which its pairs are rows
#: Pairs of a task that are estimated, and pairs or rows of buckets of which the full sets are compared.
ESTIMATED, COMPARED = 1 << 17, 1 << 11
_VALUES = BANDS * ROWS
_rng = np.random.default_rng(12)
_A = _rng.integers(0, 1 << 31, _VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, _VALUES, dtype=np.uint32)
#: One bit of each packed value.
_ONES = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


@lru_cache(maxsize=8)
def least_matches(percent: int = PERCENT, tolerance: float = TOLERANCE) -> int:
    """The most agreeing values that a pair at the threshold falls short of with odds of at most the tolerance."""
    chance = 2.0**-BITS
    p, below = chance + (1 - chance) * percent / 100, 0.0
    for m in range(_VALUES + 1):
        below += comb(_VALUES, m) * p**m * (1 - p) ** (_VALUES - m)
        if below > tolerance:
            return m
    return _VALUES


def estimate(matches):
    """Similarity from the number of agreeing values, corrected for those that agree by chance."""
    chance = 2.0**-BITS
    return np.maximum(0.0, (matches / _VALUES - chance) / (1 - chance))


def minima(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minima (texts x values) of as many hash functions over each text's shingles; zeros for texts without shingles."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, _VALUES), np.uint32)
    if len(full):
        x, starts = (h >> np.uint64(32)).astype(np.uint32), offsets[:-1][full]
        for p in range(_VALUES):
            out[full, p] = np.minimum.reduceat(x * _A[p] + _B[p], starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(values), BANDS))
    for r in range(ROWS):
        h = mix(h ^ values[:, r::ROWS].astype(np.uint64))
    return h


def packed(values: np.ndarray) -> np.ndarray:
    """Signatures (texts x machine words) of the low bits of the minima; a minimum's bits are spread first, as minima are small."""
    low = mix(values.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    low = np.pad(low, ((0, 0), (0, -_VALUES % per))).reshape(len(values), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), 2)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of values that agree, by counting bits along the last axis."""
    x, width = a ^ b, 1
    while width < BITS:
        x = x | (x >> np.uint64(width))
        width *= 2
    return _VALUES - np.bitwise_count(x & _ONES).sum(-1, dtype=np.int64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    h, at = shingles(tokens(texts, BETWEEN_WORDS), SHINGLE)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold, in integers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _signed(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sig, n, bits, bands) of each row, written once; sig stands for the set of shingles, n is its size.

    A text without words has neither bits nor bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1, 1 << 18):
                h, at = shingles(tokens(batch.column(1), BETWEEN_WORDS), SHINGLE)
                sets = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                v = minima(h, at)
                bits = pa.array([x.tobytes() if len(s) else None for x, s in zip(packed(v), sets, strict=True)], pa.binary())
                bands = pa.array([x if len(s) else None for x, s in zip(band_keys(v).view(np.int64), sets, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), _signed(sets), pa.array([len(s) for s in sets], pa.int64()), bits, bands], [key, "sig", "n", "bits", "bands"])

    path = f"{shared_folder(docs.sparkSession)}/features"
    docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, sig long, n long, bits binary, bands array<long>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def texts_of(docs: DataFrame, text: str, sigs: DataFrame) -> DataFrame:
    """(sig, text) of one row of each class of sigs (sig), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 0):
                yield pa.RecordBatch.from_arrays([_signed(shingle_sets(batch.column(0))), batch.column(0)], ["sig", "text"])

    wanted = checked_broadcast(sigs.select(F.col("sig").alias("w_sig")))
    found = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "sig long, text string").join(wanted, F.col("sig") == F.col("w_sig"), "left_semi")
    path = f"{shared_folder(docs.sparkSession)}/texts"
    found.dropDuplicates(["sig"]).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def estimated(pairs: DataFrame, bits: DataFrame, percent: int, rows: int) -> DataFrame:
    """(u, v, matches) of the pairs (u, v), `rows` at most, whose estimate doesn't rule a link out. bits: (sig, bits)."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (2, 3))
            n = agreeing(a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["u", "v", "matches"]).filter(pa.array(n >= least))

    of = lambda c: bits.select(F.col("sig").alias(f"{c}_sig"), F.col("bits").alias(f"{c}_bits"))
    both = pairs.join(of("u"), F.col("u") == F.col("u_sig")).join(of("v"), F.col("v") == F.col("v_sig"))
    return few(both.select("u", "v", "u_bits", "v_bits"), rows, ESTIMATED).mapInArrow(run, "u long, v long, matches long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs (u, v), `rows` at most, that the full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in _slices(whole, 2):
                left, keep = shingle_sets(batch.column(2)), []
                for k, v in enumerate(batch.column(1).to_pylist()):
                    if v not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[v] = shingle_sets(batch.column(3).slice(k, 1))[0]
                    keep.append(linked(left[k], known[v], percent))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: texts.select(F.col("sig").alias(f"{c}_sig"), F.col("text").alias(f"{c}_text"))
    both = pairs.join(of("u"), F.col("u") == F.col("u_sig")).join(of("v"), F.col("v") == F.col("v_sig"))
    return few(both.select("u", "v", "u_text", "v_text"), rows, COMPARED).mapInArrow(run, "u long, v long")


def bucket_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """For a task that holds two blocks of a bucket: links (u, v) enough to connect all that are similar and not yet in one group.

    A pair is looked at in the first of its shared bands only. There it has met as a star or as a pair of a small bucket, is in one group, or meets in this bucket.
    """
    least = least_matches(percent)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("item")
        own, item, group = (rows[c].to_numpy() for c in ("own", "item", "group"))
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(item), -1)
        bands = rows["bands"].combine_chunks()
        bands = (pa.concat_arrays(bands.chunks) if isinstance(bands, pa.ChunkedArray) else bands).flatten().to_numpy().reshape(len(item), -1)
        low, high, bucket = (rows[c][0].as_py() for c in ("low", "high", "component"))
        a = np.flatnonzero(own == low)
        b = a if low == high else np.flatnonzero(own == high)
        root = dict(zip(group.tolist(), group.tolist(), strict=True))
        sets: dict[int, np.ndarray] = {}
        text, out = rows["text"].combine_chunks(), []
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_sets(text.slice(k, 1))[0]
            return sets[k]

        for s in range(0, len(a), 64):
            part = a[s : s + 64]
            n = agreeing(bits[part][:, None, :], bits[b][None, :, :])
            x, y = np.nonzero((n >= least) & (group[part][:, None] != group[b][None, :]))
            i_all, j_all, n = part[x], b[y], n[x, y]
            keep = (bands[i_all, (bands[i_all] == bands[j_all]).argmax(1)] == bucket) & ((i_all < j_all) | (low != high))
            i_all, j_all, n = i_all[keep], j_all[keep], n[keep]
            for k in np.argsort(-n, kind="stable").tolist():
                i, j = int(i_all[k]), int(j_all[k])
                p, q = top(int(group[i])), top(int(group[j]))
                if p != q and linked(set_of(i), set_of(j), percent):
                    root[p] = q
                    out.append((int(item[max(i, j)]), int(item[min(i, j)])))
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Links (u, v) that connect what the groups (node, component) and further links connect, groups as stars."""
    return groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row; component_id is the least key that links lead to, kept whether it is the row's own."""
    known = features(docs, key, text)
    classes = cut(known.where("n > 0").groupBy("sig").agg(F.min(key).alias("least"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    items = shared_items(classes.select(F.explode("bands").alias("bucket"), F.col("sig").alias("item")))
    bits = classes.select("sig", "bits")
    texts = texts_of(docs, text, items.select(F.col("item").alias("sig")).distinct())
    stars = items.where("item <> lo").select(F.col("item").alias("u"), F.col("lo").alias("v")).distinct()
    near = cut(estimated(stars, bits, percent, items.count()))
    n_near = near.count()
    best = cut(few(near.groupBy("u").agg(F.max_by("v", F.struct("matches", "v")).alias("v")), n_near, ESTIMATED))
    links = cut(confirmed(best, texts, percent, n_near))
    groups = cut(components(links))
    of = lambda c: groups.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_group"))
    rest = near.join(best, ["u", "v"], "left_anti").join(of("u"), F.col("u") == F.col("u_node"), "left").join(of("v"), F.col("v") == F.col("v_node"), "left")
    rest = cut(rest.where(F.coalesce("u_group", "u") != F.coalesce("v_group", "v")).select("u", "v"))
    if n_rest := rest.count():
        links = joined(groups, cut(confirmed(rest, texts, percent, n_rest)))
        groups = cut(components(links))
    members = items.where("item <> lo").join(of("i"), F.col("item") == F.col("i_node"), "left").select("bucket", "item", F.coalesce("i_group", "item").alias("group"))
    ends = F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("size")
    mixed = members.groupBy(F.col("bucket").alias("m_bucket")).agg(*ends).where("lo <> hi").select("m_bucket", "size")
    members = cut(members.join(mixed, F.col("bucket") == F.col("m_bucket")).drop("m_bucket"))
    n_members = members.count()
    small, members = members.where(F.col("size") <= SMALL), members.where(F.col("size") > SMALL).drop("size")
    if n_members:
        other = small.select(F.col("bucket").alias("o_bucket"), F.col("item").alias("other"), F.col("group").alias("o_group"))
        met = small.join(other, (F.col("bucket") == F.col("o_bucket")) & (F.col("item") > F.col("other")) & (F.col("group") != F.col("o_group")))
        met = cut(estimated(met.select(F.col("item").alias("u"), F.col("other").alias("v")).distinct(), bits, percent, n_members * SMALL // 2))
        paired = cut(confirmed(met, texts, percent, met.count()))
        full = members.join(classes.select("sig", "bits", "bands"), F.col("item") == F.col("sig")).drop("sig").join(texts, F.col("item") == F.col("sig"))
        met = all_pairs(full.select(F.col("bucket").alias("component"), "item", "group", "bits", "bands", "text"), BLOCK)
        met = met.select("component", "low", "high", "own", "item", "group", "bits", "bands", "text")
        found = met.groupBy("component", "low", "high").applyInArrow(bucket_links(percent), "u long, v long")
        links = joined(groups, paired.unionByName(cut(few(found, n_members, COMPARED))))
        groups = cut(components(links))
    named = classes.select("sig", "least").join(groups, F.col("sig") == F.col("node"), "left").select(F.col("sig").alias("k_sig"), "least", F.coalesce("component", "sig").alias("component"))
    tops = named.groupBy(F.col("component").alias("top")).agg(F.min("least").alias("component_id"))
    named = named.join(tops, F.col("component") == F.col("top")).select("k_sig", "component_id")
    out = known.select(key, "sig", F.col("n").alias("n_shingles")).join(named, F.col("sig") == F.col("k_sig"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key))
    return out.select(key, "n_shingles", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


def op12_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id u, b.doc_id v, count(*) common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from p join n x on u = x.doc_id join n y on v = y.doc_id where 100 * common >= {PERCENT} * (x.n + y.n - common)),
e as (select u, v from l union select v, u from l),
r as (select doc_id d, doc_id c from documents union select e.v, r.c from r join e on r.d = e.u),
m as (select d, min(c) c from r group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, doc_id = c kept from documents left join n using (doc_id) join m on m.d = doc_id
"""
