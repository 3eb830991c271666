"""N-gram Jaccard join with Bayesian pruning of its candidates.

Texts of one set of word shingles form a class and are handled once. Candidates share a band of MinHash values; at
the threshold of 0.8 a pair misses all 32 bands of 4 values with odds of 5e-8. A pair's MinHash values are
compared 16 at a time; as soon as the posterior probability that its similarity reaches the threshold falls below a
tolerance, the pair is dropped. What is left is verified on the sets themselves.

Classes that share a band are connected by the least class of the band's bucket; the components of these candidates
hold every similar pair. A component is dealt out in blocks, and each two blocks meet in a task of their own, where the
classes are compared all with all in arrays: what leaves the task is a count of links and a root for each class. So links are counted
whole, while rows grow with the number of classes times that of the blocks, not with the square of a group. Classes are grouped by
connected component of the links.

Nulls, empty texts and texts of blanks are one class without links; texts of fewer words than a shingle have one shingle.
Repeated rows and rows that share a key are members of their own, and ties go to the least key. An empty table gives no rows.
Columns other than key and text aren't looked at, so their names may clash. Long texts are one row as any other; blocks are
bounded by bytes, too.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import checked_broadcast, cut, shared_folder, table
from .graph import components, shared_items

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-4
BLOCK = 512
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
_VALUES = BANDS * ROWS
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, _VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, _VALUES, dtype=np.uint64)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ... compared values, the fewest matches at which P(similarity >= threshold) >= tolerance.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1) distributed.
    """

    def posterior(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return tuple(next(m for m in range(n + 1) if posterior(m, n) >= tolerance) for n in range(STEP, _VALUES + 1, STEP))


def minhash(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint32 values (texts x BANDS * ROWS); texts without shingles get zeros."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), _VALUES), np.uint32)
    if len(full):
        starts = offsets[:-1][full]
        for p in range(_VALUES):
            out[full, p] = np.minimum.reduceat((h * _A[p] + _B[p]) >> np.uint64(32), starts)
    return out


def _slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Runs of rows of a batch with at most `most` bytes of text, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = 0
    held = 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and held + n > most:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def _long(digests: list[int]) -> pa.Array:
    return pa.array(np.array(digests, np.uint64).view(np.int64))


def _signature(h: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """64-bit hashes of the shingle sets of texts, and their sizes."""
    import xxhash

    sets = [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], [len(s) for s in sets]


def _keys(values: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """64-bit keys (texts x bands) of the MinHash values at the places that each row of `bands` lists."""
    h = np.broadcast_to(np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(values), len(bands))).copy()
    for r in range(bands.shape[1]):
        h = shingles.mix(h ^ values[:, bands[:, r]].astype(np.uint64))
    return h


_BANDS = np.arange(_VALUES).reshape(BANDS, ROWS)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sig, n, values, bands) of each row, written once.

    sig: 64 bits that stand for a text's shingle set (m sets collide with odds of m^2 / 2^65); n: its size; values: the MinHash values as
    binary; bands: a key for each band. A text without words has neither values nor bands.
    """

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, 1):
                h, at = shingles.shingle_sets(batch.column(1), SHINGLE)
                sigs, sizes = _signature(h, at)
                v = minhash(h, at)
                keys = _keys(v, _BANDS).view(np.int64)
                values = pa.array([x.tobytes() if n else None for x, n in zip(v, sizes, strict=True)], pa.binary())
                bands = pa.array([x if n else None for x, n in zip(keys, sizes, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), _long(sigs), pa.array(sizes, pa.int64()), values, bands], [key, "sig", "n", "values", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    path = f"{shared_folder(docs.sparkSession)}/features"
    docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, sig long, n long, values binary, bands array<long>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def all_pairs(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """items (component, item, text, ...) with (own, low, high): each two blocks of a component share a (low, high).

    A component has a block for each `block` items and each BLOCK_BYTES of text.
    """
    sizes = items.groupBy(F.col("component").alias("of")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    at = items.join(sizes, F.col("component") == F.col("of")).drop("of").withColumn("own", F.pmod(F.xxhash64("item", F.lit("block")), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return at.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")


def survivors(v: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), i of a and j of b, that are left when the MinHash values v are compared STEP by STEP; i < j if a is b."""
    least, out = least_matches(threshold), []
    for s in range(0, len(a), 64):
        own = a[s : s + 64]
        matches = (v[own][:, None, :STEP] == v[b][None, :, :STEP]).sum(2, dtype=np.int64)
        x, y = np.nonzero(matches >= least[0])
        i, j, n = own[x], b[y], matches[x, y]
        if a is b:
            keep = i < j
            i, j, n = i[keep], j[keep], n[keep]
        for k in range(1, len(least)):
            part = slice(k * STEP, (k + 1) * STEP)
            n = n + (v[i, part] == v[j, part]).sum(1)
            keep = n >= least[k]
            i, j, n = i[keep], j[keep], n[keep]
        out.append((i, j))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of sets have a Jaccard similarity of at least the threshold, by products of incidence matrices."""
    rows = np.unique(np.concatenate([i, j]))
    sizes = np.array([len(sets[r]) for r in rows])
    _, code, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # a shingle of one text alone is in no intersection
    own = np.repeat(np.arange(len(rows)), sizes)[times[code] > 1]
    code = place[code[times[code] > 1]]
    order = np.argsort(code, kind="stable")
    own, code = own[order], code[order]
    x, y = np.searchsorted(rows, i), np.searchsorted(rows, j)
    left, right = np.unique(x), np.unique(y)
    both = np.zeros((len(left), len(right)), np.float64)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        lo, hi = np.searchsorted(code, [first, first + COLUMNS])
        m = np.zeros((len(rows), COLUMNS), np.float32)
        m[own[lo:hi], code[lo:hi] - first] = 1
        both += m[left] @ m[right].T
    n = both[np.searchsorted(left, x), np.searchsorted(right, y)]
    return (n > 0) & (n >= threshold * (sizes[x] + sizes[y] - n) - 1e-9)


def compared(blocks: DataFrame, threshold: float, listed: bool) -> DataFrame:
    """(u, v, n) of all_pairs(): for each item with links in two blocks, the least item that they connect it with, and their number.

    With `listed`, (u, v, 1) of each link instead, u > v.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        own, items = table["own"].to_numpy(), table["item"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        v = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint32).reshape(-1, _VALUES)
        a = np.flatnonzero(own == low)
        i, j = survivors(v, a, a if low == high else np.flatnonzero(own == high), threshold)
        links = (i, j)
        if len(i):
            h, at = shingles.shingle_sets(pa.concat_arrays(table["text"].chunks), SHINGLE)
            used = set(i.tolist()) | set(j.tolist())
            keep = similar([np.unique(h[at[k] : at[k + 1]]) if k in used else h[:0] for k in range(len(items))], i, j, threshold)
            links = i[keep], j[keep]
        if listed:
            u, w = items[np.maximum(*links)], items[np.minimum(*links)]
            return pa.table({"u": u, "v": w, "n": np.ones(len(u), np.int64)})
        n = np.bincount(np.concatenate(links), minlength=len(items))
        root = np.arange(len(items))
        while len(links[0]):
            least = np.minimum(root[links[0]], root[links[1]])
            new = root.copy()
            np.minimum.at(new, links[0], least)
            np.minimum.at(new, links[1], least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(n)
        return pa.table({"u": items[at], "v": items[root[at]], "n": n[at]})

    return blocks.select("component", "low", "high", "own", "item", "values", "text").groupBy("component", "low", "high").applyInArrow(run, "u long, v long, n long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, all_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links): (key, sig, class_id, group_id, n_links) of each row, and links (u, v) of signatures, u > v.

    n_links is the number of other classes that are similar to the row's. links are all similar pairs; without all_links only
    enough of them to connect the groups, by which no row is made for each pair.

    class_id is the least key of the rows with the same shingle set, group_id the least of all rows linked with it
    directly or in steps. Texts without words (nulls too) are one class without links. Rows may share a key.
    """
    known = features(docs, key, text)
    signed = known.select(key, "sig", "n")
    classes = cut(signed.where("n > 0").groupBy("sig").agg(F.min(key).alias("least")))
    items = shared_items(known.where("n > 0").select(F.explode("bands").alias("bucket"), F.col("sig").alias("item")))
    near = cut(components(items.where("item <> lo").select(F.col("item").alias("u"), F.col("lo").alias("v")).distinct()))
    chosen = docs.select(F.col(key).alias("__k"), F.col(text).alias("text"))
    linked = near.select(F.col("node").alias("sig")).join(classes, "sig")
    values = known.select("sig", "values").join(near, F.col("sig") == F.col("node")).groupBy("sig", "component").agg(F.first("values").alias("values"))
    texts = _texts_of(signed, linked, chosen, key).withColumnRenamed("sig", "item")
    met = all_pairs(cut(values.join(texts, F.col("sig") == F.col("item")).select("component", "item", "values", "text")))
    links = cut(compared(met, threshold, all_links))
    groups = cut(components(links.select("u", "v")))
    ends = F.array("u", "v") if all_links else F.array("u")
    degree = links.select(F.explode(ends).alias("d_sig"), "n").groupBy("d_sig").agg(F.sum("n").alias("n_links"))
    named = classes.join(groups, F.col("sig") == F.col("node"), "left").withColumn("component", F.coalesce("component", "sig"))
    tops = named.groupBy("component").agg(F.min("least").alias("group_id")).withColumnRenamed("component", "top")
    named = named.join(tops, F.col("component") == F.col("top")).join(degree, F.col("sig") == F.col("d_sig"), "left")
    empty = signed.where("n = 0").groupBy("sig").agg(F.min(key).alias("least")).select("sig", "least", F.col("least").alias("group_id"), F.lit(None).cast("long").alias("n_links"))
    named = named.select("sig", "least", "group_id", "n_links").unionByName(empty).withColumnRenamed("sig", "k_sig")
    members = signed.select(key, "sig").join(named, F.col("sig") == F.col("k_sig")).select(key, "sig", F.col("least").alias("class_id"), "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return members, links.where("u <> v").select("u", "v")


def docs_key_is_number(df: DataFrame, key: str) -> bool:
    return df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")


def _texts_of(signed: DataFrame, linked: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(sig, text) of one row of each linked class; a row of another text with the same key is passed over."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, 1):
                own, _ = _signature(*shingles.shingle_sets(batch.column(1), SHINGLE))
                same = np.array(own, np.uint64).view(np.int64) == batch.column(0).to_numpy()
                yield batch.filter(pa.array(same))

    least = linked.select(F.col("sig").alias("l_sig"), "least")
    named = signed.select(key, "sig").join(least, (F.col("sig") == F.col("l_sig")) & F.col(key).eqNullSafe(F.col("least"))).select("sig", key).distinct()
    if docs_key_is_number(signed, key):
        named = checked_broadcast(named)
    got = chosen.join(named, F.col("__k").eqNullSafe(F.col(key))).select("sig", "text")
    # Only rows that share a key and a text repeat here; the signature decides, whichever of them stays.
    return cut(got.mapInArrow(run, "sig long, text string").dropDuplicates(["sig"]))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    members, _ = join(docs, all_links=False)
    return members.select("doc_id", "class_id", "group_id", "n_links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's near-duplicate stage: the row with the least doc_id of each group stays, once if it is repeated.

    Null, empty and blank texts are one group; a null doc_id comes after all others. An empty table gives no rows.
    """
    members, _ = join(docs.select("doc_id", "text"), all_links=False)
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy(F.col("doc_id").alias("__stays")).agg((F.count(F.lit(1)) > 1).alias("__again"))
    left = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("__stays"))).drop("__stays")
    once, again = left.where("not __again"), left.where("__again").dropDuplicates(["doc_id"])
    return once.unionByName(again).drop("__again")
