"""Centroid clustering of integer vectors: k-means rounds with exact results.

Vectors are packed once into blocks, matrices of up to BLOCK rows, which are written to the shared folder and read in every round. A
round's distances are |x|^2 - 2 x.c + |c|^2 from one BLAS product a block in float64. That is exact as long as no term can reach 2^53,
which is checked from the largest magnitudes of the block and the centroids before each product; beyond, the block goes through 64-bit
integers while these suffice, then through Python's integers. A round's sums come from a product with the assignment's indicator
matrix under the same check, and are added up by treeAggregate: what reaches the driver is k sums, whatever the number of vectors.

Vectors that aren't of the wanted length, or hold a null or a value that isn't finite, are left out, null vectors too. A null id has a vector of its own and is
never an initial centroid unless ids run out; rows that share an id are vectors of their own, and ties among their hashes
go to the lesser vector. Fewer vectors than centroids make fewer centroids; no vectors give no rows. A distance or an
inertia that a long can't hold is null. Columns other than id and vector aren't looked at, so their names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
BLOCK = 4096
_EXACT = 1 << 53
_LONG = 1 << 63


def kept(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector as array<double>) of the vectors that have `dimensions` components, all of them finite."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(key), x.alias(vector)).where(F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False)))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as integers that float64 holds; Python's integers where scale * x is beyond float64."""
    with np.errstate(over="ignore"):
        out = np.floor(x * scale)
    if np.isfinite(out).all():
        return out
    return np.array([int(v) * scale if abs(v) > _EXACT else int(np.floor(v * scale)) for v in x.ravel().tolist()], object).reshape(x.shape)


def _magnitude(x: np.ndarray) -> int:
    return int(max(x.max(), -x.min())) if x.size else 0


def _as_integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of c, squared distance to it) for each row of x; ties go to the smaller number.

    x and c hold integers. Each of the three terms is at most d m^2 for d components up to m, and their sum and all partial sums stay below 4 d m^2.
    """
    bound = 4 * x.shape[1] * max(_magnitude(x), _magnitude(c)) ** 2
    if bound < _EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
        label = d.argmin(1)
        return label, d[np.arange(len(x)), label].astype(np.int64)
    if bound < _LONG:
        x, c = x.astype(np.int64), c.astype(np.int64)
        d = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
    else:
        x, c = _as_integers(x), _as_integers(c)
        d = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
    label = d.argmin(1)
    return label, d[np.arange(len(x)), label]


def sums(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of each label as Python's integers, k rows."""
    if len(x) * _magnitude(x) < _EXACT:
        indicator = np.zeros((k, len(x)))
        indicator[label, np.arange(len(x))] = 1
        return _as_integers(indicator @ x.astype(np.float64))
    x, out = _as_integers(x), np.zeros((k, x.shape[1]), object)
    for j in np.unique(label).tolist():
        out[j] = x[label == j].sum(0)
    return out


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of a block: the smallest of three types that holds it, or decimal text."""
    if x.dtype != object:
        for kind in ("int16", "int32", "float64"):
            if kind == "float64" or _magnitude(x) <= np.iinfo(kind).max:
                return kind, x.astype(kind).tobytes()
    return "text", ",".join(map(str, x.ravel().tolist())).encode()


def _unpack(kind: str, data: bytes, rows: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in data.split(b",")], object).reshape(rows, -1)
    return np.frombuffer(data, kind).reshape(rows, -1)


def blocks(vectors: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(ids, kind, data): the kept vectors as integer matrices, written once to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimensions)
                kind, data = _pack(whole(x, scale))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([data], pa.binary())], ["ids", "kind", "data"])

    path = f"{shared_folder(vectors.sparkSession)}/blocks"
    of = vectors.schema[key].dataType.simpleString()
    kept(vectors, key, vector, dimensions).mapInArrow(run, f"ids array<{of}>, kind string, data binary").write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def first_centroids(vectors: DataFrame, key: str, vector: str, dimensions: int, k: int, scale: int, salt: str) -> np.ndarray:
    """The k kept vectors whose `salt` + id has the least sha256, in that order."""
    order = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"), 256)
    least = kept(vectors, key, vector, dimensions).withColumn("__h", order).orderBy(F.asc_nulls_last("__h"), vector).limit(k)
    return whole(np.array([r[0] for r in least.select(vector).collect()], np.float64).reshape(-1, dimensions), scale)


def refine(packed: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after `rounds` rounds over blocks(); a centroid without vectors stays."""
    k = len(centroids)
    rows = packed.select("kind", "data", F.size("ids").alias("n")).rdd
    for _ in range(rounds if k else 0):
        c = centroids

        def add(total, block, c=c):
            x = _unpack(block["kind"], bytes(block["data"]), block["n"])
            label, _ = nearest(x, c)
            own = sums(x, label, k), np.bincount(label, minlength=k)
            return own if total is None else (total[0] + own[0], total[1] + own[1])

        def merge(a, b):
            return (b if a is None else a) if a is None or b is None else (a[0] + b[0], a[1] + b[1])

        found = rows.treeAggregate(None, add, merge, depth=3)
        if found is None:
            break
        new = [[int(s) // int(n) for s in total] if n else [int(v) for v in old] for total, n, old in zip(*found, c, strict=True)]
        new = np.array(new, object)
        centroids = new.astype(np.float64) if _magnitude(new) < _EXACT else new
    return centroids


@dataclass
class Clusters:
    """assigned: (key, cluster, distance, cluster_inertia, inertia, centroid_sha256); centroids: their integer components."""

    assigned: DataFrame
    centroids: list[list[int]]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = "2:") -> Clusters:
    """Clusters of the kept vectors, as floor(scale * x), after `rounds` rounds from centroids chosen by hash."""
    spark = vectors.sparkSession
    packed = blocks(vectors, key, vector, dimensions, scale)
    c = refine(packed, first_centroids(vectors, key, vector, dimensions, k, scale, salt), rounds)
    name, kind = key, vectors.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, of, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                label, distance = nearest(_unpack(of, data, len(ids)), c)
                exact = [d if d < _LONG else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(label, pa.int32()), pa.array(exact, pa.int64())], [name, "cluster", "distance"])

    rows = packed.mapInArrow(assign, f"`{name}` {kind}, cluster int, distance long")
    # k rows at most: sums in decimals, so that a long's range isn't left on the way.
    each = rows.groupBy(F.col("cluster").alias("c_cluster")).agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("wide")).collect()
    whole_sum = sum(int(r["total"] or 0) for r in each)
    wide = any(r["wide"] for r in each)
    integers = [[int(v) for v in row] for row in c.tolist()]
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in integers]
    fits = lambda n, bad: n if not bad and n < _LONG else None
    named = [(r["c_cluster"], fits(int(r["total"] or 0), r["wide"]), fits(whole_sum, wide), digest[r["c_cluster"]]) for r in each]
    facts = spark.createDataFrame(named, "c_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return Clusters(rows.join(F.broadcast(facts), F.col("cluster") == F.col("c_cluster")).drop("c_cluster"), integers)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).assigned


def _rounds() -> str:
    """The CTEs of all rounds: a<r> assigns to c<r>, c<r+1> are the new centroids."""
    out = []
    for r in range(ROUNDS + 1):
        out.append(
            f"a{r} as (select id, x, least_one.j j, least_one.d d from (select id, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), j := j)) least_one from v, c{r} group by id, x, n))"
        )
        if r < ROUNDS:
            out.append(
                f"s{r} as (select j, i, sum(x[i])::hugeint s, count(*)::hugeint n from a{r}, range(1, {DIMENSIONS + 1}) g(i) group by 1, 2),"
                f" m{r} as (select j, list(((s - ((s % n) + n) % n) // n)::bigint order by i) c from s{r} group by 1),"
                f" c{r + 1} as (select o.j, coalesce(m{r}.c, o.c) c from c{r} o left join m{r} using (j))"
            )
    return ",\n".join(out)


ORACLE = f"""
with v as (select vec_id id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) x, row_number() over () n from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
c0 as (select row_number() over (order by sha256('2:' || id), x) - 1 j, x c from v qualify j < {CLUSTERS}),
{_rounds()}
select id vec_id, a.j::int as cluster, a.d::bigint distance, sum(a.d) over (partition by a.j)::bigint cluster_inertia, sum(a.d) over ()::bigint inertia,
  sha256(array_to_string(f.c, ',')) centroid_sha256 from a{ROUNDS} a join c{ROUNDS} f on a.j = f.j
"""
