"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over byte n-grams (log odds of the
languages with the bit against those without) predicts it from the text alone; decoding adds up the logistic
losses of the bits against each codeword, weighted by how well each bit did on training rows, and takes the
codeword with the least. A text whose two nearest codewords are close is flagged ambiguous.

Training counts n-grams over all labelled rows, map-side first: what reaches the driver is one array of at most
BUCKETS sums for each language. Only the scale and weight of the bits come from a sample, of about CALIBRATION rows and four times as many at most; these
rows are also counted, so scales and weights, not predictions, lean to the hopeful side.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
CALIBRATION = 2000
HELD = 512  # languages whose sums a task holds before it hands them on
AMBIGUOUS = 0.6
BLOCK = 1 << 18  # bytes that are scored at once

#: Bytes that stay: letters and whatever isn't ASCII; the others become blanks.
_KEEP = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_FACTORS = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F]


def blocks(text: str):
    """Byte blocks of a text, each with the last bytes of the one before, so that no n-gram is lost or met twice."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" "
    for k in range(0, len(data), BLOCK):
        yield data[max(0, k - ORDERS[-1] + 1) : k + BLOCK], min(k, ORDERS[-1] - 1)


def grams(data: bytes, old: int) -> np.ndarray:
    """Buckets of the n-grams of a block that end after its first `old` bytes and aren't blank alone."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    solid = b != 0x20
    key, some, out = np.zeros(len(b), np.uint32), np.zeros(len(b), bool), []
    for n in ORDERS:
        if len(b) < n:
            break
        key = key[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        some = some[: len(b) - n + 1] | solid[n - 1 :]
        use = some.copy()
        use[: max(0, old - n + 1)] = False
        out.append((key * np.uint32(_FACTORS[n - 1]) >> np.uint32(17))[use])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all bits that tell languages apart for up to 7, else the best of 64 random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        return np.array([[1, *bits] for bits in product((1, -1), repeat=n - 1) if -1 in bits], np.int8).T
    rng, best = np.random.default_rng(7), (-1, None)
    for _ in range(64):
        code = rng.choice(np.array([1, -1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        apart = (code.shape[1] - (code.astype(int) @ code.T.astype(int)) - 2 * code.shape[1] * np.eye(n, dtype=int)) // 2
        worst = np.abs(apart + 2 * code.shape[1] * np.eye(n, dtype=int)).min()
        code = code[:, np.abs(code.sum(0, dtype=int)) < n]
        best = max(best, (worst, code), key=lambda x: x[0])
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # BUCKETS x bits, float32
    scale: np.ndarray
    weight: np.ndarray

    def evidence(self, text: str) -> np.ndarray:
        """Log odds of each bit over the root of the number of n-grams."""
        total, n = np.zeros(self.odds.shape[1]), 0
        for data, old in blocks(text):
            g = grams(data, old)
            total += np.bincount(g, minlength=BUCKETS) @ self.odds if len(g) > 20_000 else self.odds[g].sum(0, dtype=np.float64)
            n += len(g)
        return total / np.sqrt(max(n, 1))

    def decode(self, z: np.ndarray) -> tuple[str, float, bool]:
        """Language of the codeword with the least weighted loss (ties: the first by code point), score, ambiguity."""
        loss = np.logaddexp(0, -self.code * (z * self.scale)) @ self.weight
        share = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        score = float(share[best] / share.sum())
        return self.languages[best], score, score < AMBIGUOUS


def in_fold(doc_id: Column, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == remainder, F.lit(False))


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) of rows (lang, text); bucket -1 holds the number of rows."""

    def give(sums, seen):
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            at, n = np.append(at, -1), np.append(v[at], seen[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])
        sums.clear()

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                if lang not in sums:
                    if len(sums) >= HELD:
                        yield from give(sums, seen)
                    sums[lang], seen[lang] = np.zeros(BUCKETS, np.int64), 0
                seen[lang] += 1
                for data, old in blocks(text.as_py()):
                    sums[lang] += np.bincount(grams(data, old), minlength=BUCKETS)
        yield from give(sums, seen)

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, key: str = "doc_id") -> Model | None:
    """A model from rows (key, lang, text) with a lang and a text; None if there are none."""
    got = count_grams(rows).groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    if not got:
        return None
    languages = sorted(r["lang"] for r in got)
    counts = np.zeros((len(languages), BUCKETS + 1), np.float64)
    for r in got:
        counts[languages.index(r["lang"]), r["at"]] = r["n"]  # bucket -1 is the last
    total, counts = int(counts[:, -1].sum()), counts[:, :-1]
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    odds = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        plus, minus = p[code[:, b] > 0], p[code[:, b] < 0]
        if len(plus) and len(minus):
            odds[:, b] = np.log(plus.mean(0)) - np.log(minus.mean(0))
    model = Model(languages, code, odds, np.ones(code.shape[1]), np.ones(code.shape[1]) / code.shape[1])
    # Rows of one key and text are in the sample or not together, so it has a bound of its own besides.
    sample = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), "text"), F.lit(max(1, total // CALIBRATION))) == 0).limit(4 * CALIBRATION)
    _calibrate(model, sample)
    return model


def _calibrate(model: Model, sample: DataFrame) -> None:
    """Scale of each bit's evidence (logistic, with a prior) and weight (its margin over chance)."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            z = [m.evidence(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.list_(pa.float64()))], ["lang", "z"])

    got = sample.select("lang", "text").mapInArrow(run, "lang string, z array<double>").toPandas()
    if got.empty:
        return
    z = np.array(got["z"].tolist())
    y = model.code[[model.languages.index(x) for x in got["lang"]]]
    for b in range(z.shape[1]):
        m, a = y[:, b] * z[:, b], 0.1
        for _ in range(50):
            s = 1 / (1 + np.exp(np.clip(a * m, -50, 50)))
            a += (float((s * m).sum()) - a) / (float((s * (1 - s) * m * m).sum()) + 1.0)
            a = min(max(a, 1e-3), 50.0)
        model.scale[b] = a
        model.weight[b] = max(0.05, 1 - 2 * float((m <= 0).mean()))


def predict(df: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """Adds lang_pred, score, ambiguous, in place of columns of these names.

    A null or empty text, or one without a letter, is `und` with score 0. Long texts are scored whole, block by block. Repeated rows get the same; of
    equally near codewords the first by code point is taken. An empty table gives no rows, and without a model all rows are `und`.
    """
    from pyspark.sql.types import StructType

    df = without(df, ["lang_pred", "score", "ambiguous"])
    readable = F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None)
    rows = df.withColumn("__text", F.when(readable, F.col(column)))
    schema = StructType(list(df.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [("und", 0.0, False) if (t := x.as_py()) is None else m.decode(m.evidence(t)) for x in batch.column(batch.num_columns - 1)]
            new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
    model = fit(labelled.select("doc_id", "lang", "text"))
    out = docs.select("doc_id", "text", in_fold(F.col("doc_id")).alias("held_out"))
    return predict(out, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
