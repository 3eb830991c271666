"""Ranked lexical search by Block-Max WAND over an inverted index of compressed posting blocks.

Documents are indexed in segments of up to SEGMENT_BYTES of text, numbered by ascending key inside a segment. A term's postings
are cut into blocks of BLOCK; each block is packed on its own, gaps and frequencies by the bits that its largest needs, and keeps outside of the
packed bytes its first and last document and its maximum impact, the largest share of a score that any of its postings can bring at a weight of one.
The index is a Parquet table, a row for each segment and term and one for the segment's documents.

A query's lists are taken through a segment by shallow moves: the ends of their blocks part the segment into stretches, and for each the
sum of weighted maxima of the blocks that lie over it bounds all scores in it. Stretches are visited from the highest bound, a run
at a time; when the bound falls below the k-th best score found, the rest of the segment is skipped, its blocks never decompressed. Every segment is
a task's work and gives k rows a query at most; the best of these are the result. Impacts, weights and scores are exact integers.

A term is a maximal run of bytes that aren't ASCII, letters and digits, A-Z in lower case; terms are told apart by 64-bit hashes. Null and
empty texts have none, can't be found and don't count. Rows that share a key are documents of their own, as are repeated rows; of equal
scores, the lesser key comes first, null last. Queries that share an id, or are repeated, are ranked each on its own; a
query without terms finds nothing, nor does any in an empty table. Columns other than key and text aren't looked at, so their
names may clash. A long text is one row of a segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shared_folder, table
from .jaccard_join import _slices
from .tokens import BETWEEN_TERMS, counts, tokens

TOP = 10
BLOCK = 128
SEGMENT_BYTES = 16 << 20
SEGMENT_DOCS = 1 << 16
#: Documents of the first run of stretches; each further run has four times as many.
FIRST = 1024
#: Terms of queries that are broadcast at a time; more queries are searched in turns.
QUERY_TERMS = 500_000
_LONG = 1 << 63


@dataclass
class Index:
    """postings: the index; documents: how many hold a term; length: all their terms."""

    postings: DataFrame
    documents: int
    length: int


def norms(sizes: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a document's length adds to the denominator of its impacts: 25 for none, 100 at the mean."""
    if not len(sizes) or not length:
        return np.zeros(len(sizes), np.int64)
    if 75 * int(sizes.max()) * documents >= _LONG:
        return np.array([25 + 75 * n * documents // length for n in sizes.tolist()], np.int64)
    return 25 + 75 * sizes.astype(np.int64) * documents // length


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Saturated frequencies, up to 1,000,000."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated ranges starts[i] .. starts[i] + sizes[i]."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _layout(n: np.ndarray, gap_bits: np.ndarray, tf_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of gaps, bytes of gaps and frequencies) of blocks of n postings."""
    gaps = (n * gap_bits + 7) // 8
    return gaps, gaps + (n * tf_bits + 7) // 8


def pack(gaps: np.ndarray, tf: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bytes of each block, bits of a gap, bits of a frequency) of blocks that begin at posting `first` and have n postings."""
    gap_bits, tf_bits = _bit_lengths(np.maximum.reduceat(gaps, first)), _bit_lengths(np.maximum.reduceat(tf, first) - 1)
    of_gaps, size = _layout(n, gap_bits, tf_bits)
    begin = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    place = np.arange(len(gaps)) - np.repeat(first, n)
    for values, width, origin in ((gaps, gap_bits, begin * 8), (tf - 1, tf_bits, (begin + of_gaps) * 8)):
        each = np.repeat(width, n)
        at = np.repeat(origin, n) + place * each
        for b in range(int(width.max(initial=0))):
            use = each > b
            bits[at[use] + b] = (values[use] >> b) & 1
    return np.packbits(bits, bitorder="little"), size, gap_bits, tf_bits


def unpack(data: np.ndarray, n: np.ndarray, gap_bits: np.ndarray, tf_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gaps, frequencies) of whole blocks whose bytes follow one another in data."""
    of_gaps, size = _layout(n, gap_bits, tf_bits)
    begin = np.cumsum(size) - size
    bits = np.unpackbits(data, bitorder="little")
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = []
    for width, origin in ((gap_bits, begin * 8), (tf_bits, (begin + of_gaps) * 8)):
        each, values = np.repeat(width, n), np.zeros(len(place), np.int64)
        at = np.repeat(origin, n) + place * each
        for b in range(int(width.max(initial=0))):
            use = each > b
            values[use] |= bits[at[use] + b].astype(np.int64) << b
        out.append(values)
    return out[0], out[1] + 1


class _Segment:
    """Documents on their way into a segment: postings of slices of texts, and their terms' names."""

    def __init__(self) -> None:
        self.keys, self.sizes, self.hash, self.doc, self.tf, self.names, self.bytes = [], [], [], [], [], [], 0

    def __len__(self) -> int:
        return sum(len(k) for k in self.keys)

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        found, before = tokens(texts, BETWEEN_TERMS), len(self)
        doc = np.repeat(np.arange(len(texts)), np.diff(found.at))
        order = np.lexsort((doc, found.hash))
        h, d = found.hash[order], doc[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
        self.keys.append(keys)
        self.sizes.append(np.diff(found.at))
        self.hash.append(h[new])
        self.doc.append((d[new] + before).astype(np.int32))
        self.tf.append(np.diff(np.append(new, len(h))).astype(np.int32))
        self.bytes += len(found.data)
        one = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else new
        start, size = found.start[order[one]], (found.end - found.start)[order[one]]
        ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32)).buffers()[1]
        letters = np.ascontiguousarray(found.data[_spread(start, size)])
        self.names.append((h[one], pa.StringArray.from_buffers(len(one), ends, pa.py_buffer(letters))))

    def rows(self, number: int, documents: int, length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        keys, sizes = pa.concat_arrays(self.keys), np.concatenate(self.sizes)
        order = pc.sort_indices(keys).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        keys, sizes = keys.take(pa.array(order)), sizes[order]
        h, doc, tf = np.concatenate(self.hash), rank[np.concatenate(self.doc)], np.concatenate(self.tf)
        by = np.lexsort((doc, h))
        h, doc, tf = h[by], doc[by].astype(np.int64), tf[by].astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        own = {"segment": pa.array([number], pa.int64()), "keys": lists, "sizes": pa.array([sizes], pa.list_(pa.int32()))}
        yield _batch(own, 1, schema)
        if not len(h):
            return
        term = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        df = np.diff(np.append(term, len(h)))
        n_blocks = -(-df // BLOCK)
        first = _spread(np.zeros(len(df), np.int64), n_blocks) * BLOCK + np.repeat(term, n_blocks)
        n = np.diff(np.append(first, len(h)))
        gaps = np.diff(doc, prepend=0)
        gaps[first] = 0
        most = np.maximum.reduceat(impacts(tf, norms(sizes, documents, length)[doc]), first)
        data, size, gap_bits, tf_bits = pack(gaps, tf, first, n)
        known, at = np.unique(np.concatenate([x for x, _ in self.names]), return_index=True)
        names = pa.concat_arrays([x for _, x in self.names]).take(pa.array(at))
        assert len(known) == len(term)
        ends = pa.array(np.append(0, np.cumsum(n_blocks)), pa.int32())
        per_block = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(x.astype(kind)))
        of_term = np.append(0, np.cumsum(np.add.reduceat(size, np.cumsum(n_blocks) - n_blocks)))
        payload = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.array(of_term.astype(np.int32)).buffers()[1], pa.py_buffer(data)])
        cols = {"segment": pa.array(np.full(len(df), number)), "term_hash": pa.array(h[term].view(np.int64)), "term": names, "df": pa.array(df)}
        cols |= {"first": per_block(doc[first], np.int32), "last": per_block(doc[first + n - 1], np.int32), "most": per_block(most, np.int32)}
        cols |= {"gap_bits": per_block(gap_bits, np.int8), "tf_bits": per_block(tf_bits, np.int8), "payload": payload}
        whole = _batch(cols, len(df), schema)
        for k in range(0, len(df), 20_000):
            yield whole.slice(k, 20_000)


def _batch(cols: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> Index:
    """The index of docs, written to path (a fresh shared folder by default). Texts are read twice: once to count terms, once to index."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 0):
                n = counts(batch.column(0), BETWEEN_TERMS)
                yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "length"])

    total = docs.select(text).mapInArrow(count, "documents long, length long").agg(F.sum("documents"), F.sum("length")).first()
    documents, length = total[0] or 0, total[1] or 0
    kind = docs.schema[key].dataType
    lists = "first array<int>, last array<int>, most array<int>, gap_bits array<tinyint>, tf_bits array<tinyint>, payload binary"
    schema = StructType.fromDDL(f"segment long, term_hash long, term string, df long, {lists}, keys array<{kind.simpleString()}>, sizes array<int>")
    arrow = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(schema)])
    arrow = pa.schema([pa.field(f.name, pa.list_(f.type.value_type)) if pa.types.is_list(f.type) else f for f in arrow])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number = TaskContext.get().partitionId(), _Segment(), 0
        for whole in batches:
            for batch in _slices(whole, 1):
                if len(held) and (held.bytes >= SEGMENT_BYTES or len(held) + batch.num_rows > SEGMENT_DOCS):
                    yield from held.rows((part << 24) + number, documents, length, arrow)
                    held, number = _Segment(), number + 1
                held.add(batch.column(0), batch.column(1))
        if len(held):
            yield from held.rows((part << 24) + number, documents, length, arrow)

    path = path or f"{shared_folder(docs.sparkSession)}/postings"
    docs.select(key, text).mapInArrow(index, schema).write.parquet(path)
    return Index(docs.sparkSession.read.parquet(path), documents, length)


class _Lists:
    """Posting lists of a segment; blocks are decompressed when they are first asked for, once for all queries."""

    def __init__(self, rows: pa.Table, norm: np.ndarray) -> None:
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
        df = rows["df"].to_numpy()
        self.norm, self.first, self.last, self.most = norm, flat("first"), flat("last").astype(np.int64), flat("most").astype(np.int64)
        self.gap_bits, self.tf_bits = flat("gap_bits").astype(np.int64), flat("tf_bits").astype(np.int64)
        n_blocks = -(-df // BLOCK)
        top = np.cumsum(n_blocks) - n_blocks
        self.blocks = {h: slice(a, a + b) for h, a, b in zip(rows["term_hash"].to_pylist(), top.tolist(), n_blocks.tolist(), strict=True)}
        self.n = np.full(int(n_blocks.sum()), BLOCK)
        self.n[top + n_blocks - 1] = df - (n_blocks - 1) * BLOCK
        self.start = np.cumsum(self.n) - self.n
        self.data = np.frombuffer(b"".join(rows["payload"].to_pylist()), np.uint8)
        self.size = _layout(self.n, self.gap_bits, self.tf_bits)[1]
        self.begin = np.cumsum(self.size) - self.size
        self.open = np.zeros(len(self.n), bool)
        self.doc, self.impact = np.zeros(int(df.sum()), np.int32), np.zeros(int(df.sum()), np.int64)

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = np.unique(blocks[~self.open[blocks]])
        if not len(blocks):
            return
        n = self.n[blocks]
        gaps, tf = unpack(self.data[_spread(self.begin[blocks], self.size[blocks])], n, self.gap_bits[blocks], self.tf_bits[blocks])
        run = np.cumsum(gaps)
        doc = run - np.repeat(run[np.cumsum(n) - n], n) + np.repeat(self.first[blocks], n)
        at = _spread(self.start[blocks], n)
        self.doc[at], self.impact[at] = doc, impacts(tf, self.norm[doc])
        self.open[blocks] = True


def best(lists: _Lists, terms: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k highest scores above 0 for terms (hash, weight), best first; of equal scores, the first document."""
    mine = [(lists.blocks[h], w) for h, w in terms if h in lists.blocks]
    top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not mine:
        return top, scores
    block = np.concatenate([np.arange(s.start, s.stop) for s, _ in mine])
    weights = np.repeat(np.array([w for _, w in mine]), [s.stop - s.start for s, _ in mine])
    first, last = lists.first[block], lists.last[block]
    bounds = np.unique(np.concatenate([first, last + 1]))
    over = np.zeros(len(bounds), np.int64)
    np.add.at(over, np.searchsorted(bounds, first), weights * lists.most[block])
    np.subtract.at(over, np.searchsorted(bounds, last + 1), weights * lists.most[block])
    bound, width = np.cumsum(over)[:-1], np.diff(bounds)
    order = np.argsort(-bound, kind="stable")
    bound, width, begin = bound[order], width[order], bounds[:-1][order]
    upto, done, take = np.cumsum(width), 0, FIRST
    n_docs = len(lists.norm)
    while done < len(order):
        least = max(1, int(scores[-1])) if len(scores) == k else 1
        live = int(np.searchsorted(-bound, -least, "right"))
        if done >= live:
            break
        stop = min(live, max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + take, "right"))))
        chosen = np.zeros(n_docs + 1, np.int64)
        np.add.at(chosen, begin[done:stop], 1)
        np.subtract.at(chosen, begin[done:stop] + width[done:stop], 1)
        chosen = np.cumsum(chosen)[:-1] > 0
        ahead = np.append(0, np.cumsum(chosen))
        hit = ahead[last + 1] > ahead[first]
        lists.decompress(block[hit])
        n = lists.n[block[hit]]
        at = _spread(lists.start[block[hit]], n)
        total = np.zeros(n_docs, np.int64)
        np.add.at(total, lists.doc[at], lists.impact[at] * np.repeat(weights[hit], n))
        found = np.flatnonzero(chosen & (total >= least))
        docs, values = np.concatenate([top, found]), np.concatenate([scores, total[found]])
        keep = np.lexsort((docs, -values))[:k]
        top, scores = docs[keep], values[keep]
        done, take = stop, take * 4
    return top, scores


def _queries(items: DataFrame, key: str, text: str) -> DataFrame:
    """(query, key, term_hash, times): the terms of each row of items, which `query` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = tokens(batch.column(1), BETWEEN_TERMS)
            for t in range(batch.num_rows):
                h, n = np.unique(found.hash[found.at[t] : found.at[t + 1]], return_counts=True)
                if len(h):
                    ids = pa.concat_arrays([batch.column(0).slice(t, 1)] * len(h))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), number)), ids, pa.array(h.view(np.int64)), pa.array(n)], ["query", key, "term_hash", "times"])
                number += 1

    return cut(items.select(key, text).mapInArrow(run, f"query long, `{key}` {items.schema[key].dataType.simpleString()}, term_hash long, times long"))


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP, doc_key: str = "doc_id") -> DataFrame:
    """(key, rank, doc_key, score): the k highest scores above 0 of each row of items, by rank from 1."""
    spark = items.sparkSession
    asked = _queries(items, key, text)
    turns = max(1, -(-asked.count() // QUERY_TERMS))
    found = [_searched(index, asked.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == t) if turns > 1 else asked, k) for t in range(turns)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = rows.withColumn("rank", place).where(F.col("rank") <= k)
    names = asked.select(F.col("query").alias("n_query"), key).distinct()
    return ranked.join(names, F.col("query") == F.col("n_query")).select(key, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_key), "score")


def _searched(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query, doc, score): the best k of each segment for a bounded number of queries."""
    lists, documents, length = index.postings, index.documents, index.length
    wanted = F.broadcast(asked.select(F.col("term_hash").alias("w_hash")).distinct())
    own = lists.join(wanted, F.col("term_hash") == F.col("w_hash"), "left").where("term_hash is null or w_hash is not null").drop("w_hash")
    held = own.where("term_hash is not null").groupBy("term_hash").agg(F.sum("df").alias("df")).collect()
    weights = {r["term_hash"]: weight(documents, r["df"]) for r in held}
    queries: dict[int, list[tuple[int, int]]] = {}
    for r in asked.select("query", "term_hash", "times").collect():
        if w := weights.get(r["term_hash"], 0):
            queries.setdefault(r["query"], []).append((r["term_hash"], w * r["times"]))
    shared = asked.sparkSession.sparkContext.broadcast(queries)
    kind = lists.schema["keys"].dataType.elementType

    def run(rows: pa.Table) -> pa.Table:
        is_term = rows["term_hash"].is_valid()
        docs = rows.filter(pc.invert(is_term))
        keys, sizes = docs["keys"].combine_chunks().flatten(), docs["sizes"].combine_chunks().flatten().to_numpy()
        segment = _Lists(rows.filter(is_term), norms(sizes, documents, length))
        query, doc, score = [], [], []
        for q, terms in shared.value.items():
            d, s = best(segment, terms, k)
            query.append(np.full(len(d), q))
            doc.append(d)
            score.append(s)
        at = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query": join(query), "doc": keys.take(pa.array(at)), "score": join(score)})

    return own.groupBy("segment").applyInArrow(run, f"query long, doc {kind.simpleString()}, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as (select doc_id, len(t)::bigint n, t from (select doc_id, {_TERMS} t from documents) where len(t) > 0),
g as (select count(*)::bigint nn, sum(n)::bigint ll from d),
p as (select doc_id, n, term, count(*)::bigint tf from (select doc_id, n, unnest(t) term from d) group by 1, 2, 3),
f as (select term, count(*)::bigint df from p group by 1),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint w from f, g),
q as (select item_id, term, count(*)::bigint times from (select item_id, unnest({_TERMS}) term from benchmark) group by 1, 2),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::bigint score
   from q join p using (term) join w using (term), g group by 1, 2)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from s where score > 0) where rank <= {TOP}
"""
