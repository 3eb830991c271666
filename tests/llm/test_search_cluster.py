"""Ranked search, b-bit near duplicates and centroid clustering against plain code, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepweave.llm import bbit, clustering, ranked_search
from stepweave.llm.tokens import BETWEEN_TERMS, BETWEEN_WORDS, counts, tokens

CLASH = ("item", "sig", "key", "query", "term_hash", "segment", "score", "rank", "cluster", "distance", "bits", "least", "n", "component_id", "kept")


def table_of(spark, rows, ddl, *, clash=True):
    df = spark.createDataFrame(rows, ddl)
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns}) if clash else df


@pytest.mark.parametrize(("between", "pattern"), [(BETWEEN_WORDS, r"[^\x20\x09-\x0D]+"), (BETWEEN_TERMS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_tokens_are_those_of_the_pattern(between, pattern):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB9 -\tä 中\x00_") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "x" * (1 << 20) + " y"]
    found = tokens(pa.array(texts), between)
    by_hash: dict = {}
    for t, text in enumerate(texts):
        want = [m.group().translate({c: c + 32 for c in range(65, 91)}) for m in re.finditer(pattern, text or "")]
        own = range(found.at[t], found.at[t + 1])
        assert [found.data[found.start[k] : found.end[k]].tobytes().decode() for k in own] == want
        for k, word in zip(own, want, strict=True):
            assert by_hash.setdefault(word, found.hash[k]) == found.hash[k]
    assert len(set(by_hash.values())) == len(by_hash)
    assert counts(pa.array(texts), between).tolist() == np.diff(found.at).tolist()


# op 11


def terms_of(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document."""
    sets = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in docs]
    sets = [x for x in sets if x[2]]
    n, length = len(sets), sum(x[2] for x in sets)
    df = Counter(t for _, c, _ in sets for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in sets:
            m = 100 - 75 + 75 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def zipf(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(n))


def test_search_equals_scoring_every_document(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(d, zipf(rng, rng.randrange(1, 90))) for d in range(700)] + [(900 + k, "same text Twice") for k in range(15)]
    docs += [(2000, None), (2001, ""), (2002, " -- "), (None, "same text twice"), (3, zipf(rng, 40)), (3, zipf(rng, 40)), (4000, zipf(rng, 30_000)), (4001, "Ärger ärger a b")]
    items = [(k, zipf(rng, 12)) for k in range(25)] + [(50, "TEXT same same"), (51, None), (52, "?!"), (53, "nowhere"), (54, "Ärger äRGER"), (None, "twice")]
    monkeypatch.setattr(ranked_search, "FIRST", 16)
    index = ranked_search.build(table_of(spark, docs, "doc_id long, text string").repartition(3))
    got = ranked_search.search(index, table_of(spark, items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)
    again = ranked_search.search(index, spark.createDataFrame([(1, "w1 w2"), (1, "w1 w2")], "item_id long, text string"))
    assert Counter(r["rank"] for r in again.collect()) == Counter([*range(1, 11)] * 2)


def test_search_in_turns_of_queries(spark, monkeypatch):
    rng = random.Random(6)
    docs, items = [(d, zipf(rng, 30)) for d in range(60)], [(k, zipf(rng, 5)) for k in range(12)]
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 8)
    index = ranked_search.build(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr) == ranked(docs, items)


def test_empty_corpus_and_queries(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = ranked_search.build(none)
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(index, asked).collect() == []
    index = ranked_search.build(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert ranked_search.search(index, asked.where(F.lit(False))).collect() == []


def test_blocks_return_their_postings():
    rng = np.random.default_rng(1)
    n = np.array([1, 128, 128, 7, 128, 2])
    gaps, tf = rng.integers(0, 1 << 17, n.sum()), rng.integers(1, 900, n.sum())
    gaps[130:140], tf[1:129] = 0, 1
    first = np.cumsum(n) - n
    data, size, gap_bits, tf_bits = ranked_search.pack(gaps, tf, first, n)
    assert data.nbytes == size.sum() < 4 * n.sum()
    back = ranked_search.unpack(data, n, gap_bits, tf_bits)
    assert (back[0] == gaps).all() and (back[1] == tf).all()
    own = data[size[:2].sum() : size[:3].sum()]  # a block alone
    assert (ranked_search.unpack(own, n[2:3], gap_bits[2:3], tf_bits[2:3])[0] == gaps[129:257]).all()


def test_blocks_below_the_threshold_stay_compressed(spark):
    """Blocks of a frequent term are decompressed only where a rare term's documents are, once these fill the result."""
    docs = [(d, "common " * (1 + d % 2) + ("rare rare" if 5000 <= d < 5012 else f"u{d}")) for d in range(20_000)]
    rows = ranked_search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    own = rows.postings.toArrow()
    sizes = own.filter(own["term_hash"].is_null())["sizes"].combine_chunks().flatten().to_numpy()
    lists = ranked_search._Lists(own.filter(own["term_hash"].is_valid()), ranked_search.norms(sizes, rows.documents, rows.length))
    named = dict(zip(own["term"].to_pylist(), own["term_hash"].to_pylist(), strict=True))
    found, _ = ranked_search.best(lists, [(named["common"], 5), (named["rare"], 9000)], 10)
    assert all(5000 <= d < 5012 for d in found.tolist())
    common = lists.blocks[named["common"]]
    assert common.stop - common.start == 157 and lists.open[common].sum() <= 12


# op 12


def word_sets(docs, k=3):
    out = []
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def near_copies(docs, percent=85):
    """(doc, n, component, kept) by comparing all pairs."""
    sets = word_sets(docs)
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least: dict = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), c := least.get(top(i)), d == c) for i, (d, s) in enumerate(sets)), key=repr)


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus(rng):
    docs = []
    for _ in range(30):  # families: one text and its edits, near the threshold on both sides
        base = [f"v{rng.randrange(300)}" for _ in range(rng.choice([8, 40, 120, 400]))]
        for _ in range(rng.randrange(1, 6)):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 1, 2, len(base) // 20]))))
    chain = [f"c{k}" for k in range(200)]
    for _ in range(40):  # a chain, whose ends are unlike
        docs.append(" ".join(chain))
        chain = edited(rng, chain, 3)
    return docs


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(8)
    docs = list(enumerate(corpus(rng), 10))
    rng.shuffle(docs)
    docs += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "Ä b"), (7, "ä b"), (8, "two words"), (8, "two words"), (None, "two words"), (None, "alone it is here"), (9, "long " * 5000 + "end")]
    got = bbit.near_duplicates(table_of(spark, docs, "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == [x if x[0] is not None else (None, x[1], x[2], x[2] is None) for x in near_copies(docs)]


def test_blocks_of_buckets_link_what_stars_leave(spark, monkeypatch):
    """A bucket whose least member is unlike the others: they meet in blocks, of four here, and each link is found."""
    rng = random.Random(9)
    docs = list(enumerate(corpus(rng)))
    monkeypatch.setattr(bbit, "BLOCK", 4)
    monkeypatch.setattr(bbit, "band_keys", lambda values: np.zeros((len(values), 1), np.uint64))
    got = bbit.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    assert sorted(map(tuple, got.collect()), key=repr) == near_copies(docs)


def test_a_pair_of_several_buckets_is_confirmed_in_the_first(monkeypatch):
    """Two texts that agree in all packed values but aren't similar share two bands: one comparison, not two for each bucket."""
    import pyarrow as pa

    compared, linked = [], bbit.linked
    monkeypatch.setattr(bbit, "linked", lambda a, b, percent: compared.append(1) or linked(a, b, percent))
    bits = np.zeros(bbit._VALUES * bbit.BITS // 64, np.uint64).tobytes()
    for bucket in (7, 8):
        rows = {"component": [bucket] * 2, "low": [0] * 2, "high": [0] * 2, "own": [0] * 2, "item": [1, 2], "group": [1, 2], "bits": [bits] * 2, "bands": [[7, 8]] * 2, "text": ["a b c d e", "f g h i j"]}
        assert bbit.bucket_links(85)(pa.table(rows)).num_rows == 0
    assert len(compared) == 1


def test_small_frames_take_few_tasks(spark):
    """Components of a few links don't take a task for each shuffle partition."""
    from stepweave.llm import graph

    adaptive, parts = (spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = graph.components(spark.createDataFrame([(k + 1, k) for k in range(20)], "u long, v long"))
        assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(21)}
        assert got.where("node <> component").rdd.getNumPartitions() < 60  # 40 of the roots and few of the edges; 80 before
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_estimate_corrects_for_chance():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.85):
        a = rng.integers(0, 1 << 32, (400, bbit._VALUES), dtype=np.uint64).astype(np.uint32)
        b = np.where(rng.random(a.shape) < share, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint64).astype(np.uint32))
        n = bbit.agreeing(bbit.packed(a), bbit.packed(b))
        assert abs(bbit.estimate(n).mean() - share) < 0.01
        assert (n >= bbit.least_matches()).all() == (share == 0.85)
    assert bbit.packed(a).nbytes == 400 * bbit._VALUES * bbit.BITS // 8


def test_empty_table_has_no_near_duplicates(spark):
    assert bbit.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# op 13


def clustered(rows, k, rounds, dimensions):
    """(id, cluster, distance, cluster inertia, inertia, digest) in Python's integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        at = [min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]
        if turn < rounds:
            for j in range(len(c)):
                if own := [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]:
                    c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = Counter()
    for d, j in at if kept else []:
        total[j] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    fits = lambda n: n if n < 1 << 63 else None
    whole = sum(total.values())
    wide = {j for d, j in (at if kept else []) if fits(d) is None}
    return sorted(((i, j, fits(d), None if j in wide else fits(total[j]), None if wide else fits(whole), digest[j]) for (i, _), (d, j) in zip(kept, at if kept else [], strict=True)), key=repr)


@pytest.mark.parametrize("size", [1.0, 2.0**17, 2.0**22, 2.0**40, 1e300], ids=["blas", "blas-integer", "integer", "python", "beyond"])
def test_clusters_equal_plain_integers(spark, size, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1, 1]) * size * rng.random() for _ in range(6)]) for k in range(150)]
    same = [size / 3] * 6
    rows += [(200 + k, same) for k in range(60)] + [(5, same), (5, same), (None, same), (None, [0.0] * 6)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 5 + [None]), (304, [1.0] * 5 + [math.nan]), (305, [math.inf] + [1.0] * 5), (306, [1.0] * 7)]
    monkeypatch.setattr(clustering, "BLOCK", 32)
    got = clustering.cluster(table_of(spark, rows, "vec_id long, embedding array<double>").repartition(3), dimensions=6, k=7, rounds=3).assigned
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == clustered(rows, 7, 3, 6)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.001, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = clustering.cluster(df, dimensions=2, k=40).assigned
    assert sorted(map(tuple, got.collect()), key=repr) == clustered([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 40, 5, 2)
    assert clustering.cluster(df.where(F.lit(False)), dimensions=2).assigned.collect() == []


def test_products_are_taken_only_where_float64_is_exact():
    """Vectors a unit apart, so large that |x|^2 loses it in float64: the integer ways find the distance."""
    for size in (1 << 24, 1 << 27, 1 << 40):
        x = np.full((2, 8), float(size))
        c = x[:1].copy()
        x[1, 0] += 1
        label, distance = clustering.nearest(x, np.vstack([c - 3, c]))
        assert label.tolist() == [1, 1] and [int(d) for d in distance] == [0, 1]
    assert clustering.sums(np.full((3, 2), 2.0**52), np.array([0, 0, 1]), 2).tolist() == [[1 << 53] * 2, [1 << 52] * 2]
