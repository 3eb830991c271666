"""The corpus operators against plain versions that share none of their code."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import docs_of, words

from stepweave.llm import bpe, fingerprints, html_text, jaccard_join, language_id, line_dedup, mixing, quality_rules, sharding, substring_dedup

MADE = ["lang_pred", "score", "ambiguous", "ids", "decoded", "depth", "prefix", "shard", "bytes", "shard_bytes", "page", "digits", "n_words", "removed_words", "kept", "base_failed", "wrapper", "host", "item", "sig", "line", "size", "target", "key", "slot"]
ROWS = [(1, "One two three\nfour", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (3, "", "en", "s"), (None, "  \t", None, "s"), (4, "One  two three\nfive six", "en", None), (5, "y" * 1_200_000 + " end", "de", "s")]


@pytest.fixture(scope="module")
def clash(spark):
    """Nulls, empty and long texts, repeated rows, and a column for each name that an operator makes or uses inside."""
    return docs_of(spark, ROWS).withColumns({c: F.lit(f"own {c}") for c in MADE})


def by_key(df, *names):
    return sorted((tuple(r[n] for n in ("doc_id", *names)) for r in df.collect()), key=repr)


def test_language_on_odd_rows(clash):
    got = language_id.predict(clash, None)
    assert by_key(got, "lang_pred", "score") == sorted(((k, "und", 0.0) for k, *_ in ROWS), key=repr)
    assert got.columns.count("lang_pred") == 1 and got.select("size").first()[0] == "own size"
    assert language_id.predict(clash.where("1 = 0"), None).count() == 0 and language_id.fit(clash.where("1 = 0").select("doc_id", "lang", "text")) is None


def test_bpe_on_odd_rows(clash):
    got = bpe.decode(bpe.encode(clash))
    assert by_key(got, "decoded") == sorted(((k, t or "") for k, t, *_ in ROWS), key=repr)
    assert got.columns.count("ids") == 1 and bpe.encode(clash.where("1 = 0")).count() == 0


def test_lines_on_odd_rows(clash):
    for distance in (3, None):
        got = line_dedup.groups(clash, distance=distance)
        assert {(r["doc_id"], r["line_no"]): (r["first_key"], r["first_line_no"]) for r in got.collect()} == {(1, 0): (1, 0), (1, 1): (1, 1), (4, 0): (1, 0), (4, 1): (4, 1), (5, 0): (5, 0)}
    kept = line_dedup.dedup(clash, distance=None)
    assert kept.columns == [*clash.columns, "__changed"] and {r["text"] for r in kept.where("doc_id = 4").collect()} == {"five six"} and kept.count() == len(ROWS)


def test_sharding_on_odd_rows(clash):
    got = sharding.shard(clash, limit=20)
    assert by_key(got, "bytes") == sorted(((k, len((t or "").encode())) for k, t, *_ in ROWS), key=repr)
    assert got.columns.count("depth") == 1 and got.select("page").first()[0] == "own page" and sharding.shard(clash.where("1 = 0")).count() == 0


def test_quality_on_odd_rows(clash):
    got = quality_rules.judge(clash)
    assert by_key(got, "n_words", "kept", "removed_words") == sorted(((k, len((t or "").split()), False, 0) for k, t, *_ in ROWS), key=repr)
    assert got.columns.count("kept") == 1 and quality_rules.judge(clash.where("1 = 0")).count() == 0


def test_mixing_on_odd_rows(clash):
    got = mixing.mix(clash)
    size = {k: len((t or "").split()) for k, t, *_ in ROWS}
    assert by_key(got, "size") == sorted(((k, size[k]) for k, *_ in ROWS), key=repr)
    assert got.where("size = 0 and (taken > 0 or slot is not null)").count() == 0 and mixing.mix(clash.where("1 = 0")).count() == 0


def test_joins_on_odd_rows(clash):
    members, _ = jaccard_join.join(clash, all_links=False)
    classes = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert members.count() == len(ROWS) and classes[3] == classes[2] == classes[None] and classes[1] == 1 and classes[4] == 4
    assert substring_dedup.shared_passages(clash).count() == 0


# op 1


def test_scores_equal_a_plain_scorer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = docs.where("lang is not null and text is not null").where(~language_id.in_fold(F.col("doc_id")))
    model = language_id.fit(labelled.select("doc_id", "lang", "text"))
    texts = [r for r in docs.orderBy("doc_id").limit(25).collect() if r["text"]]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs.select("doc_id", "text"), model).collect()}
    for r in texts:
        data = b" " + bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in r["text"].lower().encode()) + b" "
        total, n = np.zeros(model.code.shape[1]), 0
        for size in language_id.ORDERS:
            for k in range(len(data) - size + 1):
                gram = data[k : k + size]
                if set(gram) == {32}:
                    continue
                key = 0
                for j, b in enumerate(gram, 1):
                    key = (key * 0x01000193 + b + j) % 2**32
                total += model.odds[(key * language_id._FACTORS[size - 1] % 2**32) >> 17]
                n += 1
        margin = model.code * (total / np.sqrt(max(n, 1)) * model.scale)
        loss = [sum(w * np.log1p(np.exp(-m)) for w, m in zip(model.weight, row, strict=True)) for row in margin]
        share = np.exp(min(loss) - np.array(loss))
        assert got[r["doc_id"]][0] == model.languages[int(np.argmin(loss))] and abs(got[r["doc_id"]][1] - share.max() / share.sum()) < 1e-3


def test_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HELD", 3)
    rows = [(k, " ".join(f"{c}{c}{c}{d}" for d in "abcdefgh"), f"x{c}", "s") for k, c in enumerate("klmnopqrst")]
    model = language_id.fit(docs_of(spark, rows * 3).select("doc_id", "lang", "text"))
    assert model.languages == sorted({r[2] for r in rows})


# op 2


def test_query_digests_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = bpe.op2_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(out.encode()).hexdigest()


def test_streams_of_one_list_do_not_mix():
    merges = bpe.vocabulary(bpe.default_path()).merges
    texts = [bytes(random.Random(s).choices(b"aeinorst", k=20_000)) for s in (1, 2)]
    parts = [[t[k : k + 500] for k in range(0, len(t), 500)] for t in texts]
    streams = [merges.stream(iter(p)) for p in parts]
    out = [[], []]
    open_ = [0, 1]
    while open_:
        for k in list(open_):
            try:
                out[k].append(next(streams[k]))
            except StopIteration:
                open_.remove(k)
    assert out == [list(merges.stream([t])) for t in texts]


def test_unsupported_vocabularies_are_refused():
    good = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "decoder": {"type": "ByteLevel"}, "added_tokens": []}
    bpe._supported(good)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"model": {"type": "BPE", "byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe._supported(good | change)


# op 3


def test_documents_with_single_seeds_do_not_hide_a_passage(spark):
    passage = words(60, 9, 10**6)
    rows = [(k, " ".join(words(100, 20 + k, 10**6) + passage + words(100, 40 + k, 10**6))) for k in (1, 2)]
    rows += [(100 + k, " ".join(words(60, 500 + k, 10**6) + passage[k * 3 : k * 3 + 5] + words(60, 700 + k, 10**6))) for k in range(16)]
    got = substring_dedup.shared_passages(docs_of(spark, rows)).collect()
    assert {frozenset((r["doc_id"], r["other"])) for r in got} == {frozenset((1, 2))}
    # two sentences that others have alone
    a, b = passage[:30], passage[30:]
    rows = rows[:2] + [(200 + k, " ".join(words(80, 900 + k, 10**6) + (a if k % 2 else b) + words(80, 950 + k, 10**6))) for k in range(20)]
    got = substring_dedup.shared_passages(docs_of(spark, rows)).collect()
    assert frozenset((1, 2)) in {frozenset((r["doc_id"], r["other"])) for r in got}


def test_exact_passages_equal_a_plain_finder(spark):
    """Every document with 60 words in a row of another one is listed, among common phrases; no other is."""
    rng = random.Random(3)
    phrases = [words(rng.randint(5, 12), 30 + k, 10**6) for k in range(12)]
    long_ = [words(60, 60 + k, 10**6) for k in range(4)]
    rows = []
    for k in range(60):
        w = words(40, 1000 + k, 10**6)
        for _ in range(4):
            w += rng.choice(phrases) + words(12, rng.randrange(10**9), 10**6)
        if k % 4 == 0:
            w += rng.choice(long_)
        rows.append((k, " ".join(w + words(20, 5000 + k, 10**6))))
    grams = {k: {tuple(t.split()[i : i + 55]) for i in range(len(t.split()) - 54)} for k, t in rows}
    want = {k for k in grams if any(j != k and grams[k] & grams[j] for j in grams)}
    got = substring_dedup.shared_passages(docs_of(spark, rows)).collect()
    assert want and {x for r in got for x in (r["doc_id"], r["other"])} == want


def test_pairs_are_not_made_for_each_of_their_seeds(spark, monkeypatch):
    """Near copies share many seeds: their group of documents is listed once, in as many rounds as the texts ask for."""
    base = words(600, 77, 10**6)
    rows = [(k, " ".join(base[:300] + words(40, 300 + k, 10**6) + base[300:])) for k in range(6)]
    seeds = substring_dedup._seeds(docs_of(spark, rows), "text").select(F.explode("seeds").alias("s")).groupBy("s").count().where("count > 1").count()
    made = []
    monkeypatch.setattr(substring_dedup.F, "sort_array", lambda c: made.append(c) or F.array_sort(c))
    pairs = substring_dedup._pairs(docs_of(spark, rows), "text")
    assert seeds > 50 and made and pairs.count() == 15
    want = sorted(map(tuple, substring_dedup.shared_passages(docs_of(spark, rows)).collect()))
    monkeypatch.setattr(substring_dedup, "ROUND", 1)
    assert sorted(map(tuple, substring_dedup.shared_passages(docs_of(spark, rows)).collect())) == want and len(want) >= 15


def test_hopeless_pairs_are_not_chained(monkeypatch):
    """Scattered phrases of 16 words, a run of 45 words: no passage of 50 words can be there, so nothing is chained; near one, it is."""
    chained, chains = [], substring_dedup.chains
    monkeypatch.setattr(substring_dedup, "chains", lambda m: chained.append(len(m)) or chains(m))

    def laid(sizes, seed):
        out = []
        for k, n in enumerate(sizes):
            out += words(60, seed + k, 10**6) + words(n, 9000 + k, 10**6)
        return np.array([hash(w) & (1 << 63) - 1 for w in out + words(60, seed + 99, 10**6)], np.uint64)

    assert substring_dedup.passages(laid([16, 16, 45, 16], 100), laid([16, 16, 45, 16], 300)) == [] and not chained
    got = substring_dedup.passages(laid([16, 55, 16], 100), laid([16, 55, 16], 300))
    assert [(x[1] - x[0], x[4]) for x in got] == [(55, 1.0)] and chained


def test_the_shorter_text_of_a_pair_is_looked_at_first_and_stray_matches_are_not_aligned(monkeypatch):
    """A long text's words are hashed and sorted once for all its pairs; a phrase repeated inside a found passage starts no alignment."""
    looked, shared = [], substring_dedup.Words.shared
    monkeypatch.setattr(substring_dedup.Words, "shared", lambda self, other, k: looked.append(len(self.h)) or shared(self, other, k))
    h = lambda w: np.array([int(hashlib.sha256(x.encode()).hexdigest()[:15], 16) for x in w], np.uint64)
    long_, short = h(words(900, 1, 10**6)), h(words(80, 2, 10**6))
    for a, b in ((long_, short), (short, long_)):
        looked.clear()
        assert substring_dedup.passages(a, b) == [] and looked == [80]
    phrase, aligned, align = words(6, 3, 10**6), [], substring_dedup.align
    monkeypatch.setattr(substring_dedup, "align", lambda *a, **k: aligned.append(1) or align(*a, **k))
    text = h([x for k in range(6) for x in words(40, 10 + k, 10**6) + phrase])
    got = substring_dedup.passages(text, text.copy())
    assert [x[:4] for x in got] == [(0, len(text), 0, len(text))] and len(aligned) == 1


# op 5


def test_blocks_equal_plain_jaccard():
    rng = random.Random(4)
    base = [set(rng.sample(range(10**6), 120)) for _ in range(3)]
    sets = [np.array(sorted((b - set(rng.sample(sorted(b), n))) | set(rng.sample(range(10**6), n))), np.uint64) for b in base for n in (0, 2, 6, 9, 14, 20, 40)]
    i, j = np.triu_indices(len(sets), 1)
    got = jaccard_join.similar(sets, i, j, 0.8)
    want = [len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert got.tolist() == want and 5 < sum(want) < len(want)


def test_counts_without_a_list_equal_the_list(spark):
    rng = random.Random(8)
    rows = []
    for k in range(70):
        w = words(150, 60 + k % 2, 3000)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = docs_of(spark, rows)
    full, few = jaccard_join.join(df)[0], jaccard_join.join(df, all_links=False)[0]
    assert by_key(full, "group_id", "n_links") == by_key(few, "group_id", "n_links") and full.where("n_links > 5").count() > 10


# op 6


def test_only_oversized_buckets_split(spark):
    rows = [(k, "x" * (k % 90)) for k in range(700)]
    got = sharding.shard(docs_of(spark, rows), limit=900).collect()
    digits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, _ in rows}
    size = lambda p: sum(len(t) for k, t in rows if digits[k].startswith(p))
    for r in got:
        p = r["shard"]
        assert digits[r["doc_id"]].startswith(p) and r["depth"] == len(p) > 0 and size(p) == r["shard_bytes"] <= 900 < size(p[:-1])


def test_query_splits(spark, sf):
    assert sharding.op6_sharding(spark, sf).select("shard").distinct().count() > 1


# op 7

ARTICLE = "<h1>Head {0}</h1><p>The first part of text number {0} goes on for a while here.</p><p>Then comes a second part {0} with other words in it.</p>"
AROUND = '<html><body><nav><a href="/">Home</a></nav><div class="{1}">{0}</div><div class="sidebar">Side words</div><div class="post-comments"><div class="comment">Nice {2}</div></div><div class="site-footer">Foot</div></body></html>'


def texts_of(pages):
    wrapper = None
    for p in pages:
        w = html_text.fold(html_text.parse(p))
        wrapper = w if wrapper is None else html_text.merge(wrapper, w)
    html_text.decide(wrapper)
    return [html_text.extract(html_text.parse(p), wrapper) for p in pages]


def plain(markup):
    return " ".join(re.sub(r"<[^>]+>", " ", markup).split())


@pytest.mark.parametrize("name", ["content", "content has-sidebar", "post with-sidebar", "page no-comments", "article-body share-enabled", "main layout-2col sidebar-right", "layout sidebar-left", "x17"])
def test_class_names_do_not_empty_an_article(name):
    assert texts_of([AROUND.format(ARTICLE.format(k), name, k) for k in range(3)]) == [plain(ARTICLE.format(k)) for k in range(3)]


def test_texts_do_not_depend_on_the_order_of_pages():
    pages = [AROUND.format(ARTICLE.format(k) + "<ul><li>one</li><li>two</li></ul>" * (k % 2) + "<p>More here.</p>" * k, "content", k) for k in range(3)]
    want = dict(zip(pages, texts_of(pages), strict=True))
    for order in ((1, 0, 2), (2, 1, 0), (0, 2, 1), (1, 2, 0), (2, 0, 1)):
        own = [pages[k] for k in order]
        assert texts_of(own) == [want[p] for p in own]


def test_deep_elements_keep_their_kind():
    deep = "<div>" * 230 + "<form>Mail form</form><nav>Menu</nav><p>deep words</p>" + "</div>" * 230
    assert texts_of([f"<html><body><article><p>Start</p>{deep}<p>end</p></article></body></html>"]) == ["Start deep words end"]


def test_open_quotes_cost_time_in_proportion():
    import time

    began = time.time()
    for tail in (">", "", "x>'"):
        html_text.parse("<p>x" + "<a '" * 40_000 + tail)
    assert time.time() - began < 5


def test_pages_join_their_wrappers_alike(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/{k}", AROUND.format(ARTICLE.format(k), "content", k), "own") for k in range(30)] + [(90, None, None, "own"), (91, "odd", "", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    run = lambda: {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    got = run()
    monkeypatch.setattr(html_text, "SMALL_BYTES", -1)
    assert run() == got and all(got[k] == plain(ARTICLE.format(k)) for k in range(30)) and got[90] == got[91] == ""
    assert html_text.extract_text(df.where("1 = 0")).count() == 0


# op 8


def plain_sketch(text):
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]

    def chained(parts):  # each part's hash is the seed of the next
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), seed=h)
        return h

    h = {chained(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({xxhash.xxh64_intdigest(" ".join(w).encode(), seed=42)} if w else set())
    return {x for x in h if x < 1 << 62}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_equal_plain_code(spark, kind):
    rows = [(k * 7 % 101, " ".join(words(k % 60, k, 50)) + "é" * (k % 3)) for k in range(101)] + [(500, None), (501, "")]
    key = (lambda k: k) if kind == "long" else (lambda k: f"k{k:05}")
    df = docs_of(spark, rows) if kind == "long" else spark.createDataFrame([(key(k), t) for k, t in rows], "doc_id string, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(df).collect()}
    order = sorted((key(k), t or "") for k, t in rows)
    like = lambda a, b, s, t: 1.0 if s == t else (len(a & b) / min(len(a), len(b)) if a and b else 0.0)
    text = lambda s: ",".join(f"{x:016X}" for x in sorted(s))
    for k, (name, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = map(plain_sketch, (t, edited, after))
        r = got[name]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text(a), text(b)) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - like(a, b, t, edited)) < 1e-9 and abs(r["near_next"] - like(a, c, t, after)) < 1e-9


# op 9


def test_slots_equal_the_listed_schedule(spark):
    sizes = [("a", 700), ("b", 90), ("c", 1100), (None, 33)]
    goals = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).cache()
    plan = mixing.shares(goals, 1 << 9)
    n = int(plan.first()["slots"])
    ranks = plan.withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("n_slots").cast("int") - 1)))
    own = {(r["at"], r["rank"]): r["slot"] for r in ranks.select("at", "rank", mixing.slot_of(F.col("rank"), F.col("first_point"), F.col("end_point"), F.col("slots")).alias("slot")).collect()}
    listed = {(r["at"], r["rank"]): r["slot"] for r in mixing.schedule(goals, n).collect()}
    assert own == listed and sorted(own.values()) == list(range(n))


def test_texts_are_shuffled_once_for_their_places(spark):
    """Rows stay where the window has dealt them when their cells are joined; an empty source isn't the null one."""
    rows = [(k, "one two three " * (k % 5 + 1), "en", (None, "", "n", "s")[k % 4]) for k in range(80)]
    got = mixing.mix(docs_of(spark, rows), keep=["text"])
    assert {r["source_size"] for r in got.where("doc_id % 4 < 2").collect()} == {sum(3 * (k % 5 + 1) for k in range(n, 80, 4)) for n in (0, 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    by_cell = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "__cell" in line]
    assert by_cell and not [line for line in by_cell if "isnull(source" in line]


def test_the_mix_is_in_the_order_of_its_slots(spark):
    rows = [(k, " ".join(["w"] * (3 + k % 20)), "en", "abc"[k % 3]) for k in range(300)]
    df = docs_of(spark, rows)
    slot = {r["doc_id"]: (r["slot"], r["slot2"]) for r in mixing.mix(df).collect()}
    got = [r["doc_id"] for r in mixing.stage(spark, df, "").collect()]
    seen, order = Counter(), []
    for k in got:
        order.append(slot[k][seen[k]])
        seen[k] += 1
    assert order == sorted(order) and len(got) == sum(x is not None for s in slot.values() for x in s)


# op 10


def test_line_ends_do_not_tell_lines_apart(spark):
    body = lambda k: " ".join(words(60, k, 10**6))
    ends = ["", "\r", "\t", "  ", " \r"]
    rows = [(k, f"Share  This\tpage{ends[k % 5]}\n{body(k)}", "en", "h") for k in range(40)]
    got = {r["doc_id"]: r["removed_words"] for r in quality_rules.judge(docs_of(spark, rows)).collect()}
    norm = Counter(" ".join(t.split("\n")[0].lower().split()) for _, t, *_ in rows)
    assert norm == {"share this page": 40} and set(got.values()) == {3}
