"""Stored search indexes, commits of maps and the SQLite data source."""

import random
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from stepweave.operators import postings as P
from stepweave.operators import search as S
from stepweave.schema import TABLES, empty
from stepweave.sources import sqlite, store
from stepweave.testmap import TestMap


def small(spark, solution="s", texts=("the red door opens", "the door", "a gate opens the door")):
    """A map of one class, with a definition and a scenario for each text."""
    rows = {
        "meta": [("solution_path", solution)],
        "projects": [(1, "Depot", "Depot.csproj", None, "bdd_tests")],
        "classes": [(1, 1, "DoorSteps", "N", None, "step_class", "d.cs", 1, 9)],
        "methods": [(k, 1, 1, f"Step{k}", "()", "public", "step_definition", "d.cs", k, k) for k in range(1, len(texts) + 1)],
        "step_definitions": [(k, k, 1, 1, "Given", t, "regex", None, "d.cs", k) for k, t in enumerate(texts, 1)],
        "features": [(1, 1, "Doors", None, "@yard", "d.feature")],
        "scenarios": [(k, 1, 1, f"Case {k}", "scenario", None, 0, "d.feature", k) for k in range(1, len(texts) + 1)],
        "scenario_steps": [(k, k, 1, "Given", t, 0, False, False, "d.feature", k) for k, t in enumerate(texts, 1)],
    }
    return TestMap(**{t: spark.createDataFrame(rows[t], TABLES[t]) if t in rows else empty(spark, t) for t in TABLES})


# index


def test_index_finds_what_the_scan_finds(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    vocabulary = ["door", "gate", "the", "the", "the", "Élan", "rx77", "q4", "a", "of"]
    text = lambda: rng.choice([" ", "-", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))
    rows = [(k, text(), text() if k % 7 else None) for k in range(400)] + [(None, "the door", None), (500, None, None), (501, "", " -- ")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    monkeypatch.setattr(P, "BLOCK_ROWS", 40)
    P.write_index(df, "id", ["x", "y"], str(tmp_path / "i"))
    index = P.open_index(spark, str(tmp_path / "i"))
    # Blocks of the rarest term are named in the scan of the others, or met by a join.
    for named, queries in ((1000, ['"the:door"', "the-door gate", "elan ÉLAN", "the-the-the", "q4-rx77-q4", "door nowhere-the", ""]), (2, ["the-door gate", "rx77-q4 of"])):
        monkeypatch.setattr(P, "NAMED_BLOCKS", named)
        for query in queries:
            want = sorted(map(str, (r["id"] for r in S.search(df, ["x", "y"], query).collect())))
            assert sorted(str(r["id"]) for r in index.ids(query).collect()) == want, query
    twice = spark.createDataFrame([(1, "the"), (1, "door the"), (1, "door the"), (2, "the door")], "id long, x string")
    assert [r["id"] for r in P.write_index(twice, "id", ["x"], str(tmp_path / "twice")).ids("the-door").collect()] == [2]
    assert index.search(df, "id", "the-door").count() == S.search(df, ["x", "y"], "the-door").count() > 0


def test_search_reads_the_partitions_of_its_terms_only(spark, tmp_path):
    df = spark.createDataFrame([(k, f"word{k} common") for k in range(300)], "id long, x string")
    index = P.write_index(df, "id", ["x"], str(tmp_path / "i"))
    plan = index.ids("word7-common")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and "PushedFilters: [IsNotNull(term)" in plan and "EqualTo(term,word7)" in plan
    assert "EqualTo(block,0)" in plan  # of the frequent term, the rare one's block
    assert [r["id"] for r in index.ids("word7-common").collect()] == [7]


def test_postings_are_an_array_for_each_field(spark, tmp_path):
    df = spark.createDataFrame([(k, "same words " * (k + 1)) for k in range(9)], "id long, x string")
    index = P.write_index(df, "id", ["x"], str(tmp_path / "i"))
    table = spark.read.parquet(f"{index.path}/postings")
    assert set(P.FIELDS) <= set(table.columns) and table.where("term = 'same' and size(id) = n and size(at) = n and n = 45").count() == 1
    assert sorted(r["id"] for r in index.ids("words-same").collect()) == list(range(1, 9))
    # an index of an older writer
    held = F.transform(F.arrays_zip(*P.FIELDS), lambda x: F.struct(*[x[c] for c in P.FIELDS]))
    table.select("term", "block", "n", "bucket", held.alias("postings")).write.partitionBy("bucket").parquet(str(tmp_path / "old" / "postings"))
    old = P.SearchIndex(spark, str(tmp_path / "old"), index.buckets)
    assert sorted(r["id"] for r in old.ids("words-same").collect()) == list(range(1, 9))


def test_postings_are_positions_in_columns(spark):
    df = spark.createDataFrame([(1, "The door, the DOOR", "door"), (2, None, "")], "id long, x string, y string")
    got = {(r["term"], r["id"], r["column"]): r["positions"] for r in P.postings(df, "id", ["x", "y"]).collect()}
    assert got == {("the", 1, 0): [0, 2], ("door", 1, 0): [1, 3], ("door", 1, 1): [0]}


def test_a_stored_map_is_searched_by_its_index(spark, tmp_path):
    m = small(spark)
    store.save(m, str(tmp_path / "map"))
    back = store.load(spark, str(tmp_path / "map"))
    assert set(back.indexes) == {"steps", "scenarios"} and not m.indexes
    for find, query in ((S.search_steps, "DoorSteps the-door"), (S.search_scenarios, "Doors Case-2")):
        assert [r["id"] for r in find(back, query).collect()] == [r["id"] for r in find(m, query).collect()] != []
    assert [r["id"] for r in S.search_steps(back, "the-door opens").collect()] == [3]


# commits


def solution(m):
    return m.meta.first()["value"]


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    path = str(tmp_path / "map")
    assert store.save(small(spark, "one"), path) == 1
    first = store.load(spark, path)
    assert store.save(small(spark, "two", ("x",)), path) == 2
    assert solution(first) == "one" and first.step_definitions.count() == 3 and S.search_steps(first, "door").count() == 3
    now = store.load(spark, path)
    assert solution(now) == "two" and now.step_definitions.count() == 1 and solution(store.load(spark, path, 1)) == "one"
    assert store.validate(path) == (5, "") and store.collect_versions(path) == 0
    assert store.collect_versions(path, kept_seconds=-1) == 1 and solution(store.load(spark, path)) == "two"
    with pytest.raises(ValueError):
        store.load(spark, path, 1)


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "map")
    store.save(small(spark, "zero", ("x",)), path)
    base, outcome = store.current(path), {}

    def write(name):
        try:
            outcome[name] = store.save(small(spark, name, ("x",)), path, base)
        except store.Conflict:
            outcome[name] = None

    threads = [threading.Thread(target=write, args=(n,)) for n in ("left", "right")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, commit in outcome.items() if commit == 2]
    assert len(won) == 1 and len(outcome) == 2 and solution(store.load(spark, path)) == won[0]
    assert len(store.Folder(path, spark).names(store.VERSIONS)) == 2  # the loser's tables are gone
    assert [n for n in store.Folder(path, spark).names(store.MANIFESTS) if n.endswith(".json")] == ["00000001.json", "00000002.json"]


def test_a_file_is_published_once_on_other_file_systems(spark, tmp_path):
    """The way of file systems whose rename fails on an existing name, here by a mount of another scheme."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.depot.link./maps", f"file://{tmp_path}")
    at = store.Folder("viewfs://depot/maps", spark)
    at.write("a", "first")
    at.write("b", "second")
    assert at.publish("a", "name") and not at.publish("b", "name")
    assert at.read("name") == "first" and at.names() == ["name"]


def test_a_failed_commit_leaves_the_old_map(spark, tmp_path):
    path = str(tmp_path / "map")
    store.save(small(spark, "good"), path)
    broken = small(spark, "bad")
    broken.edges = spark.range(3).select(F.raise_error(F.lit("lost")).alias("from_kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["edges"]][1:])
    with pytest.raises(Exception, match="lost"):
        store.save(broken, path)
    assert store.current(path) == 1 and solution(store.load(spark, path)) == "good"
    assert len(store.Folder(path, spark).names(store.VERSIONS)) == 1


def test_a_map_of_an_older_writer_is_read_and_replaced(spark, tmp_path):
    path = tmp_path / "map"
    m = small(spark, "old")
    for name, df in m.tables().items():
        df.write.parquet(f"{path}/{name}")
    (path / store.VERSION_FILE).write_text("4")
    assert store.validate(str(path)) == (4, "") and solution(store.load(spark, str(path))) == "old"
    store.save(small(spark, "new"), str(path))
    assert store.validate(str(path)) == (5, "") and solution(store.load(spark, str(path))) == "new"


# SQLite


def test_sqlite_rows_come_by_ranges_in_tasks(spark, tmp_path):
    path = str(tmp_path / "m.db")
    con = sqlite3.connect(path)
    con.execute('create table "t" (id integer primary key, name text, big integer, flag integer, extra blob)')
    rows = [(k, f"n{k % 50}", k * 10**9 if k % 3 else None, k % 2, b"x") for k in range(-5, 2500, 2)]
    con.executemany("insert into t values (?, ?, ?, ?, ?)", rows)
    con.execute("create table w (k text primary key, v integer) without rowid")
    con.execute("insert into w values ('a', 1), ('b', 'no number'), ('c', 12345678901)")
    con.execute("create table none (id integer)")
    con.commit()
    spark.dataSource.register(sqlite.SqliteSource)
    read = lambda schema, table, **o: spark.read.format("sqlite").schema(schema).options(path=path, table=table, range=100, **o).load()
    df = read("id long, name string, big long, flag boolean, gone string", "t")
    assert df.rdd.getNumPartitions() == 26
    assert sorted(map(tuple, df.collect())) == sorted((k, n, b, bool(f), None) for k, n, b, f, _ in rows)
    assert {r["k"]: r["v"] for r in read("k string, v int", "w").collect()} == {"a": 1, "b": None, "c": None}
    assert read("id long", "none").collect() == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = read("id long, name string, big long", "t", pushdown="true")
        got = pushed.where("name = 'n7' and id > 100 and big is not null").select("id").collect()
        assert sorted(r["id"] for r in got) == [k for k, n, b, *_ in rows if n == "n7" and k > 100 and b is not None]
        assert sorted(r["id"] for r in pushed.where(F.col("id").isin(1, 3, 4)).collect()) == [1, 3]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="no file"):
        spark.read.format("sqlite").schema("id long").options(path=path + "x", table="t").load().collect()


def test_lines_of_a_comparison_are_made_once(spark, monkeypatch):
    from stepweave.operators import compare
    from stepweave.operators.storage import Scratch

    made, plain = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df: made.append(df.columns) or plain(self, df))
    left, right = (TestMap(**{t: empty(spark, t) for t in TABLES}) for _ in range(2))
    assert compare.differences(left, right).collect() == []
    assert made[:2] == [["table", "at", "line"]] * 2
