import pytest
from compare import connect, same

from stepweave.plans.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, sf, con, name):
    same(queries()[name](spark, sf), con, oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert row["total"] == 1000 and row["bound"] + row["unbound"] == 1000
    assert set(e.oracle_sql()) <= set(e.queries())


def test_feature_files_do_not_grow_with_the_map(spark, sf, monkeypatch):
    """A feature's scenarios stand in several files, each parsed and passed on by itself, with the same result."""
    from stepweave.plans import queries as Q

    want = sorted(map(tuple, Q.gherkin_files(spark, sf).collect()))
    monkeypatch.setattr(Q, "FILE_IDS", 50)
    assert sorted(map(tuple, Q.gherkin_files(spark, sf).collect())) == want
    files = ["Feature: A\n\n  Scenario: S 1\n    Given x\n", "Feature: B\n\n  Scenario: S 2\n    When y\n\n  @t\n  Scenario: S 3\n    Then z\n", None]
    got = list(Q._scenarios([Q.pa.RecordBatch.from_pydict({"content": files})]))
    assert [[r["name"] for r in b.to_pylist()] for b in got] == [["S 1"], ["S 2", "S 3"]]
