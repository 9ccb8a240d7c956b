import pytest
from oracle import connect, rows_of, rows_of_sql

from quarrybed.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert rows_of(catalog.QUERIES[name](spark, sf_dir)) == rows_of_sql(con, catalog.ORACLE_SQL[name])


def test_greedy_assignment_equals_a_scan(spark, sf_dir):
    pairs = sorted(((r.score, r.item_id, r.doc_id) for r in catalog.QUERIES["weighted_jaccard"](spark, sf_dir).collect()), reverse=True)
    a, b, want = set(), set(), set()
    for s, x, y in pairs:
        if x not in a and y not in b:
            a.add(x), b.add(y), want.add((s, x, y))
    assert {(r.score, r.item_id, r.doc_id) for r in catalog.QUERIES["greedy_assignment"](spark, sf_dir).collect()} == want


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["item_id", "doc_id", "score"] or set(e.entry(spark).columns) == {"item_id", "doc_id", "score"}
