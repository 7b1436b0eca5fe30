from __future__ import annotations

import pytest

from arbora import fixtures, queries
from tests.compare import same, tables


@pytest.fixture(scope="module")
def known(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, known, name):
    same(queries.QUERIES[name](spark, sf_dir), known, queries.ORACLES[name])


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLES.keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_ways_of_the_page_plan(sf_dir):
    """Documents with contents come to their sections by the way they are made for, and each step has work to do."""
    known, got = tables(sf_dir), {}
    for way in fixtures.WAYS:
        sql = queries.ORACLES[f"page_index_by_{way}"]
        count = """SELECT (SELECT count(DISTINCT d) FROM way_1), (SELECT count(DISTINCT d) FROM way_2), (SELECT count(DISTINCT d) FROM way_3), (SELECT count(*) FROM way_1_g WHERE decision = 'repair'),
          (SELECT count(*) FROM numbered n JOIN walked w ON w.d = n.d AND w.k = n.k WHERE n.pg IS NULL AND w.found IS NOT NULL), (SELECT count(*) FROM begun), (SELECT max(len(path)) FROM nodes), (SELECT count(*) FROM chosen WHERE run <> 0 AND last_page > 2)"""
        got[way] = known.sql(sql[: sql.index("\nSELECT o.d AS doc_id")] + "\n" + count).fetchall()[0]
    docs = known.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    numbers, titles, heads, parts = (got[w] for w in fixtures.WAYS)
    assert numbers[0] > 0.9 * docs and numbers[3] > 0.3 * docs and numbers[4] > docs // 2
    assert titles[1] > 0.5 * docs and heads[2] == docs
    assert parts[5] > docs and parts[6] == 3
    assert numbers[7] > 0
