"""Every query with a SQL counterpart must equal it."""

import pytest

import check
from shelfmark.plans import catalog
from tests.conftest import DATA


@pytest.fixture(scope="module")
def con():
    return check.open_duckdb(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    result = check.compare(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLES[name])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_streamed_corpus_equals_batch(spark, tables):
    batch = catalog.QUERIES["chunk_docs"](spark, DATA).selectExpr(
        "concat(source, '/', doc_id, '.txt') path", "chunk_no", "content"
    )
    streamed = catalog.QUERIES["stream_ingest"](spark, DATA)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, streamed.select("path", "chunk_no", "content").collect()))
