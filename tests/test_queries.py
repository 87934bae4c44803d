"""Every registered query of the corpus against its SQL, or at least to its end."""

import pytest

from quire import plans
from tests.compare import assert_same, connect

QUERIES, SQL = plans.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.count() >= 0 and df.columns


def test_approximate_neighbours_are_mostly_the_exact_ones(spark, sf_dir):
    found, exact = ({(r.query_id, r.document_id) for r in QUERIES[name](spark, sf_dir).collect()} for name in ("search_ann", "knn_cross_join"))
    assert len(found & exact) >= 0.9 * len(exact) and len(found) == len(exact)


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and "mode_used" in found.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
