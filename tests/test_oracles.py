"""Every registered query against its SQL on the smallest tables."""

import pytest

from gridspark.catalog import load
from gridspark.catalog.registry import oracle, runner
from tools.check_oracles import compare

QUERIES = load()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, sf, name):
    q = QUERIES[name]
    df = runner(q)(spark, sf)
    if q.sql is None:
        assert df.collect() is not None
        return
    assert compare(df, duck, oracle(q)).startswith("ok")
