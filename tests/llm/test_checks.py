"""The SQL twins of the llm queries on the smallest tables, where those are there."""

import os
from collections import Counter

import pytest

from siftline.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(registry.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    assert Counter(repr(tuple(r)) for r in df.select(*cols).collect()) == Counter(repr(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())
