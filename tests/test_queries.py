"""Every query of the library against its SQL on the smallest tables."""

import pytest
from conftest import DATA

from quillmill.catalog import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, DATA)
    names = sorted(df.columns)
    rows = sorted(map(tuple, df.select(*names).collect()), key=repr)
    if q.sql is None:
        return
    rel = duck.sql(q.sql)
    assert sorted(rel.columns) == names
    assert rows == sorted(map(tuple, duck.sql(f"SELECT {', '.join(names)} FROM ({q.sql})").fetchall()), key=repr)
