"""Every registered query against its SQL on the same tables."""

import pytest
from conftest import FOLDER, canonical, spark_rows

from mnemoframe.plans.catalog import load

CATALOG = load()


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(name, spark, duck):
    query = CATALOG[name]
    got = spark_rows(query.run(spark, FOLDER))
    if query.sql is None:
        assert got[1]
        return
    cursor = duck.execute(query.sql)
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
