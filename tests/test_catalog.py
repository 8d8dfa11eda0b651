import pytest

from eventloom import catalog

from .compare import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck(SF, catalog.SQL[name])
