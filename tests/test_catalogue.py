import pytest

from folioscope.plans import archive, catalogue, evidence, expressions, merges, outputs, prints  # noqa: F401  the others register their queries in catalogue
from tests.compare import compared


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    compared(spark, sf, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry_modules():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
