import __spark_entry__
from scrubwell import catalog


def test_flagship_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert all(isinstance(text, str) and text.strip() for text in sql.values())
