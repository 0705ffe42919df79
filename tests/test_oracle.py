"""Every registered query of the library against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from scrubwell import catalog
from scrubwell.sources.tables import read_table, register, write_table

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in row]) for row in rows)


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) and catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert plain(df.collect()) == plain([[r[i] for i in order] for r in rel.fetchall()])


def test_sources(spark, tmp_path):
    register(spark, str(SF), ["region"])
    assert spark.sql("SELECT count(*) FROM region").first()[0] == 5
    write_table(read_table(spark, str(SF), "region"), str(tmp_path), "r", partition_by=("r_regionkey",))
    assert read_table(spark, str(tmp_path), "r").count() == 5
