"""Every registered query of the reference's own operators gives the rows of its SQL."""

import duckdb
import pytest

from sheetloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    places = [names.index(c) for c in df.columns]
    expected = sorted(repr(tuple(r[i] for i in places)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == expected
    assert expected or name in ("page_set_mismatches",)
