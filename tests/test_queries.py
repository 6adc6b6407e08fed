"""Every query of the catalogue that SQL can tell gives the rows of its SQL, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from corpusloom.plans import catalogue

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(HERE).exists(), reason="no tables")


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([r[i] for i in order]) for r in got)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(HERE).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(catalogue.ORACLE[name])
    want = rows([d[0] for d in want.description], want.fetchall())
    df = catalogue.QUERIES[name](spark, HERE)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
