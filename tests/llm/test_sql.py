"""The registered queries that have SQL, against it in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from wardstream.llm import queries

AT = "/root/testdata/sf0.001"


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for p in Path(AT).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, AT)
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str) == want and want
