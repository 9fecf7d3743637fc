"""Every query that has SQL, against it, on whole tables."""

import duckdb
import pytest

from textcurate.llm import catalog

SF = "/root/testdata/sf0.01"


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLE[name]).df())
