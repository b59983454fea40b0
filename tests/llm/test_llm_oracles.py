"""The queries that have SQL against it."""

from collections import Counter

import duckdb
import pytest

from banyan.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*rel.columns).collect())) == Counter(rel.fetchall())
