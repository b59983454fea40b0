"""Every registered query of the reference's operators against its SQL."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from banyan.queries import ORACLES, QUERIES


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 6)
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    if isinstance(x, (datetime.datetime, bool, str)) or x is None:
        return x
    return float(x)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "customer"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
