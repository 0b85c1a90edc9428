"""Every registered query with SQL against DuckDB on the smallest tables, and those without for rows."""

import datetime
import decimal
import math
import os

import duckdb
import pandas as pd
import pytest

import tesserae.more_queries  # noqa: F401  it registers more
import tesserae.search_queries  # noqa: F401  and so does it
from tesserae.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or v is pd.NaT:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 4)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v).tz_localize(None))
    return plain(v.item()) if hasattr(v, "item") else v


def rows(df, names):
    return sorted((tuple(plain(x) for x in r) for r in df[names].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    got = df.toPandas()
    if name in SQL:
        rel = con.sql(SQL[name])
        kinds = dict(zip(rel.columns, map(str, rel.types)))
        assert {c: KINDS[k] for c, k in df.dtypes} == kinds or name in LOOSE
        names = sorted(rel.columns)
        assert rows(got, names) == rows(rel.df(), names)
    else:
        assert len(got)


#: Results whose integers DuckDB makes wider.
LOOSE: set[str] = set()
