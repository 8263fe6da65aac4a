import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from deltaweave.plans.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


def rows(pdf):
    plain = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(str(plain(v)) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries()))
def test_equals_sql(spark, data, duck, name):
    got = queries()[name](spark, data).toPandas()
    if name in oracle_sql():
        assert rows(got) == rows(duck.execute(oracle_sql()[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
