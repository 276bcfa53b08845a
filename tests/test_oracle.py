"""Every query with SQL gives the SQL's rows on the smallest tables; every query gives rows of a stable schema."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from termlake import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def same(rows):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = duck.execute(plans.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(d[0] for d in got.description)
    order = [[d[0] for d in got.description].index(c) for c in columns]
    assert same(tuple(r) for r in df.select(*columns).collect()) == same([r[i] for i in order] for r in got.fetchall())


def test_every_query_has_sql_but_the_exact_tokenizer():
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == {"ngram_tokens_exact"}
