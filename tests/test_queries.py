"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from emberscope.plans import oracles
from emberscope.plans.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return format(v, ".9g") if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, TABLES)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{TABLES}/{t}'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracles.SQL[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(want)
