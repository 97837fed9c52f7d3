"""Every query that has SQL gives the same rows as an independent engine."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

import tidemark.plans.audits  # noqa: E402, F401
from tidemark.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, str | bool):
            return (0, str(v))
        try:
            return (1, "nan") if math.isnan(float(v)) else (2, f"{float(v):.6f}")
        except TypeError:
            return (0, str(v))

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLE_SQL[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
