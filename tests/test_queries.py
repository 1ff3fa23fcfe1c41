import datetime
import math
import os

import duckdb
import pytest

from tianguis.plans import analysis_queries, payload_queries  # noqa: F401 - these register their queries
from tianguis.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the trade tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple((plain(r[i]) is None, str(plain(r[i]))) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_chained_duplicates_against_a_search(spark, duck):
    """Every row's component by a search over shared keys, one row at a time."""
    from tianguis.plans.listings import LISTINGS_SQL

    given = duck.execute(f"""{LISTINGS_SQL} SELECT (((l_orderkey * 8 + l_linenumber) * 20000 + l_partkey) * 1000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT), captured_at,
      source_id || l_orderkey, concat_ws('|', lower(seller), title, CAST(price AS VARCHAR), currency) FROM listings""").fetchall()
    by_key: dict = {}
    for uid, _, *keys in given:
        for key in enumerate(keys):
            by_key.setdefault(key, []).append(uid)
    keys_of, at, want = {u: list(enumerate(k)) for u, _, *k in given}, {u: t for u, t, *_ in given}, {}
    for uid in keys_of:
        if uid not in want:
            found, open_rows = {uid}, [uid]
            while open_rows:
                near = {v for key in keys_of[open_rows.pop()] for v in by_key[key]} - found
                found |= near
                open_rows += near
            kept = max(found, key=lambda u: (at[u], -u))
            want.update(dict.fromkeys(found, kept))
    got = QUERIES["strong_dedup_components"](spark, DATA).collect()
    assert {r.row_uid: r.canonical_uid for r in got} == want and len(got) == len(given) and len(set(want.values())) < len(want)
