"""Every query of the catalogue against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tidelog import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert ours == theirs


def simulated(calls, capacity):
    """Hits of each call, with plain lists that are searched anew each time."""
    first, main, dropped, sizes, again, hits = [], [], [], {}, {}, []
    for key, size in calls:
        hits.append(key in sizes)
        if hits[-1]:
            again[key] = True
            continue
        sizes[key], again[key] = size, False
        if key in dropped:
            dropped.remove(key)
            main.append(key)
        else:
            first.append(key)
        while sum(sizes.values()) > capacity:
            cold = [k for k in first if not again[k]]
            if cold:
                at = first.index(cold[0])
                moved, first = first[:at], first[at + 1 :]
                dropped = [*dropped, cold[0]][-64:]
            else:
                moved, first = first, []
            main += moved
            again.update(dict.fromkeys(moved, False))
            if not cold:
                turn = next((i for i, k in enumerate(main) if not again[k]), None)
                if turn is None:
                    again.update(dict.fromkeys(main, False))
                    turn = 0
                again.update(dict.fromkeys(main[:turn], False))
                cold = [main[turn]]
                main = main[turn + 1 :] + main[:turn]
            del sizes[cold[0]]
    return hits


def test_cache_sim(spark):
    from tidelog.sources.tables import timed_events

    expected = set()
    events = timed_events(spark, DATA).select("user_id", "props", "ms", "seq").orderBy("ms", "seq").collect()
    for shard in range(4):
        calls = [(f"user:{e['user_id']}", len(f"user:{e['user_id']}") + len(e["props"])) for e in events if e["user_id"] % 4 == shard]
        expected.add((shard, len(calls), sum(simulated(calls, catalog.CACHE_BYTES))))
    rows = catalog.queries()["cache_sim"](spark, DATA).collect()
    assert {(r["shard"], r["reads"], r["hits"]) for r in rows} == expected
    assert all(0 < hits < reads for _, reads, hits in expected)


def test_schema_patterns(spark):
    from tidelog.operators import schemas

    rows = [("a.b:1", '{"x": 1}'), ("a.b:12", "[]"), ("aXb:1", "raw"), ("a.b:2", None), ("a.b:3", '{"x": null}')]
    df = schemas.parsed(spark.createDataFrame(rows, "key string, value string"), {"a.b:*": "x int NOT NULL", "a.*:*": "x string", "*:9": "y int", "a.b:1*": "x int"})
    got = {r["key"]: (r["schema"], r["data"], r["error"]) for r in df.collect()}
    assert got["a.b:1"] == ("a.b:1*", '{"x":1}', None)
    assert got["aXb:1"] == (None, "raw", None)
    assert got["a.b:2"] == ("a.b:*", None, None)
    assert got["a.b:3"] == ("a.b:*", None, "schema_error")
    assert got["a.b:12"] == ("a.b:1*", None, "schema_error")


def test_entry_lists_everything(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["pos", "key", "value"]
