"""Every registered query runs on the smallest data; where there is SQL, results agree."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_agree_with_sql(spark):
    import duckdb

    from pulsegrid.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        rows = lambda d, cols=cols: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want), name
    for name in QUERIES.keys() - SQL.keys():
        QUERIES[name](spark, SF).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_whole_joins(spark):
    """The joins over all objects: spans and writes of every one, and no rows but those."""
    from pulsegrid.model import cam_events
    from pulsegrid.plans.queries import QUERIES

    cam = [(r["seq"], r["t"], r["x"], r["y"], r["pol"], r["obj"]) for r in cam_events(spark, SF).collect()]
    obj = {c[0]: c[5] for c in cam}
    pairs = {(r["seq"], r["span"]) for r in QUERIES["interval_join"](spark, SF).collect()}
    assert pairs == {(c[0], s[0]) for s in cam if s[4] == 0 for c in cam if s[1] - 500_000 < c[1] <= s[1]}
    assert {obj[s] for _, s in pairs} == {c[5] for c in cam if c[4] == 0} and len({obj[s] for _, s in pairs}) > 7
    writes = {r["seq"] for r in QUERIES["roi_writes"](spark, SF).collect()}
    assert writes == set(obj)
    mask, on = {}, set()
    for t in sorted({c[1] for c in cam}):
        here = sorted(c for c in cam if c[1] == t)
        on |= {c[0] for c in here if mask.get((c[2] // 4, c[3] // 4))}
        for _, _, x, y, pol, _ in here:
            bx, by = x // 4, y // 4
            dx, dy = ((0, 1), (1, 0), (0, -1), (-1, 0))[pol]
            mask[bx + dx, by + dy] = 1
            mask[(bx - dx, by - dy) if pol < 2 else (bx, by)] = 0
    assert {r["seq"] for r in QUERIES["roi_filter"](spark, SF).collect()} == on and on


def test_blended_colours_agree_with_sql(spark, tmp_path):
    """Colours of a few layers end in a 5 behind the last digit that counts, where the last bit of a power decides."""
    import random
    from datetime import datetime, timedelta

    import duckdb

    from pulsegrid.plans.queries import QUERIES, SQL

    rng, start = random.Random(5), datetime(2024, 1, 1)
    kinds = ("click", "error", "purchase", "signup", "view")
    user = lambda k: rng.randrange(64) if k % 3 else rng.randrange(8)
    value = lambda k: float(rng.randrange(36) if k % 3 else k // 3000 * 8 + rng.randrange(8))
    rows = [(k, start + timedelta(seconds=5 * k), user(k), rng.choice(kinds), value(k), "") for k in range(12_000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["frames_dual"](spark, str(tmp_path)).select("index", "y", "x", "r", "g", "b").collect())
    want = sorted(con.sql(f"select index, y, x, r, g, b from ({SQL['frames_dual']})").fetchall())
    assert len(want) > 10_000 and got == want


def test_contract():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= q.keys() and len(q) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
