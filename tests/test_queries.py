"""Registered queries against their DuckDB twins, on the smallest table."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each shape; the functions have a value test of their own.
CHOSEN = [n for n in engine.QUERIES if not n.startswith(("worker_", "tumbling_")) or n in ("worker_mean", "worker_zscore", "worker_blocked", "tumbling_vector", "tumbling_median", "tumbling_ema_weight")]


@pytest.fixture(scope="module")
def duck(sf):
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return own


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", CHOSEN)
def test_twin(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*(f"`{c}`" for c in names)).collect()]
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = [tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_engine_query_has_a_twin():
    assert engine.QUERIES.keys() == engine.SQL.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def events_in(folder, rows):
    """An events table of (event_type, seconds, value) rows in the order of their ids."""
    own = duckdb.connect()
    own.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    own.executemany("INSERT INTO e SELECT $1, TIMESTAMP '2024-01-01' + to_microseconds(CAST($2 AS BIGINT) * 1000000), 1, $3, $4, '{\"k\": 1}'", [(i, t, kind, v) for i, (kind, t, v) in enumerate(rows)])
    own.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT PARQUET)")
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return own


def twins(spark, folder, own, name):
    """Sorted rows of a query and of its SQL."""
    result = own.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    got = entry.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted((tuple(r) for r in got), key=repr), sorted(result.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["accessor_asof", "zip_latest"])
def test_values_of_the_same_time_are_known(spark, tmp_path, name):
    own = events_in(tmp_path, [("error", 0, 1.0), ("view", 0, 2.0), ("purchase", 5, 3.0), ("view", 5, 4.0), ("error", 5, 5.0), ("view", 7000, 6.0), ("purchase", 7000, 7.0), ("error", 7000, 8.0)])
    got, want = twins(spark, tmp_path, own, name)
    assert got == want
    assert len(got) == 2


@pytest.mark.parametrize("name", ["worker_mod", "field_atomics"])
def test_rest_is_nothing_where_the_quotient_rounds_to_a_whole_number(spark, tmp_path, name):
    own = events_in(tmp_path, [("click", 0, 210.95), ("click", 1, 51.11), ("view", 0, 489.78), ("view", 1, 89.98)])
    got, want = twins(spark, tmp_path, own, name)
    assert got == want


@pytest.mark.parametrize("name", ["worker_pow", "field_atomics"])
def test_large_powers_have_every_bit(spark, tmp_path, name):
    own = events_in(tmp_path, [("click", 0, 1193.63), ("click", 1, 1182.31), ("error", 0, 1173.34), ("error", 1, 1141.93), ("signup", 0, 1174.43), ("signup", 1, 959.76), ("purchase", 0, 1485.75), ("purchase", 1, 1260.97), ("view", 0, 50.0), ("view", 1, 10.0)])
    got, want = twins(spark, tmp_path, own, name)
    power = -1 if name == "worker_pow" else [c[0] for c in own.execute(entry.oracle_sql()[name]).description].index("fn_pow")
    assert [(r[:2], r[power]) for r in got] == [(r[:2], r[power]) for r in want]


@pytest.mark.parametrize("name", ["worker_pct_change", "field_atomics"])
def test_large_changes_are_scaled_before_the_division(spark, tmp_path, name):
    own = events_in(tmp_path, [(kind, t, v) for kind, pair in zip("abcd", ((50.01, 218.24), (50.01, 218.38), (49.98, 272.21), (50.02, 415.94)), strict=True) for t, v in enumerate(pair)])
    got, want = twins(spark, tmp_path, own, name)
    change = -1 if name == "worker_pct_change" else [c[0] for c in own.execute(entry.oracle_sql()[name]).description].index("fn_pct_change")
    assert [(r[:2], r[change]) for r in got] == [(r[:2], r[change]) for r in want]
