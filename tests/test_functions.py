"""Time, counters, three-state sums, ratios, log text and searches on small frames."""

import random
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeloom.functions import counters, logs, ratios, search, timeutil, tristate


def test_time_expressions():
    assert timeutil.parse("1700000000000000") == 1_700_000_000_000_000
    assert timeutil.parse("now-90m", now=10**16) == 10**16 - 90 * 60_000_000
    assert timeutil.parse("now-2w", now=10**16) == 10**16 - 14 * 86_400_000_000
    assert timeutil.parse("2024-01-01T01:00:00.000250+01:00") == 1_704_067_200_000_250
    for bad in ("2024-01-01T00:00:00", "now-3y", "yesterday"):
        with pytest.raises(ValueError):
            timeutil.parse(bad)


@given(st.integers(1, 1_440), st.integers(1, 10**13))
def test_bounds_cover_the_range(columns, width):
    span = timeutil.TimeRange(5, 5 + width)
    b = span.bounds(columns)
    assert b[0] == 5 and b[-1] == 5 + width and len(b) == columns + 1 and b == sorted(b)


def test_microseconds_and_hours_before_1970(spark):
    got = spark.sql("SELECT timestamp_ntz'1970-01-01 00:00:00.000001' AS a, timestamp_ntz'1969-12-31 23:59:59' AS b").select(timeutil.ts_us("a").alias("a"), timeutil.ts_us("b").alias("b"), timeutil.hour_of(F.lit(-1)).alias("h")).first()
    assert (got["a"], got["b"], got["h"]) == (1, -1_000_000, -3_600_000_000)


def test_adjacent_rates_reset_on_nulls_and_falls(spark):
    rows = [("a", 0, 10), ("a", 1_000_000, 30), ("a", 2_000_000, None), ("a", 3_000_000, 40), ("a", 4_000_000, 5), ("a", 6_000_000, 9), ("b", 0, 1)]
    got = {(r["e"], r["ts"]): r["rate"] for r in counters.adjacent(spark.createDataFrame(rows, "e string, ts long, v long"), ["e"], "v").collect()}
    assert [got["a", t * 1_000_000] for t in (0, 1, 2, 3, 4, 6)] == [None, 20.0, None, None, None, 2.0] and got["b", 0] is None


@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_matches_brute_force(spark, tolerance):
    r = random.Random(1)
    left = [(i, r.randrange(3), r.randrange(40)) for i in range(80)]
    right = sorted({(r.randrange(3), r.randrange(40)) for _ in range(30)})
    right = [(k, t, None if t % 7 == 0 else t * 10) for k, t in right]
    got = {x["id"]: (x["asof_ts"], x["v"]) for x in counters.asof(spark.createDataFrame(left, "id long, k long, ts long"), spark.createDataFrame(right, "k long, ts long, v long"), ["k"], ["v"], tolerance=tolerance).collect()}
    for i, k, t in left:
        best = max(((b, v) for kk, b, v in right if kk == k and b <= t), key=lambda x: x[0], default=(None, None))
        if best[0] is not None and tolerance is not None and t - best[0] > tolerance:
            best = (None, None)
        assert got[i] == best


def test_predecessor_is_of_the_moment_before(spark):
    df = spark.createDataFrame([(1, 7, 10), (2, 8, 1), (3, 7, 15), (3, 8, 4)], "ts long, pid long, v long")
    got = {(r["ts"], r["pid"]): r["prev_v"] for r in counters.predecessor(df, ["pid"], ["v"]).collect()}
    assert got == {(1, 7): None, (2, 8): None, (3, 7): None, (3, 8): 1}


def test_moments(spark):
    df = spark.createDataFrame([("x", 1), ("x", 5), ("x", 9), ("y", 2)], "d string, ts long")
    assert [tuple(r) for r in counters.moments(df, 8).collect()] == [(5, 2)]
    assert sorted(tuple(r) for r in counters.moments(df, 8, ["d"]).collect()) == [("x", 5, 1), ("y", 2, None)]


def test_three_states(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", None, False), ("b", 2, False), ("b", None, True), ("c", None, False)], "g string, v long, u boolean")
    got = {r["g"]: r["t"] for r in df.groupBy("g").agg(tristate.total(F.col("v"), F.col("u")).alias("t")).collect()}
    assert got == {"a": 1, "b": None, "c": None}
    pairs = spark.createDataFrame([("a", 1, 2), ("a", None, None), ("b", 1, None), ("c", 3, 0)], "g string, x long, y long")
    got = {r["g"]: (r["s"], r["n"]) for r in pairs.groupBy("g").agg(tristate.strict_ratio(F.col("x"), F.col("y")).alias("s"), tristate.neutral_ratio(F.col("x"), F.col("y")).alias("n")).collect()}
    assert got == {"a": (None, 0.5), "b": (None, None), "c": (None, None)}
    row = spark.createDataFrame([(1, None, 2), (None, None, None)], "a long, b long, c long").select(tristate.row_sum(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert [r["s"] for r in row] == [3, None]


def test_derived_metrics_use_what_is_there(spark):
    df = spark.createDataFrame([(10, 4, 0), (None, 2, 5)], "d_rows long, d_calls long, d_wal_bytes long")
    got = df.select(*ratios.derived(ratios.STATEMENT, set(df.columns))).collect()
    assert [tuple(r) for r in got] == [(2.5, 0.0), (None, 2.5)]
    caps = spark.createDataFrame([(-1, 100, 8), (150, 100, 8), (900, 100, 8), (0, 100, 8)], "q long, p long, c long").select(ratios.cpu_capacity(F.col("q"), F.col("p"), F.col("c")).alias("x")).collect()
    assert [r["x"] for r in caps] == [8.0, 1.5, 8.0, None]


MESSAGES = {
    'relation "users" does not exist at character 15': 'relation "..." does not exist',
    "invalid value '' for 'x y'": "invalid value '' for '...'",
    'an open " quote': 'an open " quote',
    '""abc" tail': '""abc" tail',
    "Key (id)=(42) already exists": "Key (...)=(...) already exists",
    "process 12 acquired lock on relation 16 of database 5 after 10.25 ms": "process ... acquired lock on relation ... of database ... after ... ms",
    "transaction x then transaction 9": "transaction x then transaction 9",
    "flush up to 0/16B3D40 is ahead of A/1": "flush up to x/x is ahead of x/x",
    'invalid input syntax for type integer: "abc" more': "invalid input syntax for type integer: ...",
    "Permission denied for table secrets": "Permission denied for table ...",
    "invalid byte sequence for encoding UTF8: 0xff": "invalid byte sequence for encoding ...",
    "é" * 200: "é" * 128,
}


def test_error_patterns(spark):
    df = spark.createDataFrame([(m,) for m in MESSAGES], "m string")
    got = {r["m"]: r["p"] for r in df.select("m", logs.normalize_error(F.col("m")).alias("p")).collect()}
    assert got == MESSAGES
    assert df.limit(1).select(logs.normalize_sql(F.lit("select 1, x2 from t where a = 3.5")).alias("p")).first()["p"] == "select ?, x2 from t where a = ?"


def test_error_families(spark):
    cases = [("deadlock detected", "ERROR", "lock"), ("anything", "PANIC", "data_corruption"), ("odd", "FATAL", "system"), ("odd", "ERROR", "other"), ("server process was terminated by signal ...: Killed", "LOG", "resource"), ('role "..." does not exist', "ERROR", "auth"), ("canceling statement due to user request", "ERROR", "timeout")]
    df = spark.createDataFrame(cases, "p string, s string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", logs.classify_error(F.col("p"), F.col("s")).alias("got")).collect())


def test_log_lines_parse(spark):
    lines = [
        "2024-01-01 00:00:00.123 UTC [77] LOG:  duration: 5012.5 ms  statement: select\n1", "2024-01-01 00:00:01 UTC [8] LOG:  process 8 still waiting for ShareLock on transaction 5 after 1000.1 ms",
        '2024-01-01 00:00:01 UTC [9] LOG:  automatic vacuum of table "db.public.t": index scans: 1', "\tcontinued", '2024-01-01 00:00:01 UTC [9] LOG:  temporary file: path "base/1", size 42',
    ]
    rows = spark.createDataFrame([(x.replace("\n", " "),) for x in lines], "l string").select(*logs.parse_stderr(F.col("l")))
    got = rows.select("pid", "severity", *logs.parse_message(F.col("message"))).collect()
    assert (got[0]["pid"], got[0]["slow_ms"], got[0]["slow_sql"]) == (77, 5012.5, "select 1")
    assert (got[1]["lock_pid"], got[1]["lock_phase"], got[1]["lock_target"], got[1]["lock_ms"]) == (8, "still waiting for", "transaction 5", 1000.1)
    assert (got[2]["auto_kind"], got[2]["auto_relation"], got[3]["severity"], got[4]["temp_bytes"]) == ("vacuum", "db.public.t", None, 42)


def test_searches(spark):
    df = spark.createDataFrame([("Select ONE", 3, 2), ("delete.two", 10, 5), (None, None, 1)], "t string, n long, d long")
    count = lambda c: df.where(c).count()
    assert count(search.glob(F.col("t"), "s?lect*one")) == 1 and count(search.glob(F.col("t"), "e.t")) == 1 and count(search.glob(F.col("t"), "e+t")) == 0
    assert count(search.exact(F.col("t"), "SELECT one")) == 1 and count(search.contains(F.col("t"), "TE.T")) == 1 and count(search.identifier(F.col("n"), "10")) == 1
    assert count(search.above(F.col("n"), "1.5", F.col("d"))) == 1 and count(search.below(F.col("n"), "1.500000001", F.col("d"))) == 1 and count(search.above(F.col("n"), "3")) == 1
    assert search.quantity("1.5 KiB") == 1536 and search.quantity("2min") == 120 and search.quantity("99.5%") == Decimal("99.5") and search.quantity("3kB/s") == 3000
    for bad in ("1.5 B", "101%", "3 parsecs", "-1", "1.0000000001"):
        with pytest.raises(ValueError):
            search.quantity(bad)
