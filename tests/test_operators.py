"""Operators on small frames with known results."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import counters
from gaugeloom.functions.timeutil import TimeRange
from gaugeloom.operators import detect, events, heatmap, relations, rows, sequence, series, snapshot


def test_grid_matches_a_direct_fold(spark):
    r = random.Random(2)
    span = TimeRange(100, 1_100)
    data = [(e, t, r.randrange(100)) for e in range(12) for t in sorted(r.sample(range(0, 1_200), 15))]
    df = spark.createDataFrame(data, "e long, ts long, v long")
    for kind in ("gauge", "counter"):
        want = {}
        for e in range(12):
            seen = [(t, v) for x, t, v in data if x == e and 100 <= t < 1_100]
            cells = {}
            for k, (t, v) in enumerate(seen):
                mid = max(100, seen[k - 1][0] + (t - seen[k - 1][0]) // 2) if k else t
                cells.setdefault(min(6, (mid - 100) * 7 // 1_000), [seen[k - 1]] if k else []).append((t, v))
            for c, obs in cells.items():
                (t0, v0), (t1, v1) = obs[0], obs[-1]
                want[e, c] = v1 if kind == "gauge" else ((v1 - v0) / ((t1 - t0) / 1e6) if t1 > t0 and v1 >= v0 else None)
        got = {(x["e"], x["col"]): x["cell"] for x in heatmap.cells(df, ["e"], "v", kind, span, 7).collect()}
        assert got == want


def test_ranking_ties_by_text_and_unknown_last(spark):
    df = spark.createDataFrame([(10, 1, 5), (9, 1, 5), (8, 1, 7), (7, 1, 9), (7, 2, 3)], "e long, ts long, v long")
    gauge = heatmap.ranking(df, "e", "v", "gauge", TimeRange(0, 10), 3).orderBy("rank").collect()
    assert [x["e"] for x in gauge] == [7, 8, 10] and gauge[0]["others_total"] == 5 and gauge[0]["entities"] == 4
    counter = heatmap.ranking(df, "e", "v", "counter", TimeRange(0, 10), 9).orderBy("rank").collect()
    assert [x["total"] for x in counter] == [None] * 4 and [x["e"] for x in counter] == [10, 7, 8, 9]
    with pytest.raises(ValueError):
        heatmap.ranking(df, "e", "v", "gauge", TimeRange(0, 10), 501)


def test_bands_and_shared_mean(spark):
    df = spark.createDataFrame([("a", 0, 200), ("a", 5, 100), ("b", 0, 60), ("c", 5, 160)], "e string, ts long, v long")
    got = {x["col"]: (x["totals"], x["others"]) for x in heatmap.bands(df, "e", "v", "gauge", TimeRange(0, 10), 1, 1).collect()}
    assert got == {0: (320, 220)}
    means = [(x["e"], x["mean"]) for x in heatmap.shared_mean(df, "e", "v", TimeRange(0, 10), 3).orderBy("rank").collect()]
    assert means == [("a", 150.0), ("c", 80.0), ("b", 30.0)]
    steps = spark.createDataFrame([(0,), (1,), (50,), (100,)], "v long").select(heatmap.intensity(F.col("v"), F.lit(100)).alias("s")).collect()
    assert [x["s"] for x in steps] == [0, 1, 5, 6]


def test_snapshot_rates_need_the_same_start(spark):
    df = spark.createDataFrame([(1_000_000, 1, 5, 10), (1_000_000, 2, 5, 10), (3_000_000, 1, 5, 14), (3_000_000, 2, 6, 50), (3_000_000, 3, 5, 1), (9_000_000, 1, 5, 99)], "ts long, pid long, starttime long, n long")
    got = {x["pid"]: x["n"] for x in snapshot.with_rates(df, 4_000_000, ["pid"], ["n"], same=["starttime"]).collect()}
    assert got == {1: 2.0, 2: None, 3: None}
    assert snapshot.with_rates(df, 1_500_000, ["pid"], ["n"]).where("n IS NULL").count() == 2


def test_pages_put_nulls_last_either_way(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 7)], "id long, v long")
    assert [x["id"] for x in snapshot.page(df, "v", ["id"], 4).collect()] == [3, 4, 2, 1]
    up = snapshot.page(df, "v", ["id"], 3, descending=False).collect()
    assert [x["id"] for x in up] == [2, 3, 4] and up[0]["truncated"] and up[0]["eligible"] == 4
    assert snapshot.look_back_of(5) == 20_000_000 and snapshot.look_back_of(300) == 750_000_000
    first = rows.page(df, "id", 2)
    assert [(x["id"], x["has_more"]) for x in first.collect()] == [(1, True), (2, True)]
    assert [(x["id"], x["has_more"]) for x in rows.page(df, "id", 2, after=2).collect()] == [(3, False), (4, False)]


def test_typed_filter_tells_zeros_apart(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, 1.5)], "id long, x double")
    assert [r["id"] for r in rows.typed_equals(df, {"x": -0.0}).collect()] == [2]
    assert [r["id"] for r in rows.typed_equals(df, {"x": 1.5, "id": 3}).collect()] == [3] and rows.typed_equals(df, {"absent": 1}).count() == 0


def test_slices_by_semantics(spark):
    df = spark.createDataFrame([(t,) for t in (0, 40, 45, 50, 60, 70, 75, 99)], "ts long")
    got = lambda s: sorted(r["ts"] for r in rows.slice_rows(df, 50, 60, s, context=20).collect())
    assert got("event_stream") == [50, 60] and got("changed") == [40, 45, 50, 60, 70, 75] and got("snapshot_full") == [45, 50, 60, 70]


def test_latest_of_each_part(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 2, 5), ("a", 7_200_000_001, 30), ("b", 7_200_000_001, 1), ("a", 7_200_000_009, 0)], "p string, ts long, v long")
    got = sorted(tuple(r) for r in relations.latest_of_each(df, "p", ["v"]).select("ts", "parts", "v").collect())
    assert got == [(1, 1, 10), (2, 2, 15), (7_200_000_001, 2, 31), (7_200_000_009, 2, 1)]


def test_latest_of_each_part_without_a_value(spark):
    """A null is unknown while it is the newest, and leaves no trace in later sums."""
    hour = 3_600_000_000
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 1), ("a", 3, None), ("b", hour + 1, 2), ("a", hour + 2, 7), ("c", hour + 3, None)], "p string, ts long, v long")
    got = sorted(tuple(r) for r in relations.latest_of_each(df, "p", ["v"]).select("ts", "parts", "v").collect())
    assert got == [(1, 1, 5), (2, 2, 6), (3, 2, None), (hour + 1, 2, None), (hour + 2, 2, 9), (hour + 3, 3, None)]


def test_latest_of_each_part_works_in_hours(spark):
    """As the plain fold, and no window has all rows of a part together."""
    r, hour = random.Random(5), 3_600_000_000
    data = [(p, t, r.randrange(50)) for p in ("a", "b", None) for t in r.sample(range(0, 40 * hour, hour // 4), 30)]
    got = relations.latest_of_each(spark.createDataFrame(data, "p string, ts long, v long"), "p", ["v"])
    held, want = {}, {}
    for p, t, v in sorted(data, key=lambda x: x[1]):
        held[p] = v
        want[t] = (len(held), sum(held.values()))
    assert {x["ts"]: (x["parts"], x["v"]) for x in got.collect()} == want
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "windowspecdefinition(p#" in x]
    assert windows and all("_h#" in x for x in windows)


def test_asof_in_spans(spark):
    r = random.Random(6)
    left = [(i, r.choice([1, 2, None]), r.randrange(400)) for i in range(80)]
    right = [(k, t, t * 7) for k in (1, 2, None) for t in r.sample(range(400), 12)]
    for by in ([], ["k"]):
        rows = right if by else [x for x in right if x[0] == 1]
        got = counters.asof(spark.createDataFrame(left, "id long, k long, ts long"), spark.createDataFrame(rows, "k long, ts long, v long"), by, ["v"], width=25)
        want = {i: max(((u, v) for q, u, v in rows if u <= t and (not by or q == k)), default=(None, None)) for i, k, t in left}
        assert {x["id"]: (x["asof_ts"], x["v"]) for x in got.collect()} == want


def test_grouped_relations(spark):
    df = spark.createDataFrame([(1, 5, True), (1, 6, True), (2, None, True), (2, 1, False), (None, 1, True)], "g long, d long, has boolean")
    got = {x["g"]: (x["members"], x["d"], x["m"]) for x in relations.grouped(df.withColumn("m", F.col("d")), ["g"], ["d"], ["m"], has={"m": "has"}).collect()}
    assert got == {1: (2, 11, 6), 2: (2, None, None)}
    flags = spark.createDataFrame([(1, True, True), (1, False, None), (2, None, True)], "g long, v boolean, r boolean")
    got = {x["g"]: (x["severity"], x["v_count"], x["r_count"]) for x in relations.severities(flags, ["g"], "v", "r").collect()}
    assert got == {1: (2, 1, None), 2: (None, None, 1)}


def test_health(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (100, 10, 25, 0), (200, 10, 25, None), (300, 10, 25, 9), (400, 11, 25, 9), (500, 1, 26, 10)], "ts long, cpu long, memory long, io long").withColumn("h", F.lit(1))
    assert [r["os_health"] for r in series.os_health(df, ["h"]).orderBy("ts").collect()] == [None, 75, None, None, 99, None]
    pg = spark.createDataFrame([(8, 4.0), (9, 4.0), (16, 4.0), (3, 0.0)], "a long, c double").select(series.postgres_penalty(F.col("a"), F.col("c")).alias("p")).collect()
    assert [r["p"] for r in pg] == [0, 11, 50, None]
    over = spark.createDataFrame([(90, 20, True), (10, 50, True), (90, None, True), (90, None, False), (None, 0, True)], "o int, p int, e boolean").select(series.overall_health(F.col("o"), F.col("p"), F.col("e")).alias("x")).collect()
    assert [r["x"] for r in over] == [70, 0, None, 90, None]


def test_neighbours_cross_spans(spark):
    df = spark.createDataFrame([(1, 5), (9, 7), (11, 6), (35, 9)], "ts long, v long")
    got = [(r["ts"], r["prev_ts"], r["prev_v"]) for r in counters.neighbours(df, ["v"], "ts", 10).orderBy("ts").collect()]
    assert got == [(1, None, None), (9, 1, 5), (11, 9, 7), (35, 11, 6)]


def test_findings_are_capped_and_counted(spark):
    df = spark.createDataFrame([(1, 1, 9_000), (1, 2, 9_000), (2, 3, 1), (1, 4, 8_000)], "e long, ts long, max_duration_ms long")
    slow = detect.crossing(df, "slow_query", detect.THRESHOLDS["slow_query"], ["e"])
    got = detect.findings([slow, slow, detect.risen(df, "rise", "max_duration_ms", ["e"])], cap=2).collect()
    assert [(r["detector"], r["ts"], r["found"]) for r in got] == [("slow_query", 1, 3), ("slow_query", 2, 3)]


def test_event_groups(spark):
    m = events.MINUTE
    df = spark.createDataFrame([(1, "k", 5 * m, None, 3), (2, "k", 4 * m, 2, 9), (3, "k", 4 * m + 1, 2, 9), (4, "j", 70 * m, 1, 1)], "event_id long, key string, ts long, w long, ms long")
    got = {r["key"]: r for r in events.groups(df, ["key"], F.col("w"), 0).collect()}
    assert (got["k"]["n"], got["k"]["first_ts"], got["k"]["last_ts"], got["k"]["representative"], got["k"]["by_minute"]) == (5, 4 * m, 5 * m, 2, {4: 4, 5: 1})
    assert got["j"]["by_minute"] is None
    assert {r["key"]: r["representative"] for r in events.groups(df, ["key"], F.col("w"), 0, score=F.col("ms")).collect()}["k"] == 2
    order = spark.createDataFrame([("b", "notable", 2, 1), ("A", "notable", 2, 1), ("x", "critical", 1, 1), ("z", "routine", 9, 9)], "key string, tier string, n long, last long")
    assert [r["key"] for r in events.in_order(order, "tier", "n", "last", "key").collect()] == ["x", "A", "b", "z"]


def test_occurrences_and_locks(spark):
    df = spark.createDataFrame([(1, 5, "b"), (2, 5, "a"), (3, 6, "a"), (4, 7, "c")], "event_id long, ts long, source string")
    got = events.occurrences(df, 0, 100, ["a", "b"], 2).orderBy("ts", "source_rank").collect()
    assert [(r["event_id"], r["truncated"]) for r in got] == [(2, True), (1, True)]
    with pytest.raises(ValueError):
        events.occurrences(df, 0, events.MAX_WINDOW + 1, ["a"], 2)
    w = spark.createDataFrame([(1, 7, 10, "x"), (2, 7, 20, "y")], "event_id long, pid long, ts long, holders string")
    a = spark.createDataFrame([(5, 7, 5), (6, 7, 20), (7, 8, 30)], "event_id long, pid long, ts long")
    assert {r["event_id"]: r["holders"] for r in events.lock_matches(w, a, ["pid"], "holders").collect()} == {5: None, 6: "y", 7: None}


def test_sequences(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in ((0, 1), (10, 2), (40, 3), (50, 1), (60, 1))], "e string, ts long, v long")
    assert [r["episode"] for r in sequence.episodes(df, ["e"], 10, ["v"]).orderBy("ts").collect()] == [0, 0, 1, 2, 2]
    stats = sequence.statistics(spark.createDataFrame([("a", t, t) for t in (1, 2, 3, 4)], "e string, ts long, v long"), ["e"], "v").first()
    assert (stats["p50"], stats["p90"], stats["p99"], stats["latest"]) == (2, 4, 4, 4)
    assert [r["ts"] for r in sequence.changes(df, ["e"], "v").orderBy("ts").collect()] == [0, 10, 40, 50]
    walk = {r["node"]: (r["root"], r["level"]) for r in sequence.forest(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "p long, q long"), "p", "q").collect()}
    assert walk == {1: (1, 0), 2: (1, 1), 3: (1, 2)}


def test_forest_keeps_every_row(spark):
    """Process 1's parent 0 has no row, 9's is gone, 4 is its own; a chain of 200; a cycle 50-52-51 with a lower one below it, and a cycle of two."""
    rows = [(1, 0), (2, 1), (9, 77), (10, 9), (4, 4), (5, 4), (6, None), (50, 52), (52, 51), (51, 50), (3, 51), (60, 61), (61, 60), *((k, k - 1) for k in range(1_001, 1_200)), (1_000, 2)]
    walk = lambda c: {r["node"]: (r["root"], r["level"]) for r in sequence.forest(spark.createDataFrame(rows, "p int, q long"), "p", "q", cycles=c).collect()}
    want = {1: (1, 0), 2: (1, 1), 9: (9, 0), 10: (9, 1), 4: (4, 0), 5: (4, 1), 6: (6, 0), **{k: (1, k - 998) for k in range(1_000, 1_200)}}
    assert walk(False) == want
    assert walk(True) == want | {50: (50, 0), 51: (50, 1), 52: (50, 2), 3: (50, 2), 60: (60, 0), 61: (60, 1)}


def test_surface_summary_admits_pairs_together(spark):
    rows = [(0, 1, 0, 0), (0, 2, 0, 0), (2_000_000, 1, 4, 10), (2_000_000, 2, 6, None), (4_000_000, 1, 2, 20)]
    df = spark.createDataFrame(rows, "ts long, e long, x long, y long")
    got = {r["ts"]: r for r in series.surface_summary(df, ["e"], ["x", "y"], {"q": ("x", "y")}).collect()}
    assert (got[0]["entities"], got[0]["x_per_s"], got[0]["q"]) == (2, None, None)
    assert (got[2_000_000]["x_per_s"], got[2_000_000]["y_per_s"], got[2_000_000]["q"]) == (5.0, 5.0, 0.4)
    assert (got[4_000_000]["x_per_s"], got[4_000_000]["y_per_s"], got[4_000_000]["q"]) == (None, 5.0, None)
