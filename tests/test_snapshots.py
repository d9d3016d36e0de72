"""Pages behind a cursor, details of one row, scans that filter by the moment, event groups."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import ratios
from gaugeloom.operators import events, series, snapshot


@pytest.mark.parametrize("descending", [True, False])
def test_pages_behind_a_cursor_make_up_the_whole(spark, descending):
    rows = [(i, i % 3, None if i % 4 == 0 else i % 5) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, grp long, v long")
    got, cursor = [], None
    for _ in range(9):
        left = df if cursor is None else df.where(snapshot.after("v", ["grp", "id"], cursor, descending))
        part = snapshot.page(left, "v", ["grp", "id"], 4, descending, eligible=False).collect()
        got += part
        if not part:
            break
        cursor = snapshot.cursor_of(part[-1], "v", ["grp", "id"])
    assert [x["id"] for x in got] == [x[0] for x in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0) if descending else r[2] or 0, r[1], r[0]))]


def test_page_facts(spark):
    df = spark.createDataFrame([(t,) for t in (5, 7, 9)], "ts long")
    assert tuple(snapshot.page_facts(df, 2).first()) == (3, 2, True, 5, 9)
    assert tuple(snapshot.page_facts(df.limit(0), 2).first()) == (0, 0, False, None, None)


def test_detail_of_one_row(spark):
    rows = [(0, 1, None, 10), (1_000_000, 1, None, 30), (500_000, 2, None, 7), (2_000_000, 1, "x", 99)]
    df = spark.createDataFrame(rows, "ts long, pid long, db string, n long")
    got = snapshot.detail_of_one(df, ["pid", "db"], ["n"], F.col("n") == 30).first()
    assert (got["previous_ts"], got["n_rate"]) == (0, 20.0)
    assert snapshot.detail_of_one(df, ["pid", "db"], ["n"], F.col("n") == 99).first()["previous_ts"] is None
    for where in ("n > 1000", "pid = 1"):
        with pytest.raises(ValueError):
            snapshot.detail_of_one(df, ["pid", "db"], ["n"], F.expr(where))


def test_moments_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(t, p, t * p) for t in range(10) for p in range(3)], "ts long, pid long, n long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ts,6)" in plan(snapshot.at_moment(df, 6)).replace(" ", "")
    both = plan(snapshot.with_rates(df, 6, ["pid"], ["n"])).replace(" ", "")
    assert "EqualTo(ts,6)" in both and "EqualTo(ts,5)" in both
    assert "GreaterThanOrEqual(ts,5)" in plan(snapshot.partitioned(df, 6, "pid", [], ["n"])).replace(" ", "")
    assert "EqualTo(pid,2)" in plan(snapshot.detail_of_one(df, ["pid"], ["n"], (F.col("pid") == 2) & (F.col("ts") == 4))).replace(" ", "")


def test_look_back_hides_old_moments(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 9)], "ts long, pid long, n long")
    assert snapshot.with_rates(df, 10, ["pid"], ["n"], look_back=5).count() == 0
    assert snapshot.with_rates(df, 10, ["pid"], ["n"], look_back=8).first()["n"] == 4_000_000.0


def test_process_summary_needs_the_moment_right_before(spark):
    rows = [(0, 1, 10, 5), (0, 2, 10, 5), (1_000_000, 2, 10, 9), (2_000_000, 1, 10, 50), (2_000_000, 2, 11, 10), (3_000_000, 1, 10, 53)]
    df = spark.createDataFrame(rows, "ts long, pid long, starttime long, utime long")
    got = {r["ts"]: r for r in series.process_summary(df, ["pid", "starttime"], ["utime"], [], {"many": F.col("utime") > 9}).collect()}
    assert [(got[t]["entities"], got[t]["utime_usable"], got[t]["utime_change"], got[t]["many"]) for t in sorted(got)] == [(2, 0, None, 0), (1, 1, 4, 0), (2, 0, None, 2), (1, 1, 3, 1)]
    assert got[3_000_000]["utime_per_s"] == 3.0


def test_neutral_operands(spark):
    one = spark.createDataFrame([(1, None), (None, None), (3, 1)], "d_seq_scan long, d_idx_scan long")
    assert [r[0] for r in one.select(ratios.TABLE["sequential_share_pct"](lambda c: F.col("d_" + c), None)).collect()] == [100.0, None, 75.0]


def test_event_groups_of_nothing_are_empty(spark):
    df = spark.createDataFrame([], "event_id long, ts long, phase long, target string, holders string, name string, value long, unit string")
    assert events.checkpoint_warnings(df, "phase", "value").count() == events.unmatched(df, "target").count() == events.pooler_groups(df, "phase", "name", ["unit"]).count() == 0
    assert events.slow_threshold(df, "name", "value", "unit").first()[0] is None
