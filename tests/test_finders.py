"""Finders: look-back, rates, searches and pages."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import search
from gaugeloom.operators import finders

S = 1_000_000
P = "ts long, pid long, starttime long, comm string, utime long, stime long"


def processes(spark):
    return spark.createDataFrame([(10 * S, 1, 0, "postgres", 0, 0), (10 * S, 2, 0, "bash", 0, 0), (15 * S, 1, 0, "postgres", 50, 5), (15 * S, 2, 9, "bash", 100, 0), (15 * S, 3, 0, "Postmaster", 10, 0)], P)


def test_processes_are_found_by_name_and_rate(spark):
    found = finders.find(processes(spark), finders.SURFACES["processes"], 16 * S, member=search.glob(F.col("comm"), "post*"), order="utime")
    assert [(r["pid"], r["utime"], r["eligible"], r["truncated"]) for r in found.collect()] == [(1, 10.0, 2, False), (3, None, 2, False)]
    fast = finders.find(processes(spark), finders.SURFACES["processes"], 16 * S, result=F.col("utime") > 5)
    assert [r["pid"] for r in fast.collect()] == [1]
    assert [r["pid"] for r in finders.find(processes(spark), finders.SURFACES["processes"], 16 * S, limit=2).collect()] == [1, 2]


def test_old_rows_are_not_shown(spark):
    assert finders.find(processes(spark), finders.SURFACES["processes"], 36 * S).count() == 0
    assert finders.find(processes(spark), finders.SURFACES["processes"], 34 * S).count() == 3
    with pytest.raises(ValueError):
        finders.find(processes(spark), finders.SURFACES["processes"], 34 * S, limit=5_001)


def test_relations_have_moments_of_their_own(spark):
    df = spark.createDataFrame([(0, 1, 7, 5), (300 * S, 1, 7, 305), (100 * S, 2, 7, 1), (400 * S, 2, 7, 31), (350 * S, 3, 1, 9)], "ts long, datid long, relid long, seq_scan long")
    found = {r["datid"]: r["seq_scan"] for r in finders.find(df, finders.SURFACES["tables"], 420 * S).collect()}
    assert found == {1: 1.0, 2: 0.1, 3: None}


def test_the_recorded_interval(spark):
    df = spark.createDataFrame([(1, 10), (5, 60), (7, 0), (9, 90)], "ts long, interval_seconds long")
    assert [finders.recorded_interval(df, at) for at in (0, 6, 8, 9)] == [30.0, 60.0, 60.0, 90.0]
