"""References, shortened text, heatmap fields and late observations."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import refs
from gaugeloom.functions.timeutil import TimeRange
from gaugeloom.operators import heatmap
from gaugeloom.sources.layouts import SECTIONS


def test_references_round_trip(spark):
    df = spark.createDataFrame([(5, 7, 2, 0, 9, "a/é"), (5, 8, 2, 1, None, "b")], "segment long, ts long, tid int, ord long, k long, name string")
    texts = [r["r"] for r in df.select(refs.reference("statements", *[F.col(c) for c in ("segment", "ts", "tid", "ord")], [F.col("k"), F.col("name")]).alias("r")).collect()]
    assert refs.parse(texts[0]) == {"section": "statements", "segment": 5, "ts": 7, "type_id": 2, "ordinal": 0, "identity": ["9", "a/é"]}
    assert refs.parse(texts[1])["identity"] == ["", "b"]
    for bad in (texts[0][:-2] + "AA", texts[0] + "=", "%%%", "x" * 9_000):
        with pytest.raises(ValueError):
            refs.parse(bad)


def test_locators_name_one_row(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "c")], "type_id int, row_ordinal int, name string")
    assert refs.locate(df, 1, 0)["name"] == "a"
    for type_id, ordinal in ((1, 1), (2, 0)):
        with pytest.raises(LookupError):
            refs.locate(df, type_id, ordinal)


def test_shortened_text(spark):
    rows = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string").select(refs.shortened(F.col("t"), 4).alias("s")).collect()
    assert [r["s"] for r in rows] == ["abc…", "abc", None]


def test_fields_of_one_class_and_unit():
    processes, statements = SECTIONS.by_id[1], SECTIONS.by_id[3]
    assert heatmap.check_fields(processes, ["utime", "stime"], ["comm"]) == "counter" and heatmap.check_fields(processes, ["rss"]) == "gauge"
    for layout, fields, groups in ((processes, ["utime", "rss"], []), (statements, ["calls", "wal_bytes"], []), (processes, ["pid"], []), (processes, ["rss"], ["utime"]), (processes, [], [])):
        with pytest.raises(ValueError):
            heatmap.check_fields(layout, fields, groups)


def test_late_observations(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 1, 55), ("a", 2, 20), ("a", 3, 52), ("b", 4, 1)], "e string, ord long, ts long")
    assert {r["e"]: r["late"] for r in heatmap.out_of_order(df, "e", TimeRange(0, 100), 10, "ord").collect()} == {"a": 1, "b": 0}


def test_others_of_rankings(spark):
    rows = [(e, t, v) for e, vs in {"a": (1, 9), "b": (1, 5), "c": (1, 3), "d": (4, 2)}.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "e string, ts long, v long")
    got = lambda kind, top: heatmap.ranking(df, "e", "v", kind, TimeRange(0, 9), top).orderBy("rank").first()
    assert (got("counter", 2)["totals_total"], got("counter", 2)["others_total"]) == (14, 2) and got("counter", 3)["others_total"] is None
    assert (got("gauge", 2)["totals_total"], got("gauge", 2)["others_total"]) == (9, 4) and got("gauge", 4)["others_total"] is None
