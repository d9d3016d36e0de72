"""Conditions, log records, series blocks, groups, devices, batched grids and loads on small frames."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import conditions
from gaugeloom.functions.timeutil import TimeRange
from gaugeloom.operators import assembly, finders, heatmap, processes, snapshot, topology
from gaugeloom.sources.index import Index, Series

HEAD = "2024-01-01 00:00:00.000 UTC [7] "


def test_quantities_carry_the_unit_of_their_field():
    tables, procs, statements = (conditions.of(s) for s in ("tables", "processes", "statements"))
    for f, text, want in (
        (tables["size"], "100.000MB", 100_000_000), (tables["size"], "0.5KiB", 512), (tables["autovacuum_mean"], "250000us", 250), (tables["buffer_hit"], "99.95%", 99.95), (procs["run_delay"], "250us/s", 0.25),
        (procs["disk_read_rate"], "1.5MiB/s", 1_572_864), (statements["exec_time_rate"], "0.5s/s", 500), (statements["rows_per_call"], "0.125", 0.125), (tables["seq_scan_rate"], "0.5/s", 0.5), (tables["xid_age"], 7, 7),
    ):
        assert float(conditions.threshold(f, text)) == want, text
    for f, text in (
        (procs["cpu_cores"], "1core"), (procs["rss"], "2MiB/s"), (procs["disk_read_rate"], "1MiB"), (statements["exec_time_rate"], "1ms"), (tables["size"], "100"), (tables["size"], "100mb"), (tables["size"], "0.1B"), (tables["buffer_hit"], "100.1%"),
        (tables["table_count"], "1.5"), (tables["size"], "-1MB"), (tables["size"], "1e3MB"), (tables["size"], "100 MB"), (tables["size"], "9" * 300 + "B"), (tables["schema"], "1"), (tables["xid_age"], -1),
    ):
        with pytest.raises(ValueError):
            conditions.threshold(f, text)


def test_conditions_have_bounds_and_phases():
    f = conditions.of("tables")
    one, big = f["schema"].matches("public"), f["size"].above("1MB")
    assert (one & big).phase() == "both" and (one | f["table"].equals("t")).phase() == "member" and big.phase() == "result"
    for mixed in (one | big, (one & big) | f["schema"].equals("audit")):
        with pytest.raises(ValueError, match="mixes"):
            mixed.phase()
    nine = one
    for _ in range(7):
        nine = nine & one
    with pytest.raises(ValueError, match="predicates"):
        nine & one
    deep = one
    for k in range(5):
        deep = (deep & one) if k % 2 else (deep | one)
    with pytest.raises(ValueError, match="deep"):
        deep & one
    for bad in (lambda: f["nothing"], lambda: f["schema"].matches("x" * 257), lambda: f["schema"].any_of([]), lambda: f["schema"].any_of(map(str, range(9))), lambda: conditions.of("locks")["pid"].equals("-1"), lambda: conditions.of("locks")["pid"].equals("07"), lambda: conditions.of("x")):
        with pytest.raises(ValueError):
            bad()
    assert conditions.of("statements")["query_id"].equals(-5).predicate.value == "-5"
    for bad in ([{"field": "schema", "op": "gt", "value": "1"}], [{"field": "size", "op": "eq", "value": 3}], [{"field": "schema", "op": "eq", "value": 3}], [{"field": "schema", "op": "in", "value": "x"}], [{"field": "schema", "op": "eq", "value": True}], []):
        with pytest.raises(ValueError):
            conditions.filters("tables", bad)
    assert len(conditions.filters("tables", [{"field": "schema", "op": "eq", "value": "a"}] * 3 + [{"field": "size", "op": "lt", "value": "1kB"}]).predicates()) == 2


def test_conditions_select_rows(spark):
    rows = [(1, "Public", 5, None, None), (2, "audit*", None, 3, 10), (3, None, 2_000, 100, 900), (4, "publicity", 10, 99, 1)]
    df = spark.createDataFrame(rows, "id int, schemaname string, main_fork_bytes long, toast_bytes long, xid_age long").withColumn("relname", F.lit("t"))
    f = conditions.of("tables")
    found = lambda c: {r["id"] for r in df.where(c.column()).collect()}
    assert found(f["schema"].matches("PUBLIC")) == {1, 4} and found(f["schema"].equals("public")) == {1} and found(f["schema"].contains("t*")) == {2} and found(f["schema"].any_of(["AUDIT*", "public"])) == {1, 2}
    assert found(f["size"].above("109B")) == {3} and found(f["size"].below("6B")) == {1, 2} and found(f["xid_age"].above("9")) == {2, 3} and found(f["xid_age"].below("10")) == {4}
    assert found(f["schema"].matches("p?b") & f["size"].above("100B") | f["xid_age"].above("100")) == {3, 4}


def test_finders_prove_identities_and_hide_own_rows(spark):
    rows = [(10, 1, 1, 1, 5, 0), (10, 2, 1, 1, 6, 0), (10, 3, 1, 1, 7, 0), (10, 3, 1, 1, 8, 0)]
    df = spark.createDataFrame(rows, "ts long, queryid long, userid long, dbid long, calls long, rows long")
    surface = finders.SURFACES["statements"]
    with pytest.raises(Exception, match="several rows of one identity"):
        finders.find(df, surface, 10, limit=4).collect()
    assert [(r["queryid"], r["eligible"], r["excluded"]) for r in finders.find(df, surface, 10, limit=2).collect()] == [(1, 4, 0), (2, 4, 0)]
    assert [(r["queryid"], r["eligible"], r["excluded"]) for r in finders.find(df, surface, 10, limit=1, own=F.col("queryid") == 1).collect()] == [(2, 3, 1)]
    with pytest.raises(Exception, match="several rows of one identity"):
        finders.find(df, surface, 10, limit=2, own=F.col("queryid") == 1).collect()


def test_newest_layout_of_each_partition(spark):
    rows = [(1, 5, 1, 0, 10), (1, 5, 2, 0, 20), (2, 5, 1, 9, 40), (2, 5, 2, 9, 80), (1, 6, 1, 0, 1), (2, 6, 1, 9, 2)]
    df = spark.createDataFrame([(t * 1_000_000, p, lay, i, c) for t, p, lay, i, c in rows], "ts long, p long, type_id int, id long, c long")
    got = {(r["p"], r["type_id"]): r["c"] for r in snapshot.partitioned(df, 2_000_000, "p", ["p"], ["c"], layout="type_id").collect()}
    assert got == {(5, 2): 60.0, (6, 1): 1.0}


def test_stderr_records_span_files(spark):
    lines = ["lost", HEAD + "ERROR:  42P01: no table", "\tat all", HEAD + "DETAIL:  one", "\ttwo", HEAD + "STATEMENT:  SELECT 1", HEAD + "LOG:  says DETAIL:  x", HEAD + "HINT:  h", "noise", None, HEAD + "FATAL:  end"]
    df = spark.createDataFrame([("s", k // 3, k, x) for k, x in enumerate(lines)] + [("other", 0, 0, HEAD + "LOG:  alone")], "source string, file int, place int, line string")
    got = assembly.stderr(df, ["source"], "file", "place", prefix="%m [%p] ").orderBy("source", "first_place").collect()
    assert [(r["first_place"], r["severity"], r["sqlstate"], r["message"], r["detail"], r["hint"], r["statement"], r["pid"]) for r in got] == [
        (0, "LOG", None, "alone", None, None, None, "7"), (1, "ERROR", "42P01", "no table\nat all", "one\ntwo", None, "SELECT 1", "7"), (6, "LOG", None, "says DETAIL:  x", None, "h", None, "7"), (10, "FATAL", None, "end", None, None, None, "7"),
    ]
    assert assembly.prefix_pattern("%m [%p] %q%u@%d ")[1] == ["logged_at", "pid", "user", "database"]
    with pytest.raises(ValueError):
        assembly.prefix_pattern("%Z")


def test_csv_and_json_records(spark):
    text = 'a,"u","d",1,,s,1,"SELECT",t,v,0,ERROR,42P01,"first ""x"",\n\nlast",,,,,,\nb,u,d,2,,s,1,x,t,v,0,LOG,00000,plain,"more\n1",,,,,'
    df = spark.createDataFrame([("s", k // 2, k, x) for k, x in enumerate(text.split("\n"))], "source string, file int, place int, line string")
    got = assembly.csv(df, ["source"], "file", "place").orderBy("first_place").collect()
    assert [(r["first_place"], r["process_id"], r["error_severity"], r["message"], r["detail"], r["hint"], r["query_id"]) for r in got] == [(0, "1", "ERROR", 'first "x",\n\nlast', None, None, None), (3, "2", "LOG", "plain", "more\n1", None, None)]
    js = spark.createDataFrame([('{"timestamp":"t","pid":5,"error_severity":"ERROR","state_code":"1","message":"a\\nb","statement":"S"}',), ("no json",), (None,)], "line string")
    assert [(r["process_id"], r["message"], r["query"], r["sql_state_code"]) for r in assembly.json(js).collect()] == [(5, "a\nb", "S", "1")]


def test_index_grows_as_if_built_at_once(spark, tmp_path):
    rows = spark.createDataFrame([(t // 3, t, e, t * e + (5 if t == 4 else 0), t % 4 if e != 2 else None) for t in range(12) for e in (1, 2, 3) if (t, e) != (5, 3)], "segment_id long, ts long, e long, c long, g long")
    series = [Series("rate", "c", "rate"), Series("most", "g", "max"), Series("sum", "g", "sum")]
    once, grown = (Index(spark, f"{tmp_path}/{n}", ["e"], series) for n in ("once", "grown"))
    assert once.refresh(rows) == 4
    assert [grown.refresh(rows.where(F.col("segment_id").isin(s))) for s in ([0], [0, 1], [2, 3], [3])] == [1, 1, 2, 0]
    assert sorted(map(tuple, once.load().collect())) == sorted(map(tuple, grown.load().collect()))
    assert {(r["ts"], r["value"]) for r in grown.load("most", 4, 7).collect()} == {(4, 0.0), (5, 1.0), (6, 2.0)}
    rate = {r["ts"]: r["value"] for r in grown.load("rate").collect()}
    assert 0 not in rate and rate[3] == pytest.approx(6e6) and rate[5] == pytest.approx(0) if 5 in rate else True
    bad = spark.read.parquet(f"{tmp_path}/grown/blocks").withColumn("checksum", F.lit(1).cast("long"))
    bad.write.partitionBy("segment_id").parquet(f"{tmp_path}/bad/blocks")
    spark.read.parquet(f"{tmp_path}/grown/segments").write.parquet(f"{tmp_path}/bad/segments")
    with pytest.raises(Exception, match="checksum"):
        Index(spark, f"{tmp_path}/bad", ["e"], series).load().collect()


def test_batch_scans_once_and_matches_single_items(spark, tmp_path):
    rows = [(e, t * 60_000_000, (e * t) % 11 if t % 5 else None, e * t * 3) for e in range(1, 9) for t in range(40)]
    spark.createDataFrame(rows, "e long, ts long, g long, c long").write.parquet(f"{tmp_path}/rows")
    df, span = spark.read.parquet(f"{tmp_path}/rows"), TimeRange(300_000_000, 2_000_000_000)
    items = {"g": ("g", "gauge"), "c": ("c", "counter"), "again": ("c", "gauge")}
    plan = heatmap.observed(df, "e", items, span, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    grids, sums = heatmap.batch(df, "e", items, span, 6, 3)
    for name, (value, kind) in items.items():
        want = {(r["rank"], r["e"], r["col"]): float(r["cell"]) for r in heatmap.grid(df, "e", value, kind, span, 6, 3).collect()}
        assert {(r["rank"], r["e"], r["col"]): r["cell"] for r in grids.where(F.col("item") == name).collect()} == want
        bands = {r["col"]: (float(r["totals"]), r["contributors"]) for r in heatmap.bands(df, "e", value, kind, span, 6, 3).where("totals IS NOT NULL").collect()}
        assert {r["col"]: (pytest.approx(r["totals"]), r["contributors"]) for r in sums.where(F.col("item") == name).collect()} == bands


def test_groups_and_devices(spark):
    groups = [(1, "/", 100), (1, "/a", 60), (1, "/b/", 50), (1, "/a/x", 10), (1, "/a/y", None), (1, "/q/z", 3), (2, "/", None)]
    got = {(r["m"], r["path"]): (r["children"], r["mem_own"]) for r in topology.residuals(spark.createDataFrame(groups, "m int, path string, mem long"), ["m"], ["mem"]).collect()}
    assert got == {(1, "/"): (2, 0), (1, "/a"): (2, None), (1, "/b"): (0, 50), (1, "/a/x"): (0, 10), (1, "/a/y"): (0, None), (1, "/q/z"): (0, 3), (2, "/"): (0, None)}
    edges = spark.createDataFrame([("dm-1", "sda2"), ("dm-1", "sdb"), ("sda2", "sda"), ("dm-2", "dm-1"), ("loop1", "loop2"), ("loop2", "loop1"), ("x", None)], "child string, parent string")
    assert {r["device"]: "".join(f"{c} " for c in r["chain"]).strip() for r in topology.layers(edges).collect()} == {
        "dm-2": "dm-2 dm-1 sda2 sda", "dm-1": "dm-1 sda2 sda", "sda2": "sda2 sda", "sda": "sda", "sdb": "sdb", "loop1": "loop1 loop2", "loop2": "loop2 loop1",
    }
    charged = spark.createDataFrame([("sda",), ("dm-2",), ("sdb",), ("loop1",), (None,)], "device string")
    assert {r["device"]: r["folded_into"] for r in topology.charged_layers(edges, charged).collect()} == {"sda": "dm-2", "dm-2": None, "sdb": "dm-2", "loop1": None}
    names = spark.createDataFrame([("8:0", "sda"), ("8:0", "sda"), ("8:1", "a"), ("8:1", "b"), (None, "c")], "device string, name string")
    assert {r["device"]: r["name"] for r in topology.device_names(names).collect()} == {"8:0": "sda", "8:1": None}


def test_load_of_episodes(spark):
    samples = spark.createDataFrame([(1, 0, 100, 10, 5), (1, 10_000_000, 400, 40, 3), (1, 30_000_000, 900, 90, 9), (2, 5, 1, 1, 1)], "pid long, ts long, utime long, stime long, read_bytes long")
    found = spark.createDataFrame([(1, 5_000_000, 20_000_000, 50), (1, 11_000_000, 12_000_000, 9), (2, 0, 9, 5), (1, 2_000_000, 40_000_000, 0)], "pid long, first_ts long, last_ts long, scanned long")
    got = {(r["pid"], r["first_ts"]): (r["load_seconds"], r["cpu_ticks"], r["read_bytes"], r["cpu_ms"], r["cpu_share"], r["read_share"]) for r in processes.vacuum_load(found, samples, ["pid"], 100, "scanned").collect()}
    assert got == {(1, 5_000_000): (10.0, 330, None, 3300.0, 33.0, None), (1, 11_000_000): (None,) * 6, (2, 0): (None,) * 6, (1, 2_000_000): (30.0, 880, 4, 8800.0, pytest.approx(29.3333333), None)}
