"""Lock forests against a plain walk; merges with removal; exact comparisons; cursors among nulls; the shared folder."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import search
from gaugeloom.operators import links, processes, relations, snapshot


def walked(rows):
    """{moment: [(pid, component, depth, parent, extra blockers, prepared)]} in the order of a depth-first walk."""
    out = {}
    moments = defaultdict(dict)
    for m, pid, blocked in rows:
        moments[m][pid] = blocked
    for m, of in moments.items():
        up = {p: sorted({b for b in bs if b in of and b}) for p, bs in of.items()}
        down = defaultdict(list)
        for p, bs in up.items():
            for b in bs:
                down[b].append(p)
        comp = {}
        for p in sorted(of):
            todo = [p]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = p
                    todo += up[x] + down[x]
        seen, order = set(), []

        def walk(p, parent, depth):
            if p in seen:
                return
            seen.add(p)
            order.append((p, comp[p], depth, parent, [b for b in up[p] if b != parent], 0 in of[p]))
            for kid in sorted(down[p]):
                walk(kid, p, depth + 1)

        for c in sorted(set(comp.values())):
            members = sorted(p for p in of if comp[p] == c)
            for p in [p for p in members if not up[p]] or members[:1]:
                walk(p, None, 1)
            for p in members:
                walk(p, None, 1)
        out[m] = order
    return out


def forest(spark, rows):
    df = processes.lock_forest(spark.createDataFrame([(*r, "x") for r in rows], "moment int, pid int, blocked_by array<int>, component string"), ["moment"])
    out = defaultdict(list)
    for r in df.orderBy("moment", "component", "tree", "path").collect():
        out[r["moment"]].append((r["pid"], r["component"], r["depth"], r["parent"], list(r["extra_blockers"]), r["waits_on_prepared"]))
    return dict(out)


def test_lock_forest_follows_the_walk(spark):
    r = random.Random(2)
    rows = [(m, p, sorted({r.randrange(1, p) for _ in range(r.randrange(3))} if p > 1 else set()) + [0] * (p % 5 == 0) + [999] * (p % 4 == 0)) for m in range(6) for p in range(1, 25)]
    rows += [(7, 10, [1, 2]), (7, 1, []), (7, 2, []), (7, 30, None), (8, 5, [6]), (8, 6, [7]), (8, 7, [5]), (8, 3, [7]), (8, 20, [21]), (8, 21, [20]), (8, 22, []), (8, 23, [22, 21])]  # several blockers, cycles
    assert forest(spark, rows) == walked([(m, p, b or []) for m, p, b in rows])


def test_lock_forest_of_odd_rows(spark):
    got = forest(spark, [(1, None, [2]), (1, 4, [4]), (1, 9, [0]), (None, 3, [2]), (None, 2, []), (1, 9, [4])])
    assert got == {1: [(4, 4, 1, None, [4], False), (9, 4, 2, 4, [], True)], None: [(2, 2, 1, None, [], False), (3, 2, 2, 2, [], False)]}
    assert processes.lock_forest(spark.createDataFrame([], "moment int, pid int, blocked_by array<int>"), ["moment"]).count() == 0


def test_long_chain(spark):
    got = forest(spark, [(1, k, [k - 1]) for k in range(2, 40)] + [(1, 1, [])])
    assert [(p, d) for p, _, d, *_ in got[1]] == [(k, k) for k in range(1, 40)]


def test_a_part_without_rows_is_gone(spark):
    hour = 3_600_000_000
    rows = [("a", 0, 5), ("b", 1, 7), ("a", 2 * hour, 6), ("b", 5 * hour, None), ("b", 6 * hour, 3)]
    seen = [*((p, t) for p, t, _ in rows), ("a", hour), ("b", 2 * hour + 1), ("c", 4), ("a", 9 * hour), ("b", 9 * hour)]
    got = relations.latest_of_each(spark.createDataFrame(rows, "part string, ts long, v long"), "part", ["v"], moments=spark.createDataFrame(seen, "part string, ts long")).orderBy("ts").collect()
    assert [tuple(r) for r in got] == [(0, 1, 5), (1, 2, 12), (4, 2, 12), (hour, 1, 7), (2 * hour, 2, 13), (2 * hour + 1, 1, 6), (5 * hour, 2, None), (6 * hour, 2, 9)]


def test_rate_sums_do_not_depend_on_order(spark):
    r = random.Random(3)
    rows = [("g", r.randrange(1 << 62), r.randrange(1, 1 << 40)) for _ in range(200)] + [("g", None, 3), ("g", 5, 0), ("h", 1, 3_000_000)] * 2
    sums = {frozenset((x["k"], x["rate"]) for x in relations.rate_sums(spark.createDataFrame(r.sample(rows, len(rows)), "k string, d long, elapsed long").repartition(n), ["k"], "d").collect()) for n in (1, 3, 7)}
    assert len(sums) == 1
    got = dict(sums.pop())
    want = sum(Fraction(d * 1_000_000, e) for k, d, e in rows if k == "g" and d is not None and e)
    assert got["g"] == pytest.approx(float(want), rel=1e-15) and got["h"] == pytest.approx(2 / 3, rel=1e-15)


def test_ratios_compare_exactly(spark):
    r = random.Random(4)
    most = (1 << 63) - 1
    pairs = [(r.randrange(most), r.randrange(1, most)) for _ in range(40)] + [(most, 1), (most, most), (0, 5), (1, 3), (1, 0), (most - 1, most), (99_999_999_999, 1), (None, 2), (3, None)]
    df = spark.createDataFrame(pairs, "n long, d long")
    for text in ("9 EiB", "99999999999.123456789", "0.333333333", "1", "0", "99.95%", "18446744073709551615", "250.5 us", "0.000000001 ns", "1.000000001"):
        q = Fraction(search.quantity(text))
        got = df.select("n", "d", search.above(F.col("n"), text, F.col("d")).alias("a"), search.below(F.col("n"), text, F.col("d")).alias("b"), search.above(F.col("n"), text).alias("c"), search.below(F.col("n"), text).alias("e")).collect()
        for n, d, a, b, c, e in got:
            if n is None or d is None:
                assert a is None and b is None
            else:
                assert (a, b, c, e) == (n > q * d, n < q * d, n > q, n < q), (text, n, d)


def test_pages_lose_no_row_among_nulls(spark):
    rows = [(5, None), (5, None), (5, 1), (5, 2), (4, None), (None, 3), (None, None), (4, 9)]
    df = spark.createDataFrame([(v, t, i) for i, (v, t) in enumerate(rows)], "v int, t int, i int")
    for down in (True, False):
        got, page = [], df
        while len(found := snapshot.page(page, "v", ["t", "i"], 2, down, eligible=False).collect()):
            got += [r["i"] for r in found]
            page = df.where(snapshot.after("v", ["t", "i"], snapshot.cursor_of(found[-1], "v", ["t", "i"]), down))
        assert got == [r["i"] for r in snapshot.page(df, "v", ["t", "i"], 100, down, eligible=False).collect()] and len(got) == len(rows)


def test_links_want_a_shared_folder(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        links._shared(Cluster)
