"""Line dedup, Jaccard groups and top-k against brute force, with the awkward cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeloom.llm import components, jaccard, lines, topk, words

DOCS = "doc_id long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def test_lines_keep_first_documents(spark):
    rows = [
        (3, "shared line one\nown line here\n  SHARED line one \t"), (1, "x\nshared line one\nshared line one"), (2, "short\nshort"), (4, None), (5, ""), (6, "É long enough line"), (7, "é long enough line"),
        (8, "twice in one doc\ntwice in one doc"), (9, "\n".join(f"line number {i % 70}" for i in range(200))), (10, "\n".join(f"line number {i}" for i in range(150))),
    ]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", kept string, key int")).collect()}
    first = {}
    for i, t in sorted(rows):
        for line in (t or "").split("\n"):
            k = line.strip(lines.BLANKS).translate(LOWER)
            if len(k) >= 10:
                first.setdefault(k, i)
    for i, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if first.get(x.strip(lines.BLANKS).translate(LOWER), i) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) == (len(all_lines), len(all_lines) - len(stay), "\n".join(stay)), i


def test_lines_with_hot_keys_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_ROWS", 3)
    rows = [(i, f"a very common line\nline of {i // 2} and more") for i in range(20)] + [(None, "a very common line"), (4, "another text of four")]
    got = lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["kept"])
    assert by[0] == ["a very common line\nline of 0 and more"]
    assert by[None] == ["a very common line"]
    assert sorted(by[4]) == ["another text of four", "line of 2 and more"]
    assert by[5] == [""]
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def brute_groups(rows, num=75, den=100):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and den * len(a & b) >= num * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted((-1 if i is None else i, len(s), (i if not s else least.get(find(x))) or 0) for x, (i, s) in enumerate(sets))


def near_copies(seed, n):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(3, 60))] for _ in range(max(1, n // 12))]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            t[r.randrange(len(t))] = r.choice(vocab)
        if r.random() < 0.2:
            t += base[0][:20]
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = near_copies(seed, 150) + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "one two three"), (906, "long " * 3000), (907, "long " * 2000), (None, rows_text := "a b c d e f"), (908, rows_text), (908, rows_text)]
    got = jaccard.similar_groups(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", key int").repartition(5)).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2] or 0) for r in got) == brute_groups(rows)


def test_groups_with_hot_n_grams(spark, monkeypatch):
    rows = near_copies(7, 120)
    tail = " ".join(f"p{k}" for k in range(30))
    rows += [(1000 + i, f"{tail} u{i} v{i} x{i}") for i in range(40)] + [(2000 + i, f"{tail} " + " ".join(f"z{i}_{k}" for k in range(12))) for i in range(20)]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == brute_groups(rows)
    assert jaccard.similar_groups(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("turns", [1, 8])
def test_groups_that_leave_the_loop_early_meet_in_cells(spark, monkeypatch, turns):
    for name, value in {"FEW_MEETINGS": -1, "MEETINGS": -1, "TURNS": turns, "CELL_TEXTS": 7, "HOT_ROWS": 3, "LEADERS": 1}.items():
        monkeypatch.setattr(jaccard, name, value)
    tail = " ".join(f"p{k}" for k in range(30))
    rows = near_copies(3, 60) + [(1000 + i, f"{tail} " + " ".join(f"z{i % 17}_{k}" for k in range(i % 13))) for i in range(60)]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == brute_groups(rows)


def test_overlaps_are_counted_by_fragments_of_the_order(spark):
    r = random.Random(5)
    texts = {k: sorted(r.sample(range(400), r.randint(1, 60))) for k in range(40)}
    held = {g: sum(g in t for t in texts.values()) for g in range(400)}
    rank = lambda g: 64 + g if g < 5 else (held[g] - 1).bit_length()
    whole = spark.createDataFrame([(k, len(t), [-1 - g if g < 5 else g for g in t], [rank(g) for g in t]) for k, t in texts.items()], "key long, n long, grams array<long>, ranks array<int>")
    segments = jaccard._segments(whole, 5)
    place = lambda g: (rank(g), g)
    seen = {}
    for x in segments.collect():
        seen[x["key"], x["fragment"]] = [-1 - g if g < 0 else g for g in x["grams"]]
        assert x["behind"] == len(texts[x["key"]]) - sum(len(seen.get((x["key"], f), ())) for f in range(x["fragment"] + 1))
    by_fragment = [[place(g) for k in texts for g in seen[k, f]] for f in range(jaccard.FRAGMENTS)]
    assert all(max(a) < min(b) for a, b in zip(by_fragment, by_fragment[1:]) if a and b)  # contiguous
    assert len([x for x in by_fragment if x]) > 2
    pairs = [(a, b, len(texts[a]), len(texts[b])) for a in texts for b in range(a)]
    got = jaccard.linked(spark.createDataFrame(pairs, "a long, b long, na long, nb long"), segments, 10, 100).collect()
    want = {(a, b) for a, b, na, nb in pairs if 100 * len(set(texts[a]) & set(texts[b])) >= 10 * len(set(texts[a]) | set(texts[b]))}
    assert {(x[0], x[1]) for x in got} == want and 10 < len(want) < len(pairs)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500)]
    random.Random(3).shuffle(links)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[501] == 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\t\n\x0b,.漢", max_size=30)), max_size=8))
def test_word_hashes_tell_words_apart(texts):
    seen = {}
    for t, h in zip(texts, words.word_hashes(texts)):
        want = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        assert len(want) == len(h)
        for w, x in zip(want, h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_of_a_text_longer_than_a_block(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    whole = words.word_hashes([text])[0]
    monkeypatch.setattr(words, "BLOCK", 1000)
    assert (words.word_hashes([text])[0] == whole).all()


def brute_top(rows, k):
    q = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in q.items():
        if i % 20 == 0:
            s = sorted((-int(v @ w), j) for j, w in q.items() if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 20])
def test_top_k_matches_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "GROUP_ROWS", 64)
    monkeypatch.setattr(topk, "CHUNK_ROWS", 4)
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=8) + (i % 5)).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    rows += [(420, None), (440, []), (421, [float("nan")] * 8), (460, [None] + [1.0] * 7), (480, [1.0, 2.0]), (481, [2.0, 2.0]), (None, [1.0] * 8), (500, [1e12] * 8), (301, [1.0] * 8)]
    frame = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=k).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == brute_top(rows, k)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_groups_of_blocks_below_the_floor_are_not_shipped(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 16, "GROUP_ROWS": 64, "CHUNK_ROWS": 4, "PAGE_GROUPS": 2}.items():
        monkeypatch.setattr(topk, name, value)
    shipped, bounded = [], topk._bounded
    monkeypatch.setattr(topk, "_bounded", lambda *a: shipped.append(bounded(*a)) or shipped[-1])
    r = np.random.default_rng(6)
    rows = [(i, (5.0 * np.eye(8)[i % 8] + r.normal(size=8) / 9).tolist()) for i in range(640)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == brute_top(rows, 5)
    assert shipped[1].count() < 8 * 10 / 2  # of 8 chunks and 10 groups


def test_vectors_of_one_id_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [4.0, 1.0]), (3, [1.0, 5.0]), (3, [1.0, 5.0]), (4, [2.0**48, 0.0]), (5, [2.0**48, -(2.0**48)])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    s = 64 * 64
    assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"])] == [(4, s * 2**48), (5, s * 2**48), (3, 10 * s)]


def test_blocks_below_the_kth_score_are_not_scored():
    r = np.random.default_rng(1)
    near, far = r.integers(50, 60, (64, 4)), r.integers(-60, -50, (6400, 4))
    blocks = [(np.arange(a, a + 64), m, m.max(axis=0), m.min(axis=0)) for a, m in ((0, near), *((64 * (1 + i), far[64 * i : 64 * i + 64]) for i in range(100)))]
    q = np.array([[5, 5, 5, 5]])
    _, _, _, scored = topk.search_cell([(np.array([99_999]), q, np.array([topk.NONE]))], blocks, 20)
    assert scored == 1


def test_unlike_words_are_not_linked(spark):
    """Single words whose hashes agree in many leading bits, and many single words, none of which is like another."""
    rows = [(1, "word4820314"), (2, "word12825320"), (3, "word4820314"), (4, "word12825320")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2}
