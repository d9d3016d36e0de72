"""Exact top-k search by inner product, a block of documents at a time.

Documents are range-partitioned and cut into blocks. A block carries its
vectors (the forward index) and the maximum and minimum of every term. For a
query, the sum over terms of its weight times the maximum (the minimum, for a
negative weight) bounds every score in the block. Blocks are scored in order of
their bounds until the bound falls below the k-th best score so far.

Queries come in chunks and documents in groups, both of bounded size; a cell
of one chunk and one group is the unit of work. A small
table of the groups' own maxima and minima, in pages, tells which group bounds
a chunk highest; a first pass over that one gives each query a k-th score, its
floor. The second pass ships a chunk and a group only where a bound reaches a floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.llm import store

BLOCK_ROWS, GROUP_ROWS, CHUNK_ROWS, PAGE_GROUPS = 256, 16_384, 1_024, 4_096
NONE = np.iinfo(np.int64).min


def quantized(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double; null for vectors that are null, empty, or hold null or non-finite components."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & (F.size(x) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most so many consecutive rows of one dimension."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, key in enumerate(batch.column(0).to_pylist()):
            v = flat[ends[i] : ends[i + 1]]
            if vectors and (len(ids) == rows or len(v) != len(vectors[0])):
                yield np.array(ids, np.int64), np.stack(vectors)
                ids, vectors = [], []
            ids.append(key)
            vectors.append(v)
    if ids:
        yield np.array(ids, np.int64), np.stack(vectors)


def _blocks(vectors: DataFrame, parts: int, rows: int) -> DataFrame:
    """(part, dim, ids, matrix, high, low): blocks of consecutive documents; a part is a range of documents.

    The range is by dimension, by the heaviest term, then by id, so that a block's maxima stay near its members.
    """
    heavy = F.array_position(F.transform("v", lambda x: F.abs(x)), F.array_max(F.transform("v", lambda x: F.abs(x))))
    keyed = vectors.withColumn("dim", F.size("v")).withColumn("term", heavy * F.when(F.get("v", heavy.cast("int") - 1) < 0, -1).otherwise(1))
    ordered = keyed.repartitionByRange(parts, "dim", "term", "vec_id").sortWithinPartitions("dim", "term", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for ids, m in _rows(batches, rows):
            data = [ids.tobytes(), m.tobytes(), m.max(axis=0).tobytes(), m.min(axis=0).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([m.shape[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["part", "dim", "ids", "matrix", "high", "low"])

    return ordered.select("vec_id", "v").mapInArrow(run, "part int, dim int, ids binary, matrix binary, high binary, low binary")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly: in doubles where no sum can reach 2 ** 53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): no vector between low and high scores more; the largest number there is where that could leave 64 bits."""
    if float(np.abs(q).max(initial=0)) * max(float(np.abs(high).max(initial=0)), float(np.abs(low).max(initial=0))) * q.shape[1] >= 2**62:
        return np.full((len(q), len(high)), np.iinfo(np.int64).max)
    return _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)


def _first(score: np.ndarray, rank: np.ndarray, k: int, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k largest scores with their ranks, smaller ranks first among equals."""
    none = score == NONE
    if np.abs(np.where(none, 0, score)).max(initial=0) < (1 << 62) // ranks:  # both in one number
        both = np.where(none, NONE, score * ranks - rank)
        top = -np.sort(-np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        value = -(-top // ranks)
        return np.where(top == NONE, NONE, value), np.where(top == NONE, 0, value * ranks - top)
    order = np.lexsort((rank, ~score), axis=1)[:, :k]  # ~x falls as x grows, without overflow
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(rank, order, axis=1)


def search_cell(queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, ids, scores, blocks scored) of the best k per query that reach its floor.

    queries: (ids, matrix, floors); blocks: (ids, matrix, high, low). Equal scores go to smaller ids.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scored = 0
    for q_ids, q, floor in queries:
        mine = [b for b in blocks if b[1].shape[1] == q.shape[1]]
        if not mine:
            continue
        every = np.sort(np.concatenate([b[0] for b in mine]))
        bound = _bounds(q, np.stack([b[2] for b in mine]), np.stack([b[3] for b in mine]))
        order = np.argsort(~bound, axis=1, kind="stable")
        best, rank = np.full((len(q), k), NONE), np.zeros((len(q), k), np.int64)
        for step in range(len(mine)):
            at = order[:, step]
            live = bound[np.arange(len(q)), at] >= np.maximum(floor, best[:, -1])
            if not live.any():
                break
            for b in np.unique(at[live]):
                rows = np.flatnonzero(live & (at == b))
                ids, m = mine[b][0], mine[b][1]
                scored += len(rows)
                score = _product(q[rows], m)
                score[q_ids[rows][:, None] == ids[None, :]] = NONE
                place = np.broadcast_to(np.searchsorted(every, ids), score.shape)
                best[rows], rank[rows] = _first(np.concatenate([best[rows], score], axis=1), np.concatenate([rank[rows], place], axis=1), k, len(every) + 1)
        keep = (best != NONE) & (best >= floor[:, None])
        out.append((np.repeat(q_ids, keep.sum(axis=1)), every[rank[keep]], best[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return *(np.concatenate(x) for x in zip(*out)), scored


def _tables(left: pa.Table, right: pa.Table) -> tuple[list, list]:
    read = lambda t, n: [np.frombuffer(x, np.int64) for x in t[n].to_pylist()]
    wide = lambda t: [m.reshape(-1, d) for m, d in zip(read(t, "matrix"), t["dim"].to_pylist())]
    queries = list(zip(read(left, "ids"), wide(left), read(left, "floors")))
    return queries, list(zip(read(right, "ids"), wide(right), read(right, "high"), read(right, "low")))


def _floors(chunks: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Chunks with each query's k-th best score in the group beside it, or NONE."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, held = _tables(left, right)
        out = []
        for ids, m, floors in queries:
            q, _, score, _ = search_cell([(ids, m, floors)], held, k)
            have: dict[int, list[int]] = {}
            for i, x in zip(q.tolist(), score.tolist()):
                have.setdefault(i, []).append(x)
            out.append(np.array([min(have[i]) if len(have.get(i, ())) == k else NONE for i in ids.tolist()], np.int64).tobytes())
        return pa.table([left["chunk"], left["dim"], left["ids"], left["matrix"], pa.array(out, pa.binary())], names=["chunk", "dim", "ids", "matrix", "floors"])

    return chunks.groupBy("chunk", "part").cogroup(blocks.groupBy("chunk", "part")).applyInArrow(run, "chunk int, dim int, ids binary, matrix binary, floors binary")


def _extremes(blocks: DataFrame) -> DataFrame:
    """(page, part, dim, high, low) of groups; PAGE_GROUPS groups make a page."""

    def run(table: pa.Table) -> pa.Table:
        high, low = (np.stack([np.frombuffer(x, np.int64) for x in table[n].to_pylist()]) for n in ("high", "low"))
        return pa.table([table["part"][:1], table["dim"][:1], pa.array([high.max(axis=0).tobytes()]), pa.array([low.min(axis=0).tobytes()])], names=["part", "dim", "high", "low"])

    found = blocks.select("part", "dim", "high", "low").groupBy("part", "dim").applyInArrow(run, "part int, dim int, high binary, low binary")
    return found.withColumn("page", F.expr(f"part div {PAGE_GROUPS}").cast("int"))


def _bounded(chunks: DataFrame, extremes: DataFrame, nearest: bool) -> DataFrame:
    """(chunk, part, most): the cells in which some query's bound reaches its floor, or, if `nearest`, of every page the group with the largest sum of bounds.

    chunks and extremes: by chunk and page.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda t, n, d: [np.frombuffer(x, np.int64).reshape(-1, d) for x, k in zip(t[n].to_pylist(), t["dim"].to_pylist()) if k == d]
        most: dict[int, float] = {}
        for dim in set(left["dim"].to_pylist()) & set(right["dim"].to_pylist()):
            q, high, low = np.concatenate(read(left, "matrix", dim)), np.concatenate(read(right, "high", dim)), np.concatenate(read(right, "low", dim))
            floor = np.concatenate([np.frombuffer(x, np.int64) for x, k in zip(left["floors"].to_pylist(), left["dim"].to_pylist()) if k == dim])
            parts = [p for p, k in zip(right["part"].to_pylist(), right["dim"].to_pylist()) if k == dim]
            bound = _bounds(q, high, low)
            for i in np.flatnonzero((bound >= floor[:, None]).any(axis=0)):
                most[parts[i]] = most.get(parts[i], 0.0) + float(bound[:, i].astype(float).sum())
        if nearest and most:
            best = max(most, key=lambda p: (most[p], -p))
            most = {best: most[best]}
        chunk = left["chunk"][0].as_py() if left.num_rows else None
        return pa.table([pa.array([chunk] * len(most), pa.int32()), pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.float64())], names=["chunk", "part", "most"])

    return chunks.groupBy("chunk", "page").cogroup(extremes.groupBy("chunk", "page")).applyInArrow(run, "chunk int, part int, most double")


def _cells(chunks: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of all cells of a chunk and a group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v, s, _ = search_cell(*_tables(left, right), k)
        return pa.table([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    return chunks.groupBy("chunk", "part").cogroup(blocks.groupBy("chunk", "part")).applyInArrow(run, "query_id long, vec_id long, score long")


def _numbered(blocks: DataFrame, wanted: int, name: str) -> DataFrame:
    """`blocks`, written, with parts from 0 to wanted - 1: neighbouring partitions make one part if there are more."""
    held = store.written(blocks, name)
    have = (held.agg(F.max("part")).first()[0] or 0) + 1
    return held.withColumn("part", F.expr(f"int(part * {min(wanted, have)} div {have})"))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for every row that `is_query` holds for.

    rows: vec_id, embedding. Vectors that are null or empty, or hold null or
    non-finite components, and rows of a null vec_id take no part; vectors of
    another length than the query's are no candidates. Repeated rows are one
    row; rows of one vec_id with different vectors are rows of their own, but no
    candidates for each other, and as queries share one answer. With fewer
    than k candidates all are returned; an empty table gives an empty result.
    Scores must fit 64 bits.
    """
    vectors = rows.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("v"), is_query.alias("asks")).where("v IS NOT NULL")
    vectors = store.written(vectors.groupBy("vec_id", "v").agg(F.bool_or("asks").alias("asks")), "top-vectors")
    n, asked = vectors.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    groups, sets = max(1, -(-n // GROUP_ROWS)), max(1, -(-asked // CHUNK_ROWS))
    blocks = _numbered(_blocks(vectors.select("vec_id", "v"), groups, BLOCK_ROWS), groups, "top-blocks")
    chunks = _numbered(_blocks(vectors.where("asks").select("vec_id", "v"), sets, CHUNK_ROWS), sets, "top-chunks")
    chunks = chunks.select(F.col("part").alias("chunk"), "dim", "ids", "matrix")

    none = F.expr(f"cast(unhex(repeat('{np.array([NONE], np.int64).tobytes().hex()}', int(octet_length(ids) div 8))) as binary)")
    extremes = _extremes(blocks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    in_pages = F.explode(F.sequence(F.lit(0), F.lit(-(-groups // PAGE_GROUPS) - 1)))
    home = _bounded(chunks.withColumn("floors", none).withColumn("page", in_pages), extremes, True).groupBy("chunk").agg(F.max_by("part", F.struct("most", -F.col("part"))).alias("part"))
    home = store.written(home, "top-homes")  # a row per chunk
    asking = store.written(_floors(chunks.withColumn("floors", none).join(home, "chunk"), blocks.join(home, "part"), k), "top-floors")
    live = store.written(_bounded(asking.withColumn("page", in_pages), extremes, False).select("chunk", "part"), "top-live")
    found = _cells(asking.join(live, "chunk"), blocks.join(live, "part"), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""
