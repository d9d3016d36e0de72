"""Centroid clustering by Exponion search, exact in integers.

Every vector keeps an upper bound of the distance to its centroid and a lower
bound of that to the second nearest. A round moves the bounds by how far the
centroids went; only where they can no longer tell the nearest centroid, the
vector looks at the centroids inside a ball around its own one, a prefix of a
list that is sorted by distance. The radius is twice the distance to its own
centroid plus that centroid's distance to the nearest other one: whatever is
nearest or second nearest lies inside, and centroids on the edge count.

Vectors and their bounds are rows of a few thousand vectors each, written once
a round; the table before is deleted. Only centroids, and their sums, are ever
on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm import store
from gaugeloom.llm.memory import small_batches, tidy

DIMS, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, "3"
MOST_CLUSTERS = 2_048  # distances between all pairs of them are broadcast: 32 MB
BLOCK = 4_096
LARGEST = 1 << 26  # of a component; 64 squared differences of twice that still fit into a long
SLACK = 1e-12  # bounds are doubles: upper ones are raised and lower ones lowered by that share
_BLOCKS = "ids array<{kind}>, vectors binary, wide boolean, own binary, upper binary, lower binary, sums binary, counts binary"


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


class Centroids:
    """Centroids of a round, with each one's others in order of distance, and how far they came since the round before."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        k = len(at)
        self.at = at
        far = np.array([_squares(at, c[None, :]) for c in at]) if k else np.zeros((0, 0), np.int64)
        self.order = np.argsort(far, axis=1, kind="stable")
        self.far = _down(np.take_along_axis(far, self.order, 1))  # so that no centroid inside a ball seems outside
        self.gap_up = _up(np.sort(far, axis=1)[:, 1]) if k > 1 else np.full(k, np.inf)
        self.half_gap = _down(np.sort(far, axis=1)[:, 1]) / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else _up(_squares(at, before))
        self.moved = moved
        most = np.sort(moved)[::-1]
        self.others_moved = np.where(moved == most[0], most[1], most[0]) if k > 1 else np.zeros(k)


def nearest(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> int:
    """Brings own, upper and lower up to date for the centroids; returns how many distances that took. Ties go to the smaller number."""
    seen = 0
    fresh = own < 0
    if fresh.any():  # no bounds yet: all centroids
        at = np.flatnonzero(fresh)
        own[at] = 0
        seen += _search(v, at, np.full(len(at), len(c.at)), own, upper, lower, c)
    at = np.flatnonzero(~fresh)
    upper[at] = (upper[at] + c.moved[own[at]]) * (1 + SLACK)
    lower[at] = (lower[at] - c.others_moved[own[at]]) * (1 - SLACK)
    doubt = lambda x: x[upper[x] >= np.maximum(lower[x], c.half_gap[own[x]])]
    at = doubt(at)
    if len(at):
        upper[at] = _up(_squares(v[at], c.at[own[at]]))
        seen += len(at)
        at = doubt(at)
    if len(at):
        radius = (2 * upper[at] + c.gap_up[own[at]]) * (1 + SLACK)
        inside = np.zeros(len(at), np.int64)
        for a in np.unique(own[at]):
            mine = own[at] == a
            inside[mine] = np.searchsorted(c.far[a], radius[mine], side="right")
        seen += _search(v, at, inside, own, upper, lower, c)
    return seen


def _search(v: np.ndarray, at: np.ndarray, inside: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> int:
    """Looks at the first `inside` centroids of each vector's list, from the nearest to its own one on."""
    none = np.iinfo(np.int64).max
    best, second, who = np.full(len(at), none), np.full(len(at), none), np.full(len(at), len(c.at))
    for step in range(int(inside.max(initial=0))):
        use = np.flatnonzero(inside > step)
        j = c.order[own[at[use]], step]
        d = _squares(v[at[use]], c.at[j])
        closer = (d < best[use]) | ((d == best[use]) & (j < who[use]))
        second[use] = np.where(closer, best[use], np.minimum(second[use], d))
        best[use], who[use] = np.where(closer, d, best[use]), np.where(closer, j, who[use])
    own[at], upper[at] = who, _up(best)
    lower[at] = np.where(second == none, np.inf, _down(second))
    return int(inside.sum())


def _blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Rows of up to BLOCK vectors, as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            v = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * scale)
            if len(v) and np.abs(v).max() > LARGEST:
                raise ValueError(f"components over {LARGEST / scale} have no exact squared distance in a long")
            n, wide = len(v), bool(len(v) and np.abs(v).max() > 32_000)
            data = [v.astype("<i4" if wide else "<i2"), np.full(n, -1, "<i4"), np.full(n, np.inf, "<f8"), np.zeros(n, "<f8")]
            own = [pa.array([x.tobytes()], pa.binary()) for x in data]
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, own[0], pa.array([wide]), *own[1:], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=["ids", "vectors", "wide", "own", "upper", "lower", "sums", "counts"])

    return vectors.mapInArrow(tidy(run), _BLOCKS.format(kind=vectors.schema["id"].dataType.simpleString()))


def _decoded(batch: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, ...]:
    raw = lambda name, t: np.frombuffer(batch.column(name)[i].as_py(), t)
    v = raw("vectors", "<i4" if batch.column("wide")[i].as_py() else "<i2").reshape(-1, dims).astype(np.int64)
    return v, raw("own", "<i4").astype(np.int64), raw("upper", "<f8").copy(), raw("lower", "<f8").copy()


def _assigned(blocks: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """The blocks with every vector at its nearest centroid, and each block's sums and counts by centroid, changed by the vectors that went."""
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        k = len(c.at)
        for batch in batches:
            for i in range(batch.num_rows):
                v, own, upper, lower = _decoded(batch, i, dims)
                was = own.copy()
                nearest(v, own, upper, lower, c)
                if batch.column("sums")[i].is_valid:
                    sums, counts = (np.frombuffer(batch.column(n)[i].as_py(), "<i8").copy() for n in ("sums", "counts"))
                else:
                    sums, counts = np.zeros(k * dims, "<i8"), np.zeros(k, "<i8")
                went = np.flatnonzero(own != was)
                table = sums.reshape(k, dims)
                np.add.at(table, own[went], v[went])
                np.add.at(counts, own[went], 1)
                left = went[was[went] >= 0]
                np.subtract.at(table, was[left], v[left])
                np.subtract.at(counts, was[left], 1)
                new = [own.astype("<i4"), upper, lower, sums, counts]
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("ids"), one.column("vectors"), one.column("wide"), *[pa.array([x.tobytes()], pa.binary()) for x in new]], names=batch.schema.names)

    return blocks.mapInArrow(tidy(run), blocks.schema)


def _totals(blocks: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[int]]:
    """Sums and counts of all blocks: k * (dims + 1) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (dims + 1), object)  # whole numbers of any size
        for batch in batches:
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += np.concatenate([np.frombuffer(s, "<i8"), np.frombuffer(n, "<i8")]).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(x) for x in total])], names=["place", "total"])

    parts = blocks.select("sums", "counts").mapInArrow(tidy(run), "place int, total string")
    got = dict(parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).collect())
    flat = [int(got.get(i) or 0) for i in range(k * (dims + 1))]
    return [flat[j * dims : (j + 1) * dims] for j in range(k)], flat[k * dims :]


def cluster(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, vec_id: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster int, distance long), final centroids) of the vectors of `dims` components.

    A component x becomes floor(scale * x). Vectors of another length, null ones
    and ones that hold a null, a NaN or an infinite component take no part. The
    first centroids are the k vectors with the smallest sha256 of `seed:vec_id`
    (a null id counts as empty; of repeated ids the smaller vector comes first);
    fewer vectors make fewer centroids, and equal ones may be centroids twice,
    the smaller number taking all. A round assigns every vector to the nearest
    centroid, ties to the smaller number, and moves a centroid to the exact
    floor of its vectors' mean; empty ones stay. When no centroid moves, the
    rounds left would change nothing and are skipped. Repeated rows are vectors
    of their own; an empty table gives no rows; other columns are ignored.
    Components over LARGEST / scale raise an error.
    """
    if not 0 < k <= MOST_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MOST_CLUSTERS}")
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col(column).cast("array<double>")
    kept = vectors.select(F.col(vec_id).alias("id"), x.alias("v")).where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    at = np.floor(np.array([r["v"] for r in first]).reshape(-1, dims) * scale)
    if len(at) and np.abs(at).max() > LARGEST:
        raise ValueError(f"components over {LARGEST / scale} have no exact squared distance in a long")
    at = at.astype(np.int64)
    blocks, path = store.written_at(_blocks(kept, dims, scale), "kmeans-0", "lz4_raw")
    known, moved = Centroids(at), True
    for r in range(rounds):
        if not len(at) or not moved:
            break
        after, new_path = store.written_at(_assigned(blocks, known, dims), f"kmeans-{r + 1}", "lz4_raw")
        store.drop(spark, path)
        blocks, path = after, new_path
        sums, counts = _totals(blocks, len(at), dims)
        new = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, at.tolist())], np.int64).reshape(-1, dims)
        moved, known, at = bool((new != at).any()), Centroids(new, at), new

    sent = spark.sparkContext.broadcast(known)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                v, own, upper, lower = _decoded(batch, i, dims)
                nearest(v, own, upper, lower, c)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(own.astype(np.int32)), pa.array(_squares(v, c.at[own]))], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema[vec_id].dataType.simpleString()
    return store.written(blocks.mapInArrow(tidy(last), f"vec_id {kind}, cluster int, distance long"), "kmeans-last"), at.tolist()


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: cluster() with the sums of its distances, and each final centroid's hash."""
    got, at = cluster(vectors, **options)
    of = {r["cluster"]: int(r["d"]) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(j, of.get(j, 0), sum(of.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(at)]
    named = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Lloyd's rounds, written out."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT r, id, v, arg_min(cid, d * 8 + cid) AS cid, min(d) AS d FROM (
    SELECT k.r, k.id, k.v, c.cid, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.c[i]) * (k.v[i] - c.c[i])))::HUGEINT AS d FROM k, c{r} c) GROUP BY r, id, v)"""
    move = """,
s{r} AS (SELECT cid, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cid, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY 1, 2),
c{next} AS MATERIALIZED (
  SELECT c.cid, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT cid, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY 1) m ON m.cid = c.cid),"""
    rounds = "".join(assign.format(r=r) + move.format(r=r, next=r + 1) for r in range(ROUNDS))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cid, v AS c FROM (SELECT v, sha256('{SEED}:' || coalesce(id::VARCHAR, '')) AS h FROM k ORDER BY h, v LIMIT {CLUSTERS})),{rounds}{assign.format(r=ROUNDS)},
i AS (SELECT a.cid, sum(a.d)::BIGINT AS cluster_inertia, sha256(array_to_string(any_value(c.c), ',')) AS h FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cid = a.cid GROUP BY a.cid)
SELECT a.id AS vec_id, a.cid::INTEGER AS cluster, a.d::BIGINT AS distance, i.cluster_inertia, (SELECT sum(cluster_inertia) FROM i)::BIGINT AS inertia, i.h AS centroid_sha256 FROM a{ROUNDS} a JOIN i ON i.cid = a.cid
"""


ORACLE_SQL = _sql()
