"""Exact Lloyd clustering of integer vectors with heap-ordered bounds.

Vectors are cut into blocks of at most ``BLOCK`` rows, written once, bucketed by block. A block keeps one heap
a cluster: an entry is a vector's gap (distance to the second nearest centroid less distance to its own) plus
the drift that its cluster had gathered when the entry was made. A round adds to each cluster's drift how far
its centroid moved plus the farthest move of any other one. A vector whose entry is above the drift of its
cluster cannot have changed sides and is not looked at; the others are popped, compared exactly with
all centroids, and pushed again. Only the heaps (12 bytes a vector) are rewritten and shuffled each round, to the
buckets of the blocks; centroids move by the exact sums of the vectors that changed sides.

All distances, sums and means are integers; gaps are floats, made smaller by more than their rounding,
so that a doubtful entry is always rescanned. The result is that of plain rounds over all vectors.

Defined results: vectors that are null, have not exactly ``DIM`` components, or have a null, non-finite or
over-large component (``LARGEST``, above which squared distances leave 64 bits) are not kept. A null vec_id is
kept, and seeds last. Rows that repeat a vec_id are vectors of their own; as seeds they are ordered by their
components. Fewer kept vectors than ``K`` make as many clusters; none make an empty result. A
sum of distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.base import by_value, cut_lineage
from umbra.session import Stages

DIM = 64
K = 40
ROUNDS = 5
SCALE = 256
BLOCK = 1024                    # vectors of a block
LARGEST = 1 << 26               # of a scaled component: 64 * (2 * 2^26)^2 < 2^63
EXACT = 1 << 22                 # up to here a product of floats is exact
SHRINK = 1e-9                   # far above the rounding of a gap
BLOCK_SCHEMA = "block long, ids array<long>, data binary"
STATE_SCHEMA = "block long, sizes binary, keys binary, rows binary, delta array<bigint>"

by_value(__name__)


def kept(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x) <= LARGEST / SCALE, F.lit(False)))
    return rows.where((F.size("embedding") == dim) & fits)


def scaled(flat: np.ndarray) -> np.ndarray:
    return np.floor(flat * SCALE).astype(np.int64)


def seeds(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The first centroids: the vectors whose ids hash lowest."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    return scaled(np.array([r[0] for r in rows], np.float64))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row a vector."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (a @ c.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number), and a lower bound of its gap."""
    d = distances(x, centroids)
    own = d.argmin(1)
    first = d[np.arange(len(x)), own]
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
    return own, second - np.sqrt(first.astype(np.float64)) - SHRINK * (1 + second)


class Heaps:
    """The heaps of one block: for each cluster (gap + drift, row), smallest first."""

    def __init__(self, k: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]

    @classmethod
    def read(cls, sizes: bytes, keys: bytes, rows: bytes) -> "Heaps":
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        keys, rows = np.frombuffer(keys, np.float64).tolist(), np.frombuffer(rows, np.int32).tolist()
        out = cls(0)
        out.heaps = [list(zip(keys[a:b], rows[a:b])) for a, b in zip([0, *ends], ends)]     # in heap order as written
        return out

    def written(self) -> tuple[bytes, bytes, bytes]:
        return (np.array([len(h) for h in self.heaps], np.int32).tobytes(),
                np.array([x for h in self.heaps for x, _ in h], np.float64).tobytes(),
                np.array([r for h in self.heaps for _, r in h], np.int32).tobytes())

    def expired(self, drift: list[float]) -> tuple[list[int], list[int]]:
        """Pops the entries that the drift of their cluster has reached: rows, and the cluster each was in."""
        rows, was = [], []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                rows.append(heapq.heappop(heap)[1])
                was.append(c)
        return rows, was

    def push(self, cluster: np.ndarray, gap: np.ndarray, rows, drift: list[float]) -> None:
        for c, g, r in zip(cluster.tolist(), gap.tolist(), rows):
            heapq.heappush(self.heaps[c], (g + drift[c] - SHRINK * drift[c], r))

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for c, heap in enumerate(self.heaps):
            out[[r for _, r in heap]] = c
        return out


def rescan(x: np.ndarray, state, centroids: np.ndarray, drift: list[float]) -> tuple[Heaps, np.ndarray | None, int]:
    """The heaps after a round, the change of (sums, count) of each cluster or None, and the vectors rescanned."""
    k = len(centroids)
    if state is None:
        heaps, rows, was = Heaps(k), list(range(len(x))), None
    else:
        heaps = Heaps.read(*state)
        rows, was = heaps.expired(drift)
    if not rows:
        return heaps, None, 0
    cluster, gap = nearest(x[rows], centroids)
    heaps.push(cluster, gap, rows, drift)
    delta = np.zeros((k, x.shape[1] + 1), np.int64)
    one = np.concatenate([x[rows], np.ones((len(rows), 1), np.int64)], 1)
    if was is None:
        np.add.at(delta, cluster, one)
    else:
        moved = cluster != np.array(was)
        if not moved.any():
            return heaps, None, len(rows)
        np.add.at(delta, cluster[moved], one[moved])
        np.subtract.at(delta, np.array(was)[moved], one[moved])
    return heaps, delta, len(rows)


def blocks(vectors: DataFrame, dim: int = DIM, rows: int = BLOCK) -> DataFrame:
    """Blocks of vectors. A block is named by the task that reads it, so the result must be written at once."""
    def run(batches):
        part, nth = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            data = scaled(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).astype(np.int32)
            for at in range(0, len(data), rows):
                got = data[at:at + rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part + nth]), pa.array([b.column(0)[at:at + rows].to_pylist()], pa.list_(pa.int64())), pa.array([got.tobytes()], pa.binary())],
                    ["block", "ids", "data"])
                nth += 1

    return vectors.mapInArrow(run, BLOCK_SCHEMA)


class Blocks:
    """The blocks as a table bucketed by block, in the run's folder, so that a round shuffles heaps only."""

    def __init__(self, spark: SparkSession, stages: Stages, vectors: DataFrame, dim: int):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK))
        cut = stages.write(blocks(vectors, dim))
        n = cut.count()
        self.spark, self.name = spark, f"umbra_blocks_{uuid.uuid4().hex}"
        self.buckets = max(n // 64, min(n, 2 * spark.sparkContext.defaultParallelism), 1)
        (cut.repartition(self.buckets, "block").write.bucketBy(self.buckets, "block").sortBy("block")
         .option("path", f"{stages.folder}/blocks").saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _round(frame: DataFrame, centroids: np.ndarray, drift: list[float], first: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["data"], np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
                heaps, delta, _ = rescan(x, None if first else (row["sizes"], row["keys"], row["rows"]), centroids, drift)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), *[pa.array([v], pa.binary()) for v in heaps.written()],
                     pa.array([None if delta is None else delta.ravel().tolist()], pa.list_(pa.int64()))],
                    ["block", "sizes", "keys", "rows", "delta"])

    return frame.mapInArrow(run, STATE_SCHEMA)


def _last(frame: DataFrame, centroids: np.ndarray, drift: list[float], first: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["data"], np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
                heaps, _, _ = rescan(x, None if first else (row["sizes"], row["keys"], row["rows"]), centroids, drift)
                own = heaps.clusters(len(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(own.astype(np.int32)), pa.array(((x - centroids[own]) ** 2).sum(1))],
                    ["vec_id", "cluster", "distance"])

    return frame.mapInArrow(run, "vec_id long, cluster int, distance long")


def _changes(state: DataFrame, k: int, dim: int) -> list[list[int]]:
    """Exact change of the sums and count of each cluster: at most k * (dim + 1) rows for the driver."""
    out = [[0] * (dim + 1) for _ in range(k)]
    rows = state.where("delta IS NOT NULL").select(F.posexplode("delta").alias("at", "v")).where("v <> 0")
    for r in rows.groupBy("at").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect():
        out[r["at"] // (dim + 1)][r["at"] % (dim + 1)] = int(r["v"])
    return out


def moved(centroids: np.ndarray, totals: list[list[int]], drift: list[float]) -> tuple[np.ndarray, list[float]]:
    """The centroids of ``totals`` (sums, count), and the drift of each cluster with this move added."""
    new = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(totals, centroids.tolist())], np.int64).reshape(centroids.shape)
    step = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SHRINK)
    order = np.argsort(step)
    far = [step[order[-2] if len(step) > 1 and c == order[-1] else order[-1]] if len(step) > 1 else 0.0 for c in range(len(step))]
    return new, [d + float(s) + float(f) for d, s, f in zip(drift, step, far)]


def clusters(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of each kept vector after ``rounds`` rounds, and the final centroids."""
    spark = embeddings.sparkSession
    vectors = kept(embeddings, dim)
    centroids = seeds(vectors, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64)
    stages = Stages(spark)
    table = Blocks(spark, stages, vectors, dim)
    totals, drift = [[0] * (dim + 1) for _ in centroids], [0.0] * len(centroids)
    state = None
    for _ in range(rounds):
        frame = table.table() if state is None else table.table().join(state.drop("delta"), "block")
        state = stages.write(_round(frame, centroids, drift, state is None))
        change = _changes(state, len(centroids), dim)
        totals = [[a + b for a, b in zip(x, y)] for x, y in zip(totals, change)]
        centroids, drift = moved(centroids, totals, drift)
    frame = table.table() if state is None else table.table().join(state.drop("delta"), "block")
    out = cut_lineage(_last(frame, centroids, drift, state is None))
    table.drop()
    stages.release()
    return out, centroids


def digest(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all, and the centroid's digest."""
    rows, centroids = clusters(embeddings, k, rounds, dim)
    spark = embeddings.sparkSession
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()      # at most k rows
    whole = sum(int(r["s"]) for r in sums)
    fits = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(r["cluster"], fits(int(r["s"])), fits(whole), sha[r["cluster"]]) for r in sums],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """DuckDB SQL for ``digest``: plain rounds over all vectors."""
    one_round = """
a{r} AS MATERIALIZED (SELECT i, v, xx, m.c AS c, m.d AS d FROM (
  SELECT i, any_value(k.v) AS v, any_value(k.xx) AS xx, min({{'d': k.xx - 2 * list_dot_product(k.v, c.v) + list_dot_product(c.v, c.v), 'c': c.c}}) AS m
  FROM k, c{r} AS c GROUP BY i)),"""
    new = """
n{r} AS (SELECT c, list(x ORDER BY p) AS v FROM (
  SELECT c, p, CAST((s - ((s % n) + n) % n) // n AS DOUBLE) AS x FROM (
    SELECT c, p, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS p FROM a{r}) GROUP BY c, p)) GROUP BY c),
c{s} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c)),"""
    steps = "".join(one_round.format(r=r) + new.format(r=r, s=r + 1) for r in range(ROUNDS)) + one_round.format(r=ROUNDS)
    largest = LARGEST / SCALE
    return f"""
WITH k0 AS (SELECT row_number() OVER () AS i, vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x) AND abs(x) <= {largest}]) = {DIM}),
k AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS xx FROM k0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM k QUALIFY c < {K}),{steps}
sha AS (SELECT c, sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in v], ',')) AS centroid_sha256 FROM c{ROUNDS}),
per AS (SELECT c, sum(CAST(d AS BIGINT)) AS s FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(per.s AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(s) FROM per) AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} a JOIN k0 USING (i) JOIN sha USING (c) JOIN per USING (c)"""
