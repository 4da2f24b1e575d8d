"""Centroid clustering (Lloyd's rounds) with bounds that are loosened by geometry, not by full drift.

Vectors are integers, so that distances, ties and centroids are exact. Every vector carries its
cluster and a lower bound on its distance to all other centroids. When centroids move, a bound need
not fall by the full drift of the farthest-moved one: the members of a cluster lie in a sphere
around its old centroid, and in the plane of that centre and the old and new place of another
centroid j, no point of the sphere can come nearer to j by more than ``loosening`` says. Where j
moves across or away, that is less than its drift, or below zero. A vector whose exact distance to
its own centroid is below its bound, or below half the gap to the nearest other centroid, stays;
all others are ambiguous and compared with every centroid.

A round is one pass over the vectors, written to a table with the new bounds; each task adds up its
vectors by cluster, and only those sums (clusters x components rows) are shuffled. The driver holds
the centroids alone, k x components numbers. No vector is moved between tasks, so one vector that
holds a third of all rows costs what any other rows cost.

Rows whose vector is null, has another length, or holds a null or a non-finite component are left
out. Repeated rows count as often as they occur. A null ``vec_id`` is a vector like any other, but
comes last where ids choose the first centroids; equal hashes are settled by the components. With
fewer vectors than k, there are as many centroids as vectors; an empty table gives no rows.
Components of 2**19 and more (2**27 after scaling) are refused with an error, since squared
distances would leave 64 bits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsense.llm.tables import read
from airsense.sources.stored import store

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Largest absolute value of a scaled component.
MOST = 1 << 27
#: Vectors that are compared with all centroids at once.
BLOCK = 4096
#: Relative room left for rounding when bounds (doubles) are compared.
ROOM = 1e-9
#: ``dim`` of the sums that are not of a component.
COUNT, INERTIA, SCANNED = -1, -2, -3

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("x", T.BinaryType())])
STATE = T.StructType([
    *VECTORS.fields, T.StructField("cluster", T.IntegerType()), T.StructField("lower", T.DoubleType()),
    T.StructField("distance", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("total", T.LongType()),
    T.StructField("farthest", T.LongType()),
])
ARROW_STATE = pa.schema([
    ("vec_id", pa.int64()), ("x", pa.binary()), ("cluster", pa.int32()), ("lower", pa.float64()), ("distance", pa.int64()),
    ("dim", pa.int32()), ("total", pa.int64()), ("farthest", pa.int64()),
])


@dataclass(frozen=True)
class Clusters:
    """``rows``: vec_id, cluster, distance of every kept vector. The rest by cluster number;
    ``scanned``: vectors that were compared with every centroid, by assignment."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    scanned: list[int]


def integers(components: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kept vectors as packed integers, in the narrowest type that fits the batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            ids = batch.column("vec_id")
            fits = (lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == components) & lists.is_valid().to_numpy(zero_copy_only=False)
            lists, ids = lists.filter(pa.array(fits)), ids.filter(pa.array(fits))
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, components)
            whole = np.isfinite(values).all(1)
            scaled = np.floor(values[whole] * scale)
            if scaled.size and np.abs(scaled).max() >= MOST:
                raise ValueError(f"a component is beyond {MOST // scale}: its squared distances do not fit 64 bits")
            size = float(np.abs(scaled).max()) if scaled.size else 0.0
            kind = next(t for t in (np.int8, np.int16, np.int32) if size < np.iinfo(t).max)
            packed = [row.tobytes() for row in scaled.astype(kind)]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(whole)).cast(pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "x"])

    return pack


def unpack(column: pa.Array, components: int) -> np.ndarray:
    """Packed vectors as a matrix of 64-bit integers."""
    raw = column.to_pylist()
    out = np.empty((len(raw), components), np.int64)
    size = np.array([len(r) // components for r in raw])
    for width, kind in ((1, np.int8), (2, np.int16), (4, np.int32)):
        at = np.flatnonzero(size == width)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(-1, components)
    return out


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; by matrix product in doubles where all terms stay below 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By cluster: the most that the distance from any of its members to any other centroid has
    shrunk. Members lie within ``radius`` of their own old centroid.

    For another centroid, put the origin half-way between its old and new place, p apart, and the
    axis along the move. A point at angle a and any distance comes nearer by p cos(a) at most, as a
    hyperbola stays within its asymptotes; the least angle in the sphere is that of a tangent. A
    point at (t, h), t along the axis and h off it, comes nearer by an amount that grows with t,
    and towards h = 0 falls or grows as t is above or below 0; so the corner of the box around the
    sphere bounds it too. The lesser of both holds."""
    out = np.zeros(len(old))
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    middle = (old + new) / 2
    for i in range(len(old)):
        others = np.flatnonzero(np.arange(len(old)) != i)
        if not len(others):
            continue
        p, r = drift[others], radius[i]
        away = old[i] - middle[others]
        far = np.sqrt((away**2).sum(1))
        along = np.divide((away * move[others]).sum(1), p, out=np.zeros(len(p)), where=p > 0)
        outside = far > r
        angle = np.arccos(np.clip(np.divide(along, far, out=np.ones(len(p)), where=outside), -1, 1))
        least = np.where(outside, angle - np.arcsin(np.clip(np.divide(r, far, out=np.ones(len(p)), where=outside), 0, 1)), 0.0)
        tangent = p * np.cos(np.clip(least, 0, np.pi / 2))
        t = along + r
        off = np.sqrt(np.maximum(far**2 - along**2, 0))
        h = np.where(t >= 0, np.maximum(off - r, 0), off + r)
        corner = np.sqrt((t + p / 2) ** 2 + h**2) - np.sqrt((t - p / 2) ** 2 + h**2)
        room = ROOM * (far + p + r)
        out[i] = np.where(p > 0, np.minimum(p, np.minimum(tangent, corner) + room), 0.0).max()
    return out


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    gaps = np.sqrt(squared_distances(centroids, centroids).astype(np.float64))
    np.fill_diagonal(gaps, np.inf)
    return gaps.min(1) / 2


def assigner(centroids: np.ndarray, loosen: np.ndarray | None, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over the vectors: rows with cluster, bound and distance, then the task's sums.
    ``loosen`` is None where there are no bounds yet; the last pass keeps no vectors."""
    k, width = centroids.shape
    half = half_gaps(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, farthest = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        counted = {COUNT: np.zeros(k, np.int64), INERTIA: np.zeros(k, np.int64), SCANNED: np.zeros(k, np.int64)}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = unpack(part.column("x"), width)
                n = len(x)
                if loosen is None:
                    cluster, lower, distance = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
                    ambiguous = np.arange(n)
                else:
                    cluster = part.column("cluster").to_numpy().astype(np.int64)
                    lower = part.column("lower").to_numpy() - loosen[cluster]
                    distance = ((x - centroids[cluster]) ** 2).sum(1)
                    bound = np.maximum(lower, half[cluster])
                    ambiguous = np.flatnonzero(~(np.sqrt(distance.astype(np.float64)) < bound * (1 - ROOM)))
                if len(ambiguous):
                    all_of_them = squared_distances(x[ambiguous], centroids)
                    best = all_of_them.argmin(1)
                    rows = np.arange(len(ambiguous))
                    cluster[ambiguous], distance[ambiguous] = best, all_of_them[rows, best]
                    all_of_them[rows, best] = np.iinfo(np.int64).max
                    lower[ambiguous] = np.sqrt(all_of_them.min(1).astype(np.float64)) * (1 - ROOM)
                np.add.at(sums, cluster, x)
                np.maximum.at(farthest, cluster, distance)
                counted[COUNT] += np.bincount(cluster, minlength=k)
                counted[SCANNED] += np.bincount(cluster[ambiguous], minlength=k)
                np.add.at(counted[INERTIA], cluster, distance)
                none = pa.nulls(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), none.cast(pa.binary()) if last else part.column("x"), pa.array(cluster, pa.int32()), pa.array(lower),
                     pa.array(distance), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64())], schema=ARROW_STATE)
        used = np.flatnonzero(counted[COUNT])
        totals = [(c, d, counted[d][c], farthest[c]) for c in used for d in counted]
        totals += [(c, d, sums[c, d], None) for c in used for d in range(0 if last else width)]
        if totals:
            c, d, total, far = zip(*totals, strict=True)
            none = pa.nulls(len(totals))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.binary()), pa.array(c, pa.int32()), none.cast(pa.float64()), none.cast(pa.int64()),
                 pa.array(d, pa.int32()), pa.array(total, pa.int64()), pa.array(far, pa.int64())], schema=ARROW_STATE)

    return assign


def totals_of(state: DataFrame) -> list[Row]:
    """The tasks' sums added up: a row per cluster and component, and three more per cluster."""
    return (
        state.where("dim is not null").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.max("farthest").alias("farthest")).collect()
    )


def cluster_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    components: int = COMPONENTS, scale: int = SCALE, seed: str = SEED,
) -> Clusters:
    """Lloyd's algorithm from the ``k`` vectors with the smallest sha256 of ``seed:vec_id``."""
    vectors = store(
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).mapInArrow(integers(components, scale), VECTORS),
        "centroid-vectors",
    )
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    wide = F.length("x") / components
    first = vectors.select("vec_id", "x", hashed.alias("h"), wide.alias("w")).orderBy(F.col("h").asc_nulls_last(), "w", "x").limit(k).collect()
    centroids = unpack(pa.array([bytes(r.x) for r in first], pa.binary()), components)
    state, loosen, scanned, inertia = vectors, None, [], [0] * len(centroids)
    if not len(centroids):
        return Clusters(df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, inertia, scanned)
    for turn in range(rounds + 1):
        state = store(state.mapInArrow(assigner(centroids, loosen, turn == rounds), STATE), "centroid-state")
        sums, counts, radius = centroids.copy(), np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
        found = totals_of(state)
        scanned.append(sum(r.total for r in found if r.dim == SCANNED))
        for r in found:
            if r.dim >= 0:
                sums[r.cluster, r.dim] = r.total
            elif r.dim == COUNT:
                counts[r.cluster], radius[r.cluster] = r.total, np.sqrt(float(r.farthest)) * (1 + ROOM)
            elif r.dim == INERTIA:
                inertia[r.cluster] = r.total
        if turn < rounds:
            moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
            loosen, centroids = loosening(centroids, moved, radius), moved
            inertia = [0] * len(centroids)
            state = state.where("dim is null").select("vec_id", "x", "cluster", "lower")
    return Clusters(state.where("dim is null").select("vec_id", "cluster", "distance"), centroids, inertia, scanned)


def centroid_digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(read(spark, sf_dir, "embeddings"))
    total = sum(found.inertia)
    by_cluster = spark.createDataFrame(
        [(i, found.inertia[i], total, centroid_digest(c)) for i, c in enumerate(found.centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # a row per centroid
    return found.rows.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The rounds written out as SQL."""
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(n - 1 AS INTEGER) AS cluster, q AS c
  FROM (SELECT q, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) AS n FROM kept) WHERE n <= {CLUSTERS})"""]
    for t in range(ROUNDS + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, arg_min(cluster, d * {CLUSTERS} + cluster) AS cluster, min(d) AS distance FROM (
    SELECT r, vec_id, q, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept, c{t})
  GROUP BY r)""")
        if t < ROUNDS:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, o.c) AS c FROM c{t} o LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT cluster, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM a{t}, range(1, {COMPONENTS + 1}) AS dims(i) GROUP BY cluster, i)
    GROUP BY cluster) m USING (cluster))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.cluster = c.cluster"""
