"""Clustering around centroids with one lower bound a group of centroids (Yinyang k-means, Ding et al., 2015), exact in integers.

Centroids are clustered into groups once.  Each vector keeps an upper bound of its distance to its own
centroid and a lower bound for each group.  When centroids move, the bounds move with them; a vector whose
upper bound is still under all lower ones stays without a distance computed, a group under whose bound it
stays is left out, and of the groups that are left only the centroids that may have come near are scanned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common, vectors

CLUSTERS = 40
ROUNDS = 5
#: Centroids a group, as in the paper.
PER_GROUP = 10
#: Components are scaled by this and floored.
SCALE = 256
#: Integers are held within plus and minus this, so that the squared distance of 64 components fits a long.
LARGEST = 2**27
#: Bounds are widened by this share at each step, far more than doubles round.
SLACK = 2.0**-40
_FAR, _MOST = 1e300, 2**63 - 1


def integers(values: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of doubles, held within LARGEST."""
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The squared distances of the rows of ``x`` to those of ``c``, exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2**53:  # then doubles are exact, and their products quicker
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def groups(centroids: np.ndarray, per_group: int = PER_GROUP) -> np.ndarray:
    """Each centroid's group: a few plain rounds among the centroids themselves, from evenly spaced ones."""
    k = len(centroids)
    n = max(1, math.ceil(k / per_group))
    middle = centroids[np.linspace(0, k - 1, n).astype(int)].astype(float)
    for _ in range(5):
        of = ((centroids[:, None, :] - middle) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (of == g).any():
                middle[g] = centroids[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


class Centroids:
    """Centroids, their groups, and how far each has moved since the bounds were set (none before the first round)."""

    def __init__(self, now: np.ndarray, of: np.ndarray, before: np.ndarray | None = None):
        self.now, self.of, self.n = now, of, int(of.max(initial=0)) + 1
        self.drift = None if before is None else np.sqrt(((now - before).astype(float) ** 2).sum(1)) * (1 + SLACK)

    def _least(self, each: np.ndarray) -> np.ndarray:
        return np.stack([each[:, self.of == g].min(1) for g in range(self.n)], 1)

    def nearest(self, x: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid (of equally near ones the smaller number), its new bounds, and how many distances were computed."""
        now, of, k = self.now, self.of, len(self.now)
        if self.drift is None:
            exact = squares(x, now)
            best = exact.argmin(1)
            each = np.sqrt(exact) * (1 - SLACK)
            upper = np.sqrt(exact[np.arange(len(x)), best]) * (1 + SLACK)
            each[np.arange(len(x)), best] = _FAR
            return best, upper, self._least(each), exact.size
        upper = (upper + self.drift[was]) * (1 + SLACK)
        most = np.array([self.drift[of == g].max() for g in range(self.n)])
        fresh = lower - most - SLACK * (lower + most)
        cluster = was.copy()
        rows = np.flatnonzero(fresh.min(1) <= upper)  # the global filter, by the loose upper bound
        own = ((x[rows] - now[was[rows]]) ** 2).sum(1)
        upper[rows] = np.sqrt(own) * (1 + SLACK)
        computed, tight = len(rows), fresh[rows].min(1) <= upper[rows]
        rows, own = rows[tight], own[tight]  # and by the exact one
        if not len(rows):
            return cluster, upper, fresh, computed
        at, mine, top = np.arange(len(rows)), was[rows], upper[rows]
        exact = np.full((len(rows), k), _MOST)
        exact[at, mine] = own
        opened = fresh[rows] <= top[:, None]  # the group filter
        each = np.empty((len(rows), k))
        for c in range(k):
            old = lower[rows, of[c]]
            each[:, c] = old - self.drift[c] - SLACK * (old + self.drift[c])
            scan = np.flatnonzero(opened[:, of[c]] & (each[:, c] <= top) & (mine != c))  # the centroid's own filter
            exact[scan, c] = squares(x[rows[scan]], now[c : c + 1])[:, 0]
            each[scan, c] = np.sqrt(exact[scan, c]) * (1 - SLACK)
            computed += len(scan)
        each[at, mine] = np.sqrt(own) * (1 - SLACK)
        best = exact.argmin(1)
        cluster[rows], upper[rows] = best, np.sqrt(exact[at, best]) * (1 + SLACK)
        each[at, best] = _FAR
        fresh[rows] = self._least(each)
        return cluster, upper, fresh, computed


def _batches(fn: Callable[[pa.RecordBatch], dict], names: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], t) for n, t in names.items()], list(names))

    return run


_STATE = "x array<int>, was int, cluster int, upper double, lower array<double>"


def _started(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(vec_id, x)`` of the vectors that have ``dim`` finite components, as integers."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> dict:
        mask, found = vectors.matrix(batch.column(1), dim)
        return {"vec_id": batch.column(0).filter(pa.array(mask)), "x": vectors.lists(integers(found).astype(np.int32), pa.int32())}

    return df.select(F.col(id_col), F.col(vector_col)).mapInArrow(_batches(fn, {"vec_id": None, "x": None}), f"vec_id {kind}, x array<int>")


def _placed(state: DataFrame, centroids: Centroids, dim: int, last: bool) -> DataFrame:
    """The state after one more assignment; after the last one ``(vec_id, cluster, distance)``."""
    spark, kind, first = state.sparkSession, state.schema["vec_id"].dataType.simpleString(), centroids.drift is None
    opened = common.sent(spark, centroids)

    def fn(batch: pa.RecordBatch) -> dict:
        model, n = opened(), batch.num_rows
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
        was = np.full(n, -1, np.int64) if first else batch.column(2).to_numpy().astype(np.int64)
        lower = np.zeros((n, model.n)) if first else batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, model.n)
        cluster, upper, lower, _ = model.nearest(x, was, np.zeros(n) if first else batch.column(3).to_numpy(), lower)
        if last:
            return {"vec_id": batch.column(0), "cluster": cluster, "distance": ((x - model.now[cluster]) ** 2).sum(1)}
        return {"vec_id": batch.column(0), "x": batch.column(1), "was": was, "cluster": cluster, "upper": upper, "lower": vectors.lists(lower, pa.float64())}

    columns = ["vec_id", "x"] if first else ["vec_id", "x", F.col("cluster").alias("was"), "upper", "lower"]
    if last:
        return state.select(*columns).mapInArrow(_batches(fn, {"vec_id": None, "cluster": pa.int32(), "distance": pa.int64()}), f"vec_id {kind}, cluster int, distance long")
    names = {"vec_id": None, "x": None, "was": pa.int32(), "cluster": pa.int32(), "upper": pa.float64(), "lower": None}
    return state.select(*columns).mapInArrow(_batches(fn, names), f"vec_id {kind}, {_STATE}")


def _changes(state: DataFrame, dim: int, k: int) -> list:
    """``(cluster, at, total)``: what vectors that changed their cluster add to and take from its sums; ``at`` -1 is the count.

    A task adds up its own first, so a cluster of any size sends as many rows as there are tasks and components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)
            was, now = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            np.add.at(sums, now, x)
            np.subtract.at(sums, was[was >= 0], x[was >= 0])
        c, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at - 1, pa.int32()), pa.array(sums[c, at])], ["cluster", "at", "total"])

    moved = state.where("cluster <> was").select("x", "was", "cluster").mapInArrow(run, "cluster int, at int, total long")
    return moved.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * (dim + 1) rows at most


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = 64,
              per_group: int = PER_GROUP) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector with ``dim`` finite components.

    Centroids start as the vectors whose ids hash smallest (of rows with one id the one whose integers sort
    first); each round assigns all vectors and replaces each centroid that has any by the floor of their mean.
    Vectors that are null, of another length, or hold null or non-finite components are left out.  Rows without an
    id are clustered but start none; with fewer vectors than clusters all start one, with none the result is
    empty.  Repeated rows count as often as they occur and get equal results; equally near centroids go
    by the smaller number.  Columns of other names play no part.  Integers are held within LARGEST, and sums
    of distances beyond a long at its largest value.

    Between rounds the vectors with their bounds are a table in the shared folder, the one before it is taken
    away; the driver holds the centroids, their sums and nothing else.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    path = common.written(_started(df, id_col, vector_col, dim), "yinyang")
    state = spark.read.schema(f"vec_id {kind}, x array<int>").parquet(path)
    first = state.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    if not first:
        first = state.select("x").orderBy("x").limit(clusters).collect()  # nobody has an id
    if not first:
        common.removed(spark, path)
        return empty
    now = np.array([r["x"] for r in first], np.int64)
    k, of, before = len(now), groups(now, per_group), None
    sums = [[0] * (dim + 1) for _ in range(k)]
    for turn in range(rounds + 1):
        last = turn == rounds
        after = common.written(_placed(state, Centroids(now, of, before), dim, last), "yinyang")
        common.removed(spark, path)
        path = after
        state = spark.read.schema(f"vec_id {kind}, cluster int, distance long" if last else f"vec_id {kind}, {_STATE}").parquet(path)
        if last:
            break
        for r in _changes(state, dim, k):
            sums[r["cluster"]][r["at"] + 1] += int(r["total"])
        before = now
        now = np.array([[s // total[0] for s in total[1:]] if total[0] else old.tolist() for total, old in zip(sums, now)], np.int64)
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    total = min(sum(inertia.values()), _MOST)
    told = spark.createDataFrame(
        [(c, min(d, _MOST), total, hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = 64) -> str:
    """The same by plain rounds, for DuckDB."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x
            FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {clusters}))"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, vec_id, v.x, min(struct_pack(d := list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.x[i] - c{k}.x[i]) * (v.x[i] - c{k}.x[i]))), c := c)) AS best
            FROM v, c{k} GROUP BY r, vec_id, v.x)""")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT c, list(f ORDER BY i) AS x FROM (
                SELECT best.c AS c, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS f FROM a{k}, unnest(range(1, {dim + 1})) t(i) GROUP BY best.c, i) GROUP BY c),
            c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c)""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, best.c AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best.c"""
