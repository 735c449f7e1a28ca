"""Nearest neighbours by learned partitions (Neural LSH, Dong et al., 2020): a balanced partitioning of a neighbour graph, learned by a small classifier.

On a bounded sample of vectors the neighbour graph is cut into equal parts, and a classifier with one hidden
layer learns in which parts the neighbours of a vector lie.  It gives every row its most probable part and
every query as many parts as hold the wanted share of probability.  Queries and rows of a part meet in
blocks, which score exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm import common, vectors

#: Parts, and vectors of the sample that the index is fitted on for each of them: at most 8,192 in all reach the driver.
PARTS = 32
FIT_ROWS = 256 * PARTS
#: Neighbours of a vector in the graph.
DEGREE = 16
#: Share of the sample's vectors by which the routing is calibrated, kept from the graph, and the recall that it must reach there.
HELD, RECALL = 1 / 16, 0.95
NEAREST = 20
#: Rows and queries that meet in one block.
ROWS, QUERIES = 16384, 4096
_HIDDEN, _EPOCHS, _BATCH, _AT_ONCE = 128, 15, 256, 256


def neighbours(x: np.ndarray, of: np.ndarray, n: int, own: bool) -> np.ndarray:
    """For each row of ``of`` the places of the ``n`` rows of ``x`` with the largest inner products; ``own``: less the one at its own place."""
    out = np.empty((len(of), n), np.int64)
    for k in range(0, len(of), 512):
        s = of[k : k + 512] @ x.T
        if own:
            s[np.arange(len(s)), np.arange(k, k + len(s))] = -np.inf
        near = np.argpartition(-s, n - 1, axis=1)[:, :n]
        out[k : k + 512] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    return out


def partition(near: np.ndarray, parts: int, sweeps: int = 8, room: float = 1.05) -> np.ndarray:
    """A part for each node of the graph: halves along the slowest mode of the graph again and again, then single nodes move.

    Halving keeps parts equal up to a node; a node then moves to the part in which most of its neighbours are, as
    long as no part grows beyond ``room`` times its share.
    """
    n = len(near)
    ends = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()]), np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    part, rng = np.zeros(n, np.int64), np.random.default_rng(1)

    def halve(nodes: np.ndarray, first: int, count: int) -> None:
        if count == 1 or len(nodes) < 2:
            part[nodes] = first
            return
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        a, b = place[ends[0]], place[ends[1]]
        inner = (a >= 0) & (b >= 0)
        a, b = a[inner], b[inner]
        root = np.sqrt(np.bincount(a, minlength=len(nodes)) + 1.0)  # with a loop at each node
        v = rng.normal(size=len(nodes))
        for _ in range(60):  # power steps towards the second mode
            v -= root * (v @ root) / (root @ root)
            w = v / root
            v = (np.bincount(a, w[b], len(nodes)) + w) / root + v
            v /= np.linalg.norm(v) or 1.0
        left = count // 2
        order = nodes[np.argsort(v / root, kind="stable")]
        cut = len(nodes) * left // count
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, count - left)

    halve(np.arange(n), 0, parts)
    most = int(np.ceil(room * n / parts))
    size = np.bincount(part, minlength=parts)
    order = np.argsort(ends[0], kind="stable")
    around, starts = ends[1][order], np.searchsorted(ends[0][order], np.arange(n + 1))
    for _ in range(sweeps):
        moved = 0
        for node in rng.permutation(n):
            there = np.bincount(part[around[starts[node] : starts[node + 1]]], minlength=parts)
            there[(size >= most) & (np.arange(parts) != part[node])] = -1
            best = int(there.argmax())
            if there[best] > there[part[node]]:
                size[part[node]] -= 1
                size[best] += 1
                part[node] = best
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """A classifier with one hidden layer: the probability that a vector's neighbours lie in each part."""

    def __init__(self, dim: int, parts: int):
        rng = np.random.default_rng(2)
        self.mean, self.scale = np.zeros(dim), 1.0
        self.w = [rng.normal(size=(dim, _HIDDEN)) * np.sqrt(2 / max(1, dim)), np.zeros(_HIDDEN), rng.normal(size=(_HIDDEN, parts)) * np.sqrt(1 / _HIDDEN), np.zeros(parts)]
        self.mass = 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(1, keepdims=True))
        return x, h, p / p.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = _EPOCHS) -> None:
        """Cross-entropy against the shares of each vector's neighbours by part, by Adam over small batches in a fixed order."""
        self.mean = x.mean(0)
        self.scale = float(np.sqrt(((x - self.mean) ** 2).mean())) or 1.0
        rng, t = np.random.default_rng(3), 0
        m, s = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for epoch in range(epochs):
            order, rate = rng.permutation(len(x)), 0.003 * (1 - epoch / epochs) + 1e-5
            for k in range(0, len(x), _BATCH):
                at = order[k : k + _BATCH]
                y, h, p = self._forward(x[at])
                d = (p - target[at]) / len(at)
                back = (d @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((y.T @ back, back.sum(0), h.T @ d, d.sum(0))):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * ((m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8) + 1e-3 * self.w[i])

    def part(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each vector."""
        return self.probabilities(x).argmax(1)

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, part)``: for each vector its most probable parts, until they hold the share ``mass`` of probability."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
        wanted = np.concatenate([np.ones((len(p), 1), bool), sums[:, :-1] < self.mass], 1)
        row, k = np.nonzero(wanted)
        return row, order[row, k]


def fitted(sample: np.ndarray, parts: int = PARTS, nearest: int = NEAREST, recall: float = RECALL) -> Router:
    """The router of a sample of vectors: graph, parts, classifier, and the share of probability that the wanted recall takes.

    The last sixteenth of the sample is kept from the graph: its vectors are queries, and ``mass`` is the least of a
    row of shares at which they find the wanted share of their nearest among all of the sample.  In a sample the
    nearest are further away than among all rows, so the true recall is higher rather than lower.
    """
    sample = np.unique(np.ascontiguousarray(sample), axis=0)  # copies can't be told apart
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    held = int(len(sample) * HELD)
    own = sample[: len(sample) - held]
    router = Router(sample.shape[1], parts)
    if len(own) <= DEGREE + 1 or parts < 2 or not held:
        return router  # too few to learn from: queries go to all parts
    near = neighbours(own, own, DEGREE, True)
    part = partition(near, parts)
    target = np.zeros((len(own), parts))
    np.add.at(target, (np.repeat(np.arange(len(own)), DEGREE), part[near].ravel()), 1 / DEGREE)
    target[np.arange(len(own)), part] += 0.5
    router.fit(own, target / target.sum(1, keepdims=True))
    queries, of = sample[len(own) :], router.part(sample)
    true = of[neighbours(sample, queries, min(nearest + 1, len(sample)), False)[:, 1:]]  # without themselves, mostly
    for mass in np.r_[np.arange(0.3, 0.95, 0.02), 0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.993, 0.995, 0.998, 0.999, 1.0]:
        router.mass = float(mass)
        row, to = router.routes(queries)
        asked = np.zeros((len(queries), parts), bool)
        asked[row, to] = True
        if np.take_along_axis(asked, true, 1).mean() >= recall:
            break
    return router


def _kept(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part."""
    kind = df.schema[vector_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, found = vectors.matrix(batch.column(1), dim)
            mask[np.flatnonzero(mask)[~found.any(axis=1)]] = False
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask)) for c in batch.columns], ["vec_id", "vector"])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(run, f"vec_id long, vector {kind}")


def _placed(kept: DataFrame, router: Router, dim: int) -> DataFrame:
    """With each row's part."""
    opened = common.sent(kept.sparkSession, router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened()
        for batch in batches:
            of = model.part(vectors.matrix(batch.column(1), dim)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], ["vec_id", "vector", "part"])

    return kept.mapInArrow(run, f"vec_id long, vector {kept.schema['vector'].dataType.simpleString()}, part int")


def _routed(queries: DataFrame, router: Router, dim: int) -> DataFrame:
    """Each query (q, vec_id, vector) once for each part that it asks."""
    opened = common.sent(queries.sparkSession, router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened()
        for batch in batches:
            row, to = model.routes(vectors.matrix(batch.column(2), dim)[1])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(to, pa.int32())], ["q", "query_id", "vector", "part"])

    return queries.mapInArrow(run, f"q long, query_id long, vector {queries.schema['vector'].dataType.simpleString()}, part int")


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, nearest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the ids and inner products of its nearest rows that have another id, nearest first, ties by id.

    Products of whole blocks choose what may be among the nearest, with room for rounding; these are then summed one
    by one, so equal vectors have equal scores wherever they stand.
    """
    order = np.argsort(ids, kind="stable")
    first, last = np.searchsorted(ids[order], query_ids, "left"), np.searchsorted(ids[order], query_ids, "right")
    room = 1e-12 * np.abs(rows).max(initial=0) * rows.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):  # beyond doubles a product is infinite, or no number and last
        for k in range(0, len(queries), _AT_ONCE):
            s = queries[k : k + _AT_ONCE] @ rows.T
            s[np.isnan(s)] = -np.inf
            for i, line in enumerate(s, k):
                line[order[first[i] : last[i]]] = -np.inf
                least = np.partition(line, len(line) - nearest)[len(line) - nearest] if len(line) > nearest else -np.inf
                least -= room * np.abs(queries[i]).max()
                at = np.flatnonzero(line >= least) if np.isfinite(least) else np.arange(len(line))
                at = at[ids[at] != query_ids[i]]
                exact = (rows[at] * queries[i]).sum(1)
                top = np.lexsort((ids[at], -exact))[:nearest]
                yield i, ids[at][top], exact[top]


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, wanted: int = NEAREST, parts: int = PARTS, fit_rows: int = FIT_ROWS,
            rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides the nearest found of all rows of another id.

    Nearest is by the largest inner product in doubles, ties by the smaller id.  The router is fitted on ``fit_rows``
    rows, chosen by hash; every row is indexed.  Rows without an id, and vectors that are null or zero, hold null or
    non-finite components, or have another length than the commonest (the smaller of two), take no part.  Of rows
    with one id each is a candidate of its own, and each is a query, whose results then have one ``query_id``.
    Queries with fewer candidates get all that their parts hold; an empty table gives none; other columns play no part.

    A part of any size is cut into blocks of ``rows``, queries into blocks of ``queries``, and each block of a part
    meets each block of queries in a task of its own, whose results are cut to the nearest before they move.  A larger
    table can take more parts, with a larger sample.
    """
    spark = df.sparkSession
    dim = vectors.commonest_length(df, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    kept = _kept(df, id_col, vector_col, dim)
    sample = kept.withColumn("h", F.xxhash64("vec_id", F.monotonically_increasing_id())).orderBy("h").limit(fit_rows).select("vector").toArrow()  # fit_rows at most
    if not sample.num_rows:
        return empty
    router = fitted(vectors.matrix(sample.column(0).combine_chunks(), dim)[1], parts, wanted)
    placed = common.saved(_placed(kept, router, dim), "placed").withColumn("row", F.monotonically_increasing_id())
    asks = F.col("vec_id") % every == 0
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(asks).alias("asks")).collect()  # a row a part
    asked = sum(r["asks"] for r in sizes)
    if not asked:
        return empty
    blocks = F.create_map(*[F.lit(x) for r in sizes for x in (r["part"], -(-r["n"] // rows))])
    asking = -(-asked // queries)
    deal = lambda c, n: F.pmod(F.xxhash64(c), n)
    here = placed.withColumn("block", deal("row", blocks[F.col("part")])).select(
        "part", "block", F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("asking"), "vec_id", "vector")
    routed = _routed(placed.where(asks).select(F.col("row").alias("q"), "vec_id", "vector"), router, dim).where(F.col("part").isin([r["part"] for r in sizes]))
    there = routed.withColumn("asking", deal("q", F.lit(asking)).cast("int")).select(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), blocks[F.col("part")].cast("long") - 1)).alias("block"), "asking", "q", "query_id", "vector")
    key = ["part", "block", "asking"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            of, mine = (np.asarray(t.column("vector").combine_chunks().flatten().cast(pa.float64())).reshape(-1, dim) for t in (left, right))
            q, query_ids, ids = (np.asarray(t.column(c).combine_chunks()) for t, c in ((left, "q"), (left, "query_id"), (right, "vec_id")))
            for i, near, score in best(of, query_ids, mine, ids, wanted):
                for out, values in zip(got, (np.full(len(near), q[i]), np.full(len(near), query_ids[i]), near, score)):
                    out.append(values)
        return pa.table([pa.array(np.concatenate(g) if g else [], t) for g, t in zip(got, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["q", "query_id", "vec_id", "score"])

    found = there.groupBy(*key).cogroup(here.groupBy(*key)).applyInArrow(run, "q long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.when(~F.isnan("score"), F.col("score")).desc_nulls_last(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the ``exact`` rows (query_id, vec_id) that are among those found; 1 without any."""
    r = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return r["hits"] / r["n"] if r["n"] else 1.0
