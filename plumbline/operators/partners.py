"""The best assignment of many rows by similarity, where the rows don't dispute their best partners.

If each row of the smaller side can have the partner it likes best, that is the assignment with the largest total, whatever
the number of rows: no other can give any row more.  Best partners are found block by block of all pairs, so
memory is bounded by a block, and equal rows are one with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import embed
from plumbline.operators.graph import cut

#: Different rows of either side that meet in one task.
BLOCK = 2048


def _embedded(rows: DataFrame, provider: embed.Provider) -> DataFrame:
    """``(text, n, vector)`` of different texts (text, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                vectors = np.asarray(provider(part.column(0).to_pylist()), float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(vectors), pa.list_(pa.float64()))], ["text", "n", "vector"])

    return cut(rows.mapInArrow(run, "text string, n long, vector array<double>"))


#: Queries and rows that meet in one task, and queries that are scored at a time there.
ASKED, ROWS, STRIP = 4096, 16_384, 256
#: How near to the border between two rounded cosines, in units of their last digit, one is worked out exactly.
NEAR = 1e-4


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and their lengths; -1 for those that are null or hold null."""
    flat, sizes = vectors.combine_chunks(), np.array(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy())
    values, of = flat.flatten(), np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    out = np.zeros((len(sizes), max(sizes.max(initial=0), 1)))
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out[of, np.arange(len(of)) - starts[of]] = values.to_numpy(zero_copy_only=False)
    if values.null_count:
        sizes[of[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, sizes


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows with each other, summed from the first on as Spark does."""
    return np.cumsum(x * y, axis=1)[:, -1]


def most_similar(asked: DataFrame, rows: DataFrame, k: int, digits: int) -> DataFrame:
    """``(q, vec_id, sim)``: for each of ``asked`` (q, e) the ``k`` of ``rows`` (vec_id, embedding) with the largest rounded cosines, ties to the smaller id, without itself.

    Blocks of both sides meet in a task, which scores them by matrix products and keeps what can be among the first ``k``; those have the
    value of ``embed.cosine``.  A pair without a cosine (null, unequal lengths, zeros) comes last with null.
    """
    asked = asked.where("q IS NOT NULL").select("q", F.col("e").cast("array<double>").alias("e"))
    rows = rows.where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    a, b = max(1, -(-asked.count() // ASKED)), max(1, -(-rows.count() // ROWS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here, there = asked.select(deal("q", a).alias("a"), every(b).alias("b"), "*"), rows.select(every(a).alias("a"), deal("vec_id", b).alias("b"), "*")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list = []
        if x.num_rows and y.num_rows:
            y = y.sort_by("vec_id")
            ids, asks = y.column("vec_id").to_numpy(), x.column("q").to_numpy()
            (v, wide), (u, size) = _matrix(y.column("embedding")), _matrix(x.column("e"))
            n = max(v.shape[1], u.shape[1])
            v, u = (np.pad(m, ((0, 0), (0, n - m.shape[1]))) for m in (v, u))
            with np.errstate(all="ignore"):
                norm_v, norm_u = np.sqrt(_in_order(v, v)), np.sqrt(_in_order(u, u))
                for s in range(0, len(u), STRIP):
                    part = slice(s, s + STRIP)
                    norms = norm_u[part, None] * norm_v
                    x_ = u[part] @ v.T / norms * 10.0**digits + 0.5
                    none = (size[part, None] != wide) | (size[part, None] < 0) | (norms == 0)
                    near = (np.abs(x_ - np.round(x_)) < NEAR) & ~none
                    whole = np.where(none, -np.inf, np.where(np.isnan(x_), np.inf, np.floor(x_)))
                    whole[asks[part, None] == ids] = np.nan
                    sure = np.where(near | np.isnan(whole), -np.inf, whole)
                    least = np.partition(sure, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(whole), -np.inf)
                    for at in range(len(whole)):
                        own = np.flatnonzero((whole[at] >= least[at]) & ~near[at])
                        own = own[np.argsort(-whole[at, own], kind="stable")[:k]]
                        own = np.concatenate([own, np.flatnonzero(near[at] & (whole[at] >= least[at] - 1))])
                        sims = _in_order(np.broadcast_to(u[s + at], (len(own), n)), v[own]) / norms[at, own]
                        out += zip([asks[s + at]] * len(own), ids[own], sims, none[at, own])
        q, i, sims, gone = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(np.array(sims, float), pa.float64(), mask=np.array(gone, bool))], ["q", "vec_id", "sim"])

    found = here.groupBy("a", "b").cogroup(there.groupBy("a", "b")).applyInArrow(run, "q long, vec_id long, sim double").withColumn("sim", F.round("sim", digits))
    return found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "vec_id"))).where(F.col("r") <= k).drop("r")


def best(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(text, n, partner, score)``: each left text's most similar right one, 1 for an equal one; of equally similar ones the text that sorts first."""
    a, b = (-(-d.count() // block) for d in (left, right))
    if not a or not b:
        return left.select("text", "n", F.lit(None).cast("string").alias("partner"), F.lit(0.0).alias("score")).limit(0)
    deal = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = left.select(deal(a).alias("a"), every(b).alias("b"), "text", "n", "vector")
    there = right.select(every(a).alias("a"), deal(b).alias("b"), "text", "vector")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        texts, n = (x.column(c).to_pylist() for c in ("text", "n"))
        y = y.sort_by("text")
        others = y.column("text").to_pylist()
        if not texts or not others:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.float64())], ["text", "n", "partner", "score"])
        vectors = [np.stack([np.asarray(v, float) for v in t.column("vector").to_pylist()]) for t in (x, y)]
        scores, place = embed.similarities(*vectors), {t: k for k, t in enumerate(others)}
        for k, t in enumerate(texts):
            if t in place:
                scores[k, place[t]] = 1.0
        top = scores.argmax(1)
        return pa.table([pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array([others[k] for k in top], pa.string()), pa.array(scores[np.arange(len(top)), top])], ["text", "n", "partner", "score"])

    found = here.groupBy("a", "b").cogroup(there.groupBy("a", "b")).applyInArrow(run, "text string, n long, partner string, score double")
    first = found.groupBy("text", "n").agg(F.min(F.struct((-F.col("score")).alias("s"), "partner")).alias("x"))
    return first.select("text", "n", F.col("x.partner").alias("partner"), (-F.col("x.s")).alias("score"))


def undisputed(gold: DataFrame, pred: DataFrame, provider: embed.Provider, block: int = BLOCK) -> float | None:
    """The total similarity of the best assignment of two columns ``text``; None if rows of the smaller side dispute a partner.

    An equal text is as good a partner as there can be, so texts that have one take it, and only the others meet all of the larger side.
    """
    few, many = sorted([cut(d.groupBy("text").agg(F.count("*").alias("n"))) for d in (gold, pred)], key=lambda d: d.agg(F.sum("n")).first()[0] or 0)
    own = cut(few.join(many.select("text", F.col("n").alias("there")), "text", "left"))
    asked = own.where("there IS NOT NULL").select("text", F.col("n").alias("asked"))
    total, over = own.where("there IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > F.col("there"))).first()
    if over:
        return None
    rest = own.where("there IS NULL").select("text", "n")
    if rest.isEmpty():
        return float(total)
    chosen = cut(best(_embedded(rest, provider), _embedded(many, provider), block))
    asked = asked.unionAll(chosen.groupBy(F.col("partner").alias("text")).agg(F.sum("n").alias("asked"))).groupBy("text").agg(F.sum("asked").alias("asked"))
    if not asked.join(many, "text").where("asked > n").isEmpty():
        return None
    return total + chosen.agg(F.sum(F.col("n") * F.col("score"))).first()[0]
