"""Bags of rows compared in one aggregation, and greedy matching of what is left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators.graph import cut

#: Edges of a case that one task may sort; larger cases are matched in rounds.
EDGES_AT_ONCE = 200_000


def tally(gold: DataFrame, pred: DataFrame, gold_key: Column, pred_key: Column) -> DataFrame:
    """``(key, g, p)``: how often each distinct row occurs on either side.

    Both sides go through one aggregation with map-side sums: one shuffle of distinct rows, and no
    join that a frequent row could skew.
    """
    g = gold.select(gold_key.alias("key"), F.lit(1).cast("long").alias("g"), F.lit(0).cast("long").alias("p"))
    p = pred.select(pred_key.alias("key"), F.lit(0).cast("long").alias("g"), F.lit(1).cast("long").alias("p"))
    return g.unionAll(p).groupBy("key").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def bag_intersection(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The rows that both have, as often as the rarer side has them."""
    return gold.intersectAll(pred)


def bag_difference(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The rows of ``gold`` that ``pred`` doesn't match."""
    return gold.exceptAll(pred)


def cell_edges(rest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, gk, pk, weight, gn, pn, gain)``: rows of either side that share cells at the same places, and how many.

    ``rest``: (*by, key array<string>, g, p), counts of unmatched rows; ``by`` tells cases apart.  Pairs come
    from an equi-join on (place, cell), so rows with nothing in common never meet.
    """
    g = rest.where("g > 0").select(*by, F.col("key").alias("gk"), F.col("g").alias("gn"), F.posexplode("key").alias("at", "cell"))
    p = rest.where("p > 0").select(*by, F.col("key").alias("pk"), F.col("p").alias("pn"), F.posexplode("key").alias("at", "cell"))
    return g.join(p, [*by, "at", "cell"]).groupBy(*by, "gk", "pk").agg(
        F.count("*").cast("double").alias("weight"), F.first("gn").alias("gn"), F.first("pn").alias("pn"), F.count("*").alias("gain"))


def token_edges(rest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same with rows as sets of tokens: the weight is their Jaccard index, the gain the common tokens."""
    g = rest.where("g > 0").select(*by, F.col("key").alias("gk"), F.col("g").alias("gn"), F.explode("key").alias("cell"))
    p = rest.where("p > 0").select(*by, F.col("key").alias("pk"), F.col("p").alias("pn"), F.explode("key").alias("cell"))
    pairs = g.join(p, [*by, "cell"]).groupBy(*by, "gk", "pk").agg(F.count("*").alias("gain"), F.first("gn").alias("gn"), F.first("pn").alias("pn"))
    return pairs.withColumn("weight", F.col("gain") / (F.size("gk") + F.size("pk") - F.col("gain")))


def greedy(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, gk, pk, gain, n)``: pairs taken in order of (weight down, gk, pk), each as often as both rows are left.

    Equal rows are one edge with counts, which comes to the same as taking them one by one.  Edges are
    made once; cases of up to EDGES_AT_ONCE are scanned by a task each, larger ones matched in rounds.
    """
    edges = cut(edges)
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def scan(e: pd.DataFrame) -> pd.DataFrame:
        case = e.iloc[0]
        e = e.assign(gt=e.gk.map(tuple), pt=e.pk.map(tuple)).sort_values(["weight", "gt", "pt"], ascending=[False, True, True], kind="stable")
        left: dict = {}
        out = []
        for r in e.itertuples():
            a, b = left.setdefault(("g", r.gt), r.gn), left.setdefault(("p", r.pt), r.pn)
            if n := min(a, b):
                left["g", r.gt], left["p", r.pt] = a - n, b - n
                out.append((*(case[c] for c in by), r.gk, r.pk, r.gain, n))
        return pd.DataFrame(out, columns=[*by, "gk", "pk", "gain", "n"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "gk array<string>, pk array<string>, gain long, n long"])
    if not by:
        if edges.limit(EDGES_AT_ONCE + 1).count() > EDGES_AT_ONCE:
            return greedy_rounds(edges)
        return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(scan, schema)
    large = cut(edges.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > EDGES_AT_ONCE).select(*by))
    small = edges.join(F.broadcast(large), list(by), "left_anti").groupBy(*by).applyInPandas(scan, schema)  # a row for each large case
    if large.isEmpty():
        return small
    return small.unionByName(greedy_rounds(edges.join(F.broadcast(large), list(by), "left_semi"), by))


def greedy_rounds(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``greedy`` without a single task for a case: in each round every edge that is first for both its rows is taken."""
    edges = cut(edges)
    taken = None
    while not edges.isEmpty():
        order = [F.desc("weight"), "gk", "pk"]
        ranked = edges.withColumn("a", F.row_number().over(W.partitionBy(*by, "gk").orderBy(*order))).withColumn(
            "b", F.row_number().over(W.partitionBy(*by, "pk").orderBy(*order)))
        won = cut(ranked.where("a = 1 and b = 1").select(*by, "gk", "pk", "gain", F.least("gn", "pn").alias("n")))
        taken = won if taken is None else taken.unionAll(won)
        edges = cut(
            edges.join(won.select(*by, "gk", F.col("n").alias("ng")), [*by, "gk"], "left").join(won.select(*by, "pk", F.col("n").alias("np")), [*by, "pk"], "left")
            .select(*by, "gk", "pk", "weight", (F.col("gn") - F.coalesce("ng", F.lit(0))).alias("gn"), (F.col("pn") - F.coalesce("np", F.lit(0))).alias("pn"), "gain")
            .where("gn > 0 and pn > 0"))
    if taken is None:
        return edges.select(*by, "gk", "pk", "gain", F.col("gn").alias("n"))
    return taken
