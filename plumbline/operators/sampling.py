"""Samples that come out alike in every run: places are drawn by hashes, not by random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _drawn(*columns: str, seed: int) -> list:
    """An order that looks random and that any engine with MD5 gives."""
    return [F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))).cast("binary")), *columns]


def per_operator(scores: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` failing mutants (EX = 0) of each operator."""
    w = W.partitionBy("operator").orderBy(*_drawn("question_id", "mutated_sql", seed=seed))
    return scores.where("EX = 0").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def question_groups(scores: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All mutants of ``n`` questions of each error pattern."""
    questions = scores.select("error_pattern", "question_id").distinct()
    w = W.partitionBy("error_pattern").orderBy(*_drawn("question_id", seed=seed))
    picked = questions.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return scores.join(picked, ["error_pattern", "question_id"], "left_semi")


def questions(df: DataFrame, size: int | float, seed: int = 42, key: str = "question_id") -> DataFrame:
    """All systems' rows of a number, or a fraction, of the questions."""
    ids = df.select(key).distinct()
    n = size if isinstance(size, int) else round(ids.count() * size)
    return df.join(ids.orderBy(*_drawn(key, seed=seed)).limit(n), key, "left_semi")


def without_solved(scores: DataFrame) -> DataFrame:
    """Rows of the questions none of whose mutants has EX = 1."""
    return scores.join(scores.where("EX = 1").select("question_id").distinct(), "question_id", "left_anti")


def balanced_plan(structure: DataFrame, groups: int = 4) -> DataFrame:
    """``(num_conditions, num_projections, db_id, quota)``: databases that have queries of a combination in every group, and their least count."""
    n = structure.groupBy("num_conditions", "num_projections", "db_id", "grp").agg(F.count("*").alias("n"))
    return n.groupBy("num_conditions", "num_projections", "db_id").agg(F.count("*").alias("_g"), F.min("n").alias("quota")).where(F.col("_g") == groups).drop("_g")


def balanced_sample(structure: DataFrame, groups: int = 4, seed: int = 42) -> DataFrame:
    """For each combination, group and database of the plan its quota of queries."""
    key = ["num_conditions", "num_projections", "db_id"]
    w = W.partitionBy(*key, "grp").orderBy(*_drawn("query_id", seed=seed))
    return structure.join(balanced_plan(structure, groups), key).withColumn("_r", F.row_number().over(w)).where("_r <= quota").drop("_r", "quota")


def prefix_split(sizes: DataFrame, targets: list[tuple[str, int]], rest: str = "train", order: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``(key, n, split)``: groups, in order, fill one split until its target is reached, then the next; what is left is ``rest``.

    ``sizes`` has a row for each database, so one ordered window over it stays small.
    """
    before = F.coalesce(F.sum("n").over(W.orderBy(*(order or _drawn("key", seed=seed))).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out, start = F.lit(rest), 0
    bounds = []
    for name, n in targets:
        start += n
        bounds.append((name, start))
    for name, end in reversed(bounds):
        out = F.when(before < end, name).otherwise(out)
    return sizes.select("key", "n", out.alias("split"))


def clusters(shares: DataFrame, key: str, features: list[str], k: int = 2, seed: int = 42) -> DataFrame:
    """``shares`` with a cluster by k-means over some columns; ``largest`` marks the rows of the largest one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_v").transform(shares)
    found = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", initMode="k-means||").fit(rows).transform(rows).drop("_v")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("_n"))
    top = sizes.orderBy(F.desc("_n"), "cluster").limit(1).select(F.col("cluster").alias("_top"))
    return found.crossJoin(F.broadcast(top)).withColumn("largest", F.col("cluster") == F.col("_top")).drop("_top")
