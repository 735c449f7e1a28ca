"""Many pairs of queries scored together, whatever their queries raise and however long they take.

Each distinct query runs once, in a job of its own, under a time limit if one is given, and leaves of its rows
what the technique compares in the shared folder.  All pairs whose queries ran are then scored by one plan: an aggregation
by (case, row) compares bags, and what is left is matched case by case.  The techniques that need a
driver's assignment run pair by pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.operators import early, techniques, tiers
from plumbline.session import shared_folder
from plumbline.sources import limits

#: Techniques that one plan scores for all cases.
TOGETHER = ("execution_accuracy", "exact_column_and_exact_cell", "exact_column_and_partial_cell", "no_column_and_partial_cell")
SCORES = ["ex", "exp", "exr", "f1", "matched", "gold_cells", "pred_cells"]
_CASE = "case_id string, gold_id string, pred_id string, gold_at array<int>, pred_at array<int>, gold_width int, pred_width int"


class Results:
    """The rows of some queries: ``rows`` (query_id, cells, tokens) of those that ran, and by query a status, columns and seconds.

    ``tokens`` are null unless asked for.
    """

    def __init__(self, spark: SparkSession, queries: Iterable[str], seconds: float | None = None, tokens: bool = True):
        self.spark, self.folder, self.tokens = spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}", tokens
        self.ids = {sql: f"q{k}" for k, sql in enumerate(dict.fromkeys(queries))}
        self.found = limits.run_all(spark, {sql: partial(self._write, sql, k) for sql, k in self.ids.items()}, seconds)

    def _write(self, sql: str, query_id: str) -> list[str]:
        df = cells.unique_names(early.result(self.spark, sql))
        tokens = cells.tokens(df) if self.tokens else F.lit(None).cast("array<string>")
        df.select(F.lit(query_id).alias("query_id"), cells.cells(df).alias("cells"), tokens.alias("tokens")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{query_id}")
        return df.columns

    def rows(self) -> DataFrame:
        ran = [f"{self.folder}/{self.ids[q]}" for q, out in self.found.items() if out.status == "ok"]
        schema = "query_id string, cells array<string>, tokens array<string>"
        return self.spark.read.schema(schema).parquet(*ran) if ran else self.spark.createDataFrame([], schema)


def _sides(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Each case's rows of both sides: (case_id, cells, tokens, at, g, p)."""
    out = None
    for side, g, p in (("gold", 1, 0), ("pred", 0, 1)):
        of = cases.select("case_id", F.col(f"{side}_id").alias("query_id"), F.col(f"{side}_at").alias("at"), (F.col("gold_width") == F.col("pred_width")).alias("alike"))
        part = rows.join(F.broadcast(of), "query_id").select("case_id", "cells", "tokens", "at", "alike", F.lit(g).cast("long").alias("g"), F.lit(p).cast("long").alias("p"))  # a row for each case
        out = part if out is None else out.unionAll(part)
    return out


def _tally(sides: DataFrame, key) -> DataFrame:
    return sides.groupBy("case_id", key).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def _together(rows: DataFrame, cases: DataFrame, technique: str, penalize: bool) -> DataFrame:
    """``(case_id, *SCORES)`` of all cases by one of the TOGETHER.

    If both sides have the same columns in the same places, the bags that are compared tell EX too.
    """
    sides, both, zero = _sides(rows, cases), F.least("g", "p"), F.lit(0).cast("long")
    by_tokens, exact = technique == "no_column_and_partial_cell", technique == "exact_column_and_exact_cell"
    cases = cases.withColumn("bags", (F.size("gold_at") == F.col("gold_width")) & (F.col("gold_at") == F.col("pred_at")))
    apart = sides.join(F.broadcast(cases.where("NOT bags").select("case_id")), "case_id", "left_semi") if exact else sides  # a row for each case
    is_same = F.bool_and((F.col("g") > 0) == (F.col("p") > 0)).alias("same")
    same = _tally(apart.where("alike"), F.col("cells").alias("key")).groupBy("case_id").agg(is_same)
    if exact:
        key = F.transform("at", lambda k: F.get("cells", k))
        tally = _tally(sides, key.alias("key"))
        sums = tally.groupBy("case_id").agg(F.sum(both).alias("m"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), is_same.alias("same_bags"))
        told = cases.join(same, "case_id", "left").join(sums, "case_id", "left").withColumn("same", F.when(F.col("bags"), F.col("same_bags")).otherwise(F.col("same")))
    else:
        told = cases.join(same, "case_id", "left")
    told = told.withColumn("ex", F.when(F.col("gold_width") == F.col("pred_width"), F.coalesce("same", F.lit(True)).cast("int")).otherwise(0))
    if technique == "execution_accuracy":
        return told.select("case_id", "ex", *[F.col("ex").cast("double").alias(c) for c in SCORES[1:4]], *[F.lit(None).cast("long").alias(c) for c in SCORES[4:]])
    if exact:
        out = told.withColumn("more", zero)
    else:
        out = _partly(sides, told, by_tokens)
    width = F.size("gold_at")
    m, g, p = (F.coalesce(c, zero) for c in ("m", "n_gold", "n_pred"))
    if not by_tokens:
        m, g, p = m * width, g * F.col("gold_width"), p * F.when(width == 0, F.col("pred_width")).otherwise(F.col("pred_width") if penalize else width)
    out = out.select("case_id", "ex", (m + F.coalesce("more", zero)).alias("matched"), g.alias("gold_cells"), p.alias("pred_cells"), ((width == 0) & F.lit(not by_tokens)).alias("apart"))
    # without a column in common all is wrong, unless the results are the same
    return techniques.scored(out, "case_id", "apart").select(
        "case_id", "ex", *[F.when(F.col("apart") & (F.col("ex") == 0), 0.0).otherwise(F.col(c)).alias(c) for c in SCORES[1:4]], *SCORES[4:])


def _partly(sides: DataFrame, told: DataFrame, by_tokens: bool) -> DataFrame:
    """``told`` with the rows of either side, those in common and what is gained beyond them."""
    both, key = F.least("g", "p"), F.col("tokens") if by_tokens else F.transform("at", lambda k: F.get("cells", k))
    size = F.size("key") if by_tokens else F.lit(1)
    tally = _tally(sides, key.alias("key"))
    sums = tally.groupBy("case_id").agg(F.sum(size * both).alias("m"), F.sum(size * F.col("g")).alias("n_gold"), F.sum(size * F.col("p")).alias("n_pred"))
    rest = tally.select("case_id", "key", (F.col("g") - both).alias("g"), (F.col("p") - both).alias("p")).where("g > 0 or p > 0")
    return told.join(sums, "case_id", "left").join(tiers.gained(rest, ("case_id",), by_tokens), "case_id", "left")


def scores(spark: SparkSession, cases: Iterable[tuple[str, str, str]], technique: str, seconds: float | None = None, **options) -> DataFrame:
    """``(case_id, status, error, latency, *SCORES)`` for each (case_id, gold SQL, predicted SQL).

    ``status`` is ok, or error if either query or the comparison of this case alone raised, or timeout if one of them
    took longer than ``seconds`` (None: no limit) with nothing beside it; then the scores are zeros, and no other
    case is touched.
    """
    if technique not in techniques.TECHNIQUES:
        raise ValueError(f"unknown technique {technique}")
    cases = [(str(k), g, p) for k, g, p in cases]
    results = Results(spark, [q for _, g, p in cases for q in (g, p)], seconds, technique == "no_column_and_partial_cell") if technique in TOGETHER else None
    if results is None:
        return _told(spark, _one_by_one(spark, cases, technique, seconds, options))
    good, told = [], []
    for k, g, p in cases:
        pair = results.found[g], results.found[p]
        bad = next((x for x in pair if x.status != "ok"), None)
        if bad is None:
            gc, pc = (x.result for x in pair)
            names = sorted(set(gc) & set(pc))
            good.append((k, results.ids[g], results.ids[p], [gc.index(n) for n in names], [pc.index(n) for n in names], len(gc), len(pc)))
        told.append((k, "ok", None, pair[0].seconds + pair[1].seconds) if bad is None else (k, bad.status, str(bad.result or bad.status), -1.0))
    found = _together(results.rows(), spark.createDataFrame(good, _CASE), technique, options.get("penalize_extra_pred_cols", True))
    return _told(spark, spark.createDataFrame(told, _TOLD).join(found, "case_id", "left"))


_TOLD = "case_id string, status string, error string, latency double"


def _told(spark: SparkSession, found: DataFrame) -> DataFrame:
    none = {"ex": F.lit(0), **{c: F.lit(0.0) for c in SCORES[1:4]}}
    return found.select("case_id", "status", "error", "latency", *[F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in SCORES])


def _one_by_one(spark: SparkSession, cases: list, technique: str, seconds: float | None, options: dict) -> DataFrame:
    """Cases of a technique that no single plan scores: each in jobs of its own."""
    found = limits.run_all(spark, {at: partial(_alone, spark, g, p, technique, options) for at, (_, g, p) in enumerate(cases)}, seconds)
    rows = [(k, out.status, None, out.seconds, *out.result) if out.status == "ok" else (k, out.status, str(out.result or out.status), -1.0, *[None] * len(SCORES))
            for (k, _, _), out in zip(cases, found.values())]
    return spark.createDataFrame(rows, f"{_TOLD}, {techniques.SCORES}")


def _alone(spark: SparkSession, gold: str, pred: str, technique: str, options: dict) -> tuple:
    return tuple(getattr(techniques, technique)(early.result(spark, gold), early.result(spark, pred), **options).select(*SCORES).first())


def mutant_scores(spark: SparkSession, mutants: DataFrame, used: Iterable[str] = ("exact_column_and_exact_cell",), seconds: float | None = None) -> DataFrame:
    """Scores of mutants (question_id, db_id, depth, operators, mutated_sql, error_count, gold_sql) by each technique.

    The corpus of mutants is the driver's; gold queries run once for all their mutants.  A mutant that
    fails or takes too long has null scores, latency -1 and its status; ``operator`` is the last of its operators.
    """
    rows = [r.asDict() for r in mutants.orderBy("question_id", "depth", "operators").collect()]
    return _swept(spark, rows, "gold_sql", "mutated_sql", used, seconds).withColumn("operator", F.element_at("operators", -1))


def system_scores(spark: SparkSession, logs: DataFrame, used: Iterable[str] = ("execution_accuracy",), seconds: float | None = None) -> DataFrame:
    """Scores of several systems' answers (system, question_id, gold_sql, pred_sql) by each technique.

    ``logs`` without one of these columns raise ValueError.  What a run has left is ``sinks.pending`` by
    (system, question_id, technique); ``sinks.resume`` appends to it.
    """
    if missing := {"system", "question_id", "gold_sql", "pred_sql"} - set(logs.columns):
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return _swept(spark, [r.asDict() for r in logs.orderBy("system", "question_id").collect()], "gold_sql", "pred_sql", used, seconds, logs.schema)


def _swept(spark: SparkSession, rows: list[dict], gold: str, pred: str, used: Iterable[str], seconds: float | None, schema=None) -> DataFrame:
    if not rows:
        raise ValueError("nothing to score")
    keyed = [{**r, "case_id": str(k)} for k, r in enumerate(rows)]
    frame = spark.createDataFrame(keyed) if schema is None else spark.createDataFrame([(*r.values(),) for r in keyed], schema.simpleString()[7:-1].replace(":", " ") + ", case_id string")
    out = None
    for technique in used:
        found = scores(spark, [(r["case_id"], r[gold] or "", r[pred] or "") for r in keyed], technique, seconds)
        ok = F.col("status") == "ok"
        part = frame.join(found, "case_id").drop("case_id").withColumns({"technique": F.lit(technique), **{c: F.when(ok, F.col(c)) for c in SCORES}})
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"ex": "EX", "exp": "EXP", "exr": "EXR", "f1": "F1"})
