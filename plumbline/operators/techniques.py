"""The seven ways to compare a predicted result with a gold one; each gives one row of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cells, embed
from plumbline.operators import early, frequent, matching, partners, tiers

TECHNIQUES = (
    "execution_accuracy", "exact_column_and_exact_cell", "exact_column_and_partial_cell", "semantic_column_and_exact_cell",
    "semantic_column_and_partial_cell", "no_column_and_partial_cell", "unified_column_and_semantic_row",
)
#: Pairs of rows of which the driver may solve an assignment.
PAIRS = 1_000_000
#: Least similarity of semantically matched columns.
SIMILAR = 0.7
SCORES = "ex int, exp double, exr double, f1 double, matched long, gold_cells long, pred_cells long"


def scored(counts: DataFrame, *keep: str) -> DataFrame:
    """Scores from ``(ex, matched, gold_cells, pred_cells)``: precision, recall and F1 of cells; columns to ``keep`` come along.

    An EX of 1 makes all of them 1.  Two empty results score 1; against an empty gold result
    precision is 0 and recall 1, for an empty prediction the other way round, and F1 is 0.
    """
    m, g, p = F.col("matched"), F.col("gold_cells"), F.col("pred_cells")
    one, both = F.col("ex") == 1, (g == 0) & (p == 0)
    # divisions are kept from zero, as strict SQL raises
    exp = F.when(one | both, 1.0).when(g == 0, 0.0).when(p == 0, 1.0).otherwise(m / F.greatest(p, F.lit(1)))
    exr = F.when(one | both, 1.0).when(g == 0, 1.0).when(p == 0, 0.0).otherwise(m / F.greatest(g, F.lit(1)))
    f1 = F.when(one | both, 1.0).when((g == 0) | (p == 0) | (m == 0), 0.0).otherwise(2.0 * m / F.greatest(g + p, F.lit(1)))
    return counts.select(*keep, F.col("ex").cast("int").alias("ex"), exp.alias("exp"), exr.alias("exr"), f1.alias("f1"),
                         m.cast("long").alias("matched"), g.cast("long").alias("gold_cells"), p.cast("long").alias("pred_cells"))


def _ex(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row with EX: whether both have the same set of rows, whatever their names, order and repeats."""
    if len(gold.columns) != len(pred.columns):
        return gold.sparkSession.range(1).select(F.lit(0).alias("ex"))
    t = matching.tally(gold, pred, cells.cells(gold), cells.cells(pred))
    return t.agg(F.coalesce(F.bool_and((F.col("g") > 0) == (F.col("p") > 0)), F.lit(True)).cast("int").alias("ex"))


def _pairs(gold: DataFrame, pred: DataFrame) -> list[tuple[int, int]]:
    """Places of the columns that both have by name, in order of the names."""
    names = sorted(set(gold.columns) & set(pred.columns))
    return [(gold.columns.index(n), pred.columns.index(n)) for n in names]


def _rows(gold: DataFrame, pred: DataFrame) -> DataFrame:
    count = lambda d, n: d.agg(F.count("*").alias(n))
    return count(gold, "rows_g").crossJoin(count(pred, "rows_p"))  # one row each


def _by_columns(gold: DataFrame, pred: DataFrame, pairs: list[tuple[int, int]], penalize: bool, partial: bool) -> DataFrame:
    """Scores with the given pairs of columns: exact rows as bags, then (partial) the rest greedily by equal cells."""
    wide = len(pred.columns) if penalize else len(pairs)
    if not pairs:
        zero = _rows(gold, pred).select(F.lit(0).alias("matched"), (F.col("rows_g") * len(gold.columns)).alias("gold_cells"), (F.col("rows_p") * len(pred.columns)).alias("pred_cells"))
        s = scored(_ex(gold, pred).crossJoin(zero))
        return s.select("ex", *[F.when(F.col("ex") == 1, 1.0).otherwise(0.0).alias(c) for c in ("exp", "exr", "f1")], "matched", "gold_cells", "pred_cells")
    t = matching.tally(gold, pred, cells.cells(gold, [a for a, _ in pairs]), cells.cells(pred, [b for _, b in pairs]))
    whole = t.agg(
        F.coalesce(F.sum(F.least("g", "p")) * len(pairs), F.lit(0)).alias("matched"),
        F.coalesce(F.sum("g") * len(gold.columns), F.lit(0)).alias("gold_cells"), F.coalesce(F.sum("p") * wide, F.lit(0)).alias("pred_cells"))
    if partial:
        both = F.least("g", "p")
        rest = t.select("key", (F.col("g") - both).alias("g"), (F.col("p") - both).alias("p")).where("g > 0 or p > 0")
        more = tiers.gained(rest).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("more"))
        whole = whole.crossJoin(more).select((F.col("matched") + F.col("more")).alias("matched"), "gold_cells", "pred_cells")
    return scored(_ex(gold, pred).crossJoin(whole))


def execution_accuracy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """EX alone; the other scores equal it."""
    e = F.col("ex")
    return _ex(gold, pred).select(e.cast("int").alias("ex"), *[e.cast("double").alias(c) for c in ("exp", "exr", "f1")],
                                  *[F.lit(None).cast("long").alias(c) for c in ("matched", "gold_cells", "pred_cells")])


def exact_column_and_exact_cell(gold: DataFrame, pred: DataFrame, penalize_extra_pred_cols: bool = True) -> DataFrame:
    """Columns by name, rows as bags."""
    gold, pred = cells.unique_names(gold), cells.unique_names(pred)
    return _by_columns(gold, pred, _pairs(gold, pred), penalize_extra_pred_cols, False)


def exact_column_and_partial_cell(gold: DataFrame, pred: DataFrame, penalize_extra_pred_cols: bool = True) -> DataFrame:
    """Columns by name, rows as bags and then greedily by equal cells."""
    gold, pred = cells.unique_names(gold), cells.unique_names(pred)
    return _by_columns(gold, pred, _pairs(gold, pred), penalize_extra_pred_cols, True)


def column_profile(df: DataFrame, top: int = 10) -> DataFrame:
    """``(column_name, data_type, value, n, rank)``: the most frequent values of each column without nulls, ties by value."""
    kind = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return frequent.commonest(df, top).select("column_name", kind[F.col("column_name")].alias("data_type"), "value", "n", "rank")


def column_texts(df: DataFrame) -> list[str]:
    """A text for each column: its name, type and commonest values."""
    found: dict = {}
    for r in column_profile(df).orderBy("column_name", "rank").collect():  # ten rows a column
        found.setdefault(r["column_name"], []).append(r["value"])
    return [f"Column name: {c} Data type: {t} Sample values: {', '.join(found.get(c, []))}" for c, t in df.dtypes]


def semantic_pairs(gold: DataFrame, pred: DataFrame, provider: embed.Provider = embed.hashed_ngrams) -> list[tuple[int, int]]:
    """Pairs of columns by the best assignment of their texts' similarities, those above SIMILAR, by gold place."""
    if not gold.columns or not pred.columns:
        return []
    sims = embed.similarities(provider(column_texts(gold)), provider(column_texts(pred)))
    return [(g, p) for g, p in embed.assignment(sims) if sims[g, p] > SIMILAR]


def semantic_column_and_exact_cell(gold: DataFrame, pred: DataFrame, penalize_extra_pred_cols: bool = True, provider: embed.Provider = embed.hashed_ngrams) -> DataFrame:
    """Columns by meaning, rows as bags of the matched columns in one order."""
    gold, pred = cells.unique_names(gold), cells.unique_names(pred)
    return _by_columns(gold, pred, semantic_pairs(gold, pred, provider), penalize_extra_pred_cols, False)


def semantic_column_and_partial_cell(gold: DataFrame, pred: DataFrame, penalize_extra_pred_cols: bool = True, provider: embed.Provider = embed.hashed_ngrams) -> DataFrame:
    """Columns by meaning, rows as bags and then greedily by equal cells."""
    gold, pred = cells.unique_names(gold), cells.unique_names(pred)
    return _by_columns(gold, pred, semantic_pairs(gold, pred, provider), penalize_extra_pred_cols, True)


def no_column_and_partial_cell(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Rows as sets of cells: equal sets as bags, then the rest greedily by Jaccard index."""
    gold, pred = cells.unique_names(gold), cells.unique_names(pred)
    t = matching.tally(gold, pred, cells.tokens(gold), cells.tokens(pred))
    size, both = F.size("key"), F.least("g", "p")
    whole = t.agg(*[F.coalesce(F.sum(size * F.col(c) if isinstance(c, str) else size * c), F.lit(0)).alias(n) for c, n in ((both, "matched"), ("g", "gold_cells"), ("p", "pred_cells"))])
    rest = t.select("key", (F.col("g") - both).alias("g"), (F.col("p") - both).alias("p")).where("g > 0 or p > 0")
    more = tiers.gained(rest, by_tokens=True).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("more"))
    whole = whole.crossJoin(more).select((F.col("matched") + F.col("more")).alias("matched"), "gold_cells", "pred_cells")
    return scored(_ex(gold, pred).crossJoin(whole))


def unified_column_and_semantic_row(gold: DataFrame, pred: DataFrame, provider: embed.Provider = embed.hashed_ngrams) -> DataFrame:
    """Rows, padded to all columns of both, by the best assignment of their texts' similarities.

    Each similarity (1 for equal texts) counts by the share of gold columns that the prediction has.
    Up to PAIRS pairs the driver solves the assignment.  Beyond, rows take their best partners, found on the executors, which is the best
    assignment if none is disputed; if one is, ValueError is raised.
    """
    gold, pred = cells.unique_names(gold), cells.unique_names(pred)
    spark, names = gold.sparkSession, sorted(set(gold.columns) | set(pred.columns))
    share = 1.0 if len(gold.columns) <= 1 else len(set(gold.columns) & set(pred.columns)) / len(gold.columns)
    texts = [d.select(cells.padded_row(d, names).alias("text")) for d in (gold, pred)]
    n_gold, n_pred = (t.count() for t in texts)
    total = 0.0
    if n_gold * n_pred > PAIRS:
        found = partners.undisputed(*texts, provider)
        if found is None:
            raise ValueError(f"{n_gold} x {n_pred} pairs of rows are more than {PAIRS}, and rows dispute their best partners")
        total = found * share
    elif n_gold and n_pred:
        a, b = (sorted(r[0] for r in t.collect()) for t in texts)  # bounded by the check above
        sims = embed.similarities(provider(a), provider(b))
        sims[[[x == y for y in b] for x in a]] = 1.0
        total = sum(float(sims[i, j]) for i, j in embed.assignment(sims)) * share
    exp, exr = (1.0, 1.0) if not n_gold and not n_pred else (total / n_pred if n_pred else 0.0, total / n_gold if n_gold else 0.0)
    if (not n_gold) != (not n_pred):
        exp = exr = 0.0
    f1 = 2 * exp * exr / (exp + exr) if exp + exr else 0.0
    row = spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in (("exp", exp), ("exr", exr), ("f1", f1))])
    one = F.col("ex") == 1
    return _ex(gold, pred).crossJoin(row).select("ex", *[F.when(one, 1.0).otherwise(F.col(c)).alias(c) for c in ("exp", "exr", "f1")],
                                                 *[F.lit(None).cast("long").alias(c) for c in ("matched", "gold_cells", "pred_cells")])


def evaluate(spark: SparkSession, gold_sql: str, pred_sql: str, technique: str, **options) -> DataFrame:
    """Scores of a predicted query against a gold one, with ``error`` null, or zeros and the message if either can't be analysed or run."""
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown technique {technique}")
    try:
        gold, pred = early.result(spark, gold_sql), early.result(spark, pred_sql)
        return globals()[technique](gold, pred, **options).withColumn("error", F.lit(None).cast("string"))
    except Exception as e:  # whatever a query may raise is a result here
        return failed(spark, str(e).splitlines()[0][:500])


def failed(spark: SparkSession, message: str) -> DataFrame:
    nothing = [F.lit(0).alias("ex"), *[F.lit(0.0).alias(c) for c in ("exp", "exr", "f1")], *[F.lit(None).cast("long").alias(c) for c in ("matched", "gold_cells", "pred_cells")]]
    return spark.range(1).select(*nothing, F.lit(message).alias("error"))


def evaluate_cases(spark: SparkSession, cases: list[tuple[str, str, str]], technique: str, **options) -> DataFrame:
    """One row of scores for each (case_id, gold_sql, pred_sql), with a status; see ``evaluation.scores``."""
    from plumbline.operators import evaluation

    if not cases:
        raise ValueError("no cases")
    return evaluation.scores(spark, cases, technique, **options)
