"""Reports over scores: each is one aggregation, with totals by window where a share is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators.graph import cut

METRICS = ("EXP", "EXR", "F1")


def rounded(c: Column, digits: int) -> Column:
    """A mean to some digits, halves up, without what the order of adding leaves in the last binary digits."""
    return F.round(F.round(c, 9).cast("decimal(20,9)"), digits).cast("double")


def _share(by=None, n: str = "n") -> Column:
    """A count's share of the total of already counted rows, in percent."""
    return F.col(n) * 100.0 / F.sum(n).over(by or W.partitionBy())


def operator_means(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean scores by operator (and technique), nulls and NaN left out, 0 where nothing is left; two decimals."""
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    return scores.groupBy(*(by or ["operator"])).agg(F.count("*").alias("n"), *[rounded(F.coalesce(F.avg(real(c)), F.lit(0.0)), 2).alias(c) for c in METRICS])


def operator_deltas(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Mean scores of two techniques by operator side by side, and their differences."""
    wide = operator_means(scores.where(F.col("technique").isin(a, b)), ["operator", "technique"]).groupBy("operator").pivot("technique", [a, b]).agg(*[F.first(c).alias(c) for c in METRICS])
    return wide.select("operator", *[F.col(f"{t}_{c}") for t in (a, b) for c in METRICS], *[F.round(F.col(f"{b}_{c}") - F.col(f"{a}_{c}"), 2).alias(f"delta_{c}") for c in METRICS])


def error_count_stats(scores: DataFrame) -> DataFrame:
    """Mean, deviation, least and most of each score by number of errors."""
    return scores.groupBy("error_count").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("percent", _share())


def common_failures(scores: DataFrame, systems: int) -> DataFrame:
    """Questions that every system answered, all of them wrong."""
    return scores.groupBy("question_id").agg(F.count_distinct("system").alias("_s"), F.max("EX").alias("_e")).where((F.col("_s") == systems) & (F.col("_e") == 0)).select("question_id")


def system_averages(scores: DataFrame, systems: int) -> DataFrame:
    """Scores in percent with their distance to 100, and latency, by system: over all rows, its own failures, and common failures.

    Each row meets the common failures once and is then counted for the subsets it is in.
    """
    shared = common_failures(scores, systems).withColumn("_c", F.lit(True))
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("EX") == 0, "own_failures"), F.when(F.col("_c"), "common_failures")))
    rows = scores.join(shared, "question_id", "left").withColumn("subset", F.explode(subsets))
    mean = lambda c: rounded(F.avg(c) * 100, 1)
    return rows.groupBy("system", "subset").agg(
        F.count("*").alias("n"), *[mean(c).alias(c) for c in METRICS], *[F.round(100 - mean(c), 1).alias(f"gap_{c}") for c in METRICS],
        F.avg("latency").alias("latency_mean"), F.stddev_samp("latency").alias("latency_std"))


def ex_by_question(scores: DataFrame, systems: list[str]) -> DataFrame:
    """EX of each system by question (mean of repeats, -1 if it has none), and how many were right and wrong."""
    wide = scores.groupBy("question_id").pivot("system", systems).agg(F.avg("EX"))
    count = lambda v: sum((F.coalesce((F.col(f"`{s}`") == v).cast("int"), F.lit(0)) for s in systems), F.lit(0))
    return wide.withColumns({"n_correct": count(1), "n_failed": count(0)}).fillna(-1.0, systems)


def venn_counts(scores: DataFrame, systems: list[str]) -> DataFrame:
    """How many questions were right for exactly which systems."""
    flags = [F.coalesce(F.max(F.when(F.col("system") == s, F.col("EX"))), F.lit(0)).alias(s) for s in systems]
    return scores.groupBy("question_id").agg(*flags).groupBy(*[f"`{s}`" for s in systems]).agg(F.count("*").alias("n"))


def overlap(scores: DataFrame, systems: int) -> DataFrame:
    """Questions that all systems got right."""
    return scores.where("EX = 1").groupBy("question_id").agg(F.count_distinct("system").alias("_s")).where(F.col("_s") == systems).select("question_id")


def delta_ex(pairs: DataFrame) -> DataFrame:
    """Counts and shares of (EX before, EX after) and their difference."""
    d = pairs.groupBy("ex_before", "ex_after").agg(F.count("*").alias("n"))
    return d.withColumns({"delta": F.col("ex_after") - F.col("ex_before"), "percent": _share()})


def transitions(pairs: DataFrame) -> DataFrame:
    """EX transitions by number of joins, and over all (null): one rollup for both reports."""
    n = pairs.groupBy("n_join", "ex_before", "ex_after").agg(F.count("*").alias("c"))
    sets = n.rollup("n_join").agg(
        *[F.coalesce(F.sum(F.when((F.col("ex_before") == a) & (F.col("ex_after") == b), F.col("c"))), F.lit(0)).alias(f"n_{a}_{b}") for a in (0, 1) for b in (0, 1)])
    return sets.withColumn("net", F.col("n_0_1") - F.col("n_1_0"))


def accuracy_by(scores: DataFrame, key: str) -> DataFrame:
    """Mean EX in percent by some column."""
    return scores.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(rounded(F.avg("EX") * 100, 2), F.lit(0.0)).alias("accuracy"))


def joined_accuracies(maps: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Accuracies of several sets by a key side by side, 0 where a set has none."""
    out = None
    for name, m in maps:
        part = m.select(key, F.col("accuracy").alias(name))
        out = part if out is None else out.join(part, key, "full")
    return out.fillna(0.0)


def pair_gaps(scores: DataFrame, least: float, most: float) -> DataFrame:
    """Pairs of systems whose precision and recall on a question both failed differ by so much."""
    f = scores.where("EX = 0").select("question_id", "system", "EXP", "EXR")
    a, b = (f.select("question_id", *[F.col(c).alias(f"{c}_{s}") for c in ("system", "EXP", "EXR")]) for s in "ab")
    gap = lambda c: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))
    return a.join(b, "question_id").where((F.col("system_a") < F.col("system_b")) & gap("EXP").between(least, most) & gap("EXR").between(least, most))


def structure_groups(structure: DataFrame) -> DataFrame:
    """Queries by (nodes, edges, conditions, projections): totals, clause counts, average cycles, and databases with their counts."""
    key = ["num_nodes", "num_edges", "num_conditions", "num_projections"]
    per_db = structure.groupBy(*key, "db_id").agg(
        F.count("*").alias("n"), *[F.sum(F.col(c).cast("int")).alias(c) for c in ("is_cyclic", "has_group_by", "has_having", "has_aggregation")], F.sum("num_cycles").alias("cycles"))
    dbs = F.array_join(F.array_sort(F.collect_list(F.concat(F.col("db_id"), F.lit("("), F.col("n").cast("string"), F.lit(")")))), ", ")
    return per_db.groupBy(*key).agg(
        F.sum("n").alias("total"), F.sum("is_cyclic").alias("cyclic"), (F.sum("n") - F.sum("is_cyclic")).alias("acyclic"), (F.sum("cycles") / F.sum("n")).alias("avg_cycles"),
        F.sum("has_group_by").alias("group_by"), F.sum("has_having").alias("having"), F.sum("has_aggregation").alias("aggregation"), dbs.alias("dbs"))


def column_frequencies(used: DataFrame, queries: int | None = None) -> DataFrame:
    """How many queries project and filter each column; ``used``: (question_id, db_id, table_name, column_name, role)."""
    n = used.groupBy("db_id", "table_name", "column_name").agg(
        F.count_distinct(F.when(F.col("role") == "projection", F.col("question_id"))).alias("projection_occurrences"),
        F.count_distinct(F.when(F.col("role") == "filter", F.col("question_id"))).alias("filtering_occurrences"))
    return n


def top_columns(frequencies: DataFrame, occurrences: str, n: int, without: DataFrame | None = None) -> DataFrame:
    """The ``n`` most used columns of each database, ties by name, leaving out those that ``without`` has."""
    w = W.partitionBy("db_id").orderBy(F.desc(occurrences), "table_name", "column_name")
    left = frequencies.where(F.col(occurrences) > 0)
    if without is not None:
        left = left.join(without.select("db_id", "table_name", "column_name"), ["db_id", "table_name", "column_name"], "left_anti")
    return left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def naturalness(names: DataFrame) -> DataFrame:
    """Counts and shares of naturalness classes for tables (each once), columns and both."""
    tables = names.dropDuplicates(["dataset", "db_id", "table_name"]).select(F.lit("tables").alias("scope"), F.col("table_naturalness").alias("class"))
    columns = names.select(F.lit("columns").alias("scope"), F.col("column_naturalness").alias("class"))
    n = tables.unionAll(columns).groupBy("scope", "class").agg(F.count("*").alias("n"))
    both = n.groupBy("class").agg(F.sum("n").alias("n")).select(F.lit("combined").alias("scope"), "class", "n")
    return n.unionByName(both).withColumn("percent", _share(W.partitionBy("scope")))


def agreement(df: DataFrame) -> DataFrame:
    """Means of automatic and human verdicts and how many differ, nulls counting as a value."""
    return df.agg(F.avg("automatic").alias("mean_automatic"), F.avg("human").alias("mean_human"), F.count_if(~F.col("automatic").eqNullSafe(F.col("human"))).alias("n_differ"))


def statuses(scores: DataFrame, by: str = "technique") -> DataFrame:
    """Successes, timeouts and errors, and mean and deviation (of the population) of F1, by technique."""
    return scores.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "timeout", "error")], F.avg("F1").alias("f1_mean"), F.stddev_pop("F1").alias("f1_std"))


def percentiles(df: DataFrame, column: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``(*by, *shares)``: exact percentiles between neighbouring values, without a group's values in one task.

    Equal values are counted first, and the counts sorted into ranges, whatever their group.  Sums by (group, range), a row
    for each, tell which range has a rank; only that range is then counted through.  A group without values
    has nulls; NaN is the largest value.
    """
    group, names = F.struct(*by).alias("k"), list(shares)
    counts = df.groupBy(group, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = cut(counts.orderBy("k", "v").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    parts = counts.where("v IS NOT NULL").groupBy("k", "part").agg(F.sum("n").alias("n"))
    parts = parts.withColumns({"before": F.sum("n").over(W.partitionBy("k").orderBy("part")) - F.col("n"), "total": F.sum("n").over(W.partitionBy("k"))})
    at = F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("total") - 1) * F.lit(float(q))).alias("pos")) for n, q in shares.items()])
    ranks = parts.select("k", "part", "before", "n", F.explode(at).alias("x")).select("k", "part", "before", "n", "x.*")
    ranks = ranks.select("k", "part", "before", "n", "name", "pos", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank")).where("rank >= before AND rank < before + n").drop("n").distinct()
    inner = counts.where("v IS NOT NULL").join(ranks.select("k", "part").distinct(), ["k", "part"], "left_semi")
    inner = inner.withColumn("upto", F.sum("n").over(W.partitionBy("k", "part").orderBy("v")))
    found = ranks.join(inner, ["k", "part"]).where("rank >= before + upto - n AND rank < before + upto")
    weight = F.when(F.floor("pos") == F.ceil("pos"), 1.0).when(F.col("rank") == F.floor("pos"), F.ceil("pos") - F.col("pos")).otherwise(F.col("pos") - F.floor("pos"))
    values = found.groupBy("k", "name").agg(F.sum(weight * F.col("v")).alias("value")).groupBy("k").pivot("name", names).agg(F.first("value"))
    return counts.select("k").distinct().join(values, "k", "left").select("k.*", *names)


def five_numbers(df: DataFrame, column: str, by: str) -> DataFrame:
    """Least, quartiles and most, as box plots show."""
    return percentiles(df, column, [by], {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """Rows by bin of equal width; the top edge belongs to the last bin."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.where(F.col(column).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def long_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores one to a row; fractions become percent."""
    long = scores.select(*keys, *[F.col(c).cast("double").alias(c) for c in METRICS]).unpivot(keys, list(METRICS), "metric", "value")
    return long.withColumn("value", F.when(F.col("value") <= 1, F.col("value") * 100).otherwise(F.col("value")))


def patched(scores: DataFrame) -> DataFrame:
    """Scores with precision, recall and F1 set to 1 where EX is."""
    return scores.withColumns({c: F.when(F.col("EX") == 1, 1.0).otherwise(F.col(c)) for c in METRICS})


def chains(mutants: DataFrame, depth: int) -> DataFrame:
    """Mutants of the full depth whose every prefix of operators is a mutant of the same question too, with the pattern they make."""
    full = mutants.where(F.col("depth") == depth)
    for k in range(1, depth):
        part = mutants.where(F.col("depth") == k).select("question_id", F.col("operators").alias("_p")).distinct()
        full = full.join(part, (full["question_id"] == part["question_id"]) & (F.slice(F.col("operators"), 1, k) == F.col("_p")), "left_semi")
    return full.withColumn("error_pattern", F.array_join("operators", " → "))


def shares_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """How a value is distributed within each group, as fractions."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") * 1.0 / F.sum("n").over(W.partitionBy(group)))


def benchmark_summary(graphs: DataFrame, by: str = "benchmark") -> DataFrame:
    """Graphs of each benchmark: share connected and with cycles, degrees, average diameter."""
    return graphs.groupBy(by).agg(
        F.count("*").alias("n"), F.avg((F.col("n_components") == 1).cast("double")).alias("connected_share"), F.avg((F.col("n_cycles") > 0).cast("double")).alias("cyclic_share"),
        F.avg("avg_degree").alias("degree_mean"), F.stddev_samp("avg_degree").alias("degree_std"), F.min("avg_degree").alias("degree_min"), F.max("avg_degree").alias("degree_max"),
        F.avg("diameter").alias("diameter_mean"))


def degree_changes(pairs: DataFrame) -> DataFrame:
    """Pairs of (original, extended) average degrees by their difference, with each one's share."""
    n = pairs.groupBy(F.round(F.col("degree_after") - F.col("degree_before"), 4).alias("delta"), "degree_before", "degree_after").agg(F.count("*").alias("n"))
    return n.withColumn("percent", _share())


def hiding_average(scores: DataFrame, column: str = "score") -> DataFrame:
    """The mean of what was scored; null if nothing was."""
    return scores.agg(F.avg(column).alias("mean"), F.count(column).alias("n"))


def two_ex(cases: DataFrame) -> DataFrame:
    """EX before and after as numbers: missing SQL is null, a timeout or error is 0; and their difference."""
    ex = lambda c: F.when(F.col(c).isNull() | (F.col(c) == "missing"), None).when(F.col(c).isin("timeout", "error"), 0).otherwise(F.col(c).try_cast("int"))
    return cases.withColumns({"ex_before": ex("before"), "ex_after": ex("after")}).withColumn("delta", F.col("ex_after") - F.col("ex_before"))


def top_databases(df: DataFrame, scenario: Column, n: int = 5) -> DataFrame:
    """The ``n`` databases with most rows in a scenario, of equals the first by name."""
    return df.where(scenario).groupBy("db_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "db_id").limit(n)


def disjoint_patterns(mutants: DataFrame, n: int) -> DataFrame:
    """``(error_pattern, n, rank)``: the commonest patterns that share no operator with one already taken, ``n`` at most.

    Patterns are as many as combinations of operators, so they are picked on the driver."""
    counted = mutants.groupBy("error_pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_pattern").collect()
    taken: list = []
    used: set = set()
    for r in counted:
        operators = set(r["error_pattern"].split(" → "))
        if len(taken) < n and not operators & used:
            used |= operators
            taken.append((r["error_pattern"], r["n"], len(taken) + 1))
    return mutants.sparkSession.createDataFrame(taken, "error_pattern string, n long, rank int")


def degree_by_set(graphs: DataFrame, by: str = "set") -> DataFrame:
    """Mean average degree of each set of graphs (original, augmented, pruned, generated), and of all."""
    return graphs.rollup(by).agg(F.count("*").alias("n"), F.avg("avg_degree").alias("avg_degree"))


def ex_tuples(df: DataFrame, flag: str) -> DataFrame:
    """How (delta, EX) are distributed by a flag and system, with each one's share in percent."""
    n = df.groupBy(flag, "system", "delta", "EX").agg(F.count("*").alias("n"))
    return n.withColumn("percent", _share(W.partitionBy(flag, "system")))


def rename_statistics(rows: DataFrame) -> DataFrame:
    """Renamings or validations of each database by their status (ok, failed, timeout, error), with the share that is ok."""
    return rows.groupBy("db_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "failed", "timeout", "error")],
                                     F.avg((F.col("status") == "ok").cast("double") * 100).alias("percent_ok"))


def by_sql(left: DataFrame, right: DataFrame, column: str = "sql") -> DataFrame:
    """``left`` with the other columns of the row of ``right`` whose query reads the same (of several the first by all columns)."""
    from plumbline.functions.text import normalised_sql

    others = [c for c in right.columns if c != column]
    one = right.groupBy(normalised_sql(F.col(column)).alias("_sql")).agg(F.min(F.struct(*others)).alias("_x")).select("_sql", *[F.col("_x")[c].alias(c) for c in others])
    return left.withColumn("_sql", normalised_sql(F.col(column))).join(one, "_sql", "left").drop("_sql")


def with_originals(scores: DataFrame, originals: DataFrame, column: str = "EX") -> DataFrame:
    """``scores`` with the original's ``column`` on (question_id, db_id) as ``original_...``, and whether there was one."""
    known = originals.select("question_id", "db_id", F.col(column).alias(f"original_{column}"), F.lit(True).alias("found"))
    return scores.join(known, ["question_id", "db_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def by_system(queries: DataFrame, scores: DataFrame, systems: list[str]) -> DataFrame:
    """``queries`` with each system's EX on (question_id, db_id), null where it has none: one aggregation, one join."""
    wide = scores.groupBy("question_id", "db_id").pivot("system", systems).agg(F.max("EX"))
    return queries.join(wide, ["question_id", "db_id"], "left")


def table_text(df: DataFrame, limit: int = 1000) -> str:
    """A report of up to ``limit`` rows as text, in columns."""
    rows = [df.columns, *[["" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(limit).collect()]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in wide), *lines[1:]])
