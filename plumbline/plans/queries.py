"""The registered queries over the test tables, each beside the SQL that DuckDB checks it with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import expansion, graph, linking, matching, mutation, naturalness, partners, rename, reports, sampling, similar, techniques, words
from plumbline.plans import star
from plumbline.plans.queryspec import columns_of, is_nested, parse, structure
from plumbline.plans.register import ORACLES, QUERIES, query  # noqa: F401  what the driver reads

# ---- result-set metrics

#: (case, gold query, its columns, predicted query, its columns); both engines read them.
CASES = [
    ("identical", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "l_returnflag l_linestatus n",
     "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "l_returnflag l_linestatus n"),
    ("predicate_lost", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'", "o_orderkey o_orderpriority", "SELECT o_orderkey, o_orderpriority FROM orders", "o_orderkey o_orderpriority"),
    ("rows_missing", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem", "l_orderkey l_linenumber l_quantity",
     "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10", "l_orderkey l_linenumber l_quantity"),
    ("columns_swapped", "SELECT n_name, n_regionkey FROM nation", "n_name n_regionkey", "SELECT n_regionkey, n_name FROM nation", "n_regionkey n_name"),
    ("column_renamed", "SELECT n_name, n_regionkey FROM nation", "n_name n_regionkey", "SELECT n_name, n_regionkey AS r FROM nation", "n_name r"),
    ("column_extra", "SELECT c_custkey FROM customer", "c_custkey", "SELECT c_custkey, c_mktsegment FROM customer", "c_custkey c_mktsegment"),
    ("column_missing", "SELECT c_custkey, c_mktsegment FROM customer", "c_custkey c_mktsegment", "SELECT c_custkey FROM customer", "c_custkey"),
    ("repeats", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "l_returnflag l_linestatus", "SELECT l_returnflag, l_linestatus FROM lineitem", "l_returnflag l_linestatus"),
    ("gold_empty", "SELECT p_brand FROM part WHERE p_size < 0", "p_brand", "SELECT p_brand FROM part", "p_brand"),
    ("pred_empty", "SELECT p_brand FROM part", "p_brand", "SELECT p_brand FROM part WHERE p_size < 0", "p_brand"),
    ("both_empty", "SELECT p_brand FROM part WHERE p_size < 0", "p_brand", "SELECT p_brand FROM part WHERE p_size < -1", "p_brand"),
    ("nothing_shared", "SELECT p_brand FROM part", "p_brand", "SELECT s_name FROM supplier", "s_name"),
    ("nulls", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS s FROM orders", "o_orderkey s",
     "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS s FROM orders", "o_orderkey s"),
]
EMPTY = [c for c in CASES if c[0].endswith("empty") or c[0] == "identical"]
_SCORE = """CASE WHEN ex = 1 OR g + p = 0 THEN 1.0::DOUBLE WHEN {zero} THEN 0.0 WHEN g = 0 THEN 0.0 WHEN p = 0 THEN 1.0 ELSE m * 1.0::DOUBLE / p END AS exp,
       CASE WHEN ex = 1 OR g + p = 0 THEN 1.0::DOUBLE WHEN {zero} THEN 0.0 WHEN g = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE m * 1.0::DOUBLE / g END AS exr,
       CASE WHEN ex = 1 OR g + p = 0 THEN 1.0::DOUBLE WHEN {zero} OR g = 0 OR p = 0 OR m = 0 THEN 0.0 ELSE 2.0::DOUBLE * m / (g + p) END AS f1"""


def _ex_sql(gold: str, pred: str, same_width: bool) -> str:
    return f"(CASE WHEN NOT EXISTS (({gold}) EXCEPT ({pred})) AND NOT EXISTS (({pred}) EXCEPT ({gold})) THEN 1 ELSE 0 END)" if same_width else "0"


def _ex_suite_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS case_id, {_ex_sql(g, p, len(a.split()) == len(b.split()))} AS ex" for k, g, a, p, b in CASES)


def _exact_sql(penalize: bool, cases: list | None = None) -> str:
    out = []
    for k, g, a, p, b in cases or CASES:
        ga, pb = a.split(), b.split()
        shared = sorted(set(ga) & set(pb))
        cols = ", ".join(shared)
        matched = f"(SELECT count(*) * {len(shared)} FROM ((SELECT {cols} FROM ({g})) INTERSECT ALL (SELECT {cols} FROM ({p}))))" if shared else "0"
        wide = len(pb) if penalize or not shared else len(shared)
        inner = f"SELECT {_ex_sql(g, p, len(ga) == len(pb))} AS ex, {matched} AS m, (SELECT count(*) * {len(ga)} FROM ({g})) AS g, (SELECT count(*) * {wide} FROM ({p})) AS p"
        out.append(f"SELECT '{k}' AS case_id, ex, {_SCORE.format(zero='false' if shared else 'true')} FROM ({inner})")
    return " UNION ALL ".join(out)


def _ok(sql: str) -> str:
    """The same with the status that every case must have."""
    return f"SELECT *, 'ok' AS status FROM ({sql})"


def _suite(spark: SparkSession, technique: str, cases=None, **options) -> DataFrame:
    return techniques.evaluate_cases(spark, [(k, g, p) for k, g, _, p, _ in cases or CASES], technique, **options)


@query(_ok(_exact_sql(True)))
def metric_exact_exact(spark: SparkSession) -> DataFrame:
    return _suite(spark, "exact_column_and_exact_cell").select("case_id", "status", "ex", "exp", "exr", "f1")


@query(_ok(_exact_sql(False)))
def metric_exact_exact_unpenalised(spark: SparkSession) -> DataFrame:
    return _suite(spark, "exact_column_and_exact_cell", penalize_extra_pred_cols=False).select("case_id", "status", "ex", "exp", "exr", "f1")


@query(_ok(_ex_suite_sql()))
def metric_ex_suite(spark: SparkSession) -> DataFrame:
    return _suite(spark, "execution_accuracy").select("case_id", "status", "ex")


#: Pairs whose rows match in part; all cells are text or whole numbers and all rows distinct.
PARTIAL = [
    ("names", "SELECT n_nationkey, n_name, n_regionkey FROM nation", "n_nationkey n_name n_regionkey", "SELECT n_nationkey + 1 AS n_nationkey, n_name, n_regionkey FROM nation", "n_nationkey n_name n_regionkey"),
    ("keys", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 15", "n_nationkey n_regionkey",
     "SELECT n_nationkey, n_regionkey + 1 AS n_regionkey FROM nation WHERE n_nationkey > 4", "n_nationkey n_regionkey"),
    ("suppliers", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey <= 20", "s_suppkey s_nationkey", "SELECT s_suppkey + 2 AS s_suppkey, s_nationkey FROM supplier WHERE s_suppkey <= 16", "s_suppkey s_nationkey"),
]


def _greedy_sql(cases: list, tokens: bool) -> str:
    """The sequential loop: edges in order, each taken if both its rows are free."""
    out = []
    for k, g, a, p, b in cases:
        ga, pb = a.split(), b.split()
        shared = sorted(set(ga) & set(pb))
        text_ = {"n_name"}
        cell = lambda c: f"'s:' || {c}" if c in text_ else f"'n:' || {c}"
        row = (lambda cs: "list_sort(list_distinct([" + ", ".join(f"CAST({c} AS VARCHAR)" for c in cs) + "]))") if tokens else (lambda cs: "[" + ", ".join(cell(c) for c in shared) + "]")
        weight = "len(list_intersect(g.k, p.k)) * 1.0::DOUBLE / len(list_distinct(list_concat(g.k, p.k)))" if tokens else "list_sum([CASE WHEN g.k[i] = p.k[i] THEN 1 ELSE 0 END for i in range(1, len(g.k) + 1)])"
        gain = "len(list_intersect(g.k, p.k))" if tokens else weight
        size = (lambda x: f"(SELECT coalesce(sum(len(k)), 0) FROM {x})") if tokens else (lambda x: f"(SELECT count(*) * {len(ga if x == 'gr' else pb)} FROM {x})")
        one = "list_sum([len(x) for x in ks])"
        out.append(f"""(WITH RECURSIVE gr AS (SELECT {row(ga)} AS k FROM ({g})), pr AS (SELECT {row(pb)} AS k FROM ({p})),
          gn AS (SELECT k, row_number() OVER (PARTITION BY k) AS d FROM gr), pn AS (SELECT k, row_number() OVER (PARTITION BY k) AS d FROM pr),
          same AS (SELECT k, d FROM gn INTERSECT SELECT k, d FROM pn),
          g AS (SELECT k, d FROM gn EXCEPT SELECT k, d FROM same), p AS (SELECT k, d FROM pn EXCEPT SELECT k, d FROM same),
          e AS (SELECT row_number() OVER (ORDER BY {weight} DESC, g.k, p.k, g.d, p.d) AS i, g.k AS gk, g.d AS gd, p.k AS pk, p.d AS pd, {gain} AS gain FROM g, p WHERE {gain} > 0),
          r AS (SELECT 0::BIGINT AS i, []::STRUCT(k VARCHAR[], d BIGINT)[] AS ug, []::STRUCT(k VARCHAR[], d BIGINT)[] AS up, 0::BIGINT AS m
                UNION ALL SELECT e.i,
                  CASE WHEN list_contains(ug, {{'k': gk, 'd': gd}}) OR list_contains(up, {{'k': pk, 'd': pd}}) THEN ug ELSE list_append(ug, {{'k': gk, 'd': gd}}) END,
                  CASE WHEN list_contains(ug, {{'k': gk, 'd': gd}}) OR list_contains(up, {{'k': pk, 'd': pd}}) THEN up ELSE list_append(up, {{'k': pk, 'd': pd}}) END,
                  CAST(m + CASE WHEN list_contains(ug, {{'k': gk, 'd': gd}}) OR list_contains(up, {{'k': pk, 'd': pd}}) THEN 0 ELSE gain END AS BIGINT)
                FROM r JOIN e ON e.i = r.i + 1),
          s AS (SELECT {_ex_sql(g, p, len(ga) == len(pb))} AS ex, (SELECT max(m) FROM r) + (SELECT coalesce(sum(len(k)), 0) FROM same) AS m, {size('gr')} AS g, {size('pr')} AS p)
          SELECT '{k}' AS case_id, ex, CAST(m AS BIGINT) AS matched, {_SCORE.format(zero='false')} FROM s)""")
    return " UNION ALL ".join(out)


@query(_ok(_greedy_sql(PARTIAL, False)))
def metric_exact_partial(spark: SparkSession) -> DataFrame:
    return _suite(spark, "exact_column_and_partial_cell", PARTIAL).select("case_id", "status", "ex", "matched", "exp", "exr", "f1")


@query(_ok(_greedy_sql(PARTIAL, True)))
def metric_nocol_partial(spark: SparkSession) -> DataFrame:
    return _suite(spark, "no_column_and_partial_cell", PARTIAL).select("case_id", "status", "ex", "matched", "exp", "exr", "f1")


@query(_ok(_exact_sql(True, PARTIAL)))
def metric_semantic_exact(spark: SparkSession) -> DataFrame:
    """Equal names are nearest in meaning here, so the scores are those of columns by name."""
    return _suite(spark, "semantic_column_and_exact_cell", PARTIAL).select("case_id", "status", "ex", "exp", "exr", "f1")


@query(_ok(_greedy_sql(PARTIAL, False)))
def metric_semantic_partial(spark: SparkSession) -> DataFrame:
    return _suite(spark, "semantic_column_and_partial_cell", PARTIAL).select("case_id", "status", "ex", "matched", "exp", "exr", "f1")


#: Whole tables against copies with other keys, so that only columns of a few values can match: many millions of pairs share a cell.
_WHOLE = {
    "partial": ("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
                "SELECT -1 - o_orderkey AS o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders"),
    "tokens": ("SELECT l_orderkey * 10 + l_linenumber AS line, l_returnflag FROM lineitem",
               "SELECT -1 - l_orderkey * 10 - l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'A' ELSE l_returnflag END AS l_returnflag FROM lineitem"),
}
_PART = {k: (f"SELECT {c} FROM ({g})", f"SELECT {c} FROM ({p})") for k, c in (("partial", "o_orderstatus, o_orderpriority"), ("tokens", "l_returnflag")) for g, p in [_WHOLE[k]]}


@query(f"""SELECT 'orders' AS case_id, 'ok' AS status, 0 AS ex, CAST(m AS BIGINT) AS matched, {_SCORE.format(zero='false')} FROM (SELECT 0 AS ex,
        2 * (SELECT count(*) FROM ({_PART['partial'][0]} INTERSECT ALL {_PART['partial'][1]}))
        + (SELECT count(*) FROM (SELECT o_orderstatus FROM ({_PART['partial'][0]} EXCEPT ALL {_PART['partial'][1]}) INTERSECT ALL SELECT o_orderstatus FROM ({_PART['partial'][1]} EXCEPT ALL {_PART['partial'][0]}))) AS m,
        (SELECT 3 * count(*) FROM orders) AS g, (SELECT 3 * count(*) FROM orders) AS p)""")
def metric_partial_whole_orders(spark: SparkSession) -> DataFrame:
    """Two tiers: status and priority, then the status alone of those whose priority was changed."""
    cases = [("orders", *_WHOLE["partial"])]
    return techniques.evaluate_cases(spark, cases, "exact_column_and_partial_cell").select("case_id", "status", "ex", "matched", "exp", "exr", "f1")


@query(f"""SELECT 'lineitem' AS case_id, 'ok' AS status, 0 AS ex, CAST(m AS BIGINT) AS matched, {_SCORE.format(zero='false')} FROM (SELECT 0 AS ex,
        (SELECT count(*) FROM ({_PART['tokens'][0]} INTERSECT ALL {_PART['tokens'][1]})) AS m, (SELECT 2 * count(*) FROM lineitem) AS g, (SELECT 2 * count(*) FROM lineitem) AS p)""")
def metric_tokens_whole_lineitem(spark: SparkSession) -> DataFrame:
    cases = [("lineitem", *_WHOLE["tokens"])]
    return techniques.evaluate_cases(spark, cases, "no_column_and_partial_cell").select("case_id", "status", "ex", "matched", "exp", "exr", "f1")


#: Pairs whose rows are equal or left over, so that the best assignment is known without similarities.
ROWS = [("same", "n_nationkey >= 0", "n_nationkey >= 0"), ("fewer", "n_nationkey >= 0", "n_nationkey < 10"), ("more", "n_nationkey < 7", "n_nationkey >= 0"), ("gold_empty", "n_nationkey < 0", "n_nationkey < 3"),
        ("pred_empty", "n_nationkey < 3", "n_nationkey < 0"), ("both_empty", "n_nationkey < 0", "n_nationkey < 0")]


@query(" UNION ALL ".join(f"""SELECT '{k}' AS case_id, 'ok' AS status, CASE WHEN g = p THEN 1 ELSE 0 END AS ex, CASE WHEN g = p THEN 1.0::DOUBLE WHEN p = 0 OR g = 0 THEN 0.0 ELSE m / p::DOUBLE END AS exp,
        CASE WHEN g = p THEN 1.0::DOUBLE WHEN p = 0 OR g = 0 THEN 0.0 ELSE m / g::DOUBLE END AS exr FROM (SELECT (SELECT count(*) FROM nation WHERE {a}) AS g, (SELECT count(*) FROM nation WHERE {b}) AS p, (SELECT count(*) FROM nation WHERE {a} AND {b}) AS m)""" for k, a, b in ROWS))
def metric_unified_row(spark: SparkSession) -> DataFrame:
    cases = [(k, f"SELECT n_nationkey, n_name FROM nation WHERE {a}", f"SELECT n_nationkey, n_name FROM nation WHERE {b}") for k, a, b in ROWS]
    return techniques.evaluate_cases(spark, cases, "unified_column_and_semantic_row").select("case_id", "status", "ex", F.round("exp", 9).alias("exp"), F.round("exr", 9).alias("exr"))


@query("""SELECT 'customers' AS case_id, 'ok' AS status, CASE WHEN p = g THEN 1 ELSE 0 END AS ex, 1.0::DOUBLE AS exp, p / g::DOUBLE AS exr
        FROM (SELECT count(*) AS g, count(*) FILTER (c_acctbal > 0) AS p FROM customer)""")
def metric_unified_whole_customer(spark: SparkSession) -> DataFrame:
    """More pairs of rows than one machine should hold, of which every predicted row has an equal one."""
    cases = [("customers", "SELECT c_custkey, c_name, c_mktsegment FROM customer", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0")]
    return techniques.evaluate_cases(spark, cases, "unified_column_and_semantic_row").select("case_id", "status", "ex", F.round("exp", 9).alias("exp"), F.round("exr", 9).alias("exr"))


@query(_ok(_exact_sql(True, EMPTY)))
def metric_empty_rules(spark: SparkSession) -> DataFrame:
    return _suite(spark, "exact_column_and_partial_cell", EMPTY).select("case_id", "status", "ex", "exp", "exr", "f1")


_GRID = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_nationkey, n_name, n_regionkey FROM customer INNER JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey BETWEEN 1 AND 9"
_COLUMNS = "c_custkey c_name c_nationkey c_acctbal c_mktsegment n_nationkey n_name n_regionkey".split()
_GRIDS = [(r, c) for r in range(1, 10) for c in (1, 4, 8)]


@query(f"""WITH t AS (SELECT count(*) AS n FROM ({_GRID})), s(r, c) AS (VALUES {', '.join(map(str, _GRIDS))})
        SELECT 'r' || r || 'c' || c AS case_id, 'ok' AS status, CASE WHEN least(r, n) = n AND c = 8 THEN 1 ELSE 0 END AS ex, 1.0::DOUBLE AS exp, least(r, n) * c / (n * 8.0::DOUBLE) AS exr FROM s, t""")
def shape_sweep(spark: SparkSession) -> DataFrame:
    cases = [(f"r{r}c{c}", _GRID, f"SELECT {', '.join(_COLUMNS[:c])} FROM ({_GRID}) ORDER BY c_custkey LIMIT {r}") for r, c in _GRIDS]
    return techniques.evaluate_cases(spark, cases, "exact_column_and_exact_cell").select("case_id", "status", "ex", "exp", "exr")


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS column_name, v AS value, n, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rank <= 10""" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def column_profile_top10(spark: SparkSession) -> DataFrame:
    return techniques.column_profile(spark.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).select("column_name", "value", "n", "rank")


_LINES = "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus".split()


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS column_name, v AS value, n, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1)) WHERE rank <= 10""" for c in _LINES) + """ UNION ALL SELECT * FROM (SELECT 'month' AS column_name, v AS value, n,
        CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank FROM (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1)) WHERE rank <= 10""")
def commonest_of_lines(spark: SparkSession) -> DataFrame:
    """Keys with ties at the end, columns of a few values, and months in between."""
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("month")
    return techniques.column_profile(spark.table("lineitem").select(*_LINES, month)).select("column_name", "value", "n", "rank")


@query("SELECT l_returnflag, l_quantity FROM lineitem WHERE l_discount > 0.05 INTERSECT ALL SELECT l_returnflag, l_quantity FROM lineitem WHERE l_tax > 0.04")
def bag_intersection(spark: SparkSession) -> DataFrame:
    part = lambda c: spark.table("lineitem").where(c).select("l_returnflag", "l_quantity")
    return matching.bag_intersection(part("l_discount > 0.05"), part("l_tax > 0.04"))


@query("SELECT l_returnflag, l_quantity FROM lineitem WHERE l_discount > 0.05 EXCEPT ALL SELECT l_returnflag, l_quantity FROM lineitem WHERE l_tax > 0.04")
def bag_difference(spark: SparkSession) -> DataFrame:
    part = lambda c: spark.table("lineitem").where(c).select("l_returnflag", "l_quantity")
    return matching.bag_difference(part("l_discount > 0.05"), part("l_tax > 0.04"))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
        s AS (SELECT q, vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS sim FROM q, embeddings WHERE vec_id <> q)
        SELECT q, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def cosine_topk(spark: SparkSession) -> DataFrame:
    e = spark.table("embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))  # the stated queries, against all rows
    return partners.most_similar(asked, e.select("vec_id", "embedding"), 5, 6)


# ---- scores and reports

SCORES = """SELECT event_type AS system, user_id AS question_id, CAST(max(event_id) % 2 AS INT) AS EX, CAST(max(event_id) % 101 AS DOUBLE) / 100 AS EXP,
 CAST(min(event_id) % 101 AS DOUBLE) / 100 AS EXR, CAST((max(event_id) + min(event_id)) % 101 AS DOUBLE) / 100 AS F1, CAST(count(*) AS DOUBLE) AS latency,
 CAST(user_id % 5 AS INT) AS n_join, CAST(user_id % 3 + 1 AS INT) AS error_count,
 CASE user_id % 4 WHEN 0 THEN 'where_remove' WHEN 1 THEN 'join_break' WHEN 2 THEN 'distinct_toggle' ELSE 'projection_drop' END AS operator FROM events GROUP BY event_type, user_id"""
SYSTEMS = ["click", "error", "purchase", "signup", "view"]
_S = f"WITH s AS ({SCORES}) "


def _r(c: str, digits: int) -> str:
    """The SQL of ``reports.rounded``."""
    return f"CAST(round(CAST(round({c}, 9) AS DECIMAL(20, 9)), {digits}) AS DOUBLE)"


_MEANS = ", ".join(f"{_r(f'avg({c})', 2)} AS {c}" for c in ("EXP", "EXR", "F1"))


@query(_S + f"SELECT operator, count(*) AS n, {_MEANS} FROM s GROUP BY operator")
def operator_metric_means(spark: SparkSession) -> DataFrame:
    return reports.operator_means(spark.sql(SCORES))


@query(_S + "SELECT error_count, count(*) AS n, " + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in ("EXP", "EXR", "F1") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM s GROUP BY error_count")
def error_count_stats(spark: SparkSession) -> DataFrame:
    d = reports.error_count_stats(spark.sql(SCORES))
    return d.select("error_count", "n", *[F.round(c, 6).alias(c) for c in d.columns[2:]])


_SUBSETS = "c AS (SELECT question_id FROM s GROUP BY question_id HAVING count(DISTINCT system) = 5 AND max(EX) = 0), u AS (SELECT 'all' AS subset, * FROM s UNION ALL SELECT 'own_failures', * FROM s WHERE EX = 0 UNION ALL SELECT 'common_failures', * FROM s WHERE question_id IN (FROM c)) "


@query(_S + ", " + _SUBSETS + "SELECT system, subset, count(*) AS n, " + ", ".join(f"{_r(f'avg({c}) * 100', 1)} AS {c}, round(100 - {_r(f'avg({c}) * 100', 1)}, 1) AS gap_{c}" for c in ("EXP", "EXR", "F1")) +
       ", round(avg(latency), 6) AS latency_mean, round(stddev_samp(latency), 6) AS latency_std FROM u GROUP BY system, subset")
def system_averages(spark: SparkSession) -> DataFrame:
    d = reports.system_averages(spark.sql(SCORES), len(SYSTEMS))
    return d.withColumns({c: F.round(c, 6) for c in ("latency_mean", "latency_std")})


@query(_S + "SELECT question_id FROM s GROUP BY question_id HAVING count(DISTINCT system) = 5 AND max(EX) = 0")
def common_failures(spark: SparkSession) -> DataFrame:
    return reports.common_failures(spark.sql(SCORES), len(SYSTEMS))


@query(_S + "SELECT " + ", ".join(f"coalesce(max(CASE WHEN system = '{x}' THEN EX END), 0) AS {x}" for x in SYSTEMS) + ", question_id FROM s GROUP BY question_id", "system_flags")
def system_flags(spark: SparkSession) -> DataFrame:
    s = spark.sql(SCORES)
    return s.groupBy("question_id").agg(*[F.coalesce(F.max(F.when(F.col("system") == x, F.col("EX"))), F.lit(0)).alias(x) for x in SYSTEMS])


@query(_S + ", f AS (SELECT " + ", ".join(f"coalesce(max(CASE WHEN system = '{x}' THEN EX END), 0) AS {x}" for x in SYSTEMS[:3]) + " FROM s GROUP BY question_id) SELECT click, error, purchase, count(*) AS n FROM f GROUP BY 1, 2, 3")
def venn_counts(spark: SparkSession) -> DataFrame:
    return reports.venn_counts(spark.sql(SCORES), SYSTEMS[:3])


@query(_S + "SELECT question_id, " + ", ".join(f"coalesce(avg(CASE WHEN system = '{x}' THEN EX END), -1.0::DOUBLE) AS {x}" for x in SYSTEMS) +
       ", CAST(count(*) FILTER (EX = 1) AS INTEGER) AS n_correct, CAST(count(*) FILTER (EX = 0) AS INTEGER) AS n_failed FROM s GROUP BY question_id")
def ex_pivot(spark: SparkSession) -> DataFrame:
    return reports.ex_by_question(spark.sql(SCORES), SYSTEMS)


@query(_S + "SELECT question_id FROM s WHERE EX = 1 GROUP BY question_id HAVING count(DISTINCT system) = 5")
def solved_by_all(spark: SparkSession) -> DataFrame:
    return reports.overlap(spark.sql(SCORES), len(SYSTEMS))


_PAIRS = "p AS (SELECT a.question_id, a.n_join, a.EX AS ex_before, b.EX AS ex_after FROM s a JOIN s b ON a.question_id = b.question_id WHERE a.system = 'view' AND b.system = 'click') "


def _pairs(spark: SparkSession) -> DataFrame:
    s = spark.sql(SCORES)
    a = s.where("system = 'view'").select("question_id", "n_join", F.col("EX").alias("ex_before"))
    return a.join(s.where("system = 'click'").select("question_id", F.col("EX").alias("ex_after")), "question_id")


@query(_S + ", " + _PAIRS + "SELECT ex_before, ex_after, count(*) AS n, ex_after - ex_before AS delta, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM p GROUP BY 1, 2")
def delta_ex(spark: SparkSession) -> DataFrame:
    return reports.delta_ex(_pairs(spark)).withColumn("percent", F.round("percent", 6))


@query(_S + ", " + _PAIRS + ", c AS (SELECT n_join, " + ", ".join(f"count(*) FILTER (ex_before = {a} AND ex_after = {b}) AS n_{a}_{b}" for a in (0, 1) for b in (0, 1)) + " FROM p GROUP BY ROLLUP (n_join)) SELECT *, n_0_1 - n_1_0 AS net FROM c")
def ex_transitions(spark: SparkSession) -> DataFrame:
    return reports.transitions(_pairs(spark))


@query(_S + "SELECT n_join, count(*) AS n, " + _r("avg(EX) * 100", 2) + " AS accuracy FROM s GROUP BY n_join")
def accuracy_by_joins(spark: SparkSession) -> DataFrame:
    return reports.accuracy_by(spark.sql(SCORES), "n_join")


@query(_S + "SELECT n_join, " + ", ".join(f"coalesce({_r(f"avg(EX) FILTER (system = '{x}') * 100", 2)}, 0.0::DOUBLE) AS {x}" for x in SYSTEMS) + " FROM s GROUP BY n_join")
def joined_accuracies(spark: SparkSession) -> DataFrame:
    s = spark.sql(SCORES)
    return reports.joined_accuracies([(x, reports.accuracy_by(s.where(F.col("system") == x), "n_join")) for x in SYSTEMS], "n_join")


@query(_S + "SELECT a.question_id, a.system AS system_a, a.EXP AS EXP_a, a.EXR AS EXR_a, b.system AS system_b, b.EXP AS EXP_b, b.EXR AS EXR_b FROM s a JOIN s b ON a.question_id = b.question_id AND a.system < b.system "
       "WHERE a.EX = 0 AND b.EX = 0 AND abs(a.EXP - b.EXP) BETWEEN 0.205 AND 0.605 AND abs(a.EXR - b.EXR) BETWEEN 0.205 AND 0.605")
def pair_gaps(spark: SparkSession) -> DataFrame:
    return reports.pair_gaps(spark.sql(SCORES), 0.205, 0.605)


@query(_S + ", u AS (SELECT system, question_id, unnest(['EXP', 'EXR', 'F1']) AS metric, unnest([EXP, EXR, F1]) AS v FROM s) SELECT system, question_id, metric, round(CASE WHEN v <= 1 THEN v * 100 ELSE v END, 6) AS value FROM u")
def long_metrics(spark: SparkSession) -> DataFrame:
    return reports.long_metrics(spark.sql(SCORES), ["system", "question_id"]).withColumn("value", F.round("value", 6))


@query(_S + "SELECT system, " + ", ".join(f"round(quantile_cont(F1, {q}), 6) AS {n}" for n, q in (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1))) + " FROM s GROUP BY system")
def five_numbers(spark: SparkSession) -> DataFrame:
    d = reports.five_numbers(spark.sql(SCORES), "F1", "system")
    return d.select("system", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


_SHARES = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99, "high": 1.0}


@query("SELECT 'all' AS lines, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for n, q in _SHARES.items()) + " FROM lineitem UNION ALL SELECT l_returnflag, "
       + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6)" for q in _SHARES.values()) + " FROM lineitem GROUP BY l_returnflag")
def price_percentiles(spark: SparkSession) -> DataFrame:
    """All lines as one group beside three smaller ones."""
    lines = spark.table("lineitem").select(F.explode(F.array(F.lit("all"), F.col("l_returnflag"))).alias("lines"), "l_extendedprice")
    return reports.percentiles(lines, "l_extendedprice", ["lines"], _SHARES).select("lines", *[F.round(n, 6).alias(n) for n in _SHARES])


_LETTERS = "regexp_extract_all(lower(text), '[a-z]+')"


@query(f"""WITH RECURSIVE t AS (SELECT {_LETTERS} AS w FROM conversations), v AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY word),
 c AS (SELECT word, CAST(round(1000 * ln((SELECT sum(n) FROM v) / n)) AS BIGINT) AS cost FROM v), one AS (SELECT CAST(round(1000 * ln(sum(n))) AS BIGINT) + {words.UNKNOWN} AS alone FROM v),
 d AS (SELECT DISTINCT w[k] || w[k + 1] AS name FROM t, unnest(range(1, len(w))) x(k)),
 s AS (SELECT name, a, b, name[a + 1 : b] AS word FROM d, unnest(range(len(name))) x(a), unnest(range(a + 1, least(len(name), a + {words.LONGEST}) + 1)) y(b)),
 e AS (SELECT name, list(struct_pack(e := b, s := a, c := coalesce(cost, alone))) AS edges FROM s LEFT JOIN c USING (word), one WHERE cost IS NOT NULL OR b = a + 1 GROUP BY name),
 r AS (SELECT name, edges, 0 AS i, [struct_pack(cost := 0::BIGINT, words := 0::BIGINT, s := 0::BIGINT)] AS best FROM e UNION ALL
   SELECT name, edges, i + 1, list_append(best, list_min([struct_pack(cost := best[x.s + 1].cost + x.c, words := best[x.s + 1].words + 1, s := CAST(x.s AS BIGINT)) for x in edges if x.e = i + 1])) FROM r WHERE i < len(name)),
 f AS (SELECT name, best, len(name) AS pos, '' AS said FROM r WHERE i = len(name) UNION ALL SELECT name, best, CAST(best[pos + 1].s AS BIGINT), name[best[pos + 1].s + 1 : pos] || ' ' || said FROM f WHERE pos > 0)
 SELECT name, best[len(name) + 1].cost AS cost, trim(said) AS words FROM f WHERE pos = 0""")
def joined_words_cut(spark: SparkSession) -> DataFrame:
    """Every two words that follow each other in a turn, joined and cut apart again."""
    turns = spark.table("conversations").select("text", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("w"))
    joined = turns.select(F.explode(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, b))).alias("name")).where("name IS NOT NULL")
    return words.segmented(joined, "name", words.vocabulary(turns, "text")).select("name", "cost", F.array_join("words", " ").alias("words"))


@query(f"""WITH v AS (SELECT DISTINCT unnest({_LETTERS}) AS word FROM documents), r(k, old, new) AS (VALUES {', '.join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(words.ENDINGS))}),
 f AS (SELECT word, r.k, left(word, len(word) - len(old)) || new AS form FROM v, r WHERE ends_with(word, old) AND NOT (old = 's' AND ends_with(word, 'ss'))),
 k AS (SELECT f.word, arg_min(form, f.k) AS form FROM f JOIN v ON v.word = form WHERE len(form) >= 3 GROUP BY f.word)
 SELECT coalesce(form, v.word) AS lemma, count(*) AS n FROM v LEFT JOIN k ON k.word = v.word GROUP BY 1 HAVING count(*) > 1""")
def lemmas_of_documents(spark: SparkSession) -> DataFrame:
    """Plain forms to which several words of the documents come down."""
    found = words.lemmas(words.vocabulary(spark.table("documents"), "text"))
    return found.groupBy("lemma").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH RECURSIVE h AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
 p AS (SELECT child, child AS up, 0 AS k FROM h UNION ALL SELECT p.child, h.parent, k + 1 FROM p JOIN h ON h.child = p.up),
 d AS (SELECT child, max(k) + 1 AS depth FROM p GROUP BY child), x AS (SELECT c_custkey AS k, 'c' || c_custkey AS a, 'c' || (c_custkey + 1) AS b FROM customer),
 l AS (SELECT x.k, min(u.k) AS up FROM x JOIN p u ON u.child = x.a JOIN p w ON w.child = x.b AND w.up = u.up GROUP BY x.k)
 SELECT x.a, x.b, round(2.0::DOUBLE * (da.depth - up) / (da.depth + db.depth), 9) AS score FROM x LEFT JOIN l USING (k) LEFT JOIN d da ON da.child = x.a LEFT JOIN d db ON db.child = x.b""")
def customer_relatedness(spark: SparkSession) -> DataFrame:
    """Neighbouring customers by their nations and regions."""
    edge = lambda t, a, x, b, y: spark.table(t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("child"), F.concat(F.lit(b), y).alias("parent"))
    tree = edge("customer", "c", "c_custkey", "n", F.col("c_nationkey").cast("string")).unionAll(edge("nation", "n", "n_nationkey", "r", F.col("n_regionkey").cast("string"))).unionAll(edge("region", "r", "r_regionkey", "world", F.lit("")))
    name = lambda n: F.concat(F.lit("c"), (F.col("c_custkey") + n).cast("string"))
    pairs, senses = spark.table("customer").select(name(0).alias("a"), name(1).alias("b")), spark.table("customer").select(name(0).alias("word"), name(0).alias("node"))
    return words.relatedness(pairs, senses, tree).withColumn("score", F.round("score", 9))


_WORDS = "unnest(regexp_extract_all(lower({}), '[a-z]+'))"


@query(f"""WITH RECURSIVE x AS (SELECT DISTINCT {_WORDS.format('p_name')} AS a FROM part), y AS (SELECT DISTINCT {_WORDS.format('text')} AS b FROM conversations),
 p AS (SELECT a, b, len(a) AS n, len(b) AS m FROM x, y WHERE 200.0 * least(len(a), len(b)) / (len(a) + len(b)) >= 70),
 r AS (SELECT a, b, n, m, 0 AS i, [0 for j in range(m + 1)] AS row FROM p UNION ALL
   SELECT a, b, n, m, i + 1, [greatest(row[j], coalesce(list_max([row[q - 1] + 1 for q in range(2, j + 1) if b[q - 1] = a[i + 1]]), 0)) for j in range(1, m + 2)] FROM r WHERE i < n)
 SELECT a, b, round(200.0 * row[m + 1] / (n + m), 6) AS ratio FROM r WHERE i = n AND 200.0 * row[m + 1] / (n + m) >= 70""")
def fuzzy_words(spark: SparkSession) -> DataFrame:
    """Words of part names that are like words of conversations."""
    said = lambda t, c: spark.table(t).select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"))).alias("w"))
    return similar.similar(said("part", "p_name"), said("conversations", "text"), "w", "w", 70.0).select(F.col("left").alias("a"), F.col("right").alias("b"), F.round("ratio", 6).alias("ratio"))


@query("SELECT CAST(least(floor((l_quantity - 0) / 2.5), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def histogram(spark: SparkSession) -> DataFrame:
    return reports.histogram(spark.table("lineitem"), "l_quantity", 0.0, 50.0)


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1")
def value_counts(spark: SparkSession) -> DataFrame:
    return reports.value_counts(spark.table("orders"), "o_orderpriority").withColumn("percent", F.round("percent", 6))


@query(_S + "SELECT * FROM s WHERE question_id NOT IN (SELECT question_id FROM s WHERE EX = 1)")
def drop_problem_groups(spark: SparkSession) -> DataFrame:
    return sampling.without_solved(spark.sql(SCORES))


@query(_S + "SELECT * FROM s WHERE question_id IN (SELECT question_id FROM (SELECT DISTINCT question_id FROM s) ORDER BY md5(question_id || '/42'), question_id LIMIT (SELECT CAST(round(count(DISTINCT question_id) * 0.2) AS BIGINT) FROM s))")
def hash_sample_questions(spark: SparkSession) -> DataFrame:
    return sampling.questions(spark.sql(SCORES), 0.2)


@query("""WITH n AS (SELECT source AS key, count(*) AS n FROM documents GROUP BY source), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
        SELECT key, n, CASE WHEN before < 100 THEN 'test' WHEN before < 250 THEN 'dev' ELSE 'train' END AS split FROM b""")
def prefix_split(spark: SparkSession) -> DataFrame:
    sizes = spark.table("documents").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"))
    return sampling.prefix_split(sizes, [("test", 100), ("dev", 150)], order=["key"])


@query()
def kmeans_sources(spark: SparkSession) -> DataFrame:
    langs = ["de", "en", "es", "fr"]
    shares = spark.table("documents").groupBy("source").agg(*[F.avg((F.col("lang") == x).cast("double")).alias(x) for x in langs])
    return sampling.clusters(shares, "source", langs)


_STRUCTURE = """SELECT l_orderkey * 10 + l_linenumber AS query_id, CAST(l_linenumber % 3 AS INT) AS num_conditions, CAST(l_linenumber % 2 AS INT) AS num_projections, concat('db', CAST(l_suppkey % 3 AS INT)) AS db_id,
 CAST(l_partkey % 4 AS INT) AS grp FROM lineitem"""
_PLAN = f"""WITH t AS ({_STRUCTURE}), n AS (SELECT num_conditions, num_projections, db_id, grp, count(*) AS n FROM t GROUP BY ALL)
 SELECT num_conditions, num_projections, db_id, min(n) AS quota FROM n GROUP BY ALL HAVING count(*) = 4"""


@query(_PLAN)
def balanced_plan(spark: SparkSession) -> DataFrame:
    return sampling.balanced_plan(spark.sql(_STRUCTURE))


@query(f"""WITH t AS ({_STRUCTURE}), n AS (SELECT num_conditions, num_projections, db_id, grp, count(*) AS n FROM t GROUP BY ALL),
 q AS (SELECT num_conditions, num_projections, db_id, min(n) AS quota FROM n GROUP BY ALL HAVING count(*) = 4),
 r AS (SELECT t.*, quota, row_number() OVER (PARTITION BY t.num_conditions, t.num_projections, t.db_id, grp ORDER BY md5(query_id || '/42'), query_id) AS r FROM t JOIN q USING (num_conditions, num_projections, db_id))
 SELECT query_id, num_conditions, num_projections, db_id, grp FROM r WHERE r <= quota""")
def balanced_sample(spark: SparkSession) -> DataFrame:
    return sampling.balanced_sample(spark.sql(_STRUCTURE))


# ---- queries as values: structure, mutants, expansion, renaming


@query()
def corpus_structure(spark: SparkSession) -> DataFrame:
    rows = [{"question_id": k, "db_id": db, "is_nested": is_nested(q), **structure(parse(q))} for k, db, q in star.CORPUS]
    return spark.createDataFrame(rows)


@query()
def structure_groups(spark: SparkSession) -> DataFrame:
    return reports.structure_groups(spark.createDataFrame([{"db_id": db, **structure(parse(q))} for _, db, q in star.CORPUS]))


def _used(spark: SparkSession) -> DataFrame:
    owner = {c: t for t, (_, cols) in star.ABBREVIATIONS.items() for c in cols}
    rows = []
    for k, db, q in star.CORPUS:
        s = parse(q)
        for role, parts in (("projection", [e for e, _ in s.select]), ("filter", [t for _, t in s.where])):
            rows += [(k, db, owner[c.split(".")[-1]], c.split(".")[-1], role) for p in parts for c in columns_of(p) if c.split(".")[-1] in owner]
    return spark.createDataFrame(rows, "question_id int, db_id string, table_name string, column_name string, role string")


@query()
def top_projection_columns(spark: SparkSession) -> DataFrame:
    return reports.top_columns(reports.column_frequencies(_used(spark)), "projection_occurrences", 5)


@query()
def top_filter_columns(spark: SparkSession) -> DataFrame:
    n = reports.column_frequencies(_used(spark))
    return reports.top_columns(n, "filtering_occurrences", 5, without=reports.top_columns(n, "projection_occurrences", 5))


@query()
def mutants_depth1(spark: SparkSession) -> DataFrame:
    return mutation.mutants(spark, star.CORPUS, 1)


@query()
def mutants_depth2(spark: SparkSession) -> DataFrame:
    return mutation.mutants(spark, star.CORPUS, 2)


@query()
def mutant_chains(spark: SparkSession) -> DataFrame:
    return reports.chains(mutation.mutants(spark, star.CORPUS, 2), 2)


_FK = "f(a, x, b, y) AS (VALUES " + ", ".join(map(str, star.FOREIGN_KEYS)) + ")"
_E = _FK + ", e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM f)"


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("star", *sorted((a, b))) for a, _, b, _ in star.FOREIGN_KEYS], "graph_id string, src string, dst string").distinct()


@query(f"WITH {_FK} SELECT least(a, b) AS src, greatest(a, b) AS dst, string_agg(DISTINCT a || '.' || x || ' = ' || b || '.' || y, '; ' ORDER BY a || '.' || x || ' = ' || b || '.' || y) AS label FROM f GROUP BY 1, 2")
def fk_edges(spark: SparkSession) -> DataFrame:
    return graph.schema_edges(star.foreign_keys(spark), False).select("src", "dst", F.array_join("labels", "; ").alias("label"))


@query(f"""WITH {_FK}, u AS (SELECT a, b, a || '.' || x || ' = ' || b || '.' || y AS l FROM f UNION ALL SELECT p.a, q.a, p.a || '.' || p.x || ' = ' || q.a || '.' || q.x FROM f p JOIN f q ON p.b = q.b AND p.y = q.y AND p.a < q.a)
        SELECT least(a, b) AS src, greatest(a, b) AS dst, string_agg(DISTINCT l, '; ' ORDER BY l) AS label FROM u GROUP BY 1, 2""")
def sibling_edges(spark: SparkSession) -> DataFrame:
    return graph.schema_edges(star.foreign_keys(spark)).select("src", "dst", F.array_join("labels", "; ").alias("label"))


@query(f"WITH {_E} SELECT 'star' AS graph_id, node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def graph_degree(spark: SparkSession) -> DataFrame:
    return graph.degrees(_edges(spark))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000000 + o_orderkey AS b FROM orders UNION SELECT DISTINCT o_custkey, o_custkey + 3 FROM orders WHERE o_custkey % 12 = 0),
        n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, c) AS (SELECT a, a FROM n UNION SELECT n.b, r.c FROM r JOIN n ON n.a = r.v AND r.c < n.b),
        m AS (SELECT v, min(c) AS root FROM r GROUP BY v) SELECT root, count(*) AS n FROM m GROUP BY root""")
def graph_components(spark: SparkSession) -> DataFrame:
    o = spark.table("orders")
    e = o.select(F.col("o_custkey").alias("a"), (F.lit(1000000000) + F.col("o_orderkey")).alias("b")).union(
        o.where("o_custkey % 12 = 0").select("o_custkey", F.col("o_custkey") + 3)).distinct()
    c = graph.components(e)
    return c.select(F.col("b").alias("root"), "a").union(c.select("b", "b").distinct()).groupBy("root").agg(F.count("*").alias("n"))


@query(f"WITH {_E}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT 'star' AS graph_id, (SELECT count(*) FROM v) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, 1::BIGINT AS n_components, "
       "(SELECT count(*) FROM e) - (SELECT count(*) FROM v) + 1 AS n_cycles, round(2.0::DOUBLE * (SELECT count(*) FROM e) / (SELECT count(*) FROM v), 6) AS avg_degree")
def graph_summary(spark: SparkSession) -> DataFrame:
    e = _edges(spark)
    nodes = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.summaries(nodes, e).withColumn("avg_degree", F.round("avg_degree", 6))


@query(f"""WITH RECURSIVE {_E}, n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
        r(path) AS (SELECT [a] FROM n GROUP BY a UNION ALL SELECT list_append(path, b) FROM r JOIN n ON n.a = path[len(path)] WHERE b > path[1] AND NOT list_contains(path, b)),
        c AS (SELECT path FROM r JOIN n ON n.a = path[len(path)] AND n.b = path[1] WHERE len(path) > 2 AND path[2] < path[len(path)])
        SELECT 'star' AS graph_id, CAST(len(path) AS INTEGER) AS length, array_to_string(path, '-') AS cycle FROM c""")
def graph_cycles(spark: SparkSession) -> DataFrame:
    return graph.cycles(_edges(spark))


@query(f"""WITH RECURSIVE {_E}, n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(a, b, d, path) AS (SELECT a, b, 1, [a, b] FROM n UNION ALL
        SELECT r.a, n.b, d + 1, list_append(path, n.b) FROM r JOIN n ON n.a = r.b WHERE NOT list_contains(path, n.b)), m AS (SELECT a, b, min(d) AS d FROM r GROUP BY a, b) SELECT 'star' AS graph_id, max(d) AS diameter FROM m""")
def graph_diameter(spark: SparkSession) -> DataFrame:
    return graph.diameters(_edges(spark))


@query()
def graph_centrality(spark: SparkSession) -> DataFrame:
    return graph.centralities(_edges(spark))


@query()
def pattern_growth(spark: SparkSession) -> DataFrame:
    rows = [(n, len(e), graph.canonical(list(range(n)), e)) for n, e in graph.patterns(5)]
    found = spark.createDataFrame(rows, "n_nodes int, n_edges int, iso_key string")
    return found.groupBy("n_nodes", "n_edges").agg(F.count_distinct("iso_key").alias("n_patterns"))


@query()
def pattern_instances(spark: SparkSession) -> DataFrame:
    """Patterns of up to four nodes, told by their nodes' degrees, which no two of them share."""
    degrees = {c: "".join(map(str, sorted(len(v) for v in graph.neighbours(e).values()))) for c, e in ((graph.canonical(list(range(n)), e), e) for n, e in graph.patterns(4))}
    return graph.per_graph(_edges(spark), lambda g, n, e: [(g, degrees[k], c) for k, c in sorted(graph.instances(n, e, 4).items())], "graph_id string, degrees string, n long")


@query()
def iso_classes(spark: SparkSession) -> DataFrame:
    rows = [(f"{k}", str(a), str(b)) for k, _, q in star.CORPUS for a, b in expansion.query_graph(parse(q))[1]]
    forms = graph.canonical_forms(spark.createDataFrame(rows, "graph_id string, src string, dst string"))
    return forms.groupBy("iso_key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("graph_id")), ",").alias("graphs")).drop("iso_key")


def _schema(spark: SparkSession) -> expansion.Schema:
    return expansion.schema_of(graph.schema_edges(star.foreign_keys(spark)))


@query()
def candidate_expansions(spark: SparkSession) -> DataFrame:
    found = expansion.expansions(spark, [(k, q) for k, _, q in star.CORPUS], _schema(spark))
    return found.select("question_id", "ord", "table_name", F.array_join("joins", " AND ").alias("joins"))


#: The schema's edges by hand: declared keys, and customer and supplier that refer to one column.
_EDGES = {(a, b): [f"{a}.{x} = {b}.{y}"] for a, x, b, y in star.FOREIGN_KEYS} | {("customer", "supplier"): ["customer.c_nationkey = supplier.s_nationkey"]}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _expanded_sql() -> str:
    """Each candidate run by DuckDB itself; those with a result are numbered, and of equal graphs the first is kept."""
    rows = []
    for k, _, sql in star.CORPUS:
        spec = parse(sql)
        for at, c in enumerate(expansion.candidates(spec, _EDGES)):
            new = expansion.extend(spec, c)
            if not expansion.redundant(spec, c):
                said = new.sql()
                lone = f"(SELECT count(*) = 1 AND bool_or(x IS NULL OR x = 0) FROM (SELECT * FROM ({said}) LIMIT 2) t(x))" if len(spec.select) == 1 and re.search(r"(count|avg|sum|max|min)\(", said, re.I) else "false"
                form = graph.canonical(*expansion.query_graph(new))
                rows.append(f"SELECT {k} AS question_id, {at} AS ord, '{c.table}' AS table_name, {_quoted(said)} AS sql, '{form}' AS form WHERE EXISTS (SELECT 1 FROM ({said})) AND NOT {lone}")
    return f"""SELECT question_id, ord, table_name, sql, CASE WHEN row_number() OVER (PARTITION BY question_id, form ORDER BY ord) = 1 THEN 'filtered' ELSE 'discarded' END AS status
               FROM ({' UNION ALL '.join(rows)})"""


@query(_expanded_sql())
def expanded_query_results(spark: SparkSession) -> DataFrame:
    return expansion.expand(spark, [(k, q) for k, _, q in star.CORPUS], _schema(spark)).select("question_id", "ord", "table_name", "sql", "status")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, o_orderstatus NULLS FIRST, o_orderpriority NULLS FIRST LIMIT 1")
def best_filter_values(spark: SparkSession) -> DataFrame:
    _, counting = expansion.graph_first([("orders", "orders")], [], ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return expansion.best_values(spark.sql(counting), ["o_orderstatus", "o_orderpriority"])


@query("SELECT k AS case_id, 'ok' AS status, 1 AS ex FROM (VALUES " + ", ".join(f"('{k}')" for k, _, _ in star.CORPUS) + ") t(k)")
def rename_equivalence(spark: SparkSession) -> DataFrame:
    mapping = rename.mapping_of(star.mapping(spark), "star")
    rename.apply_renames(spark, mapping)
    return rename.validate_rewritten(spark, [(k, q) for k, _, q in star.CORPUS], mapping).select("case_id", "status", "ex")


_MAP = "m(t, c, nt, nc) AS (VALUES " + ", ".join(f"('{t}', '{c}', '{new[:2]}', '{x[:2]}')" for t, (new, cols) in star.ABBREVIATIONS.items() for c, x in cols.items()) + ")"


@query(f"""WITH {_MAP} SELECT 'star' AS db_id, 'table' AS scope, lower(nt) AS new_name, count(DISTINCT t) AS n FROM m GROUP BY 3 HAVING count(DISTINCT t) > 1
        UNION ALL SELECT 'star', 'column of ' || t, lower(nc), count(DISTINCT c) FROM m GROUP BY t, lower(nc) HAVING count(DISTINCT c) > 1""")
def duplicate_new_names(spark: SparkSession) -> DataFrame:
    m = star.mapping(spark).withColumns({c: F.substring(c, 1, 2) for c in ("new_table_name", "new_column_name")})
    return rename.duplicate_names(m)


# ---- words, identifiers and linking

_NAMES = "i(name) AS (VALUES " + ", ".join(f"('{x}')" for t, (new, cols) in star.ABBREVIATIONS.items() for x in (t, new, *cols, *cols.values())) + ")"


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for t, (new, cols) in star.ABBREVIATIONS.items() for x in (t, new, *cols, *cols.values())], "name string")


@query(f"WITH {_NAMES} SELECT name, translate(regexp_replace(lower(name), '[^a-z1-9_@-]', '*', 'g'), 'abcdefghijklmnopqrstuvwxyz123456789-_@', '^+++^+++^+++++^+++++^+++++#########$$$') AS tags FROM i")
def token_tags(spark: SparkSession) -> DataFrame:
    return _names(spark).select("name", text.character_tags(F.col("name")).alias("tags"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS INTEGER) AS n FROM documents")
def word_counts(spark: SparkSession) -> DataFrame:
    return spark.table("documents").select("doc_id", F.size(text.lower_tokens(F.col("text"))).alias("n"))


@query()
def tokens_with_pos(spark: SparkSession) -> DataFrame:
    tokens = text.tokens_with_positions(F.col("text"))
    said = F.array_join(F.transform(tokens, lambda t: F.concat(t["token"], F.lit("@"), t["position"].cast("string"))), " ")
    return spark.table("conversations").select("conv_id", "turn", said.alias("tokens"))


@query()
def phrase_removal(spark: SparkSession) -> DataFrame:
    c = spark.table("conversations")
    phrase = F.array_join(F.slice(text.lower_tokens(F.col("text")), 2, 2), " ")
    return c.select("conv_id", "turn", text.phrase_removed(F.col("text"), phrase).alias("r")).select("conv_id", "turn", "r.text", F.size("r.removed").alias("n_removed"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN list_has_any(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: lower(w)), ['the', 'and']) THEN 0.0::DOUBLE ELSE 1.0 END AS score
        FROM conversations""")
def hiding_score(spark: SparkSession) -> DataFrame:
    return spark.table("conversations").select("conv_id", "turn", text.hiding_score(F.col("text"), F.array(F.lit("the"), F.lit("and"))).alias("score"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 5 = 0 THEN 'ok' ELSE 'malformed' END AS status, "
       "CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 0 THEN 1 END AS EX, CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 0 THEN 0.5::DOUBLE END AS EXP FROM events")
def json_metric_parse(spark: SparkSession) -> DataFrame:
    cell = F.when(F.col("event_id") % 7 == 0, "timeout").when(F.col("event_id") % 5 == 0, "{'EX': 1, 'EXP': 0.5, 'EXR': 1.0, 'F1': 0.67}").otherwise("not json")
    return spark.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.metrics_of(cell).alias("m")).select("event_id", "k", "m.status", "m.EX", "m.EXP")


@query("SELECT o_orderkey, CAST('11' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS BIGINT) AS id, CAST(o_orderkey % 10000 AS INTEGER) AS back FROM orders")
def encoded_ids(spark: SparkSession) -> DataFrame:
    o = spark.table("orders").withColumn("id", text.encoded_id(F.col("o_orderkey") % 10000, F.col("o_custkey") % 1000))
    return o.select("o_orderkey", "id", text.decoded_id(F.col("id")).alias("back"))


def _link_rows(spark: SparkSession) -> DataFrame:
    """Gold and predicted links of each order, as maps from tables to columns."""
    as_map = lambda *xs: F.create_map(*[v for t, cs in xs for v in (F.lit(t), F.array(*[F.lit(c) for c in cs]))])
    gold = F.when(F.col("o_orderstatus") == "F", as_map(("A", "xy"), ("b", "z"))).otherwise(as_map(("a", "X"), ("c", "w")))
    m = F.col("o_custkey") % 4
    pred = F.when(m == 0, as_map(("a", "x"))).when(m == 1, as_map(("a", "xy"), ("b", "z"), ("d", "q"))).when(m == 2, as_map(("c", "w"), ("a", "x"))).otherwise(
        F.create_map().cast("map<string,array<string>>"))
    return spark.table("orders").select(F.col("o_orderkey").alias("k"), gold.alias("gold"), pred.alias("pred"), F.col("o_orderpriority").alias("method"),
                                        F.when(F.col("o_custkey") % 3 == 0, "OO").when(F.col("o_custkey") % 3 == 1, "OL").otherwise("LL").alias("combo"))


_L = """WITH l AS (SELECT o_orderkey AS k, o_orderpriority AS method, CASE o_custkey % 3 WHEN 0 THEN 'OO' WHEN 1 THEN 'OL' ELSE 'LL' END AS combo,
  CASE WHEN o_orderstatus = 'F' THEN ['a_x', 'a_y', 'b_z'] ELSE ['a_x', 'c_w'] END AS g,
  CASE o_custkey % 4 WHEN 0 THEN ['a_x'] WHEN 1 THEN ['a_x', 'a_y', 'b_z', 'd_q'] WHEN 2 THEN ['c_w', 'a_x'] ELSE []::VARCHAR[] END AS p FROM orders),
 c AS (SELECT k, method, combo, len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM l),
 x AS (SELECT k, method, combo, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, CASE WHEN fn = 0 THEN 1 ELSE 0 END AS slr FROM c) """


@query(_L + "SELECT k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, slr FROM x")
def schema_linking_scores(spark: SparkSession) -> DataFrame:
    return linking.scores(_link_rows(spark), "gold", "pred").select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "slr")


@query(_L + ", a AS (SELECT combo, method, count(*) AS n, " + ", ".join(f"{_r(f'avg({c}) * 100', 1)} AS {c}" for c in ("precision", "recall", "f1", "slr")) + " FROM x GROUP BY combo, method) SELECT a.*, " +
       ", ".join(f"round(a.{c} - b.{c}, 1) AS delta_{c}" for c in ("precision", "recall", "f1", "slr")) + " FROM a LEFT JOIN a b ON a.method = b.method AND b.combo = 'OO'")
def schema_linking_report(spark: SparkSession) -> DataFrame:
    return linking.report(linking.scores(_link_rows(spark), "gold", "pred").withColumn("error", F.lit(None).cast("string")))


@query(f"""WITH {_NAMES}, n AS (SELECT name AS c, CASE WHEN length(name) <= 3 THEN 'N3' WHEN name LIKE '%\\_%' ESCAPE '\\' THEN 'N2' ELSE 'N1' END AS k FROM i),
        u AS (SELECT 'columns' AS scope, k, count(*) AS n FROM n GROUP BY k UNION ALL SELECT 'tables', 'N1', 1 UNION ALL SELECT 'combined', k, count(*) + CASE WHEN k = 'N1' THEN 1 ELSE 0 END FROM n GROUP BY k)
        SELECT scope, k AS class, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY scope), 6) AS percent FROM u""")
def naturalness_dist(spark: SparkSession) -> DataFrame:
    k = F.when(F.length("name") <= 3, "N3").when(F.col("name").contains("_"), "N2").otherwise("N1")
    rows = _names(spark).select(F.lit("d").alias("dataset"), F.lit("star").alias("db_id"), F.lit("t").alias("table_name"), F.lit("N1").alias("table_naturalness"), k.alias("column_naturalness"))
    return reports.naturalness(rows).withColumn("percent", F.round("percent", 6))


# ---- what the SQL layer must run

BACKEND = {
    "join": "SELECT n.n_name, count(*) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000 GROUP BY n.n_name",
    "comma_join": "SELECT r_name, count(*) AS n FROM region, nation, customer WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey GROUP BY r_name",
    "group_having": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS q FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "window": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < -900)",
    "cte": "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), m AS (SELECT max(n) AS n FROM t) SELECT t.o_custkey, t.n FROM t JOIN m ON t.n = m.n",
    "case_in_like": "SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 'small' WHEN p_brand LIKE '%1%' THEN 'one' ELSE 'other' END AS k FROM part WHERE p_retailprice IS NOT NULL",
    "order_limit": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25",
    "set_ops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT 99",
    "dates": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
}
for _k, _q in BACKEND.items():
    query(_q, f"sql_backend_{_k}")(lambda spark, q=_q: spark.sql(q))



# ---- more reports

_STATUS = "CASE WHEN question_id % 11 = 0 THEN 'timeout' WHEN question_id % 13 = 0 THEN 'error' ELSE 'ok' END"


@query(_S + f"SELECT system AS technique, count(*) FILTER ({_STATUS} = 'ok') AS n_ok, count(*) FILTER ({_STATUS} = 'timeout') AS n_timeout, count(*) FILTER ({_STATUS} = 'error') AS n_error, "
       "round(avg(F1), 6) AS f1_mean, round(stddev_pop(F1), 6) AS f1_std FROM s GROUP BY system")
def technique_statuses(spark: SparkSession) -> DataFrame:
    s = spark.sql(SCORES).withColumn("status", F.expr(_STATUS)).withColumnRenamed("system", "technique")
    return reports.statuses(s).withColumns({c: F.round(c, 6) for c in ("f1_mean", "f1_std")})


@query(_S + "SELECT round(avg(a), 6) AS mean_automatic, round(avg(h), 6) AS mean_human, count(*) FILTER (a IS DISTINCT FROM h) AS n_differ FROM (SELECT CASE WHEN question_id % 9 > 0 THEN EX END AS a, CASE WHEN question_id % 7 > 0 THEN n_join % 2 END AS h FROM s)")
def agreement(spark: SparkSession) -> DataFrame:
    s = spark.sql(SCORES).select(F.when(F.col("question_id") % 9 > 0, F.col("EX")).alias("automatic"), F.when(F.col("question_id") % 7 > 0, F.col("n_join") % 2).alias("human"))
    return reports.agreement(s).withColumns({c: F.round(c, 6) for c in ("mean_automatic", "mean_human")})


@query(_S + ", m AS (SELECT operator, system, " + _MEANS + " FROM s WHERE system IN ('view', 'click') GROUP BY 1, 2) SELECT a.operator, " +
       ", ".join(f"{t}.{c} AS {n}_{c}" for t, n in (("a", "view"), ("b", "click")) for c in ("EXP", "EXR", "F1")) + ", " + ", ".join(f"round(b.{c} - a.{c}, 2) AS delta_{c}" for c in ("EXP", "EXR", "F1")) +
       " FROM m a JOIN m b ON a.operator = b.operator AND a.system = 'view' AND b.system = 'click'")
def operator_deltas(spark: SparkSession) -> DataFrame:
    return reports.operator_deltas(spark.sql(SCORES).withColumnRenamed("system", "technique"), "view", "click")


@query(_S + "SELECT system, n_join, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY system), 6) AS share FROM s GROUP BY system, n_join")
def node_distribution(spark: SparkSession) -> DataFrame:
    return reports.shares_by(spark.sql(SCORES), "system", "n_join").select("system", "n_join", "n", F.round(F.col("share").cast("double"), 6).alias("share"))


@query("SELECT 'db' || CAST(c_nationkey % 3 AS VARCHAR) AS db_id, 'system' AS system, c_custkey AS question_id, c_mktsegment AS method, c_custkey % 2 = 1 AND c_custkey % 3 = 0 AS over_ol, c_custkey % 2 = 1 AND c_custkey % 5 = 0 AS over_lo FROM customer")
def linking_improvements(spark: SparkSession) -> DataFrame:
    k = F.col("question_id")
    base = spark.table("customer").select(F.concat(F.lit("db"), (F.col("c_nationkey") % 3).cast("string")).alias("db_id"), F.lit("system").alias("system"), F.col("c_custkey").alias("question_id"), F.col("c_mktsegment").alias("method"))
    rows = base.select("*", F.explode(F.array(F.lit("LL"), F.lit("OL"), F.lit("LO"))).alias("combo"))
    slr = F.when(F.col("combo") == "LL", (k % 2 == 1).cast("int")).when(F.col("combo") == "OL", (k % 3 > 0).cast("int")).otherwise((k % 5 > 0).cast("int"))
    return linking.improvements(rows.withColumn("slr", slr))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(o_custkey % 2 AS INTEGER) END AS ex_before, CAST(o_orderkey % 2 AS INTEGER) AS ex_after, "
       "CAST(o_orderkey % 2 AS INTEGER) - CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(o_custkey % 2 AS INTEGER) END AS delta FROM orders")
def ex_before_and_after(spark: SparkSession) -> DataFrame:
    k = F.col("o_orderkey")
    before = F.when(k % 10 == 0, "missing").when(k % 7 == 0, "timeout").otherwise((F.col("o_custkey") % 2).cast("string"))
    return reports.two_ex(spark.table("orders").select("o_orderkey", before.alias("before"), (k % 2).cast("string").alias("after"))).select("o_orderkey", "ex_before", "ex_after", "delta")


@query()
def schema_translation(spark: SparkSession) -> DataFrame:
    from plumbline.plans.queryspec import gold_links

    rows = [(k, db, gold_links(parse(q))) for k, db, q in star.CORPUS]
    schema = spark.createDataFrame(rows, "question_id int, db_id string, schema map<string,array<string>>")
    return linking.translated(schema, star.mapping(spark)).select("question_id", linking.schema_text(F.col("schema")).alias("text"))


@query()
def identifier_naturalness(spark: SparkSession) -> DataFrame:
    dictionary = frozenset("region nation customer supplier part order line item key name size type brand".split())
    return naturalness.decreased(naturalness.classified(_names(spark), naturalness.by_dictionary(dictionary)))


@query()
def question_links(spark: SparkSession) -> DataFrame:
    rows = [(k, q, parse(sql).table, [], []) for (k, _, sql), q in zip(star.CORPUS, (
        "Which nations lie outside Asia?", "How many customers has each segment?", "Which parts are large?", "List suppliers by key", "Balance by nation", "Orders by priority", "Quantities of line items", "Suppliers by region", "Large orders"))]
    found = naturalness.linked(spark.createDataFrame(rows, "question_id int, question string, central_table string, literals array<string>, attributes array<string>"), frozenset({"line", "item"}))
    said = F.transform("components", lambda c: F.concat(c["segment"], F.lit(":"), F.array_join(F.transform(c["matched_tokens"], lambda t: F.concat(t["token"], F.lit("@"), t["position"].cast("string"))), ",")))
    return found.select("question_id", "central_table", F.array_join(said, " ").alias("components"))


@query()
def query_variants(spark: SparkSession) -> DataFrame:
    mapping = rename.mapping_of(star.mapping(spark), "star")
    rows = [(k, db, f"question {k}", f"new question {k}", q, rename.rewrite(q, mapping)) for k, db, q in star.CORPUS]
    return rename.variants(spark.createDataFrame(rows, "question_id int, db_id string, question string, new_question string, sql string, new_sql string"))


@query("SELECT conv_id, turn, text AS original, trim(regexp_replace(text, '[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS squeezed FROM conversations")
def squeezed_texts(spark: SparkSession) -> DataFrame:
    return spark.table("conversations").select("conv_id", "turn", F.col("text").alias("original"), text.squeezed(F.col("text")).alias("squeezed"))


from plumbline.plans import checked  # noqa: E402, F401  more queries, and SQL for some of the above
