"""Queries over the corpus, schema graph and words whose SQL finds the same by other means: DuckDB's own
parser for what a query is made of, recursion for graphs, and values worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evaluation, expansion, graph, mutation, reports
from plumbline.plans import queries as q
from plumbline.plans import star
from plumbline.plans.queryspec import parse
from plumbline.plans.register import ORACLES, query

_said = lambda s: "'" + str(s).replace("'", "''") + "'"

# ---- what the corpus's queries are made of, by DuckDB's parser

_AST = "c(question_id, db_id, sql) AS (VALUES " + ", ".join(f"({k}, '{db}', {_said(s)})" for k, db, s in star.CORPUS) + r"""),
 a AS (SELECT question_id, db_id, sql, json_extract(json_serialize_sql(sql), '$.statements[0].node') AS n FROM c),
 b AS (SELECT question_id, db_id, CAST(json_extract(n, '$.from_table') AS VARCHAR) AS f, coalesce(CAST(json_extract(n, '$.where_clause') AS VARCHAR), 'null') AS w,
   json_extract_string(n, '$.where_clause.type') AS wt, json_array_length(n, '$.where_clause.children') AS wn, json_array_length(n, '$.select_list') AS num_projections,
   CAST(json_extract(n, '$.select_list') AS VARCHAR) AS sel, json_array_length(n, '$.group_expressions') > 0 AS has_group_by, json_extract_string(n, '$.having.type') IS NOT NULL AS has_having,
   coalesce(CAST(json_extract(n, '$.having') AS VARCHAR), '') AS h FROM a),
 p AS (SELECT question_id, unnest(regexp_extract_all(f || CASE WHEN contains(f, '"is_implicit":true') THEN w ELSE '' END,
   '"left":\{"class":"COLUMN_REF"[^{}]*"column_names":\["[a-z]+","[a-z_]+"\]\},"right":\{"class":"COLUMN_REF"[^{}]*"column_names":\["[a-z]+","[a-z_]+"\]\}')) AS e FROM b),
 d AS (SELECT question_id, regexp_extract_all(e, '"column_names":\["([a-z]+)"', 1) AS x FROM p),
 g AS (SELECT question_id, count(DISTINCT list_sort(x)) AS num_edges FROM d GROUP BY question_id),
 s AS (SELECT question_id, db_id, len(regexp_extract_all(f, '"type":"BASE_TABLE"')) AS num_nodes, coalesce(num_edges, 0) AS num_edges, len(regexp_extract_all(f, '"is_implicit":false')) AS num_joins,
   CASE WHEN w = 'null' THEN 0 WHEN wt LIKE 'CONJUNCTION%' THEN wn ELSE 1 END AS num_conditions, num_projections, has_group_by, has_having,
   regexp_matches(sel || h, '"function_name":"(count|count_star|sum|avg|min|max)"') AS has_aggregation FROM b LEFT JOIN g USING (question_id)),
 t AS (SELECT *, num_edges - num_nodes + 1 AS num_cycles FROM s)"""

ORACLES["corpus_structure"] = f"""WITH {_AST} SELECT question_id, db_id, false AS is_nested, num_nodes, num_edges, num_joins, 2.0::DOUBLE * num_edges / num_nodes AS avg_degree, num_cycles > 0 AS is_cyclic, num_cycles,
 num_conditions, num_projections, has_group_by, has_having, has_aggregation FROM t"""
ORACLES["structure_groups"] = f"""WITH {_AST}, k AS (SELECT num_nodes, num_edges, num_conditions, num_projections, db_id, count(*) AS n, count(*) FILTER (num_cycles > 0) AS cyclic, sum(num_cycles) AS cycles,
 count(*) FILTER (has_group_by) AS group_by, count(*) FILTER (has_having) AS hav, count(*) FILTER (has_aggregation) AS aggregation FROM t GROUP BY ALL)
 SELECT num_nodes, num_edges, num_conditions, num_projections, CAST(sum(n) AS BIGINT) AS total, CAST(sum(cyclic) AS BIGINT) AS cyclic, CAST(sum(n) - sum(cyclic) AS BIGINT) AS acyclic, CAST(sum(cycles) / sum(n) AS DOUBLE) AS avg_cycles,
 CAST(sum(group_by) AS BIGINT) AS group_by, CAST(sum(hav) AS BIGINT) AS "having", CAST(sum(aggregation) AS BIGINT) AS aggregation, string_agg(db_id || '(' || n || ')', ', ' ORDER BY db_id || '(' || n || ')') AS dbs
 FROM k GROUP BY num_nodes, num_edges, num_conditions, num_projections"""
_OWNER = "own(table_name, column_name) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, (_, cols) in star.ABBREVIATIONS.items() for c in cols) + ")"
_FREQUENCIES = f"""{_AST}, {_OWNER}, u AS (SELECT question_id, db_id, 'projection' AS role, unnest(regexp_extract_all(sel, '"column_names":\\[(?:"[a-z_]+",)?"([a-z_]+)"\\]', 1)) AS column_name FROM b
  UNION ALL SELECT question_id, db_id, 'filter', unnest(regexp_extract_all(w, '"column_names":\\[(?:"[a-z_]+",)?"([a-z_]+)"\\]', 1)) FROM b),
 fr AS (SELECT db_id, table_name, column_name, count(DISTINCT question_id) FILTER (role = 'projection') AS projection_occurrences, count(DISTINCT question_id) FILTER (role = 'filter') AS filtering_occurrences
   FROM u JOIN own USING (column_name) GROUP BY ALL),
 tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY projection_occurrences DESC, table_name, column_name) AS rank FROM fr WHERE projection_occurrences > 0) WHERE rank <= 5)"""
ORACLES["top_projection_columns"] = f"WITH {_FREQUENCIES} SELECT * FROM tp"
ORACLES["top_filter_columns"] = f"""WITH {_FREQUENCIES}, l AS (SELECT * FROM fr ANTI JOIN tp USING (db_id, table_name, column_name) WHERE filtering_occurrences > 0)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY filtering_occurrences DESC, table_name, column_name) AS rank FROM l) WHERE rank <= 5"""

# ---- mutations, worked out by hand on queries that leave one choice

MUTATIONS = [
    ("projection_drop", "SELECT n_name, n_name FROM nation", "SELECT n_name FROM nation"),
    ("where_predicate_delete", "SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    ("where_remove", "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation"),
    ("where_condition_flip", "SELECT n_name FROM nation WHERE n_regionkey >= 1", "SELECT n_name FROM nation WHERE n_regionkey <= 1"),
    ("where_strengthen", "SELECT n_name FROM nation WHERE n_regionkey < 3", "SELECT n_name FROM nation WHERE n_regionkey <= 3"),
    ("where_weaken", "SELECT n_name FROM nation WHERE n_regionkey >= 3", "SELECT n_name FROM nation WHERE n_regionkey > 3"),
    ("join_break", "SELECT n.n_name FROM nation AS n INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey", "SELECT n.n_name FROM nation AS n CROSS JOIN region AS r"),
    ("aggregation_swap", "SELECT MAX(n_nationkey) FROM nation", "SELECT MIN(n_nationkey) FROM nation"),
    ("add_star_wildcard", "SELECT n_name FROM nation", "SELECT n_name, nation.* FROM nation"),
    ("having_condition_flip", "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 5", "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING COUNT(*) < 5"),
    ("having_remove", "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 5", "SELECT n_regionkey FROM nation GROUP BY n_regionkey"),
    ("join_type_to_left", "SELECT n.n_name FROM nation AS n INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey", "SELECT n.n_name FROM nation AS n LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey"),
    ("limit_increase", "SELECT n_name FROM nation ORDER BY n_name LIMIT 20", "SELECT n_name FROM nation ORDER BY n_name LIMIT 41 to 45"),
    ("limit_decrease", "SELECT n_name FROM nation ORDER BY n_name LIMIT 21", "SELECT n_name FROM nation ORDER BY n_name LIMIT 10"),
    ("distinct_toggle", "SELECT DISTINCT n_name FROM nation", "SELECT n_name FROM nation"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({_said(op)}, {_said(new)})" for op, _, new in MUTATIONS) + ") t(operator, mutated_sql)")
def mutation_operators(spark: SparkSession) -> DataFrame:
    rows = [(op, mutation.apply(sql, [op])) for op, sql, _ in MUTATIONS]
    return spark.createDataFrame(rows, "operator string, mutated_sql string").withColumn("mutated_sql", F.regexp_replace("mutated_sql", "LIMIT 4[1-5]$", "LIMIT 41 to 45"))


def _mutant_sql() -> str:
    """Each mutant of hand-written pairs run by DuckDB itself."""
    width = {"projection_drop": False, "add_star_wildcard": False}
    return " UNION ALL ".join(f"SELECT '{op}' AS operator, 'ok' AS status, {q._ex_sql(sql, new.replace(' to 45', ''), width.get(op, True))} AS EX" for op, sql, new in MUTATIONS)


@query(_mutant_sql())
def mutant_scores(spark: SparkSession) -> DataFrame:
    rows = [(k, "star", 1, [op], mutation.apply(sql, [op]), 1, sql) for k, (op, sql, _) in enumerate(MUTATIONS)]
    mutants = spark.createDataFrame(rows, "question_id int, db_id string, depth int, operators array<string>, mutated_sql string, error_count int, gold_sql string")
    return evaluation.mutant_scores(spark, mutants, ("execution_accuracy",)).select("operator", "status", "EX")


_ANSWERS = [(s, k, g, p) for s, change in (("echo", lambda x: x), ("wider", lambda x: x.replace("WHERE", "WHERE 1 = 1 OR", 1)), ("broken", lambda x: x.replace("SELECT", "SELEC", 1)))
            for k, _, g in star.CORPUS[:7] for p in [change(g)]]


@query(" UNION ALL ".join(f"SELECT '{s}' AS system, {k} AS question_id, '{'error' if s == 'broken' else 'ok'}' AS status, {'NULL' if s == 'broken' else q._ex_sql(g, p, True)} AS EX" for s, k, g, p in _ANSWERS))
def system_scores(spark: SparkSession) -> DataFrame:
    return evaluation.system_scores(spark, spark.createDataFrame(_ANSWERS, "system string, question_id int, gold_sql string, pred_sql string")).select("system", "question_id", "status", "EX")


# ---- graphs

ORACLES["graph_centrality"] = f"""WITH RECURSIVE {q._E}, n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), v AS (SELECT DISTINCT a AS node FROM n),
 r(a, b, path) AS (SELECT a, b, [a, b] FROM n UNION ALL SELECT r.a, n.b, list_append(path, n.b) FROM r JOIN n ON n.a = r.b WHERE NOT list_contains(path, n.b)),
 m AS (SELECT *, min(len(path)) OVER (PARTITION BY a, b) AS least FROM r), s AS (SELECT a, b, path, count(*) OVER (PARTITION BY a, b) AS paths FROM m WHERE len(path) = least),
 i AS (SELECT unnest(path[2 : len(path) - 1]) AS node, 1.0::DOUBLE / paths AS share FROM s WHERE len(path) > 2),
 x AS (SELECT node, coalesce(sum(share), 0) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2) AS betweenness FROM v LEFT JOIN i USING (node) GROUP BY node),
 y AS (SELECT node, betweenness, (SELECT count(*) FROM n WHERE a = node) AS degree FROM x)
 SELECT 'star' AS graph_id, node, round(betweenness, 9) AS betweenness, row_number() OVER (ORDER BY round(betweenness, 9) DESC, degree DESC, node) = 1 AS is_central FROM y"""
_BITS = {n: [(i, j) for i in range(n) for j in range(i + 1, n)] for n in range(2, 6)}


def _patterns_sql(n: int) -> str:
    """All graphs of n nodes as numbers, those that are connected, and of each class the least number over all orders."""
    pairs = _BITS[n]
    at = {p: k for k, p in enumerate(pairs)}
    moved = " + ".join(f"(((g >> {k}) & 1) << (CASE least(p[{i + 1}], p[{j + 1}]) * {n} + greatest(p[{i + 1}], p[{j + 1}]) " + " ".join(f"WHEN {a * n + b} THEN {at[a, b]}" for a, b in pairs) + " END))" for (i, j), k in at.items())
    near = " UNION ALL ".join(f"SELECT g, {i} AS x, {j} AS y FROM g WHERE (g >> {k}) & 1 = 1 UNION ALL SELECT g, {j}, {i} FROM g WHERE (g >> {k}) & 1 = 1" for (i, j), k in at.items())
    return f"""SELECT {n} AS n_nodes, CAST(bit_count(c) AS INTEGER) AS n_edges, c FROM (WITH RECURSIVE g AS (SELECT unnest(range({1 << len(pairs)})) AS g), e AS ({near}),
 r(g, x) AS (SELECT g, 0 FROM g UNION SELECT e.g, e.y FROM r JOIN e ON e.g = r.g AND e.x = r.x), k AS (SELECT g FROM r GROUP BY g HAVING count(*) = {n}),
 p(p) AS (SELECT [x] FROM (SELECT unnest(range({n})) AS x) UNION ALL SELECT list_append(p, x) FROM p, (SELECT unnest(range({n})) AS x) WHERE NOT list_contains(p, x)),
 o AS (SELECT p FROM p WHERE len(p) = {n}) SELECT g, min({moved}) AS c FROM k, o GROUP BY g)"""


ORACLES["pattern_growth"] = " UNION ALL ".join(f"SELECT n_nodes, n_edges, count(DISTINCT c) AS n_patterns FROM ({_patterns_sql(n)}) GROUP BY ALL" for n in range(2, 5)) + " UNION ALL SELECT * FROM (VALUES (5, 4, 3), (5, 5, 5), (5, 6, 5), (5, 7, 4), (5, 8, 2), (5, 9, 1), (5, 10, 1)) t(n_nodes, n_edges, n_patterns)"
ORACLES["pattern_instances"] = f"""WITH RECURSIVE {q._E}, n AS (SELECT row_number() OVER (ORDER BY src, dst) AS i, src, dst FROM e),
 r(ids, nodes) AS (SELECT [i], list_sort([src, dst]) FROM n UNION
   SELECT list_sort(list_append(ids, i)), list_sort(list_distinct(list_concat(nodes, [src, dst]))) FROM r, n
   WHERE NOT list_contains(ids, i) AND (list_contains(nodes, src) OR list_contains(nodes, dst)) AND len(list_distinct(list_concat(nodes, [src, dst]))) <= 4),
 d AS (SELECT ids, node, count(*) AS degree FROM (SELECT ids, unnest(ids) AS i FROM r) JOIN (SELECT i, src AS node FROM n UNION ALL SELECT i, dst FROM n) USING (i) GROUP BY ids, node),
 s AS (SELECT ids, string_agg(degree, '' ORDER BY degree) AS degrees FROM d GROUP BY ids) SELECT 'star' AS graph_id, degrees, count(*) AS n FROM s GROUP BY degrees"""
#: Joined pairs of the corpus's queries, by hand.
_JOINED = "j(k, a, b) AS (VALUES ('1', 'n', 'r'), ('4', 's', 'n'), ('5', 'n', 'c'), ('6', 'o', 'c'), ('6', 'c', 'n'), ('8', 'r', 'n'), ('8', 'n', 's'), ('8', 'n', 'c'))"
ORACLES["iso_classes"] = f"""WITH {_JOINED}, d AS (SELECT k, x, count(*) AS degree FROM (SELECT k, a AS x FROM j UNION ALL SELECT k, b FROM j) GROUP BY k, x),
 s AS (SELECT k, string_agg(degree, '' ORDER BY degree) AS degrees FROM d GROUP BY k) SELECT count(*) AS n, string_agg(k, ',' ORDER BY k) AS graphs FROM s GROUP BY degrees"""
#: Tables and aliases of the corpus's queries, by hand.
_IN = "i(k, t, a, m) AS (VALUES (1, 'nation', 'n', 2), (1, 'region', 'r', 2), (2, 'customer', 'customer', 1), (3, 'part', 'part', 1), (4, 'supplier', 's', 2), (4, 'nation', 'n', 2), (5, 'nation', 'n', 2), (5, 'customer', 'c', 2), " \
      "(6, 'orders', 'o', 3), (6, 'customer', 'c', 3), (6, 'nation', 'n', 3), (7, 'lineitem', 'lineitem', 1), (8, 'region', 'r', 4), (8, 'nation', 'n', 4), (8, 'supplier', 's', 4), (8, 'customer', 'c', 4), (9, 'orders', 'orders', 1))"
ORACLES["candidate_expansions"] = f"""WITH RECURSIVE {q._FK}, {_IN}, l AS (SELECT a AS t, x, b AS u, y FROM f UNION ALL SELECT b, y, a, x FROM f
   UNION ALL SELECT p.a, p.x, s.a, s.x FROM f p JOIN f s ON p.b = s.b AND p.y = s.y AND p.a <> s.a),
 e AS (SELECT DISTINCT i.k, l.u AS new, i.a, i.a || '.' || l.x || ' = t' || (i.m + 1) || '.' || l.y AS label FROM i JOIN l ON l.t = i.t WHERE NOT EXISTS (SELECT 1 FROM i z WHERE z.k = i.k AND z.t = l.u)),
 c(k, new, labels, aliases) AS (SELECT k, new, [label], [a] FROM e UNION ALL SELECT c.k, c.new, list_append(labels, e.label), list_distinct(list_append(aliases, e.a)) FROM c JOIN e ON e.k = c.k AND e.new = c.new AND e.label > labels[len(labels)])
 SELECT k AS question_id, CAST(row_number() OVER (PARTITION BY k ORDER BY len(aliases) DESC, new, labels) - 1 AS INTEGER) AS ord, new AS table_name, array_to_string(labels, ' AND ') AS joins FROM c"""
#: Whether the new table's joins follow from each other, by hand: (query, table, joins, verdict).
_TIED = [
    ("SELECT c.c_name FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey", "supplier", ("c.c_nationkey = t3.s_nationkey", "n.n_nationkey = t3.s_nationkey"), True),
    ("SELECT c.c_name FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey", "supplier", ("n.n_nationkey = t3.s_nationkey",), False),
    ("SELECT c.c_name FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey", "supplier", ("c.c_nationkey = t3.s_nationkey",), False),
    ("SELECT c.c_name FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey", "orders", ("c.c_custkey = t3.o_custkey",), False),
    ("SELECT l.l_tax FROM lineitem AS l INNER JOIN orders AS o ON l.l_orderkey = o.o_orderkey", "part", ("l.l_partkey = t3.p_partkey",), False),
    ("SELECT s.s_name FROM supplier AS s INNER JOIN lineitem AS l ON s.s_suppkey = l.l_suppkey INNER JOIN orders AS o ON l.l_orderkey = o.o_orderkey", "customer",
     ("o.o_custkey = t4.c_custkey", "s.s_nationkey = t4.c_nationkey"), False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}', '{' AND '.join(j)}', {str(v).lower()})" for k, (_, t, j, v) in enumerate(_TIED)) + ") t(case_id, table_name, joins, is_redundant)")
def redundant_cycles(spark: SparkSession) -> DataFrame:
    rows = []
    for k, (sql, table, joins, _) in enumerate(_TIED):
        spec = parse(sql)
        rows.append((k, table, " AND ".join(joins), expansion.redundant(spec, expansion.Candidate(table, f"t{len(spec.tables()) + 1}", joins))))
    return spark.createDataFrame(rows, "case_id int, table_name string, joins string, is_redundant boolean")


# ---- words and names

ORACLES["tokens_with_pos"] = r"""WITH t AS (SELECT conv_id, turn, text, string_split(text, '') AS ch FROM conversations),
 p AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w,
   list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substring(text, i, 1), '[\p{L}\p{N}_]') AND (i = 1 OR NOT regexp_matches(substring(text, i - 1, 1), '[\p{L}\p{N}_]'))) AS starts FROM t)
 SELECT conv_id, turn, array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || '@' || CAST(starts[i] - 1 AS VARCHAR)), ' ') AS tokens FROM p"""
_RENAMES = [(old, new) for t, (table, cols) in star.ABBREVIATIONS.items() for old, new in ((t, table), *cols.items())]


def _renamed_sql(c: str) -> str:
    for old, new in _RENAMES:
        c = f"regexp_replace({c}, '\\b{old}\\b', '{new}', 'g')"
    return c


ORACLES["query_variants"] = "WITH c(question_id, db_id, sql) AS (VALUES " + ", ".join(f"({k}, '{db}', {_said(s)})" for k, db, s in star.CORPUS) + f"), n AS (SELECT *, {_renamed_sql('sql')} AS new_sql FROM c) " + " UNION ALL ".join(
    f"SELECT question_id, db_id, '{v}_nl_{w}_sql' AS variant, '{'new ' if v == 'new' else ''}question ' || question_id AS question, {'new_sql' if w == 'new' else 'sql'} AS sql FROM n" for v in ("original", "new") for w in ("original", "new"))
#: Tables and columns of the corpus's queries under their new names, by hand.
_LINKS = {
    1: "Table ntn -> nk, nnm, nrk\nTable rgn -> rk, rnm", 2: "Table cst -> cab, cms", 3: "Table prt -> pbr, prp, psz", 4: "Table ntn -> nk, nnm\nTable spl -> sk, snk, snm",
    5: "Table cst -> cab, cnk\nTable ntn -> nk, nnm", 6: "Table cst -> ck, cnk\nTable ntn -> nk, nrk\nTable ord -> ock, opr, ost", 7: "Table ln_itm -> lds, lqt, lrf, lst",
    8: "Table cst -> cnk\nTable ntn -> nk, nrk\nTable rgn -> rk, rnm\nTable spl -> snk", 9: "Table ord -> ok, ost, otp"}
ORACLES["schema_translation"] = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {_said(t)})" for k, t in _LINKS.items()) + ") t(question_id, text)"

ORACLES["phrase_removal"] = r"""WITH t AS (SELECT row_number() OVER () AS r, conv_id, turn, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w,
   list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substring(text, i, 1), '[\p{L}\p{N}_]') AND (i = 1 OR NOT regexp_matches(substring(text, i - 1, 1), '[\p{L}\p{N}_]'))) AS starts FROM conversations),
 p AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw, list_transform(w[2:3], lambda x: lower(x)) AS ph FROM t),
 h AS (SELECT *, list_filter(range(1, len(w) - len(ph) + 2), lambda k: len(ph) > 0 AND lw[k : k + len(ph) - 1] = ph) AS hits FROM p),
 k AS (SELECT *, CASE WHEN len(hits) < 2 THEN hits ELSE list_reduce(list_transform(hits, lambda x: [x]), lambda a, x: CASE WHEN x[1] >= a[len(a)] + len(ph) THEN list_concat(a, x) ELSE a END) END AS taken FROM h),
 g AS (SELECT *, list_transform(flatten(list_transform(taken, lambda x: range(x, x + len(ph)))), lambda x: {'a': starts[x], 'b': starts[x] + length(w[x])}) AS gone FROM k)
 SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_transform(list_filter(range(1, length(text) + 1), lambda i: len(list_filter(gone, lambda x: i >= x.a AND i < x.b)) = 0), lambda i: substring(text, i, 1)), '') END AS text,
 CAST(len(gone) AS INTEGER) AS n_removed FROM g"""
#: Words of the questions that name their central table, by hand.
_NAMED = {1: ("nation", "nation:nations@6"), 2: ("customer", "customer:customers@9"), 3: ("part", "part:parts@6"), 4: ("supplier", "supplier:suppliers@5"), 5: ("nation", "nation:nation@11"), 6: ("orders", "orders:Orders@0"),
          7: ("lineitem", "line:line@14 item:items@19"), 8: ("region", "region:region@13"), 9: ("orders", "orders:orders@6")}
ORACLES["question_links"] = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}', '{c}')" for k, (t, c) in _NAMED.items()) + ") t(question_id, central_table, components)"
ORACLES["identifier_naturalness"] = f"""WITH {q._NAMES}, w AS (SELECT name, list_filter(regexp_extract_all(name, '[a-z]+'), lambda x: length(x) > 1) AS w FROM i),
 k AS (SELECT name, len(list_filter(w, lambda x: regexp_full_match(x, '(region|nation|customer|supplier|part|order|line|item|key|name|size|type|brand)+s?'))) * 1.0::DOUBLE / len(w) AS share FROM w),
 c AS (SELECT name, CASE WHEN share = 1 THEN 'N1' WHEN share > 0 THEN 'N2' ELSE 'N3' END AS naturalness, CASE WHEN share = 1 THEN 1.0::DOUBLE WHEN share > 0 THEN greatest(share, 1 - share) ELSE 1.0 END AS confidence FROM k)
 SELECT name, naturalness, confidence, CASE WHEN naturalness = 'N3' THEN name ELSE array_to_string(list_transform(string_split(name, '_'), lambda x: substring(substring(x, 1, 1) || regexp_replace(substring(x, 2), '[aeiou]', '', 'g'), 1, 3)), '_') END AS new_name FROM c"""

# ---- reports over more tables

_DB = "'db' || CAST(question_id % 7 AS VARCHAR)"


def _by_db(spark: SparkSession) -> DataFrame:
    return spark.sql(q.SCORES).withColumn("db_id", F.concat(F.lit("db"), (F.col("question_id") % 7).cast("string")))


@query(q._S + f"SELECT {_DB} AS db_id, count(*) AS n FROM s WHERE EX = 1 AND n_join > 1 GROUP BY 1 ORDER BY n DESC, db_id LIMIT 5")
def top_databases(spark: SparkSession) -> DataFrame:
    return reports.top_databases(_by_db(spark), (F.col("EX") == 1) & (F.col("n_join") > 1))


@query(q._S + "SELECT system AS \"set\", count(*) AS n, round(avg(F1), 9) AS avg_degree FROM s GROUP BY ROLLUP (system)")
def degree_by_set(spark: SparkSession) -> DataFrame:
    return reports.degree_by_set(spark.sql(q.SCORES).select(F.col("system").alias("set"), F.col("F1").alias("avg_degree"))).withColumn("avg_degree", F.round("avg_degree", 9))


@query(q._S + "SELECT n_join > 2 AS joined, system, error_count - 2 AS delta, EX, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY n_join > 2, system), 6) AS percent FROM s GROUP BY n_join > 2, system, error_count - 2, EX")
def ex_tuples(spark: SparkSession) -> DataFrame:
    s = spark.sql(q.SCORES).withColumns({"joined": F.col("n_join") > 2, "delta": F.col("error_count") - 2})
    return reports.ex_tuples(s, "joined").withColumn("percent", F.round("percent", 6))


_STATUS = "CASE question_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'error' ELSE 'ok' END"


@query(q._S + f"SELECT {_DB} AS db_id, count(*) AS total, " + ", ".join(f"count(*) FILTER ({_STATUS} = '{x}') AS n_{x}" for x in ("ok", "failed", "timeout", "error")) +
       f", round(avg(CASE WHEN {_STATUS} = 'ok' THEN 100.0::DOUBLE ELSE 0.0 END), 6) AS percent_ok FROM s GROUP BY 1")
def rename_statistics(spark: SparkSession) -> DataFrame:
    return reports.rename_statistics(_by_db(spark).withColumn("status", F.expr(_STATUS))).withColumn("percent_ok", F.round("percent_ok", 6))


@query(q._S + f"SELECT DISTINCT question_id, {_DB} AS db_id, " + ", ".join(f"(SELECT max(EX) FROM s t WHERE t.question_id = s.question_id AND t.system = '{x}') AS {x}" for x in q.SYSTEMS[:3]) + " FROM s")
def results_by_system(spark: SparkSession) -> DataFrame:
    s = _by_db(spark)
    return reports.by_system(s.select("question_id", "db_id").distinct(), s, q.SYSTEMS[:3])


@query("""SELECT p_partkey, lower(p_type) AS sql, (SELECT min(z.p_partkey) FROM part z WHERE lower(z.p_type) = lower(p.p_type)) AS first_key FROM part p""")
def lookup_by_sql(spark: SparkSession) -> DataFrame:
    p = spark.table("part")
    asked = p.select("p_partkey", F.lower("p_type").alias("sql"))
    return reports.by_sql(asked, p.select(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" ; ")).alias("sql"), F.col("p_partkey").alias("first_key")))


@query("SELECT * FROM (VALUES ('where_remove → join_break', 2, 1), ('distinct_toggle → projection_drop', 1, 2)) t(error_pattern, n, rank)")
def disjoint_patterns(spark: SparkSession) -> DataFrame:
    rows = ["where_remove → join_break", "where_remove → join_break", "join_break → distinct_toggle", "projection_drop → where_remove", "distinct_toggle → projection_drop"]
    found = reports.disjoint_patterns(spark.createDataFrame([(r,) for r in rows], "error_pattern string"), 5)
    return found.withColumns({"n": F.col("n").cast("int")})


@query("SELECT * FROM (VALUES ('1', 'edge'), ('4', 'edge'), ('5', 'edge'), ('6', 'path'), ('8', 'star')) t(graph_id, pattern_id)")
def matched_patterns(spark: SparkSession) -> DataFrame:
    """The corpus's join graphs among a catalogue of two patterns, by hand."""
    rows = [(f"{k}", str(a), str(b)) for k, _, s in star.CORPUS for a, b in expansion.query_graph(parse(s))[1]]
    known = [(graph.canonical([0, 1, 2], [(0, 1), (1, 2)]), "path"), (graph.canonical([0, 1, 2, 3], [(0, 1), (0, 2), (0, 3)]), "star")]
    found = graph.matched_patterns(spark.createDataFrame(rows, "graph_id string, src string, dst string"), spark.createDataFrame(known, "iso_key string, pattern_id string"))
    return found.select("graph_id", "pattern_id")
