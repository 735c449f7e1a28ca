from __future__ import annotations

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import expansion, graph, linking, mutation, naturalness, rename, reports, sampling
from plumbline.plans import star
from plumbline.plans.queryspec import NotFlat, gold_links, is_nested, join_conditions, parse, structure

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    star.register(spark, FOLDER)
    return spark


@pytest.mark.parametrize("sql", [q for _, _, q in star.CORPUS])
def test_round_trip_is_equivalent(tables, sql):
    again = parse(sql).sql()
    assert parse(again) == parse(sql)
    a, b = tables.sql(sql), tables.sql(again)
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("sql", ["WITH t AS (SELECT 1) SELECT * FROM t", "SELECT a FROM t UNION SELECT b FROM u", "SELECT a FROM (SELECT 1 AS a) t", "SELECT a FROM t WHERE a IN (SELECT b FROM u)", "", "%%%"])
def test_nested(sql):
    assert is_nested(sql)
    with pytest.raises(NotFlat):
        parse(sql)


def test_structure_and_links():
    s = structure(parse(star.CORPUS[7][2]))
    assert (s["num_nodes"], s["num_edges"], s["num_joins"], s["is_cyclic"], s["has_having"]) == (4, 3, 3, False, True)
    assert join_conditions(parse(star.CORPUS[4][2]), False) == ["customer.c_nationkey = nation.n_nationkey"]
    assert gold_links(parse(star.CORPUS[2][2])) == {"part": ["p_brand", "p_retailprice", "p_size"]}


def test_every_operator_fires_and_errs_are_found(tables):
    fired = {}
    for _, _, q in star.CORPUS:
        for _, (op,), m in mutation.suite(q, 1):
            fired.setdefault(op, []).append((q, m))
    assert set(fired) == set(mutation.OPERATORS)
    for op, pairs in fired.items():
        for q, m in pairs:
            assert parse(m) and m != q
            if op not in ("aggregation_swap", "add_star_wildcard"):  # the sum of all columns, and a star beside groups, aren't valid
                tables.sql(m)


def test_suites_are_deterministic_and_respect_conflicts(spark):
    a, b = (mutation.mutants(spark, star.CORPUS, 2).collect() for _ in range(2))
    assert a == b
    for r in a:
        assert not any(frozenset(p) in mutation.CONFLICTS for p in zip(r.operators, r.operators[1:]))
        assert r.error_count == r.depth == len(r.operators)
    rich = "SELECT n_name, n_regionkey FROM nation INNER JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3 AND r_regionkey < 4 ORDER BY n_name LIMIT 20"
    used = {tuple(ops) for _, ops, _ in mutation.suite(rich)}
    assert {("where_condition_flip", "where_remove"), ("projection_drop", "add_star_wildcard"), ("limit_increase", "limit_increase"), ("join_type_to_left", "projection_drop")} <= used
    assert not used & {("where_strengthen", "where_weaken"), ("limit_increase", "limit_decrease"), ("where_remove", "where_remove")}


def test_chains(spark):
    rows = [(1, 1, ["a"]), (1, 2, ["a", "b"]), (1, 2, ["c", "b"]), (2, 2, ["a", "b"])]
    got = reports.chains(spark.createDataFrame(rows, "question_id int, depth int, operators array<string>"), 2).collect()
    assert [(r.question_id, r.error_pattern) for r in got] == [(1, "a → b")]


def test_isomorphism():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(2, 7)
        e = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.5]
        p = list(range(n))
        rng.shuffle(p)
        assert graph.canonical(list(range(n)), e) == graph.canonical(list(range(n)), [(p[a], p[b]) for a, b in e])
    assert [sum(n == k for n, _ in graph.patterns(5)) for k in range(2, 6)] == [1, 2, 6, 21]
    assert graph.canonical([0, 1, 2, 3], [(0, 1), (1, 2), (2, 3)]) != graph.canonical([0, 1, 2, 3], [(0, 1), (0, 2), (0, 3)])
    nine, other = [(k, (k + 1) % 9) for k in range(9)], [(k, (k + 2) % 9) for k in range(9)]
    assert graph.canonical(list(range(9)), nine) == graph.canonical(list(range(9)), other) != graph.canonical(list(range(9)), [*nine[:5], (5, 0), (6, 7), (7, 8), (8, 6)])
    assert graph.canonical(list(range(12)), []) == "12:" + "0" * 66 and graph.canonical([1, 2], [(1, 2)]) == "2:1"


def test_degrees_tell_most_graphs_apart():
    rng, told = random.Random(2), 0
    for _ in range(60):
        a, b = ([(x, y) for x in range(5) for y in range(x) if rng.random() < 0.5] for _ in range(2))
        same = any(sorted(tuple(sorted((p[x], p[y]))) for x, y in a) == sorted(tuple(sorted(e)) for e in b) for p in permutations(range(5)))
        nodes = list(range(5))
        assert graph.isomorphic((nodes, a), (nodes, b)) == same
        assert not same or graph.degree_encoding(nodes, a) == graph.degree_encoding(nodes, b)
        told += not same and graph.degree_encoding(nodes, a) != graph.degree_encoding(nodes, b)
    assert told > 40
    hexagon, triangles = [(k, (k + 1) % 6) for k in range(6)], [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]
    assert graph.degree_encoding(list(range(6)), hexagon) == graph.degree_encoding(list(range(6)), triangles) and not graph.isomorphic((list(range(6)), hexagon), (list(range(6)), triangles))


def test_cycles_and_centrality():
    square = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c")]
    assert [len(c) for c in graph.simple_cycles(square)] == [3, 3, 4]
    star_ = [("m", x) for x in "abc"]
    assert graph.betweenness(list("abcm"), star_)["m"] == 1.0 and graph.central_node(list("abcm"), star_) == "m" and graph.central_node(["a", "b"], [("a", "b")]) is None
    assert graph.instances(list("abcm"), star_, 3) == {"2:1": 3, graph.canonical([0, 1, 2], [(0, 1), (0, 2)]): 3}


def test_components_of_long_paths(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    got = graph.components(spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)], "a long, b long")).collect()
    assert {(r.a, r.b) for r in got} == {(k, 0) for k in range(1, n)} | {(1001, 1000)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_expansion(tables):
    schema = expansion.schema_of(graph.schema_edges(star.foreign_keys(tables)))
    spec = parse("SELECT c.c_name FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey")
    found = expansion.candidates(spec, schema)
    supplier = [c for c in found if c.table == "supplier"]
    assert len(supplier) == 3 and len(supplier[0].joins) == 2  # both edges, then each
    assert [expansion.redundant(spec, c) for c in supplier] == [True, False, False]
    assert {c.table for c in found} == {"supplier", "region", "orders"}
    for c in found:
        tables.sql(expansion.extend(spec, c).sql())
    one = expansion.extend(parse("SELECT n_name, COUNT(*) AS n FROM nation WHERE n_name <> 'n_name' GROUP BY n_name"), expansion.Candidate("region", "t2", ("nation.n_regionkey = t2.r_regionkey",)))
    assert "nation.n_name <> 'n_name'" in one.sql() and tables.sql(one.sql()).columns == ["n_name", "n"]


def test_budget(spark):
    rows = [(1, k, "t", [], False, "x" if k % 2 else "y", "s") for k in range(6)]
    got = expansion.accepted(spark.createDataFrame(rows, "question_id int, ord int, table_name string, joins array<string>, is_redundant boolean, iso_key string, sql string"), 5, 2).collect()
    assert {(r.ord, r.status) for r in got} == {(0, "filtered"), (1, "filtered"), (2, "filtered"), (3, "filtered"), (4, "discarded")}


def test_meaningful_and_fill(tables):
    assert not expansion.meaningful(tables, "SELECT count(*) FROM region WHERE r_regionkey < 0") and not expansion.meaningful(tables, "SELECT r_name FROM region WHERE r_regionkey < 0")
    assert expansion.meaningful(tables, "SELECT count(*) FROM region") and expansion.meaningful(tables, "SELECT 0 FROM region LIMIT 1")
    several = ["SELECT count(*) FROM region WHERE r_regionkey < 0", "SELECT r_name FROM region WHERE r_regionkey < 0", "SELECT count(*) FROM region", "SELECT 0 FROM region LIMIT 1", "SELECT nope FROM region",
               "SELECT r_name, max(r_regionkey) AS m FROM region GROUP BY r_name", "SELECT max(r_name) FROM region", "SELECT min(r_regionkey) IS NULL FROM region", "SELECT CAST(max(r_name) AS INT) FROM region", "SELECT max(NULL) FROM region"]
    want = [False, False, True, True, False, True, True, False, False, False]
    assert expansion.all_meaningful(tables, several) == want == expansion.all_meaningful(tables, several, 60, 3) and expansion.all_meaningful(tables, []) == []
    assert expansion.existing("SELECT DISTINCT r_name, max(r_regionkey) AS m FROM region WHERE r_name > 'A' GROUP BY r_name ORDER BY m LIMIT 3") == "SELECT 1 AS one, 1 AS two FROM region WHERE r_name > 'A'"
    assert all(expansion.existing(q) == q for q in ("SELECT count(*) FROM region", "SELECT r_name, count(*) FROM region GROUP BY r_name HAVING count(*) > 1", "SELECT r_name, CAST(r_name AS INT) FROM region", "SELECT 1 UNION SELECT 2"))
    many = "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > {}"
    assert expansion.shown(many.format(2)) and not expansion.shown(many.format(2).replace(">", "<")) and expansion.all_meaningful(tables, [many.format(4), many.format(5), many.format(5).replace("> 5", "< 6")]) == [True, False, True]
    assert [expansion.meaningful(tables, q) for k, q in enumerate(several) if k not in (4, 8)] == [w for k, w in enumerate(want) if k not in (4, 8)]
    assert expansion.fill("a = ? AND b = ? AND c = ?", ["it's ?", None, 3]) == "a = 'it''s ?' AND b IS NULL AND c = 3"


def test_renaming_keeps_results(tables):
    m = rename.mapping_of(star.mapping(tables), "star")
    assert rename.apply_renames(tables, m) == [] and rename.apply_renames(tables, {"nope": ("x", {})}) == [("nope", "table")]
    assert rename.validate_renames(tables, star.mapping(tables)).isEmpty()
    assert [r.ex for r in rename.validate_rewritten(tables, [(k, q) for k, _, q in star.CORPUS], m).collect()] == [1] * len(star.CORPUS)
    assert rename.rewrite("SELECT n_name FROM nation WHERE n_name = 'nation n_name'", m) == "SELECT nnm FROM ntn WHERE nnm = 'nation n_name'"
    assert rename.duplicate_names(star.mapping(tables)).isEmpty()


def test_words():
    assert text.without_phrase("The Big cat, the big dog", "the big") == ("  cat,   dog", [("The", 0), ("Big", 4), ("the", 13), ("big", 17)])
    assert text.replaced_at("show all orders now", [(9, "sales"), (0, "list")]) == "list all sales now"
    assert text.identifier_words("CustomerOrders_part2") == ["customer", "orders", "part"]
    assert text.identifier_words("lineitem", frozenset({"line", "item"})) == ["line", "item"]
    assert [text.lemma(w) for w in ("orders", "parts", "cities", "class", "boxes")] == ["order", "part", "city", "class", "box"]
    assert text.without_parentheses("WHERE ((a.x = b.y)) AND (c = 1 OR d = 2)") == "WHERE a.x = b.y AND (c = 1 OR d = 2)"
    assert text.without_database_terms("show Paris orders by o_date", ["Paris"], ["o.o_date"]) == "show orders by"


def test_text_columns(spark):
    df = spark.createDataFrame([("C_cust-Id0 1é", "```json\n{}\n```", " SELECT  A ;; ", 12, 7, "{'EX': 1, 'EXP': 0.5, 'EXR': 1, 'F1': 0.7}")], "a string, b string, c string, d int, e int, f string")
    r = df.select(text.character_tags(F.col("a")).alias("tags"), text.without_fences(F.col("b")).alias("b"), text.normalised_sql(F.col("c")).alias("c"), text.encoded_id(F.col("d"), F.col("e")).alias("id"),
                  text.metrics_of(F.col("f")).alias("m"), text.subsequences(F.split(F.lit("a b c"), " "), 2).alias("s"), text.same_consonants(F.lit("qty"), F.lit("quantity")).alias("q"), text.same_consonants(F.lit("customer"), F.lit("cstmr")).alias("cc")).first()
    assert (r.tags, r.b, r.c, r.id, r.m.EX, r.m.F1) == ("+$+^++$^+**#*", "{}", "select a", 110012007, 1, 0.7)
    assert sorted(map(tuple, r.s)) == [("a", "b"), ("a", "b", "c"), ("b", "c")] and not r.q and r.cc


def test_naturalness(spark):
    names = spark.createDataFrame([("customer_name",), ("cust_name",), ("xq",), (None,)], "name string")
    got = {r.name: r for r in naturalness.decreased(naturalness.classified(names, naturalness.by_dictionary(frozenset({"customer", "name"})))).collect()}
    assert [got[k].naturalness for k in ("customer_name", "cust_name", "xq")] == ["N1", "N2", "N3"]
    assert got["customer_name"].new_name == "cst_nm" and got["xq"].new_name == "xq" and got[None].new_name is None


def test_linker(spark):
    rows = [(1, "How many orders did Paris place?", "orders", ["Paris"], ["o_date"]), (2, "Nothing here", "orders", [], [])]
    got = naturalness.linked(spark.createDataFrame(rows, "question_id int, question string, central_table string, literals array<string>, attributes array<string>")).collect()
    assert [r.question_id for r in got] == [1] and got[0].components[0].matched_tokens[0].position == 9
    assert naturalness.hidden(rows[0][1], [c.asDict(True) for c in got[0].components], {"orders": "purchases"}) == "How many purchases did Paris place?"


def test_linking(spark):
    df = spark.sql("SELECT 1 AS question_id, 'd' AS db_id, map('T', array('a', 'b')) AS g, map('t', array('A')) AS p, map('u', array('x')) AS q, cast(map() AS map<string,array<string>>) AS e")
    r = linking.scores(df, "g", "p").first()
    assert (r.precision, r.recall, r.slr) == (1.0, 0.5, 0) and round(r.f1, 6) == 0.666667
    assert linking.scores(df, "e", "q").first().slr == 1 and linking.scores(df, "g", "e").first().precision == 0.0
    mapping = spark.createDataFrame([("d", "T", "a", "tt", "aa")], "db_id string, table_name string, column_name string, new_table_name string, new_column_name string")
    assert linking.translated(df.select("question_id", "db_id", F.col("g").alias("schema")), mapping).first().schema == {"tt": ["aa", "b"]}


def test_sampling(spark):
    s = spark.createDataFrame([(q, f"m{q}{k}", op, int(q == 3), f"{op} → x") for q in range(8) for k, op in enumerate("abc")], "question_id int, mutated_sql string, operator string, EX int, error_pattern string")
    got = sampling.per_operator(s, 2).collect()
    assert len(got) == 6 and all(r.EX == 0 for r in got) and got == sampling.per_operator(s, 2).collect()
    assert sampling.questions(s, 3).select("question_id").distinct().count() == 3 and sampling.questions(s, 0.25).count() == 6
    assert sampling.without_solved(s).where("question_id = 3").isEmpty() and sampling.without_solved(s).count() == 21
    assert sampling.question_groups(s, 2).count() == 6


def test_queries_pickle_in_any_order(tables):
    """What one query has made in the session must not travel with the functions of the next."""
    from plumbline.plans.queries import QUERIES

    for name in ("phrase_removal", "tokens_with_pos", "question_links", "identifier_naturalness", "phrase_removal"):
        assert QUERIES[name](tables, FOLDER).count() > 0


def test_every_order_gives_one_form():
    """Against the least adjacency string over all orders: equal classes for all graphs of five nodes."""
    from itertools import combinations, permutations

    pairs = list(combinations(range(5), 2))
    forms: dict = {}
    for bits in range(0, 1 << 10, 3):
        e = [p for k, p in enumerate(pairs) if bits >> k & 1]
        has = {frozenset(x) for x in e}
        least = min("".join("01"[frozenset((o[i], o[j])) in has] for i, j in pairs) for o in permutations(range(5)))
        forms.setdefault(least, set()).add(graph.canonical(list(range(5)), e))
    assert all(len(v) == 1 for v in forms.values()) and len(set().union(*forms.values())) == len(forms)


def test_small_graph_facts(spark):
    assert graph.is_tree(["a", "b", "c"], [("a", "b"), ("b", "c")]) and not graph.is_tree(["a", "b", "c"], [("a", "b")]) and graph.find_cycle([("a", "b"), ("b", "c")]) is None
    assert graph.find_cycle([("a", "b"), ("b", "c"), ("c", "a")]) == ("a", "b", "c") and graph.degree_centrality(list("abc"), [("a", "b"), ("a", "c")]) == {"a": 1.0, "b": 0.5, "c": 0.5}
    edges = spark.createDataFrame([("p", "a", "b"), ("q", "a", "b"), ("q", "b", "c"), ("z", "a", "b"), ("z", "b", "c"), ("z", "c", "a")], "graph_id string, src string, dst string")
    known = spark.createDataFrame([(graph.canonical([0, 1, 2], [(0, 1), (0, 2)]), "chain")], "iso_key string, pattern_id string")
    assert {r.graph_id: r.pattern_id for r in graph.matched_patterns(edges, known).collect()} == {"p": "edge", "q": "chain", "z": None}


def test_more_text():
    assert text.dialect("SELECT STRPOS(a, 'x'), INSTR (b, 'y')", "parser") == "SELECT str_position(a, 'x'), str_position(b, 'y')" and text.dialect("STR_POSITION(a)") == "instr(a)"
    assert text.order_quoted("SELECT order.id FROM order WHERE a = 'order' ORDER BY Order.id") == "SELECT `order`.id FROM `order` WHERE a = 'order' ORDER BY `Order`.id"
    assert text.aliases(["customer", "city", "orders"]) == {"customer": "c", "city": "c2", "orders": "o"}
    assert text.partial_ratio("abc", "xxabcxx") == 100 and text.partial_ratio("abd", "abc") < 100 and text.partial_ratio("", "a") == 0
    assert text.alike()("cstmr", "customer") and not text.alike()("qty", "quantity") and text.alike(60)("qty", "quantity")


def test_more_text_columns(spark):
    df = spark.createDataFrame([("show all Orders now", "list all sales now", ["orders"])], "a string, b string, w array<string>")
    r = df.select(text.word_difference(F.col("a"), F.col("b")).alias("d"), text.token_count(F.lit("a, b (c)")).alias("n"), text.backticks_as_strings(F.lit("a = `x`")).alias("q"),
                  text.component_score(F.col("a"), F.col("b"), F.col("w")).alias("s"), text.component_score(F.col("a"), F.lit(" "), F.col("w")).alias("z"), text.component_score(F.lit(None).cast("string"), F.col("b"), F.col("w")).alias("none"),
                  text.mentions(text.lower_tokens(F.lit("the order date")), F.lit("o.order_date")).alias("m"), text.mentions(text.lower_tokens(F.lit("some cust x")), F.lit("customer_id")).alias("p"),
                  text.mentions(text.lower_tokens(F.lit("nothing")), F.lit("customer_id")).alias("no")).first()
    assert (r.d.removed, r.d.added, r.n, r.q, r.s, r.z, r.none, r.m, r.p, r.no) == (["show", "orders"], ["list", "sales"], 6, "a = 'x'", 1.0, 0.0, None, True, True, False)


def test_more_reports(spark):
    df = spark.createDataFrame([("a", "x → y", 1), ("b", "x → z", 1), ("a", "x → y", 0), ("c", "v → w", 1), ("a", "v → w", 0), ("b", "z → u", 1)], "db_id string, error_pattern string, flag int")
    assert [tuple(r) for r in reports.top_databases(df, F.col("flag") == 1, 2).collect()] == [("b", 2), ("a", 1)]
    assert [tuple(r) for r in reports.disjoint_patterns(df, 5).collect()] == [("v → w", 2, 1), ("x → y", 2, 2), ("z → u", 1, 3)]
    st = reports.rename_statistics(spark.createDataFrame([("a", "ok"), ("a", "error"), ("b", "timeout")], "db_id string, status string")).collect()
    assert {(r.db_id, r.total, r.n_ok, r.n_timeout, r.percent_ok) for r in st} == {("a", 2, 1, 0, 50.0), ("b", 1, 0, 1, 0.0)}
    left, right = spark.createDataFrame([(1, "SELECT  1;"), (2, "SELECT 2")], "k int, sql string"), spark.createDataFrame([("select 1", "z"), ("SELECT 1 ", "y")], "sql string, name string")
    assert sorted((r.k, r.name) for r in reports.by_sql(left, right).collect()) == [(1, "y"), (2, None)]
    s = spark.createDataFrame([(1, "d", "A", 1), (1, "d", "B", 0)], "question_id int, db_id string, system string, EX int")
    wide = reports.by_system(spark.createDataFrame([(1, "d"), (2, "d")], "question_id int, db_id string"), s, ["A", "B", "C"]).orderBy("question_id").collect()
    assert [tuple(r) for r in wide] == [(1, "d", 1, 0, None), (2, "d", None, None, None)]
    o = reports.with_originals(s, spark.createDataFrame([(1, "d", 1)], "question_id int, db_id string, EX int")).collect()
    assert {(r.system, r.original_EX, r.found) for r in o} == {("A", 1, True), ("B", 1, True)}
    assert reports.table_text(s.orderBy("system")).splitlines()[2].split() == ["1", "d", "A", "1"]
    t = reports.ex_tuples(s.withColumns({"delta": F.lit(0), "flag": F.lit(True)}), "flag").collect()
    assert len(t) == 2 and all(r.percent == 100.0 for r in t)
    d = reports.degree_by_set(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "set string, avg_degree double")).collect()
    assert {(r.set, r.n, r.avg_degree) for r in d} == {("a", 2, 1.5), ("b", 1, 3.0), (None, 3, 2.0)}


def test_attributes_and_records():
    from plumbline.plans.queryspec import central_attributes, record

    assert central_attributes(parse(star.CORPUS[0][2]), "nation") == {"joins": ["n_regionkey"], "projections_and_filters": ["n_name", "n_nationkey"]}
    assert central_attributes(parse(star.CORPUS[4][2]), "customer") == {"joins": ["c_nationkey"], "projections_and_filters": ["c_acctbal"]}
    assert record(1, "d", "SELECT a FROM t WHERE a IN (SELECT 1)")["is_nested"] and record(1, "d", star.CORPUS[3][2])["joins"] == ["s.s_nationkey = n.n_nationkey"]


def test_generated_queries(tables):
    rows = [("star", "nation", "n_name", 5, 0), ("star", "region", "r_name", 3, 4), ("star", "nation", "n_regionkey", 0, 2), ("star", "region", "r_regionkey", 0, 1)]
    freq = tables.createDataFrame(rows, "db_id string, table_name string, column_name string, projection_occurrences long, filtering_occurrences long")
    got = expansion.generate(tables, [("g", [("nation", "a"), ("region", "b")], ["a.n_regionkey = b.r_regionkey"])], freq, p=1, w=2).collect()
    assert len(got) == 1 and got[0].sql.startswith("SELECT DISTINCT a.n_name FROM nation AS a, region AS b WHERE a.n_regionkey = b.r_regionkey AND b.r_name = '") and tables.sql(got[0].sql).count() > 0
    assert expansion.filled(tables, [("nation", "a")], ["a.n_nationkey < 0"], ["a.n_name"], []) is None
    asked = tables.createDataFrame([("SELECT 1", "s", "q?")], "sql string, schema string, question string")
    answer = expansion.worded(asked, "explicit", lambda: lambda prompts: [p.splitlines()[0] for p in prompts]).first()
    assert answer.explicit == "Query: SELECT 1"
