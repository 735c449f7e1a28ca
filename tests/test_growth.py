"""What grows faster than the input: rows that are shuffled or compared, counted."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import embed
from plumbline.operators import expansion, matching, partners, techniques, tiers, words


def shuffled(spark, run):
    """The result of ``run``, and how many rows its stages wrote for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found, it = {}, store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
        while it.hasNext():
            s = it.next()
            found[s.stageId(), s.attemptId()] = s.shuffleWriteRecords()
        return found

    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_stretches_of_names_stay_where_they_are(spark, monkeypatch):
    """a stretch is shuffled only if it may be a word that isn't common; before, all of them were."""
    names = spark.range(3000).selectExpr("concat('customer', translate(string(id), '0123456789', 'abcdefghij'), 'orders') AS n")
    v = spark.createDataFrame([("customer", 9), ("orders", 7), ("order", 3), ("s", 3), ("tomer", 1), ("cus", 1), ("q", 1)], "word string, n long")
    all_, rows = shuffled(spark, lambda: sorted(map(tuple, words.segmented(names, "n", v).collect())))
    assert len(all_) == 3000 and rows < 10_000
    monkeypatch.setattr(words, "LEXICON", 3)
    few, rows = shuffled(spark, lambda: sorted(map(tuple, words.segmented(names, "n", v).collect())))
    assert few == all_ and rows < 60_000
    assert {r[0]: r[2] for r in few}["customerjorders"] == ["customer", "j", "orders"]


def test_equal_rows_meet_no_others(spark, monkeypatch):
    """texts with an equal partner take it; before, all of them met all of the other side."""
    met = []
    best = partners.best
    monkeypatch.setattr(partners, "best", lambda left, right, *more: (met.append(left.count()), best(left, right, *more))[1])
    texts = lambda *x: spark.createDataFrame([(t,) for t in x], "text string")
    many = [f"name {k}" for k in range(300)]
    assert partners.undisputed(texts(*many), texts(*many[:200], many[0]), embed.hashed_ngrams) is None
    assert partners.undisputed(texts(*many), texts(*many[:200]), embed.hashed_ngrams) == 200.0 and not met
    got = partners.undisputed(texts(*many, "quite another"), texts(*many[:200], "quite another one"), embed.hashed_ngrams)
    assert met == [1] and 200 < got < 201


def test_cosines_of_pairs_are_not_shuffled(spark, monkeypatch):
    """blocks keep what can be among the first; before, each pair was a shuffled row."""
    import random

    from plumbline.plans.queries import QUERIES

    _, rows = shuffled(spark, lambda: QUERIES["cosine_topk"](spark, "/root/testdata/sf0.001").collect())
    n = spark.table("embeddings").count()
    assert rows < 3 * n < n * (n // 50)
    rng = random.Random(4)
    odd = [None, [1.0, None, 2.0], [1.0], [], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [0.0, 0.0, 0.0]]
    vectors = [[float(rng.randrange(-3, 4)) for _ in range(3)] for _ in range(90)] + odd + [[1.0, 2.0, 3.0]] * 9
    x = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    asked = x.where("vec_id % 10 = 0").selectExpr("vec_id AS q", "embedding AS e")
    monkeypatch.setattr(partners, "ROWS", 20)
    got = sorted(map(str, map(tuple, partners.most_similar(asked, x, 5, 6).collect())))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        sims = x.join(asked, x["vec_id"] != F.col("q")).select("q", "vec_id", F.round(embed.cosine(F.col("e"), F.col("embedding")), 6).alias("sim"))
        want = sims.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "vec_id"))).where("r <= 5").drop("r").collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert got == sorted(map(str, map(tuple, want))) and len(got) == 5 * asked.count()


def test_rows_are_looked_for_before_they_multiply(spark):
    """the new table comes right after its neighbour; before, suppliers met all customers of their nation first."""
    sql = ("SELECT n.k, COUNT(*) AS c FROM n INNER JOIN s ON s.nk = n.k INNER JOIN c ON c.nk = n.k INNER JOIN l AS t4 ON s.k = t4.sk GROUP BY n.k HAVING COUNT(*) >= 2")
    order = "FROM n INNER JOIN s ON s.nk = n.k INNER JOIN l AS t4 ON s.k = t4.sk INNER JOIN c ON c.nk = n.k"
    assert order in expansion.shown(sql)
    assert order in expansion.existing(sql.replace(" HAVING COUNT(*) >= 2", ""))
    outer = sql.replace("INNER JOIN c", "LEFT JOIN c")
    assert "INNER JOIN s ON s.nk = n.k LEFT JOIN c ON c.nk = n.k" in expansion.shown(outer)
    for name, rows in (("n", "1 AS k"), ("s", "5 AS k, 1 AS nk"), ("c", "1 AS nk"), ("l", "5 AS sk")):
        spark.sql(f"SELECT {rows} UNION ALL SELECT {rows}").createOrReplaceTempView(name)
    assert expansion.all_meaningful(spark, [sql, sql.replace(">= 2", ">= 17"), sql.replace(">= 2", "> 15"), sql.replace("s.k = t4", "n.k = t4")]) == [True, False, True, False]


def test_large_cases_are_settled_by_classes(spark, monkeypatch):
    """where the order of rows can't matter classes are matched; before, rows went through rounds of shuffles."""
    from tests.test_tiers import case, loop

    used = []
    in_tiers = tiers.in_tiers
    monkeypatch.setattr(tiers, "in_tiers", lambda *a, **k: (used.append(1), in_tiers(*a, **k))[1])
    df = spark.range(6000).selectExpr("array(concat('k', id), concat('v', id % 3)) AS key", "if(id < 3000, 1L, 0L) AS g", "if(id < 3000, 0L, 2L) AS p")
    for by_tokens in (False, True):
        assert [r.more for r in tiers.gained(df, by_tokens=by_tokens).collect()] == [3000]
    assert not used
    monkeypatch.setattr(matching, "EDGES_AT_ONCE", 5)
    for seed in (11, 12):
        rest = case(seed, True, 3, 14)
        df = spark.createDataFrame([("c", list(k), g, p) for k, g, p in rest], "case_id string, key array<string>, g long, p long")
        assert sum(r.more for r in tiers.gained(df, ("case_id",), True).collect()) == sum(g * n for _, _, g, n in loop(rest, True))


def test_rows_are_shuffled_once(spark):
    """F8, F9, F10: equal columns in equal places are compared by one shuffle; before, by two, after one that put all rows of a query into one task."""
    spark.range(4000).selectExpr("id AS a", "repeat(md5(string(id)), 40) AS b").createOrReplaceTempView("wide_rows")
    cases = [("lost", "SELECT a, b FROM wide_rows", "SELECT a, b FROM wide_rows WHERE a > 0"), ("same", "SELECT a, b FROM wide_rows", "SELECT a, b FROM wide_rows"),
             ("swapped", "SELECT a, b FROM wide_rows", "SELECT b, a FROM wide_rows"), ("other", "SELECT a, b FROM wide_rows", "SELECT a, b AS c FROM wide_rows"),
             ("repeats", "SELECT a % 3 AS a FROM wide_rows", "SELECT DISTINCT a % 3 AS a FROM wide_rows")]
    rows, moved = shuffled(spark, lambda: techniques.evaluate_cases(spark, cases, "exact_column_and_exact_cell").collect())
    got = {r.case_id: (r.ex, r.matched, r.gold_cells, r.pred_cells) for r in rows}
    assert got == {"lost": (0, 7998, 8000, 7998), "same": (1, 8000, 8000, 8000), "swapped": (0, 8000, 8000, 8000), "other": (1, 4000, 8000, 8000), "repeats": (1, 3, 4000, 3)}
    assert moved < 50_000  # eight sides of 4,000 rows by names, and of these four by places
    ex, _ = shuffled(spark, lambda: {r.case_id: r.ex for r in techniques.evaluate_cases(spark, cases, "execution_accuracy").collect()})
    assert ex == {k: v[0] for k, v in got.items()}
