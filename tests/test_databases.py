"""Tables of database files and of a JDBC driver, written from the test tables."""

from __future__ import annotations

import sqlite3

import duckdb
import pytest
from pyspark.sql import datasource as D

from plumbline.operators import graph, techniques
from plumbline.sources import backend, databases

FOLDER = "/root/testdata/sf0.001"
NATION = "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name VARCHAR(25) COLLATE NOCASE, n_regionkey INTEGER)"
CUSTOMER = "CREATE TABLE customer (c_custkey BIGINT, c_name TEXT, c_nationkey INTEGER REFERENCES nation(n_nationkey), c_acctbal DOUBLE, c_mktsegment TEXT)"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("databases")
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").collect()]
    nation, customer = read("nation"), read("customer")
    con = sqlite3.connect(f"{at}/x.sqlite")
    for sql in (NATION, CUSTOMER, "CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000", "CREATE TABLE pairs (a INTEGER, b TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID",
                'CREATE TABLE odd ("a ""b" BLOB, flag BOOLEAN, day DATE, empty TEXT)', "CREATE TABLE bare (x INTEGER)"):
        con.execute(sql)
    con.executemany("INSERT INTO nation VALUES (?, ?, ?)", nation)
    con.executemany("INSERT INTO customer VALUES (?, ?, ?, ?, ?)", customer)
    con.executemany("INSERT INTO pairs VALUES (?, ?)", [(1, "x"), (1, "y")])
    con.execute("INSERT INTO odd VALUES (x'0102', 1, '2024-01-05', NULL)")
    con.commit()
    con.close()
    con = duckdb.connect(f"{at}/x.duckdb")
    con.execute(NATION.replace(" COLLATE NOCASE", ""))
    con.execute(CUSTOMER)
    con.execute(f"INSERT INTO nation SELECT * FROM read_parquet('{FOLDER}/nation.parquet')")
    con.execute(f"INSERT INTO customer SELECT * FROM read_parquet('{FOLDER}/customer.parquet')")
    con.close()
    return at


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["sqlite", "duckdb"])
def test_tables_catalog_and_keys(spark, files, kind):
    b = backend.open_backend(kind, spark, f"{files}/x.{kind}", partitions=5)
    assert {"nation", "customer"} <= set(b.tables()) and b.is_alive()
    for t in ("nation", "customer"):
        want = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        assert rows(b.table(t)) == rows(want) and b.table(t).columns == want.columns
    assert b.table("customer").rdd.getNumPartitions() == 5
    assert rows(b.foreign_keys()) == [("customer", "c_nationkey", "nation", "n_nationkey")]
    assert [r.column_name for r in b.catalog().where("key = 1 AND table_name = 'nation'").collect()] == ["n_nationkey"]
    assert {r.table_name: r.n for r in b.cardinalities().collect()}["nation"] == 25
    edges = graph.schema_edges(b.foreign_keys())
    assert edges.count() == 1
    got = techniques.evaluate(spark, "SELECT n_name FROM nation", "SELECT n_name FROM nation WHERE n_nationkey < 10", "exact_column_and_exact_cell").first()
    assert (got.exp, got.exr) == (1.0, 0.4)


C = lambda name: (name,)
FILTERS = [
    ([D.GreaterThanOrEqual(C("c_custkey"), 40), D.LessThan(C("c_custkey"), 60)], "c_custkey >= 40 AND c_custkey < 60"),
    ([D.EqualTo(C("c_mktsegment"), "BUILDING")], "c_mktsegment = 'BUILDING'"), ([D.EqualTo(C("c_mktsegment"), "building")], "c_mktsegment = 'building'"),
    ([D.In(C("c_mktsegment"), ("BUILDING", "MACHINERY"))], "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ([D.StringStartsWith(C("c_name"), "Cust"), D.StringEndsWith(C("c_name"), "7")], "c_name LIKE 'Cust%' AND c_name LIKE '%7'"),
    ([D.StringContains(C("c_name"), "00002")], "c_name LIKE '%00002%'"), ([D.GreaterThan(C("c_acctbal"), 100.5), D.IsNotNull(C("c_nationkey"))], "c_acctbal > 100.5D AND c_nationkey IS NOT NULL"),
    ([D.Not(D.EqualTo(C("c_mktsegment"), "BUILDING"))], "NOT c_mktsegment = 'BUILDING'"), ([D.LessThanOrEqual(C("c_name"), "Customer#000000050")], "c_name <= 'Customer#000000050'"),
    ([D.EqualNullSafe(C("c_custkey"), 7)], "c_custkey <=> 7"), ([D.IsNull(C("c_name"))], "c_name IS NULL")]


@pytest.mark.parametrize("kind", ["sqlite", "duckdb"])
def test_filters_are_the_databases_work(spark, files, kind):
    b, whole = backend.open_backend(kind, spark, f"{files}/x.{kind}", partitions=3), spark.read.parquet(f"{FOLDER}/customer.parquet")
    for filters, where in FILTERS:
        assert rows(b.table("customer", where=filters)) == rows(whole.where(where)), where
    assert rows(b.table("customer", ["c_name"], FILTERS[0][0])) == rows(whole.where(FILTERS[0][1]).select("c_name"))
    for bad in (D.EqualTo(C("c_custkey"), "x"), D.EqualTo(C("none"), 1), D.In(C("c_custkey"), tuple(range(10_000))), D.GreaterThan(C("c_acctbal"), float("nan"))):
        with pytest.raises(ValueError, match="database"):
            b.table("customer", where=[bad])


def test_scans_with_other_filters_are_not_taken_for_one_another(spark, files):
    b = backend.open_backend("sqlite", spark, f"{files}/x.sqlite")
    got = spark.sql("SELECT 'a' AS k, count(*) AS n FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'b', count(*) FROM nation").collect()
    assert sorted(map(tuple, got)) == [("a", 10), ("b", 25)]
    some, more = (b.table("nation", where=[D.LessThan(C("n_nationkey"), n)]).groupBy().count() for n in (10, 20))
    assert sorted(r[0] for r in some.unionAll(more).collect()) == [10, 20]


def test_orders_that_a_column_declares_dont_matter(spark, files):
    b = backend.open_backend("sqlite", spark, f"{files}/x.sqlite")
    want = spark.read.parquet(f"{FOLDER}/nation.parquet")
    name = want.first().n_name
    for where in (f"n_name = '{name.lower()}'", f"n_name = '{name}'", "n_name > 'a'", f"n_name < '{name.swapcase()}'"):
        assert rows(spark.table("nation").where(where)) == rows(want.where(where))
    for f in (D.EqualTo(C("n_name"), name.lower()), D.EqualTo(C("n_name"), name), D.GreaterThan(C("n_name"), "a")):
        sign = "=" if isinstance(f, D.EqualTo) else ">"
        assert rows(b.table("nation", where=[f])) == rows(want.where(f"n_name {sign} '{f.value}'"))


def test_ranges_columns_and_odd_tables(spark, files):
    path = f"{files}/x.sqlite"
    reader = databases.TableReader({"kind": "sqlite", "path": path, "table": "customer", "partitions": "4"}, None)
    ends = [p.value for p in reader.partitions()]
    assert len(ends) == 4 and ends[0][0] is None and ends[-1][1] is None and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    b = backend.open_backend("sqlite", spark, path, partitions=3, keys={"customer": "c_custkey"})
    some = b.table("customer", ["c_acctbal"])
    assert some.columns == ["c_acctbal"] and some.count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    assert rows(b.table("pairs")) == [(1, "x"), (1, "y")] and b.table("pairs").rdd.getNumPartitions() == 1
    assert rows(b.table("odd")) == [(b"\x01\x02", True, "2024-01-05", None)] and b.table("odd").columns[0] == 'a "b'
    assert rows(b.table("bare")) == []
    assert b.table("rich").count() == spark.read.parquet(f"{FOLDER}/customer.parquet").where("c_acctbal > 5000").count()
    with pytest.raises(Exception, match="no table"):
        b.table("absent").count()
    with pytest.raises(Exception, match="whole numbers"):
        backend.Database(spark, "sqlite", path, ["customer"], keys={"customer": "c_name"}).table("customer").count()


def test_jdbc(spark, files):
    url = f"jdbc:derby:{files}/derby;create=true"
    for t, kinds in (("nation", "n_name VARCHAR(64)"), ("customer", "c_name VARCHAR(64), c_mktsegment VARCHAR(64)")):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.option("createTableColumnTypes", kinds).jdbc(url, t)
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    statement = con.createStatement()
    for sql in ('ALTER TABLE nation ALTER COLUMN "n_nationkey" NOT NULL', 'ALTER TABLE nation ADD PRIMARY KEY ("n_nationkey")', 'ALTER TABLE customer ADD FOREIGN KEY ("c_nationkey") REFERENCES nation ("n_nationkey")'):
        statement.execute(sql)
    con.close()
    b = backend.open_backend("jdbc", spark, url, ["nation", "customer"], keys={"customer": '"c_custkey"'}, partitions=4)
    want = spark.read.parquet(f"{FOLDER}/customer.parquet")
    assert rows(b.table("customer")) == rows(want) and b.table("customer").rdd.getNumPartitions() == 4
    some = b.run_query("SELECT c_name FROM customer WHERE c_custkey > 50 AND c_mktsegment = 'BUILDING'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_custkey,50)" in plan and "ReadSchema: struct<c_name:string>" in plan
    assert rows(some) == rows(want.where("c_custkey > 50 AND c_mktsegment = 'BUILDING'").select("c_name"))
    assert rows(b.foreign_keys()) == [("CUSTOMER", "c_nationkey", "NATION", "n_nationkey")]
