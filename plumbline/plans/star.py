"""The star schema of the test tables: keys, and a small corpus of queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: (from_table, from_column, to_table, to_column); Parquet declares none.
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
CORPUS = [
    (1, "star", "SELECT n.n_name, r.r_name FROM nation AS n INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA' AND n.n_nationkey > 3"),
    (2, "star", "SELECT c_mktsegment AS segment, COUNT(*) AS n, AVG(c_acctbal) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment HAVING COUNT(*) > 10"),
    (3, "star", "SELECT DISTINCT p_brand, p_size FROM part WHERE p_size >= 10 AND p_retailprice < 1500"),
    (4, "star", "SELECT s.s_name, n.n_name FROM supplier AS s INNER JOIN nation AS n ON s.s_nationkey = n.n_nationkey ORDER BY s.s_suppkey LIMIT 20"),
    (5, "star", "SELECT n.n_name AS nation, SUM(c.c_acctbal) AS total FROM nation AS n, customer AS c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal <= 5000 GROUP BY n.n_name"),
    (6, "star", "SELECT o.o_orderpriority, COUNT(*) AS n FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey "
                "WHERE o.o_orderstatus = 'F' AND n.n_regionkey < 3 GROUP BY o.o_orderpriority"),
    (7, "star", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS qty, MIN(l_discount) AS least FROM lineitem WHERE l_quantity BETWEEN 5 AND 30 GROUP BY l_returnflag, l_linestatus"),
    (8, "star", "SELECT r.r_name, COUNT(*) AS n FROM region AS r INNER JOIN nation AS n ON n.n_regionkey = r.r_regionkey INNER JOIN supplier AS s ON s.s_nationkey = n.n_nationkey "
                "INNER JOIN customer AS c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name HAVING COUNT(*) >= 2"),
    (9, "star", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' OR o_totalprice > 300000 ORDER BY o_totalprice, o_orderkey LIMIT 15"),
]
#: A shorter name for each table and column, none twice.
ABBREVIATIONS = {
    "region": ("rgn", {"r_regionkey": "rk", "r_name": "rnm"}),
    "nation": ("ntn", {"n_nationkey": "nk", "n_name": "nnm", "n_regionkey": "nrk"}),
    "customer": ("cst", {"c_custkey": "ck", "c_name": "cnm", "c_nationkey": "cnk", "c_acctbal": "cab", "c_mktsegment": "cms"}),
    "supplier": ("spl", {"s_suppkey": "sk", "s_name": "snm", "s_nationkey": "snk", "s_acctbal": "sab"}),
    "part": ("prt", {"p_partkey": "pk", "p_name": "pnm", "p_brand": "pbr", "p_type": "pty", "p_size": "psz", "p_retailprice": "prp"}),
    "orders": ("ord", {"o_orderkey": "ok", "o_custkey": "ock", "o_orderstatus": "ost", "o_totalprice": "otp", "o_orderdate": "odt", "o_orderpriority": "opr"}),
    "lineitem": ("ln_itm", {"l_orderkey": "lok", "l_partkey": "lpk", "l_suppkey": "lsk", "l_linenumber": "lno", "l_quantity": "lqt", "l_extendedprice": "lep",
                            "l_discount": "lds", "l_tax": "ltx", "l_returnflag": "lrf", "l_linestatus": "lst", "l_shipdate": "lsd"}),
}


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> None:
    """The tables as temporary views of their names."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def foreign_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOREIGN_KEYS, "from_table string, from_column string, to_table string, to_column string")


def mapping(spark: SparkSession) -> DataFrame:
    rows = [("star", "star", t, c, new, x) for t, (new, cols) in ABBREVIATIONS.items() for c, x in cols.items()]
    return spark.createDataFrame(rows, "dataset string, db_id string, table_name string, column_name string, new_table_name string, new_column_name string")
