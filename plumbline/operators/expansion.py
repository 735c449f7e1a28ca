"""Join query expansion: a query grown by one table of the schema graph, in every valid way."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from plumbline.functions import providers
from plumbline.operators import graph
from plumbline.plans.queryspec import Join, NotFlat, QuerySpec, columns_of, join_conditions, parse
from plumbline.sources import limits

#: Queries that one plan tests.
TOGETHER = 16
#: Rows in which groups are looked for before all are counted.
LOOK = 100_000
#: Schema edges: (table, table) to equalities "a.x = b.y" of their columns.
Schema = dict[tuple[str, str], list[str]]


def schema_of(edges: DataFrame) -> Schema:
    """A schema graph's edge table (src, dst, labels) as a value; it has a row for each pair of tables."""
    return {(r["src"], r["dst"]): list(r["labels"]) for r in edges.collect()}


@dataclass(frozen=True)
class Candidate:
    table: str
    alias: str
    joins: tuple[str, ...]  # equalities with aliases, in order

    def edges(self) -> set[str]:
        """Aliases of the query's tables that the new one is joined with."""
        return {s.split(".")[0] for j in self.joins for s in j.split(" = ")} - {self.alias}


def candidates(spec: QuerySpec, schema: Schema) -> list[Candidate]:
    """Every table that isn't in the query but next to one that is, with every non-empty set of the
    equalities between them: those with most joined tables first, then by their text."""
    used, out = {t.lower() for t, _ in spec.tables()}, []
    alias = f"t{len(spec.tables()) + 1}"
    while alias in {a for _, a in spec.tables()}:
        alias += "x"
    found: dict = {}
    for pair, labels in schema.items():
        for new, old in (pair, pair[::-1]):
            if new.lower() in used or old.lower() not in used:
                continue
            for t, a in spec.tables():
                if t.lower() == old.lower():
                    for label in labels:
                        sides = [s.split(".") for s in label.split(" = ")]
                        sides.sort(key=lambda s: s[0] == new)  # the query's side first
                        found.setdefault(new, set()).add(f"{a}.{sides[0][1]} = {alias}.{sides[1][1]}")
    for table, labels in found.items():
        order = sorted(labels)
        out += [Candidate(table, alias, c) for n in range(1, len(order) + 1) for c in combinations(order, n)]
    return sorted(out, key=lambda c: (-len(c.edges()), c.table, c.joins))


def redundant(spec: QuerySpec, candidate: Candidate) -> bool:
    """Whether one of the new joins follows from the others: in some simple cycle through the new table
    both sides of the last join are already tied by equalities of the rest."""
    labels: dict = {}
    for c in [*join_conditions(spec), *candidate.joins]:
        a, b = (s.split(".")[0] for s in c.split(" = "))
        labels.setdefault(tuple(sorted((a, b))), []).append(c)
    for cycle in graph.simple_cycles(list(labels)):
        if candidate.alias not in cycle:
            continue
        pairs = [tuple(sorted(p)) for p in zip(cycle, (*cycle[1:], cycle[0]))]
        added = sorted(p for p in pairs if candidate.alias in p)
        keys = {s for p in pairs if p != added[-1] for c in labels[p] for s in c.split(" = ")}
        if any(all(s in keys for s in c.split(" = ")) for c in labels[added[-1]]):
            return True
    return False


def extend(spec: QuerySpec, candidate: Candidate) -> QuerySpec:
    """The query with the table joined; bare columns of a single-table query are qualified first."""
    if len(spec.tables()) == 1:
        spec = qualified(spec)
    return spec.edit(joins=(*spec.joins, Join("INNER", candidate.table, candidate.alias, candidate.joins)))


def qualified(spec: QuerySpec) -> QuerySpec:
    """A single-table query with its columns qualified by the table's alias."""
    named = {a for _, a in spec.select if a}

    def fix(text: str, skip: set = frozenset()) -> str:
        for c in sorted({c for c in columns_of(text) if "." not in c and c not in skip}, key=len, reverse=True):
            text = re.sub(rf"(?<![\w.'`]){re.escape(c)}(?![\w'`(])(?=(?:[^']*'[^']*')*[^']*$)", f"{spec.alias}.{c}", text)
        return text

    return spec.edit(
        select=tuple((fix(e), a) for e, a in spec.select), where=tuple((op, fix(t)) for op, t in spec.where), group_by=tuple(map(fix, spec.group_by)),
        having=tuple((op, fix(t, named)) for op, t in spec.having), order_by=tuple(fix(o, named) for o in spec.order_by))


def query_graph(spec: QuerySpec) -> tuple[list[str], list[tuple[str, str]]]:
    """Nodes (aliases) and joined pairs of a query."""
    pairs = {tuple(sorted(s.split(".")[0] for s in c.split(" = "))) for c in join_conditions(spec)}
    return sorted(a for _, a in spec.tables()), sorted(p for p in pairs if len(set(p)) == 2)


def graph_first(tables: list[tuple[str, str]], joins: list[str], projections: list[str], filters: list[str]) -> tuple[str, str]:
    """A query over a join graph with placeholders for filter values, and the query that counts value combinations for them."""
    source = ", ".join(f"{t} AS {a}" for t, a in tables)
    where = " AND ".join(joins)
    query = f"SELECT DISTINCT {', '.join(projections)} FROM {source}"
    if joins or filters:
        query += " WHERE " + " AND ".join([*joins, *(f"{f} = ?" for f in filters)])
    counting = f"SELECT {', '.join(filters)}, COUNT(*) AS n FROM {source}" + f" WHERE {where}" * bool(joins) + f" GROUP BY {', '.join(filters)}" if filters else ""
    return query, counting


def fill(query: str, values: list) -> str:
    """Placeholders ``= ?`` filled one by one: null as IS NULL, numbers as they are, text quoted."""
    for v in values:
        said = "IS NULL" if v is None else f"= {v}" if isinstance(v, (int, float)) and not isinstance(v, bool) else "= '" + str(v).replace("'", "''") + "'"
        query = query.replace("= ?", said.replace("?", "\0"), 1)
    return query.replace("\0", "?")


def best_values(counts: DataFrame, names: list[str]) -> DataFrame:
    """The combination of values that occurs most (of equals the one that sorts first), one row."""
    order = F.struct(F.col("n"))
    top = counts.agg(F.max_by(F.struct(*names), order).alias("x")) if not names else counts.orderBy(F.desc("n"), *[F.asc_nulls_first(c) for c in names]).limit(1)
    return top.select(*names, "n") if names else top


def _aggregates(sql: str) -> bool:
    return re.search(r"(count|avg|sum|max|min)\(", sql, re.I) is not None


def meaningful(spark: SparkSession, sql: str) -> bool:
    """False for an empty result, and for one cell that is 0 or null while the query aggregates; two rows are fetched at most."""
    rows = spark.sql(sql).limit(2).collect()
    if not rows:
        return False
    lone = len(rows) == 1 and len(rows[0]) == 1
    return not (lone and rows[0][0] in (0, None) and _aggregates(sql))


_PLAIN = re.compile(r"((count|avg|sum|max|min)\()?\s*(\*|[\w.`]+)\s*\)?", re.I)


def _last_first(spec: QuerySpec) -> QuerySpec:
    """The same inner joins with the last table right after those that tie it to the first one.

    Rows are looked for until there are some, so what multiplies them for no other join belongs at the end, where it isn't finished.
    """
    if not spec.joins or any(j.kind != "INNER" for j in spec.joins):
        return spec
    needs = {j.alias: {s.split(".")[0].strip() for c in j.on for s in re.split("=", c)} - {j.alias} for j in spec.joins}
    if not all(re.fullmatch(r"\s*\w+\.\w+\s*=\s*\w+\.\w+\s*", c) for j in spec.joins for c in j.on):
        return spec
    tied, open_ = set(), [spec.joins[-1].alias]
    while open_:
        a = open_.pop()
        if a not in tied:
            tied.add(a)
            open_ += needs.get(a, ())
    return spec.edit(joins=(*(j for j in spec.joins if j.alias in tied), *(j for j in spec.joins if j.alias not in tied)))


def existing(sql: str) -> str:
    """A query that has rows just when the given one is meaningful, or the query itself.

    A flat query of two columns or more, all of them plain or aggregates of plain ones, is meaningful if it has a row.
    Without HAVING it has one if anything is left to be grouped, sorted or told apart, and of that the first row
    decides: no join has to be finished.  An aggregate without groups has a row always.
    """
    try:
        spec = parse(sql)
    except NotFlat:
        return sql
    plain = len(spec.select) > 1 and all(_PLAIN.fullmatch(e) for e, _ in spec.select) and not spec.having and (spec.limit is None or spec.limit > 0)
    if not plain:
        return sql
    if _aggregates(sql) and not spec.group_by:
        return "SELECT 1 AS one, 1 AS two"
    return _last_first(spec).edit(select=(("1", "one"), ("1", "two")), distinct=False, group_by=(), order_by=(), limit=None).sql()


def shown(sql: str) -> str | None:
    """A cheap query whose rows show that the given one is meaningful, though their absence doesn't show the contrary; None if there is none.

    Groups of which HAVING asks for a least number of rows have it if LOOK of the rows already give it.
    """
    try:
        spec = parse(sql)
    except NotFlat:
        return None
    least = all(op != "OR" and re.fullmatch(r"count\(\s*\*\s*\)\s*>=?\s*\d+", t, re.I) for op, t in spec.having)
    if len(spec.select) < 2 or not spec.having or not least or not spec.group_by or not all(_PLAIN.fullmatch(e) for e, _ in spec.select) or spec.limit == 0:
        return None
    keys = [f"_g{k}" for k in range(len(spec.group_by))]
    some = _last_first(spec).edit(select=tuple(zip(spec.group_by, keys)), distinct=False, group_by=(), having=(), order_by=(), limit=LOOK)
    return f"SELECT 1 AS one, 1 AS two FROM ({some.sql()}) GROUP BY {', '.join(keys)} HAVING {' '.join(f'{op} {t}'.strip() for op, t in spec.having)}"


def _test(df: DataFrame, key: int, sql: str) -> DataFrame:
    """One row (key, good): ``meaningful`` as an aggregate of the query's own plan, over two of its rows at most."""
    zero = F.lit(False)
    if len(df.columns) == 1 and _aggregates(sql):
        c, kind = F.col("_c"), df.schema.fields[0].dataType
        zero = c.isNull() | (c == 0 if isinstance(kind, T.NumericType) else ~c if isinstance(kind, T.BooleanType) else F.lit(False))
    rows = df.toDF(*["_c", *(f"_c{k}" for k in range(1, len(df.columns)))]).limit(2)
    told = rows.agg(F.count("*").alias("n"), F.count_if(zero).alias("z"))
    return told.select(F.lit(key).alias("key"), ((F.col("n") > 0) & ~((F.col("n") == 1) & (F.col("z") == 1))).alias("good"))


def all_meaningful(spark: SparkSession, queries: list[str], seconds: float | None = None, at_once: int = TOGETHER) -> list[bool]:
    """``meaningful`` of each query, ``at_once`` of them in one plan, in which scans and joins that they share are made once.

    A query that can't be analysed isn't meaningful.  First come the queries' cheapest forms (see ``existing`` and
    ``shown``), then the full ones of those that aren't decided.  If a plan fails or is late, its queries run by
    themselves, so that what one raises, or takes longer than ``seconds`` for, touches no other.
    """
    good, first, full = [False] * len(queries), {}, {}
    for k, sql in enumerate(queries):
        try:
            spark.sql(sql)  # the whole query must be sound
            last, cheap = existing(sql), shown(sql)
            (first if cheap is None else full)[k] = _test(spark.sql(last), k, last)
            if cheap is not None:
                first[k] = _test(spark.sql(cheap), k, cheap)
        except Exception:  # whatever a query raises makes it worthless here
            continue
    for tests in (first, full):
        open_ = [k for k in tests if not good[k]]
        plans = {tuple(open_[k : k + at_once]): reduce(DataFrame.unionAll, [tests[x] for x in open_[k : k + at_once]]) for k in range(0, len(open_), at_once)}
        told = limits.run_all(spark, {part: plan.collect for part, plan in plans.items()}, seconds)
        for r in (r for out in told.values() if out.status == "ok" for r in out.result):
            good[r["key"]] = r["good"]
        again = [k for part, out in told.items() if out.status != "ok" for k in part]
        for k, out in limits.run_all(spark, {k: tests[k].collect for k in again}, seconds).items():
            good[k] = out.status == "ok" and out.result[0]["good"]
    return good


def expansions(spark: SparkSession, corpus: list[tuple[int, str]], schema: Schema) -> DataFrame:
    """``(question_id, ord, table_name, joins, is_redundant, iso_key, sql)`` of all candidates of (question_id, sql), in their order."""
    rows = []
    for qid, sql in corpus:  # a corpus of queries, each with a handful of candidates
        spec = parse(sql)
        for k, c in enumerate(candidates(spec, schema)):
            new = extend(spec, c)
            nodes, edges = query_graph(new)
            rows.append((qid, k, c.table, list(c.joins), redundant(spec, c), graph.canonical(nodes, edges) if graph.is_connected(nodes, edges) else "", new.sql()))
    return spark.createDataFrame(rows, "question_id int, ord int, table_name string, joins array<string>, is_redundant boolean, iso_key string, sql string")


def accepted(found: DataFrame, max_queries: int = 1000, max_isomorphic: int = 1) -> DataFrame:
    """Valid candidates with ``status`` filtered or discarded: the first ``max_queries`` in order count, of each
    class of isomorphic graphs the first ``max_isomorphic`` are filtered (kept)."""
    first = found.withColumn("_n", F.row_number().over(W.partitionBy("question_id").orderBy("ord"))).where(F.col("_n") <= max_queries)
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy("question_id", "iso_key").orderBy("ord")))
    return ranked.withColumn("status", F.when(F.col("_k") <= max_isomorphic, "filtered").otherwise("discarded")).drop("_n", "_k")


def expand(spark: SparkSession, corpus: list[tuple[int, str]], schema: Schema, max_queries: int = 1000, max_isomorphic: int = 1, seconds: float | None = None) -> DataFrame:
    """Expansions that aren't redundant and whose result is meaningful, with their status; ``all_meaningful`` tests many in one plan."""
    found = expansions(spark, corpus, schema).where(~F.col("is_redundant"))
    rows = found.select("question_id", "ord", "sql").collect()
    good = [(r["question_id"], r["ord"]) for r, x in zip(rows, all_meaningful(spark, [r["sql"] for r in rows], seconds)) if x]
    keys = spark.createDataFrame(good, "question_id int, ord int")
    return accepted(found.join(F.broadcast(keys), ["question_id", "ord"], "left_semi"), max_queries, max_isomorphic)  # a row for each candidate


def filled(spark: SparkSession, tables: list[tuple[str, str]], joins: list[str], projections: list[str], filters: list[str]) -> str | None:
    """A graph-first query with its filters set to their commonest combination of values; None if its result is empty."""
    sql, counting = graph_first(tables, joins, projections, filters)
    if filters:
        names = [f"_{k}" for k in range(len(filters))]
        best = best_values(spark.sql(counting).toDF(*names, "n"), names).first()
        if best is None:
            return None
        sql = fill(sql, [best[n] for n in names])
    return None if spark.sql(sql).isEmpty() else sql


def generate(spark: SparkSession, graphs: list[tuple[str, list[tuple[str, str]], list[str]]], frequencies: DataFrame, p: int = 5, w: int = 2) -> DataFrame:
    """``(graph_id, sql)`` of graph-first queries over join graphs (id, (table, alias) pairs, joins): the ``p`` most projected
    columns of their tables, and the ``w`` most filtered others, as filters.  Graphs without a result are left out."""
    counts = [r.asDict() for r in frequencies.collect()]  # a row for each column of the schema
    out = []
    for graph_id, tables, joins in graphs:
        alias = {t.lower(): a for t, a in reversed(tables)}
        own = [c for c in counts if c["table_name"].lower() in alias]
        said = lambda c: f"{alias[c['table_name'].lower()]}.{c['column_name']}"
        top = sorted((c for c in own if c["projection_occurrences"]), key=lambda c: (-c["projection_occurrences"], c["table_name"], c["column_name"]))[:p]
        rest = sorted((c for c in own if c["filtering_occurrences"] and c not in top), key=lambda c: (-c["filtering_occurrences"], c["table_name"], c["column_name"]))[:w]
        if top and (sql := filled(spark, tables, joins, list(map(said, top)), list(map(said, rest)))):
            out.append((graph_id, sql))
    return spark.createDataFrame(out, "graph_id string, sql string")


#: What a model is asked for about a query; an application may pass its own texts with {sql}, {schema} and {question}.
REQUESTS = {
    "extended": "A question asks: {question}\nIts query was extended to: {sql}\nSchema: {schema}\nWrite the question that the extended query answers.",
    "explicit": "Query: {sql}\nSchema: {schema}\nWrite a question that names every table and column which the query uses.",
    "plain": "Query: {sql}\nSchema: {schema}\nWrite the question as a user would ask it.",
    "evidence": "Query: {sql}\nQuestion: {question}\nWrite what one must know of the schema to answer the question.",
}


def worded(queries: DataFrame, kind: str, make, requests: dict[str, str] = REQUESTS) -> DataFrame:
    """``queries`` (sql, schema, question) with a model's answer to a request of REQUESTS in the column ``kind``."""
    prompt = F.lit(requests[kind])
    for name in ("sql", "schema", "question"):
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(name, F.lit("")))
    return providers.completed(queries.withColumn("_prompt", prompt), "_prompt", kind, make).drop("_prompt")
