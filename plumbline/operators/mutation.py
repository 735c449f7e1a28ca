"""Controlled errors in queries: fifteen operators, their conflicts, and suites of mutants."""

from __future__ import annotations

import random
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.queryspec import Join, NotFlat, QuerySpec, parse

Operator = Callable[[QuerySpec, random.Random], "QuerySpec | None"]
_FLIP = {"=": "<>", "<>": "=", "!=": "=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}
_SWAP = {"avg": "sum", "sum": "avg", "min": "max", "max": "min", "count": "sum"}
_OUTSIDE = r"(?=(?:[^']*'[^']*')*[^']*$)"  # not within a string


def _one(items: tuple, rng: random.Random, change: Callable) -> tuple | None:
    """The items with one of those that ``change`` can change, changed."""
    able = [(k, new) for k, x in enumerate(items) if (new := change(x)) is not None and new != x]
    if not able:
        return None
    k, new = rng.choice(able)
    return (*items[:k], new, *items[k + 1 :])


def _comparison(table: dict[str, str]) -> Callable:
    def change(term: tuple[str, str]) -> tuple[str, str] | None:
        m = re.search(r" (<>|!=|<=|>=|=|<|>) " + _OUTSIDE, term[1])
        return (term[0], term[1][: m.start(1)] + table[m[1]] + term[1][m.end(1) :]) if m and m[1] in table else None

    return change


def _edited(spec: QuerySpec, name: str, value) -> QuerySpec | None:
    return None if value is None else spec.edit(**{name: value})


def projection_drop(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    if len(s.select) < 2:
        return None
    k = rng.randrange(len(s.select))
    return s.edit(select=s.select[:k] + s.select[k + 1 :])


def where_predicate_delete(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    if len(s.where) < 2:
        return None
    k = rng.randrange(len(s.where))
    rest = [t for i, (_, t) in enumerate(s.where) if i != k]
    return s.edit(where=tuple(("AND" if i else "", t) for i, t in enumerate(rest)))


def where_remove(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return s.edit(where=()) if s.where else None


def where_condition_flip(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return _edited(s, "where", _one(s.where, rng, _comparison(_FLIP)))


def where_strengthen(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return _edited(s, "where", _one(s.where, rng, _comparison({"<": "<=", ">": ">="})))


def where_weaken(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return _edited(s, "where", _one(s.where, rng, _comparison({"<=": "<", ">=": ">"})))


def join_break(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return _edited(s, "joins", _one(s.joins, rng, lambda j: Join("CROSS", j.table, j.alias) if j.on else None))


def aggregation_swap(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    def change(text: str) -> str | None:
        m = re.search(r"\b(avg|sum|min|max|count)\(" + _OUTSIDE, text, re.I)
        return text[: m.start(1)] + _SWAP[m[1].lower()].upper() + text[m.end(1) :] if m else None

    both = [("select", _one(s.select, rng, lambda x: (c, x[1]) if (c := change(x[0])) else None)), ("having", _one(s.having, rng, lambda x: (x[0], c) if (c := change(x[1])) else None))]
    able = [b for b in both if b[1] is not None]
    return s.edit(**dict([rng.choice(able)])) if able else None


def add_star_wildcard(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    if any(e.endswith("*") for e, _ in s.select):
        return None
    return s.edit(select=(*s.select, (f"{rng.choice(s.tables())[1]}.*", "")))


def having_condition_flip(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return _edited(s, "having", _one(s.having, rng, _comparison(_FLIP)))


def having_remove(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return s.edit(having=()) if s.having else None


def join_type_to_left(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return _edited(s, "joins", _one(s.joins, rng, lambda j: Join("LEFT", j.table, j.alias, j.on) if j.on and j.kind != "LEFT" else None))


def limit_increase(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return s.edit(limit=2 * s.limit + rng.randint(1, 5)) if s.limit is not None else None


def limit_decrease(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return s.edit(limit=max(1, s.limit // 2)) if s.limit is not None and max(1, s.limit // 2) != s.limit else None


def distinct_toggle(s: QuerySpec, rng: random.Random) -> QuerySpec | None:
    return s.edit(distinct=False) if s.distinct else None


#: The registry; an application may add its own.
OPERATORS: dict[str, Operator] = {f.__name__: f for f in (
    projection_drop, where_predicate_delete, where_remove, where_condition_flip, where_strengthen, where_weaken, join_break, aggregation_swap,
    add_star_wildcard, having_condition_flip, having_remove, join_type_to_left, limit_increase, limit_decrease, distinct_toggle)}
#: Operators that may not be used together: those that edit the same predicate, and limits both ways.
CONFLICTS = {frozenset(p) for p in (
    ("where_condition_flip", "where_strengthen"), ("where_condition_flip", "where_weaken"), ("where_strengthen", "where_weaken"), ("limit_increase", "limit_decrease"))}
#: Operators that may be used more than once.
REPEATABLE = {"projection_drop", "limit_increase", "limit_decrease"}


def apply(sql: str, operators: list[str], seed: int = 42) -> str | None:
    """A query after some operators in turn; None if one changes nothing or the result can't be read again."""
    try:
        spec = parse(sql)
        for k, name in enumerate(operators):
            changed = OPERATORS[name](spec, random.Random(f"{seed}/{k}/{name}/{sql}"))
            if changed is None or changed.sql() == spec.sql():
                return None
            spec = changed
        parse(spec.sql())
    except NotFlat:
        return None
    return spec.sql()


def suite(sql: str, depth: int = 2, seed: int = 42) -> list[tuple[int, list[str], str]]:
    """(depth, operators, mutated SQL): every operator at depth 1, and each survivor followed by every operator it doesn't conflict with."""
    out, level = [], [([], sql)]
    for d in range(1, depth + 1):
        grown = []
        for done, _ in level:
            for name in OPERATORS:
                if name in done and name not in REPEATABLE or any(frozenset((name, x)) in CONFLICTS for x in done):
                    continue
                if (mutant := apply(sql, [*done, name], seed)) is not None:
                    grown.append(([*done, name], mutant))
        out += [(d, ops, m) for ops, m in grown]
        level = grown
    return out


def mutants(spark: SparkSession, corpus: list[tuple[int, str, str]], depth: int = 2, seed: int = 42) -> DataFrame:
    """The suites of a corpus of (question_id, db_id, sql).

    Queries are spread over tasks; a suite's size depends on the operators and the depth alone.
    """
    rows = spark.createDataFrame(corpus, "question_id int, db_id string, gold_sql string")
    schema = "question_id int, db_id string, depth int, operators array<string>, mutated_sql string, error_count int, gold_sql string"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(r.question_id, r.db_id, d, ops, m, len(ops), r.gold_sql) for r in pdf.itertuples() for d, ops, m in suite(r.gold_sql, depth, seed)]
            yield pd.DataFrame(out, columns=["question_id", "db_id", "depth", "operators", "mutated_sql", "error_count", "gold_sql"])

    return rows.mapInPandas(run, schema)
