"""Flat SELECT statements as values that can be examined, edited and written again.

Spark parses and plans what is run; this is only the shape that mutation, expansion and renaming
edit.  Whatever is outside it (subqueries, CTEs, set operations) is nested and keeps its text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

_TOKEN = re.compile(r"""\s*('(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|<>|!=|<=|>=|\|\||[-+*/%=<>(),.;?])""")
_CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT")
_JOIN_WORDS = {"INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "JOIN"}
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
_WORDS = _JOIN_WORDS | _AGGREGATES | set("SELECT DISTINCT FROM WHERE GROUP BY HAVING ORDER LIMIT AS ON AND OR NOT IN IS NULL LIKE BETWEEN CASE WHEN THEN ELSE END ASC DESC DATE TIMESTAMP INTERVAL CAST TRUE FALSE EXISTS OVER PARTITION".split())


class NotFlat(ValueError):
    """The statement isn't one flat SELECT."""


def tokens(sql: str) -> list[str]:
    """The tokens of a statement, without white space."""
    out, at = [], 0
    text = sql.strip().rstrip(";").rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise NotFlat(f"can't read {text[at : at + 20]!r}")
        out.append(m[1])
        at = m.end()
    return out


def text(parts: list[str]) -> str:
    """Tokens as a statement again."""
    out = ""
    for k, t in enumerate(parts):
        tight = not out or t in {",", ")", ".", ";"} or parts[k - 1] in {"(", "."} or t == "(" and (parts[k - 1].upper() in _AGGREGATES or _name(parts[k - 1]))
        out += t if tight else " " + t
    return out


def _name(t: str) -> bool:
    return bool(re.fullmatch(r'[A-Za-z_]\w*|`[^`]*`|"[^"]*"', t)) and t.upper() not in _WORDS


def split(parts: list[str], *words: str) -> list[tuple[str, list[str]]]:
    """Parts between any of some words outside parentheses and CASE, each with the word before it.
    The AND of a BETWEEN isn't one."""
    out: list = [("", [])]
    depth, between = 0, 0
    for t in parts:
        up = t.upper()
        depth += (t == "(" or up == "CASE") - (t == ")" or up == "END")
        between += not depth and up == "BETWEEN"
        if not depth and up in words and not (up == "AND" and between):
            out.append((up, []))
            continue
        if not depth and up == "AND" and between:
            between -= 1
        out[-1][1].append(t)
    return out


@dataclass(frozen=True)
class Join:
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS, or "," for a list in FROM
    table: str
    alias: str
    on: tuple[str, ...] = ()


@dataclass(frozen=True)
class QuerySpec:
    select: tuple[tuple[str, str], ...]  # (expression, alias or "")
    table: str
    alias: str
    distinct: bool = False
    joins: tuple[Join, ...] = ()
    where: tuple[tuple[str, str], ...] = ()  # (AND, OR or "" for the first; condition)
    group_by: tuple[str, ...] = ()
    having: tuple[tuple[str, str], ...] = ()
    order_by: tuple[str, ...] = ()
    limit: int | None = None
    extra: tuple = field(default=(), compare=False)

    def edit(self, **changes) -> QuerySpec:
        return replace(self, **changes)

    def tables(self) -> list[tuple[str, str]]:
        """(table, alias) of everything in FROM."""
        return [(self.table, self.alias), *((j.table, j.alias) for j in self.joins)]

    def sql(self) -> str:
        said = lambda t, a: t if a == t else f"{t} AS {a}"
        out = "SELECT " + "DISTINCT " * self.distinct + ", ".join(e + f" AS {a}" * bool(a) for e, a in self.select) + f" FROM {said(self.table, self.alias)}"
        for j in self.joins:
            out += (", " if j.kind == "," else f" {j.kind} JOIN ") + said(j.table, j.alias) + (" ON " + " AND ".join(j.on) if j.on else "")
        for word, terms in (("WHERE", self.where), ("HAVING", self.having)):
            if word == "HAVING" and self.group_by:
                out += " GROUP BY " + ", ".join(self.group_by)
            if terms:
                out += f" {word} " + " ".join(f"{op} {t}".strip() for op, t in terms)
        if self.order_by:
            out += " ORDER BY " + ", ".join(self.order_by)
        return out + (f" LIMIT {self.limit}" if self.limit is not None else "")


def is_nested(sql: str) -> bool:
    """Whether a statement has a CTE, a set operation, or a SELECT within; what can't be read counts as nested."""
    try:
        up = [t.upper() for t in tokens(sql)]
    except NotFlat:
        return True
    return not up or up[0] != "SELECT" or up.count("SELECT") > 1 or bool({"UNION", "INTERSECT", "EXCEPT", "WITH"} & set(up))


def _from(parts: list[str]) -> tuple[str, str, tuple[Join, ...]]:
    out, kind, at = [], "", 0
    while at < len(parts):
        up = parts[at].upper()
        if parts[at] == ",":
            kind, at = ",", at + 1
            continue
        if up in _JOIN_WORDS:
            words = []
            while at < len(parts) and parts[at].upper() in _JOIN_WORDS:
                words.append(parts[at].upper())
                at += 1
            kind = next((w for w in words if w in {"LEFT", "RIGHT", "FULL", "CROSS"}), "INNER")
            continue
        if not _name(parts[at]):
            raise NotFlat(f"unexpected {parts[at]!r} in FROM")
        table, alias, at = parts[at], parts[at], at + 1
        if at < len(parts) and parts[at].upper() == "AS":
            at += 1
        if at < len(parts) and _name(parts[at]):
            alias, at = parts[at], at + 1
        on: list[str] = []
        if at < len(parts) and parts[at].upper() == "ON":
            at += 1
            depth = 0
            while at < len(parts) and (depth or parts[at] != "," and parts[at].upper() not in _JOIN_WORDS):
                depth += (parts[at] == "(") - (parts[at] == ")")
                on.append(parts[at])
                at += 1
        out.append(Join(kind, table, alias, tuple(text(p) for _, p in split(on, "AND")) if on else ()))
    if not out:
        raise NotFlat("nothing in FROM")
    return out[0].table, out[0].alias, tuple(out[1:])


def parse(sql: str) -> QuerySpec:
    """The shape of a flat SELECT; NotFlat for anything else."""
    if is_nested(sql):
        raise NotFlat("not one flat SELECT")
    found: dict[str, list[str]] = {}
    now, depth, parts, at = "", 0, tokens(sql), 0
    while at < len(parts):
        depth += (parts[at] == "(") - (parts[at] == ")")
        two = " ".join(parts[at : at + 2]).upper()
        word = next((w for w in _CLAUSES if w == (two if " " in w else parts[at].upper())), None) if not depth else None
        if word:
            now, at = word, at + 1 + (" " in word)
            found[now] = []
            continue
        found[now].append(parts[at])
        at += 1
    if "FROM" not in found:
        raise NotFlat("no FROM")
    distinct = found["SELECT"][:1] and found["SELECT"][0].upper() == "DISTINCT"
    items = []
    for _, p in split(found["SELECT"][1 if distinct else 0 :], ","):
        named = len(p) > 2 and p[-2].upper() == "AS"
        items.append((text(p[:-2]), p[-1]) if named else (text(p), ""))
    table, alias, joins = _from(found["FROM"])
    terms = lambda c: tuple((op, text(p)) for op, p in split(found[c], "AND", "OR")) if found.get(c) else ()
    listed = lambda c: tuple(text(p) for _, p in split(found[c], ",")) if found.get(c) else ()
    limit = found.get("LIMIT")
    if limit and not (len(limit) == 1 and limit[0].isdigit()):
        raise NotFlat("a limit that isn't a number")
    return QuerySpec(tuple(items), table, alias, bool(distinct), joins, terms("WHERE"), listed("GROUP BY"), terms("HAVING"), listed("ORDER BY"), int(limit[0]) if limit else None)


def columns_of(part: str) -> list[str]:
    """Columns in an expression, qualified as they stand."""
    t, out, k = tokens(part), [], 0
    while k < len(t):
        if _name(t[k]) and not (k + 1 < len(t) and t[k + 1] == "("):
            if k + 2 < len(t) and t[k + 1] == "." and _name(t[k + 2]):
                out.append(f"{t[k]}.{t[k + 2]}")
                k += 2
            else:
                out.append(t[k])
        k += 1
    return out


def literals_of(part: str) -> list[str]:
    return [t for t in tokens(part) if t[0] == "'" or t[0].isdigit()]


def join_conditions(spec: QuerySpec, aliased: bool = True) -> list[str]:
    """Equalities of two qualified columns in ON, or in WHERE between listed tables, with aliases or with tables' names."""
    real = {a: t for t, a in spec.tables()}
    terms = [c for j in spec.joins for c in j.on] + [c for _, c in spec.where if any(j.kind == "," for j in spec.joins)]
    out = []
    for c in terms:
        if m := re.fullmatch(r"`?(\w+)`?\.`?(\w+)`? = `?(\w+)`?\.`?(\w+)`?", c):
            a, x, b, y = m.groups()
            out.append(f"{a}.{x} = {b}.{y}" if aliased else f"{real.get(a, a)}.{x} = {real.get(b, b)}.{y}")
    return out


def structure(spec: QuerySpec) -> dict:
    """Counts that describe a query: tables, joins, distinct joined pairs, cycles, conditions, projections, and clause flags."""
    pairs = {frozenset(x.split(".")[0] for x in c.split(" = ")) for c in join_conditions(spec)}
    pairs = {p for p in pairs if len(p) == 2}
    names = {a for _, a in spec.tables()}
    root = {n: n for n in names}

    def find(n: str) -> str:
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for p in pairs:
        a, b = map(find, p)
        root[a] = b
    parts = len({find(n) for n in names})
    cycles = len(pairs) - len(names) + parts
    whole = " ".join(e for e, _ in spec.select) + " " + " ".join(t for _, t in spec.having)
    return {
        "num_nodes": len(names), "num_edges": len(pairs), "num_joins": sum(j.kind != "," for j in spec.joins), "avg_degree": 2.0 * len(pairs) / len(names),
        "is_cyclic": cycles > 0, "num_cycles": cycles, "num_conditions": len(spec.where), "num_projections": len(spec.select),
        "has_group_by": bool(spec.group_by), "has_having": bool(spec.having), "has_aggregation": bool(re.search(r"\b(count|sum|avg|min|max)\(", whole, re.I)),
    }


def gold_links(spec: QuerySpec) -> dict[str, list[str]]:
    """Tables and columns that a query uses: with one table every column is its own, else qualified ones are."""
    real = {a: t for t, a in spec.tables()}
    out: dict = {t: set() for t, _ in spec.tables()}
    parts = [e for e, _ in spec.select] + [t for _, t in (*spec.where, *spec.having)] + [*spec.group_by, *spec.order_by] + [c for j in spec.joins for c in j.on]
    named = {a for _, a in spec.select if a}
    for c in (x for p in parts for x in columns_of(p)):
        table, dot, column = c.rpartition(".")
        if dot and table in real:
            out[real[table]].add(column)
        elif not dot and len(out) == 1 and c not in named:
            out[spec.table].add(c)
    return {t: sorted(v) for t, v in out.items()}


def central_attributes(spec: QuerySpec, table: str) -> dict[str, list[str]]:
    """Columns of a table that a query joins by, and those it selects or filters by."""
    own = {a for t, a in spec.tables() if t.lower() == table.lower()}
    lone = len(spec.tables()) == 1
    mine = lambda parts: {c.rpartition(".")[2] for p in parts for c in columns_of(p) if c.rpartition(".")[0] in own or lone and "." not in c}
    joins = mine(join_conditions(spec))
    named = {a for _, a in spec.select if a}
    rest = mine([e for e, _ in spec.select] + [t for _, t in spec.where if t not in join_conditions(spec)]) - named
    return {"joins": sorted(joins), "projections_and_filters": sorted(rest)}


#: The rows of a parsed corpus.
RECORD = "question_id int, db_id string, sql string, is_nested boolean, tables array<string>, joins array<string>, num_tables int"


def record(question_id: int, db_id: str, sql: str) -> dict:
    """A query as the row of a parsed corpus: nested ones, and what can't be read, keep their text alone."""
    try:
        spec = parse(sql)
    except NotFlat:
        return {"question_id": question_id, "db_id": db_id, "sql": sql, "is_nested": True, "tables": [], "joins": [], "num_tables": 0}
    return {"question_id": question_id, "db_id": db_id, "sql": sql, "is_nested": False, "tables": [f"{t} {a}" for t, a in spec.tables()], "joins": join_conditions(spec), "num_tables": len(spec.tables())}
