"""Graphs as edge tables: schema graphs, query graphs, and what is measured on them.

Tables of graphs have columns (graph_id, src, dst).  Degrees, components and summaries are joins and
aggregations for graphs of any size; what enumerates (cycles, canonical forms, centrality) works on
one query-sized graph at a time inside a grouped function.
"""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.session import shared_folder

Edges = list[tuple]


# ---- tables of any size

def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept as files in the folder that ``spark.checkpoint.dir`` names."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as ``(a, b)``: each vertex but the root, and its root (the least).

    Alternating large and small stars (Kiveris et al., 2014): every round is a few equi-joins on
    pre-aggregated minima.  The minima are cut off first, so that both sides of a join come straight
    from a shuffle and adaptive execution can split a hub's edges over tasks.  Rounds grow as the
    logarithm of a component's length.  Null or empty input gives no rows; self-loops are ignored.
    """

    def stamp(e: DataFrame) -> tuple:
        got = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return (got["n"], got["h"])

    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    last = stamp(e)
    while last[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = (
            both.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        e = cut(small)
        now = stamp(e)
        if now == last:
            break
        last = now
    return e


def schema_edges(fks: DataFrame, siblings: bool = True) -> DataFrame:
    """``(src, dst, labels)`` with src < dst: foreign keys, and (siblings) pairs of tables that refer to one column.

    ``fks``: (from_table, from_column, to_table, to_column).  References of a table to itself are left out.
    """
    eq = lambda t, c, u, d: F.concat(F.col(t), F.lit("."), F.col(c), F.lit(" = "), F.col(u), F.lit("."), F.col(d))
    rows = fks.where("from_table <> to_table").select("from_table", "to_table", eq("from_table", "from_column", "to_table", "to_column").alias("label"))
    if siblings:
        a, b = (fks.select(*[F.col(c).alias(f"{p}_{c}") for c in fks.columns]) for p in "ab")
        same = (F.col("a_to_table") == F.col("b_to_table")) & (F.col("a_to_column") == F.col("b_to_column")) & (F.col("a_from_table") < F.col("b_from_table"))
        rows = rows.union(a.join(b, same).select("a_from_table", "b_from_table", eq("a_from_table", "a_from_column", "b_from_table", "b_from_column")))
    return rows.groupBy(F.least("from_table", "to_table").alias("src"), F.greatest("from_table", "to_table").alias("dst")).agg(
        F.array_sort(F.collect_set("label")).alias("labels"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, degree)`` of undirected simple graphs."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("graph_id", "node").agg(F.count("*").alias("degree"))


def summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, n_nodes, n_edges, n_components, n_cycles, avg_degree)``; independent cycles are E - V + C."""
    key = lambda c: F.to_json(F.struct("graph_id", F.col(c).alias("node")))
    roots = components(edges.select(key("src").alias("a"), key("dst").alias("b")))
    v = nodes.select("graph_id", "node", key("node").alias("a")).join(roots, "a", "left").groupBy("graph_id").agg(
        F.count("*").alias("n_nodes"), F.count_distinct(F.coalesce("b", "a")).alias("n_components"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    n = F.coalesce("n_edges", F.lit(0))
    return v.join(e, "graph_id", "left").select(
        "graph_id", "n_nodes", n.alias("n_edges"), "n_components", (n - F.col("n_nodes") + F.col("n_components")).alias("n_cycles"), (2.0 * n / F.col("n_nodes")).alias("avg_degree"))


def distances(edges: DataFrame) -> DataFrame:
    """``(graph_id, src, dst, d)``: shortest distances of all ordered pairs, by widening a frontier one edge a round.

    As many rows as pairs, so for graphs the size of schemas."""
    both = edges.select("graph_id", "src", "dst").union(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen, d = cut(both.withColumn("d", F.lit(1))), 1
    front = seen
    while not front.isEmpty():
        step = front.select("graph_id", "src", F.col("dst").alias("via")).join(both.select("graph_id", F.col("src").alias("via"), "dst"), ["graph_id", "via"])
        d += 1
        front = cut(step.where("src <> dst").select("graph_id", "src", "dst").distinct().join(seen, ["graph_id", "src", "dst"], "left_anti").withColumn("d", F.lit(d)))
        seen = cut(seen.union(front))
    return seen


def diameters(edges: DataFrame) -> DataFrame:
    """``(graph_id, diameter)``: the largest distance within a component."""
    return distances(edges).groupBy("graph_id").agg(F.max("d").alias("diameter"))


# ---- one small graph

def neighbours(edges: Edges) -> dict:
    out: dict = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def simple_cycles(edges: Edges) -> list[tuple]:
    """Each simple cycle once: it begins at its least node and goes on to the lesser of that node's two neighbours."""
    near, out = neighbours(edges), []

    def walk(path: list) -> None:
        for n in sorted(near[path[-1]]):
            if n == path[0] and len(path) > 2 and path[1] < path[-1]:
                out.append(tuple(path))
            elif n > path[0] and n not in path:
                walk([*path, n])

    for start in sorted(near):
        walk([start])
    return sorted(out, key=lambda c: (len(c), c))


def is_connected(nodes: list, edges: Edges) -> bool:
    if not nodes:
        return False
    near, seen, todo = neighbours(edges), {nodes[0]}, [nodes[0]]
    while todo:
        for n in near[todo.pop()]:
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return len(seen) == len(set(nodes))


def degree_encoding(nodes: list, edges: Edges) -> tuple:
    """Equal for isomorphic graphs (but not only): for each node its degree and its neighbours' degrees, sorted."""
    near = neighbours(edges)
    return tuple(sorted((len(near[n]), tuple(sorted(len(near[m]) for m in near[n]))) for n in nodes))


def isomorphic(a: tuple[list, Edges], b: tuple[list, Edges]) -> bool:
    """Whether two graphs (nodes, edges) have the same structure; most that haven't differ in their degrees already."""
    return degree_encoding(*a) == degree_encoding(*b) and canonical(*a) == canonical(*b)


def canonical(nodes: list, edges: Edges) -> str:
    """A text that two graphs share exactly if they are isomorphic: the least adjacency string over the orders that
    colour refinement leaves.

    Nodes of one colour are split by how many neighbours of each colour they have, until nothing changes; then one of the
    first class that has several is told apart, each in its turn.  Regular graphs leave most orders.
    """
    near, order = neighbours(edges), sorted(nodes, key=str)

    def refined(colour: dict) -> dict:
        while True:
            signs = {n: (colour[n], tuple(sorted(colour[m] for m in near[n]))) for n in order}
            places = {s: k for k, s in enumerate(sorted(set(signs.values())))}
            new = {n: places[signs[n]] for n in order}
            if len(places) == len(set(colour.values())):
                return new
            colour = new

    best: list = [None]

    def walk(colour: dict) -> None:
        colour = refined(colour)
        classes: dict = defaultdict(list)
        for n in order:
            classes[colour[n]].append(n)
        several = next((classes[k] for k in sorted(classes) if len(classes[k]) > 1), None)
        if several is None:
            o = sorted(order, key=colour.get)
            text = "".join("01"[b in near[a]] for a, b in combinations(o, 2))
            if best[0] is None or text < best[0]:
                best[0] = text
            return
        # nodes with the same neighbours (but for each other) may stand for each other: one of them is enough
        tried: set = set()
        for n in several:
            twin = (frozenset(near[n] - {n}), 0), (frozenset(near[n] | {n}), 1)
            if not tried & set(twin):
                tried |= set(twin)
                walk({m: 2 * c + (m != n and c == colour[n]) for m, c in colour.items()})

    walk(dict.fromkeys(order, 0))
    return f"{len(nodes)}:{best[0] or ''}"


def is_tree(nodes: list, edges: Edges) -> bool:
    """Whether a graph is connected and has one edge less than nodes."""
    return is_connected(nodes, edges) and len({frozenset(e) for e in edges}) == len(set(nodes)) - 1


def find_cycle(edges: Edges) -> tuple | None:
    """A simple cycle, the shortest, or None."""
    return next(iter(simple_cycles(edges)), None)


def degree_centrality(nodes: list, edges: Edges) -> dict:
    """Each node's neighbours as a share of all others."""
    near = neighbours(edges)
    return {n: len(near[n]) / max(1, len(set(nodes)) - 1) for n in nodes}


def betweenness(nodes: list, edges: Edges) -> dict:
    """Normalised betweenness (Brandes, 2001): the share of shortest paths between others that pass a node."""
    near, out = neighbours(edges), dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, before, paths, far = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    todo.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share: dict = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in out.items()}


def central_node(nodes: list, edges: Edges):
    """The node that most shortest paths pass, of equals the one with most edges, then the least; None below three nodes."""
    if len(nodes) < 3:
        return None
    b, near = betweenness(nodes, edges), neighbours(edges)
    return min(nodes, key=lambda n: (-round(b[n], 9), -len(near[n]), n))


def grown_patterns(patterns: list[tuple[int, Edges]]) -> list[tuple[int, Edges]]:
    """Connected graphs with one node more, each class of isomorphic ones once: a node joined to every non-empty set of nodes."""
    out: dict = {}
    for n, edges in patterns:
        for bits in range(1, 1 << n):
            more = edges + [(k, n) for k in range(n) if bits >> k & 1]
            out.setdefault(canonical(list(range(n + 1)), more), (n + 1, more))
    return [out[k] for k in sorted(out)]


def patterns(most: int) -> list[tuple[int, Edges]]:
    """All connected graphs of 2 to ``most`` nodes up to isomorphism."""
    level, out = [(2, [(0, 1)])], []
    while level and level[0][0] <= most:
        out += level
        level = grown_patterns(level) if level[0][0] < most else []
    return out


def instances(nodes: list, edges: Edges, most: int) -> dict[str, int]:
    """How often each pattern of 2 to ``most`` nodes occurs as a connected subgraph (any of the edges among its nodes)."""
    out: dict = defaultdict(int)
    edges = sorted({tuple(sorted(e)) for e in edges})
    for size in range(2, most + 1):
        for chosen in combinations(sorted(nodes), size):
            own = [e for e in edges if e[0] in chosen and e[1] in chosen]
            for k in range(size - 1, len(own) + 1):
                for part in combinations(own, k):
                    if is_connected(list(chosen), list(part)):
                        out[canonical(list(chosen), list(part))] += 1
    return dict(out)


# ---- small graphs by the table

def per_graph(edges: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(graph_id, nodes, edges)``, a list of rows, for each graph of query size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["src"], pdf["dst"]))
        rows = fn(pdf["graph_id"].iloc[0], sorted({x for p in pairs for x in p}), pairs)
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return edges.groupBy("graph_id").applyInPandas(run, schema)


def cycles(edges: DataFrame) -> DataFrame:
    """``(graph_id, length, cycle)`` of every simple cycle."""
    return per_graph(edges, lambda g, n, e: [(g, len(c), "-".join(map(str, c))) for c in simple_cycles(e)], "graph_id string, length int, cycle string")


def canonical_forms(edges: DataFrame) -> DataFrame:
    """``(graph_id, iso_key)``: graphs with one key are isomorphic, so comparing all pairs is a group-by."""
    return per_graph(edges, lambda g, n, e: [(g, canonical(n, e))], "graph_id string, iso_key string")


def centralities(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, betweenness, is_central)``."""

    def rows(g, n, e):
        c = central_node(n, e)
        return [(g, v, b, v == c) for v, b in sorted(betweenness(n, e).items())]

    return per_graph(edges, rows, "graph_id string, node string, betweenness double, is_central boolean")


def graph_groups(summary: DataFrame) -> DataFrame:
    """Graphs by number of nodes: how many, their share, average degree and the share with cycles."""
    g = summary.groupBy("n_nodes").agg(F.count("*").alias("n_graphs"), F.avg("avg_degree").alias("avg_degree"), F.avg((F.col("n_cycles") > 0).cast("double")).alias("cyclic_share"))
    return g.withColumn("share", F.col("n_graphs") / F.sum("n_graphs").over(W.partitionBy()))


def matched_patterns(edges: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(graph_id, iso_key, pattern_id)``: each graph with its pattern of the catalogue (iso_key, pattern_id), by equal canonical forms.

    A single edge is pattern ``edge``; what the catalogue doesn't have has none.  Graphs of one node have no edges, so no row here."""
    found = canonical_forms(edges).join(F.broadcast(catalogue.select("iso_key", "pattern_id")), "iso_key", "left")  # a row for each pattern
    return found.select("graph_id", "iso_key", F.coalesce("pattern_id", F.when(F.col("iso_key") == "2:1", "edge")).alias("pattern_id"))
