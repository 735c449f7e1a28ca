"""Greedy matching of rows in tiers of overlap, without a row for each pair.

Pairs are taken by falling weight, then by the order of both rows.  All pairs of one weight are a tier, and once a
tier is done no pair of its weight or more is left.  So in the next one two rows that share ``k`` cells share no
more, and the pairs of the tier are those of groups: rows with the same cells at the same ``k`` places.  A group
whose rows have nowhere earlier to go is matched at once, first with first and so on, however large it is; the
work of a round is linear in the rows and the groups that they are in.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import combinations
from math import comb
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators import matching
from plumbline.operators.graph import cut

#: Rounds of a tier; rows that are then left are matched by pairs.
ROUNDS = 30
#: Cells that both sides have, and classes of rows by them, with which a case is settled on the driver.
LIVE, CLASSES = 2000, 1000


def pairs(rest: DataFrame, by: tuple[str, ...], by_tokens: bool) -> DataFrame:
    """``(*by, pairs)``: how many pairs of rows an index by cells would make, without making any."""
    each = rest.select(*by, (F.explode("key") if by_tokens else F.posexplode("key")).alias(*(["cell"] if by_tokens else ["at", "cell"])), "g", "p")
    cells = each.groupBy(*by, *([] if by_tokens else ["at"]), "cell").agg(F.count_if(F.col("g") > 0).alias("a"), F.count_if(F.col("p") > 0).alias("b"))
    return cells.groupBy(*by).agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("pairs"))


def _live(rest: DataFrame, by: tuple[str, ...], by_tokens: bool) -> DataFrame:
    """``(*by, at, h, pairs)``: cells (by their hashes) that rows of both sides have, and how many pairs of rows each makes."""
    each = rest.select(*by, (F.explode("key") if by_tokens else F.posexplode("key")).alias(*(["cell"] if by_tokens else ["at", "cell"])), "g", "p")
    at = F.lit(0) if by_tokens else F.col("at")
    cells = each.groupBy(*by, at.alias("at"), F.xxhash64("cell").alias("h")).agg(F.count_if(F.col("g") > 0).alias("a"), F.count_if(F.col("p") > 0).alias("b"))
    return cells.where("a > 0 AND b > 0").select(*by, "at", "h", (F.col("a").cast("double") * F.col("b")).alias("pairs"))


def gained(rest: DataFrame, by: tuple[str, ...] = (), by_tokens: bool = False) -> DataFrame:
    """``(*by, more)``: the cells that ``matched`` pairs have in common; cases without any may be left out.

    Large cases are settled by classes of rows where no order of rows can matter (see ``_settled``), others row by row.
    """
    rest = cut(rest)
    live = cut(_live(rest, by, by_tokens))
    told = [r for r in live.groupBy(*by).agg(F.sum("pairs").alias("pairs"), F.count("*").alias("n")).collect() if r["n"]]  # a row for each case
    own = lambda df, r: df.where(reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in by], F.lit(True)))
    done, open_ = [], []
    for r in told:
        large = r["pairs"] > matching.EDGES_AT_ONCE and r["n"] <= LIVE
        more = _settled(own(rest, r), [(x["at"], x["h"]) for x in own(live, r).collect()], by_tokens) if large else None
        (open_ if more is None else done).append((*(r[c] for c in by), *([] if more is None else [more])))
    kinds = [f"`{c}` {rest.schema[c].dataType.simpleString()}" for c in by]
    out = rest.sparkSession.createDataFrame(done, ", ".join([*kinds, "more long"]))
    if not open_:
        return out
    left = rest.join(F.broadcast(rest.sparkSession.createDataFrame(open_, ", ".join(kinds))), list(by), "left_semi") if by else rest  # a row for each case
    return out.unionByName(matched(left, by, by_tokens).groupBy(*by).agg(F.coalesce(F.sum(F.col("gain") * F.col("n")), F.lit(0)).alias("more")))


def _settled(rest: DataFrame, live: list[tuple[int, int]], by_tokens: bool) -> int | None:
    """The cells in common of one case by classes of rows, or None if there are too many or the order of rows may matter.

    Cells that one side alone has make no pair, so rows of a size with the same other cells are alike.  If in each tier every class
    has rows to share with one class of the other side at most, the smaller of both is matched, whichever its rows are.
    """
    there = lambda x, k: F.xxhash64(x).isin([h for at, h in live if at == k])
    if by_tokens:
        kept = F.filter("key", lambda x: there(x, 0))
    else:
        places = sorted({at for at, _ in live})
        kept = F.array(*[F.when(there(F.get("key", F.lit(k)), k), F.get("key", F.lit(k))) for k in places])
    found = rest.groupBy(F.size("key").alias("size"), kept.alias("kept")).agg(F.sum("g").alias("g"), F.sum("p").alias("p")).limit(CLASSES + 1).collect()
    if len(found) > CLASSES:
        return None
    weights: dict = {}
    for a, x in enumerate(found):
        for b, y in enumerate(found):
            if x["g"] and y["p"]:
                k = len(set(x["kept"]) & set(y["kept"])) if by_tokens else sum(c is not None and c == d for c, d in zip(x["kept"], y["kept"]))
                if k:
                    weights.setdefault(Fraction(k, x["size"] + y["size"] - k) if by_tokens else k, []).append((a, b, k))
    left, total = ([r["g"] for r in found], [r["p"] for r in found]), 0
    for w in sorted(weights, reverse=True):
        tier = [(a, b, k) for a, b, k in weights[w] if left[0][a] and left[1][b]]
        if any(len({x[side] for x in tier}) < len(tier) for side in (0, 1)):
            return None
        for a, b, k in tier:
            n = min(left[0][a], left[1][b])
            left[0][a] -= n
            left[1][b] -= n
            total += k * n
    return total


def matched(rest: DataFrame, by: tuple[str, ...] = (), by_tokens: bool = False) -> DataFrame:
    """``(*by, gk, pk, gain, n)``: pairs taken in order of (weight down, gk, pk), each as often as both rows are left.

    ``rest``: (*by, key array<string>, g, p), the counts of rows that no equal one matches.  The weight is the number of equal cells
    at the same places, or the Jaccard index of sets of tokens.  Cases that an index by cells makes few pairs of are
    matched by pairs, others in tiers; the result is the same.
    """
    edges = matching.token_edges if by_tokens else matching.cell_edges
    rest = cut(rest)
    large = pairs(rest, by, by_tokens).where(F.col("pairs") > matching.EDGES_AT_ONCE).select(*by, "pairs").collect()  # a row for each large case
    if not large:
        return matching.greedy(edges(rest, by), by)
    if not by:
        return in_tiers(rest, by_tokens)
    kinds = ", ".join(f"`{c}` {rest.schema[c].dataType.simpleString()}" for c in by)
    out = matching.greedy(edges(rest.join(rest.sparkSession.createDataFrame([tuple(r[c] for c in by) for r in large], kinds), list(by), "left_anti"), by), by)
    for r in large:
        own = rest
        for c in by:
            own = own.where(F.col(c).eqNullSafe(F.lit(r[c])))
        out = out.unionByName(in_tiers(own.select("key", "g", "p"), by_tokens).withColumns({c: F.lit(r[c]) for c in by}).select(*by, "gk", "pk", "gain", "n"))
    return out


def _tiers(sizes: tuple[list[int], list[int]], by_tokens: bool) -> list[list[tuple[int, int, int]]]:
    """Tiers of falling weight, each as (size of a gold row, size of a predicted one, cells in common)."""
    kinds: dict = {}
    for a in sizes[0]:
        for b in sizes[1]:
            for k in range(1, min(a, b) + 1):
                if k < max(a, b) or not by_tokens and a != b:  # equal rows are gone
                    kinds.setdefault(Fraction(k, a + b - k) if by_tokens else Fraction(k), []).append((a, b, k))
    return [kinds[w] for w in sorted(kinds, reverse=True)]


def _groups(side: int, tier: list[tuple[int, int, int]], by_tokens: bool) -> Column:
    """The groups of a row in a tier: (b, gain)."""
    out = F.array().cast("array<struct<b:string,gain:int>>")
    for kind in tier:
        at = list(combinations(range(kind[side]), kind[2]))
        said = lambda s: F.concat(F.lit(f"{kind if by_tokens else s}"), F.to_json(F.array(*[F.get("key", F.lit(i)) for i in s])))  # noqa: E731, B023
        these = F.array(*[F.struct(F.md5(said(s)).alias("b"), F.lit(kind[2]).alias("gain")) for s in at])
        out = F.concat(out, F.when(F.size("key") == kind[side], these).otherwise(F.array().cast("array<struct<b:string,gain:int>>")))
    return out


def _round(gold: DataFrame, pred: DataFrame, tier: list, by_tokens: bool) -> DataFrame | None:
    """``(og, op, gain)``: pairs of the tier that nothing earlier can prevent; None if the tier has none left.

    Each row prefers the group with the earliest row of the other side.  In a group the rows of either side are put
    in order; equal ranks are a pair as long as, for it and all earlier ranks, both rows prefer this group and have no
    earlier partner in another.
    """
    members = None
    for side, df in enumerate((gold, pred)):
        part = df.select(F.lit(side).alias("side"), "o", F.explode(_groups(side, tier, by_tokens)).alias("x")).select("side", "o", "x.b", "x.gain")
        members = part if members is None else members.unionAll(part)
    firsts = members.groupBy("b").agg(F.min(F.when(F.col("side") == 0, F.col("o"))).alias("fg"), F.min(F.when(F.col("side") == 1, F.col("o"))).alias("fp")).where("fg IS NOT NULL AND fp IS NOT NULL")
    members = cut(members.join(firsts, "b").select("side", "o", "b", "gain", F.when(F.col("side") == 0, F.col("fp")).otherwise(F.col("fg")).alias("first")))
    if members.isEmpty():
        return None
    # a row's two groups with the earliest partners; no row is in more groups than it has combinations of cells
    two = F.slice(F.array_sort(F.collect_list(F.struct("first", "b")).over(W.partitionBy("side", "o"))), 1, 2)
    members = members.withColumn("two", two).select("side", "o", "b", "gain", (F.get("two", F.lit(0))["b"] == F.col("b")).alias("here"), F.get("two", F.lit(1))["first"].alias("other"),
                                                    F.shiftright("o", 33).alias("part"))
    # ranks in a group of any size: its rows lie in ranges, whose counts come before them
    counts = members.groupBy("b", "side", "part").agg(F.count("*").alias("n"))
    before = counts.select("b", "side", "part", (F.sum("n").over(W.partitionBy("b", "side").orderBy("part")) - F.col("n")).alias("before"))
    ranked = members.join(before, ["b", "side", "part"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("b", "side", "part").orderBy("o")))
    g = ranked.where("side = 0").select("b", "rank", "gain", F.col("o").alias("og"), F.col("here").alias("here_g"), F.col("other").alias("other_g"))
    p = ranked.where("side = 1").select("b", "rank", F.col("o").alias("op"), F.col("here").alias("here_p"), F.col("other").alias("other_p"))
    sure = F.col("here_g") & F.col("here_p") & (F.col("other_g").isNull() | (F.col("other_g") > F.col("op"))) & (F.col("other_p").isNull() | (F.col("other_p") > F.col("og")))
    pairs_ = cut(g.join(p, ["b", "rank"]).select("b", "rank", "gain", "og", "op", sure.alias("sure")))
    ends = pairs_.where("NOT sure").groupBy("b").agg(F.min("rank").alias("end"))
    return cut(pairs_.join(ends, "b", "left").where("end IS NULL OR rank < end").select("og", "op", "gain"))


def _units(rest: DataFrame, side: str) -> DataFrame:
    """``(o, key)``: each row as often as it is left, numbered in the order of the rows; the number's high bits tell its range."""
    rows = rest.where(F.col(side) > 0).select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col(side))).alias("d"))
    return cut(rows.orderBy("key", "d").select(F.monotonically_increasing_id().alias("o"), "key"))


def in_tiers(rest: DataFrame, by_tokens: bool = False) -> DataFrame:
    """``matched`` of one case in tiers; as soon as pairs are fewer than the groups that rows are in, the rest is matched by pairs."""
    start = {"g": _units(rest, "g"), "p": _units(rest, "p")}
    gold, pred = start["g"], start["p"]
    sizes = tuple([r[0] for r in d.select(F.size("key")).distinct().collect()] for d in (gold, pred))  # as many as there are columns at most
    taken, last = [], None
    for tier in _tiers(sizes, by_tokens):
        left = _counted(gold, pred)
        made, rows = pairs(left, (), by_tokens).first()["pairs"], gold.count() + pred.count()
        groups = rows * max(sum(comb(kind[side], kind[2]) for kind in tier) for side in (0, 1))
        done = made <= max(matching.EDGES_AT_ONCE, groups / 8)
        here = (gold, pred)
        for _ in range(0 if done else ROUNDS):
            won = _round(*here, tier, by_tokens)
            if won is None:
                break
            taken.append(won)
            here = tuple(d.join(won.select(F.col(c).alias("o")), "o", "left_anti") for d, c in zip(here, ("og", "op")))
            here = tuple(cut(d) for d in here)
        else:
            last = matching.greedy((matching.token_edges if by_tokens else matching.cell_edges)(_counted(*here)))
            break
        gold, pred = here
    out = None
    for won in taken:
        out = won if out is None else out.unionAll(won)
    if out is not None:
        out = out.join(start["g"].select(F.col("o").alias("og"), F.col("key").alias("gk")), "og").join(start["p"].select(F.col("o").alias("op"), F.col("key").alias("pk")), "op")
        out = out.groupBy("gk", "pk").agg(F.first("gain").cast("long").alias("gain"), F.count("*").alias("n"))
    if last is not None:
        out = last.select("gk", "pk", "gain", "n") if out is None else out.unionByName(last.select("gk", "pk", "gain", "n"))
    if out is None:
        return rest.sparkSession.createDataFrame([], "gk array<string>, pk array<string>, gain long, n long")
    return out


def _counted(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Units as rows with counts again."""
    one = lambda d, g, p: d.select("key", F.lit(g).cast("long").alias("g"), F.lit(p).cast("long").alias("p"))
    return one(gold, 1, 0).unionAll(one(pred, 0, 1)).groupBy("key").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
