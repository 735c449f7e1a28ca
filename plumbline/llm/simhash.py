"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has 64 bits; two link at ``radius`` differing bits or fewer.  With the bits cut into
``radius + fixed`` blocks, two linked fingerprints agree on at least ``fixed`` whole blocks.  So the
top of the index has a node for each choice of ``fixed`` blocks and each value of those bits (a
masked pattern); the shuffle deals these nodes to tasks.  Below a node its fingerprints stand in
order of their Gray rank, and groups of neighbours are factored, level by level, into upper nodes
that hold the bits all members share.  A search goes down from the top with the differences added
up so far, leaves a whole group when they pass the radius, and takes a whole group at once when
even its free bits cannot pass it (Tang et al., EDBT 2015: the HA-index).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.operators.graph import components, cut

#: Fingerprints of a top node that are worked on at once.
NODE = 1_000_000
#: How often a node of more is dealt again; each time it is dealt five times, by other bits.
DEPTH = 2
#: Tasks over which the fingerprints of one component are dealt.
PARTS = 16
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text over shingles of ``words`` words.

    A-Z is lower-cased, words are parted by ASCII white space, repeats count; a text with fewer
    words is one shingle; without words (or null) the result is 0.
    """
    import xxhash

    split = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not split:
        return 0
    joined, n = b" ".join(split), max(1, len(split) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[words - 1 :] if len(split) >= words else ends[-1:]
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = [h(joined[i:j], seed) for i, j in zip(starts[k : k + 65536].tolist(), ends[k : k + 65536].tolist())]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8)).reshape(-1, 64)
        for m in range(0, len(bits), 255):  # so few that their sum fits the bytes
            counts += np.add.reduce(bits[m : m + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id_col, fp long)`` for each row of ``df``; no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(cols: list) -> dict:
        fps = np.array([fingerprint(t, words) for t in cols[1]], np.uint64).view(np.int64)
        return {id_col: cols[0], "fp": fps}

    return common.mapped(df, [id_col, text_col], run, f"`{id_col}` {kind}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit value in the reflected Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def masks(radius: int, fixed: int) -> list[int]:
    """The bits of each choice of ``fixed`` out of ``radius + fixed`` blocks, as signed 64-bit values."""
    edges = [round(64 * k / (radius + fixed)) for k in range(radius + fixed + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    found = [sum(c) for c in combinations(blocks, fixed)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def finer_masks(mask: int, radius: int) -> list[int]:
    """A mask with each of ``radius + 1`` parts of its free bits added: of two values within the radius
    that agree on the mask, at least one part agrees too."""
    free = [k for k in range(64) if not mask >> k & 1]
    edges = [round(len(free) * k / (radius + 1)) for k in range(radius + 2)]
    found = [(mask | sum(1 << k for k in free[lo:hi])) & ((1 << 64) - 1) for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in found]


class Index:
    """The hierarchical index of one batch of top nodes, as arrays, level by level.

    ``fps`` are in order of (group, Gray rank); a level has, for each node, the bits its members
    share, their values, and the range of its children below.
    """

    FAN = 8

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.fps, self.levels, self.size = fps, [], np.diff(np.r_[starts, len(fps)])
        ones, low, high = np.full(len(fps), ~np.uint64(0)), fps, fps
        first, member = np.arange(len(fps)), group
        self.levels.append((ones, fps, first, np.r_[first[1:], len(fps)], first))
        while len(low) > len(starts):
            begin = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
            inside = np.arange(len(low)) - np.repeat(begin, np.diff(np.r_[begin, len(low)]))
            at = np.flatnonzero(inside % self.FAN == 0)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            member, first = member[at], first[at]
            self.levels.append((~(low ^ high), low, at, np.r_[at[1:], len(inside)], first))

    def roots(self) -> np.ndarray:
        """For each fingerprint its group's root, a node of the last level."""
        return np.repeat(np.arange(len(self.size)), self.size)

    def links(self, radius: int, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (later, earlier) that connect all that is within the radius.

        A group whose free bits fit in what is left of the radius is linked by its first member
        alone: its members are then within the radius of each other, and link to that member too.
        ``limit`` bounds the pairs held at a time; larger fronts are cut and taken in turn.
        """
        n = len(self.fps)
        top, roots = len(self.levels) - 1, self.roots()
        stack = [(top, np.arange(k, min(n, k + limit)), roots[k : k + limit], None, None) for k in range(0, n, limit)]
        taken = [np.zeros(len(lv[0]), bool) for lv in self.levels]
        while stack:
            level, q, node, above, acc = stack.pop()
            if len(q) > limit:
                half = len(q) // 2
                for part in (slice(0, half), slice(half, None)):
                    stack.append((level, q[part], node[part], None if above is None else above[part], None if acc is None else acc[part]))
                continue
            shared, value, lo, hi, first = self.levels[level]
            bits = shared[node]
            fresh = bits if above is None else bits & ~above  # differences above these bits are added up already
            diff = np.bitwise_count((self.fps[q] ^ value[node]) & fresh).astype(np.int8)
            acc = diff if acc is None else acc + diff
            near = (acc <= radius) & (first[node] < q)
            q, node, bits, acc = q[near], node[near], bits[near], acc[near]
            if level == 0:
                if len(q):
                    yield q, first[node]
                continue
            whole = acc + np.bitwise_count(~bits) <= radius
            if whole.any():
                yield q[whole], first[node[whole]]
                mark = np.unique(node[whole])
                mark = mark[~taken[level][mark]]
                taken[level][mark] = True
                for m in mark.tolist():  # its members, to the first
                    a, b = m, m + 1
                    for lv in range(level, 0, -1):
                        a, b = self.levels[lv][2][a], self.levels[lv][3][b - 1]
                    yield np.arange(a + 1, b), np.full(b - a - 1, a)
            q, node, bits, acc = q[~whole], node[~whole], bits[~whole], acc[~whole]
            if len(q):
                width = (hi - lo)[node]
                offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                stack.append((level - 1, np.repeat(q, width), np.repeat(lo[node], width) + offset, np.repeat(bits, width), np.repeat(acc, width)))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the classes of a and b together, in place: label[i] <= i is a member's nearest known root."""
    while len(a):
        ra, rb = label[a], label[b]
        while (ra != label[ra]).any() or (rb != label[rb]).any():
            ra, rb = label[ra], label[rb]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


def _group_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that isn't first of its class within its group, and the class's first."""
    index, label = Index(fps, group), np.arange(len(fps))
    for a, b in index.links(radius):
        _merge(label, a, b)
    while (label != label[label]).any():
        label = label[label]
    late = np.flatnonzero(label != np.arange(len(fps)))
    return fps[late], fps[label[late]]


def links(fps: DataFrame, radius: int = 4, fixed: int = 2, most: int = NODE) -> DataFrame:
    """``(a, b)`` pairs of fingerprints that connect all distinct ``fp`` within ``radius`` of each other.

    Rows grow as the fingerprints times the number of masks (15 by default).  Within a top node
    only its fingerprints (8 bytes each) are held, as arrays; copies of a text count once.  Nodes of
    more than ``most`` fingerprints, which only as many can make, are dealt again by finer masks, up
    to DEPTH times; what is still together then is nearly equal, and is held whole by one task.
    """
    distinct, chosen = fps.select("fp").distinct(), masks(radius, fixed)

    def under(df: DataFrame, by: Column) -> DataFrame:
        return df.select("fp", F.explode(by).alias("x")).select("x.t", F.col("fp").bitwiseAND(F.col("x.mask")).alias("top"), "fp")

    told = lambda by: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in by])
    nodes, level = under(distinct, told(enumerate(chosen))), dict(enumerate(chosen))
    if distinct.limit(most + 1).count() > most:
        fitting, last = None, len(chosen)
        for depth in range(DEPTH + 1):
            heavy = cut(nodes.groupBy("t", "top").agg(F.count("*").alias("n")).where(F.col("n") > most).select("t", "top"))
            found = sorted(r["t"] for r in heavy.select("t").distinct().collect())  # masks, a few
            some = nodes if not found or depth == DEPTH else nodes.join(heavy, ["t", "top"], "left_anti")
            fitting = some if fitting is None else fitting.union(some)
            if not found or depth == DEPTH:  # what is together still is so alike that no part of its bits tells it apart: held whole
                break
            finer: dict = {t: list(enumerate(finer_masks(level[t], radius), last + k * (radius + 1))) for k, t in enumerate(found)}
            last += len(found) * (radius + 1)
            by = F.create_map(*[x for t, ms in finer.items() for x in (F.lit(t), told(ms))])
            dense = cut(nodes.join(heavy, ["t", "top"], "left_semi"))
            nodes, level = under(dense, by[F.col("t")]), {t: m for ms in finer.values() for t, m in ms}
        nodes = fitting
    dealt = nodes.repartition("t", "top").sortWithinPartitions("t", "top", gray_rank(F.col("fp")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: np.ndarray, top: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (t[1:] != t[:-1]) | (top[1:] != top[:-1])]
            group = np.cumsum(new)
            many = np.bincount(group)[group] > 1
            a, b = _group_links(fp[many].view(np.uint64), group[many], radius) if many.any() else (fp[:0], fp[:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        held: list = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            # what ends with the batch may go on in the next
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            at = last[-1] + 1 if len(last) else 0
            if held and not (at == 0 and held[-1][0][-1] == cols[0][0] and held[-1][1][-1] == cols[1][0]):
                done = [np.concatenate([h[k] for h in held] + [cols[k][:at]]) for k in range(3)]
                held = []
                yield found(*done)
            elif at:
                yield found(*[c[:at] for c in cols])
            held.append([c[at:].copy() for c in cols])
        if held:
            yield found(*[np.concatenate([h[k] for h in held]) for k in range(3)])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``(id_col, fp, fingerprint, component_id)``: one row for each row of ``df``.

    Rows link when their fingerprints differ in ``radius`` bits at most; ``component_id`` is the
    smallest id reachable, the row's own included.  Null text counts as empty (fingerprint 0,
    linked like any other); rows with a null id take part, but a null is never the smallest;
    repeated rows get equal results; an empty table gives none.  Links and components are found
    between distinct fingerprints, so any number of copies costs one of them.
    """
    fps = common.saved(fingerprints(df, id_col, text_col, words), "fingerprints")
    first = fps.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(links(first, radius))
    linked = roots.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(roots.select("b", "b").distinct())
    linked = cut(linked.join(first, "fp").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS))))
    # a component of any size is dealt to PARTS tasks; components alone, not single fingerprints, are told PARTS times
    least = linked.groupBy("root", "part").agg(F.min("first").alias("m")).groupBy("root").agg(F.min("m").alias("least"))
    told = least.select("root", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    of_linked = linked.join(told, ["root", "part"]).select("fp", "least")
    by_fp = common.saved(first.join(of_linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "components")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(by_fp, "fp").select(id_col, "fp", hexed, "component_id")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``df`` with one row of each component: that with the smallest id, unchanged.

    Null and empty texts are near copies of each other.  Rows of one id are one document: it stays if
    any of them is its component's smallest, as the row whose text sorts first.  Rows without an id
    can't be told apart and stay.  Columns of ``df`` may have any names; an empty table gives none.
    Only the ids that go meet the texts, and are broadcast where Spark finds them small enough, so
    the texts don't move then.
    """
    found = near_duplicates(df, id_col, text_col, words, radius).where(F.col(id_col).isNotNull())
    stays = F.col(id_col) == F.col("component_id")
    verdict = found.groupBy(F.col(id_col).alias(id_col)).agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n"))
    verdict = common.saved(verdict.where("not stays or n > 1"), "near-duplicates")
    kept = df.join(verdict.where("not stays").select(id_col), id_col, "left_anti").select(*[f"`{c}`" for c in df.columns])
    again = verdict.where("stays and n > 1").select(id_col)
    if again.isEmpty():
        return kept
    whole = F.struct(*[f"`{c}`" for c in df.columns])
    one = kept.join(again, id_col, "left_semi").groupBy(F.col(id_col).alias("id")).agg(F.min_by(whole, F.coalesce(text_col, F.lit(""))).alias("row"))
    return kept.join(again, id_col, "left_anti").select(*[f"`{c}`" for c in df.columns]).unionByName(one.select("row.*"))
