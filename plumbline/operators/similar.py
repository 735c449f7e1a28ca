"""Words that are nearly equal, found by pieces that they must share instead of all pairs.

The ratio of two words is twice their longest common subsequence by both lengths, in percent.  For a least ratio
it takes no more than some number of letters put in or left out to come from one to the other, say ``d``.  Cut into
``d + 1`` pieces, one word has a piece that none of them touches, which the other has as well, at most ``d`` places away.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import cut

#: Below this a word may have fewer letters than it needs pieces.
LEAST = 70.0


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a word of bits at a time (Hyyrö, 2004)."""
    masks: dict[str, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    free = full
    for x in b:
        hit = free & masks.get(x, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; of two empty words 100."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _edits(n: int, m: int, least: float) -> int:
    """Letters that may be put in or left out between words of these lengths."""
    return int((1 - least / 100) * (n + m) + 1e-9)


def _cuts(n: int, pieces: int) -> list[tuple[int, int]]:
    """Start and end of pieces of nearly equal length."""
    ends = [n * k // pieces for k in range(pieces + 1)]
    return list(zip(ends, ends[1:]))


def _lengths(n: int, least: float) -> range:
    """The lengths of words that may be like one of ``n`` letters."""
    share = least / 200
    low, high = n * share / (1 - share), n * (1 - share) / share
    return range(max(1, int(low - 1e-9)), int(high + 1e-9) + 1)


def pieces(word: str, least: float, left: bool, lengths: frozenset[int] | None = None) -> set[str]:
    """The keys by which a word is met: its pieces for each length that a partner may have (of ``lengths``, if given), or,
    as the partner, all that could be such a piece."""
    n, out = len(word), set()
    for m in _lengths(n, least):
        d = _edits(n, m, least)
        if abs(n - m) > d or lengths is not None and m not in lengths:
            continue
        own, other = (n, m) if left else (m, n)
        for k, (a, b) in enumerate(_cuts(own, d + 1)):
            places = [a] if left else range(max(0, a - d), min(n - (b - a), a + d) + 1)
            out |= {f"{own},{other},{k},{word[s : s + b - a]}" for s in places}
    return out


def _lengths_of(words: DataFrame) -> frozenset[int]:
    """The lengths that words have: as many rows as the longest has letters at most."""
    return frozenset(r[0] for r in words.select(F.length("word")).distinct().collect())


def _keyed(words: DataFrame, least: float, left: bool, lengths: frozenset[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):  # a long word has many pieces
                said = [(w, key) for w in batch.column(0).slice(k, 500).to_pylist() for key in pieces(w, least, left, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in said], pa.string()), pa.array([x for _, x in said], pa.string())], ["word", "key"])

    return words.mapInArrow(run, "word string, key string")


def similar(left: DataFrame, right: DataFrame, left_col: str, right_col: str, least: float = 85.0) -> DataFrame:
    """``(left, right, ratio)`` of all pairs of different entries of both columns whose ratio is ``least`` or more.

    Repeated words count once, equal ones on both sides are a pair; null and empty words have none.  Below LEAST
    ValueError is raised.
    """
    if not LEAST <= least <= 100:
        raise ValueError(f"the least ratio must be {LEAST} to 100")
    own = [cut(d.select(F.col(c).alias("word")).where("word <> ''").distinct()) for d, c in ((left, left_col), (right, right_col))]
    a, b = _keyed(own[0], least, True, _lengths_of(own[1])), _keyed(own[1], least, False, _lengths_of(own[0]))
    pairs = a.select(F.col("word").alias("left"), "key").join(b.select(F.col("word").alias("right"), "key"), "key").select("left", "right").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [ratio(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            keep = pa.array([r >= least - 1e-9 for r in told], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), pa.array(told, pa.float64()).filter(keep)], ["left", "right", "ratio"])

    return pairs.mapInArrow(run, "left string, right string, ratio double")
