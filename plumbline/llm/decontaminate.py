"""Benchmark decontamination with suffix arrays over shards of the corpus.

Each task sorts the word suffixes of the documents it holds (a shard) and searches every suffix of
the benchmark that opens a window in that order, by bisection.  The range found holds all verbatim
occurrences; those that follow each other in a document and in an item alike make up a longest
match, with its places in both.  Nothing is shuffled.  A document is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

#: A-Z lower-cased; every byte that can't be part of a word made a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of a shard, about; a document is a shard by itself if it is longer.
SHARD_WORDS = 1_000_000
#: UTF-8 bytes of a benchmark that are searched in one pass, and so sent to each executor; a larger one takes more passes.
BLOCK_BYTES = 16_000_000
#: Pairs of an occurrence and an item's place that are held at once (all of one document at least).
PAIRS = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of digits, letters a-z in either case, and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Windows:
    """The distinct windows of some benchmark items in order, packed for comparison, and where each is.

    ``vocabulary`` numbers the benchmark's words from 1; 0 stands for any other word.  ``low`` has
    a row for each window, ``per`` words of ``bits`` bits in each column, the first word highest.
    Window k is in the items ``item[first[k]:first[k + 1]]``, at the words ``place[...]`` of them.
    Beside the vocabulary there are 8 bytes for each column and place, in all about 50 a word.
    """

    def __init__(self, items: list[tuple], size: int):
        self.size, self.vocabulary, texts = size, {}, []
        for _, text in items:
            words = words_of(text)
            texts.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
        self.names = [None if x is None else str(x) for x, _ in items]
        self.bits = max(2, (len(self.vocabulary) + 1).bit_length())
        self.per = 63 // self.bits
        size_of = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate([*texts, np.zeros(size, np.int32)])
        count = np.where(size_of >= size, size_of - size + 1, np.minimum(size_of, 1))
        item = np.repeat(np.arange(len(texts)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, length = (np.cumsum(size_of) - size_of)[item] + place, np.minimum(size_of, size)[item]
        keys = self.pack(lambda j: np.where(length > j, ids[np.minimum(at + j, len(ids) - 1)], 0))
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        begin = np.flatnonzero(new)
        self.low, self.length = [k[order[begin]] for k in keys], length[order[begin]].astype(np.int32)
        self.first = np.append(begin, len(order))
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.least = int(self.length.min()) if len(begin) else 0
        self.beyond: list | None = None

    def __len__(self) -> int:
        return len(self.length)

    def high(self) -> list[np.ndarray]:
        """The largest keys that begin with each window; made where they are used."""
        if self.beyond is None:
            rest = self.pack(lambda j: np.where(j >= self.length, (1 << self.bits) - 1, 0))
            self.beyond = [a | b for a, b in zip(self.low, rest)]
        return self.beyond

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))

    def pack(self, column: Callable[[int], np.ndarray]) -> list[np.ndarray]:
        """Keys of rows whose j-th word is ``column(j)``; a column is asked for when its turn comes."""
        out = []
        for k in range(0, self.size, self.per):
            key = column(k).astype(np.int64)
            for j in range(k + 1, k + self.per):
                key <<= self.bits
                if j < self.size:
                    key |= column(j)
            out.append(key)
        return out


def _bisect(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For each wanted row the first row of the sorted keys that is not below it (or, right: above it)."""
    n, m = len(keys[0]), len(wanted[0])
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, n - 1)
        less, same = np.zeros(m, bool), np.ones(m, bool)
        for k, w in zip(keys, wanted):
            less |= same & (k[at] < w)
            same &= k[at] == w
        below = (less | same if right else less) & open_
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


class SuffixArray:
    """The suffixes of a shard in order of their first ``windows.size`` words.

    Documents end their suffixes.  A word that no window has can't be matched, so suffixes stop
    there too, and those with fewer words left than the shortest window are left out.
    """

    def __init__(self, texts: list[np.ndarray], windows: Windows):
        self.start = np.cumsum([0] + [len(t) + 1 for t in texts])  # a 0 stands after each document
        ids = np.zeros(self.start[-1] + windows.size, np.int32)
        for t, at in zip(texts, self.start.tolist()):
            ids[at : at + len(t)] = t
        stop = np.where(ids == 0, np.arange(len(ids)), len(ids))
        left = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(ids))
        at = np.flatnonzero(left >= max(1, windows.least))
        left = left[at]
        keys = windows.pack(lambda j: np.where(left > j, ids[np.minimum(at + j, len(ids) - 1)], 0))
        order = np.lexsort(keys[::-1])
        self.suffixes, self.keys, self.windows = at[order], [k[order] for k in keys], windows

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(start position, window) of every occurrence of every window."""
        if not len(self.suffixes) or not len(self.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = _bisect(self.keys, self.windows.low, False)
        n = np.maximum(_bisect(self.keys, self.windows.high(), True) - lo, 0)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.suffixes[np.repeat(lo, n) + offset], np.repeat(np.arange(len(n)), n)


def _longest(doc: np.ndarray, at: np.ndarray, window: np.ndarray, windows: Windows) -> Iterator[tuple[int, str | None, int, int, int]]:
    """(document, item, item's word, document's word, words) of each document's longest match with each item, of equals the first.

    Occurrences come by document and place.  Those of an item's next window at the document's next word go on with the match.
    """
    n = (windows.first[1:] - windows.first[:-1])[window]
    if not len(n):
        return
    docs = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    pairs = np.cumsum(np.add.reduceat(n, docs))
    cuts, done = [0], 0
    for k, total in enumerate(pairs.tolist()):
        if k and total - done > PAIRS:
            cuts.append(int(docs[k]))
            done = int(pairs[k - 1])
    for lo, hi in zip(cuts, [*cuts[1:], len(n)]):
        many = n[lo:hi]
        row = np.repeat(np.arange(lo, hi), many)
        where = windows.first[window[row]] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        d, p, item, place = doc[row], at[row], windows.item[where].astype(np.int64), windows.place[where].astype(np.int64)
        order = np.lexsort((p, p - place, item, d))
        d, p, item, place, length = d[order], p[order], item[order], place[order], windows.length[window[row[order]]]
        new = np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (place[1:] != place[:-1] + 1)]
        begin = np.flatnonzero(new)
        words = np.diff(np.r_[begin, len(p)]) - 1 + length[begin]
        d, p, item, place = d[begin], p[begin], item[begin], place[begin]
        best = np.lexsort((place, p, -words, item, d))
        best = best[np.r_[True, (d[best[1:]] != d[best[:-1]]) | (item[best[1:]] != item[best[:-1]])]]
        yield from zip(d[best].tolist(), [windows.names[k] for k in item[best].tolist()], place[best].tolist(), p[best].tolist(), words[best].tolist())


def _search(texts: list[np.ndarray], windows: Windows) -> tuple[list, list]:
    """For each document the merged [start, end) word spans that windows cover, and its longest match with each item."""
    array = SuffixArray(texts, windows)
    at, window = array.occurrences()
    cover = np.zeros(array.start[-1] + windows.size + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + windows.length[window], -1)
    covered = np.r_[0, (np.cumsum(cover) > 0).astype(np.int8), 0]
    begin, end = np.flatnonzero(np.diff(covered) > 0), np.flatnonzero(np.diff(covered) < 0)
    spans, found = [[] for _ in texts], [[] for _ in texts]
    for d, b, e in zip((np.searchsorted(array.start, begin, "right") - 1).tolist(), begin.tolist(), end.tolist()):
        spans[d].append((b - int(array.start[d]), e - int(array.start[d])))
    order = np.argsort(at, kind="stable")
    at, window = at[order], window[order]
    doc = np.searchsorted(array.start, at, "right") - 1
    for d, *match in _longest(doc, at - array.start[doc], window, windows):
        found[d].append(tuple(match))
    return spans, found


def _merged(spans: list) -> list:
    out: list = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of bounded size; the driver holds one block at a time."""
    total = benchmark.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n = total // BLOCK_BYTES + 1
    rows = benchmark.select(item_col, text_col)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64(text_col), F.lit(n)) == k)
        yield [tuple(r) for r in part.toLocalIterator()]


def matches(df: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the columns ``bench_words`` (long), ``bench_spans`` (word spans that benchmark
    windows cover, merged), ``bench_items`` (ids, as strings, sorted) and ``bench_matches`` (the
    longest verbatim match with each item: item, its first word there and in the document, and its
    words; of equals the first), replacing such columns.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
    window.  Null or wordless texts have no words and match nothing; an item without an id marks
    words and has matches but isn't listed; repeated rows get equal results; an empty benchmark
    matches nothing, an empty table gives none; other columns may have any names.  A very long
    document is a shard by itself.
    """
    spark = df.sparkSession
    added = {"bench_words": "long", "bench_spans": "array<struct<start:long,end:long>>", "bench_items": "array<string>",
             "bench_matches": "array<struct<item:string,item_start:long,doc_start:long,words:long>>"}
    df = df.drop(*added).withColumns({c: (F.lit(0) if t == "long" else F.array()).cast(t) for c, t in added.items()})
    # the text leaves with the last pass unless it is wanted: it needn't travel back to the JVM
    blocks = _blocks(benchmark, item_col, item_text)
    rows = next(blocks)
    while rows is not None:
        after = next(blocks, None)
        df = _pass(df, common.sent(spark, Windows(rows, size)), text_col, keep_text or after is not None)
        rows = after
    return df


def _pass(df: DataFrame, windows: Callable[[], Windows], text_col: str, keep_text: bool) -> DataFrame:
    names = df.columns
    kept = [k for k, c in enumerate(names) if keep_text or c != text_col]
    text_at, words_at, spans_at, items_at, matches_at = (names.index(c) for c in (text_col, "bench_words", "bench_spans", "bench_items", "bench_matches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows()
        for batch in batches:
            words, spans, items, found, held, total = [], [], [], [], [], 0
            old_spans, old_items, old_found = (batch.column(k).to_pylist() for k in (spans_at, items_at, matches_at))

            def flush():
                for a, b in zip(*_search(held, w)):
                    k = len(spans)
                    before = [(x["start"], x["end"]) for x in old_spans[k]]
                    spans.append([{"start": x, "end": y} for x, y in _merged(before + a)])
                    items.append(sorted({m[0] for m in b if m[0] is not None}.union(old_items[k])))
                    found.append(old_found[k] + [{"item": i, "item_start": q, "doc_start": p, "words": n} for i, q, p, n in b])
                held.clear()

            for text in batch.column(text_at):
                held.append(w.numbers(words_of(text.as_py())))
                words.append(len(held[-1]))
                total += words[-1]
                if total >= SHARD_WORDS:
                    flush()
                    total = 0
            flush()
            columns = list(batch.columns)
            for k, x in ((words_at, words), (spans_at, spans), (items_at, items), (matches_at, found)):
                columns[k] = pa.array(x, batch.schema.field(k).type)
            fields = pa.schema([batch.schema.field(k) for k in kept])
            yield pa.RecordBatch.from_arrays([columns[k] for k in kept], schema=fields)

    return df.mapInArrow(run, df.select(*[f"`{names[k]}`" for k in kept]).schema)


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``matches``: counts of words, hit words and items, a digest of the items, the verdict, and
    the words of the longest match."""
    hit = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return df.select(
        id_col, F.col("bench_words").alias("n_words"), hit.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        (F.size("bench_spans") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("bench_matches", lambda m: m["words"])), F.lit(0).cast("long")).alias("n_longest"),
    )


def decontaminated(df: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that share no window with the benchmark, unchanged; null and wordless texts share none."""
    found = matches(df, benchmark, size, text_col)
    return found.where(F.size("bench_spans") == 0).select(*df.columns)


def empty_digest() -> str:
    return hashlib.sha256(b"").hexdigest()
