"""Words of a corpus: joined words cut apart by their frequencies, plain forms that the corpus has, and relatedness in a hierarchy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import cut

#: Letters of a word at most.
LONGEST = 24
#: What a letter that is no word costs beside a word that occurs once, in thousandths of a natural logarithm.
UNKNOWN = 10_000
#: Commonest words that every task holds.
LEXICON = 250_000
#: Bits of the bitmap that tells which stretches may be other words; 16 MB.
BITS = 1 << 27
#: Endings of plurals and verbs with what may stand for them, the likeliest first.
ENDINGS = (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("es", ""), ("s", ""))


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """``(word, n)``: the words of letters a to z, lower case, and how often they occur."""
    words = F.regexp_extract_all(F.lower(F.col(column)), F.lit("([a-z]+)"))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _cheapest(length: int, edges: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """The way from 0 to ``length`` over edges (end, start, cost) of least cost, then of fewest, then of the longest last ones."""
    best: list = [(0, 0, 0)] + [None] * length
    for end, start, cost in sorted(edges):
        way = (best[start][0] + cost, best[start][1] + 1, start)
        if best[end] is None or way < best[end]:
            best[end] = way
    parts, at = [], length
    while at:
        parts.append((best[at][2], at))
        at = best[at][2]
    return best[length][0], parts[::-1]


def segmented(names: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """``(name, cost, words)``: each different name of letters a to z cut into the likeliest words of a vocabulary.

    A word costs the logarithm of its share of the corpus, in whole thousandths so that sums are exact; letters that
    are no word can stand alone.  The LEXICON commonest words are looked up where the names are.  Stretches that may be other words, by
    a bitmap of their CRCs, meet these in a join, so a vocabulary may have any size.  Null, empty and other names are left out, repeated ones count once.
    """
    spark, words = names.sparkSession, cut(words)
    total, alone = words.agg(F.sum("n"), F.round(1000 * F.log(F.sum("n"))).cast("long")).first()
    own = names.select(F.col(column).alias("name")).where(F.col(column).rlike("^[a-z]+$")).distinct()
    if not total:
        return own.select("name", F.lit(None).cast("long").alias("cost"), F.array().cast("array<string>").alias("words")).limit(0)
    costs = words.where(F.length("word") <= LONGEST).select("word", "n", F.round(1000 * F.log(F.lit(total).cast("long") / F.col("n"))).cast("long").alias("cost"))
    common = costs.orderBy(F.desc("n"), "word").limit(LEXICON).collect()
    lexicon = spark.sparkContext.broadcast({r["word"]: r["cost"] for r in common})
    lists = own.withColumn("edges", F.lit(None).cast("array<struct<end:int,start:int,cost:bigint>>"))
    if len(common) == LEXICON:
        last = common[-1]
        rest = costs.where((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("word") > last["word"]))
        stretches = own.mapInArrow(_maybe(lexicon, spark.sparkContext.broadcast(_bitmap(rest))), "name string, start int, end int, word string")
        found = stretches.join(rest.select("word", "cost"), "word").groupBy("name").agg(F.collect_list(F.struct("end", "start", "cost")).alias("edges"))
        lists = own.join(found, "name", "left").select("name", "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = lexicon.value.get
        for batch in batches:
            out = []
            for name, more in zip(*(c.to_pylist() for c in batch.columns)):
                edges = [(e["end"], e["start"], e["cost"]) for e in more or ()]
                seen = {a for b, a, _ in edges if b == a + 1}
                for a, b in _stretches(name):
                    if (c := cost(name[a:b])) is not None:
                        edges.append((b, a, c))
                    elif b == a + 1 and a not in seen:
                        edges.append((b, a, alone + UNKNOWN))
                out.append((name, *_cheapest(len(name), edges)))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in out], pa.string()), pa.array([c for _, c, _ in out], pa.int64()), pa.array([[n[a:b] for a, b in p] for n, _, p in out], pa.list_(pa.string()))],
                                             ["name", "cost", "words"])

    return lists.mapInArrow(run, "name string, cost long, words array<string>")


def _stretches(name: str) -> Iterator[tuple[int, int]]:
    for a in range(len(name)):
        for b in range(a + 1, min(len(name), a + LONGEST) + 1):
            yield a, b


def _bitmap(words: DataFrame) -> bytes:
    """A bit for each CRC of a word modulo BITS; slices are made on the executors."""
    size = BITS // 128
    at = words.select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BITS)).cast("int").alias("at")).distinct()

    def run(t: pa.Table) -> pa.Table:
        at = t.column("at").to_numpy()
        bits = np.zeros(size, np.uint8)
        bits[at % size] = 1
        return pa.table({"slice": pa.array([int(at[0]) // size], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((128, size // 8), np.uint8)
    for r in at.groupBy(F.floor(F.col("at") / size).alias("slice")).applyInArrow(run, "slice int, bits binary").toLocalIterator():  # BITS in all
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _maybe(lexicon: Broadcast, bitmap: Broadcast):
    """Stretches of names that aren't in the lexicon but may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, bits = lexicon.value, bitmap.value
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                for a, b in _stretches(name):
                    word = name[a:b]
                    if word not in common:
                        at = zlib.crc32(word.encode()) % BITS
                        if bits[at >> 3] >> (at & 7) & 1:
                            out.append((name, a, b, word))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()))], ["name", "start", "end", "word"])

    return run


def lemmas(words: DataFrame) -> DataFrame:
    """``(word, lemma)``: a word's plain form by the first of ENDINGS that leads to another word of the vocabulary of three letters or more, or itself."""
    found = [F.when(F.col("word").endswith(end) & ~(F.lit(end == "s") & F.col("word").endswith("ss")), F.concat(F.expr(f"left(word, greatest(length(word) - {len(end)}, 0))"), F.lit(new))) for end, new in ENDINGS]
    forms = words.select("word", F.posexplode(F.array(*found)).alias("at", "form")).where("length(form) >= 3")
    known = forms.join(words.select(F.col("word").alias("form")), "form").groupBy("word").agg(F.min_by("form", "at").alias("lemma"))
    return words.select("word").join(known, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


def paths(edges: DataFrame) -> DataFrame:
    """``(node, path)``: for each node of a hierarchy (child, parent) the nodes from its root to itself.

    Paths double in each round, so there are as many as the logarithm of the depth.  A child with several parents has
    a path by each of them; a root is named as a parent alone or as a child without one.  A circle raises ValueError.
    """
    edges = edges.where("child IS NOT NULL").distinct()
    roots = edges.select(F.col("parent").alias("child")).where("child IS NOT NULL").join(edges.select("child"), "child", "left_anti").distinct()
    state = edges.select(F.col("child").alias("node"), F.array("child").alias("path"), F.col("parent").alias("head")).unionByName(
        roots.select(F.col("child").alias("node"), F.array("child").alias("path"), F.lit(None).cast(edges.schema["parent"].dataType).alias("head")))
    state = cut(state)
    for _ in range(32):
        if state.where("head IS NOT NULL").isEmpty():
            return state.select("node", "path").distinct()
        up = state.select(F.col("node").alias("head"), F.col("path").alias("above"), F.col("head").alias("next"))
        state = cut(state.join(up, "head", "left").select("node", F.concat(F.coalesce("above", F.array().cast(state.schema["path"].dataType)), "path").alias("path"), F.col("next").alias("head")))
        if state.where(F.size(F.array_distinct("path")) < F.size("path")).limit(1).count():
            raise ValueError("the hierarchy has a circle")
    raise ValueError("the hierarchy has a circle")


def wu_palmer(a: Column, b: Column) -> Column:
    """How related two nodes are by their paths: twice the depth of their last common ancestor by both depths; 0 without one."""
    same = F.size(F.filter(F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y), lambda x: x))
    return 2.0 * same / (F.size(a) + F.size(b))


def relatedness(pairs: DataFrame, senses: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``(a, b, score)`` of pairs of words: the most that any of their ``senses`` (word, node) are related; null if one has none.

    In a tree two paths that part don't meet again, so equal places are a common beginning.
    """
    placed = cut(senses.join(paths(hierarchy), "node").select("word", "path"))
    left, right = (placed.select(F.col("word").alias(c), F.col("path").alias(f"path_{c}")) for c in ("a", "b"))
    joined = pairs.select("a", "b").distinct().join(left, "a", "left").join(right, "b", "left")
    return joined.groupBy("a", "b").agg(F.max(wu_palmer(F.col("path_a"), F.col("path_b"))).alias("score"))
