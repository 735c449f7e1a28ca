"""Line dedup by winnowing over the hashes of lines.

A text is a sequence of units: its lines, long ones cut further at sentence ends.  A window is a
shortest run of units from some unit onwards, or up to some unit, that has MIN_WORDS words.  Each
window selects its unit with the least hash, and the selected units are the text's fingerprints.
Equal windows select the same unit, so a window that occurs twice has a fingerprint that occurs
twice: what's unique among fingerprints needs no look at its windows.  Positions of the others are
joined by the windows that selected them, and matches that lie on one diagonal of two texts are
extended over one another to the longest ones.

If a text shares a run of MIN_WORDS words with an earlier one, each unit of the run lies in a window
inside it: go from the unit to the run's end until the words are enough, else take the last window
of the run.  So the windows that occur earlier make up exactly the runs that are deleted, whichever
text each occurs in first.  Units are told apart by 128 bits of hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

#: Words of the shortest run that is deleted, and of a window.
MIN_WORDS = 8
_SENTENCE = re.compile(r"(?<=[.!?]) +")


def units(text: str | None) -> list[tuple[int, str, int]]:
    """(line, content with single spaces, words) of each unit that has words."""
    out = []
    for at, line in enumerate((text or "").split("\n")):
        for part in _SENTENCE.split(line):
            if words := part.split():
                out.append((at, " ".join(words), len(words)))
    return out


def windows(words: np.ndarray, doc: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Where each window begins and how many units it has: the shortest from each unit on that has
    ``least`` words, and those up to a unit that aren't among them.  None reaches beyond its text."""
    total = np.r_[0, np.cumsum(words)]
    end = np.searchsorted(total, total[:-1] + least)  # the window is [i, end)
    ahead = np.flatnonzero(end <= np.searchsorted(doc, doc, "right"))
    begin = np.searchsorted(total, total[1:] - least, "right") - 1  # the window is [begin, i]
    back = np.flatnonzero(begin >= np.searchsorted(doc, doc))
    back = back[end[begin[back]] != back + 1]
    return np.r_[ahead, begin[back]], np.r_[end[ahead] - ahead, back + 1 - begin[back]]


def select(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The position of the unit that each window selects; of equal least hashes the last."""
    best, at = hashes[begin].copy(), begin.copy()
    for k in range(1, int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        on = on[hashes[begin[on] + k] <= best[on]]
        at[on] = begin[on] + k
        best[on] = hashes[at[on]]
    return at


#: Odd multipliers for either half of a hash.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _hashes(contents: list[str]) -> np.ndarray:
    """Both halves of each unit's 128-bit hash."""
    import xxhash

    if not contents:
        return np.zeros((0, 2), np.uint64)
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, contents)), ">u8").astype(np.uint64).reshape(-1, 2)


def _keys(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Both halves of a hash of each window's units in their order; that of a single unit is its own."""
    key = hashes[begin]
    for k in range(1, int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        key[on] = (key[on] ^ (key[on] >> np.uint64(32))) * _ODD + hashes[begin[on] + k]
    return key


def _cut(texts: list, skip: list) -> tuple[list[list], np.ndarray, np.ndarray, np.ndarray]:
    """The units of some texts, and of all of them their hashes, words and texts' numbers."""
    found = [[] if s else units(t) for t, s in zip(texts, skip)]
    hashes = _hashes([u for us in found for _, u, _ in us])
    words = np.array([w for us in found for _, _, w in us], np.int64)
    return found, hashes, words, np.repeat(np.arange(len(texts)), [len(us) for us in found])


def _winnowed(texts: list, ids: pa.Array) -> pa.RecordBatch:
    """Rows of ``fingerprints`` for some texts; those without an id have none."""
    _, hashes, words, doc = _cut(texts, ids.is_null().to_pylist())
    begin, size = windows(words, doc)
    at = select(hashes[:, 0], begin, size)
    order = np.argsort(at, kind="stable")
    begin, size, at = begin[order], size[order], at[order]
    picked, first = np.unique(at, return_index=True)
    key = _keys(hashes, begin, size)
    alone = size == 1  # its key is the fingerprint itself
    told = pa.StructArray.from_arrays(
        [pa.array(key[:, 0].astype(np.int64), mask=alone), pa.array(key[:, 1].astype(np.int64)),
         pa.array((at - begin).astype(np.int32)), pa.array(size.astype(np.int32))], names=["key", "check", "back", "size"])
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes[picked, 0].astype(np.int64)), ids.take(pa.array(doc[picked])), pa.array((picked - np.searchsorted(doc, doc[picked])).astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), told)], names=["h", "id", "pos", "windows"])


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h, id, pos, windows)`` of every selected unit: its hash, its text, its place, and of each window
    that selects it both halves of the hash, how many units before it lie and how many the window has."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield _winnowed(part.column(1).to_pylist(), part.column(0))

    return df.select(id_col, text_col).mapInArrow(run, f"h long, id {kind}, pos int, windows array<struct<key: long, check: long, back: int, size: int>>")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, matches)``: for each text with windows that occur earlier, where they are and where they occur first.

    Earlier is by (id, place).  Fingerprints alone are counted first; just the repeated ones go on, by
    their windows.  Each occurrence of a window joins the first one alone, never all others.  What is
    aggregated by hash is written first, so that the joins' sides come straight from a shuffle and
    adaptive execution can split the occurrences of a very common line over tasks.
    """
    every = common.saved(fingerprints(df, id_col, text_col), "line-fingerprints")
    many = common.saved(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-fingerprints")
    told = every.join(many, "h", "left_semi").select("h", "id", "pos", F.explode("windows").alias("w"))
    found = common.saved(told.select(F.coalesce("w.key", "h").alias("key"), "w.check", "id", (F.col("pos") - F.col("w.back")).alias("pos"), "w.size"), "line-windows")
    first = found.groupBy("key", "check").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("f")).where("n > 1")
    first = common.saved(first.select("key", "check", F.col("f.id").alias("from_id"), F.col("f.pos").alias("from_pos")), "first-occurrences")
    later = found.join(first, ["key", "check"]).where("id <> from_id or pos <> from_pos")
    return later.select("id", F.struct("pos", "size", "key", "check", "from_id", "from_pos").alias("m")).groupBy("id").agg(F.collect_list("m").alias("matches"))


def extended(pos: np.ndarray, size: np.ndarray, source: np.ndarray, source_pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest runs ``[begin, end)`` that matched windows make: those on one diagonal of two texts that touch are one run.

    No window lies between both ends of another, so by place and size their ends rise.
    """
    diagonal, end = pos - source_pos, pos + size
    order = np.lexsort((size, pos, diagonal, source))
    pos, end, diagonal, source = pos[order], end[order], diagonal[order], source[order]
    new = np.r_[True, (source[1:] != source[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] > end[:-1])][: len(pos)]
    first = np.flatnonzero(new)
    return pos[first], end[np.r_[first[1:], len(pos)][: len(first)] - 1]


def removed(texts: list, matches: pa.ListArray) -> list[tuple[str | None, int, int]]:
    """Texts without the runs that occur earlier; how many units and words went from each.

    Matches of another text that has the same id aren't this one's.  A line that loses some of its
    units keeps the rest with single spaces; one that loses all goes.
    """
    known = matches.is_valid().to_numpy(zero_copy_only=False) & np.array([t is not None for t in texts], bool)
    found, hashes, words, doc = _cut(texts, (~known).tolist())
    flat, n = matches.flatten(), matches.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    whose = np.repeat(np.arange(len(texts)), n)
    pos, size, key, check, source_pos = (flat.field(flat.type.get_field_index(c)).to_numpy().astype(np.int64) for c in ("pos", "size", "key", "check", "from_pos"))
    source = flat.field(flat.type.get_field_index("from_id")).dictionary_encode().indices.to_numpy().astype(np.int64)
    base, till = np.searchsorted(doc, whose), np.searchsorted(doc, whose, "right")
    at = base + pos
    inside = np.flatnonzero(at + size <= till)
    own = _keys(hashes, at[inside], size[inside])
    same = inside[(own == np.c_[key, check][inside].astype(np.uint64)).all(axis=1)]
    begin, end = extended(at[same], size[same], source[same] * len(texts) + whose[same], source_pos[same])
    edges = np.bincount(begin, minlength=len(doc) + 1) - np.bincount(end, minlength=len(doc) + 1)
    drop = np.cumsum(edges[: len(doc)]) > 0
    first = np.searchsorted(doc, np.arange(len(texts)))
    gone = np.bincount(doc[drop], minlength=len(texts)).tolist()
    gone_words = np.bincount(doc[drop], weights=words[drop], minlength=len(texts)).astype(np.int64).tolist()
    out = []
    for k, t in enumerate(texts):
        if not gone[k]:
            out.append((t, 0, 0))
            continue
        rest: dict = {}
        for (line, u, _), d in zip(found[k], drop[first[k] : first[k] + len(found[k])].tolist()):
            kept = rest.setdefault(line, [False])
            if d:
                kept[0] = True
            else:
                kept.append(u)
        lines = []
        for i, line in enumerate(t.split("\n")):
            kept = rest.get(i)
            if kept is None or not kept[0]:
                lines.append(line)
            elif len(kept) > 1:
                lines.append(" ".join(kept[1:]))
        out.append(("\n".join(lines), gone[k], gone_words[k]))
    return out


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with repeated runs deleted from ``text_col``, and the columns ``units_removed`` and
    ``words_removed`` (replacing such columns); ``length_col``, if given, gets the new length.

    Null and empty texts stay as they are.  A row without an id keeps its text and counts as
    nowhere seen.  Rows with one id are one text told several times: they aren't repeats of each
    other.  A text that repeats itself loses the later run.  Columns of ``df`` may have any names.
    Of a very long text only the hashes of its units are held beside it.  An empty table gives none.
    """
    df = df.drop("units_removed", "words_removed")
    names = df.columns
    key, told = common.free(names, "_id"), common.free(names, "_matches")
    found = repeats(df, id_col, text_col).select(F.col("id").alias(key), F.col("matches").alias(told))
    joined = df.join(found, F.col(f"`{id_col}`") == F.col(key), "left").select(
        *[f"`{c}`" for c in names], F.lit(0).cast("long").alias("units_removed"), F.lit(0).cast("long").alias("words_removed"), told)
    text_at, length_at = names.index(text_col), names.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, matches = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            old_text = columns[text_at].to_pylist()
            done = [x for k in range(0, len(old_text), 1000) for x in removed(old_text[k : k + 1000], matches.slice(k, 1000))]
            text, gone = [x[0] for x in done], [x[1:] for x in done]
            kinds = [f.type for f in batch.schema]
            columns[text_at] = pa.array(text, kinds[text_at])
            if length_at is not None:
                old = columns[length_at].to_pylist()
                columns[length_at] = pa.array([o if not g[0] else len(t) for t, o, g in zip(text, old, gone)], kinds[length_at])
            columns[-2:] = [pa.array([g[k] for g in gone], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(len(columns))]))

    return joined.mapInArrow(run, joined.drop(told).schema)


def sql() -> str:
    """The same over the table ``documents``, in DuckDB's SQL: windows by their words instead of hashes, and no selection."""
    word = "[^\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    return f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE doc_id IS NOT NULL),
    parts AS (SELECT doc_id, place, unnest(p) AS part, generate_subscripts(p, 1) AS k
              FROM (SELECT doc_id, place, string_split(regexp_replace(line, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)) AS p FROM lines)),
    said AS (SELECT doc_id, place, k, regexp_extract_all(part, '{word}') AS w FROM parts),
    u AS (SELECT doc_id, place, row_number() OVER o AS pos, array_to_string(w, ' ') AS unit, CAST(len(w) AS BIGINT) AS words,
                 sum(len(w)) OVER o AS total FROM said WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY place, k)),
    win AS (SELECT a.doc_id, a.pos, b.pos AS till
            FROM u a, unnest(range(1, {MIN_WORDS} + 1)) t(n) JOIN u b ON b.doc_id = a.doc_id AND b.pos = a.pos + n - 1
            WHERE b.total - a.total + a.words >= {MIN_WORDS} AND (b.total - b.words - a.total + a.words < {MIN_WORDS} OR b.total - a.total < {MIN_WORDS})),
    named AS (SELECT w.doc_id, w.pos, w.till, string_agg(u.unit, chr(10) ORDER BY u.pos) AS content
              FROM win w JOIN u ON u.doc_id = w.doc_id AND u.pos BETWEEN w.pos AND w.till GROUP BY w.doc_id, w.pos, w.till),
    later AS (SELECT doc_id, pos, till FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS r FROM named) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(pos, till + 1)) AS pos FROM later),
    by_line AS (SELECT u.doc_id, u.place, string_agg(CASE WHEN g.pos IS NULL THEN u.unit END, ' ' ORDER BY u.pos) AS rest, count(g.pos) AS n, coalesce(sum(CASE WHEN g.pos IS NOT NULL THEN u.words END), 0) AS words
                FROM u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.pos = u.pos GROUP BY u.doc_id, u.place),
    left_over AS (SELECT l.doc_id, string_agg(CASE WHEN b.n > 0 THEN b.rest ELSE l.line END, chr(10) ORDER BY l.place) FILTER (WHERE coalesce(b.n, 0) = 0 OR b.rest IS NOT NULL) AS text,
                         CAST(coalesce(sum(b.n), 0) AS BIGINT) AS units_removed, CAST(coalesce(sum(b.words), 0) AS BIGINT) AS words_removed
                  FROM lines l LEFT JOIN by_line b USING (doc_id, place) GROUP BY l.doc_id)
    SELECT d.doc_id, CASE WHEN coalesce(units_removed, 0) = 0 THEN d.text ELSE coalesce(left_over.text, '') END AS text,
           coalesce(units_removed, 0) AS units_removed, coalesce(words_removed, 0) AS words_removed
    FROM documents d LEFT JOIN left_over USING (doc_id)"""
