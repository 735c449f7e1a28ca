"""Byte-level BPE with a lexicon of frequent words in a minimal acyclic transducer.

Words that make up a certain share of the whole corpus are compiled, with their ids, into an
automaton whose states are shared by equal suffixes (Daciuk et al., 2000).  The numbers along a
word's path add up to its place in the list of id sequences.  Tasks map the file into memory and
look up all distinct words of a batch at once; every other word is merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

#: A word is in the lexicon if it makes up this share of the corpus at least; so there are at most 1 / SHARE of them.
SHARE = 4e-6
#: Merged words that a task remembers at most; then it starts anew.
REMEMBERED = 200_000

#: Letters and digits that Python's ``re`` classes like the tokenizer's pattern does; other texts go to ``regex``.
_ODD = re.compile("[^\x00-\x1b\x20-\x7fÀ-ɏ‐-‟]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_QUICK = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")


def words(text: str) -> list[str]:
    """The parts of a text that are merged each by itself, as byte-level tokenizers cut it; joined they are the text."""
    if _ODD.search(text) is None:
        return _QUICK.findall(text)
    import regex

    return regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next beyond 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Merges:
    """A byte-level BPE read from a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, letters = spec["model"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.span = max(vocab.values()) + 1
        self.byte_ids = [vocab[c] for c in letters]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {vocab[a] * self.span + vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes = {i: bytes(to_byte[c] for c in w) for w, i in vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: of its adjacent pairs the one of lowest rank, the leftmost of those, is merged, until none is left."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, span, none = self.rank.get, self.span, len(self.made)
        ranks = [get(a * span + b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at : at + 2] = [self.made[best]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(ids[at] * span + ids[at + 1], none)
            if at:
                ranks[at - 1] = get(ids[at - 1] * span + ids[at], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        get, span, n = self.rank.get, self.span, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] * span + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] * span + ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := get(ids[i] * span + ids[after[i]])) is not None:
                    heapq.heappush(heap, (k, i))
            if (h := before[i]) >= 0 and (k := get(ids[h] * span + ids[i])) is not None:
                heapq.heappush(heap, (k, h))
        return [x for x in ids if x >= 0]

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """A text's stretches between special tokens (None), and those tokens with their ids."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield part, self.special[part]
            elif part:
                yield part, None

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """The minimal automaton of the given words and their ids, as one array of 32-bit integers.

    Head: numbers of states, edges, words, ids, and the longest word.  Then, by edge in order of
    (state, byte): key, target, and the number of words that come before those behind the edge;
    by state: whether a word ends there; by word: where its ids begin; the ids.
    """
    final, edges, register = [False], [{}], {}
    path: list[tuple[int, int]] = []  # (state, byte) of the latest word, not yet minimal

    def settle(keep: int) -> None:
        while len(path) > keep:
            state, byte = path.pop()
            child = edges[state][byte]
            key = (final[child], tuple(edges[child].items()))
            edges[state][byte] = register.setdefault(key, child)

    order = sorted(entries)
    last = b""
    for word in order:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[same:]:
            final.append(False)
            edges.append({})
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        last = word
    settle(0)
    number, reached = {0: 0}, [0]
    for s in reached:
        for t in edges[s].values():
            if t not in number:
                number[t] = len(reached)
                reached.append(t)
    count: dict[int, int] = {}
    for s in reversed(_after(edges)):
        count[s] = final[s] + sum(count[t] for t in edges[s].values())
    keys, targets, outs = [], [], []
    for s in reached:
        before = int(final[s])
        for byte, t in sorted(edges[s].items()):
            keys.append(number[s] * 256 + byte)
            targets.append(number[t])
            outs.append(before)
            before += count[t]
    ids = [entries[w] for w in order]
    offsets = np.cumsum([0] + [len(x) for x in ids])
    head = [len(reached), len(keys), len(order), int(offsets[-1]), max(map(len, order), default=0)]
    flat = [i for x in ids for i in x]
    return np.concatenate([np.array(x, np.int32) for x in (head, keys, targets, outs, [final[s] for s in reached], offsets, flat)])


def _after(edges: list[dict]) -> list[int]:
    """States in an order in which each stands before those it leads to."""
    seen, out, stack = {0}, [], [(0, iter(edges[0].values()))]
    while stack:
        state, rest = stack[-1]
        for t in rest:
            if t not in seen:
                seen.add(t)
                stack.append((t, iter(edges[t].values())))
                break
        else:
            out.append(state)
            stack.pop()
    return out[::-1]


def _memory_map(blob: bytes) -> np.ndarray:
    """A compiled lexicon mapped from a file of this task, which has no name any more and goes with the mapping."""
    with tempfile.TemporaryFile() as f:
        f.write(blob)
        f.flush()
        return np.memmap(f, np.int32, "r")


class Lexicon:
    """A compiled lexicon, read where it lies."""

    def __init__(self, blob: np.ndarray):
        states, edges, n, ids, self.longest = blob[:5].tolist()
        at = 5
        for name, size in (("keys", edges), ("targets", edges), ("outs", edges), ("final", states), ("offsets", n + 1), ("ids", ids)):
            setattr(self, name, blob[at : at + size])
            at += size
        self.ids_bytes = self.ids.astype("<u4").tobytes() if ids else b""

    def find(self, wanted: list[bytes]) -> list[bytes | None]:
        """For each word its ids as little-endian 32-bit integers, or None if it isn't in the lexicon."""
        n = len(wanted)
        length = np.fromiter(map(len, wanted), np.int64, n)
        letters = np.frombuffer(b"".join(wanted) + b"\0", np.uint8)
        start = np.cumsum(length) - length
        state, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((length > 0) & (length <= self.longest)) if len(self.keys) else np.zeros(0, np.int64)
        found = np.full(n, -1, np.int64)
        for k in range(self.longest):
            if not len(live):
                break
            key = state[live] * 256 + letters[start[live] + k]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[e] == key
            live, e = live[hit], e[hit]
            state[live] = self.targets[e]
            place[live] += self.outs[e]
            over = length[live] == k + 1
            done = live[over]
            done = done[self.final[state[done]] == 1]
            found[done] = place[done]
            live = live[~over]
        begin, end = (4 * self.offsets[:-1]).tolist(), (4 * self.offsets[1:]).tolist()
        return [None if i < 0 else self.ids_bytes[begin[i] : end[i]] for i in found.tolist()]


class Encoder:
    """Words to ids, by the lexicon or else by merging; what was met is remembered up to a bound."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None = None):
        self.merges, self.lexicon, self.known = merges, lexicon, {}

    def learn(self, met: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in met if w not in self.known]
        raw = [w.encode() for w in new]
        ids = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        for w, b, i in zip(new, raw, ids):
            self.known[w] = np.array(self.merges.merge(b), "<u4").tobytes() if i is None else i

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        cut = [[(words(p), i) for p, i in self.merges.parts(t)] for t in texts]
        self.learn({w for parts in cut for ws, i in parts if i is None for w in ws})
        known = self.known.__getitem__
        return [b"".join(b"".join(map(known, ws)) if i is None else i.to_bytes(4, "little") for ws, i in parts) for parts in cut]


def _chunks(column: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts of a column, some at a time: whole ones, as many as it takes to pass ``chars``."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    yield held


def word_counts(df: DataFrame, text_col: str = "text", special: Iterable[str] = ()) -> DataFrame:
    """``(word, n)`` over all texts, summed per batch before the shuffle; null ``word`` has the total."""
    split = re.compile("|".join(map(re.escape, special))) if special else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                if text.is_valid:
                    for part in split.split(text.as_py()) if split else [text.as_py()]:
                        seen.update(words(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *seen], pa.string()), pa.array([seen.total(), *seen.values()], pa.int64())], names=["word", "n"])

    return df.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(df: DataFrame, tokenizer: str, text_col: str = "text", share: float = SHARE) -> np.ndarray:
    """The lexicon of the words that are at least ``share`` of all words of ``df``: at most ``1 / share`` words."""
    merges = Merges(tokenizer)
    counts = common.saved(word_counts(df, text_col, list(merges.special)).where("n > 1 or word is null"), "words")
    total = counts.where("word is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    frequent = counts.where(F.col("word").isNotNull() & (F.col("n") >= max(2, total * share))).select("word")
    return compile_lexicon({w: merges.merge(w) for w in (r["word"].encode() for r in frequent.toLocalIterator())})


def encoded(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, share: float = SHARE) -> DataFrame:
    """``(id_col, ids array<int>, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``df``.

    ``tokenizer`` is the content of a byte-level BPE tokenizer file.  Ids are those of the public
    tokenizers library without added special tokens; special tokens in a text are recognised.
    ``decoded_sha256`` is of the text made again from the ids.  Null texts count as empty: no ids.
    Very long words are merged with a heap; repeated rows get equal results; an empty table gives none.
    """
    sc = df.sparkSession.sparkContext
    lexicon = sc.broadcast(fit_lexicon(df, tokenizer, text_col, share).tobytes())  # bounded by share
    spec = sc.broadcast(tokenizer)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + "ids array<int>, " * ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(spec.value), Lexicon(_memory_map(lexicon.value)))
        size = max(encoder.merges.bytes) + 1
        token = [encoder.merges.bytes.get(k, b"") for k in range(size)]
        for batch in batches:
            n, sha, back, all_ids = [], [], [], []
            for raw in (r for texts in _chunks(batch.column(1)) for r in encoder.encode(texts)):
                got = np.frombuffer(raw, "<u4")
                n.append(len(got))
                sha.append(hashlib.sha256(raw).hexdigest())
                whole = b"".join(map(token.__getitem__, got.tolist())).decode("utf-8", "replace")
                back.append(hashlib.sha256(whole.encode()).hexdigest())
                if ids:
                    all_ids.append(got.astype(np.int32))
            columns = [batch.column(0)] + [pa.array(all_ids, pa.list_(pa.int32()))] * ids + [pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
            names = [id_col] + ["ids"] * ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decoded(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)``: the texts of id arrays; a null array gives null, bytes that aren't UTF-8 the replacement character."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(spec.value)
        for batch in batches:
            texts = [None if x is None else merges.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def tokenizer_file(path: str | None = None) -> str:
    """The content of a tokenizer file; by default the public byte-level one of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
