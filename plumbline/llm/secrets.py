"""Secret scans: known shapes by pattern, and random strings by token efficiency.

A BPE vocabulary packs ordinary words into few tokens; a random string falls apart into many.
So a low number of characters per token marks a string that nobody wrote.  Checksums of known
lengths, UUIDs, dates and numbers, and identifiers made of words are left out; what has a
checksum's length but is assigned to a secret's keyword is none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which they count at equal starts; "random" is the method's own.
KINDS = ("assign", "access", "hex", "random")
#: A string with fewer characters per token than this is random.
CHARS_PER_TOKEN = 2.2
#: The same for letters of one case alone, which long or invented words are made of too.
CHARS_PER_TOKEN_LETTERS = 2.01
#: Characters that a string must have for its ratio to tell.
LEAST = 16
#: And what must be left of it beside UUIDs and numbers.
REST = 12
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Each keyword has one of these, so a text without any has no assignment.
_HINT = re.compile(r"(?:passw|secret|token|api_?key)", re.ASCII | re.IGNORECASE)
#: Whole strings: a part of a word with letters beyond ASCII isn't one.
_LONG = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{%d,}+(?!\w)" % LEAST)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[A-Za-z]{0,4}[0-9]{1,14}(?:[A-Za-z]{1,2}[0-9]{0,6})?")
_WORDY = re.compile(r"(?:[A-Za-z][a-z]{2,}|[A-Z]{3,})(?:[_/=-]+(?:[A-Za-z][a-z]*|[A-Z]+|[0-9]{1,4})|[A-Z][a-z]{2,})*")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the patterns find, by start and kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def known(s: str, assigned: bool = False) -> bool:
    """Whether a string is a digest of a usual length, a UUID, a number, or an identifier made of words.

    Letters of one case alone may be a word or not; only their tokens tell.  Nor is a value that is
    ``assigned`` to a secret's keyword a digest."""
    if not assigned and len(s) in DIGESTS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        return True
    if not re.search("[A-Za-z]", s) or not re.search("[0-9]", s) and len(set(s)) < 10 or _UUID.fullmatch(s):
        return True
    return bool(_WORDY.fullmatch(s)) and not re.fullmatch("[a-z]+|[A-Z]+", s)


def _is_random(s: str, tokens: Callable[[str], int], least: float, assigned: bool) -> bool:
    """Whether a string, or what it has beside UUIDs, dates and numbers, isn't ``known`` and has few characters per token."""
    rest = _UUID.sub("", s)
    parts = re.split("[-_/=+]+", rest)
    if len(rest) < len(s) or len(parts) > 1 and any(map(_NUMBER.fullmatch, parts)):
        rest = "-".join(p for p in parts if p and not _NUMBER.fullmatch(p))
        if len(rest) < REST:
            return False
    if re.fullmatch("[A-Z]?[a-z]+|[A-Z]+", rest):
        least = min(least, CHARS_PER_TOKEN_LETTERS)
    return not known(rest, assigned) and len(rest) < least * tokens(rest)


def random_spans(text: str, tokens: Callable[[str], int], least: float = CHARS_PER_TOKEN, base: list | None = None) -> list[tuple[int, str, int]]:
    """(start, "random", end) of long strings with few characters per token that aren't ``known``; ``base``: the text's ``base_spans``."""
    asked = [(a, b) for a, kind, b in (base_spans(text) if base is None else base) if kind == "assign"]
    return [(m.start(), "random", m.end()) for m in _LONG.finditer(text) if _is_random(m[0], tokens, least, any(a < m.start() < b for a, b in asked))]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def vocabulary(path: str | None = None) -> bytes:
    """The content of a tiktoken vocabulary; by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def counter(content: bytes) -> Callable[[str], int]:
    """Counts tokens of a string under a tiktoken vocabulary; the string is cut as the public byte-level BPE does."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(encoding.encode_ordinary(s))


def scanned(df: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text", least: float = CHARS_PER_TOKEN) -> DataFrame:
    """For each row: ``id_col``, counts by kind, ``base_sha256`` and ``spans`` (kind:start:end, in code points).

    Null texts count as empty; spans of different kinds may overlap; repeated rows get equal
    results; an empty table gives none.  Texts are scanned whole, one at a time; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(content)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(shared.value)
        for batch in batches:
            out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
            for text in batch.column(1):
                t = text.as_py() or ""
                base = base_spans(t)
                own = random_spans(t, tokens, least, base)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[1] == k for s in (own if k == "random" else base)))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(sorted(base + own, key=lambda s: (s[0], KINDS.index(s[1])))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items())], names=[id_col, *out])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(text: str, spans: str, mark: str = "[{}]") -> str:
    """A text with its spans (as ``scanned`` gives them) replaced by their kinds; of overlapping ones the first counts."""
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",") if s):
        if int(start) >= at:
            out += [text[at : int(start)], mark.format(kind)]
            at = int(end)
    return "".join(out) + text[at:]
