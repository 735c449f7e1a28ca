"""Functions on words, identifiers and query texts, as column expressions where Spark has them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLACES = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("position", T.IntegerType())]))
#: Words that retrieval leaves out.
STOP_WORDS = frozenset("a an and are as at be by for from has have how in is it its of on or that the their this to was were what which who with".split())


#: A character of a word, and white space, as Python's patterns have them.
WORD, SPACE = r"[\p{L}\p{N}_]", r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


def lower_tokens(c: Column) -> Column:
    """The words of a text in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({WORD}+)"), F.lit(1)), F.lower)


def normalised_token(c: Column) -> Column:
    """A token in lower case without punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")


def tokens_with_positions(c: Column) -> Column:
    """Words and where they begin.

    The function for Arrow batches is made here: one kept by the module would travel with every
    closure that names the module, and what it holds of the session can't be pickled.
    """

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"token": m[0], "position": m.start()} for m in re.finditer(r"\b\w+\b", t)])

    return F.pandas_udf(run, _PLACES)(c)


def subsequences(words: Column, least: int) -> Column:
    """All runs of at least ``least`` consecutive words."""
    n = F.size(words)
    starts = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.slice(words, i, k))))


def without_phrase(text: str, phrase: str) -> tuple[str, list[tuple[str, int]]]:
    """A text without the runs of words that are the phrase, in any case; what goes, with places.  What stood between stays."""
    wanted = [m[0].lower() for m in re.finditer(r"\w+", phrase)]
    found = list(re.finditer(r"\w+", text))
    gone, k = [], 0
    while wanted and k + len(wanted) <= len(found):
        if [m[0].lower() for m in found[k : k + len(wanted)]] == wanted:
            gone += found[k : k + len(wanted)]
            k += len(wanted)
        else:
            k += 1
    out = text
    for m in reversed(gone):
        out = out[: m.start()] + out[m.end() :]
    return out, [(m[0], m.start()) for m in gone]


def phrase_removed(texts: Column, phrases: Column) -> Column:
    """``struct<text, removed>``: each text without its phrase, and what went with places; null without a text."""

    def run(texts: pd.Series, phrases: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else without_phrase(t, p or "") for t, p in zip(texts, phrases)]
        return pd.DataFrame({"text": [a for a, _ in rows], "removed": [None if b is None else [{"token": t, "position": p} for t, p in b] for _, b in rows]})

    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", _PLACES)])
    return F.pandas_udf(run, kind)(texts, phrases)


def without_database_terms(text: str, literals: list[str], attributes: list[str]) -> str:
    """A text without a query's literals, then its qualified columns or their names, then bare columns; single spaces."""
    for term in [*literals, *(a for a in attributes if "." in a), *(a.rpartition(".")[2] for a in attributes)]:
        text = without_phrase(text, term)[0]
    return " ".join(text.split())


def hiding_score(text: Column, expected: Column) -> Column:
    """1.0 if none of the expected words (lower case) is left in the text, or none was expected; else 0.0; null without a text."""
    left = F.arrays_overlap(lower_tokens(text), expected)
    return F.when(text.isNull(), F.lit(None).cast("double")).when(F.size(expected) == 0, 1.0).when(left, 0.0).otherwise(1.0)


def replaced_at(text: str, changes: list[tuple[int, str]]) -> str:
    """A text with the word at each place replaced, from right to left so that places stay true."""
    for at, new in sorted(changes, reverse=True):
        end = at
        while end < len(text) and text[end].isalnum():
            end += 1
        text = text[:at] + new + text[end:]
    return text


def character_tags(c: Column) -> Column:
    """An identifier's make-up: vowels ``^``, ``-_@`` as ``$``, 1-9 as ``#``, consonants ``+``, anything else ``*``."""
    low = F.regexp_replace(F.lower(c), r"[^a-z1-9\-_@]", "*")
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(low, letters + "123456789-_@", "".join("^" if x in "aeiou" else "+" for x in letters) + "#" * 9 + "$$$")


def is_abbreviation(c: Column, known: Column, allow: list[str] = (), deny: list[str] = ()) -> Column:
    """Whether a word looks abbreviated: by list, or short and not in the dictionary (``known``), or in capitals, or with a digit."""
    low = F.lower(c)
    looks = (F.length(c) <= 4) & ~known | ((F.upper(c) == c) & c.rlike("[A-Za-z]")) | c.rlike("[0-9]")
    return F.when(low.isin(list(allow)), True).when(low.isin(list(deny)), False).otherwise(looks)


def same_consonants(a: Column, b: Column) -> Column:
    """Whether one word without vowels contains the other, both having two letters or more."""
    x, y = (F.translate(F.lower(c), "aeiou", "") for c in (a, b))
    return (F.length(a) >= 2) & (F.length(b) >= 2) & (x.contains(y) | y.contains(x))


def lemma(word: str) -> str:
    """A word's plain form by rule: plural and verb endings go, ``part`` stays what it is."""
    w = word.lower()
    if w in {"part", "parts"}:
        return "part"
    for end, new in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ing", ""), ("ed", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) + len(new) >= 3 and not w.endswith("ss"):
            return w[: len(w) - len(end)] + new
    return w


def identifier_words(name: str, dictionary: frozenset[str] = frozenset()) -> list[str]:
    """The words of an identifier: cut at ``._-``, at changes of case and of letters to digits, then by the dictionary if all of it is words."""
    out: list[str] = []
    for part in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name):
        out += _by_dictionary(part.lower(), dictionary) or [part.lower()]
    return [w for w in out if w == "part" or len(w) > 1 and w.isalpha() and w not in STOP_WORDS]


def _by_dictionary(word: str, dictionary: frozenset[str]) -> list[str] | None:
    best: list = [[]] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if best[start] is not None and word[start:end] in dictionary and (best[end] is None or len(best[start]) + 1 < len(best[end])):
                best[end] = best[start] + [word[start:end]]
    return best[-1]


def normalised_sql(c: Column) -> Column:
    """A query in lower case with single spaces and no semicolon at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r";+\s*$", ""), r"\s+", " "))


def squeezed(c: Column) -> Column:
    """A text with single spaces for its white space, none at its ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def encoded_id(a: Column, b: Column) -> Column:
    """11, then a in four digits and b in three, as one number."""
    pad = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))
    return F.concat(F.lit("11"), pad(a, 4), pad(b, 3)).cast("long")


def decoded_id(c: Column) -> Column:
    """The four digits that ``encoded_id`` began with."""
    return F.substring(c.cast("string"), 3, 4).cast("int")


def metrics_of(c: Column) -> Column:
    """Scores from JSON (single quotes allowed) or the words timeout and error: struct<status, EX, EXP, EXR, F1>."""
    parsed = F.from_json(c, "EX int, EXP double, EXR double, F1 double", {"allowSingleQuotes": "true"})
    bad = F.lower(F.trim(c))
    status = F.when(c.isNull(), F.lit("missing")).when(bad.isin("timeout", "error"), bad).when(parsed["EX"].isNull(), F.lit("malformed")).otherwise("ok")
    return F.struct(status.alias("status"), *[F.when(status == "ok", parsed[k]).alias(k) for k in ("EX", "EXP", "EXR", "F1")])


def without_fences(c: Column) -> Column:
    """A model's answer without the Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def without_parentheses(sql: str) -> str:
    """A query with parentheses around single equalities taken away, as long as there are any."""
    while (new := re.sub(r"\(\s*([\w.`]+\s*=\s*[\w.`]+)\s*\)", r"\1", sql)) != sql:
        sql = new
    return sql


#: What engines call the function that finds a text's place in another.
_PLACE_OF = {"spark": "instr", "duckdb": "instr", "postgres": "strpos", "parser": "str_position"}


def dialect(sql: str, to: str = "spark") -> str:
    """A query with the function STR_POSITION, STRPOS or INSTR by the name it has in an engine (``parser``: a neutral form)."""
    return re.sub(r"\b(?:STR_POSITION|STRPOS|INSTR)\s*\(", _PLACE_OF[to] + "(", sql, flags=re.I)


def order_quoted(sql: str) -> str:
    """A query with a table or column named ``order`` in backticks; ORDER BY and strings stay."""
    return re.sub(r"'(?:[^']|'')*'|`[^`]*`|\border\b(?!\s+by\b)", lambda m: f"`{m[0]}`" if m[0].lower() == "order" else m[0], sql, flags=re.I)


def backticks_as_strings(c: Column) -> Column:
    """A query with its backticks made single quotes, as some corpora mean them."""
    return F.translate(c, "`", "'")


def aliases(names: list[str]) -> dict[str, str]:
    """For each name its first letter and, from the second such name on, a number."""
    seen: dict = {}
    out = {}
    for n in names:
        first = n[:1].lower()
        seen[first] = seen.get(first, 0) + 1
        out[n] = first + (str(seen[first]) if seen[first] > 1 else "")
    return out


def word_difference(before: Column, after: Column) -> Column:
    """``struct<removed, added>``: the different words that a text has lost and gained."""
    a, b = lower_tokens(before), lower_tokens(after)
    return F.struct(F.array_except(a, b).alias("removed"), F.array_except(b, a).alias("added"))


def token_count(c: Column) -> Column:
    """About how many tokens a prompt has: words and marks."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(\w+|[^\w\s])"), F.lit(1)))


def partial_ratio(a: str, b: str) -> float:
    """How much of the shorter text is in the best stretch of the longer one that has its length, in percent (twice the
    longest common subsequence by both lengths)."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    best = 0
    for k in range(-len(short) + 1, len(long)):
        part = long[max(0, k) : k + len(short)]
        row = [0] * (len(part) + 1)
        for x in short:
            last = 0
            for j, y in enumerate(part):
                row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
        best = max(best, 200.0 * row[-1] / (len(short) + len(part)))
    return best


def alike(threshold: float = 100.0) -> Callable[[str, str], bool]:
    """Whether two words of two letters or more are alike without their vowels, as far as a partial ratio of ``threshold``."""
    bones = lambda w: re.sub("[aeiou]", "", w.lower())
    return lambda a, b: len(a) > 1 and len(b) > 1 and bool(bones(a) and bones(b)) and partial_ratio(bones(a), bones(b)) >= threshold


def component_score(text: Column, rewritten: Column, expected: Column) -> Column:
    """The hiding score of a rewritten question or evidence: null without a text or anything to hide, 0.0 if nothing is left of the text."""
    return F.when(text.isNull() | expected.isNull() | (F.size(expected) == 0), F.lit(None).cast("double")).when(
        F.coalesce(F.trim(rewritten), F.lit("")) == "", 0.0).otherwise(hiding_score(rewritten, expected))


def mentions(tokens: Column, attribute: Column) -> Column:
    """Whether a text's words (lower case) name an attribute: all its parts are there one after the other, or one of its
    parts begins with a word of two letters or more."""
    parts = F.filter(F.split(F.lower(attribute), r"[._\s]+"), lambda p: F.length(p) > 0)
    whole = F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" ")))
    return whole | F.exists(tokens, lambda t: (F.length(t) > 1) & F.exists(parts, lambda p: p.startswith(t)))


def operator_of(operators: Column, position: Column, pattern: Column) -> Column:
    """The operator a mutant stands for: its only one, else the one at its place in the pattern, else the pattern's first."""
    only = F.when(F.size(operators) == 1, operators[0])
    return F.coalesce(only, F.try_element_at(operators, position), F.split(pattern, " → ")[0], F.lit("unknown"))


def column_text(name: Column, kind: Column, values: Column) -> Column:
    return F.concat(F.lit("Column name: "), name, F.lit(" Data type: "), kind, F.lit(" Sample values: "), F.array_join(values, ", "))


def linked(question: Column, names: Column, related: Callable[[Column, Column], Column] = same_consonants) -> Column:
    """The words of a question that match any of some names, by equality or by ``related``."""
    return F.array_distinct(F.filter(lower_tokens(question), lambda t: F.exists(names, lambda n: (t == F.lower(n)) | related(t, n))))
