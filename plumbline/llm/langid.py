"""Language identification by interpolated Kneser-Ney character models.

Counts of character 4-grams by language are gathered from all training texts, summed in each batch
before the shuffle; all of them count, so a model grows with its corpus's different grams.  A model
holds, for orders 4 to 1, the grams in a sorted array and the probabilities of those languages that
have each; the others' follow from the order below.  A text gets the language with the lowest cross-entropy per
character; a temperature and a bound fitted on training rows turn entropies into scores and mark
texts that look like no language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

ORDER = 4
#: Training rows, about, on which scores and rejection are calibrated.
CALIBRATION_ROWS = 2000
#: Of the rows of a language with ENOUGH of them one in SPARED at most is calibrated on, and not counted.
SPARED, ENOUGH = 10, 20
#: Characters that are worked on at a time (whole texts, as many as it takes to pass this).
CHUNK = 1_000_000


def folding() -> tuple[np.ndarray, np.ndarray]:
    """For each UTF-16 unit: its lower-case letter, or a space for what is no letter; and whether it is a letter.
    Halves of pairs stand for themselves."""
    fold, letter = np.full(65536, 32, np.uint16), np.zeros(65536, bool)
    for c in range(65536):
        if 0xD800 <= c < 0xE000:
            fold[c] = c
        elif chr(c).isalpha():
            low = chr(c).lower()
            fold[c], letter[c] = ord(low) if len(low) == 1 else c, True
    return fold, letter


class Reader:
    """Texts to grams."""

    def __init__(self):
        self.fold, self.letter = folding()

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, the text of each, whether each text has a letter).

        Letters are lower-cased, runs of anything else become one space, and each text begins with
        spaces.  A gram has a 16-bit unit for each of ORDER characters, the last one lowest.
        """
        raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2 + 1
        unit = np.frombuffer(b"".join(b"\n\0" + r for r in raw), np.uint16)
        doc = np.repeat(np.arange(len(raw)), size)
        has = np.bincount(doc[self.letter[unit]], minlength=len(raw)) > 0
        for k in np.flatnonzero(~has & (np.bincount(doc[(unit & 0xF800) == 0xD800], minlength=len(raw)) > 0)):
            has[k] = any(c.isalpha() for c in texts[k])
        unit = self.fold[unit]
        keep = np.r_[True, (unit[1:] != 32) | (unit[:-1] != 32) | (doc[1:] != doc[:-1])]
        unit, doc = unit[keep], doc[keep]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        place = np.arange(len(unit)) - np.repeat(first, np.diff(np.r_[first, len(unit)]))
        gram = unit.astype(np.uint64)
        for k in range(1, ORDER):
            before = np.full(len(unit), 32, np.uint64)
            before[k:] = unit[:-k]
            before[place < k] = 32
            gram |= before << np.uint64(16 * k)
        real = place > 0
        return gram[real], doc[real], has


def _chunks(texts: list, *along: list) -> Iterator[tuple]:
    held: tuple = tuple([] for _ in range(1 + len(along)))
    size = 0
    for row in zip(texts, *along):
        for h, x in zip(held, row):
            h.append(x)
        size += len(row[0])
        if size >= CHUNK:
            yield held
            held, size = tuple([] for _ in held), 0
    if held[0]:
        yield held


def _added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def gram_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, gram, n)`` over all rows that have a language; null texts have no grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            found: dict = {}
            for texts, ls in _chunks([t.as_py() or "" for t in batch.column(1)], langs):
                gram, doc, _ = reader.grams(texts)
                names = sorted(set(ls))
                of = np.array([names.index(x) for x in ls])[doc]
                for k, name in enumerate(names):
                    keys, n = np.unique(gram[of == k], return_counts=True)
                    found.setdefault(name, []).append((keys, n))
            for name, parts in found.items():
                keys, n = _added([p[0] for p in parts], [p[1] for p in parts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Cells:
    """A value for each of some pairs of a key and a language: sorted keys, and for each a stretch of languages and values."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, lang: np.ndarray, value: np.ndarray):
        """``at``: positions in ``keys``, ascending."""
        self.keys, self.lang, self.value = keys, lang.astype(np.int32), value.astype(np.float32)
        self.start = np.searchsorted(at, np.arange(len(keys) + 1))

    def fill(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Puts the values of some keys into their rows of ``out``, which has a column for each language."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == keys)
        begin, size = self.start[at[row]], self.start[at[row] + 1] - self.start[at[row]]
        cell = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        out[np.repeat(row, size), self.lang[cell]] = self.value[cell]


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters of each gram."""
    return keys & np.uint64((1 << 16 * order) - 1)


class Model:
    """Probabilities by language: for each order those of grams, and the weights of contexts."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang: np.ndarray, n: np.ndarray):
        """From rows of (gram, position in ``langs``, count)."""
        self.langs, self.grams, self.weights = langs, {}, {}
        self.temperature, self.worst = 1.0, np.full(len(langs), np.inf)
        size = max(1, len(langs))

        def summed(keys: np.ndarray, lang: np.ndarray, n: np.ndarray) -> tuple:
            """(keys, position of each cell's key, its language, its sum, the cell of each row)."""
            keys, at = np.unique(keys, return_inverse=True)
            cell, back = np.unique(at * size + lang, return_inverse=True)
            return keys, cell // size, cell % size, np.bincount(back, n, minlength=len(cell)), back

        tables = {ORDER: summed(gram, np.asarray(lang, np.int64), n)}
        for order in range(ORDER - 1, 0, -1):  # below the top: the number of characters seen before a gram
            keys, at, of, _, _ = tables[order + 1]
            tables[order] = summed(_low(keys, order)[at], of, np.ones(len(at)))
        lower = np.zeros(0)
        for order in range(1, ORDER + 1):
            keys, at, of, counts, _ = tables[order]
            once, twice = (np.bincount(of[counts == k], minlength=size) for k in (1, 2))
            discount = np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5)
            context, c_at, c_of, total, back = summed((keys >> np.uint64(16))[at], of, counts)
            weight = discount[c_of] * np.bincount(back, minlength=len(total)) / total
            below = lower[tables[order - 1][4]] if order > 1 else 1 / 65536  # a row of the order below for each cell
            lower = np.maximum(counts - discount[of], 0) / total[back] + weight[back] * below
            self.grams[order], self.weights[order] = Cells(keys, at, of, lower), Cells(context, c_at, c_of, weight)

    def prob(self, order: int, keys: np.ndarray) -> np.ndarray:
        """The probability of each gram's last character after those before, a column for each language."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), 1 / 65536)
        some, at = np.unique(_low(keys, order - 1), return_inverse=True)
        out = np.ones((len(keys), len(self.langs)))
        self.weights[order].fill(keys >> np.uint64(16), out)
        out *= self.prob(order - 1, some)[at]
        self.grams[order].fill(keys, out)
        return out

    def entropies(self, reader: Reader, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character by text and language, characters, whether a text has a letter)."""
        gram, doc, has = reader.grams(texts)
        keys, at = np.unique(gram, return_inverse=True)
        cost = -np.log(self.prob(ORDER, keys)) if len(keys) else np.zeros((0, len(self.langs)))
        n = np.bincount(doc, minlength=len(texts))
        total = np.stack([np.bincount(doc, cost[:, k][at], minlength=len(texts)) for k in range(len(self.langs))], 1)
        return total / np.maximum(n, 1)[:, None], n, has

    def scores(self, entropy: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, by the fitted temperature."""
        x = -(entropy - entropy.min(1, keepdims=True)) * self.temperature
        return np.exp(x) / np.exp(x).sum(1, keepdims=True)

    def calibrate(self, entropy: np.ndarray, lang: np.ndarray) -> None:
        """Fits the temperature by log loss, and by language the entropy beyond which a text looks unlike it
        (that of the 999th of 1000 of its texts, and a tenth more)."""
        rows = np.arange(len(lang))

        def loss(t: float) -> float:
            self.temperature = t
            return -np.log(np.maximum(self.scores(entropy)[rows, lang], 1e-9)).mean()

        if len(lang):
            self.temperature = min((0.5 * 2**k for k in range(8)), key=loss)
            for k in set(lang.tolist()):
                self.worst[k] = 1.1 * np.quantile(entropy[lang == k, k], 0.999)


def fit(train: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """The model of the rows of ``train`` that have a language; None if there are none.

    About CALIBRATION_ROWS rows, one in SPARED at most, picked by a hash of the id among languages with
    ENOUGH rows, are kept out of the counts, and scored for calibration.  All other texts are counted, and
    every count reaches the driver: as many rows as there are different grams of a language.
    """
    known = train.where(F.col(lang_col).isNotNull())
    size = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row for each language
    every = max(SPARED, sum(size.values()) // CALIBRATION_ROWS)
    often = F.col(lang_col).cast("string").isin([x for x in size if size[x] >= ENOUGH])
    apart = F.coalesce(often & F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("calibration")), F.lit(every)) == 0), F.lit(False))
    counts = common.saved(gram_counts(known.where(~apart), lang_col, text_col), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    at = F.create_map(*[x for k, name in enumerate(langs) for x in (F.lit(name), F.lit(k))])
    table = counts.select("gram", at[F.col("lang")].alias("lang"), "n").toArrow()
    gram, lang, n = (table.column(k).to_numpy() for k in range(3))
    model = Model(langs, gram.view(np.uint64), lang, n)
    apart &= F.col(lang_col).cast("string").isin(langs)
    found = scored(known.where(apart), model, id_col, text_col, lang_col).where("n > 0").select("lang", "entropy").collect()
    model.calibrate(np.array([r["entropy"] for r in found]).reshape(-1, len(langs)), np.array([langs.index(r["lang"]) for r in found], int))
    return model


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """``(id_col, lang, entropy by language, n, lang_pred, score, rejected)``; ``lang`` is carried along, never read."""
    opened = common.sent(df.sparkSession, model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = opened(), Reader()
        for batch in batches:
            entropy, n, pred, score, rejected = [], [], [], [], []
            for (texts,) in _chunks([t.as_py() or "" for t in batch.column(2)]):
                e, size, has = m.entropies(reader, texts)
                best, s = e.argmin(1), m.scores(e).max(1)
                entropy += e.tolist()
                n += np.where(has, size, 0).tolist()
                pred += [m.langs[k] if h else "und" for k, h in zip(best.tolist(), has.tolist())]
                score += np.where(has, s, 0.0).tolist()
                rejected += (~has | (e[np.arange(len(best)), best] > m.worst[best])).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(entropy, pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(pred, pa.string()),
                 pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[id_col, "lang", "entropy", "n", "lang_pred", "score", "rejected"])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return df.select(id_col, lang.alias("lang"), text_col).mapInArrow(
        run, f"`{id_col}` {kind}, lang string, entropy array<double>, n long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: the CRC-32 of its id's text leaves 2 when divided by 4 (never for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, held_out, lang_pred, score, rejected)`` for each row, learned from the rows not held out.

    A text that is null or has no letter gets ``und`` with score 0, as do all if nothing can be
    learned; ties go to the language that sorts first; repeated rows get equal results; an empty
    table gives none; very long texts are read whole.  ``rejected`` marks texts that look unlike every language.
    """
    model = fit(df.where(~held_out(id_col)), id_col, lang_col, text_col)
    if model is None:
        return df.select(id_col, held_out(id_col).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    return scored(df, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
