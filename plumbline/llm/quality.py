"""Quality classification by co-training two views of a document.

One classifier sees what a text says (its words and their make-up), the other the page's metadata
(source, language, recorded length), never the text.  Both are logistic regressions.  In each round
either hands the documents it is surest of, out of all unlabelled ones, to the other as
pseudo-labels (Blum and Mitchell, 1998).  Afterwards each is calibrated on labelled rows that neither
was trained on, and a last regression joins the two calibrated scores.  A document is good if its
quality label is 1 and it is not toxic.

Features are made once for the whole corpus, in the labelled sample's vocabulary, and written to
the shared folder; rounds and scores read these alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm import common

#: Labelled rows that are fitted on: about so many, picked by a hash of the id.
LABELLED = 8000
#: Words of the content view are those in so many labelled documents at least.
LEAST_DOCUMENTS = 4
ROUNDS = 4
#: Pseudo-labels that a view gives per round and class at most, and how sure it must be.
GIVEN, SURE = 300, 0.98
#: What is kept of a document for rounds and scores.
PACKED = ["words", "figures", "source", "lang", "n_chars"]
#: A document is rejected if its joint score is below.
THRESHOLD = 0.5

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def content(text: str | None) -> tuple[np.ndarray, list[float]]:
    """Hashes of a text's distinct words (sorted), and figures of its make-up."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    upper, lower, digit = n[65:91].sum(), n[97:123].sum(), n[48:58].sum()
    other = n[33:127].sum() - upper - lower - digit
    usual = n[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    tokens = raw.split()
    count = max(1, len(tokens))
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    words = set(raw.translate(_LOWER).split())
    lines = [x for x in raw.split(b"\n") if x]
    figures = [
        upper / size, digit / size, (other - usual) / size, usual / size, n[33] / size, n[124] / size, n[195:245].sum() / size,
        again / count, len(words) / count, np.log1p(len(tokens)), (size - n[32] - n[10]) / count / 10, 1 - len(set(lines)) / max(1, len(lines)),
        float(not tokens),
    ]
    return np.array(sorted(map(zlib.crc32, words)), np.int64), figures


def recorded(n_chars: int | None) -> list[float]:
    """Figures of a page that its metadata tell beside source and language."""
    return [np.log1p(max(0, n_chars or 0)), float(n_chars is None)]


class Features:
    """Sparse rows: the columns of each, in one array, and dense figures beside them."""

    def __init__(self, ids: list[np.ndarray], figures: np.ndarray):
        self.size = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(ids)), self.size)
        self.figures = figures

    def __len__(self) -> int:
        return len(self.size)

    def take(self, rows: np.ndarray) -> Features:
        cut = np.split(self.ids, np.cumsum(self.size)[:-1])
        return Features([cut[r] for r in rows], self.figures[rows])


def joined(parts: list[Features]) -> Features:
    """Rows one after the other."""
    out = Features([], np.concatenate([p.figures for p in parts]))
    out.size, out.ids = np.concatenate([p.size for p in parts]), np.concatenate([p.ids for p in parts])
    out.row = np.repeat(np.arange(len(out.size)), out.size)
    return out


class Logistic:
    """Logistic regression with an L2 penalty over sparse columns and standardised figures."""

    def __init__(self, columns: int, figures: int, penalty: float = 2e-4):
        self.w, self.v, self.b, self.penalty = np.zeros(columns), np.zeros(figures), 0.0, penalty
        self.mean, self.scale = np.zeros(figures), np.ones(figures)

    def logit(self, x: Features) -> np.ndarray:
        z = (np.clip((x.figures - self.mean) / self.scale, -8, 8)) @ self.v + self.b
        return z + np.bincount(x.row, self.w[x.ids], minlength=len(x)) if len(self.w) else z

    def begin(self, x: Features, y: np.ndarray) -> None:
        """Columns start from how much oftener good rows have them than bad ones, as a log ratio."""
        good, bad = (np.bincount(x.ids, of[x.row], minlength=len(self.w)) for of in (y, 1 - y))
        self.w = np.log((good + 1) / (y.sum() + 2)) - np.log((bad + 1) / ((1 - y).sum() + 2))

    def fit(self, x: Features, y: np.ndarray, weight: np.ndarray, steps: int) -> None:
        """Adam over all rows at once; goes on from what is there."""
        self.mean, self.scale = x.figures.mean(0), x.figures.std(0) + 1e-6
        dense = np.clip((x.figures - self.mean) / self.scale, -8, 8)
        theta = np.concatenate([self.w, self.v, [self.b]])
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        k, total = len(self.w), weight.sum()
        for t in range(1, steps + 1):
            self.w, self.v, self.b = theta[:k], theta[k:-1], theta[-1]
            r = (1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30))) - y) * weight / total
            g = np.concatenate([np.bincount(x.ids, r[x.row], minlength=k), r @ dense, [r.sum()]]) + self.penalty * np.r_[theta[:-1], 0]
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta = theta - 0.1 / np.sqrt(1 + t / 20) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w, self.v, self.b = theta[:k], theta[k:-1], float(theta[-1])


def _platt(z: np.ndarray, y: np.ndarray) -> Logistic:
    """A regression of the label on some views' scores (columns of z)."""
    out = Logistic(0, z.shape[1], 1e-3)
    out.fit(Features([np.zeros(0, np.int64)] * len(z), z), y, np.ones(len(z)), 200)
    return out


class Model:
    """Both views, their calibrations and the joint score."""

    def __init__(self, vocabulary: np.ndarray, sources: list[str], langs: list[str]):
        self.vocabulary = vocabulary  # sorted hashes
        self.values = {("source", x): k for k, x in enumerate(sources)} | {("lang", x): len(sources) + k for k, x in enumerate(langs)}

    def content_features(self, hashes: list[np.ndarray], figures: list) -> Features:
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        at = np.minimum(np.searchsorted(self.vocabulary, flat), max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[at] == flat if len(self.vocabulary) else np.zeros(len(flat), bool)
        count = np.bincount(row[hit], minlength=len(hashes))
        return Features(np.split(at[hit], np.cumsum(count)[:-1]) if hashes else [], np.array(figures, float).reshape(len(hashes), -1))

    def metadata_features(self, sources: list, langs: list, figures: list) -> Features:
        ids = [np.array([k for k in (self.values.get(("source", s)), self.values.get(("lang", g))) if k is not None], np.int64) for s, g in zip(sources, langs)]
        return Features(ids, np.array(figures, float).reshape(len(ids), -1))

    def pack(self, texts: list) -> tuple[list[bytes], list[bytes]]:
        """Each text's words as places in the vocabulary, and its figures: 32 bits each."""
        got = [content(t) for t in texts]
        x = self.content_features([h for h, _ in got], [f for _, f in got])
        ids, ends = x.ids.astype("<u4").tobytes(), (4 * np.cumsum(x.size)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)], [f.tobytes() for f in x.figures.astype("<f4")]

    def views_of(self, words: list[bytes], figures: list[bytes], sources: list, langs: list, n_chars: list) -> tuple[Features, Features]:
        """Both views' features from packed ones."""
        a = Features([np.frombuffer(w, "<u4").astype(np.int64) for w in words], np.frombuffer(b"".join(figures), "<f4").astype(float).reshape(len(figures), -1))
        return a, self.metadata_features(sources, langs, [recorded(n) for n in n_chars])

    def train(self, a: Features, b: Features, y: np.ndarray, surest: Callable[[Model, int], list]) -> None:
        """y: 1 good, 0 bad.  Every fourth row is kept for calibration.

        ``surest(model, turn)`` gives (view, label, key, packed features) of the unlabelled documents that a view is surest of
        and hasn't given yet; the other view learns them, and with them sources and languages that no labelled row has.
        """
        every = np.arange(len(y))
        kept = every[::4] if len(y) >= 40 else every
        own = np.setdiff1d(every, kept) if len(y) >= 40 else every
        self.views = [Logistic(len(self.vocabulary), a.figures.shape[1]), Logistic(len(self.values), b.figures.shape[1], 1e-3)]
        for x, m in zip((a, b), self.views):
            m.begin(x.take(own), y[own].astype(float))
        self.given: list[list] = [[], []]  # (key, label) that a view got from the other, in order
        extra: list[list] = [[], []]
        for turn in range(ROUNDS + 1):
            for k, (x, model) in enumerate(zip((a, b), self.views)):
                target = np.r_[y[own], [label for _, label in self.given[k]]].astype(float)
                weight = np.r_[np.ones(len(own)), np.full(len(extra[k]), 0.3)]
                for label in (0.0, 1.0):  # both classes count alike up to a power
                    share = weight[target == label].sum() / max(1e-9, weight.sum())
                    weight[target == label] /= max(share, 0.05) ** 0.5
                model.fit(joined([x.take(own), *extra[k]]), target, weight, 150 if turn == 0 else 50)
            if turn == ROUNDS:
                break
            picked = surest(self, turn)
            for view, label, key, row in picked:
                self.given[1 - view].append((key, label))
                for name in ("source", "lang"):
                    if row[name] is not None:
                        self.values.setdefault((name, row[name]), len(self.values))
            self.views[1].w = np.r_[self.views[1].w, np.zeros(len(self.values) - len(self.views[1].w))]
            for view, _, _, row in picked:
                extra[1 - view].append(self.views_of(*([row[c]] for c in PACKED))[1 - view])
        z = [m.logit(x.take(kept)) for x, m in zip((a, b), self.views)]
        self.calibrated = [_platt(v[:, None], y[kept].astype(float)) for v in z]
        self.joint = _platt(np.stack(z, 1), y[kept].astype(float))

    def logits(self, a: Features, b: Features) -> np.ndarray:
        """How sure each view (column) is that a row is good, or (below 0) bad."""
        return np.stack([np.clip(m.logit(x), -30, 30) for m, x in zip(self.views, (a, b))], 1)

    def score(self, a: Features, b: Features) -> np.ndarray:
        """Columns: content, metadata and joint probability of being good."""
        z = [m.logit(x) for m, x in zip(self.views, (a, b))]
        none = lambda v: Features([np.zeros(0, np.int64)] * len(v), v)
        out = [m.logit(none(v[:, None])) for m, v in zip(self.calibrated, z)] + [self.joint.logit(none(np.stack(z, 1)))]
        return 1 / (1 + np.exp(-np.clip(np.stack(out, 1), -30, 30)))


def _columns(df: DataFrame) -> list:
    """Source, language and length, or nulls where a table has no such column."""
    has = set(df.columns)
    return [(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut so small that what is made of one at a time stays small beside the model."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _sample(df: DataFrame, size: int, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id's hash is in one of so many equal parts that about ``size`` rows remain."""
    parts = max(1, df.count() // size)
    return df.where(F.pmod(F.xxhash64(id_col, F.lit("quality")), F.lit(parts)) == 0)


def _told(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        (F.min("quality") * (1 - F.max(F.coalesce("toxic", F.lit(0))))).cast("int").alias("good"))


def _labelled(df: DataFrame, told: DataFrame, id_col: str, text_col: str) -> tuple[Model, Features, Features, np.ndarray] | None:
    """An untrained model and the features of about LABELLED labelled rows; None without rows of both classes.

    Texts become hashes on the executors; the driver gets these only.
    """
    some = F.broadcast(_sample(told, LABELLED, id_col))  # bounded by LABELLED
    known = df.select(id_col, F.col(text_col).alias("text"), *_columns(df)).join(some, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            key, text, source, lang, n, good = (c.to_pylist() for c in batch.columns)
            got = [content(t) for t in text]
            yield pa.RecordBatch.from_arrays(
                [pa.array([zlib.crc32(str(k).encode()) for k in key], pa.int64()), pa.array([h.astype("<u4").tobytes() for h, _ in got], pa.binary()),
                 pa.array([np.array(f, "<f4").tobytes() for _, f in got], pa.binary()), pa.array(source, pa.string()), pa.array(lang, pa.string()), pa.array(n, pa.int64()), pa.array(good, pa.int32())],
                names=["k", "words", "figures", "source", "lang", "n_chars", "good"])

    got = known.select(id_col, "text", "source", "lang", "n_chars", "good").mapInArrow(
        run, "k long, words binary, figures binary, source string, lang string, n_chars long, good int").toArrow()
    got = got.sort_by([("k", "ascending"), ("good", "ascending"), ("words", "ascending")])  # the order in which rows come may vary
    y = np.array(got["good"].to_pylist(), int)
    if not (y == 1).any() or not (y == 0).any():
        return None
    words = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in got["words"]]
    figures = np.frombuffer(b"".join(x.as_py() for x in got["figures"]), "<f4").astype(float).reshape(len(y), -1)
    hashes, n = np.unique(np.concatenate(words), return_counts=True)
    source, lang = got["source"].to_pylist(), got["lang"].to_pylist()
    values = lambda c: sorted({x for x in c if x is not None})  # noqa: E731  bounded by the sample
    model = Model(hashes[n >= LEAST_DOCUMENTS], values(source), values(lang))
    return model, model.content_features(words, figures), model.metadata_features(source, lang, [recorded(n) for n in got["n_chars"].to_pylist()]), y


_PACKED = "words binary, figures binary, source string, lang string, n_chars long"


def _features(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, packed features, k)`` of every row; ``k`` is equal for equal features."""
    opened, kind = common.sent(df.sparkSession, model), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened()
        for part in _slices(batches):
            words, figures = m.pack(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.binary()), pa.array(figures, pa.binary()), *part.columns[2:]],
                                             names=[id_col, "words", "figures", "source", "lang", "n_chars"])

    made = df.select(id_col, F.col(text_col).alias("text"), *_columns(df)).mapInArrow(run, f"`{id_col}` {kind}, {_PACKED}")
    return common.saved(made.select(id_col, *PACKED, F.xxhash64(*PACKED).alias("k")), "quality-features")


_PACKED = "words binary, figures binary, source string, lang string, n_chars long"


def _surest(features: DataFrame, told: DataFrame, id_col: str) -> Callable[[Model, int], list]:
    """What ``Model.train`` asks for: of all documents without a label, and unlike those with one, the GIVEN that a view is surest of, by class.

    Documents with equal features count once.  A round is one pass over the packed features; what moves
    is a key and a number for each document that a view is sure of.  Counts by sureness tell which of
    these can be among the GIVEN, and only they are ordered.
    """
    labelled = common.saved(features.select(id_col, "k").join(told, id_col, "left_semi").select("k").distinct(), "labelled-features")

    def ask(model: Model, turn: int) -> list:
        opened = common.sent(features.sparkSession, model)
        done, least = [np.array([k for k, _ in model.given[1 - view]], np.int64) for view in (0, 1)], np.log(SURE / (1 - SURE))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = opened()
            for batch in _slices(batches):
                k = batch.column(0).to_numpy()
                z = m.logits(*m.views_of(*(c.to_pylist() for c in batch.columns[1:])))
                for view in (0, 1):
                    at = np.flatnonzero((np.abs(z[:, view]) >= least) & ~np.isin(k, done[view]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view, np.int32)), pa.array((z[at, view] > 0).astype(np.int32)), pa.array(k[at]), pa.array(np.abs(z[at, view]))],
                                                     names=["view", "label", "k", "z"])

        sure = features.select("k", *PACKED).mapInArrow(run, "view int, label int, k long, z double").groupBy("view", "label", "k").agg(F.max("z").alias("z"))
        sure = common.saved(sure.join(labelled, "k", "left_anti").withColumn("step", F.floor(F.col("z") * 8)), "sure")
        steps = sorted((tuple(r) for r in sure.groupBy("view", "label", "step").agg(F.count("*").alias("n")).collect()), key=lambda r: -r[2])  # 240 steps at most, by view and class
        total, enough = {}, {}
        for view, label, step, n in steps:
            if total.get((view, label), 0) < GIVEN:
                total[view, label], enough[view, label] = total.get((view, label), 0) + n, step
        if not enough:
            return []
        some = F.lit(False)
        for (view, label), step in enough.items():
            some |= (F.col("view") == view) & (F.col("label") == label) & (F.col("step") >= step)
        best = sure.where(some).withColumn("r", F.row_number().over(W.partitionBy("view", "label").orderBy(F.desc("z"), "k"))).where(F.col("r") <= GIVEN)
        picked = sorted((r["view"], r["label"], r["r"], r["k"]) for r in best.collect())  # 4 GIVEN rows at most
        keys = features.sparkSession.createDataFrame([(k,) for k in {k for *_, k in picked}], "k long")
        rows = features.select("k", *PACKED).join(F.broadcast(keys), "k").groupBy("k").agg(*[F.first(c).alias(c) for c in PACKED]).toArrow().to_pylist()
        found = {r["k"]: r for r in rows}
        return [(view, label, k, found[k]) for view, label, _, k in picked]

    return ask


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame] | None:
    """The model, fitted on about LABELLED labelled rows and, by co-training, on all others; and all rows' packed features.
    None without labelled rows of both classes.

    ``labels``: id, quality, toxic; rows with null quality are no labels; of several rows for an id the worst counts.
    """
    told = _told(labels, id_col)
    sample = _labelled(df, told, id_col, text_col)
    if sample is None:
        return None
    model, a, b, y = sample
    features = _features(df, model, id_col, text_col)
    model.train(a, b, y, _surest(features, told, id_col))
    return model, features


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, p_content, p_metadata, score, keep)`` for each row of ``df``.

    Null texts count as empty, unknown or null sources and languages say nothing; repeated rows get
    equal results; of equally sure documents those with the smaller hash are handed on; very long
    texts are read whole, some at a time; an empty table gives none; without labels of both classes
    all scores are null and every row is kept.
    """
    found = fit(df, labels, id_col, text_col)
    if found is None:
        none = F.lit(None).cast("double")
        return df.select(id_col, none.alias("p_content"), none.alias("p_metadata"), none.alias("score"), F.lit(True).alias("keep"))
    opened = common.sent(df.sparkSession, found[0])
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened()
        for batch in _slices(batches):
            p = m.score(*m.views_of(*(c.to_pylist() for c in batch.columns[1:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(3)), pa.array(p[:, 2] >= THRESHOLD)],
                                             names=[id_col, "p_content", "p_metadata", "score", "keep"])

    return found[1].select(id_col, *PACKED).mapInArrow(run, f"`{id_col}` {kind}, p_content double, p_metadata double, score double, keep boolean")


def kept(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``scored`` keeps, unchanged; no shuffle."""
    found = fit(df, labels, id_col, text_col)
    if found is None:
        return df
    opened = common.sent(df.sparkSession, found[0])
    names = df.columns
    at = [names.index(c) if c in names else None for c in (text_col, "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened()
        for part in _slices(batches):
            texts, *told = ([None] * part.num_rows if c is None else part.column(c).to_pylist() for c in at)
            yield part.filter(pa.array(m.score(*m.views_of(*m.pack(texts), *told))[:, 2] >= THRESHOLD))

    return df.mapInArrow(run, df.schema)
