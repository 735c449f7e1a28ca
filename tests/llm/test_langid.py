from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from plumbline.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def normal(text):
    out = ["   "]
    for c in "\n" + text:
        low = c.lower() if c.isalpha() else " "
        if low != " " or out[-1][-1] != " ":
            out.append(low)
    return "".join(out)


def brute(corpus, probe):
    """Interpolated Kneser-Ney by its definition, for one language over 4-grams."""
    count = {4: Counter()}
    for t in corpus:
        s = normal(t)
        count[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    for o in (3, 2, 1):
        count[o] = Counter(g[1:] for g in count[o + 1])
    total, kinds = defaultdict(Counter), defaultdict(Counter)
    disc = {}
    for o, c in count.items():
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        disc[o] = n1 / (n1 + 2 * n2) if n1 else 0.5
        for g, v in c.items():
            total[o][g[:-1]] += v
            kinds[o][g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / 65536
        o, ctx = len(g), g[:-1]
        if not total[o][ctx]:
            return p(g[1:])
        return max(count[o][g] - disc[o], 0) / total[o][ctx] + disc[o] * kinds[o][ctx] / total[o][ctx] * p(g[1:])

    s = normal(probe)
    return -sum(math.log(p(s[i - 3 : i + 1])) for i in range(3, len(s))) / max(1, len(s) - 3)


def test_model_equals_the_definition():
    reader = langid.Reader()
    corpora = {"aa": ["the cat sat on the mat", "The hat, that hat!"], "bb": ["der hut und das haus", "öl und brot; über"]}
    rows = []
    for k, texts in enumerate(corpora.values()):
        grams, n = np.unique(reader.grams(texts)[0], return_counts=True)
        rows.append((grams, np.full(len(grams), k), n))
    m = langid.Model(list(corpora), *[np.concatenate(x) for x in zip(*rows)])
    probes = ["the hat", "über das", "zzz 42", "Q", "the"]
    e, n, has = m.entropies(reader, probes)
    for i, t in enumerate(probes):
        for k, c in enumerate(corpora.values()):
            assert math.isclose(e[i, k], brute(c, t), rel_tol=1e-5), (t, k)
    assert has.all()


def test_letters():
    has = langid.Reader().grams(["", "123 !?", "x", "é", "日本", "😀", "𝒜", "½", "ª"])[2]
    assert has.tolist() == [any(c.isalpha() for c in t) for t in ["", "123 !?", "x", "é", "日本", "😀", "𝒜", "½", "ª"]]


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    parts = {"en": ["the", "and", "ing", "th", "er", "on"], "de": ["der", "und", "ung", "sch", "ein", "ü"], "fr": ["les", "que", "eau", "é", "ou", "ment"]}
    rows = []
    for k in range(400):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.choice([8, 60]))), lang if rng.random() > 0.1 else None, "clash"))
    rows += [(1000, None, "en", None), (1001, "12 34", "de", None), (None, "the and thing", "en", None), (5, rows[5][1], rows[5][2], None), (1002, "and " * 400_000, None, None)]
    got = langid.predicted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for (d, t, lang, _), r in zip(rows, got):
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (t is None or t == "12 34") and 0 <= r.score <= 1
    judged = [(r.lang_pred, x[2]) for x, r in zip(rows, got) if r.held_out and x[2]]
    assert sum(a == b for a, b in judged) > 0.97 * len(judged)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None, None)], SCHEMA)
    assert [tuple(r)[2:4] for r in langid.predicted(df).collect()] == [("und", 0.0)]
    assert langid.predicted(df.limit(0)).collect() == []


def test_rare_grams_of_many_languages_count(spark):
    rng = random.Random(2)
    corpora = {}
    for k in range(60):
        usual = ["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(20)]
        rare = ["".join(rng.choices("qrstuvwxyzàèìòù", k=7)) for _ in range(30)]
        corpora[f"l{k:02d}"] = [" ".join(rng.choices(usual, k=1500)), " ".join(rare)]
    rows = [(None, t, lang, None) for lang, texts in corpora.items() for t in texts]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    for k in (0, 31, 59):
        name = model.langs[k]
        for probe in (corpora[name][1], corpora[name][0][:200], "quite another text"):
            entropy = model.entropies(langid.Reader(), [probe])[0]
            assert math.isclose(entropy[0, k], brute(corpora[name], probe), rel_tol=1e-5), (name, probe[:20])


def test_hundreds_of_languages(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for name in (f"x{j:03d}" for j in range(300)):
        parts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice([2, 3]))) for _ in range(25)]
        for _ in range(8):
            rows.append((k, " ".join("".join(rng.choices(parts, k=2)) for _ in range(60)), name, None))
            k += 1
    got = {r.doc_id: r for r in langid.predicted(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out}
    assert len(got) > 500 and sum(got[d].lang_pred == lang for d, _, lang, _ in rows if d in got) >= 0.97 * len(got)


def test_calibration_rows_are_not_counted(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    rows = [(k, text() + f" {chr(0x430 + k % 30)}{chr(0x450 + k // 30)}{chr(0x430 + k % 29)}", "aa", None) for k in range(600)] + [(9000, "lone text", "bb", None)]
    seen = {}
    real = langid.Model.calibrate
    monkeypatch.setattr(langid.Model, "calibrate", lambda self, e, lang: (seen.update(n=len(lang), e=e), real(self, e, lang))[1])
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["aa", "bb"] and 30 <= seen["n"] <= 90  # a tenth, about; of a rare language none
    plain = langid.fit(spark.createDataFrame(rows, SCHEMA).limit(0))
    assert plain is None
