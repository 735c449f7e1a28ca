from __future__ import annotations

import hashlib
import random
import re

from plumbline.llm import decontaminate
from plumbline.llm.registry import op4_digest

SCHEMA = "doc_id long, text string, bench_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def longest(w, b, size=10):
    """Words of the longest run of ``size`` words or more that both have; an item of fewer counts as a whole."""
    best = 0
    for p in range(len(w)):
        for k in range(len(b)):
            n = 0
            while p + n < len(w) and k + n < len(b) and w[p + n] == b[k + n]:
                n += 1
            if n >= min(size, len(b)):
                best = max(best, n)
    return best


def brute(text, bench, size=10):
    w, hit, items, most = words(text), set(), set(), 0
    for item, t in bench:
        b = words(t)
        for k in range(max(1, len(b) - size + 1) if b else 0):
            win = b[k : k + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    items.add(str(item))
        most = max(most, longest(w, b) if any(map(w.__contains__, b)) else 0)
    text_ = ",".join(sorted(items))
    return (len(w), len(hit), len(items), hashlib.sha256(text_.encode()).hexdigest(), bool(hit), most)


def test_against_brute_force(spark, monkeypatch):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(6)] + ["Été", "naïve", "b2"]
    bench = [(k, " ".join(random.choices(vocabulary, k=random.choice([0, 1, 3, 9, 10, 11, 30])))) for k in range(25)]
    bench += [(7, "x y z"), (99, None), (100, "q " * 12)]
    docs = []
    for k in range(60):
        t = random.choices(vocabulary + ["odd", "rare"], k=random.choice([0, 2, 12, 80]))
        src = words(random.choice(bench)[1])
        t += src[random.randrange(len(src) + 1) :] + ["end"] + src
        docs.append((k % 50, random.choice([" ", ", ", "\n"]).join(t).upper() if k % 3 else " ".join(t), "clash"))
    docs += [(1000, None, None), (1001, "", None), (1002, "q " * 200, None), (None, "x-y!z", None), (1002, "q " * 200, None)]
    df, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    want = [brute(t, bench) for _, t, _ in docs]
    assert [tuple(r)[1:] for r in op4_digest(df, b).collect()] == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    assert [tuple(r)[1:] for r in op4_digest(df, b).collect()] == want
    assert sorted(r.doc_id for r in decontaminate.decontaminated(df, b).collect() if r.doc_id is not None) == sorted(
        d for (d, _, _), w in zip(docs, want) if not w[4] and d is not None)


def test_empty_tables(spark):
    df, b = spark.createDataFrame([(1, "a b c", None)], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in op4_digest(df, b).collect()] == [(1, 3, 0, 0, decontaminate.empty_digest(), False, 0)]
    assert op4_digest(df.limit(0), b).collect() == []


def test_longest_matches_and_their_places(spark):
    rng = random.Random(3)
    item = [f"b{rng.randrange(900)}" for _ in range(60)]
    other = [f"c{k}" for k in range(30)]
    doc = ["x"] * 5 + item[10:35] + ["y"] + other[:12] + ["z"] * 3 + item[40:52] + other[:12]
    df = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(item[:9]))], "doc_id long, text string")
    b = spark.createDataFrame([("i", " ".join(item)), ("o", " ".join(other)), (None, "z Z z")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.matches(df, b).collect()}
    assert sorted((m.item or "", m.item_start, m.doc_start, m.words) for m in got[1].bench_matches) == [("", 0, 43, 3), ("i", 10, 5, 25), ("o", 0, 31, 12)]
    assert list(got[1].bench_items) == ["i", "o"] and list(got[2].bench_matches) == []


def test_packed_size():
    """What is sent: the vocabulary, and about 50 bytes a word."""
    import pickle

    rng = random.Random(5)
    items = [(k, " ".join(f"v{rng.randrange(20_000)}" for _ in range(500))) for k in range(200)]
    w = decontaminate.Windows(items, 10)
    arrays = [*w.low, w.length, w.first, w.item, w.place]
    assert len(w) == 200 * 491 and sum(a.nbytes for a in arrays) <= 60 * len(w)
    assert len(pickle.dumps(w)) <= 2 * sum(a.nbytes for a in arrays)
