from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash

DOCS = "doc_id long, text string, lang string, fp string"


def plain(text):
    """The contract, word for word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(ids, fps, radius=4):
    label = dict(zip(ids, ids))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(ids[i]), root(ids[j])))
                label[b] = a
    return {x: root(x) for x in ids}


@pytest.mark.parametrize("text", ["", None, "  \t\n", "one", "One TWO three", "a b c d", "A\x0bb\x0cc d É É é  x", "x " * 3000, "a b c d e f g " * 90])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_index_against_all_pairs():
    rng = np.random.default_rng(5)
    for radius in (0, 2, 4):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        fps = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 6)).tolist())) for b in base for _ in range(12)]
        fps += [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]  # a dense cluster
        fps = sorted(set(fps))
        gray = sorted(fps, key=lambda x: x ^ x >> 1)
        a, b = simhash._group_links(np.array(gray, np.uint64), np.zeros(len(gray), np.int64), radius)
        want, got = closure(fps, fps, radius), closure(fps, fps, -1)
        label = dict(zip(a.tolist(), b.tolist()))
        classes = {}
        for x in got:
            classes.setdefault(label.get(x, x), set()).add(x)
        true = {}
        for x, r in want.items():
            true.setdefault(r, set()).add(x)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, true.values()))


def test_heavy_nodes_are_dealt_again(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for m in simhash.masks(4, 2):
        assert all(f & m == m for f in simhash.finer_masks(m, 4)) and len(simhash.finer_masks(m, 4)) == 5
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = closure(signed, fps)
    for most in (5, 10**6):
        from plumbline.operators.graph import components

        got = dict((r.a, r.b) for r in components(simhash.links(df, most=most)).collect())
        assert {f: got.get(f, f) for f in signed} == want


def test_near_duplicates_against_brute_force(spark):
    random.seed(3)
    rows = []
    for i in range(60):
        words = [f"w{random.randrange(400)}" for _ in range(random.choice([0, 2, 30, 300]))]
        for k in range(random.choice([1, 1, 4])):
            words = [w if random.random() > 0.004 else "zz" for w in words]
            rows.append((len(rows) * 7 % 1000, " ".join(words), None, "clash"))
    rows += [(5000, None, None, None), (5000, None, None, None), (None, "lone null id", "en", None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    known = [(r[0], plain(r[1])) for r in rows if r[0] is not None]
    want = closure([x for x, _ in known], [f for _, f in known])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert {r.doc_id: r.fingerprint for r in got if r.doc_id is not None} == {x: f"{f:016x}" for x, f in known}
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_one_row_of_each_component_stays(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    schema = "doc_id long, text string, _n string, stays boolean, n int"
    rows = [(4, a, "x", None, 1), (2, a, "y", None, 2), (7, b, "z", True, 3), (7, b, "z", True, 3), (None, a, None, None, 4), (None, a, None, None, 4),
            (9, None, "null", False, 5), (8, "", "empty", False, 6), (5, "clean text that nothing else is like", None, None, 7)]
    got = simhash.without_near_duplicates(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "_n", "stays", "n"]
    assert sorted(((r.doc_id or 0, r.text, r.n) for r in got.collect()), key=str) == sorted([(0, a, 4), (0, a, 4), (2, a, 2), (5, rows[8][1], 7), (7, b, 3), (8, "", 6)], key=str)
    assert simhash.without_near_duplicates(spark.createDataFrame([], schema)).collect() == []
