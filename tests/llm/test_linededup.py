from __future__ import annotations

import random

import numpy as np
import xxhash

from plumbline.llm import linededup as ld

SCHEMA = "doc_id long, text string, n_chars long, units_removed string"


def brute(rows):
    """The rule by its definition, over plain lists."""
    texts = {}
    for d, t in rows:
        if d is not None:
            texts.setdefault(d, ld.units(t))
    h = {d: [xxhash.xxh64_intdigest(u) for _, u, _ in us] for d, us in texts.items()}
    picked = {}
    for d, us in texts.items():
        own = set()
        for i in range(len(us)):
            j, n = i, 0
            while j < len(us) and n < ld.MIN_WORDS:
                n += us[j][2]
                j += 1
            if n >= ld.MIN_WORDS:
                own.add(min(range(i, j), key=lambda k: (h[d][k], -k)))
        picked[d] = own
    first = {}
    for d in sorted(texts):
        for p in sorted(picked[d]):
            first.setdefault(h[d][p], (d, p))
    gone = {}
    for d, us in texts.items():
        drop = set()
        for p in picked[d]:
            e, q = first[h[d][p]]
            if (e, q) == (d, p):
                continue
            a = b = n = 0
            while n < ld.MIN_WORDS and p - a - 1 >= 0 and q - a - 1 >= 0 and h[d][p - a - 1] == h[e][q - a - 1]:
                a += 1
                n += us[p - a][2]
            n = 0
            while n < ld.MIN_WORDS and p + b + 1 < len(us) and q + b + 1 < len(h[e]) and h[d][p + b + 1] == h[e][q + b + 1]:
                b += 1
                n += us[p + b][2]
            if sum(us[k][2] for k in range(p - a, p + b + 1)) >= ld.MIN_WORDS:
                drop.update(range(p - a, p + b + 1))
        gone[d] = drop
    return texts, gone


def made(seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3, 9, 14]))) + rng.choice([".", "!", "?"])
    passages = [[sentence() for _ in range(rng.choice([1, 3, 12]))] for _ in range(12)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randrange(6)):
            parts += rng.choice(passages) if rng.random() < 0.4 else [sentence() for _ in range(3)]
        rows.append((d, "".join(p + rng.choice([" ", "\n", "\n\n"]) for p in parts)))
    return rows


def test_against_brute_force(spark):
    rows = made(1)
    got = {r.doc_id: r for r in ld.deduplicated(spark.createDataFrame([(d, t, len(t), "x") for d, t in rows], SCHEMA), length_col="n_chars").collect()}
    texts, gone = brute(rows)
    assert sum(map(len, gone.values())) > 50
    for d, t in rows:
        assert got[d].units_removed == len(gone[d]), d
        assert [u for _, u, _ in ld.units(got[d].text)] == [u for k, (_, u, _) in enumerate(texts[d]) if k not in gone[d]]
        assert got[d].text == t or got[d].n_chars == len(got[d].text)


def test_selection_is_a_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(50):
        shared = rng.integers(0, 2**63, 6, dtype=np.uint64)
        words = rng.integers(1, 5, 6)
        if words.sum() < ld.MIN_WORDS:
            continue
        picks = []
        for _ in range(2):
            a, b = rng.integers(0, 2**63, 5, dtype=np.uint64), rng.integers(0, 2**63, 5, dtype=np.uint64)
            h, w = np.r_[a, shared, b], np.r_[rng.integers(1, 9, 5), words, rng.integers(1, 9, 5)]
            picks.append({int(h[k]) for k in ld.select(h, *ld.windows(w, np.zeros(len(h), int)))} & set(shared.tolist()))
        assert picks[0] & picks[1]


def test_long_passages_go_and_clean_texts_stay(spark):
    passage = " ".join(f"p{k}" + "." * (k % 9 == 8) for k in range(60)) + "."
    rows = [(0, f"clean one here.\n{passage}\nend.", 1, None), (1, "only clean words in this line, nothing else at all to see.", 2, None),
            (2, f"other start. {passage} other end.", 3, None), (3, None, None, None), (4, "", 0, None), (None, passage, 5, None), (2, f"other start. {passage} other end.", 3, None),
            (5, f"{passage}\n{passage}", 9, None), (6, "no. no. no. no. no. no. no. no. no. no.", 1, None), (7, "line\n" * 3000 + "x " * 200_000, 1, None)]
    got = ld.deduplicated(spark.createDataFrame(rows, SCHEMA), length_col="n_chars").collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(rows)
    for d in (0, 1, 3, 4, None):
        assert text[d] == next(t for k, t, _, _ in rows if k == d)
    assert text[2] == "other start. other end." and [r.units_removed for r in got if r.doc_id == 2] == [7, 7]
    assert text[5] == ""
    assert text[6].startswith("no.")


def test_empty_table(spark):
    assert ld.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def every_run(rows):
    """Units of each text that lie in a run of MIN_WORDS words which occurs earlier, compared with all that comes before."""
    texts, seen, gone = {d: ld.units(t) for d, t in rows}, set(), {}
    for d in sorted(texts):
        us, gone[d] = texts[d], set()
        for i in range(len(us)):
            n = 0
            for j in range(i, len(us)):
                n += us[j][2]
                run = tuple(u for _, u, _ in us[i : j + 1])
                if n >= ld.MIN_WORDS and run in seen:
                    gone[d].update(range(i, j + 1))
                seen.add(run)
    return texts, gone


def test_all_earlier_occurrences_count(spark):
    rng = random.Random(8)
    short = [f"{a} {b}." for a in ("yes", "no", "so") for b in ("it", "we", "all", "go")]
    rows = [(k, f"Alone in text {k}. {s}") for k, s in enumerate(short)]  # each first in a text that shares nothing else
    long = [" ".join(f"w{rng.randrange(40)}" for _ in range(9)) + "." for _ in range(6)]
    for k in range(60):
        rows.append((100 + k, "\n".join(" ".join(rng.choice(short if rng.random() < 0.8 else long) for _ in range(rng.randrange(1, 7))) for _ in range(4))))
    texts, gone = every_run(rows)
    assert sum(map(len, gone.values())) > 300
    got = ld.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert r.units_removed == len(gone[r.doc_id]), r.doc_id
        assert [u for _, u, _ in ld.units(r.text)] == [u for k, (_, u, _) in enumerate(texts[r.doc_id]) if k not in gone[r.doc_id]]


def test_columns_of_any_name_and_rows_that_share_an_id(spark):
    run = "a run of some ten words that comes up again."
    rows = [(1, f"{run}\nfirst tail.", "p", 1, "r", 0), (5, f"{run}\nmiddle one here.", "q", 2, None, 0), (5, f"{run}\nsomething else entirely, told under the same id.", "s", 3, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _runs int, id string, words_removed int")
    got = {r._runs: r for r in ld.deduplicated(df).collect()}
    assert [got[k]._id for k in (1, 2, 3)] == ["p", "q", "s"]
    assert [got[k].text for k in (1, 2, 3)] == [rows[0][1], "middle one here.", "something else entirely, told under the same id."]


def test_only_selected_units_are_rows_and_hashes_have_two_halves(spark):
    rows = made(5)
    got = ld.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    n_units, told = 0, {(r.id, r.pos): r for r in got}
    for d, t in rows:
        us = ld.units(t)
        n_units += len(us)
        h = ld._hashes([u for _, u, _ in us])
        want = {}
        for i in range(len(us)):
            for j in range(i, len(us)):
                n = [sum(w for _, _, w in us[a : b + 1]) for a, b in ((i, j), (i, j - 1), (i + 1, j))]
                if n[0] >= ld.MIN_WORDS and min(n[1:]) < ld.MIN_WORDS:
                    p = min(range(i, j + 1), key=lambda k: (int(h[k, 0]), -k))
                    want.setdefault(p, set()).add((i, j - i + 1))
        assert {p for e, p in told if e == d} == set(want)
        for p, ws in want.items():
            assert told[d, p].h % (1 << 64) == int(h[p, 0]) and {(p - w.back, w.size) for w in told[d, p].windows} == ws
            for w in told[d, p].windows:
                assert (w.key is None) == (w.size == 1)
                assert w.size > 1 or w.check % (1 << 64) == int(h[p, 1])
    assert 0 < len(got) < n_units and len(got) < sum(len(r.windows) for r in got)


def test_matches_extend_on_a_diagonal():
    matches = np.array([(4, 2, 1, 14), (2, 2, 1, 12), (3, 1, 1, 20), (9, 3, 1, 19), (5, 4, 1, 15), (6, 1, 2, 16)], np.int64).T
    assert sorted(zip(*(x.tolist() for x in ld.extended(*matches)))) == [(2, 12), (3, 4), (6, 7)]
    assert [len(x) for x in ld.extended(*matches[:, :0])] == [0, 0]


def test_windows_of_one_half_alike_are_not_equal():
    import pyarrow as pa

    text = "one two three four five six seven eight nine."
    (a, b), = ld._hashes([text]).astype(np.int64).tolist()
    match = {"pos": 0, "size": 1, "key": a, "check": b, "from_id": 0, "from_pos": 0}
    told = pa.array([[match], [match | {"check": b ^ 1}], [match | {"pos": 1}], None, [match, match]])
    assert ld.removed([text] * 4 + [f"{text}\nend."], told) == [("", 1, 9), (text, 0, 0), (text, 0, 0), (text, 0, 0), ("end.", 1, 9)]
    assert ld.removed([None, text], told[:2]) == [(None, 0, 0), (text, 0, 0)]
    assert ld.removed([], told[:0]) == []


def test_sql_beside_it(spark):
    import duckdb

    odd = [(1000, None), (1001, ""), (1002, "\n\n. . ."), (1003, "a\u00a0b\u2003c d e f g h.  i! j?"), (1004, "x a\u00a0b c\u3000d e f g h. tail"), (1005, "a b c d e f g h.  i! j?\r\n"), (1006, "a b c d e f g h.\n\ni! j?")]
    df = spark.createDataFrame(made(9) + odd, "doc_id long, text string")
    documents = df.toArrow()  # noqa: F841  read by name
    want = {r[0]: r for r in duckdb.sql(ld.sql()).fetchall()}
    got = ld.deduplicated(df).collect()
    assert sum(r.units_removed for r in got) > 50 and want[1005][2] and want[1006][2]
    for r in got:
        assert (r.doc_id, r.text, r.units_removed, r.words_removed) == want[r.doc_id]
