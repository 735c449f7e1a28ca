from __future__ import annotations

import random

import corpus_pipeline as cp
from plumbline.llm import bpe, decontaminate, linededup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "ro", "mi") for b in ("len", "sur", "bo") for c in ("", "te", "nas", "ing")]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n)).capitalize() + "."
    bench = [(k, prose(20)) for k in range(4)]
    rows, labels = [], []
    for k in range(300):
        bad = k % 5 == 0
        text = "\n".join(prose(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4)))
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(not bad), 0))
    passage = prose(60)
    rows += [(1000 + k, t, "en", "s0", len(t)) for k, t in enumerate([rows[1][1], prose(40) + "\n" + passage, prose(40) + "\n" + passage, bench[2][1], prose(30) + " " + bench[1][1]])]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return docs, bench


def test_stages(spark, tmp_path):
    docs, bench = corpus(spark, tmp_path)
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    first = cp.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    good = {k for k in range(300) if k % 5}
    assert good <= set(ids(first)) and not {k for k in range(300) if not k % 5} & set(ids(first))

    second = cp.STAGES[1][1](spark, docs, str(tmp_path)).cache()
    assert second.columns == docs.columns
    assert set(range(300)) <= set(ids(second)) and 1000 not in ids(second)
    text = {r.doc_id: r.text for r in second.collect()}
    assert text[1002].count("\n") == 0 and text[1001].count("\n") == 1 and text[2000] is None

    third = cp.STAGES[2][1](spark, docs, str(tmp_path))
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert ids(third) == sorted(d for d, c in near.items() if d == c) and 1000 not in ids(third)

    fourth = cp.STAGES[3][1](spark, docs, str(tmp_path))
    assert set(ids(docs)) - set(ids(fourth)) == {1003, 1004}

    last = cp.STAGES[4][1](spark, docs, str(tmp_path))
    assert ids(last) == ids(docs) and "ids" in last.columns


def test_run(spark, tmp_path):
    docs, bench = corpus(spark, tmp_path)
    step = docs
    for _, stage in cp.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), SCHEMA)
    merges = bpe.Encoder(bpe.Merges(bpe.tokenizer_file()))
    want = sorted((r.doc_id, merges.encode([r.text or ""])[0]) for r in step.collect())
    import numpy as np

    got = sorted((r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in cp.run(spark, str(tmp_path)).collect())
    assert got == want
    assert not any(decontaminate.words_of(r.text) and linededup.units(r.text) == [] for r in step.collect())


def test_empty_tables(spark, tmp_path):
    docs, _ = corpus(spark, tmp_path)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_one_row_of_each_id_stays(spark):
    rows = [(1, "a b c d e", None, None, 1), (1, "a b c d e", None, None, 1), (2, "a b c d e", "x", None, 1), (None, "a b c d e", None, None, 1)]
    got = simhash.without_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"]


def test_texts_of_blank_lines_alone_go(spark, tmp_path):
    text = "One paragraph that has some ten words in it here.\n\n \u2003\nAnother paragraph that has some ten words in it too.\n"
    rows = [(1, text, "en", "s", 9), (2, text, "en", "s", 9), (3, "\n\n", "en", "s", 2), (4, None, "en", "s", 0)]
    assert sorted(r.doc_id for r in cp.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()) == [1, 3, 4]
