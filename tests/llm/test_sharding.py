from __future__ import annotations

from collections import Counter

import pytest

from plumbline.llm import sharding


def test_table_follows_the_rule():
    names, slots = ["a", "b", "c"], 101
    table = sharding.lookup_table(names, slots)
    orders = []
    for n in names:
        o, s = sharding._number(n, 0) % slots, sharding._number(n, 8) % (slots - 1) + 1
        orders.append([(o + j * s) % slots for j in range(slots)])
    want = {}
    while len(want) < slots:
        for i, order in enumerate(orders):
            free = [c for c in order if c not in want]
            if free:
                want[free[0]] = i
    assert table == [want[c] for c in range(slots)]
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1


def test_removing_a_shard_moves_little():
    names = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.1 * len(a)


@pytest.mark.parametrize("bad", [([], 101), (["a", "a"], 101), (["a"], 100)])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        sharding.lookup_table(*bad)


def test_place(spark):
    df = spark.createDataFrame([(1, "x", "old"), (1, "y", "old"), (None, None, None)], "k long, t string, shard string")
    rows = sharding.place(df, "k", ["p", "q"]).collect()
    assert rows[0].shard == rows[1].shard and {r.shard for r in rows} <= {"p", "q"}
    assert sharding.place(df.limit(0), "k", ["p"]).collect() == []
    assert "Exchange" not in sharding.place(df, "k", ["p"])._jdf.queryExecution().executedPlan().toString()


def test_written_shards_and_very_long_texts(spark, tmp_path):
    rows = [(k, "x" * (300_000 if k == 3 else k), "clash") for k in range(60)] + [(None, None, None), (7, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    names = ["a", "b", "c"]
    sharding.write_shards(df, "doc_id", names, f"{tmp_path}/shards", 2)
    got = spark.read.parquet(f"{tmp_path}/shards").select("doc_id", "text", "shard").collect()
    want = sharding.place(df, "doc_id", names).select("doc_id", "text", "shard").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 62
