"""Cutting, plain forms and relatedness against small cases worked by hand."""

from __future__ import annotations

import pytest

from plumbline.operators import words


def test_joined_words_come_apart(spark):
    texts = spark.createDataFrame([("the customer table has the order date and the ship date of each customer",), ("Order the TABLE, order it!",), (None,), ("",)], "t string")
    v = words.vocabulary(texts, "t")
    assert {r.word: r.n for r in v.collect()}["order"] == 3
    names = spark.createDataFrame([(n,) for n in ("customertable", "orderdate", "shipdate", "thetable", "xq", "datex", "customertable", "", None, "a_b", "thethe" * 20)], "n string")
    got = {r.name: " ".join(r.words) for r in words.segmented(names, "n", v).collect()}
    assert got == {"customertable": "customer table", "orderdate": "order date", "shipdate": "ship date", "thetable": "the table", "xq": "x q", "datex": "date x", "thethe" * 20: "the the " * 19 + "the the"}
    assert words.segmented(names, "n", v.limit(0)).collect() == [] and words.segmented(names.limit(0), "n", v).collect() == []


def test_most_joined_pairs_come_back(spark):
    from plumbline.plans.queries import QUERIES

    rows = QUERIES["joined_words_cut"](spark, "/root/testdata/sf0.001").collect()
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    import re

    said = {}
    for r in turns:
        w = re.findall("[a-z]+", r.text.lower())
        for a, b in zip(w, w[1:]):
            said.setdefault(a + b, set()).add(f"{a} {b}")
    assert {r.name for r in rows} == set(said) and sum(r.words in said[r.name] for r in rows) / len(rows) >= 0.9


def test_plain_forms(spark):
    v = spark.createDataFrame([(w, 1) for w in ("parties", "party", "class", "classes", "making", "make", "walked", "walk", "boxes", "box", "bus", "buses", "is", "sing", "dogs")], "word string, n long")
    got = {r.word: r.lemma for r in words.lemmas(v).collect()}
    assert got == {"parties": "party", "party": "party", "class": "class", "classes": "class", "making": "make", "make": "make", "walked": "walk", "walk": "walk", "boxes": "box", "box": "box", "bus": "bus", "buses": "bus",
                   "is": "is", "sing": "sing", "dogs": "dogs"}


def test_relatedness(spark):
    edges = [("animal", "thing"), ("dog", "animal"), ("cat", "animal"), ("puppy", "dog"), ("rock", "thing"), ("star", None)]
    tree = spark.createDataFrame(edges, "child string, parent string")
    assert {r.node: r.path for r in words.paths(tree).collect()}["puppy"] == ["thing", "animal", "dog", "puppy"]
    senses = spark.createDataFrame([("dog", "dog"), ("puppy", "puppy"), ("cat", "cat"), ("cat", "star"), ("rock", "rock"), ("star", "star")], "word string, node string")
    pairs = spark.createDataFrame([("dog", "cat"), ("dog", "puppy"), ("puppy", "rock"), ("dog", "dog"), ("star", "cat"), ("star", "rock"), ("dog", "unknown")], "a string, b string")
    got = {(r.a, r.b): r.score for r in words.relatedness(pairs, senses, tree).collect()}
    assert got == {("dog", "cat"): 2 * 2 / 6, ("dog", "puppy"): 2 * 3 / 7, ("puppy", "rock"): 2 / 6, ("dog", "dog"): 1.0, ("star", "cat"): 1.0, ("star", "rock"): 0.0, ("dog", "unknown"): None}
    with pytest.raises(ValueError):
        words.paths(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))
    deep = words.paths(spark.createDataFrame([(k + 1, k) for k in range(60)], "child int, parent int"))
    assert max(len(r.path) for r in deep.collect()) == 61
