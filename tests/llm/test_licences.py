from __future__ import annotations

import random
from collections import Counter

from plumbline.llm import licences as lc


def brute(text, threshold=lc.THRESHOLD):
    t = text or ""
    import re

    flat = re.sub("[^A-Za-z0-9\n]+", " ", t)
    units = {lc.normalised(u) for u in [t, *re.split("\n *\n", flat), *t.split("\n")]}
    out = []
    for u in units:
        a = Counter(zip(u.split(" "), u.split(" ")[1:]))
        for name, x in lc.TEMPLATES.items():
            w = lc.normalised(x).split(" ")
            b = Counter(zip(w, w[1:]))
            if a and (d := 2 * (a & b).total() / (a.total() + b.total())) >= threshold:
                out.append((d, name))
    return (len(out), ",".join(sorted({n for _, n in out})), max(out)[1] if out else None, max(out)[0] if out else None)


def test_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "\n\n", "word", "All rights reserved.", "all RIGHTS, reserved\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", "é All rights reserved",
             "rights rights reserved reserved", "x " * 100_000 + "\nAll rights reserved."]
    for t in lc.TEMPLATES.values():
        words = t.split(" ")
        for rate in (0.0, 0.03, 0.08, 0.2):
            w = [x if rng.random() > rate else rng.choice(["the", "foo", "", x + " " + x]) for x in words]
            texts.append(" ".join(w))
            texts.append("A title line\n \n" + "".join(x + rng.choice([" ", " ", "\n"]) for x in w) + "\n\nAnd some prose after it.")
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, best string")
    got = lc.scanned(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    for t, r in zip([*texts, None], got.collect()):
        assert tuple(r)[1:] == brute(t), t and t[:80]
    assert lc.scanned(df.limit(0)).collect() == []


def test_licences_of_several_paragraphs_and_in_lines(spark):
    mit, prose = lc.TEMPLATES["mit"], "Some other words that go on for a while here. " * 40
    a, b = mit.index("The above copyright"), mit.index("THE SOFTWARE IS PROVIDED")
    parts = [mit[:a].strip(), mit[a:b].strip(), mit[b:]]
    code = "\n".join("# " + line for line in "\n\n".join(parts).split("\n"))
    rows = [prose + "\n\n" + "\n\n".join(parts) + "\n\n" + prose, f"# title of it\n#\n{code}\n\nimport os\n" + "print(os.name, 1)\n" * 90,
            "Copyright 2024 X Y Z and all of the others. All rights reserved. More of it.", prose + parts[0] + "\n\n" + prose]
    got = lc.scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert [(r.n_matches, r.licences) for r in got] == [(1, "mit"), (1, "mit"), (1, "all-rights-reserved"), (0, "")]
    assert got[0].best_dice > 0.99 and got[1].best_dice > 0.95 and got[2].best_dice == 1.0
    assert brute(rows[0])[0] == brute(rows[1])[0] == brute(rows[2])[0] == 0  # no line, paragraph or whole text is near enough


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "a", 2, "c")], "doc_id long, text string, _plain string, _units int, _text string")
    got = lc.with_matches(df, "text", "found").collect()[0]
    assert (got._plain, got._units, got._text, [m.name for m in got.found]) == ("a", 2, "c", ["mit-notice"])


def best_runs(text):
    """The best coefficient of each template over all runs of sentences."""
    import re

    parts = [w for u in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n[^A-Za-z0-9\n]*\n", text) if (w := lc.normalised(u))]
    out = {}
    for t in lc.templates():
        words = lc.normalised(lc.TEMPLATES[t.name]).split(" ")
        b = Counter(zip(words, words[1:]))
        for i in range(len(parts)):
            run = []
            for j in range(i, len(parts)):
                run += parts[j].split(" ")
                if len(run) - 1 > t.most:
                    break
                a = Counter(zip(run, run[1:]))
                if a and (d := 2 * (a & b).total() / (a.total() + b.total())) >= lc.THRESHOLD:
                    out[t.name] = max(d, out.get(t.name, 0))
    return out


def run_texts():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "or", "this", "software", "in", "words", "that", "go", "on", "all", "copy.", "to.", "here."]) for _ in range(n)) + "."
    out = []
    for t in lc.TEMPLATES.values():
        for rate in (0.0, 0.06, 0.12):
            w = [x if rng.random() > rate else rng.choice(["the", "foo.", x + " " + x]) for x in t.replace(", ", rng.choice([". ", ", ", "!\n"])).split(" ")]
            out.append(f"{prose(30)} {' '.join(w)}. {prose(30)}\n -- \n{' '.join(w[: len(w) // 2])}\n{prose(9)}")
    return out


def test_runs_of_sentences_against_brute_force(spark):
    texts = run_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hit = 0
    for r in lc.with_matches(df, "text", "m").collect():
        want, got = best_runs(r.text), {m.name: m.dice for m in r.m}
        assert set(want) <= set(got)
        for name, d in want.items():  # a template that a unit reaches has the units' coefficients
            hit += d == got[name]
        assert all(name in want for name in got if brute(r.text)[0] == 0)
    assert hit > 25


def test_sql_finds_runs_too(spark):
    import duckdb

    df = spark.createDataFrame([*enumerate([*run_texts(), "", "...", "All. Rights. Reserved", "Word? All rights\n-\nreserved here."]), (99, None)], "doc_id long, text string")
    documents = df.toArrow()  # noqa: F841  read by name
    want = {r[0]: r for r in duckdb.sql(lc.sql()).fetchall()}
    got = lc.scanned(df).collect()
    assert sum(r.n_matches for r in got) > 30
    for r in got:
        assert tuple(r) == want[r.doc_id], r.doc_id


def test_a_long_text_with_a_split_licence(spark):
    words = [f"{w}{'.' if k % 11 == 10 else ''}" for k, w in enumerate(random.Random(2).choices(["the", "of", "software", "and", "or", "some", "copies", "to", "use", "other"], k=200_000))]
    text = " ".join(words[:100_000]) + ". " + lc.TEMPLATES["mit"].replace(", ", ". ") + " " + " ".join(words[100_000:])
    got = lc.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got[0].licences == "mit" and got[0].best_dice > 0.95
