"""How natural identifiers are, less natural ones, and words of questions that name a table and can be hidden."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import providers, text

#: Identifier and its tags to (class, confidence); an application may pass a trained model's.
Classifier = Callable[[str, str], tuple[str, float]]


def by_dictionary(dictionary: frozenset[str]) -> Classifier:
    """The offline classifier: N1 if all of an identifier's words are known, N2 if some are, else N3; the share is its confidence."""

    def classify(name: str, tags: str) -> tuple[str, float]:
        words = text.identifier_words(name, dictionary) or [name.lower()]
        known = sum(text.lemma(w) in dictionary or w in dictionary for w in words) / len(words)
        return ("N1", known) if known == 1 else ("N2", max(known, 1 - known)) if known > 0 else ("N3", 1.0)

    return classify


def classified(names: DataFrame, classify: Classifier, column: str = "name") -> DataFrame:
    """``names`` with ``naturalness`` and ``confidence``; equal identifiers are classified once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [classify(n, t) for n, t in zip(pdf["_n"], pdf["_t"])]
            yield pd.DataFrame({"_n": pdf["_n"], "naturalness": [a for a, _ in found], "confidence": [float(b) for _, b in found]})

    once = names.select(F.col(column).alias("_n")).where("_n is not null").distinct().withColumn("_t", text.character_tags(F.col("_n")))
    return names.join(once.mapInPandas(run, "_n string, naturalness string, confidence double"), F.col(column) == F.col("_n"), "left").drop("_n")


def decreased(names: DataFrame, make: Callable[[], providers.Completion] = providers.abbreviating) -> DataFrame:
    """``names`` (name, naturalness) with ``new_name``: N3 stays, others get the provider's abbreviation, each asked once."""
    asked = names.withColumn("_q", F.when(F.col("naturalness") != "N3", F.col("name")))
    return providers.completed(asked, "_q", "_a", make).withColumn("new_name", F.coalesce(F.when(F.col("_a") != "error", F.col("_a")), F.col("name"))).drop("_q", "_a")


def linker_words(question: str, table: str, literals: list[str], attributes: list[str], dictionary: frozenset[str] = frozenset()) -> list[dict]:
    """For each word of a table's name the places in a question where it is meant: by equal lemmas, or by equal consonants
    if the word is short.  Literals and attributes of the query don't count."""
    import re

    rest = text.without_database_terms(question, literals, attributes).lower()
    there = [(m[0], m.start()) for m in re.finditer(r"\w+", question) if m[0].lower() in set(re.findall(r"\w+", rest))]
    bones = lambda w: re.sub("[aeiou]", "", w.lower())
    out = []
    for segment in text.identifier_words(table, dictionary) or [table.lower()]:
        short = len(segment) <= 4 and segment not in dictionary
        same = [(w, at) for w, at in there if text.lemma(w) == text.lemma(segment) or short and len(w) > 1 and bones(segment) and bones(w).startswith(bones(segment))]
        out.append({"segment": segment, "is_abbreviation": short, "matched_tokens": [{"token": w, "position": at} for w, at in same]})
    return out


COMPONENTS = "array<struct<segment:string,is_abbreviation:boolean,matched_tokens:array<struct<token:string,position:int>>>>"


def linked(queries: DataFrame, dictionary: frozenset[str] = frozenset()) -> DataFrame:
    """``queries`` (question_id, question, central_table, literals, attributes) that name their central table, with ``components``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [linker_words(r.question or "", r.central_table or "", list(r.literals), list(r.attributes), dictionary) for r in pdf.itertuples()]
            yield pdf[["question_id"]].assign(components=found)

    rows = queries.select("question_id", "question", "central_table", "literals", "attributes").mapInPandas(run, f"question_id int, components {COMPONENTS}")
    hit = F.exists("components", lambda c: F.size(c["matched_tokens"]) > 0)
    return queries.join(rows.where(hit), "question_id")


def hidden(question: str, components: list[dict], synonyms: dict[str, str]) -> str:
    """A question with its linker words replaced by synonyms, each at its place."""
    changes = {m["position"]: synonyms.get(m["token"].lower(), "item") for c in components for m in c["matched_tokens"]}
    return text.replaced_at(question, sorted(changes.items()))


#: What a model is asked for to hide a table's words in a question; an application may pass its own.
HIDING = {
    "back_translation": "Translate this question to French and back to English, so that its wording changes: {question}",
    "contextual": "Rewrite this question so that it keeps its meaning without the words {words}: {question}",
}


def hidden_by(queries: DataFrame, method: str, make: Callable[[], providers.Completion] | None = None, synonyms: dict[str, str] | None = None) -> DataFrame:
    """``queries`` as ``linked`` gives them, with ``hidden_question`` and its ``score``: by ``synonym`` in place, or by a model's answer
    to one of HIDING.  A failed answer leaves the question as it is."""
    words = F.array_distinct(F.flatten(F.transform("components", lambda c: F.transform(c["matched_tokens"], lambda t: F.lower(t["token"])))))
    rows = queries.withColumn("_words", words)
    if method == "synonym":
        known = dict(synonyms or {})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                done = [hidden(q, [{"matched_tokens": [{"token": t["token"], "position": int(t["position"])} for t in c["matched_tokens"]]} for c in cs], known) for q, cs in zip(pdf["question"], pdf["components"])]
                yield pd.DataFrame({"question_id": pdf["question_id"], "hidden_question": done})

        made = rows.select("question_id", "question", "components").mapInPandas(run, "question_id int, hidden_question string")
        rows = rows.join(made, "question_id")
    else:
        ask = F.replace(F.replace(F.lit(HIDING[method]), F.lit("{question}"), F.col("question")), F.lit("{words}"), F.array_join("_words", ", "))
        rows = providers.completed(rows.withColumn("_ask", ask), "_ask", "_answer", make)
        rows = rows.withColumn("hidden_question", F.when(F.col("_answer") == "error", F.col("question")).otherwise(F.col("_answer"))).drop("_ask", "_answer")
    return rows.withColumn("score", text.component_score(F.col("question"), F.col("hidden_question"), F.col("_words"))).drop("_words")


def hiding_run(queries: DataFrame, shares: DataFrame, features: list[str], targets: list[tuple[str, int]], method: str, **options) -> DataFrame:
    """Databases clustered by some shares, those of the largest cluster put into splits in turn until each has its queries, and
    the questions of every split hidden and scored: ``queries`` (db_id, ...) with ``cluster``, ``split``, ``hidden_question`` and ``score``."""
    from plumbline.operators import sampling

    found = sampling.clusters(shares, "db_id", features)
    sizes = queries.join(found.where("largest").select("db_id"), "db_id", "left_semi").groupBy(F.col("db_id").alias("key")).agg(F.count("*").alias("n"))
    splits = sampling.prefix_split(sizes, targets).select(F.col("key").alias("db_id"), "split")
    rows = queries.join(found.select("db_id", "cluster"), "db_id").join(splits, "db_id", "left")
    return hidden_by(rows.withColumn("split", F.coalesce("split", F.lit("train"))), method, **options)


REWRITING = ('Schema: {schema}\nQuestion: {question}\nEvidence: {evidence}\nRewrite both so that they use the words of the schema. '
             'Answer in JSON: {"question": "...", "evidence": "..."}')


def rewritten_questions(queries: DataFrame, make: Callable[[], providers.Completion], request: str = REWRITING) -> DataFrame:
    """``queries`` (question, evidence, schema) with ``new_question``, ``new_evidence`` and ``status``: a model's answer in JSON, or, where that
    fails or can't be read, the original.  What is done already is left out by ``sinks.pending`` before."""
    prompt = F.lit(request)
    for name in ("schema", "question", "evidence"):
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(name, F.lit("")))
    rows = providers.completed(queries.withColumn("_ask", prompt), "_ask", "_answer", make)
    read = F.from_json(text.without_fences(F.col("_answer")), "question string, evidence string")
    status = F.when(F.col("_answer") == "error", "error").when(read["question"].isNull(), "malformed").otherwise("ok")
    return rows.withColumn("status", status).withColumns({
        "new_question": F.when(F.col("status") == "ok", read["question"]).otherwise(F.col("question")),
        "new_evidence": F.when(F.col("status") == "ok", F.coalesce(read["evidence"], "evidence")).otherwise(F.col("evidence"))}).drop("_ask", "_answer")
