"""Language models behind one contract, called per batch on the executors, and deterministic stand-ins.

No model is part of this package: the stand-ins follow rules, so that what uses them runs and can be
tested anywhere; their results don't compare with a model's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prompts to answers, one for each.
Completion = Callable[[list[str]], list[str]]


def completed(df: DataFrame, prompt: str, answer: str, make: Callable[[], Completion]) -> DataFrame:
    """``df`` with a column of answers.  Equal prompts are asked once; ``make`` opens a client in each task.

    A prompt whose call raises gets the answer ``error``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            try:
                out = ask(pdf["_p"].tolist())
            except Exception:  # a service's failure is a value here
                out = ["error"] * len(pdf)
            yield pdf.assign(_a=out)

    asked = df.select(F.col(prompt).alias("_p")).where("_p is not null").distinct().mapInPandas(run, "_p string, _a string")
    return df.join(asked.withColumnRenamed("_a", answer), F.col(prompt) == F.col("_p"), "left").drop("_p")


def abbreviation(word: str) -> str:
    """The stand-in's abbreviation: the first letter, and the next consonants, three in all."""
    low = word.lower()
    return (low[:1] + re.sub("[aeiou]", "", low[1:]))[:3]


def abbreviated(name: str) -> str:
    """An identifier with each of its words abbreviated."""
    return re.sub("[A-Za-z]+", lambda m: abbreviation(m[0]), name)


def abbreviating() -> Completion:
    return lambda prompts: [abbreviated(p) for p in prompts]


def replacing(synonyms: dict[str, str]) -> Callable[[], Completion]:
    """A stand-in that replaces words by their synonyms."""
    return lambda: lambda prompts: [re.sub(r"\w+", lambda m: synonyms.get(m[0].lower(), m[0]), p) for p in prompts]
