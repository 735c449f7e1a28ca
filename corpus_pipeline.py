"""A training corpus from raw documents, in five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, decontaminate, linededup, quality, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are judged as empty ones, repeated rows alike; of equally sure documents those with the
    smaller hash teach; without labels of both classes all stay; an empty table gives none.
    """
    return quality.kept(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from all texts but the first; documents of which nothing is left go.

    Earlier is by (id, place), so there are no ties; null and empty texts, and rows without an id, stay as they are;
    rows with one id aren't repeats of each other; an empty table gives none.
    """
    kept = linededup.deduplicated(docs, length_col="n_chars")
    return kept.where((F.col("units_removed") == 0) | F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null and empty texts are one group; rows of one id come down to one, the first by text; rows without an id stay;
    an empty table gives none.
    """
    return simhash.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a window of a benchmark item go.

    Null and wordless texts have none and stay, repeated rows share one fate; an empty table gives none, an empty
    benchmark takes none.
    """
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left.

    Null and empty texts have no ids, repeated rows equal ones; of pairs of one rank the leftmost is merged first; an
    empty table gives none.
    """
    return bpe.encoded(docs, bpe.tokenizer_file())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("bpe encoding", bpe_encoding),
]

#: Trained weights, hashes and merges have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.saved(docs, name.replace(" ", "-"))
    return docs
