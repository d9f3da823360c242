"""A corpus from raw documents: reject toxic ones, keep one of each group of near copies, cut repeated passages, mix the
sources to target weights, pack sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written and read again as the next one's ``docs``. All but
the last return the columns of ``docs``. Toxicity is learned from ``labels`` of the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.columns import read
from panelkit.llm.jaccard import keep_one_of_each
from panelkit.llm.mixing import mix_documents
from panelkit.llm.packing import pack
from panelkit.llm.substrings import dedup_substrings
from panelkit.llm.toxicity import drop_toxic
from panelkit.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores under 0.5. Labels are learned from the documents as they were read."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: that of the smallest id. Near copies share 80 hundredths
    of their shingles of five words at least."""
    return keep_one_of_each(docs, size=5, least=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of 50-word windows that start in an earlier one too; ``n_chars``, where there is
    such a column, counts what is left."""
    cut = dedup_substrings(docs)
    removed = cut.columns[-1]
    columns = [
        F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return cut.select(*columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2,048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("source mix", source_mix),
    ("best-fit packing", packing),
]

#: SQL cannot express the first stage; tests hold the others against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
