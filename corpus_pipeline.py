"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage works on whatever its predecessor kept. All but the last return the columns of documents. Rows are told
apart by doc_id and text: rows that agree in both are one document and share its fate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common, decontamination, langid, linededup, neardup, packing

#: Documents whose best language is likelier than this are kept.
MIN_LANG_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that stands out, go."""
    held_out = common.remainder(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT
    found = langid.identify(docs, langid.train(docs.where(langid.learnable(held_out))))
    pred, score = found.columns[-2:]
    return found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= MIN_LANG_SCORE)).drop(pred, score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs are deleted; n_chars follows the text."""
    found = linededup.dedup_lines(docs)
    found = found.drop(found.columns[-1])
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are benchmark passages go."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("packing", pack),
]
#: No SQL expresses the language model or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return common.stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
