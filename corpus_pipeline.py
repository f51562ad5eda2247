"""A training corpus from `documents`: known languages, one of each group of near copies, no benchmark passages, no personal data, sources mixed to equal weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last adds copy and mix_order.

Edge cases: rows with a null, empty or letter-free text go in the first stage, if there are languages to learn from, and
otherwise no row does; a null doc_id, source or n_chars passes; rows that agree in doc_id and text are copies of each
other, of which one stays; a text that loses all its words to the benchmark goes; n_chars follows the text; an empty
table gives no rows; other columns pass, also those whose names an operator uses inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrie.llm import decontaminate, jaccard, langid, mixing, pii
from corrie.llm.common import Scratch, shield, table


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars as the text now has it (null for a null text)."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The language becomes the predicted one, whatever was marked; documents without a letter go. Without any marked language there is nothing to learn from, and all documents pass as they are."""
    model = langid.train(docs)
    if not model.langs:
        return docs
    docs, back = shield(docs, "text", "lang")
    found = langid.identify(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return back(found.withColumn("lang", F.col("lang_pred")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; texts that are half of them go."""
    return _sized(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _sized(pii.redact(docs, pii.train(docs)), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source has the same weight; documents are repeated or left out accordingly, in a global random order."""
    return mixing.replicate(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]

#: The language and personal data models are trained in numpy, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
