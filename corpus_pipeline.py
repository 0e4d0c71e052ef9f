"""A corpus from raw documents to packed sequences: language ID, exact dedup, near dedup, mixing, packing.

Every stage works on all that the one before it kept. Stages before the last return the columns of ``documents``, and others that
the input has. Null and empty texts have no language and go in the first stage, as do texts without a letter and those whose
n-grams no labelled language has; repeated rows of a document leave one, by exact dedup; a null doc_id or source is kept like others;
an empty table gives an empty result. The operators' docstrings say the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, histogram_packing, lang_id, minhash_dedup, mixing
from millrace.llm.bpe import tokenizer_path
from millrace.llm.store import Tables

#: Documents with a lower language score share next to nothing with any language learned.
LEAST_LANGUAGE_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in no language that the labelled ones are in."""
    judged = lang_id.identify(docs, F.lit(True), keep=tuple(docs.columns))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.exact_dedup_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays."""
    return minhash_dedup.near_dedup_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes their sources to the target weights; ``packed`` numbers the sequences along it."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences, which follow the mixed order.

    Files keep no order and stages hand on the columns of ``documents`` only, so the mix is made again from the same rows.
    """
    return histogram_packing.pack_mixed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: The language classifier, the MinHash candidates and the tokenizer can't be said in SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; what each stage returns is written in the shared folder for the next, and what it
    read goes then."""
    tables, docs = Tables(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = tables.write(stage(spark, docs, sf_dir), name)
        tables.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
