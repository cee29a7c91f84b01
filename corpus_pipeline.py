"""A corpus pipeline over the table documents: five stages, each written as Parquet and read again by the next.

Language ID and the quality classifier drop what they reject, exact dedup and the n-gram Jaccard join leave one document of each group of
copies, and best-fit packing says where the pieces of what is left go. All stages but the last return the columns of documents. Documents with
null text have no language and go at the first stage; repeated rows are cut to one by the third.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import exact_dedup, jaccard_join, language_id, packing, quality
from pixelloom.llm.common import free_name, remove, scratch, shared_dir
from pixelloom.llm.queries import table, tokenizer_path


def _judged(docs: DataFrame, judge, *names: str) -> DataFrame:
    """The rows of docs, all columns, that a classifier doesn't reject. Its columns have names that docs hasn't, so columns of documents are never
    replaced; the text stays, and is read from the column that stays, as a copy would double the batches."""
    own = tuple(free_name(docs.columns, n) for n in names)
    return judge(docs, own).where(~F.col(own[-1])).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learnt from the lang of a bounded sample of the stage's input. If no row has text and lang, nothing
    can be learnt and all rows stay."""
    model = language_id.train(docs)
    return _judged(docs, lambda df, names: language_id.identify(df, model, "text", names, stays=True), "lang_pred", "lang_score", "rejected") if model.languages else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score isn't below the threshold; learnt from all documents that labels covers. If no label or only labels of one
    kind cover documents, all rows stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _judged(docs, lambda df, names: quality.score(df, model, "text", names, stays=True), "quality_score", "rejected") if model.weights.any() else docs


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the largest doc_id, of those whose texts are equal after lower-casing A-Z; null texts are empty ones."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group connected by a Jaccard similarity of 0.8 or more of five-word shingles. Documents
    without words, and rows without doc_id, stay."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among sequences of 4096 tokens."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path(), tokens=4096)


STAGES = [("language_id", language), ("quality", good_quality), ("exact_dedup", exact), ("jaccard_join", near), ("packing", packed)]

#: SQL can't express the classifiers and the tokenizer; tests/llm/test_llm_queries.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again. What a stage stored on the way goes when its result is
    written, and that result when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(at), at
    return docs
