"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and, but for the last, returns rows with the columns of ``documents``, whatever these
are: extra ones are carried along, also if their names are those that operators use inside.  For every stage: an empty table gives no
rows; very long texts are read whole; nulls in columns other than doc_id and text are carried along.  What each stage does with
null texts and ids, ties, repeated rows and unlabelled tables stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import language, packing, pii, simhash, substrings
from quillon.llm.common import Scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without letters (null and empty texts among them) and those whose words are sure of no
    language. Texts in several languages stay. In a table without labels nothing can be learnt: every text with letters stays. Rows
    are judged each on its own, so repeated ones alike and those without an id like any other."""
    return language.keep_known(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, once, also where that id's row is repeated (any one of its rows, which may
    differ in other columns). Rows without an id stay, since nothing can name them, and don't keep others from staying."""
    found = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id")
    kept = Scratch(spark, "near").keep(found)
    left = docs.join(kept.distinct(), "doc_id", "left_semi")
    if not kept.groupBy("doc_id").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id"])
    return left.select(docs.columns).union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document (of a lesser id), or the same one earlier, holds are cut; the first of equal passages stays. Documents
    of which nothing is left go. Texts that lose nothing, null ones among them, and rows without an id stay as they are."""
    return substrings.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind, as in [EMAIL]; where spans overlap the first one does. All rows stay; null texts stay null."""
    return pii.mask(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences: a row a piece. Null texts count as empty, a document that holds the separator only; ties go
    by (doc_id, start); repeated rows and rows without an id are packed each on its own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
