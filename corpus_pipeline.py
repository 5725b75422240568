"""A corpus pipeline of five stages over ``documents``.

Every stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertape.llm import decontam, langid, packing, simhash, substring_dedup
from ordertape.llm.common import crc_of_id, table
from ordertape.llm.queries import tokenizer_path
from ordertape.plans import stage


#: A text of at least so many characters that is less like every learned language than this cosine is in none of them.
JUDGED_CHARS, LEAST_LIKENESS = 300, 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.

    Undetermined ones (no letter, no text) go, and so do texts that are long enough to tell and resemble no
    language (one word repeated throughout, for instance). Null ids and empty tables pass like any others.
    """
    profiles = langid.train(docs, F.pmod(crc_of_id("doc_id"), F.lit(4)) != 2)
    judged = langid.predict(docs, profiles, lang_out="__lang", score_out="__score")
    told = (F.col("__lang") != langid.UNDETERMINED) & ((F.length("text") < JUDGED_CHARS) | (F.col("__score") >= LEAST_LIKENESS))
    return judged.where(told).drop("__lang", "__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, the one with the smallest id; texts without a word are one class, rows without an id stay."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; no document goes, a null text stays null."""
    return substring_dedup.clean(docs, chars_col="n_chars")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item; an empty benchmark keeps all."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences; a null text is a piece of the end id alone."""
    return packing.pack(packing.pieces(docs, tokenizer_path())).drop("copy")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Fingerprints, trained profiles, tokenizer ids and the packing search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage.save(docs, name)
    return docs
