"""Corpus preparation: language ID, exact dedup, near dedup, source mixing, BPE encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the encoded rows. Tables with null or clashing extra columns, empty tables and
repeated rows pass through: stages read only ``doc_id``, ``text``, ``lang`` and ``source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, exact_dedup, langid, mixing, ngram_join
from loam.llm.common import clear_stored, crc_mod, stored, table, written
from loam.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some language: null texts and those without a letter go.

    The model learns from the stage's own rows that have a language. Repeated rows, rows with a null id and texts of any
    length are decided each by itself; an empty table gives an empty one; other columns pass through.
    """
    model = langid.fit(docs.where(F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0)) != 2))
    return langid.keep_identified(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are identical after lower-casing A-Z, the row with the largest id; of rows that repeat id and text, one.

    Null ids lose against others; null texts count as empty; an empty table gives an empty one; other columns pass through.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the 5-word Jaccard join at 0.8, the one with the smallest id.

    Texts without words and rows with a null id are linked with nothing and stay; rows that share an id are one document;
    an empty table gives an empty one; other columns pass through.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the schedule's order, each as often as the mix passes it: 0 to 3 times.

    Texts without words are left out; null sources are one source; an empty table gives an empty one; other columns pass
    through.
    """
    return mixing.repeat_to_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, one row per row of the mix; null texts have no tokens, an empty table gives an empty one."""
    return bpe.digest_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: The language model, the components of the join and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next, and the tables that it made on its way are deleted."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before = written()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
            clear_stored(spark, before, docs)
    return docs
