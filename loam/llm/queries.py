"""The registered queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, bbit_minhash, bpe, exact_dedup, langid, licenses, mixing, ngram_join, secrets, source_terms, tiff, toxicity, wavelet
from .common import crc_mod, table


def tokenizer_path() -> str:
    """The public tokenizer that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    field = toxicity.fit_joined(docs, labels.select("doc_id", "toxic"))
    scored = toxicity.score(docs, field)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_spans", "spans")


def op3_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op4_license_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.document_path(docs))


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_slot", "last_slot", "pieces")


def op7_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op8_salted_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_bloom_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.clusters(table(spark, sf_dir, "embeddings"))


def op12_source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_terms.audit(table(spark, sf_dir, "documents"))


def op13_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_battery,
        op2_toxic_spans,
        op3_signature_tree_join,
        op4_license_paths,
        op5_bpe_tree,
        op6_source_schedule,
        op7_tiff_pages,
        op8_salted_dedup,
        op9_bloom_langid,
        op10_wavelet_shards,
        op11_ball_kmeans,
        op12_source_terms,
        op13_bbit_minhash,
    )
}
SQL = {"op8_salted_dedup": exact_dedup.SQL, "op11_ball_kmeans": ball_kmeans.SQL, "op12_source_terms": source_terms.SQL}
