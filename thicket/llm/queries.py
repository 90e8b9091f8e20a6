"""One thin query for each operator, over its whole table; and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from thicket.llm.shared import ship

    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))[0]


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.warc import audit_pages

    found, _ = audit_pages(_table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("record", "page_id")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm import kneser_ney as N

    documents = _table(spark, sf_dir, "documents").select("doc_id", N.held_out().alias("held_out"), "text")
    return N.score(documents, N.train(documents.where("not held_out"), order=3))


def op4_context_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.idcoder import stored_documents

    return stored_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))[0]


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm import toxicity as T

    documents = _table(spark, sf_dir, "documents")
    model = T.train(documents, _table(spark, sf_dir, "labels"))
    scored = T.score_documents(documents.select("doc_id", T.fold().alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= T.THRESHOLD).cast("int"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))


def op7_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))[0]


def planted_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's operator over ``embeddings`` with planted copies: of every third vector one at a cosine near 0.999, of
    every fifth one turned further, below the threshold, and of every seventh a multiple of itself."""
    from thicket.llm.embeddings import near_duplicates
    from thicket.llm.sql import planted

    _table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    return near_duplicates(spark.sql(planted(spark=True)))[0]


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.tiktoken"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))[0]


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_merkle_fixity, op3_kneser_ney, op4_context_mixing_coder, op5_toxicity, op6_token_counts, op7_sorted_projections, planted_near_vectors, op8_byte_level_bpe, op9_hilbert_sharding, op10_prob_minhash)}


def oracle_sql() -> dict[str, str]:
    from thicket.llm import sql

    return sql.oracle_sql()
