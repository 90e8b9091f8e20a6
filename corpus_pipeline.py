"""From raw documents to token ids: toxic, repeated and contaminated documents go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``, with whole rows unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import toxicity
from thicket.llm.bpe import round_trip
from thicket.llm.decontaminate import uncontaminated
from thicket.llm.minhash import deduplicated
from thicket.llm.shared import fresh, ship, written

TOKENIZER = "byte_bpe_50k.tiktoken"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "_toxicity")
    scored = toxicity.score_documents(docs, model, out=score)
    return scored.where(~F.coalesce(toxicity.rejected(F.col(score), F.col("lang"), model), F.lit(False))).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    ship(spark)
    return deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    ship(spark)
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of whole texts, with digests of the ids and of what they decode to."""
    import public_tokenizers

    ship(spark)
    return round_trip(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("byte_level_bpe", encoded)]

#: SQL can't express a trained classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
