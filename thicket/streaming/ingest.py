"""Documents as a stream: every file that arrives is normalised whole, in the micro-batch that brings it.

Merging and deduplication concern one document at a time, so there is no state to keep between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thicket.plans.normalize import normalize
from thicket.plans.staging import scope, send_modules
from thicket.sources.documents import flatten, nest


def normalize_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Watch ``source`` for JSON files and append (doc_id, text, batch) to the Parquet table ``target``. A batch
    that runs again after a failure replaces its own partition."""
    send_modules(spark)
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(source)
    docs = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))

    def batch(frame: DataFrame, number: int) -> None:
        with scope():  # a batch's tables go with it
            nest(frame, normalize(flatten(frame)).nodes).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
