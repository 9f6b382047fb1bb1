"""Structured Streaming scoring.

Scoring is stateless, so the batch ``score_all`` plan runs unchanged on a
streaming DataFrame: new profile files arriving in a folder are scored and
appended to a sink, exactly once per file (the checkpoint records which
files were done).  ``trigger(availableNow=True)`` drains what is there and
stops, the usual way to run this as a scheduled job.

The running tier counts are a stateful streaming aggregate (complete mode);
its state is one row per tier.  Each batch is a folder of its own, so a reader
never sees a half-written or empty sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lapse.functions.exprs import risk_level
from lapse.operators.models import TrainedModel
from lapse.operators.scoring import score_all


def read_profiles(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def score_stream(model: TrainedModel, stream: DataFrame, sink_path: str, checkpoint: str,
                 fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Append the scores of every arriving profile to ``sink_path``."""
    scored = score_all(model, stream)
    writer = (scored.writeStream.format(fmt).option("path", sink_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def tier_counts_stream(scored: DataFrame, sink_path: str, checkpoint: str,
                       score_col: str = "risk_score") -> StreamingQuery:
    """Running row count per risk tier; the counts after batch n are in
    ``sink_path/batch=n`` (see ``latest_tier_counts``)."""
    counts = scored.groupBy(risk_level(F.col(score_col)).alias("tier")).agg(F.count(F.lit(1)).alias("count"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    return (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .foreachBatch(write_batch).trigger(availableNow=True).start())


def latest_tier_counts(spark: SparkSession, sink_path: str) -> DataFrame:
    """(tier, count) after the last finished batch."""
    rows = spark.read.parquet(sink_path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")
