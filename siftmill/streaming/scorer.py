"""Resumable scoring and streaming decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftmill.functions.scoring import Rule, keyword_logits, softmax
from siftmill.operators.teacher import check_inputs, remaining, score_batches, validate_scores
from siftmill.schema import ContractError
from siftmill.sources.files import delete, exists


def run_scorer(inputs: DataFrame, path: str, score: Callable[[list[str]], list[dict]], model: str, batch: int = 8, rows_per_flush: int = 80, limit: int | None = None) -> int:
    """Score what the table at ``path`` lacks and append it flush by flush; rows already
    appended survive a later failure, and the next run goes on with the others. Returns
    how many rows were new.

    Inputs are read once: what they lack is laid out beside the table in files of a flush each,
    and a stream takes one file at a time, scores it and appends it. A run that is
    killed leaves whole flushes; its layout is removed by the next run."""
    spark = inputs.sparkSession
    work = f"{path}.work"
    delete(spark, work)
    asked = f"{work}/inputs"
    inputs.select("id", "text").write.parquet(asked)
    rows = check_inputs(spark.read.schema("id string, text string").parquet(asked))
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    if exists(spark, path):
        done = validate_scores(spark.read.parquet(path))
        other = done.where(F.col("teacher_model") != model).limit(1).count()
        if other:
            delete(spark, work)
            raise ContractError(f"{path} holds scores of another model than {model}")
        rows = remaining(rows, done)
    flushes = f"{work}/flushes"
    rows.write.option("maxRecordsPerFile", rows_per_flush).parquet(flushes)
    n = spark.read.schema("id string, text string").parquet(flushes).count()
    if n:
        stream = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).parquet(flushes)

        def sink(flush: DataFrame, _: int) -> None:
            # ids were told apart above: a flush is new, and is appended whole
            score_batches(flush, score, model, batch).coalesce(1).write.mode("append").parquet(path)

        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    delete(spark, work)
    return n


def append_batch(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that skips keys its table has; a batch that runs twice adds nothing new."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if exists(spark, path):
            rows = remaining(rows, spark.read.parquet(path)) if key == "id" else rows.join(spark.read.parquet(path).select(key), key, "left_anti")
        rows.write.mode("append").parquet(path)

    return sink


def decide(stream: DataFrame, rules: list[Rule], t: float) -> DataFrame:
    """Rule scores and the escalation decision of a stream of (id, text)."""
    p = softmax(keyword_logits(F.coalesce("text", F.lit("")), rules))
    return stream.withColumns({"p_safe": p[0], "p_dangerous": p[1], "p_unsure": p[2]}).withColumn("escalate", F.col("p_safe") < F.lit(float(t)))


def stream_decisions(spark: SparkSession, source: str, schema: str, rules: list[Rule], t: float, sink: str, checkpoint: str) -> StreamingQuery:
    """Prompt files as they arrive -> score -> decision -> idempotent table."""
    rows = decide(spark.readStream.schema(schema).json(source), rules, t)
    return rows.writeStream.foreachBatch(append_batch(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and errors per window, late ones within the watermark included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
