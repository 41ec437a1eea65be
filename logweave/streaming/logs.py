"""Structured Streaming entry points.

Parsing and redaction are stateless column expressions, so the batch
operators run unchanged on a stream of new log files; nothing here keeps
state. The sink is any file format with a checkpoint folder, which makes
the query restartable after a failure (exactly-once for file sinks).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config as C
from ..operators.process import process
from ..sources.logs import labelled


def read_log_stream(
    spark: SparkSession,
    path: str,
    labels: Mapping[str, str] | DataFrame | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """New text files under ``path`` → (value, source) rows, as they arrive; lines and labels as in ``read_logs``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return labelled(reader.load(path), labels).drop("file_name")


def process_stream(stream: DataFrame, cfg: C.RedactionConfig | None = None, include_original: bool = False) -> DataFrame:
    """Parse and redact a line stream; the raw text is dropped unless asked for."""
    out = process(stream, cfg, line_col="value", keep=["source"])
    out = out.drop("detected")
    return out if include_original else out.drop("original_msg")


def start_processing(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    checkpoint_location: str,
    cfg: C.RedactionConfig | None = None,
    fmt: str = "parquet",
    trigger_available_now: bool = False,
) -> StreamingQuery:
    """Continuously write processed (redacted) rows of new files to ``out_path``."""
    w = (
        process_stream(read_log_stream(spark, in_path), cfg)
        .writeStream.format(fmt)
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_location)
        .outputMode("append")
    )
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def stream_event_density(
    logs: DataFrame,
    bucket_minutes: int = 5,
    watermark_minutes: int = 10,
    hot_share: float = 0.4,
) -> DataFrame:
    """Event density on a stream: rows per epoch-aligned time bucket, errors, hot flag.

    The batch operator's buckets and classes, as a windowed aggregate with a
    watermark: a bucket is final once event time passes its end by
    ``watermark_minutes``; later lines for it are dropped by Spark, and state
    for old buckets is freed. ``logs`` is a parsed (and usually redacted)
    stream with ``time``, ``level``, ``msg``.
    """
    from ..operators.events import classify_event, event_time, is_anomaly_type

    timed = logs.withColumn("ts", event_time(F.col("time"))).where(F.col("ts").isNotNull())
    cl = classify_event(timed, display_col=None).withWatermark("ts", f"{int(watermark_minutes)} minutes")
    return (
        cl.groupBy(F.window("ts", f"{int(bucket_minutes)} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(is_anomaly_type(F.col("event_type"))).alias("errors"))
        .select(F.col("w.start").alias("bucket"), "events", "errors",
                (F.col("errors") / F.col("events") >= F.lit(hot_share)).alias("hot"))
    )


def stream_anomaly_windows(
    logs: DataFrame,
    window_minutes: int = 10,
    threshold: float = 0.5,
    watermark_minutes: int = 10,
) -> DataFrame:
    """Anomaly windows on a stream: (start, end, label, buckets) of each run of bad time buckets.

    Two stateful steps share one watermark: time buckets with their error
    rate, and a session window over the bad ones, whose gap lies between one and two
    buckets, so that neighbours merge and a good bucket in between parts them.
    A run is final once event time passes its last bucket by the gap and the
    watermark; until then late lines still count. Use it in append mode.
    """
    from ..operators.events import anomaly_label, classify_event, event_time, is_anomaly_type

    timed = logs.withColumn("ts", event_time(F.col("time"))).where(F.col("ts").isNotNull())
    cl = classify_event(timed, display_col=None).withWatermark("ts", f"{int(watermark_minutes)} minutes")
    bad = (
        cl.groupBy(F.window("ts", f"{int(window_minutes)} minutes").alias("w"))
        .agg((F.count_if(is_anomaly_type(F.col("event_type"))) / F.count(F.lit(1))).alias("rate"))
        .where(F.col("rate") >= F.lit(threshold))
        # a session window on a stream needs a key beside it: all bad buckets have the same one
        .select(F.window_time("w").alias("at"), "w", (F.col("rate") * 0).cast("int").alias("all"))
    )
    runs = bad.groupBy("all", F.session_window("at", f"{int(window_minutes) * 90} seconds")).agg(
        F.min("w.start").alias("start"), F.max("w.end").alias("end"), F.count(F.lit(1)).alias("buckets")
    )
    return runs.select("start", "end", anomaly_label(F.col("start"), F.col("end")).alias("label"), "buckets")
