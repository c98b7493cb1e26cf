"""Structured Streaming: the stateless text masking runs unchanged on ``readStream`` (2.16).

A file source feeds ``mask_text``; each micro-batch is appended to a parquet sink.  Per-window
audit counts use an event-time watermark.  Checkpoint and sink live under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster), never a machine-local temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mask as M
from ..session import ensure_checkpoint_dir


def table_stream(spark: SparkSession, source_dir: str, name: str, schema) -> DataFrame:
    """Stream of a table that is one file or a folder of files.  A file source takes no plain file and looks into no folder
    below its own, so the name is given as a pattern, which both forms match."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
            .parquet(f"{source_dir.rstrip('/')}/{{{name}}}"))


def masked_stream(spark: SparkSession, source_dir: str, name: str, schema, text: str, profile) -> DataFrame:
    src = table_stream(spark, source_dir, name, schema)
    return M.mask_text(src, text, profile, out="masked", counts="c", protect=False)


def run_to_sink(stream_df: DataFrame, name: str, available_now: bool = True) -> str:
    """Run the stream until the available input is processed; return the sink folder."""
    spark = stream_df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"
    q = (stream_df.writeStream.format("parquet").option("path", f"{run}/out")
         .option("checkpointLocation", f"{run}/checkpoint").outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    handle = q.start()
    handle.awaitTermination()
    return f"{run}/out"


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Tumbling-window event counts and value sums with a watermark for late rows."""
    return (events.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")))


def windowed_audit(masked: DataFrame, ts: str, counts: str, names, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """How often each tag was masked in each tumbling window of a masked stream (2.16, A1).

    State is one sum a (window, tag).  In append mode a window is given out once, when the watermark has passed its end;
    rows that come later are dropped by the watermark.
    """
    tags = F.array(*[F.struct(F.lit(n).alias("tag"), F.col(f"{counts}.{n}").alias("n")) for n in names])
    rows = masked.withWatermark(ts, watermark).select(ts, F.explode(F.filter(tags, lambda t: t["n"] > 0)).alias("t"))
    return rows.groupBy(F.window(ts, window).alias("w"), "t.tag").agg(F.sum("t.n").cast("long").alias("n")).select(
        F.col("w.start").alias("window_start"), "tag", "n")


def run_to_batches(stream_df: DataFrame, name: str, output_mode: str = "append", base: str | None = None) -> str:
    """Run the stream over the available input; every micro-batch overwrites the folder of its own id, so a batch that is
    run again after a failure leaves no second copy.  Returns the folder of the batches."""
    run = base or f"{ensure_checkpoint_dir(stream_df.sparkSession).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch_id={batch_id}")

    handle = (stream_df.writeStream.outputMode(output_mode).foreachBatch(sink).option("checkpointLocation", f"{run}/checkpoint")
              .trigger(availableNow=True).start())
    handle.awaitTermination()
    return f"{run}/out"
