"""Streaming queries: masking over a file stream (same result as ``mask_documents``) and windowed
event counts with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..profile import default_profile
from ..session import ensure_checkpoint_dir
from ..streaming import mask_stream as MS
from . import q_mask as QM
from .registry import REGISTRY, register, table


@register("mask_stream", "2.16 M8 D1 (readStream -> parquet sink, availableNow)", "documents",
          REGISTRY["mask_documents"].sql)
def mask_stream(spark, sf):
    full = table(spark, sf, "documents").schema
    s = MS.masked_stream(spark, sf, "documents.parquet", full, "text", default_profile())
    names = QM.STEP_NAMES + ["heur"]
    from ..operators.mask import count_total

    s = s.select("doc_id", "lang", "masked", *[F.col(f"c.{n}").alias(f"n_{n}") for n in names],
                 count_total("c", names).alias("n_total"))
    out = MS.run_to_sink(s, "mask_stream")
    return spark.read.schema(s.schema).parquet(out)


@register(
    "event_windows",
    "2.16 (withWatermark + tumbling window aggregate)",
    "events",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value) AS value_sum
FROM events GROUP BY 1, 2""",
)
def event_windows(spark, sf):
    """Update-mode stream: each micro-batch appends its changed windows with the batch id; the
    final table keeps the latest version of each (window, key) - no driver-side memory sink."""
    full = table(spark, sf, "events").schema
    src = MS.table_stream(spark, sf, "events.parquet", full)
    src = src.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = MS.windowed_counts(src, "ts", "event_type", "1 hour", "10 minutes")
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/streams/event_windows-{uuid.uuid4().hex[:12]}"

    def sink(batch, batch_id):
        (batch.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value_sum",
                      F.lit(batch_id).alias("batch_id"))
         .write.mode("append").parquet(f"{run}/out"))

    q = (agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{run}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{run}/out")
    latest = out.groupBy("window_start", "event_type").agg(
        F.max_by(F.struct("n", "value_sum"), "batch_id").alias("v"))
    return latest.select("window_start", "event_type", "v.n", "v.value_sum")


#: A message for every event, with what the masker has to find in it.
_MESSAGE = ("concat('Evento ', CASE WHEN event_id % 2 = 0 THEN concat('DNI ', lpad(CAST(event_id AS STRING), 8, '0'), 'B') ELSE 'sin datos' END, "
            "CASE WHEN user_id % 3 = 0 THEN concat(' de u', CAST(user_id AS STRING), '@correo.es') ELSE '' END, "
            "CASE WHEN event_id % 5 < 2 THEN ' el 01/02/2024 y 03/04/2024' ELSE '' END)")


@register(
    "stream_audit",
    "2.16 A1 (masked stream, counts a window and tag, watermark, idempotent batches)",
    "events",
    """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_id, user_id, max(ts) OVER () AS latest FROM events),
t AS (SELECT window_start, latest, 'dni' AS tag, 1 AS n FROM e WHERE event_id % 2 = 0
      UNION ALL SELECT window_start, latest, 'email', 1 FROM e WHERE user_id % 3 = 0
      UNION ALL SELECT window_start, latest, 'date', 2 FROM e WHERE event_id % 5 < 2)
SELECT window_start, tag, CAST(sum(n) AS BIGINT) AS n FROM t
WHERE window_start + INTERVAL 1 HOUR <= latest - INTERVAL 10 MINUTE GROUP BY window_start, tag""",
)
def stream_audit(spark, sf):
    """Messages of the events are masked as a stream; a window's counts are written when the watermark has passed it."""
    full = table(spark, sf, "events").schema
    src = MS.table_stream(spark, sf, "events.parquet", full)
    src = src.select(F.col("ts").cast("timestamp").alias("ts"), F.expr(_MESSAGE).alias("text"))
    profile = default_profile()
    masked = MS.M.mask_text(src, "text", profile, out="masked", counts="c", protect=False)
    names = [n for n, _, _ in MS.M.T.text_steps(profile)]
    out = MS.run_to_batches(MS.windowed_audit(masked, "ts", "c", names), "stream_audit")
    return spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tag", "n")
