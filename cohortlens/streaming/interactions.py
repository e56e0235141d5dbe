"""Interaction events: an allow-list, then windows and sessions; the same functions serve batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Events and the properties that each may carry.
ALLOWED = {
    "report_opened": [], "pdf_downloaded": ["cohort_key"], "cohort_selected": ["cohort_key"], "metric_selected": ["cohort_key", "metric_key"], "overlap_region_selected": ["overlap_region"],
}
SAFE = "^[a-z0-9][a-z0-9_-]{0,63}$"


def allowed(events: DataFrame, allow: dict[str, list[str]] = ALLOWED) -> DataFrame:
    """Known events with their known, safe properties. ``events``: event, props (map of strings)."""
    keys = F.create_map(*[x for e, k in allow.items() for x in (F.lit(e), F.array(*map(F.lit, k)).cast("array<string>"))])
    mine = F.try_element_at(keys, F.col("event"))
    return events.where(F.col("event").isin(*allow)).withColumn("props", F.map_filter("props", lambda k, v: F.array_contains(mine, k) & F.coalesce(v.rlike(SAFE), F.lit(False))))


def windowed(events: DataFrame, length: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts by window and event; ``late`` sets a watermark on a stream."""
    found = events.withWatermark("ts", late) if late else events
    return found.groupBy(F.window("ts", length).alias("w"), "event").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    found = events.withWatermark("ts", late) if late else events
    return found.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def _bucket(digest) -> Column:
    """Which of 256 folders of the manifest a digest is in."""
    return F.substring(F.sha2(digest.cast("binary"), 256), 1, 2)


def ingest(stream: DataFrame, manifest: str, sink: str, checkpoint: str):
    """Idempotent file ingest: a digest that the manifest has is skipped, also when a batch is replayed.

    The manifest is kept by digest: a batch reads the folders of its own digests alone, however long the manifest has grown.
    """
    from cohortlens.operators.lifecycle import new_files

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = ["digest", "source_type", "event"]
        known = spark.createDataFrame([], "digest string, source_type string, event string")
        if batch_id:
            near = [r[0] for r in batch.select(_bucket(F.col("digest"))).distinct().collect()]  # 256 at most
            # What the batch itself has written before is left out and overwritten, so a replay of it changes nothing.
            known = spark.read.schema("digest string, source_type string, event string, bucket string, batch long").parquet(manifest).where(F.col("bucket").isin(near) & (F.col("batch") != batch_id)).select(*keys)
        fresh = new_files(batch, known)
        batch.join(fresh, [*keys, "arrival"]).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        rows = fresh.select(*keys, _bucket(F.col("digest")).alias("bucket"), F.lit(batch_id).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(manifest)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
