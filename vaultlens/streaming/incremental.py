"""Streaming forms: incremental import of staged notes, windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultlens.operators.registry import write_plan
from vaultlens.plans.runtime import path_exists, shared_dir

STAGED = "id bigint, title string, note_type string, source_doc string, date string, body string"


def import_stream(spark: SparkSession, staging: str, registry: str, plans: str, checkpoint: str) -> StreamingQuery:
    """Plan the import of staged notes (JSON lines) as they arrive; registry and plans are Parquet folders.

    Each micro-batch reads the registry as it stands, appends its plan and the
    titles it registers. A batch that is repeated after a failure finds its
    own folder and replaces it, so nothing is registered twice.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        s = df.sparkSession
        if path_exists(s, registry):
            known = s.read.parquet(f"{registry}/*").where(F.col("epoch") < epoch)
        else:  # nothing registered yet
            known = s.createDataFrame([], "source_doc string, title string, date string, epoch bigint")
        df = df.persist()
        plan = write_plan(df, known)
        plan.write.mode("overwrite").parquet(f"{plans}/epoch={epoch}")
        new = plan.where("registered").select("id").join(df, "id").select("source_doc", "title", "date", F.lit(epoch).cast("bigint").alias("epoch")).distinct()
        new.write.mode("overwrite").parquet(f"{registry}/batch-{epoch}")
        df.unpersist()

    stream = spark.readStream.schema(STAGED).json(staging)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and the sum of their values per window and type; the same for a stream and a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "total")


def stream_event_windows(spark: SparkSession, folder: str, **kw: str) -> DataFrame:
    """event_windows over Parquet files as a stream, run until all that is there has been read.

    The path is given to the stream as a pattern of itself, as a stream takes
    a plain path for a folder, while a table may be a single file.
    """
    import uuid

    schema = spark.read.parquet(folder).schema
    name = uuid.uuid4().hex
    e = spark.readStream.schema(schema).parquet(f"{folder[:-1]}[{folder[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))
    out, check = f"{shared_dir(spark)}/vaultlens/stream-{name}", f"{shared_dir(spark)}/vaultlens/check-{name}"

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(out)  # complete mode: each batch has the whole result

    q = event_windows(e, **kw).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
