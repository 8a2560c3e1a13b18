"""A daily series from a stream of events that never contains an unfinished day.

``closed_days`` leaves the closing to the watermark, which says nothing of the rows that come
later still. ``close_days`` closes the same days and keeps every row: it is in a closed day,
in one still open, or among the late rows. What it knows between micro-batches are small
tables of its own, one set per batch: a batch that is replayed starts from those of the batch
before and overwrites its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidecast.session import landed
from tidecast.sources.files import Files

DAYS = "entity string, day date, n_events bigint, total double"


def closed_days(events: DataFrame, late_by: str) -> DataFrame:
    """``entity, day, n_events, total`` per event type and day.

    ``late_by`` is how long a day stays open for events that come late; there is no default,
    since what comes later still is left out. In append mode a day is emitted once the
    watermark has passed its end, and never changes after. The state is one row per
    (type, day) still open.
    """
    return (
        events.withWatermark("ts", late_by)
        .groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("entity"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
        .select(
            "entity", F.col("w.start").cast("date").alias("day"), "n_events", "total"
        )
    )


def write_closed_days(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def close_days(events: DataFrame, root: str, checkpoint: str, late_by: str) -> StreamingQuery:
    """Write days that are over, days still open and late rows below ``root``.

    ``events``: ts, event_type, value, and whatever else late rows are to keep. A day is over
    when an event has come that is ``late_by`` past its end; an event of such a day, read in
    a later micro-batch, is late, whether or not its type had others that day. An event
    without a time is late too. ``root`` belongs to ``checkpoint``: a new one starts anew.
    """
    def one_batch(batch: DataFrame, n: int) -> None:
        spark, files = batch.sparkSession, Files(batch.sparkSession)
        at = lambda kind, k: f"{root}/{kind}/batch={k}"
        dated = batch.withColumn("day", F.col("ts").cast("date"))
        known = n > 0 and files.exists(at("mark", n - 1))
        before = spark.read.parquet(at("mark", n - 1)).first() if known else None
        cut = before["cut"] if before else None
        late = F.col("day").isNull() if cut is None else (
            F.col("day").isNull() | (F.col("day") < F.lit(cut)))
        dated.where(late).drop("day").write.mode("overwrite").parquet(at("late", n))

        came = landed(dated.where("day is not null").groupBy(
            F.col("event_type").alias("entity"), "day").agg(
            F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"),
            F.max("ts").alias("newest")), "came")
        days = came.where(~late).drop("newest")
        if known:
            days = days.unionByName(spark.read.schema(DAYS).parquet(at("open", n - 1)))
        days = landed(days.groupBy("entity", "day").agg(
            F.sum("n_events").alias("n_events"), F.sum("total").alias("total")), "days")
        newest = came.agg(F.max("newest")).first()[0]
        newest = max((x for x in (newest, before and before["newest"]) if x is not None), default=None)
        mark = spark.range(1).select(F.lit(newest).cast("timestamp").alias("newest")).select(
            "newest", (F.col("newest") - F.expr(f"INTERVAL {late_by}")).cast("date").alias("cut"))
        over = F.col("day") < F.lit(mark.first()["cut"])
        days.where(over).write.mode("overwrite").parquet(at("closed", n))
        days.where(~F.coalesce(over, F.lit(False))).write.mode("overwrite").parquet(at("open", n))
        mark.write.mode("overwrite").parquet(at("mark", n))
        for kind in ("open", "mark"):
            files.delete(at(kind, n - 2))

    return (
        events.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_days(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closed days, days still open, and late rows, as of the last micro-batch that ended."""
    marks = Files(spark).names(f"{root}/mark")
    last = max((int(n.partition("=")[2]) for n in marks if n.startswith("batch=")), default=None)
    if last is None:
        none = spark.createDataFrame([], DAYS)
        return none, none, spark.createDataFrame([], "ts timestamp, event_type string, value double")
    upto = F.col("batch") <= last
    closed = spark.read.schema(f"{DAYS}, batch int").parquet(f"{root}/closed").where(upto)
    late = spark.read.parquet(f"{root}/late").where(upto)
    return (closed.drop("batch"), spark.read.schema(DAYS).parquet(f"{root}/open/batch={last}"),
            late.drop("batch"))
