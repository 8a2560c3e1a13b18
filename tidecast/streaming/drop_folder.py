"""Exports imported as they are dropped into a folder, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidecast.plans.import_job import import_folder
from tidecast.sources.exports import stream_lines
from tidecast.sources.store import Store


def start_import(
    spark: SparkSession,
    folder: str,
    store: Store,
    checkpoint: str,
    archive: str | None = None,
    **options,
) -> StreamingQuery:
    """Import what is new in the folder and stop. Progress is kept in ``checkpoint``.

    The stream says when there is something new; what is new is the store's ledger to say,
    so a batch that is replayed, in whole or for one of its files, finds what was imported
    before recorded and moves it to ``archive`` in the same batch.
    """

    def one_batch(_: DataFrame, _batch_id: int) -> None:
        import_folder(spark, folder, store, archive, **options)

    return (
        stream_lines(spark, folder)
        .writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
