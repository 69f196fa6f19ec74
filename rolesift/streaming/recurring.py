"""The run every half hour, as micro-batches over landed pages."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rolesift.operators.pages import PAGE_FETCHES
from rolesift.plans.jobs import RunParams, run_once
from rolesift.sources.store import RunStore


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGE_FETCHES).parquet(folder)


def recurring_run(
    spark: SparkSession,
    pages_folder: str,
    store: RunStore,
    configs: Callable[[], DataFrame],
    checkpoint: str,
    params: RunParams | None = None,
    notify: bool = True,
    trigger: dict | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> StreamingQuery:
    """Each micro-batch of landed pages triggers one run over all pages landed so far.

    The run reads the folder as of its time, so pages of one source that land in
    different batches, and copies stamped later than the run, are judged together by
    the next run. A run is known by the stream and the batch that triggered it: a batch
    replayed after a failure finds its run published and changes nothing, and run ids
    are shared with runs started otherwise.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        landed = spark.read.schema(PAGE_FETCHES).parquet(pages_folder)
        run_once(store, landed, configs(), clock(), params, notify, trigger=f"{stream}/{batch_id}")

    return (
        landed_pages(spark, pages_folder)
        .writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 minutes"}))
        .start()
    )
