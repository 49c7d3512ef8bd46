"""Patch chains and progress as streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boughline.operators.changefeed import apply_changes
from boughline.operators.common import discard, settle


def table_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 4) -> DataFrame:
    """A table's files as a stream, so many files a micro-batch."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    # A single file is found through its folder.
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


class ChainState:
    """The current state of chains whose sections arrive as a stream, in any order and repeatedly.

    Batches append to a log of sections and one of changes in a shared folder;
    a batch that is retried overwrites its own files only, so each arrives
    once. The state is the log applied in chain order, which late sections may
    change anywhere. It is kept as a table: a chain is replayed from the log
    when it is asked for after batches brought rows of it, the others stay.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._new: dict[str, list[int]] = {"sections": [], "changes": []}
        self._state: DataFrame | None = None

    def _append(self, kind: str):
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={number}")
            self._new[kind].append(number)

        return write

    def take(self, stream: DataFrame, kind: str) -> None:
        """Takes all that the stream has now; ``kind`` is ``sections`` or ``changes``."""
        query = stream.writeStream.foreachBatch(self._append(kind)).option("checkpointLocation", f"{self.folder}/checkpoints/{kind}").trigger(availableNow=True).start()
        query.awaitTermination()

    def state(self) -> DataFrame:
        read = lambda kind: self.spark.read.parquet(f"{self.folder}/{kind}")
        sections, changes = read("sections"), read("changes")
        if self._state is None:
            self._state = settle(apply_changes(sections.drop("batch"), changes.drop("batch")))
        elif any(self._new.values()):
            fresh = changes.where(F.col("batch").isin(self._new["changes"])).select("section_id").distinct()
            touched = sections.where(F.col("batch").isin(self._new["sections"])).select("chain_id").unionByName(sections.join(fresh, "section_id", "left_semi").select("chain_id"))
            touched = settle(touched.where("chain_id IS NOT NULL").distinct())
            own = sections.drop("batch").join(touched, "chain_id", "left_semi")
            again = apply_changes(own, changes.drop("batch").join(own.select("section_id").distinct(), "section_id", "left_semi"))
            former, self._state = self._state, settle(self._state.join(touched, "chain_id", "left_anti").unionByName(again))
            discard(former)
        self._new = {"sections": [], "changes": []}
        return self._state


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events per window and type with a watermark (an addition of this engine: trees have no event time)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))


def take_complete(counts: DataFrame, folder: str) -> DataFrame:
    """The aggregate of a stream after all that it has now, kept as a table in ``folder`` that each micro-batch replaces."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = counts.sparkSession
    last = query.lastProgress["batchId"] if query.lastProgress else None
    return spark.read.schema(counts.schema).parquet(f"{folder}/batch={last}") if last is not None else spark.createDataFrame([], counts.schema)
