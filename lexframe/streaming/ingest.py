"""New snapshots in the landing folder, brought into the store as they arrive, and norms as their scheduled changes come."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime
from inspect import signature

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import landing, xml

Sync = Callable[..., object]
FILES = "path string, modificationTime timestamp, length long, content binary"
TEXTS = "norm_id string, payload string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)


def _sync(spark: SparkSession, root: str, norms: list[str], sync: Sync, day: date) -> None:
    """Calls ``sync`` with what is landed of ``norms``; only their folders are opened, however many there are beside them."""
    texts = landing.read_of(spark, root, landing.TEXT, norms)
    index = landing.parse_index(landing.read_of(spark, root, landing.INDEX, norms))
    only = {"only": spark.createDataFrame([(n,) for n in norms], "norm_id string")} if "only" in signature(sync).parameters else {}
    sync(xml.blocks(texts), index, day, **only)


def _named(batch: DataFrame) -> list[str]:
    return [r[0] for r in batch.select("norm_id").distinct().orderBy("norm_id").collect()]  # at most the catalog


def watch(spark: SparkSession, root: str, checkpoint: str, sync: Sync, day: Callable[[], date] = date.today, once: bool = True) -> StreamingQuery:
    """Calls ``sync(blocks, index, day)``, with ``only=norms`` too where it takes that, for the norms whose text or index is new in each micro-batch.

    A batch names the norms; their snapshots are read whole from the folder, so a batch replayed after a failure does the same.
    """
    arrived = _files(spark, root).select(F.element_at(F.split("path", "/"), -2).alias("norm_id"))

    def handle(batch: DataFrame, _: int) -> None:
        if norms := _named(batch):
            _sync(spark, root, norms, sync, day())

    writer = arrived.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def midnight(day: date) -> int:
    """Milliseconds since 1970 at which ``day`` begins in UTC."""
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000)


class _Wakes(StatefulProcessor):
    """A timer for every day to come on which a norm's text changes; the timers are the state. A new text replaces them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        days = [r["wakes"] for r in rows if r["wakes"] is not None]
        if days:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            now = timerValues.getCurrentProcessingTimeInMs()
            for at in sorted(set(days[-1])):
                if at > now:
                    self.handle.registerTimer(at)
        yield Row(norm_id=key[0], reason="arrived")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield Row(norm_id=key[0], reason="scheduled")

    def close(self) -> None:
        pass


def watch_scheduled(spark: SparkSession, root: str, checkpoint: str, sync: Sync, day: Callable[[], date] = date.today, every: str = "1 minute", wake: Callable[[date], int] = midnight) -> StreamingQuery:
    """As ``watch``, and calls ``sync`` for a norm too when a day has come on which its landed text changes, though no file arrives.

    Runs until it is stopped. ``wake`` tells at which millisecond a day begins. Timers are kept in the checkpoint, so a query that was
    down on a day makes up for it when it starts again. Days of blocks out of scope wake a norm as well; ``sync`` then finds nothing due.
    """
    own = spark.newSession()  # the state store that timers need is of no concern to the user's other queries
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))

    def days(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [path.rsplit("/", 2)[-2:] for path in frame["path"]]
            wakes = [[wake(d) for d in xml.change_days(content)] if name == landing.TEXT else None for (_, name), content in zip(parts, frame["content"], strict=True)]
            yield pd.DataFrame({"norm_id": [norm for norm, _ in parts], "wakes": wakes})

    arrived = _files(own, root).select("path", "content").mapInPandas(days, "norm_id string, wakes array<bigint>")
    told = arrived.groupBy("norm_id").transformWithState(_Wakes(), "norm_id string, reason string", "Update", "ProcessingTime")

    def handle(batch: DataFrame, _: int) -> None:
        if norms := _named(batch):
            _sync(spark, root, norms, sync, day())

    return told.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def poll(spark: SparkSession, root: str, checkpoint: str, norms: DataFrame, base: str, once: bool = True, every: str = "1 hour", **options: str) -> StreamingQuery:
    """Asks the service for the index of every norm at each trigger and lands the parts of those that changed, for ``watch`` to find.

    The checkpoint holds what was last seen, so a restarted query asks for the texts of changed norms only.
    """

    def handle(batch: DataFrame, _: int) -> None:
        landing.land(batch, root)

    writer = landing.changes(spark, norms, base, **options).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=every).start()
