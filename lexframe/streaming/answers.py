"""Questions that arrive in a folder, answered as they come."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import answering
from ..plans.engine import LENGTHS, Engine

QUESTION = "query_id long, query string"
EVENTS = "query_id long, seq int, type string, data string"


def answer(engine: Engine, questions: str, out: str, checkpoint: str, day: Callable[[], date] = date.today, once: bool = True, files: int = 1, **asked) -> StreamingQuery:
    """Events of the questions, JSON lines of (query_id, query) in the folder ``questions``, written under ``out`` after every ``files``
    files: (query_id, seq, type, data), a folder ``batch=n`` for each micro-batch.

    Every (query_id, seq) is there once: a batch that is run again replaces its own folder, of equal ids in a batch the least
    question counts, and ids that another batch has answered are left out. A null, too short or too long question has an "error" event alone, so that
    it does not stop the stream. ``asked`` goes to ``Engine.ask_events``.
    """
    spark, path = engine.spark, out.rstrip("/")
    arrived = spark.readStream.schema(QUESTION).option("maxFilesPerTrigger", files).json(questions)

    def handle(batch: DataFrame, number: int) -> None:
        once_each = batch.where("query_id is not null").groupBy("query_id").agg(F.min("query").alias("query"))
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            answered = spark.read.schema(EVENTS + ", batch long").option("basePath", path).parquet(path).where(F.col("batch") != number).select("query_id")
            once_each = once_each.join(answered, "query_id", "left_anti")
        # The folder is replaced while it is read from, so what is asked is fixed first.
        fixed = engine.store.keep(once_each)
        good = F.coalesce(F.length("query").between(*LENGTHS), F.lit(False))
        refused = fixed.where(~good).select("query_id", F.lit(0).alias("seq"), F.lit("error").alias("type"), F.to_json(F.struct(F.lit(answering.FAILED).alias("message"))).alias("data"))
        events = engine.ask_events(fixed.where(good), day(), **asked).unionByName(refused)
        events.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arrived.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
