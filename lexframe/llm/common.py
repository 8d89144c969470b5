"""What the operators share: a scratch folder all executors see, and the split of labelled rows."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            root = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="lexframe-")
            _LOCAL[context.applicationId] = root
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/lexframe"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later stages neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_by(df: DataFrame, part_col: str, label: str, *parts: str) -> list[DataFrame]:
    """``cut``, with the rows of each value of ``part_col`` (a text) in a folder of its own, which ``discard`` removes by itself."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(part_col).parquet(path)
    whole, out = spark.read.schema(df.schema).parquet(path), []
    for part in parts:
        rows = whole.where(F.col(part_col) == part).drop(part_col)
        rows._cut_path = f"{path}/{part_col}={part}"
        out.append(rows)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of ``cut`` tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """``discard``, and the shuffle files of jobs that are over: Spark drops them when the driver collects its garbage. Its listeners hold the last
    job's plan until they hear of another one, so a job of one row goes first."""
    discard(*tables)
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def utf8(text_col: str) -> Column:
    return F.col(text_col).cast("binary")
