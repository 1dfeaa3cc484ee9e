"""Tables that cut a plan: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of an Arrow batch that a Python worker gets, besides its last row.
BATCH_BYTES = 4 << 20


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="marlstone-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written once and read back: a lost executor costs the rerun of its tasks at most."""
    path = scratch_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of at most BATCH_BYTES and a row from now on; a smaller bound stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None) or ""
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (an action counts them), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
