"""What the corpus operators share: whitespace words, scratch tables, sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Rows of a side that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of an Arrow batch that a Python worker gets, besides its last row.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of at most BATCH_BYTES from now on; a smaller bound stays.

    Batches are cut by rows alone otherwise, and ten thousand long texts take a worker's memory.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name) or ""
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; null text gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+", -1))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use inside one expression."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def replaced(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of ``df`` but those that columns of these names will replace, in any case of letters."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage.

    A lost executor costs at most the rerun of tasks; finished files stay readable.
    """
    path = scratch_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    The count is an action; call it on tables that are cheap to read again.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
