"""Readers and writers of the catalogue's file formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """JSON lines; lines that don't parse or lack a required field are skipped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.filter("_bad IS NULL").drop("_bad")
    return rows.na.drop(subset=list(required)) if required else rows


def worksheets(spark: SparkSession, paths: Sequence[str], key: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): quoted CSV files with one row per key, and keys with differing rows."""
    rows = spark.read.csv(list(paths), header=True, quote='"', escape='"', multiLine=True)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    distinct = rows.distinct()
    conflicts = distinct.groupBy(key).count().filter("count > 1").select(key)
    return distinct.join(conflicts, key, "left_anti"), conflicts


def plain_body(body):
    """The body without vertical tabs, with line feeds alone as line ends."""
    return F.replace(F.replace(body, F.lit("\x0b"), F.lit("")), F.lit("\r\n"), F.lit("\n"))


RUN = "struct<textRun:struct<content:string>>"
TREE = f"""struct<body:struct<content:array<struct<
  paragraph:struct<elements:array<{RUN}>>, sectionBreak:struct<sectionStyle:string>,
  table:struct<tableRows:array<struct<tableCells:array<struct<content:array<struct<paragraph:struct<elements:array<{RUN}>>>>>>>>>>>>>"""


def tree_text(value):
    """The text of a document tree in JSON: runs, table rows with bars, a rule at section breaks."""
    tree = F.from_json(value, TREE)
    runs = lambda p: F.array_join(F.transform(p["elements"], lambda e: F.coalesce(e["textRun"]["content"], F.lit(""))), "")
    cell = lambda c: F.btrim(F.array_join(F.transform(c["content"], lambda x: runs(x["paragraph"])), " "))
    row = lambda r: F.concat(F.array_join(F.transform(r["tableCells"], cell), " | "), F.lit("\n"))
    part = lambda x: (
        F.when(x["paragraph"].isNotNull(), runs(x["paragraph"])).when(x["table"].isNotNull(), F.array_join(F.transform(x["table"]["tableRows"], row), "")).otherwise(F.lit("\n---\n"))
    )
    return F.array_join(F.transform(tree["body"]["content"], part), "")


def page_after(rows: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """The next ``size`` rows after the cursor by key; fewer rows mean that it was the last page."""
    return (rows if cursor is None else rows.filter(F.col(key) > cursor)).orderBy(key).limit(size)


def scorecard(metrics: DataFrame, title: str) -> str:
    """A Markdown table of a small result; its rows are collected."""
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "-|" * len(metrics.columns)
    rows = ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in metrics.limit(1000).collect()]
    return "\n".join([f"# {title}", "", head, *rows, ""])
