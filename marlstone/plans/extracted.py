"""Levels, seasons and activities that descriptions name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import extraction as X
from marlstone.plans import views as V
from marlstone.plans.catalog import query

LEVELS = ["PK", "K", "1", "2", "3", "4", "5", "6", "7", "8"]
SEASONS = {"Fall": ["early fall", "fall", "autumn"], "Winter": ["winter"], "Spring": ["spring"]}
KINDS = {"small": ["small", "mini"], "bright": ["red", "blue"]}


@query(
    "t22_levels",
    f"WITH {V.ITEMS}, s AS (SELECT id, title, size, 1 + size % 5 AS a, 1 + size % 5 + size % 3 AS b, ['PK', 'K', '1', '2', '3', '4', '5', '6', '7', '8'] AS v FROM items) "
    "SELECT id, array_to_string(list_filter(v, lambda x: CASE WHEN size % 4 = 3 THEN false ELSE list_position(v, x) BETWEEN a + 1 AND b + 1 OR (size % 4 = 1 AND x IN ('6', '8')) END), ',') AS levels, "
    "concat_ws(',', CASE WHEN size > 30 THEN 'Fall' END, CASE WHEN size % 2 = 0 THEN 'Spring' END) AS seasons, "
    "concat_ws(',', CASE WHEN contains(title, 'small') THEN 'small' END, CASE WHEN contains(title, 'red') OR contains(title, 'blue') THEN 'bright' END) AS kinds FROM s",
)
def t22_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels from lists, ranges and ordinals, seasons from phrases, kinds from words that occur three times."""
    i = V.items(spark, sf_dir).withColumn("a", 1 + F.col("size") % 5).withColumn("b", F.col("a") + F.col("size") % 3)
    known = F.array(*[F.lit(v) for v in LEVELS])
    low, high = (F.element_at(known, (F.col(c) + 1).cast("int")) for c in "ab")
    told = F.when(F.col("size") % 4 == 3, F.concat(F.lit("Pages "), low, F.lit(" to 8."))).when(
        F.col("size") % 4 == 1, F.concat(F.lit("Grades "), low, F.lit(" - "), high, F.lit(", 8; also for 6th graders."))
    ).otherwise(F.concat(F.lit("For GRADES "), low, F.lit(" through "), high, F.lit(".")))
    season = F.concat(F.when(F.col("size") > 30, " In early Fall.").otherwise(" Falling."), F.when(F.col("size") % 2 == 0, " Spring!").otherwise(""))
    text = F.concat(told, season, F.lit(" "), F.concat_ws(". ", "title", "title", "title"), F.lit(" mini red"))
    i = i.withColumn("text", text)
    return i.select("id", *[F.array_join(c, ",").alias(n) for n, c in (("levels", X.levels(F.col("text"), LEVELS)), ("seasons", X.phrases(F.col("text"), SEASONS)), ("kinds", X.frequent(F.col("text"), KINDS)))])
