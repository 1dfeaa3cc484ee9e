"""Levels, seasons and frequent words of plain texts."""

from pyspark.sql import functions as F

from marlstone.functions import extraction as X

LEVELS = ["PK", "K", "1", "2", "3", "4", "5", "6", "7", "8"]
CASES = {
    "Grades K-2": "K 1 2", "for grades 1, 2 and 4.": "1 2 4", "Grade 3": "3", "3rd grade": "3", "2nd through 4th graders": "2 3 4", "grades pre-K to 1": "PK K 1", "Pre-k and Kindergarten grades": "PK K",
    "levels 6–8, grade 2": "2 6 7 8", "grades 5 - 3": "3 5", "grades 7-12": "7", "grade 9": "", "page 3 of 8": "", "upgrade 3": "", "GRADES 1 & 3, or 5": "1 3 5", "1st, 2nd, and 3rd grade": "1 2 3", "": "",
    "grades 3-5 and 7": "3 4 5 7", "a 4th-grade class": "4",
}


def test_levels(spark):
    rows = spark.createDataFrame([(t,) for t in [*CASES, None]], "t string").select("t", X.levels(F.col("t"), LEVELS).alias("l")).collect()
    assert {r.t: " ".join(r.l) for r in rows} == {**CASES, None: ""}


def test_phrases_and_frequent_words(spark):
    rows = spark.createDataFrame([("In early Fall and WINTER",), ("falling springs",), (None,), ("cook, Cook! baking cooks cook",), ("cook bake",)], "t string")
    seasons = {"Fall": ["early fall", "autumn"], "Winter": ["winter"], "Spring": ["spring"]}
    got = rows.select(X.phrases(F.col("t"), seasons), X.frequent(F.col("t"), {"cooking": ["cook", "bake"]}), X.phrases(F.col("t"), {})).collect()
    assert [tuple(r) for r in got] == [(["Fall", "Winter"], [], []), ([], [], []), ([], [], []), ([], ["cooking"], []), ([], [], [])]
