"""Expectations: nulls, limits, empty tables."""

from pyspark.sql import functions as F

from marlstone.operators import expectations as E


def test_counts_and_failing_rows(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, None, 5), (3, "b", None), (4, "c", 9), (4, "c", 9)], "id long, name string, n int")
    expected = [
        E.Expectation("named", F.col("name").isNotNull()), E.Expectation("small", F.col("n") < 6, at_most=3), E.Expectation("a is 3", F.col("n") == 3, F.col("name") == "a", at_least=2),
        E.Expectation("known", F.col("name").isin("a", "b", "c"), F.col("n") > 4),
    ]
    assert {tuple(r) for r in E.checked(rows, expected).collect()} == {("named", 5, 1, False), ("small", 5, 3, True), ("a is 3", 1, 0, False), ("known", 3, 1, False)}
    assert sorted(map(tuple, E.failing(rows, "id", expected).collect())) == [(2, "known"), (2, "named"), (3, "small"), (4, "small"), (4, "small")]
    assert {tuple(r) for r in E.checked(rows.limit(0), expected).collect()} == {("named", 0, 0, True), ("small", 0, 0, True), ("a is 3", 0, 0, False), ("known", 0, 0, True)}
    plan = E.checked(rows, expected)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Scan") == 1


def test_distributions_keep_zeros(spark):
    rows = spark.createDataFrame([(["x", "x", "y"],), ([],), (None,), (["odd", "odder", "x"],)], "v array<string>")
    assert {tuple(r) for r in E.distribution(rows, F.col("v"), ["x", "y", "z"]).collect()} == {("x", 2), ("y", 1), ("z", 0), ("(off vocabulary)", 2)}
