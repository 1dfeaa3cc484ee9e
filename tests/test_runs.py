"""Broken and repeated runs against one unbroken run."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import runs

SCHEMA = "key string, outcome string, v long"


def step(rows, bad=()):
    return rows.select("name", F.when(F.col("name").isin(*bad), "failed").otherwise("done").alias("outcome"), (F.col("n") * 2).alias("v"))


def told(spark, target, run):
    return sorted((r.key, r.outcome, r.v) for r in runs.results(spark, target, run, SCHEMA).collect())


@pytest.fixture
def inputs(spark):
    return spark.createDataFrame([(f"k{i}", i) for i in range(60)] + [(None, 1)], "name string, n long")


def test_a_broken_run_ends_like_an_unbroken_one(spark, inputs, tmp_path):
    assert runs.carry_on(inputs, "name", step, f"{tmp_path}/one", "r") == 8
    one = told(spark, f"{tmp_path}/one", "r")
    assert len(one) == 60
    broken = f"{tmp_path}/two"
    calls = []

    def breaking(rows):
        calls.append(1)
        if len(calls) == 3:  # half of a batch is written, then its task fails
            bad = F.udf(lambda n: 1 // (n - n), "long")
            return step(rows).withColumn("v", F.when(F.col("v") > 40, bad("v")).otherwise(F.col("v")))
        return step(rows)

    with pytest.raises(Exception):
        runs.carry_on(inputs, "name", breaking, broken, "r")
    assert runs.finished_batches(spark, broken, "r", 0, 8) == [0, 1]
    assert runs.carry_on(inputs, "name", step, broken, "r", at_most=1) == 3
    before = len(calls)
    assert runs.carry_on(inputs, "name", breaking, broken, "r") == 8 and len(calls) == before + 5
    assert told(spark, broken, "r") == one
    assert runs.carry_on(inputs, "name", breaking, broken, "r") == 8 and len(calls) == before + 5  # nothing is left to do


def test_failed_and_new_inputs_are_tried_again(spark, inputs, tmp_path):
    target = str(tmp_path)
    runs.carry_on(inputs, "name", lambda r: step(r, ["k3", "k40"]), target, "r", batches=3)
    assert {(r.outcome, r.n) for r in runs.outcomes(runs.results(spark, target, "r", SCHEMA)).collect()} == {("done", 58), ("failed", 2)}
    seen = []

    def again(rows):
        seen.extend(r.name for r in rows.collect())
        return step(rows)

    more = inputs.union(spark.createDataFrame([("new", 7)], "name string, n long"))
    runs.carry_on(more, "name", again, target, "r", attempt=1, batches=3)
    assert sorted(seen) == ["k3", "k40", "new"]
    assert len(told(spark, target, "r")) == 61 and all(o == "done" for _, o, _ in told(spark, target, "r"))


def test_other_parameters_are_another_run(spark, inputs, tmp_path):
    a, b = runs.identity(prompt="x", size=1), runs.identity(prompt="x", size=2)
    assert a != b and a == runs.identity(size=1, prompt="x") and runs.identity(a="1", b="2") != runs.identity(a="12", b="")
    runs.carry_on(inputs, "name", step, str(tmp_path), a, batches=2)
    assert told(spark, str(tmp_path), b) == [] and len(told(spark, str(tmp_path), a)) == 60
    assert runs.carry_on(inputs.limit(0), "name", step, str(tmp_path), b, batches=2) == 2 and told(spark, str(tmp_path), b) == []
