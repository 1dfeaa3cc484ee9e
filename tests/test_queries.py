"""Every catalogue query with SQL against DuckDB, on the smallest driver tables."""

from pathlib import Path

import pytest

from marlstone import registry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, db, name):
    assert differences(spark, db, registry.QUERIES[name], registry.SQL[name], FOLDER) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "title", "rank", "total"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_samples_have_their_sizes_and_repeat(spark):
    q = registry.QUERIES
    for name, size in (("m3_stratified_sample", 120), ("m4_layered_sample", 60)):
        first, again = (sorted(map(tuple, q[name](spark, FOLDER).collect())) for _ in range(2))
        assert len(first) == size and first == again
    langs = [r.lang for r in q["m3_stratified_sample"](spark, FOLDER).collect()]
    total = spark.read.parquet(f"{FOLDER}/documents.parquet").groupBy("lang").count().collect()
    n = sum(r["count"] for r in total)
    assert all(abs(langs.count(r.lang) - 120 * r["count"] / n) <= len(total) for r in total)


def test_seeded_order_is_a_permutation(spark):
    rows = [r[0] for r in registry.QUERIES["m1_seeded_order"](spark, FOLDER).collect()]
    assert rows != sorted(rows) and sorted(rows) == [r[0] for r in spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey").orderBy("p_partkey").collect()]


def test_bootstrap_holds_the_mean(spark):
    r = registry.QUERIES["a34_bootstrap"](spark, FOLDER).first()
    mean = spark.read.parquet(f"{FOLDER}/orders.parquet").agg({"o_totalprice": "avg"}).first()[0]
    assert r.low < mean < r.high and r.low < r.mean < r.high
