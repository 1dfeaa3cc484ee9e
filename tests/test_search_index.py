"""The stored index against the search over all items, merged batches, and what is read of it."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.operators import search as S
from marlstone.operators import search_index as X
from marlstone.streaming.derive import keep_batches, merge_batches

SYNONYMS = [("w3", ["w4", "w5 w6"], "bidirectional"), ("w7", ["w8"], "oneway")]


def sections():
    return {"A": F.col("title"), "D": F.col("body")}


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    text = lambda k: " ".join(f"w{int(rnd.expovariate(0.08))}" for _ in range(rnd.randint(0, k)))
    return [(i, text(4), None if i % 17 == 0 else text(30), ["a", "b", None][i % 3]) for i in range(n)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(rows_of(400), "id long, title string, body string, lang string").withColumn("langs", F.array("lang")).cache()


@pytest.fixture(scope="module")
def folder(items, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("index"))
    X.build(items, "id", "title", sections(), target, ["langs", "lang"], "body", block=16)
    return target


@pytest.mark.parametrize("query", ["w3", "w7 w1", "the w2 w99", "zzz", "", "the of", "w1 w2 w3 w4", "w10 w11", "W5! w5"])
def test_pages_equal_those_of_the_scan(spark, items, folder, query):
    cases = [(S.Request(query), None, None)]
    if query in ("w3", "the w2 w99"):
        cases += [(S.Request(query, {"langs": ["a"]}, size=7, offset=5), F.col("lang").isNotNull(), "body"), (S.Request(query, order="title"), None, "body")]
    for request, live, summary in cases:
        told = S.search(items, request, "id", "title", sections(), SYNONYMS, live, summary)
        found = X.search(spark, folder, request, SYNONYMS, live, summary is not None)
        exact = lambda df: [(r.id, r.title, round(r["rank"], 9), r.total) for r in df.collect()]
        assert exact(found) == exact(told)


def test_top_matches_skip_blocks(spark, items, folder):
    for query in ("w1", "w3 w2", "w1 w2 w5", "zzz", ""):
        groups = S.expand(query, SYNONYMS)
        told = []
        if groups:
            posts = S.postings(items, "id", sections())
            told = S.matched(posts, groups).filter(F.col("hits") == len(groups)).orderBy(F.desc("score"), "id").limit(9).collect()
        assert [(r.id, round(r.score, 9)) for r in X.top_matches(spark, folder, query, 9, SYNONYMS).collect()] == [(r.id, round(r.score, 9)) for r in told]


def test_a_search_reads_the_folders_of_its_words_only(spark, folder):
    lists = X._read(spark, folder, "word", ["w3"], "bigint")
    opened = {Path(f).parent.name for f in lists.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(opened) == 1 and len(list(Path(folder, "word").glob("bucket=*"))) > 10
    plan = lists._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(key" in plan or "EqualTo(key" in plan
    assert lists.groupBy("key", "block").count().filter("count > 1").count() == 0


def test_merged_batches_equal_the_last_rows(spark, tmp_path):
    first, second = rows_of(120, 3), [(i, "new " + t, b, g) for i, t, b, g in rows_of(160, 4)[80:]]
    kept = {r[0]: r for r in [*first, *second]}
    schema = "id long, title string, body string, lang string"
    for rows in (first, second):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        keep_batches(spark, f"{tmp_path}/in", schema, f"{tmp_path}/batches", f"{tmp_path}/state").awaitTermination()
    for _ in range(2):  # a repeated merge changes nothing
        merge_batches(spark, f"{tmp_path}/batches", f"{tmp_path}/index")
        now = spark.createDataFrame(list(kept.values()), schema)
        for query in ("new", "w1 w2", "w3"):
            told = S.search(now, S.Request(query, size=50), "id", "title", sections())
            assert X.search(spark, f"{tmp_path}/index", S.Request(query, size=50)).collect() == told.collect()


def test_an_empty_table_has_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, title string, body string")
    X.build(none, "id", "title", sections(), str(tmp_path))
    assert X.search(spark, str(tmp_path), S.Request("w1")).collect() == [] == X.top_matches(spark, str(tmp_path), "w1", 3).collect()


def test_blocks_are_made_where_items_lie_and_no_posting_is_shuffled(spark, tmp_path):
    rows = spark.createDataFrame(rows_of(1000, 5), "id long, title string, body string, lang string").repartitionByRange(4, "id")
    X.build(rows, "id", "title", sections(), str(tmp_path), block=64)
    for kind in ("word", "title"):
        lists = spark.read.parquet(f"{tmp_path}/{kind}")
        held = lists.groupBy("block").agg(F.min(F.array_min("ids")).alias("a"), F.max(F.array_max("ids")).alias("b")).collect()
        assert len(held) >= 1000 // 64 and max(r.b - r.a for r in held) < 64
    plan = S.postings(rows.sort("id").localCheckpoint(), "id", sections())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_lists_equal_plain_python(spark, tmp_path):
    texts = ["Größe größe a1-b2", "", None, "x", "ab ab abc", "\U0001f600 \U00020000z naïve İI", "  ,; ", "a b\nc a"]
    rows = spark.createDataFrame([(i, texts[i % 8], texts[(i * 3 + 1) % 8]) for i in range(40)], "id long, title string, body string").repartition(3)
    X.build(rows, "id", "title", sections(), str(tmp_path), summary="body", block=7)
    cut = {r.id: (r.a, r.b) for r in rows.select("id", F.expr("title").alias("t"), *[X.T.words(F.col(c)).alias(n) for c, n in (("title", "a"), ("body", "b"))]).collect()}
    grams = lambda ws: {f"  {w} "[i : i + 3] for w in ws for i in range(len(w) + 1)}
    told = {"word": set(), "title": set(), "summary": set()}
    for i, (a, b) in cut.items():
        told["word"] |= {(w, i, 1.0 if w in a else 0.1) for w in {*a, *b}}
        told["title"] |= {(g, i, float(len(grams(a)))) for g in grams(a)}
        told["summary"] |= {(g, i, float(len(grams(b)))) for g in grams(b)}
    for kind, wanted in told.items():
        found = X._entries(spark.read.parquet(f"{tmp_path}/{kind}")).collect()
        assert len(found) == len(wanted) and {(r.key, r.id, r.weight) for r in found} == wanted
        assert spark.read.parquet(f"{tmp_path}/{kind}").filter("best < array_max(weights) or n != size(ids)").isEmpty()


def test_rows_that_repeat_an_id_give_each_word_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "b c"), (1, "c", "a d"), (2, "d", None), (None, "e", "f"), (None, "f", "g")], "id long, title string, body string").repartition(3)
    wanted = {(1, "a", 1.0), (1, "b", 0.1), (1, "c", 1.0), (1, "d", 0.1), (2, "d", 1.0), (None, "e", 1.0), (None, "f", 1.0), (None, "g", 0.1)}
    found = S.postings(rows, "id", sections()).collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    X.build(rows, "id", "title", sections(), str(tmp_path))
    lists = X._entries(spark.read.parquet(f"{tmp_path}/word")).collect()
    assert len(lists) == len(wanted) and {(r.id, r.key, r.weight) for r in lists} == wanted
