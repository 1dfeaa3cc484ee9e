"""Ship policy, gates by field, nested options, suggestions: nulls, empty tables, odd trees."""

import json

from pyspark.sql import functions as F

from marlstone.operators import evaluation as E
from marlstone.operators import hierarchy, search
from marlstone.operators import tags as N


def test_shipped_values(spark):
    rows = spark.createDataFrame([(["a", "lock"], ["b", "a", "off", "b"]), (None, ["lock", "c"]), (["a"], None), ([], [])], "f array<string>, m array<string>")
    got = [r[0] for r in rows.select(N.shipped(F.col("f"), F.col("m"), ["a", "b", "c", "lock"], ["lock"])).collect()]
    assert got == [["a", "lock", "b"], ["c"], ["a"], []]


def test_subjects_of_concepts(spark):
    rows = spark.createDataFrame([(["Art"], {"Math": ["sums"], "Art": ["line"], "Music": [], "Bio": None}), (["Art"], None), (None, {"Math": ["x"]})], "i array<string>, c map<string,array<string>>")
    assert [r[0] for r in rows.select(N.with_subjects(F.col("i"), F.col("c"))).collect()] == [["Art", "Math"], ["Art"], None]


def test_gates(spark):
    sets = lambda rows: spark.createDataFrame(rows, "field string, id long, value string")
    truth = sets([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "p")])
    good = sets([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "p"), ("b", 1, "p")])
    assert E.field_gates(truth, truth, truth).collect() == E.field_gates(good, truth, truth).collect() == []
    bad = sets([("a", 1, "y"), ("b", 1, "p")])
    got = {tuple(r) for r in E.field_gates(bad, good, truth).select("gate", "field", "value").collect()}
    assert got == {("baseline", "a", None), ("macro", None, None), ("recall", "a", "x"), ("singleton", "a", "y")}
    assert [r.gate for r in E.field_gates(truth.limit(0), truth.limit(0), truth.limit(0)).collect()] == ["macro"]


def test_nested_options(spark):
    rows = [("r", 'say "r"', None, 3), ("s", "s", None, 1), ("b", "b", "r", 2), ("a", "a", "r", 2), ("c", "c", "r", 9), ("d", "d", "a", 1), ("deep", "deep", "d", 1), ("lost", "l", "none", 1), ("loop", "l", "loop", 1)]
    tree = spark.createDataFrame(rows, "key string, label string, parent string, n long")

    def folded(key, depth):
        below = sorted((x for x in rows if x[2] == key), key=lambda x: (-x[3], x[0]))
        own = next(x for x in rows if x[0] == key)
        return {"key": key, "label": own[1], "n": own[3], "children": [folded(x[0], depth - 1) for x in below] if depth else []}

    for depth in (0, 1, 2, 3, 5):
        got = {r.key: json.loads(r.options) for r in hierarchy.nested_options(tree, depth).collect()}
        assert got == {k: folded(k, depth) for k in ("r", "s")}
    assert hierarchy.nested_options(tree.limit(0), 2).collect() == []


def test_suggestions(spark):
    synonyms = [("soup", ["stew", "broth"], "bidirectional"), ("plant", ["sow"], "oneway")]
    assert search.suggestions("Plants stew", synonyms) == ["plants", "plant", "plantss", "stew", "soup"]
    assert search.suggestions("sow", synonyms) == ["sow"] and search.suggestions("  ") == []
    page = spark.createDataFrame([(1, "t")], "id long, title string")
    assert [tuple(r) for r in search.page_or_suggestions(page, "sow").collect()] == [(1, "t", None)]
    assert [tuple(r) for r in search.page_or_suggestions(page.limit(0), "sow").collect()] == [(None, None, "sow")]
    assert search.page_or_suggestions(page.limit(0), "").collect() == []
