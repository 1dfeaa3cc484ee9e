"""Column functions and operators on small tables: nulls, empties, repeats and edges."""

from pyspark.sql import functions as F

from marlstone.functions import filters as P
from marlstone.functions import text as T
from marlstone.operators import duplicates, evaluation, facets, hierarchy, requests, sampling, search, tags, workflow
from marlstone.operators.graph import components
from marlstone.sources import readers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def a(*values):
    return P.strings_lit(values)


def null(kind="string"):
    return F.lit(None).cast(kind)


def test_similarities_of_empty_texts(spark):
    r = one(spark, T.trigram_similarity(F.lit(""), F.lit("?!")), T.jaccard(a(), a(), 1.0), T.edit_ratio(F.lit(""), F.lit("")), T.word_jaccard(null(), F.lit("a")))
    assert list(r) == [0.0, 1.0, 1.0, 0.0]
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    r = one(spark, T.cosine(v(0, 0), v(1, 0)), T.cosine(v(1), v(1, 0)), T.cosine(v(2, 0), v(4, 0)))
    assert list(r) == [0.0, 0.0, 1.0]


def test_titles_and_trigrams(spark):
    r = one(spark, T.normal_title(F.lit(" A\x0b B\t\tc ")), F.array_sort(T.trigrams(F.lit("Cat"))), T.content_hash(F.lit("A  b")) == T.content_hash(F.lit(" a B ")))
    assert list(r) == ["a b c", ["  c", " ca", "at ", "cat"], True]


def test_filters_on_nulls(spark):
    none = F.lit(None).cast("array<string>")
    r = one(spark, P.any_of(none, ["x"]), P.any_of(none, []), P.any_of(a("X"), ["x"], fold=True), P.safe_name(F.lit("a@b")), P.safe_name(null()), P.safe_name(F.lit("Ann B")))
    assert list(r) == [False, True, True, False, False, True]
    assert P.with_aliases(["Outdoor", "x"], P.PLACES, fold=True) == ["outdoor", "both", "x"]


def test_tag_functions(spark):
    f = tags.floor(a("x", "Red", "b", "a"), ["x"], {"red": "a"}, ["a", "b"])
    r = one(spark, f, tags.reconcile(a("a", "b"), a("b", "c"), a("c", "d", "e"), ["e"]), tags.seasons(a("All Year", "fall")), T.json_strings(F.lit("null")), T.folded(a(" A", "a", "z"), {"a": "b"}))
    assert [tuple(x) for x in r[0]] == [("a", "exact"), ("b", "exact")]
    assert list(r)[1:] == [["a", "d"], ["Fall", "Winter", "Spring", "Summer"], [], ["b", "z"]]
    again = one(spark, T.folded(T.folded(a("A", "z"), {"a": "b"}), {"a": "b"}))
    assert again[0] == ["b", "z"]


def test_expansion_of_queries():
    synonyms = [("cat", ["tom cat"], "bidirectional"), ("dgo", ["dog"], "typo_correction")]
    assert search.expand("The CAT & dgo dog", synonyms) == [[["cat"], ["tom", "cat"]], [["dgo"], ["dog"]], [["dog"]]]
    assert search.expand("the of a") == []
    assert search.prefix_terms("beans bus beans") == ["bean", "bus"]


def test_search_without_words_and_past_the_end(spark):
    rows = spark.createDataFrame([(1, "b", "x y", ["t"]), (2, "a", None, None), (3, None, "z", [])], "id long, title string, body string, tags array<string>")
    found = lambda **k: search.search(rows, search.Request(**k), "id", "title", {"A": F.col("title"), "D": F.col("body")})
    assert [r.id for r in found(query="the").collect()] == [3, 2, 1]
    assert found(query="x", facets={"tags": ["t"]}).first().id == 1
    assert found(query="x", offset=50).count() == 0


def test_typed_queries():
    cases = {
        "3rd Grade, soup": ("soup", ["3"]), "lessons about the garden for Grades K - 2": ("garden", ["K", "1", "2"]), "grades 5 to 3 beans": ("beans", ["3", "4", "5"]), "grade 9 corn": ("grade 9 corn", []),
        "grades 3-9 corn": ("grades 3-9 corn", []), "pre-k kindergarten 3K": ("", ["3K", "PK", "K"]), "lessons for the": ("lessons for the", []), "grade second graders?": ("graders?", ["2"]), "3 sisters": ("3 sisters", []),
        "grades three through fifth.": ("", ["3", "4", "5"]), "  ": ("", []), "grades 3 to 9": ("to 9", ["3"]), "K-2 corn": ("K-2 corn", []),
    }
    assert {q: requests.parsed(q) for q in cases} == cases and requests.parsed(None) == ("", [])
    assert requests.request_of("grade 2 corn", {}, "level").facets == {"level": ["2"]}
    assert requests.request_of("grade 2 corn", {"level": ["5"]}, "level").facets == {"level": ["5"]}


def test_phrase_rules_and_summaries(spark):
    rows = spark.createDataFrame([(1, "bake pie", "x", "taste"), (2, "pie test", "y", "z"), (3, "soup", "taste test", "q"), (4, None, None, None)], "id long, title string, summary string, body string")
    parts = {"A": F.col("title"), "D": F.col("body")}
    rules = {"taste test": ([[["bake"], ["pie"]]], ("A",))}
    found = search.search(rows, search.Request(" Taste  TEST"), "id", "title", parts, rules=rules).collect()
    assert [(r.id, r.rank, r.total) for r in found] == [(1, 1.0, 2), (2, 1.0, 2)]
    found = search.search(rows, search.Request("taste test"), "id", "title", parts | {"B": F.col("summary")}, summary="summary").collect()
    assert [r.id for r in found] == [2, 3, 1] and abs(found[1].rank - 0.8) < 1e-9


def test_cycles_of_parents_end(spark):
    tree = spark.createDataFrame([("a", "a", "b"), ("b", "b", "c"), ("c", "c", "a"), ("d", "d", "a"), ("e", "e", None), ("f", "f", "f")], "key string, label string, parent string")
    got = {(r.key, r.ancestor): r.steps for r in hierarchy.closure(tree).collect()}
    assert got[("d", "c")] == 3 and got[("a", "c")] == 2 and got[("a", "a")] == 0 and len(got) == 3 * 3 + 4 + 1 + 1
    assert sorted(r.key for r in hierarchy.cycles(tree).collect()) == ["a", "b", "c", "f"]


def test_facet_counts_leave_the_own_filter_out(spark):
    rows = spark.createDataFrame([(["a"], ["x"]), (["b"], ["x"]), (["b"], ["y"]), (None, ["x"]), (["a", "a"], None)], "c array<string>, d array<string>")
    got = {(r.category, r.value): r.n for r in facets.true_counts(rows, ["c", "d"], {"c": ["a"], "d": ["x"]}).collect()}
    assert got == {("c", "a"): 1, ("c", "b"): 1, ("d", "x"): 1}


def test_closure_of_a_chain_and_components(spark):
    tree = spark.createDataFrame([(str(i), f"l{i}", str(i - 1) if i else None) for i in range(9)], "key string, label string, parent string")
    chain = hierarchy.closure(tree)
    assert chain.count() == 45 and chain.agg(F.max("steps")).first()[0] == 8
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 20, 2)] + [(1, 2), (3, 4), (30, 31)], "x long, y long")
    got = {r.id: r.label for r in components(links).collect()}
    assert got[5] == 0 and got[7] == 6 and got[31] == 30


def test_trigram_pairs_equal_brute_force(spark):
    titles = ["red ring", "red rings", "red rung", "blue bolt", "blu bolt", "", None, "red ring", "a b c d e f", "f e d c b a"]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")

    def grams(t):
        return {("  " + w + " ")[i : i + 3] for w in (t or "").split() for i in range(len(w) + 1)}

    want = set()
    first = {t: i for i, t in reversed(list(enumerate(titles)))}
    for s, i in first.items():
        for t, j in first.items():
            g, h = grams(s), grams(t)
            if i < j and g and h and len(g & h) / len(g | h) >= 0.55:
                want.add((i, j))
    assert {(r.x, r.y) for r in duplicates.trigram_pairs(rows, "id", "title").collect()} == want


def test_metrics_without_a_base_are_null(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, value string")
    t = spark.createDataFrame([(1, "a"), (1, "c")], "id long, value string")
    got = {r.value: (r.precision, r.recall) for r in evaluation.label_metrics(p, t).collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.0, None), "c": (None, 0.0)}


def test_samples(spark):
    rows = spark.range(100).select("id", (F.col("id") < 90).cast("string").alias("s"))
    assert sampling.stratified(rows, "id", "s", 10).count() == 10
    assert sampling.stratified(rows, "id", "s", 500).count() == 100
    assert sampling.stratified(rows.filter("false"), "id", "s", 5).count() == 0


def test_workflow(spark):
    old = spark.createDataFrame([(1, "a", 3), (2, None, 1)], "key long, name string, version int")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (1, None)], "key long, name string")
    got = {r.key: (r.name, r.version, r.status) for r in workflow.decided(old, new, "key", ["name"]).collect()}
    assert got == {1: ("a", 4, "updated"), 2: ("b", 2, "updated"), 3: ("c", 1, "inserted")}
    assert one(spark, workflow.first_line(F.lit("\n---\n[x]\nSummary: s\n T \nz")))[0] == "T"


def test_worksheets_and_scorecard(spark, tmp_path):
    (tmp_path / "a.csv").write_text('key,v\n1,"x ""q"", y"\n2,b\n')
    (tmp_path / "b.csv").write_text("key,v\n2,c\n3,d\n")
    rows, conflicts = readers.worksheets(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "key", ["key", "v"])
    assert {tuple(r) for r in rows.collect()} == {("1", 'x "q", y'), ("3", "d")} and [r.key for r in conflicts.collect()] == ["2"]
    assert readers.scorecard(spark.createDataFrame([(1, 0.5)], "n long, f double"), "T").endswith("| 1 | 0.500 |\n")
