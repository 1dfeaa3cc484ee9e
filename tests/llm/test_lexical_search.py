"""Ranked search against plain sums over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from marlstone.llm import lexical_search as L
from tests.compare import connect, differences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best(docs, items, top=50):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in own:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def text_of(rnd, n):
    return rnd.choice([" ", "-", "\n"]).join(rnd.choice(["Wort", "mot", "ñandú", "Été", "x9", "the"]) + str(int(rnd.expovariate(0.05))) for _ in range(n)) + rnd.choice(["", " the" * 9, "!"])


def run(spark, docs, items, **kw):
    rows = spark.createDataFrame([(i, t, "z", "y") for i, t in docs], "doc_id long, text string, id string, qs string")
    asked = spark.createDataFrame([(i, t, "a") for i, t in items], "item_id long, text string, rank string")
    return sorted(map(tuple, L.search(rows.repartition(4), asked, **kw).select("item_id", "rank", "id", "score").collect()), key=repr)


def test_results_equal_all_scores(spark, monkeypatch):
    rnd = random.Random(2)
    docs = [(i, text_of(rnd, rnd.choice([1, 3, 40, 400]))) for i in range(300)]
    docs += [(300, docs[5][1]), (301, docs[5][1]), (302, None), (303, ""), (304, "?! -"), (None, docs[7][1] + " only"), (7, "mot1 mot2 again"), (400, " ".join(f"w{k}" for k in range(20_000)))]
    items = [(i, text_of(rnd, 12)) for i in range(8)] + [(8, None), (9, "..."), (10, docs[5][1]), (10, "w3 w19999 mot1"), (11, "nowhere")]
    told = best(docs, items, 7)
    assert run(spark, docs, items, top=7) == told and any(r[2] is None for r in told)
    monkeypatch.setattr(L, "ITEMS", 3)
    monkeypatch.setattr(L, "HELD", 100)
    assert run(spark, docs, items, top=7) == told


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_are_never_below_scores(spark):
    rnd = random.Random(4)
    docs = [text_of(rnd, rnd.choice([2, 30, 300])) for _ in range(200)]
    items = [terms(text_of(rnd, 15)) for _ in range(6)]
    counts = [Counter(terms(t)) for t in docs]
    df = Counter(t for c in counts for t in c)
    n_terms = sum(sum(c.values()) for c in counts)
    w = L.Wanted([[t.encode() for t in own] for own in items], {t.encode(): n for t, n in df.items()}, len(docs), n_terms)
    seen, close = 0, []
    for r in L.index(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).filter("slices IS NOT NULL").collect():
        for first, bounds in L.upper_bounds(w, np.array(r.n), np.array(r.top), r.rows, bytes(r.slices)):
            for q, row in enumerate(bounds):
                for i, bound in zip(r.ids, row, strict=True):
                    score = sum(x * w.share(counts[i][t.decode()], sum(counts[i].values())) for t, x in w.items[first + q] if t.decode() in counts[i])
                    assert bound >= score
                    seen += 1
                    close.append(bound <= 1.3 * score + 1)
    assert seen == len(docs) * len(items) and np.mean(close) > 0.8


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(spark, connect(folder), L.op13_lexical_search, L.SQL, folder) == ""
