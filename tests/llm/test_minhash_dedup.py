"""Near duplicates by signatures against all pairs of whole sets."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import minhash_dedup as M
from tests.compare import connect, differences
from tests.llm.test_corpus_operators import WORD, near_copies


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} - {()}


def linked(rows):
    """(id, size, component) of rows with unique or repeated ids, by all pairs of texts."""
    sets, low = [shingles(t) for _, t in rows], [i for i, _ in rows]
    index = {}
    for k, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(k)
    edges = [[] for _ in rows]
    for k, s in enumerate(sets):
        both = {}
        for g in s:
            for j in index[g]:
                both[j] = both.get(j, 0) + 1
        edges[k] = [j for j, c in both.items() if 100 * c >= 80 * (len(s) + len(sets[j]) - c)]
    done = set()
    for k in range(len(rows)):
        if k in done:
            continue
        part, todo = {k}, [k]
        while todo:
            for j in edges[todo.pop()]:
                if j not in part:
                    part.add(j), todo.append(j)
        least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
        for j in part:
            low[j] = least if sets[j] and rows[j][0] is not None else rows[j][0]
        done |= part
    return sorted(((i, len(s), c) for (i, _), s, c in zip(rows, sets, low, strict=True)), key=repr)


def run(spark, rows):
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)).collect()
    assert all(r.kept == (r.id is None or r.id == r.component_id) for r in got)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=repr)


def test_components_equal_those_of_all_pairs(spark):
    rows = list(enumerate(near_copies(6, 300)))
    rnd = random.Random(7)
    template = [f"t{k}" for k in range(60)]
    for k in range(150):  # a family of unlike members: two thirds are common
        rows.append((1000 + k, " ".join(template + [f"m{rnd.randrange(40)}" for _ in range(30)])))
    center = [f"c{k}" for k in range(80)]
    for k in range(150):  # a family whose members are similar to its centre, some only to it
        words = list(center)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(80)] = f"e{k}"
        rows.append((2000 + k, " ".join(words)))
    told = linked(rows)
    assert run(spark, rows) == told and len({c for _, _, c in told}) < len(rows) - 100


def test_pairs_of_a_family_by_their_differences(spark):
    rnd = random.Random(3)
    base = rnd.sample(range(10_000), 100)
    sets = {0: set(base)}
    for k in range(1, 120):  # far from the centre, some near each other
        own = set(sets[rnd.randrange(1, k)]) if k > 40 and rnd.random() < 0.5 else set(base)
        for _ in range(rnd.randint(4, 16)):
            own.discard(rnd.choice(base))
            own.add(rnd.randrange(10_000, 10_400))
        sets[k] = own
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    label = {k: 0 if near(sets[0], v) else k for k, v in sets.items()}
    kin = spark.createDataFrame([(k, len(v), label[k], 0) for k, v in sets.items() if k], "id long, n int, label long, centre long")
    held = spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "id long, grams array<bigint>")
    got = {tuple(sorted((r.x, r.y))) for r in M.within_families(kin, held).collect()}
    told = {(a, b) for a in sets for b in sets if 0 < a < b and label[a] != label[b] and near(sets[a], sets[b])}
    assert told <= got and len(told) > 20 and len(got) < 0.3 * 119 * 118 / 2


def test_nulls_and_repeated_ids(spark):
    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(3, own[0]), (5, own[0]), (5, own[1]), (9, own[1] + " more"), (3, own[0]), (5, None), (5, ""), (8, "one"), (7, "ONE"), (20, own[2]), (20, " ")]
    assert run(spark, rows) == linked(rows)
    assert run(spark, [*rows, (None, own[0]), (None, None)]) == sorted([*linked(rows), (None, 29, None), (None, 0, None)], key=repr)
    assert run(spark, []) == []


def test_long_texts(spark):
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(4000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3000])), (3, " ".join(words[:30_000]))]
    assert [c for _, _, c in run(spark, rows)] == [1, 1, 3]


def test_least_matches_follow_the_posterior():
    for size in M.BATCHES:
        x = (np.arange(200_000) + 0.5) / 200_000
        above = []
        for m in range(size + 1):
            log = math.lgamma(size + 2) - math.lgamma(m + 1) - math.lgamma(size - m + 1) + m * np.log(x) + (size - m) * np.log1p(-x)
            above.append(float(np.exp(log)[x >= 0.8].mean() * 0.2))
        least = next(m for m, p in enumerate(above) if p >= M.MISS)
        assert M.least_matches(size) == least and 0 < least < 0.8 * size


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 1 << 63, 30_000).astype(np.uint64) * np.uint64(2)
    for share in (0.2, 0.5, 0.8):
        both = int(1000 * 2 * share / (1 + share))
        a, b = np.sort(pool[:1000]), np.sort(np.r_[pool[:both], pool[5000 : 6000 - both]])
        sigs = M.signatures(np.repeat([0, 1], 1000), np.r_[a, b], 2)
        assert abs((sigs[0] == sigs[1]).mean() - share) < 0.12
    assert (M.banded(sigs)[0] == M.banded(sigs)[1]).sum() > 3


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(spark, connect(folder), M.op11_minhash_dedup, M.SQL, folder) == ""
