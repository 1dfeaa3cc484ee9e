"""Near vectors against all pairs, and the recall of buckets."""

import math

import numpy as np
import pytest

from marlstone.operators import vectors as N


def clustered(seed, centres, members, size, spread):
    rnd = np.random.default_rng(seed)
    c = rnd.standard_normal((centres, size))
    out = (c[:, None] + spread * rnd.standard_normal((centres, members, size))).reshape(-1, size)
    return [(i, v.tolist()) for i, v in enumerate(out)]


def all_pairs(rows, least):
    out = {}
    good = [(i, np.array(v)) for i, v in rows if v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    for i, a in good:
        for j, b in good:
            if i < j and len(a) == len(b):
                c = float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))
                if c >= least:
                    out[i, j] = round(c, 9)
    return out


def run(spark, rows, pairs_of):
    reps = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    return {(r.x, r.y): round(r.cosine, 9) for r in pairs_of(reps).collect()}


ODD = [(9001, [0.0] * 24), (9002, []), (9003, None), (9004, [float("nan")] * 24), (9005, [1.0]), (9006, [2.0]), (9007, [-1.0]), (9008, [1.0, 1.0]), (9009, [2.0, 2.0])]


def test_exact_pairs_equal_all_pairs(spark):
    for size, least in ((24, 0.95), (24, 0.6), (3, 0.95)):
        rows = clustered(size, 25, 6, size, 0.25) + ODD
        told = all_pairs(rows, least)
        assert run(spark, rows, lambda r, least=least: N.exact_pairs(r, least)) == told and len(told) > 25


def test_recall_of_buckets(spark):
    rows = clustered(1, 120, 5, 48, 0.2) + ODD
    told = all_pairs(rows, 0.95)
    found = run(spark, rows, lambda r: N.bucketed_pairs(r, 0.95, recall=0.9))
    assert set(found.items()) <= set(told.items())
    assert len(told) > 500 and len(found) / len(told) >= 0.9
    assert run(spark, rows, lambda r: N.bucketed_pairs(r, 0.95, recall=0.999999)) == told


def test_plan_keeps_its_recall_at_any_size():
    for n in (2, 10**4, 10**9):
        for least, recall in ((0.95, 0.9), (0.8, 0.99)):
            bits, tables = N.bucket_plan(n, least, recall)
            assert 1 - (1 - (1 - math.acos(least) / math.pi) ** bits) ** tables >= recall - 1e-9
            assert bits >= math.log2(n) - N.MORE_BITS - 1


def test_report_counts_equal_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 0.01]), (6, None), (7, None), (8, [1.0, 0.0])]
    given = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, v array<double>, rows string")
    for pairs_of in (lambda r: N.exact_pairs(r, 0.95), lambda r: N.bucketed_pairs(r, 0.95, 0.999)):
        got = sorted((r.x, r.y, round(r.cosine, 3), r.x_rows, r.y_rows) for r in N.pair_report(given, "id", "v", pairs_of).collect())
        assert got == [(1, 2, 1.0, 3, 2), (1, 3, 1.0, None, None), (1, 8, 1.0, None, None), (2, 5, 1.0, None, None)]


@pytest.mark.parametrize("pairs_of", [N.exact_pairs, N.bucketed_pairs])
def test_empty_tables(spark, pairs_of):
    assert run(spark, [], pairs_of) == {} and run(spark, ODD[:4], pairs_of) == {}
