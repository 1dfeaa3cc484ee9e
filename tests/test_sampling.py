"""Greedy cover against one row after another, and the bootstrap against its law."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import evaluation as E
from marlstone.operators import sampling as M


def one_after_another(rows, cover, have, seed):
    held, out = dict(have), []
    left = {i: set(v or ()) - {None} for i, v in rows}
    due = {v: cover if have else min(cover, sum(v in s for s in left.values())) for s in left.values() for v in s}
    drawn = {i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest() for i in left}
    while True:
        gain = lambda i: sum(held.get(v, 0) < due[v] for v in left[i])
        i = min(left, key=lambda i: (-gain(i), drawn[i], i), default=None)
        if i is None or not gain(i):
            return out
        out.append((i, gain(i)))
        for v in left.pop(i):
            held[v] = held.get(v, 0) + 1


@pytest.mark.parametrize(("cover", "kinds"), [(1, 8), (2, 30), (3, 60)])
def test_greedy_cover_equals_the_sequence(spark, cover, kinds):
    rnd = random.Random(kinds)
    rows = [(i, [f"v{int(kinds * rnd.random() ** 2)}" for _ in range(rnd.randint(0, 5))]) for i in range(120)] + [(500, None), (501, [None])]
    given = spark.createDataFrame(rows, "item long, tags array<string>")
    got = M.greedy_cover(given, "item", "tags", cover, seed=4)
    assert sorted((r.id, r.gain) for r in got.collect()) == sorted(one_after_another(rows, cover, {}, 4))
    have = spark.createDataFrame([("v0", 2), ("v1", 1)], "value string, n long")
    got = M.greedy_cover(given, "item", "tags", cover, have, seed=4)
    assert sorted((r.id, r.gain) for r in got.collect()) == sorted(one_after_another(rows, cover, {"v0": 2, "v1": 1}, 4))


def test_layered_samples_keep_their_size(spark):
    rows = spark.createDataFrame([(i, [f"t{i % 40}"], i % 7 == 0, i % 3) for i in range(200)], "id long, tags array<string>, odd boolean, part int")
    for size in (0, 5, 30, 90, 500):
        got = M.layered(rows, "id", "tags", F.when(F.col("odd"), "odd"), "part", size).collect()
        assert len(got) == min(size, 200) == len({r.id for r in got})
    assert M.layered(rows.limit(0), "id", "tags", F.when(F.col("odd"), "odd"), "part", 9).collect() == []


def test_each_round_draws_as_many_as_there_are_rows(spark):
    ones = spark.range(1000).select("id", F.lit(1).alias("v"))
    for block in (64, 1 << 16):
        sums, rows = E.bootstrap_sums(ones, "v", 50, 3, block)
        assert rows == 1000 and [r.total for r in sums.collect()] == [1000.0] * 50


def test_draws_follow_their_law():
    sizes = np.array([3, 0, 5, 2])
    parts = np.stack([E.block_draws(sizes, b, 40_000, 1) for b in range(4)])
    assert (parts.sum(axis=0) == 10).all() and (parts[1] == 0).all()
    p = sizes / 10
    assert np.abs(parts.mean(axis=1) - 10 * p).max() < 0.05
    assert np.abs(np.cov(parts) - 10 * (np.diag(p) - np.outer(p, p))).max() < 0.1


def test_interval_and_empty_tables(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 3600, (F.col("id") * 7919 % 1000).cast("double")).alias("v"))
    r = E.bootstrap_mean(rows, "v").first()
    mean, deviation = rows.agg(F.avg("v"), F.stddev_pop("v") / F.sqrt(F.count("v"))).first()
    assert abs(r.mean - mean) < 0.2 * deviation and abs(r.low - mean + 1.96 * deviation) < 0.3 * deviation and abs(r.high - mean - 1.96 * deviation) < 0.3 * deviation
    assert tuple(E.bootstrap_mean(rows.limit(0), "v").first()) == (None, None, None)
