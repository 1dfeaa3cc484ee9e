"""Periodic runs against a scan over all periods, and the query against its contract in plain Python."""

import hashlib
import random
import re
import zlib

from marlstone.llm import periodic_runs
from tests.compare import connect, differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found[i, j - i + q] = min(q, found.get((i, j - i + q), q))
            i = j + 1 if j == i else j
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    few, out = rnd.choice([1, 2, 3, 30]), []
    for _ in range(rnd.randint(0, 7)):
        unit = [f"é{rnd.randrange(few)}" for _ in range(rnd.randint(1, 6))]
        out += unit * rnd.choice([1, 1, 3, 4, 5, 9]) + unit[: rnd.randint(0, len(unit))]
    return out


def test_runs_of_words():
    rnd = random.Random(5)
    for _ in range(400):
        texts = [repetitive(rnd) for _ in range(rnd.randint(1, 4))]
        assert periodic_runs.runs_of([[w.encode() for w in t] for t in texts]) == [every_run(t) for t in texts]


def test_long_texts():
    assert periodic_runs.runs_of([[b"a"] * 60_000, [b"%d" % (i % 1000) for i in range(40_500)]]) == [[(0, 60_000, 1)], [(0, 40_500, 1000)]]


def test_rows_of_any_kind(spark):
    texts = ["a b " * 4, None, "", " \n", "x " + "y\t" * 7 + "z", "a b " * 4, "A a A a A a A a"]
    rows = spark.createDataFrame([(None if i == 6 else f"k{i % 5}", t, 1, "r") for i, t in enumerate(texts)], "doc_id string, text string, id int, runs string")
    got = sorted(((r.id or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(rows).collect()), key=repr)
    assert got == sorted(
        [("k0", 8, [(0, 8, 2)], "a b"), ("k1", 0, [], ""), ("k2", 0, [], ""), ("k3", 0, [], ""), ("k4", 9, [(1, 7, 1)], "x y z"), ("k0", 8, [(0, 8, 2)], "a b"), ("", 8, [(0, 8, 2)], "A a")], key=repr
    )
    assert periodic_runs.periodic_runs(rows.limit(0)).collect() == []


def contract(doc_id, text):
    w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = every_run(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_keeps_its_contract(spark, tmp_path):
    rnd = random.Random(8)
    texts = [" ".join(repetitive(rnd)) for _ in range(150)] + [" ".join(str(rnd.randrange(9)) for _ in range(k)) for k in range(60)] + [None, "", "one"]
    rows = [(i * 7, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(contract(i, t) for i, t, _ in rows)
    assert any(r[1] > 1 for r in map(tuple, got.select(names).collect()))


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(spark, connect(folder), periodic_runs.op12_periodic_runs, periodic_runs.SQL, folder) == ""
