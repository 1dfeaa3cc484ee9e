"""Self-join of documents by the Jaccard similarity of their word n-grams, vertically partitioned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents, small, written
from marlstone.llm.components import components
from marlstone.llm.slots import bits_for, slot_levels, text_bytes
from marlstone.llm.text_classes import text_classes

N = 5
#: An n-gram of more documents than this comes last in the global order.
MANY = 64
#: Fragments of the global order: ranges of the hash, within each of two classes of frequency.
RANGES = 4
SLICE = 1 << 20

_P = 0xD1B54A32D192ED03
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)]) for p in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which near numbers end up far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and UTF-8 texts in groups of about ``size`` bytes and 30,000 rows at most; null is empty."""
    for batch in batches:
        texts, low, held = [], 0, 0
        for k, t in enumerate(batch.column(1)):
            texts.append(b"" if not t.is_valid else t.as_buffer().to_pybytes())
            held += len(texts[-1])
            if held >= size or len(texts) == 30_000 or k == batch.num_rows - 1:
                yield batch.column(0).slice(low, len(texts)), texts
                texts, low, held = [], k + 1, 0


def shingle_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct ``n``-grams of each text, sorted by both.

    ASCII capitals are lowered; a text of fewer words is one n-gram, a text without words none.
    Words and n-grams are 64-bit hashes: two of them are taken as equal if their hashes are.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lens + 1) - lens - 1
    data = data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & ~np.r_[True, space[:-1]])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    word = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(begin, starts, "right") - 1
    seeds = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(n)]
    d, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(word) >= n:
        m = len(word) - n + 1
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h += word[k : k + m] * np.uint64(seeds[k])
        inside = doc[:m] == doc[n - 1 :]
        d, h = doc[:m][inside], mixed(h[inside])
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        own = [sum(int(word[first[i] + k]) * seeds[k] for k in range(count[i])) + 7919 * int(count[i]) & (1 << 64) - 1 for i in few]
        d, h = np.r_[d, few], np.r_[h, mixed(np.array(own, np.uint64))]
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.uint16), kind="stable")]
    d, h = d[order], h[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]
    return d[new], h[new]


def indexed(docs: DataFrame, levels: Broadcast) -> DataFrame:
    """(id, n, alone, core, prefix, parts): the n-gram count of each document and what its links can rest on.

    The global order puts n-grams of one document first, then others, then frequent ones, each
    by hash. ``prefix`` holds those of the first n - ceil(0.8 n) + 1 n-grams that may be in other
    documents; two similar sets share one of these. ``parts`` has all n-grams that may be in
    other documents, by fragment of the order. Both are null where the prefix is empty. ``alone`` counts
    the n-grams of one document; ``core`` is larger the more n-grams are frequent, up to 1000.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = levels.value
        for ids, texts in slices(batches):
            d, h = shingle_sets(texts)
            n = np.bincount(d, minlength=len(texts))
            rank = known.at_least(h, 0).astype(np.uint8) + known.at_least(h, 1)
            border = np.r_[0, np.cumsum(n)]
            prefix, parts = [], []
            alones, cores = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            signed = h.view(np.int64)
            for i in range(len(texts)):
                own, kind = signed[border[i] : border[i + 1]], rank[border[i] : border[i + 1]]
                p = len(own) - -(-4 * len(own) // 5) + 1 if len(own) else 0
                alone = alones[i] = int((kind == 0).sum())
                cores[i] = 500 * int(kind.sum()) // max(len(own), 1)
                if alone >= p:
                    prefix.append(None), parts.append(None)
                    continue
                one, two = own[kind == 1], own[kind == 2]
                prefix.append(np.r_[one, two][: p - alone])
                cuts = [x[(x.view(np.uint64) >> np.uint64(62)) == r] for x in (one, two) for r in range(RANGES)]
                parts.append(cuts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n.astype(np.int64)), pa.array(alones), pa.array(cores), pa.array(prefix, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.list_(pa.int64())))],
                ["id", "n", "alone", "core", "prefix", "parts"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return bounded_batches(docs).mapInArrow(run, f"id {kind}, n long, alone long, core long, prefix array<bigint>, parts array<array<bigint>>")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (x, y) of which 100 * intersection >= 80 * union, exactly.

    Each fragment of the order counts its own part of an overlap; the parts are summed per pair.
    """
    x = sets.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.posexplode("parts").alias("part", "hx")).filter(F.size("hx") > 0)
    y = sets.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.posexplode("parts").alias("part", "hy")).filter(F.size("hy") > 0)
    partial = pairs.select("x", "y").join(x, "x").join(y, ["y", "part"]).select("x", "y", "nx", "ny", F.size(F.array_intersect("hx", "hy")).alias("both"))
    total = partial.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum("both").alias("both"))
    return total.filter("100 * both >= 80 * (nx + ny - both)").select("x", "y")


def _near_sizes(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= 80 * F.greatest(a, b)


def _classes(given: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, bool]:
    """Classes of equal texts of the rows (id, text), each under a number of its own.

    Returns (id, rep, rows) of the different rows, ``rep`` being the number of their class and
    ``rows`` how many rows are equal; (id, text)
    of each class under its number; the numbers that occur there more than once, as their rows
    are repeated, or None; and whether numbers differ from the smallest id of the class. They do
    only if some id has several texts, each of which needs a number then: all such classes get
    one above the largest id.
    """
    keyed = written(text_classes(given).groupBy("id", "key", "rep").agg(F.count(F.lit(1)).alias("rows")))
    firsts = keyed.filter("id = rep")
    twice = written(firsts.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep"))
    renamed = twice.limit(1).count() > 0
    if renamed:
        top = int(keyed.agg(F.max("id")).first()[0])
        numbers = written(firsts.join(small(twice), "rep", "left_semi").select("key", (F.monotonically_increasing_id() + F.lit(top + 1)).alias("node")))
        numbered = keyed.join(small(numbers), "key", "left").select("id", "key", F.coalesce("node", "rep").alias("rep"), (F.col("id") == F.col("rep")).alias("first"), "rows")
        classes = written(numbered)
        copies = classes.filter("NOT first").select("id", "key")
        texts = given.withColumn("key", F.md5("text")).join(small(copies), ["id", "key"], "left_anti").join(small(numbers), "key", "left")
        reps = texts.select(F.coalesce("node", "id").alias("id"), "text")
        again = classes.filter("first AND rows > 1").select(F.col("rep").alias("id"))
    else:
        classes = keyed
        # one text per class: a shuffle-free anti join if the copies are few enough to be broadcast
        reps = given.join(small(keyed.filter("id <> rep").select("id"), 2_000_000), "id", "left_anti")
        again = firsts.filter("rows > 1").select("id")
    return classes.select("id", "rep", "rows"), reps, again if again.limit(1).count() else None, renamed


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document; ids must be integers.

    Documents link if the Jaccard similarity of their sets of distinct 5-grams is 0.8 or more;
    component_id is the smallest id that links lead to. Texts without words (null, empty) have
    an empty set and link with nothing, and so do rows with a null id. Equal texts are one class, of which the smallest id
    takes part. Rows that repeat an id and its text are rows of one document; other texts of the
    same id are documents of their own, each linked by its own text alone. Each row given is a row of the result.

    Candidates share an n-gram of their prefixes in a global order, rare n-grams first. In a
    group of documents with the same n-gram two are centres, one by its share of frequent
    n-grams, which the original of near copies has most of, and one by a hash of the id. Each
    document is compared with the centre of either kind that it shares most n-grams with; so a
    family of near copies joins after a number of comparisons in proportion to its size. Then
    each pair that still lies in two components is counted exactly if it has a common prefix
    n-gram from which on both have enough n-grams left for a similarity of 0.8 (the first
    common one always does), and if its common prefix n-grams allow it; no link between
    different components is lost, and links within one would not change it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = rows.filter("id IS NOT NULL")
    classes, reps, again, renamed = _classes(given)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, texts in slices(batches):
            yield shingle_sets(texts)[1]

    levels = slot_levels(reps, keys_of, bits_for(text_bytes(given, "text") / 7, 2), (2, MANY))
    index = written(indexed(reps, levels))
    levels.destroy()
    if again is not None:
        index = written(index.join(again, "id", "left_anti").union(index.join(again, "id", "left_semi").dropDuplicates(["id"])))
    sets = index.filter("prefix IS NOT NULL")
    posts = sets.select("id", "n", "alone", "core", F.posexplode("prefix").alias("at", "gram"))
    posts = posts.select("id", "n", "core", "gram", (F.col("n") - F.col("alone") - F.col("at")).alias("room"))
    shared = posts.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("gram")
    posts = written(posts.join(shared, "gram"))

    def prefix(n: Column) -> Column:
        return n - F.ceil(4 * n / 5) + 1

    # 1. each document against the one centre of its groups that it shares most n-grams with, for both kinds of centres
    hashed = F.xxhash64(F.lit(2), F.col("id"))
    first, second = F.max_by(F.struct("id", "n"), F.struct("core", hashed)), F.min_by(F.struct("id", "n"), hashed)
    centres = posts.groupBy("gram").agg(first.alias("c1"), second.alias("c2")).select("gram", F.posexplode(F.array("c1", "c2")).alias("nth", "c"))
    star = posts.join(centres, "gram").filter((F.col("id") != F.col("c.id")) & _near_sizes(F.col("n"), F.col("c.n")))
    star = star.groupBy("nth", "id", F.col("c.id").alias("centre")).agg(F.count(F.lit(1)).alias("grams"), F.max(F.greatest("n", "c.n")).alias("n"))
    star = star.filter(5 * F.col("grams") >= prefix(F.col("n")))  # the rest wait for the second step
    star = star.groupBy("nth", "id").agg(F.max_by("centre", F.struct("grams", "centre")).alias("centre"))
    star = star.select(F.least("id", "centre").alias("x"), F.greatest("id", "centre").alias("y")).distinct()
    near = components(linked(star, sets))

    # 2. every pair between two components
    held = posts.join(near, "id", "left").select("gram", "id", "n", "room", F.coalesce("label", "id").alias("label"))
    per = held.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed_grams = per.groupBy("gram").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    held = written(held.join(mixed_grams.select("gram", "main"), "gram"))
    # only documents of near sizes meet: bands of size, each a quarter wider than the last, beside their neighbours
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int")
    bands = F.explode(F.array(band - 1, band, band + 1)).alias("band")
    minor = held.filter("label <> main").select("gram", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("room").alias("rx"), F.col("label").alias("lx"), bands)
    other = held.select("gram", band.alias("band"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("room").alias("ry"), F.col("label").alias("ly"), "main")
    across = minor.join(other, ["gram", "band"]).filter(
        _near_sizes(F.col("nx"), F.col("ny")) & (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("main")) | (F.col("x") < F.col("y"))) & (9 * F.least("rx", "ry") >= 4 * (F.col("nx") + F.col("ny")))
    )
    across = written(across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}"))
    grams = F.size(F.array_intersect("px", "py"))
    rest = F.greatest(F.col("nx") - prefix(F.col("nx")), F.col("ny") - prefix(F.col("ny")))
    across = across.join(side("x"), "x").join(side("y"), "y").filter(9 * (grams + rest) >= 4 * (F.col("nx") + F.col("ny"))).select("x", "y")
    more = written(linked(across, sets))
    labelled = lambda c: near.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    bridge = more.join(labelled("x"), "x", "left").join(labelled("y"), "y", "left").select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y"))
    joined = components(bridge).select(F.col("id").alias("label"), F.col("label").alias("low"))
    # 3. classes of documents by their components
    final = near.select("id", "label").union(joined.join(near, joined["label"] == near["id"], "left_anti").select("label", F.col("label").alias("x")))
    final = final.join(joined, "label", "left").select(F.col("id").alias("rep"), F.coalesce("low", "label").alias("low"))
    sizes = index.select(F.col("id").alias("rep"), "n")
    grouped = classes.join(sizes, "rep").join(final, "rep", "left").select("id", "rows", "n", F.coalesce("low", "rep").alias("low"))
    if renamed:  # numbers of classes back to the smallest id of their component
        grouped = written(grouped)
        grouped = grouped.join(grouped.filter("n > 0").groupBy("low").agg(F.min("id").alias("least")), "low", "left").select("id", "rows", "n", F.col("least").alias("low"))
    grouped = grouped.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    grouped = grouped.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("low")).alias("component_id"))

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            n = np.bincount(shingle_sets(texts)[0], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), ids], ["id", "n_shingles", "component_id"])

    kind = rows.schema["id"].dataType.simpleString()
    return grouped.union(rows.filter("id IS NULL").mapInArrow(sizes_of, f"id {kind}, n_shingles long, component_id {kind}"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the number of their 5-grams and the component of their links."""
    return similar_groups(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), e AS (
  SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT DISTINCT a AS id, a AS r FROM e UNION SELECT id, b FROM reach JOIN e ON r = a
), low AS (
  SELECT id, min(r) AS r FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.r, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.id = d.doc_id
"""
