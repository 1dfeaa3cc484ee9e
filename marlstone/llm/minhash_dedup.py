"""Near duplicates by banded MinHash signatures, sequential Bayesian pruning and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents, small, written
from marlstone.llm.components import components
from marlstone.llm.ngram_join import _classes, _near_sizes, mixed, shingle_sets, slices

#: Words of a shingle.
N = 2
#: A similarity of 0.8 is missed by all bands with a probability of (1 - 0.8 ** ROWS) ** BANDS, 5e-6.
BANDS, ROWS = 40, 6
#: Signature numbers that have been compared after each batch, and the posterior probability of a
#: similarity of 0.8 or more below which a pair is dropped.
BATCHES, MISS = (32, 64, 128, 240), 1e-6
#: What rounding may take from a count that is needed.
EPS = 1e-9
#: Hash functions are applied to so many shingles at a time.
STEP = 1 << 16

_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint64).astype(np.uint32) | np.array([[0], [1]], np.uint32)
_MIX = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(doc: np.ndarray, shingle: np.ndarray, size: int) -> np.ndarray:
    """(size, BANDS * ROWS) smallest hashes of each document's shingles; rows of documents without any are zero."""
    out = np.zeros((size, BANDS * ROWS), np.uint32)
    if not len(doc):
        return out
    h = (shingle >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for low in range(0, len(first), 1024):
        some = first[low : low + 1024]
        end = first[low + 1024] if low + 1024 < len(first) else len(h)
        own, at = h[some[0] : end], some - some[0]
        for k in range(BANDS * ROWS):
            out[doc[some], k] = np.minimum.reduceat((own ^ _SEEDS[0, k]) * _SEEDS[1, k], at)
    return out


def banded(sigs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys: documents with an equal key agree in all rows of a band."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros((len(sigs), BANDS), np.uint64)
    for k in range(ROWS):
        keys += parts[:, :, k] * _MIX[k]
    return mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def index(docs: DataFrame) -> DataFrame:
    """(id, n, keys, sig) of the rows (id, text): number of shingles, keys of the bands, and a byte of each smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            d, h = shingle_sets(texts, N)
            sigs = signatures(d, h, len(texts))
            keys = pa.array(banded(sigs).view(np.int64).reshape(-1))
            told = pa.array(((sigs * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).view(np.int8).reshape(-1))
            border = lambda k: pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.bincount(d, minlength=len(texts)).astype(np.int64)), pa.ListArray.from_arrays(border(BANDS), keys), pa.ListArray.from_arrays(border(BANDS * ROWS), told)],
                ["id", "n", "keys", "sig"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return bounded_batches(docs).mapInArrow(run, f"id {kind}, n long, keys array<bigint>, sig array<tinyint>")


def shingled(docs: DataFrame) -> DataFrame:
    """(id, grams) of the rows (id, text): the whole set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            d, h = shingle_sets(texts, N)
            border = np.r_[0, np.cumsum(np.bincount(d, minlength=len(texts)))]
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(h.view(np.int64)))], ["id", "grams"])

    kind = docs.schema["id"].dataType.simpleString()
    return bounded_batches(docs).mapInArrow(run, f"id {kind}, grams array<bigint>")


def least_matches(compared: int, miss: float = MISS, similar: float = 0.8) -> int:
    """The fewest of ``compared`` equal hashes at which a similarity of ``similar`` is believed in with ``miss`` or more.

    With a uniform prior the similarity given m matches is Beta(m + 1, compared - m + 1), whose
    weight above ``similar`` is the chance of at most m in compared + 1 draws of that rate.
    """
    below = 0.0
    for m in range(compared + 1):
        below += math.comb(compared + 1, m) * similar**m * (1 - similar) ** (compared + 1 - m)
        if below >= miss:
            return m
    return compared


def believed(a: Column, b: Column) -> Column:
    """Whether two signatures are still believed to be similar after each batch; a later batch is only looked at then."""
    test = None
    for size in BATCHES:
        same = F.aggregate(F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        step = same >= least_matches(size)
        test = step if test is None else test & step
    return test


def verified(pairs: DataFrame, held: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (x, y) of which 100 * intersection >= 80 * union, after pruning by signatures, exactly on whole sets."""
    side = lambda c: held.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    left = written(pairs.join(side("x"), "x").join(side("y"), "y").filter(believed(F.col("sx"), F.col("sy"))).select("x", "y", "nx", "ny"))
    ids = written(left.select(F.col("x").alias("id")).union(left.select("y")).distinct())
    sets = written(shingled(texts.join(small(ids, 1_000_000), "id", "left_semi")).dropDuplicates(["id"]))
    a, b = sets.select(F.col("id").alias("x"), F.col("grams").alias("gx")), sets.select(F.col("id").alias("y"), F.col("grams").alias("gy"))
    both = left.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", F.size(F.array_intersect("gx", "gy")).alias("both"))
    return both.filter("100 * both >= 80 * (nx + ny - both)").select("x", "y")


def within_families(kin: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y): the pairs of different labels among the rows (id, n, label, centre) of one centre that may be similar; no other pair is.

    Members of a family are compared by how they differ from its centre c: R of its shingles are
    missing and others are added. What two members share is |c| - |Rx| - |Ry| and the differences
    that they share, so similar ones share at least u(x) + u(y) differences, with u = 4 n / 9 + |R| - |c| / 2. Those
    similar to c have u <= |c| / 18 and one label, so one of a pair has more, and u is never below -|c| / 18. The
    differences go from rare to frequent, and pairs meet in the prefixes that this leaves, with
    room enough after the place where they meet.
    """
    own, centre = sets.select("id", "grams"), sets.select(F.col("id").alias("centre"), F.col("grams").alias("base"))
    apart = kin.join(own, "id").join(centre, "centre").select(
        "id", "centre", "label", (4 * F.col("n") / 9 + F.size(F.array_except("base", "grams")) - F.size("base") / 2).alias("u"), (F.size("base") / 18).alias("step"),
        F.concat(F.array_except("base", "grams"), F.array_except("grams", "base")).alias("d"),
    )
    apart = written(apart.filter(F.size("d") > 0))
    each = apart.select("id", "centre", "label", "u", "step", F.size("d").alias("size"), F.explode("d").alias("gram"))
    shared = each.groupBy("centre", "gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    each = written(each.join(shared, ["centre", "gram"]))
    rank = F.row_number().over(Window.partitionBy("centre", "id").orderBy("df", "gram"))
    rest = each.groupBy("centre", "id").agg(F.count(F.lit(1)).alias("rest"))
    # differences of one member alone come before all others, so they only move the places of the rest
    placed = each.withColumn("rank", rank).join(rest, ["centre", "id"]).withColumn("at", F.col("rank") + F.col("size") - F.col("rest"))
    far = F.col("u") > F.col("step") + EPS
    least = F.greatest(F.ceil(F.col("u") + F.when(far, -F.col("step")).otherwise(F.col("step")) - EPS), F.lit(1))
    placed = written(placed.withColumn("far", far).filter(F.col("at") <= F.col("size") - least + 1).select("centre", "gram", "id", "label", "u", "far", (F.col("size") - F.col("at") + 1).alias("room")))
    x, y = (placed.select("centre", "gram", *[F.col(c).alias(c + k) for c in ("id", "label", "u", "far", "room")]) for k in ("1", "2"))
    met = x.filter("far1").join(y, ["centre", "gram"]).filter((F.col("label1") != F.col("label2")) & (~F.col("far2") | (F.col("id1") < F.col("id2"))) & (F.least("room1", "room2") >= F.col("u1") + F.col("u2") - EPS))
    return met.select(F.col("id1").alias("x"), F.col("id2").alias("y")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; ids must be integers.

    Documents link if the Jaccard similarity of their sets of distinct 2-word shingles is 0.8 or
    more (ASCII capitals lowered; a text of fewer words is one shingle); component_id is the
    smallest id that links lead to, and the rows with that id are kept. Texts without words (null, empty)
    have an empty set, link with nothing and are kept, and so are rows with a null id, whose
    component is null. Equal texts are one class, of which the smallest id takes part. Rows that repeat an id and
    its text are rows of one document; other texts of an id are documents of their own. Other
    columns don't matter; an empty table gives an empty table.

    Candidates agree in a band of their signatures and are of near sizes. In a bucket two
    documents are centres: the one in the fullest buckets altogether, and one by a hash of its id.
    Each document is compared with the centre of either kind that it shares most buckets with, so
    a family of near copies joins after comparisons in proportion to its size. Then the pairs of a
    bucket that still lie in two components are compared, within bands of size and if the shingles
    that more than one of these documents has leave room for a similarity of 0.8. Pairs that were compared
    with the same centre don't meet by bucket but by their shared differences from it (:func:`within_families`),
    so a large family of copies too far from their original isn't compared in pairs. Each compared pair
    goes through batches of its signatures, is dropped once its posterior similarity is too
    low, and links only if the whole sets say so. What is left to cost comparisons in the square of a
    group are documents that share buckets and most shingles with many others and yet link with few.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    given = rows.filter("id IS NOT NULL")
    classes, reps, again, renamed = _classes(given)
    held = written(index(reps))
    if again is not None:
        held = written(held.join(again, "id", "left_anti").union(held.join(again, "id", "left_semi").dropDuplicates(["id"])))
    posts = held.filter("n > 0").select("id", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("members")).filter("a < b").select("key", "members")
    posts = written(posts.join(shared, "key"))
    # 1. each document against the centre of either kind that it shares most buckets with
    popular = posts.groupBy("id").agg(F.sum("members").alias("fame"))
    famed = posts.join(popular, "id")
    hashed = F.xxhash64(F.lit(3), F.col("id"))
    one, two = F.max_by(F.struct("id", "n"), F.struct("fame", hashed)), F.min_by(F.struct("id", "n"), hashed)
    centres = written(famed.groupBy("key").agg(one.alias("c1"), two.alias("c2"))).select("key", F.posexplode(F.array("c1", "c2")).alias("nth", "c"))
    star = posts.join(centres, "key").filter((F.col("id") != F.col("c.id")) & _near_sizes(F.col("n"), F.col("c.n")))
    star = star.groupBy("nth", "id", F.col("c.id").alias("centre")).agg(F.count(F.lit(1)).alias("bands"))
    star = written(star.groupBy("nth", "id").agg(F.max_by("centre", F.struct("bands", "centre")).alias("centre")))
    family = star.filter("nth = 0").select("id", "centre")
    star = written(star.select(F.least("id", "centre").alias("x"), F.greatest("id", "centre").alias("y")).distinct())
    near = components(verified(star, held, reps))
    # 2. the pairs of a bucket between two components
    mine = posts.join(near, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    per = mine.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    several = per.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    mine = written(mine.join(several.select("key", "main"), "key"))
    members = written(mine.select("id", "n", "label").distinct())
    kin = members.join(family, "id")
    asked = written(members.select("id").union(kin.select("centre")).distinct())
    sets = written(shingled(reps.join(small(asked, 1_000_000), "id", "left_semi")).dropDuplicates(["id"]))
    # what two of these documents can have in common: not the shingles that only one of them has
    grams = sets.join(members.select("id"), "id").select("id", F.explode("grams").alias("gram"))
    alone = grams.groupBy("gram").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("df")).filter("df = 1").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("alone"))
    mine = mine.join(written(alone), "id", "left").withColumn("room", F.col("n") - F.coalesce("alone", F.lit(0))).filter("5 * room >= 4 * n").join(family, "id", "left")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int")
    minor = mine.filter("label <> main").select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("room").alias("rx"), F.col("centre").alias("cx"), F.col("label").alias("lx"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    other = mine.select("key", band.alias("band"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("room").alias("ry"), F.col("centre").alias("cy"), F.col("label").alias("ly"), "main")
    apart = F.coalesce(F.col("cx") != F.col("cy"), F.lit(True))
    met = minor.join(other, ["key", "band"]).filter(
        _near_sizes(F.col("nx"), F.col("ny")) & (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("main")) | (F.col("x") < F.col("y"))) & (9 * F.least("rx", "ry") >= 4 * (F.col("nx") + F.col("ny"))) & apart
    )
    met = met.select("x", "y").union(within_families(kin, sets))
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    more = written(verified(met.join(star, ["x", "y"], "left_anti"), held, reps))
    labelled = lambda c: near.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    bridge = more.join(labelled("x"), "x", "left").join(labelled("y"), "y", "left").select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y"))
    joined = components(bridge).select(F.col("id").alias("label"), F.col("label").alias("low"))
    # 3. classes of documents by their components
    final = near.select("id", "label").union(joined.join(near, joined["label"] == near["id"], "left_anti").select("label", F.col("label").alias("x")))
    final = final.join(joined, "label", "left").select(F.col("id").alias("rep"), F.coalesce("low", "label").alias("low"))
    grouped = classes.join(held.select(F.col("id").alias("rep"), "n"), "rep").join(final, "rep", "left").select("id", "rows", "n", F.coalesce("low", "rep").alias("low"))
    if renamed:  # numbers of classes back to the smallest id of their component
        grouped = written(grouped)
        grouped = grouped.join(grouped.filter("n > 0").groupBy("low").agg(F.min("id").alias("least")), "low", "left").select("id", "rows", "n", F.col("least").alias("low"))
    grouped = grouped.withColumn("low", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("low")))
    grouped = grouped.select("id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), (F.col("id") == F.col("low")).alias("kept"), "rows")
    grouped = grouped.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("row", "rows")
    alone = shingled(rows.filter("id IS NULL")).select("id", F.size("grams").cast("long"), "id", F.lit(True))
    return grouped.union(alone)


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their sets, their component and whether they are kept."""
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i : i + 1], ' '))
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
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.r, d.doc_id) AS component_id, coalesce(low.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.id = d.doc_id
"""
