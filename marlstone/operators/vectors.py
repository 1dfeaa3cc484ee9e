"""Pairs of near vectors: by buckets of random hyperplanes, or exactly by products of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.block_joins import TILE, block_pairs
from marlstone.plans.scratch import written

#: Bits of a bucket at least, and bits beyond those that give each vector a bucket of its own.
LEAST_BITS, MORE_BITS = 8, 2
#: What single precision may take from a cosine.
NEAR = 1e-4


def bucket_plan(vectors: int, least: float, recall: float) -> tuple[int, int]:
    """(bits, tables): hyperplanes of a bucket for so many vectors, and how many tables of buckets find
    a pair of cosine ``least`` with probability ``recall``; nearer pairs are found more surely."""
    bits = min(60, max(LEAST_BITS, math.ceil(math.log2(max(vectors, 2))) - MORE_BITS))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors as a matrix) of the vectors of each length; null, empty, zero and non-finite ones are left out."""
    sizes = np.array([len(v) if v.is_valid else 0 for v in column], np.int64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        values = np.array(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
        norm = np.sqrt((values * values).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        yield rows[good], values[good] / norm[good, None]


def vector_classes(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """((id, rep, rows) of each class of equal vectors' smallest ids; (id, v) of one vector a class).

    Equal vectors are told by the SHA-256 of their numbers. Null vectors are in no class.
    """
    keyed = vectors.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    keyed = keyed.withColumn("h", F.sha2(F.to_json("v"), 256))
    firsts = written(keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    members = keyed.select("id", "h").join(firsts, "h").select("id", "rep", "rows")
    reps = keyed.join(firsts.select(F.col("rep").alias("id"), "h"), ["id", "h"], "left_semi").select("id", "v").dropDuplicates(["id"])
    return members, written(reps)


def _checked(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    side = lambda c: reps.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    met = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", T.cosine(F.col("vx"), F.col("vy")).alias("cosine"))
    return met.filter(F.col("cosine") >= least)


def bucketed_pairs(reps: DataFrame, least: float = 0.95, recall: float = 0.99, seed: int = 0) -> DataFrame:
    """(x, y, cosine): pairs x < y of the rows (id, v) with a cosine of ``least`` or more.

    A vector's bucket is the side on which it lies of each of some random hyperplanes, so the
    angle between two decides how often they share one. Buckets get smaller with the number of
    vectors and tables get more, so the pairs compared grow with the vectors unless the data are
    dense. Every pair compared is checked exactly: none is wrong, and one of cosine ``least`` is missed with
    a probability of 1 - ``recall``. Vectors of different lengths never pair.
    """
    bits, tables = bucket_plan(reps.count(), least, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, units in _matrix(batch.column(1)):
                size = units.shape[1]
                planes = np.random.Generator(np.random.PCG64([seed, size])).standard_normal((size, tables * bits))
                sides = (units @ planes > 0).reshape(len(rows), tables, bits)
                keys = (sides @ (np.int64(1) << np.arange(bits))).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), size), pa.int32()), pa.array(np.tile(np.arange(tables), len(rows)), pa.int32()), pa.array(keys), batch.column(0).take(pa.array(np.repeat(rows, tables)))],
                    ["size", "tab", "bucket", "id"],
                )

    kind = reps.schema["id"].dataType.simpleString()
    posts = written(reps.select("id", "v").mapInArrow(run, f"size int, tab int, bucket long, id {kind}"))
    place = ["size", "tab", "bucket"]
    shared = posts.groupBy(place).agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select(place)
    held = written(posts.join(shared, place))
    pairs = held.withColumnRenamed("id", "x").join(held.withColumnRenamed("id", "y"), place).filter("x < y").select("x", "y").distinct()
    return _checked(pairs, reps, least)


def exact_pairs(reps: DataFrame, least: float = 0.95) -> DataFrame:
    """(x, y, cosine): all pairs x < y of the rows (id, v) with a cosine of ``least`` or more, surely.

    Blocks of unit vectors of one length are multiplied, each two groups of vectors in a task, and what may reach
    ``least`` is checked in double precision. The products grow with the square of the vectors, as any exact join's on data without
    structure; what is sent grows with vectors times groups, and no task holds more than two groups.
    """
    kind = reps.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, units in _matrix(batch.column(1)):
                packed = pa.array([u.tobytes() for u in units.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), units.shape[1]), pa.int32()), packed], ["id", "size", "unit"])

    def opened(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
        t = t.filter(pa.array(t["size"].to_numpy() == size))
        return t["id"].to_numpy(), np.frombuffer(b"".join(t["unit"].to_pylist()), np.float32).reshape(-1, size)

    def compare(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        for size in np.unique(left["size"].to_numpy()).tolist():
            a = opened(left, size)
            b = a if right is None else opened(right, size)
            for low in range(0, len(a[0]), TILE):
                for at in range(low if right is None else 0, len(b[0]), TILE):
                    i, j = np.nonzero(a[1][low : low + TILE] @ b[1][at : at + TILE].T >= np.float32(least - NEAR))
                    i, j = i + low, j + at
                    if right is None:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        ids = a[0][i], b[0][j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ids)), pa.array(np.maximum(*ids))], ["x", "y"])

    rows = written(reps.select("id", "v").mapInArrow(encode, f"id {kind}, size int, unit binary"))
    return _checked(block_pairs(rows, compare, f"x {kind}, y {kind}", lambda n, m: False), reps, least)


def pair_report(vectors: DataFrame, id_col: str, vector: str, pairs_of) -> DataFrame:
    """(x, y, cosine, x_rows, y_rows): near pairs of different vectors, each under the smallest id that has it with the
    number of its rows, and each further row of an equal vector beside that id with cosine 1 (null counts)."""
    members, reps = vector_classes(vectors, id_col, vector)
    members = written(members)
    sizes = members.filter(F.col("id") == F.col("rep")).groupBy("rep").agg(F.first("rows").alias("rows"))
    side = lambda c: sizes.select(F.col("rep").alias(c), F.col("rows").alias(f"{c}_rows"))
    near = pairs_of(reps).join(side("x"), "x").join(side("y"), "y").select("x", "y", "cosine", "x_rows", "y_rows")
    none: Column = F.lit(None).cast("long")
    return near.union(members.filter(F.col("id") != F.col("rep")).select("rep", "id", F.lit(1.0), none, none))
