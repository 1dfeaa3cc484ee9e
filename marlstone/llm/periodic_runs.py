"""Periodic runs of words, by maximal pairs from a bottom-up tree of common-prefix intervals."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents, fresh, let, words

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 6, 4
#: A run repeats a string of so many words at its period's distance, at least (LEAST - 1 for period 1).
GRAM = LEAST - 1
#: Words whose suffixes are sorted together; a longer text is sorted alone.
TOGETHER = 300_000


def _repeated(codes: np.ndarray) -> np.ndarray:
    """Whether the GRAM codes from each place on may occur elsewhere, by a hash: false only if they don't."""
    m = len(codes) - GRAM + 1
    if m < 2:
        return np.zeros(len(codes), bool)
    x = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(m, np.uint64)
    for k in range(GRAM):
        h = (h + x[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    out = np.zeros(len(codes), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        out[:m] = twice[at] == h
    return out


def _suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, common): places in the order of their suffixes, and the common prefix of each with the one before.

    Prefix doubling: each round orders the places that still tie by the order of what follows,
    and keeps its classes, from which the common prefixes are put together.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, size = [rank], 1
    while True:
        # slots whose class holds several places
        ties = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(ties) or size >= n:
            break
        place = order[ties]
        after = np.where(place + size < n, rank[np.minimum(place + size, n - 1)], -1)
        key = rank[place] * np.int64(n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        order[ties] = place[by]
        key = key[by]
        new = new.copy()
        new[ties] = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[order[ties]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[ties]
        levels.append(rank)
        size *= 2
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        a, b, common = a + step, b + step, common + step
    return order, np.r_[0, common]


def _joined(held: list[int], child: list[int], common: int, left: np.ndarray, found: list[tuple[int, int, int]]) -> list[int]:
    """The places of two children of an interval in one list; maximal pairs between them go to ``found``.

    A pair of places is maximal if the words before them differ, that is, their classes of left
    words, and it lies in different children. Only neighbours in the text are looked at: inside
    a run of smallest period q no place between two at distance q has a string of 3 q words in common.
    """
    if len(held) < len(child):
        held, child = child, held
    pairs = []
    for x in child:
        k = bisect_left(held, x)
        for a, b in ((held[k - 1], x) if k else (x, x), (x, held[k]) if k < len(held) else (x, x)):
            q = b - a
            if 0 < q and (TIMES - 1) * q <= common and q + common >= LEAST and left[a] != left[b]:
                pairs.append((a, q + common, q))
    found += pairs
    for x in child:
        held.insert(bisect_left(held, x), x)
    return held


def maximal_pairs(order: np.ndarray, common: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of maximal pairs at most a third of their common string apart.

    Intervals of the order with a common prefix of GRAM words or more are closed from the leaves
    up; each carries its places in text order with the classes of their left words. A subtree
    in which no two places are near enough for its longest common prefix is passed over.
    """
    deep = common >= GRAM
    block = np.cumsum(~deep)
    several = np.r_[deep[1:], False] | deep
    slots = np.flatnonzero(several)
    if not len(slots):
        return []
    by = np.lexsort((order[slots], block[slots]))
    b, p = block[slots][by], order[slots][by]
    gap = np.where(b[1:] == b[:-1], p[1:] - p[:-1], len(order))
    top = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    nearest = np.minimum.reduceat(np.r_[gap, len(order)], top)
    longest = np.maximum.reduceat(np.where(deep, common, 0)[slots], np.flatnonzero(np.r_[True, np.diff(block[slots]) > 0]))
    starts = slots[np.flatnonzero(np.r_[True, np.diff(block[slots]) > 0])]
    sizes = np.diff(np.r_[top, len(slots)])
    found: list[tuple[int, int, int]] = []
    near = (TIMES - 1) * nearest <= longest
    for first, size in zip(starts[near].tolist(), sizes[near].tolist(), strict=True):
        places, depths = order[first : first + size].tolist(), [*common[first + 1 : first + size].tolist(), 0]
        stack: list[list] = []
        for place, depth in zip(places, depths, strict=True):
            child = [place]
            while stack and stack[-1][0] > depth:
                size_, held = stack.pop()
                child = _joined(held, child, size_, left, found)
            if depth and stack and stack[-1][0] == depth:
                stack[-1][1] = _joined(stack[-1][1], child, depth, left, found)
            elif depth:
                stack.append([depth, child])
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, smallest period) of each list of words, by start and period.

    Words get numbers of their own in each text and texts end with numbers that occur once, so
    nothing is common to two texts. Words that no repeated string of GRAM words touches lie in
    no run and are left out of the order; a number that occurs once takes their place.
    """
    codes, borders, used = [], [0], 0
    for own in texts:
        coded = pa.array(own, pa.large_binary()).dictionary_encode() if own else None
        if coded is not None:
            codes.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + used)
            used += len(coded.dictionary)
        codes.append(np.array([used], np.int64))
        used += 1
        borders.append(borders[-1] + len(own) + 1)
    code = np.concatenate(codes)
    starts = _repeated(code)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not starts.any():
        return out
    reach = np.cumsum(np.r_[0, starts])
    kept = reach[1:] > reach[np.maximum(np.arange(len(code)) - GRAM + 1, 0)]
    at = np.flatnonzero(kept)
    split = np.flatnonzero(np.diff(at) > 1) + 1
    origin = np.insert(at, split, -1)
    gaps = origin < 0
    small = np.where(gaps, 0, code[np.maximum(origin, 0)])
    small[gaps] = used + np.arange(int(gaps.sum()))
    order, common = _suffixes(small)
    left = np.r_[-1, small[:-1]]
    document = np.array(borders)
    best: dict[tuple[int, int], int] = {}
    for start, length, q in maximal_pairs(order, common, left):
        place = (int(origin[start]), length)
        best[place] = min(q, best.get(place, q))
    for (start, length), q in best.items():
        k = int(np.searchsorted(document, start, "right")) - 1
        out[k].append((start - borders[k], length, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def without_repeats(own: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return own
    gone = np.zeros(len(own) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [w for w, k in zip(own, np.cumsum(gone)[:-1].tolist(), strict=True) if not k]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs of words, and its text with one period of each.

    ``runs`` is an array of (start, length, period) by start and period, of words numbered from
    0; words are runs of bytes other than white space. A run is a stretch of words of smallest
    period q that can't be extended, of at least LEAST words and TIMES periods. Words are equal if
    all of their bytes are. ``collapsed`` has one blank between the words that are left.

    Null and empty texts have no words, no runs and the empty text. Rows are independent: ids
    may be null, repeat and be of any type, other columns don't matter, an empty table gives
    an empty table. Nothing is shuffled. A text is held whole, with some 300 bytes a word of
    its repeated parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            low, held, size = 0, [], 0
            for k in range(batch.num_rows):
                held.append(texts[k].as_buffer().to_pybytes().split() if texts[k].is_valid else [])
                size += len(held[-1]) + 1
                if size >= TOGETHER or k == batch.num_rows - 1:
                    found = runs_of(held)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(low, len(held)), pa.array([len(w) for w in held], pa.int64()),
                            pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], RUNS),
                            pa.array([b" ".join(without_repeats(w, f)) for w, f in zip(held, found, strict=True)], pa.binary()).cast(pa.string()),
                        ],
                        ["id", "n_words", "runs", "collapsed"],
                    )
                    low, held, size = k + 1, [], 0

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_planted(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` whose texts of ids with crc32 divisible by 10 go on in a period from some word on; a null id is left as it is."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))

    def periodic(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0), n - 1)
        moved = let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda v: F.transform(places, lambda i: F.get(w, F.when(i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]))))
        return F.when(n > 0, F.array_join(moved, " "))

    planted = F.when(h % 10 == 0, let(words(F.col(f"`{text}`")), periodic)).otherwise(F.col(f"`{text}`"))
    return docs.withColumn(text, planted)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, some made periodic, with their longest run and the digests of runs and of what is left."""
    docs = documents(spark, sf_dir)
    key = fresh(docs, "text")
    found = periodic_runs(with_planted(docs.select("doc_id", F.col("text").alias(key)), "doc_id", key), "doc_id", key)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select(F.col("id").alias("doc_id"), "runs", "collapsed", longest.alias("best"), lines.alias("lines"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Equal words of the same text, five in a row, at every distance that leaves room for four periods.
SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents
), planted AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS moved, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS e FROM split
), texts AS (
  SELECT doc_id, CASE WHEN moved THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END]) ELSE w END AS w, n FROM planted
), grams AS (
  SELECT doc_id, n, unnest(range(0, n - 4)) AS i, unnest(list_transform(range(1, n - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM texts WHERE n >= 5
), twins AS (
  SELECT a.doc_id, a.n, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i AND 4 * (b.i - a.i) <= a.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM twins
), pairs AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY doc_id, q, k
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM pairs WHERE length >= greatest(6, 4 * q) GROUP BY ALL
), told AS (
  SELECT doc_id, count(*) AS n_runs, max(struct_pack(length := length, start := -start, period := -period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    list_distinct(flatten(list(range(start + period, start + length)))) AS gone FROM runs GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, (-best.start)::BIGINT AS start, best.length::BIGINT AS length, (-best.period)::BIGINT AS period,
  (1000 * best.length // -best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(x.v, ' ' ORDER BY x.i) FROM (SELECT unnest(w) AS v, unnest(range(0, n)) AS i) x WHERE NOT list_contains(gone, x.i)), '') END) AS collapsed_sha256
FROM texts t LEFT JOIN told USING (doc_id)
"""
