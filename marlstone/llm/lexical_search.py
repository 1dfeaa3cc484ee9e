"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents, written

#: Results of an item.
TOP = 50
#: Bits of a signature for each of its tokens, and bits that a token sets.
BITS, PROBES = 12, 4
#: A term of frequency tf has a token for each of these frequencies that tf reaches.
LEVELS = (1, 2, 4, 8)
#: Documents of a block of signatures, and how much larger its largest signature may be than its smallest.
BLOCK, SPREAD = 1024, 1.5
#: Items, and terms of items, that are searched for together; larger tables of items take several passes.
ITEMS, ITEM_TERMS = 500, 50_000
#: Numbers of an item by document table that are held at once.
HELD = 2_000_000

#: ASCII letters in lower case and digits stay, other ASCII bytes are blanks, all other bytes stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def probes(hashes: np.ndarray, level: int, rows: int) -> np.ndarray:
    """(PROBES, len(hashes)) rows of a signature of ``rows`` bits that the tokens of a level set."""
    x = hashes.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    return np.stack([((low + np.uint64(k) * (high | np.uint64(1))) & np.uint64(0xFFFFFFFF)) % np.uint64(rows) for k in range(PROBES)]).astype(np.int64)


def _blocks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Documents in blocks of like numbers of tokens; those without tokens are in none."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    low = 0
    while low < len(order):
        high = min(low + BLOCK, int(np.searchsorted(sizes[order], SPREAD * sizes[order[low]] + 16, "right")))
        yield order[low:high]
        low = high


def index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The signatures of all documents, written to the shared folder; nothing is shuffled.

    Rows are of two kinds. A block has the ids and ``texts`` of some documents of like size, their numbers of
    terms ``n``, the frequencies ``top`` of their commonest terms, and ``slices``: for each of ``rows``
    bits of a signature a bitmap with one place a document. A list has the different terms
    of some documents in ``terms`` and how many of these hold each in ``df``. Documents without terms (null
    and empty texts, punctuation alone) are in no block. Ids may be null, repeat, and be of any type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            own = [terms_of(t.as_buffer().to_pybytes()) if t.is_valid else [] for t in texts]
            n = np.fromiter(map(len, own), np.int64, len(own))
            if not n.sum():
                continue
            coded = pa.array(list(chain.from_iterable(own)), pa.large_binary()).dictionary_encode()
            own.clear()
            words = coded.dictionary.to_pylist()
            size = len(words)
            pair, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            doc, code = pair // size, pair % size
            top = np.zeros(len(n), np.int64)
            np.maximum.at(top, doc, tf)
            tokens = np.bincount(doc, np.searchsorted(LEVELS, tf, "right"), len(n)).astype(np.int64)
            hashes = np.fromiter(map(zlib.crc32, words), np.uint64, size)
            yield _row(terms=[pa.array(words, pa.binary()), pa.array(np.bincount(code, minlength=size), pa.int64())])
            for chosen in _blocks(tokens):
                rows = BITS * int(tokens[chosen].max())
                column = np.full(len(n), -1)
                column[chosen] = np.arange(len(chosen))
                bits = np.zeros((rows, len(chosen)), bool)
                mine = column[doc] >= 0
                for level, least in enumerate(LEVELS):
                    held = mine & (tf >= least)
                    bits[probes(hashes[code[held]], level, rows), column[doc[held]]] = True
                yield _row(block=[*(c.take(pa.array(chosen)) for c in batch.columns), pa.array(n[chosen]), pa.array(top[chosen])], rows=rows, slices=np.packbits(bits, axis=1).tobytes())

    def _row(block=None, rows=None, slices=None, terms=None) -> pa.RecordBatch:
        one = lambda values, of: pa.ListArray.from_arrays([0, len(values)], values) if values is not None else pa.nulls(1, pa.list_(of))
        ids, texts, n, top = block or (None, None, None, None)
        words, df = terms or (None, None)
        arrays = [one(ids, arrow_id), one(texts, pa.string()), one(n, pa.int64()), one(top, pa.int64()), pa.array([rows], pa.int32()), pa.array([slices], pa.binary()), one(words, pa.binary()), one(df, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "texts", "n", "top", "rows", "slices", "terms", "df"])

    from pyspark.sql.pandas.types import to_arrow_type

    pairs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = pairs.schema["id"].dataType
    arrow_id = to_arrow_type(kind)
    return written(bounded_batches(pairs).mapInArrow(run, f"ids array<{kind.simpleString()}>, texts array<string>, n array<long>, top array<long>, rows int, slices binary, terms array<binary>, df array<long>"))


class Wanted:
    """The terms and weights of some items; ``span[q]`` are the places of item q in ``term`` and ``weight``."""

    def __init__(self, items: list[list[bytes]], df: dict[bytes, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = [[(t, weight(n_docs, df[t])) for t in dict.fromkeys(own) if t in df] for own in items]
        names = sorted({t for own in self.items for t, _ in own})
        place = {t: k for k, t in enumerate(names)}
        self.hashes = np.fromiter(map(zlib.crc32, names), np.uint64, len(names))
        self.term = np.array([place[t] for own in self.items for t, _ in own], np.int64)
        self.weight = np.array([w for own in self.items for _, w in own], np.int64)
        self.border = np.cumsum([0, *map(len, self.items)])

    def share(self, tf: np.ndarray | int, n: np.ndarray | int) -> np.ndarray | int:
        """What a unit of weight is worth at frequency ``tf`` in a document of ``n`` terms."""
        m = 50 + 50 * n * self.n_docs // self.n_terms
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def upper_bounds(w: Wanted, n: np.ndarray, top: np.ndarray, rows: int, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first item, table of items by documents): no document of the block scores more for an item.

    The bits of a term say at most too much, so the weights of the terms whose bits are all set,
    summed for each level of frequency, and each level's worth in the document, bound its score.
    """
    wide = len(n)
    table = np.frombuffer(slices, np.uint8).reshape(rows, -1)
    held, bits = None, []
    for level in range(len(LEVELS)):
        p = probes(w.hashes, level, rows)
        here = table[p[0]]
        for k in range(1, PROBES):
            here = here & table[p[k]]
        held = here if held is None else held & here
        bits.append(held)
    limits = [np.minimum(b - 1, top) for b in LEVELS[1:]] + [top]
    worth = [w.share(limit, n) for limit in limits]
    worth = [a - b for a, b in zip(worth, [np.zeros(wide, np.int64), *worth], strict=False)]
    q, end = 0, len(w.items)
    while q < end:
        stop = max(q + 1, int(np.searchsorted(w.border, w.border[q] + max(HELD // wide, 1), "right")) - 1)
        low, high = w.border[q], w.border[stop]
        out = np.zeros((stop - q, wide), np.int64)
        if high > low:
            some = np.flatnonzero(np.diff(w.border[q : stop + 1]))
            at = w.border[q:stop][some] - low
            for level in range(len(LEVELS)):
                rows_of = bits[level][w.term[low:high]]
                if level and not rows_of.any():
                    break
                sums = np.add.reduceat(np.unpackbits(rows_of, axis=1, count=wide) * w.weight[low:high, None], at, axis=0)
                out[some] += sums * worth[level]
        yield q, out
        q = stop


def _tables(batches: Iterator[pa.RecordBatch], w: Wanted) -> Iterator[tuple]:
    """(block, first item, table of bounds) of the blocks in ``batches``, whose first columns are those of _BOUNDS."""
    for batch in batches:
        for block in zip(*batch.columns, strict=True):
            n, top = (x.values.to_numpy(zero_copy_only=False) for x in block[1:3])
            for q, bounds in upper_bounds(w, n, top, block[3].as_py(), block[4].as_buffer()):
                yield block, q, bounds


_BOUNDS = ["ids", "n", "top", "rows", "slices"]


def largest_bounds(blocks: DataFrame, wanted, top: int) -> DataFrame:
    """(q, id, bound) of the ``top`` documents of largest bounds for each item, among the blocks of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for block, first, bounds in _tables(batches, wanted.value):
            k = min(top, bounds.shape[1])
            at = np.argpartition(-bounds, k - 1, axis=1)[:, :k]
            for q in np.flatnonzero(bounds.max(axis=1) > 0).tolist():
                chosen = at[q][bounds[q, at[q]] > 0]
                new, value = block[0].values.take(pa.array(chosen)), bounds[q, chosen]
                if first + q in held:
                    old, was = held[first + q]
                    if len(was) >= top and value.max() <= was.min():
                        continue
                    new, value = pa.concat_arrays([old, new]), np.r_[was, value]
                    if len(value) > top:
                        best = np.argpartition(-value, top - 1)[:top]
                        new, value = new.take(pa.array(best)), value[best]
                held[first + q] = new, value
        for q, (ids, value) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), q), pa.int32()), ids, pa.array(value, pa.int64())], ["q", "id", "bound"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return bounded_batches(blocks.select(_BOUNDS)).mapInArrow(run, f"q int, id {kind}, bound long")


def scores_of(w: Wanted, text: bytes, items: list[int]) -> Iterator[tuple[int, int]]:
    """(item, score) of those of the items for which the text scores more than 0."""
    own = terms_of(text)
    tf, n = Counter(own), len(own)
    for q in items:
        total = sum(x * w.share(tf[t], n) for t, x in w.items[q] if t in tf)
        if total:
            yield q, total


def scored_in_place(blocks: DataFrame, wanted, least: np.ndarray) -> DataFrame:
    """(q, id, score) of all documents whose bounds reach ``least`` of an item, from the texts that lie beside the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted(block, asked: dict[int, list[int]]) -> pa.RecordBatch:
            out = [(q, d, score) for d, items in asked.items() for q, score in scores_of(wanted.value, block[5].values[d].as_buffer().to_pybytes(), items)]
            ids = block[0].values.take(pa.array([d for _, d, _ in out], pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in out], pa.int32()), ids, pa.array([x for _, _, x in out], pa.int64())], ["q", "id", "score"])

        now, asked = None, {}
        for block, first, bounds in _tables(batches, wanted.value):
            if block is not now and asked:
                yield emitted(now, asked)
                asked = {}
            now = block
            q, d = np.nonzero(bounds >= least[first : first + len(bounds), None])
            for item, document in zip((q + first).tolist(), d.tolist(), strict=True):
                asked.setdefault(document, []).append(item)
        if asked:
            yield emitted(now, asked)

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return bounded_batches(blocks.select(*_BOUNDS, "texts")).mapInArrow(run, f"q int, id {kind}, score long")


def exact_scores(docs: DataFrame, pairs: DataFrame, wanted, id_col: str, text: str) -> DataFrame:
    """(q, id, score) of the pairs (q, id), of which there are TOP an item at most, from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(k, *x) for k in range(batch.num_rows) for x in scores_of(wanted.value, (batch.column(1)[k].as_py() or "").encode(), batch.column(2)[k].as_py())]
            ids = batch.column(0).take(pa.array([k for k, _, _ in told], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([q for _, q, _ in told], pa.int32()), ids, pa.array([x for _, _, x in told], pa.int64())], ["q", "id", "score"])

    asked = F.broadcast(pairs.groupBy(F.col("id").alias("asked")).agg(F.collect_set("q").alias("qs")))  # ITEMS * TOP rows at most
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.join(asked, F.col("id").eqNullSafe(F.col("asked"))).select("id", "text", "qs")
    return bounded_batches(found).mapInArrow(run, f"q int, id {kind}, score long")


def ranked(scores: DataFrame, top: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return scores.withColumn("rank", nth).filter(F.col("rank") <= top)


def _search(docs: DataFrame, held: DataFrame, items: list[tuple], n_docs: int, n_terms: int, top: int, id_col: str, text: str) -> DataFrame:
    """(q, rank, id, score) for some items (their terms alone count here)."""
    spark = docs.sparkSession
    names = sorted({t for _, own in items for t in own})
    asked = spark.createDataFrame([(t,) for t in names], "term binary")
    lists = held.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = {bytes(r.term): r.df for r in lists.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # ITEM_TERMS at most
    w = Wanted([own for _, own in items], df, n_docs, n_terms)
    wanted = spark.sparkContext.broadcast(w)
    blocks = held.filter("slices IS NOT NULL")
    # 1. the documents with the largest bounds: their scores are what a result must reach
    first = largest_bounds(blocks, wanted, top)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound")))
    seeds = first.withColumn("nth", nth).filter(F.col("nth") <= top).select("q", "id")
    seen = ranked(exact_scores(docs, seeds, wanted, id_col, text), top).groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    least = np.ones(len(items), np.int64)
    for r in seen.collect():  # a row an item
        if r.n == top:
            least[r.q] = r.least
    # 2. every document that isn't provably below
    return ranked(scored_in_place(blocks, wanted, least), top).select("q", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, id, score): for each row of ``items`` the ``top`` documents of highest score above 0.

    Equal scores go by ascending id, a null id last. The score is a sum over the different terms of an item
    of 64-bit integers, as documented in :class:`Wanted` and :func:`weight`. Items without terms
    (null, empty, punctuation) and an empty table of either kind give no rows; items that repeat
    an id are items of their own, and so are documents. Other columns don't matter.

    Documents are indexed once as bit-sliced signatures. They give an upper bound for each
    item and document; the scores of the documents with the largest bounds set what a result must
    reach, and all documents whose bounds reach it are scored exactly from their whole texts, which
    the index holds beside the signatures, so results are exact and no text is shuffled. Items are searched for in groups of at most ITEMS, each with a scan of
    the index; what is broadcast is a group's terms and ``top`` documents for each of its items.
    """
    held = index(docs, id_col, text)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    n_docs, n_terms = held.filter("slices IS NOT NULL").agg(F.sum(F.size("n")), F.sum(total)).first()
    out, group, terms = None, [], 0
    kind = items.schema[item_id].dataType.simpleString()

    def found(group: list[tuple]) -> DataFrame:
        rows = _search(docs, held, group, n_docs, n_terms, top, id_col, text)
        names = docs.sparkSession.createDataFrame([(q, i) for q, (i, _) in enumerate(group)], f"q int, item {kind}")
        return written(rows.join(F.broadcast(names), "q").select(F.col("item").alias("item_id"), "rank", "id", "score"))

    own = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t"))
    for row in own.toLocalIterator() if n_docs else ():  # a partition of items at a time
        asked = list(dict.fromkeys(terms_of((row.t or "").encode())))
        if group and (len(group) == ITEMS or terms + len(asked) > ITEM_TERMS):
            part = found(group)
            out, group, terms = part if out is None else out.union(part), [], 0
        if asked:
            group.append((row.i, asked))
            terms += len(asked)
    if group:
        part = found(group)
        out = part if out is None else out.union(part)
    if out is None:
        empty = docs.select(F.col(f"`{id_col}`").alias("id")).limit(0)
        return empty.select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for each benchmark item."""
    found = search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), f AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), n AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id
), g AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(g.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY term
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * g.docs) // g.terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), g GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
