"""Removal of repeated 50-byte strings across documents, by anchored windows.

Every window of 50 bytes has an anchor: the smallest of its hashed 20-grams. Equal windows have
equal anchors, so it is enough to deal out the anchors, about one byte in sixteen, with the 30
bytes on either side. No suffix is sorted. See the README for why this stands in
for external induced sorting of all suffixes, with figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents, small, written
from marlstone.llm.ngram_join import mixed, slices
from marlstone.llm.slots import bits_for, slot_levels, text_bytes
from marlstone.llm.text_classes import text_classes

LENGTH, GRAM = 50, 20
SIDE = LENGTH - GRAM
#: Buckets of keys, windows and documents, at least; text bytes a bucket beyond that; text bytes that a task holds records of before it sends them.
BUCKETS, BUCKET_BYTES, HELD = 1024, 4 << 20, 12 << 20
#: Documents from which on the records of a key don't meet, but only their windows by their hash; records whose windows are compared at once.
FREQUENT, COMPARED = 200, 40_000
#: Rows of one bucket that meet by context or window, from which on they are reduced to those of the smallest documents.
REDUCED = 400_000
RECORD = np.dtype([("key", "<u8"), ("id", "<i8"), ("pos", "<u4"), ("left", "u1"), ("right", "u1"), ("around", "u1", (2 * SIDE,))])
WINDOW = np.dtype([("window", "<u8"), ("id", "<i8"), ("start", "<u4")])
SPAN = np.dtype([("id", "<i8"), ("start", "<u4"), ("end", "<u4")])
_P = 0xD1B54A32D192ED03


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_P, k, 1 << 64))


def _slid(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or largest of every ``width`` adjacent values."""
    pick = np.minimum if least else np.maximum
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position in it, key, position in the joined texts) of all anchors; texts under 50 bytes have none."""
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    x = data.astype(np.uint64) + np.uint64(1)
    size = {1: x}
    for a, b in ((1, 1), (2, 2), (4, 4), (8, 8), (16, 4)):
        m = n - (a + b) + 1
        size[a + b] = size[a][:m] * _power(b) + size[b][a : a + m]
    key = mixed(size[GRAM])
    low = _slid(key, SIDE + 1, True)  # of the window that starts here
    crossing = np.zeros(n + 1, np.int32)
    starts = np.maximum(ends - LENGTH + 1, ends - lens)[:-1]
    np.add.at(crossing, starts, 1)
    np.add.at(crossing, ends[:-1], -1)
    low = np.where(np.cumsum(crossing[: len(low)]) > 0, np.uint64(0), low)
    seen = _slid(np.r_[np.zeros(SIDE, np.uint64), low, np.zeros(SIDE, np.uint64)], SIDE + 1, False)  # of the windows around a gram
    at = np.flatnonzero((key == seen[: len(key)]) & (seen[: len(key)] > 0))
    doc = np.searchsorted(ends, at, "right")
    return doc, at - (ends - lens)[doc], key[at], at


def records(ids: np.ndarray, texts: list[bytes], known: object) -> np.ndarray:
    """Anchors whose key may be in another document, with the bytes around their gram."""
    doc, pos, key, at = anchors(texts)
    if known is not None and len(key):
        kept = known.at_least(mixed(key), 0)
        doc, pos, key, at = doc[kept], pos[kept], key[kept], at[kept]
    out = np.zeros(len(key), RECORD)
    if not len(key):
        return out
    lens = np.fromiter(map(len, texts), np.int64, len(texts))[doc]
    out["key"], out["id"], out["pos"] = key, ids[doc], pos
    out["left"], out["right"] = np.minimum(pos, SIDE), np.minimum(lens - pos - GRAM, SIDE)
    data = np.frombuffer(b"\0" * SIDE + b"".join(texts) + b"\0" * LENGTH, np.uint8)
    k = np.r_[np.arange(SIDE), np.arange(LENGTH, LENGTH + SIDE)]
    for low in range(0, len(key), 50_000):
        part = slice(low, low + 50_000)
        around = data[at[part, None] + k]
        outside = np.concatenate([np.arange(SIDE)[None] < SIDE - out["left"][part, None].astype(int), np.arange(SIDE)[None] >= out["right"][part, None]], axis=1)
        around[outside] = 0
        out["around"][part] = around
    return out


def _context(r: np.ndarray) -> np.ndarray:
    """A hash of key and surroundings; bytes outside a text differ from all others by the sides' lengths."""
    out = mixed(r["key"] + r["left"].astype(np.uint64) * np.uint64(64) + r["right"])
    words = np.ascontiguousarray(np.pad(r["around"], ((0, 0), (0, 4)))).view("<u8")
    for k in range(words.shape[1]):
        out = mixed(out ^ words[:, k])
    return out


def first_of_context(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the records of each context's smallest id; spans of the records of larger ids).

    A record whose whole surroundings occur in a smaller document has all its windows repeated.
    """
    context = _context(r)
    order = np.lexsort((r["pos"], r["id"], context))
    r, context = r[order], context[order]
    new = np.r_[True, context[1:] != context[:-1]] if len(r) else np.zeros(0, bool)
    least = r["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = r[r["id"] > least]
    spans = np.zeros(len(later), SPAN)
    spans["id"], spans["start"], spans["end"] = later["id"], later["pos"] - later["left"], later["pos"] + GRAM + later["right"]
    return r[r["id"] == least], spans


def _by_key(r: np.ndarray) -> Iterator[np.ndarray]:
    """Records sorted by key, about COMPARED at a time; those of one key stay together."""
    r = r[np.argsort(r["key"], kind="stable")]
    new = np.flatnonzero(np.r_[True, r["key"][1:] != r["key"][:-1]]) if len(r) else np.zeros(0, np.int64)
    low = 0
    while low < len(r):
        at = np.searchsorted(new, low + COMPARED)
        high = int(new[at]) if at < len(new) else len(r)
        yield r[low:high]
        low = high


def _window_hashes(r: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes left of the gram, records that have the window, its hashes), for each place of the gram in the window."""
    weight = np.cumprod(np.r_[np.uint64(1), np.full(2 * SIDE - 1, _P, np.uint64)])
    total = np.zeros((len(r), 2 * SIDE + 1), np.uint64)
    np.cumsum((r["around"].astype(np.uint64) + np.uint64(1)) * weight, axis=1, out=total[:, 1:])
    back = pow(_P, -1, 1 << 64)
    for o in range(SIDE + 1):
        valid = np.flatnonzero((r["left"] >= o) & (r["right"] >= SIDE - o))
        window = (total[valid, 2 * SIDE - o] - total[valid, SIDE - o]) * np.uint64(pow(back, SIDE - o, 1 << 64))
        yield o, valid, mixed(mixed(window) ^ r["key"][valid])


def repeated_windows(r: np.ndarray) -> np.ndarray:
    """Spans of windows that a record with the same key and a smaller id has as well.

    ``r`` has each context's records of its smallest id only. The windows of an anchor by 20
    bytes at least, so those that are repeated cover one span.
    """
    out = [np.zeros(0, SPAN)]
    for r in _by_key(r):
        same = np.r_[False, r["key"][1:] == r["key"][:-1]]
        r = r[same | np.r_[same[1:], False]]
        most, least = np.full(len(r), -1), np.full(len(r), SIDE + 1)
        for o, valid, window in _window_hashes(r):
            if len(valid) < 2:
                continue
            by = np.lexsort((r["id"][valid], window))
            window, row = window[by], valid[by]
            new = np.r_[True, window[1:] != window[:-1]]
            smallest = r["id"][row[np.flatnonzero(new)]][np.cumsum(new) - 1]
            hit = row[r["id"][row] > smallest]
            most[hit] = np.maximum(most[hit], o)
            least[hit] = np.minimum(least[hit], o)
        hit = most >= 0
        spans = np.zeros(int(hit.sum()), SPAN)
        spans["id"], spans["start"], spans["end"] = r["id"][hit], r["pos"][hit] - most[hit], r["pos"][hit] - least[hit] + LENGTH
        out.append(spans)
    return np.concatenate(out)


def windows_of(r: np.ndarray) -> np.ndarray:
    """All windows of some records."""
    out = [np.zeros(0, WINDOW)]
    for o, valid, window in _window_hashes(r):
        own = np.zeros(len(valid), WINDOW)
        own["window"], own["id"], own["start"] = window, r["id"][valid], r["pos"][valid] - o
        out.append(own)
    return np.concatenate(out)


def first_of_window(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each window's places in its smallest document, once; spans of its places in larger ones)."""
    w = w[np.lexsort((w["start"], w["id"], w["window"]))]
    if not len(w):
        return w, np.zeros(0, SPAN)
    new = np.r_[True, w["window"][1:] != w["window"][:-1]]
    again = np.r_[False, ~new[1:] & (w["id"][1:] == w["id"][:-1]) & (w["start"][1:] == w["start"][:-1])]
    least = w["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = w[w["id"] > least]
    spans = np.zeros(len(later), SPAN)
    spans["id"], spans["start"], spans["end"] = later["id"], later["start"], later["start"] + LENGTH
    return w[(w["id"] == least) & ~again], merged(spans)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans, joined where they touch or overlap within a document."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["end"], spans["start"], spans["id"]))]
    # the largest end so far, by document: ends are below 2^32, ids get a rank above them
    rank = np.cumsum(np.r_[False, spans["id"][1:] != spans["id"][:-1]]).astype(np.int64) << 32
    reach = np.maximum.accumulate(spans["end"].astype(np.int64) + rank)
    new = np.r_[True, spans["start"][1:].astype(np.int64) + rank[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    out = spans[first].copy()
    out["end"] = (reach - rank)[np.r_[first[1:] - 1, len(spans) - 1]]
    return out


def _sent(bucket: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """Rows by bucket, each bucket's columns compressed into one value."""
    codec = pa.Codec("zstd", 1)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(rows)]
    blobs = [codec.compress(b"".join(np.ascontiguousarray(rows[a:b][c]).tobytes() for c in rows.dtype.names), asbytes=True) for a, b in zip(starts, ends, strict=True)]
    columns = [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), kind, np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "n", "rows"])


def _received(n: int, blob: bytes, dtype: np.dtype) -> np.ndarray:
    data = pa.Codec("zstd").decompress(blob, n * dtype.itemsize, asbytes=True)
    out, at = np.zeros(n, dtype), 0
    for c in dtype.names:
        field = dtype[c]
        out[c] = np.frombuffer(data, field.base, n * (field.itemsize // field.base.itemsize), at).reshape(out[c].shape)
        at += n * field.itemsize
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _spans(spans: np.ndarray, buckets: int) -> pa.RecordBatch:
    return _sent(_dealt(mixed(spans["id"].astype(np.uint64)), buckets), spans, SPANS)


def _dealt(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values % np.uint64(buckets)).astype(np.int32)


SENT = "bucket int, kind int, n int, rows binary"
#: Kinds of rows: records that meet by key, spans, records of frequent keys that meet by context, windows.
BY_KEY, SPANS, BY_CONTEXT, WINDOWS = range(4)


def _matched(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The spans of what meets in a bucket, and the first records of the contexts of frequent keys.

    What meets by context or window is reduced to the smallest document whenever REDUCED rows
    are held, so a context of very many documents takes no more memory than a few.
    """
    now: tuple[int, int] | None = None
    held: list[np.ndarray] = []

    def reduced() -> Iterator[pa.RecordBatch]:
        least, spans = (first_of_window if now[1] == WINDOWS else first_of_context)(np.concatenate(held))
        held[:] = [least]
        if len(spans):
            yield _spans(merged(spans), buckets)

    def done() -> Iterator[pa.RecordBatch]:
        yield from reduced()
        if now[1] == BY_KEY:
            spans = repeated_windows(held[0])
            if len(spans):
                yield _spans(merged(spans), buckets)
        elif now[1] == BY_CONTEXT and len(held[0]):
            yield _sent(np.full(len(held[0]), now[0], np.int32), held[0], BY_CONTEXT)

    size = 0
    for bucket, kind, n, blob in _rows(batches):
        if kind == SPANS:
            columns = [pa.array([x], t) for x, t in zip((bucket, kind, n, blob), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "n", "rows"])
            continue
        if (bucket, kind) != now and held:
            yield from done()
            held.clear()
            size = 0
        now = bucket, kind
        held.append(_received(n, blob, WINDOW if kind == WINDOWS else RECORD))
        size += n
        if size > REDUCED:
            yield from reduced()
            size = min(len(held[0]), REDUCED // 2)
    if held:
        yield from done()


def _met(sent: DataFrame, buckets: int) -> DataFrame:
    return sent.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda batches: _matched(batches, buckets), SENT)


def spans_by_window(hot: DataFrame, buckets: int) -> DataFrame:
    """The spans of records of frequent keys, each context's first ones, as rows of :data:`SENT`.

    Only their windows meet, by hash: those that two documents or more may have (by slots, as
    the keys), of each task the places in the smallest of its documents. So a window of most
    documents is a few rows, and windows that no other document has are not sent at all.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        for _, _, n, blob in _rows(batches):
            held.append(_received(n, blob, RECORD))
            if sum(map(len, held)) >= COMPARED:
                yield np.concatenate(held)
                held = []
        if held:
            yield np.concatenate(held)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for r in chunks(batches):
            for low in range(0, len(r), COMPARED):
                yield windows_of(r[low : low + COMPARED])

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for w in parts(batches):
            w = w[np.lexsort((w["id"], w["window"]))]
            yield w["window"][np.r_[True, (w["window"][1:] != w["window"][:-1]) | (w["id"][1:] != w["id"][:-1])]] if len(w) else w["window"]

    n = hot.agg(F.sum("n")).first()[0] or 0
    shared = slot_levels(hot, keys_of, bits_for(n * (SIDE + 1), 8), (2,))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in parts(batches):
            windows, spans = first_of_window(w[shared.value.at_least(w["window"], 0)])
            if len(spans):
                yield _spans(spans, buckets)
            if len(windows):
                yield _sent(_dealt(windows["window"], buckets), windows, WINDOWS)

    found = written(_met(hot.mapInArrow(send, SENT), buckets), "uncompressed")  # rows are compressed already
    shared.destroy()
    return found


def repeated_spans(reps: DataFrame, levels: Broadcast, buckets: int = BUCKETS) -> DataFrame:
    """(id, spans): the bytes of (id, text) to remove, as sorted disjoint spans; ids are integers.

    The second of the ``levels`` tells frequent keys. Records of the others meet by key. Those
    of frequent keys meet by context first, where each context keeps its smallest document's,
    and then by window (:func:`spans_by_window`).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            firsts, spans = first_of_context(np.concatenate(held))
            held.clear()
            if len(spans):
                yield _spans(merged(spans), buckets)
            frequent = levels.value.at_least(mixed(firsts["key"]), 1)
            hot, rare = firsts[frequent], firsts[~frequent]
            if len(hot):
                yield _sent(_dealt(_context(hot), buckets), hot, BY_CONTEXT)
            if len(rare):
                yield _sent(_dealt(rare["key"], buckets), rare, BY_KEY)

        for ids, texts in slices(batches, 1 << 18):
            held.append(records(ids.to_numpy(zero_copy_only=False), texts, levels.value))
            size += sum(map(len, texts))
            if size > HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            spans = merged(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, spans["id"][1:] != spans["id"][:-1]])
            edges = pa.array(np.r_[first, len(spans)].astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(spans[c].astype(np.int64)) for c in ("start", "end")], ["start", "end"])
            return pa.RecordBatch.from_arrays([pa.array(spans["id"][first]), pa.ListArray.from_arrays(edges, pairs)], ["id", "spans"])

        for bucket, _, n, blob in _rows(batches):
            if bucket != now and held:
                yield done()
                held = []
            now = bucket
            held.append(_received(n, blob, SPAN))
        if held:
            yield done()

    sent = bounded_batches(reps).select(F.col("id").cast("long"), "text").mapInArrow(send, SENT)
    found = written(_met(sent, buckets), "uncompressed")
    spans, hot = found.filter(F.col("kind") == SPANS), found.filter(F.col("kind") == BY_CONTEXT)
    if not hot.isEmpty():
        spans = spans.union(spans_by_window(hot, buckets))
    return spans.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "id long, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    Removed is each byte of the UTF-8 text that a 50-byte string covers which also starts in a
    document of a smaller id; ``kept`` is the rest. Null text is empty; texts under 50 bytes
    stay whole; of rows with the same id none removes
    bytes of another, and a null id is neither smaller nor larger than any. Equal texts are one class: all but those of its
    smallest id go whole, and that one takes part in the search. Buckets grow in number with
    the bytes. What meets in one task is what one bucket holds: the records of keys of fewer
    than FREQUENT documents, and of other keys the contexts or windows, reduced to their
    smallest documents as they come. Spans return to the texts by a shuffle join at every size,
    as they grow with the texts.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    classes = written(text_classes(given).filter("id > rep").select("id", "key").distinct())
    copies = small(classes, 2_000_000)
    marked = given.withColumn("key", F.md5("text"))
    reps = marked.filter("id IS NOT NULL").join(copies, ["id", "key"], "left_anti").select("id", "text")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, texts in slices(batches, 1 << 18):
            doc, _, key, _ = anchors(texts)
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            # keys are the least of many hashes; mixed again they spread over all slots
            yield mixed(key[np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]]) if len(key) else key

    size = text_bytes(given, "text")
    levels = slot_levels(reps, keys_of, bits_for(size / 15, 8), (2, FREQUENT))
    spans = written(repeated_spans(reps, levels, max(BUCKETS, size // BUCKET_BYTES)))
    levels.destroy()
    copied = classes.withColumn("copy", F.lit(True))
    joined = marked.join(small(copied, 2_000_000), ["id", "key"], "left").join(spans.hint("merge"), "id", "left").select("id", "text", "copy", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            out: list[tuple] = []
            low = held = 0
            for k, (t, copy, found) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = t.as_buffer().to_pybytes()
                cuts = [(0, len(raw))] if copy and len(raw) >= LENGTH else [(x["start"], x["end"]) for x in found or [] if not copy]
                edges = [0, *(e for c in cuts for e in c), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept))
                held += len(raw)
                if held > 8 << 20 or k == batch.num_rows - 1:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(out)), *(pa.array(x, ty) for x, ty in zip(zip(*out, strict=True), kinds, strict=True))], names)
                    out, low, held = [], k + 1, 0

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what is removed of them and the digest of the rest."""
    return remove_repeats(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)
), firsts AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s
), rep AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM win JOIN firsts USING (s) WHERE m < doc_id
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM rep) GROUP BY doc_id, run
), gaps AS (
  SELECT r.doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a) + 1, 2 * (a - lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a))) AS gap FROM runs r JOIN d USING (doc_id)
), per AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(gap, '' ORDER BY a) AS kept FROM gaps GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN per.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""
