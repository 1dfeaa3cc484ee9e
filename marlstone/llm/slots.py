"""Which 64-bit keys occur in how many documents, roughly and in little space.

Keys fall into 2^bits slots by their high bits. They are counted by eight bits more, and a slot is
marked at a level if one of its 256 parts has that many documents. So a slot that isn't marked proves that
each of its keys is in fewer documents than that; a mark proves nothing. Counts cover every
document. As keys of one document mark nothing, marks grow with the keys that are repeated and not with all keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, written

#: Slots of one bucket, and parts of a slot; a key's place in its bucket takes three bytes.
BUCKET_BITS, PART_BITS = 16, 8
#: Keys that a task holds before it sends them.
HELD = 2_000_000
#: Partitions that the driver reads the levels in, one after the other.
READ = 4
#: Counts stop here.
MOST = 200
#: 2^29 slots are 64 MB a level, which is the most that is broadcast; with far more repeated keys than
#: slots the levels stop telling keys apart, which costs time and never results.
MAX_BITS = 29


class Levels:
    """Slots with at least 2, and at least ``many``, documents; sent to the executors once."""

    def __init__(self, bits: int, levels: list[np.ndarray]) -> None:
        self.bits, self.levels = bits, levels

    def at_least(self, keys: np.ndarray, level: int) -> np.ndarray:
        slots = keys >> np.uint64(64 - self.bits)
        return (self.levels[level][(slots >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slots & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def bits_for(keys: float, slots: int) -> int:
    """Bits for about ``slots`` slots a key, up to :data:`MAX_BITS`."""
    return int(min(MAX_BITS, max(BUCKET_BITS + 2, np.round(np.log2(slots * max(keys, 1))))))


def slot_levels(
    docs: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]], bits: int, levels: tuple[int, ...]
) -> Broadcast:
    """The :class:`Levels` of all keys that ``keys_of`` yields, each key once a document.

    A task sends three bytes a key, already counted among its own documents, so a key that a
    third of all documents share is a few rows. The result is a fixed number of bytes; all of it is
    made at once and read back from the shared folder.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            slots = np.sort(np.concatenate(held))
            held.clear()
            first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
            times = np.minimum(np.diff(np.r_[first, len(slots)]), MOST)
            slots = np.repeat(slots[first], times)
            bucket = slots >> np.uint64(BUCKET_BITS + PART_BITS)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            low = np.ascontiguousarray(slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]).tobytes()
            ends = np.r_[starts[1:], len(slots)]
            blobs = [low[3 * a : 3 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "low"])

        size = 0
        for keys in keys_of(batches):
            held.append(keys >> np.uint64(64 - bits - PART_BITS))
            size += len(keys)
            if size > HELD:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = None, 0
        held: list[bytes] = []
        kept = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 3)
            parts = np.zeros((len(raw), 4), np.uint8)
            parts[:, :3] = raw
            parts, times = np.r_[kept[0], parts.view("<u4")[:, 0]], np.r_[kept[1], np.ones(len(raw), np.uint8)]
            order = np.argsort(parts, kind="stable")
            parts, times = parts[order], times[order]
            first = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
            return parts[first], np.minimum(np.add.reduceat(times, first, dtype=np.int64), MOST).astype(np.uint8)

        def done() -> pa.RecordBatch:
            parts, times = reduced()
            packed = b""
            for level in levels:
                marked = np.zeros(1 << BUCKET_BITS, bool)
                marked[parts[times >= level] >> np.uint32(PART_BITS)] = True
                packed += np.packbits(marked).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for bucket, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    if now is not None:
                        yield done()
                    now, size, held, kept = bucket, 0, [], (kept[0][:0], kept[1][:0])
                held.append(low.as_buffer().to_pybytes())
                size += len(held[-1]) // 3
                if size > HELD:
                    kept, held = reduced(), []
                    size = min(len(kept[0]), HELD // 2)
        if now is not None:
            yield done()

    sent = bounded_batches(docs).mapInArrow(send, "bucket int, low binary")
    packed = written(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "bucket int, packed binary"))
    size = 1 << (BUCKET_BITS - 3)
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in levels]
    for row in packed.coalesce(READ).toLocalIterator():  # 2^bits bits a level, whatever the input; a partition at a time
        for k, level in enumerate(out):
            level[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(row.packed, np.uint8, size, k * size)
    return docs.sparkSession.sparkContext.broadcast(Levels(bits, out))


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
