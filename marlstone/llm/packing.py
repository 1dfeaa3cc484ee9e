"""Packing by concatenate and cut: two passes of prefix sums, then fixed windows."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents, written
from marlstone.llm.ngram_join import mixed, slices

END_ID = 2
WINDOW = 4096
#: Words whose ids a worker keeps, the longest in bytes, and their ids; about 40 MB at most.
KEPT, LONGEST, KEPT_IDS = 1 << 20, 64, 1 << 23
#: Bytes of text that are looked up at once.
SLICE = 1 << 19
_GAP = re.compile(rb"[ \n]")


class WordTokens:
    """Token ids of texts under a vocabulary that drops white space, lowers case and joins no words.

    Such a tokenizer gives a text the ids of its space-separated words one after the other, so
    each different word is encoded once. Words of ASCII are in lower case, and a full stop or
    comma after a last letter or digit is a word of its own, as it is for the tokenizer. Words
    are known by 64-bit hashes in sorted arrays; a full store is left with the words in use.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.hashes, self.first, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = np.zeros(0, "<u2")

    def encoded(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Words of lower-case ASCII letters need no normaliser and no splitting."""
        out: list = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if w.isascii() and w.isalpha() and w.islower():
                out[k] = [t.id for t in self.tokenizer.model.tokenize(w)]
            else:
                rest.append(k)
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def found(self, hashes: np.ndarray, words: Callable[[np.ndarray], list[str]], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, n, ids): where the ids of different words, by sorted hash, start in ``ids`` and how many they are."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        first, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        first[hit], n[hit] = self.first[at[hit]], self.n[at[hit]]
        new = np.flatnonzero(~hit)
        new = np.r_[new[size[new] <= LONGEST], new[size[new] > LONGEST]]
        own = self.encoded(words(new))
        n[new] = [len(x) for x in own]
        first[new] = len(self.known) + np.cumsum(n[new]) - n[new]
        ids = np.concatenate([self.known, np.array([i for x in own for i in x], "<u2")])
        kept = size <= LONGEST
        if len(self.hashes) + len(new) > KEPT or len(ids) > KEPT_IDS:
            own = np.flatnonzero(kept)
            self.hashes, self.n = hashes[own], n[own]
            self.first = np.cumsum(self.n) - self.n
            self.known = ids[np.repeat(first[own] - self.first, self.n) + np.arange(int(self.n.sum()))]
        else:
            own = new[: int(kept[new].sum())]
            own = own[np.argsort(own)]
            places = np.searchsorted(self.hashes, hashes[own])
            self.hashes, self.first, self.n = (np.insert(a, places, b[own]) for a, b in ((self.hashes, hashes), (self.first, first), (self.n, n)))
            self.known = ids[: len(self.known) + int(n[own].sum())]
        return first, n, ids

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = (data == 32) | (data == 10)
        start = np.flatnonzero(~space & np.r_[True, space[:-1]])
        end = np.flatnonzero(space & ~np.r_[True, space[:-1]])
        if not len(start):
            return [b""] * len(texts)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        # capitals are lowered in words of ASCII, unless a special token may be near
        raw = np.r_[0, np.cumsum(data >= 128, dtype=np.int64)]
        raw = raw[end] > raw[start]
        special = np.array([b"<|" in t for t in texts])
        if special.any():
            raw |= special[np.searchsorted(begin, start, "right") - 1]
        plain = np.repeat(~raw, np.diff(np.r_[start, len(data)]))
        lower = data.copy()
        lower[start[0] :] += (((data[start[0] :] >= 65) & (data[start[0] :] <= 90)) & plain).view(np.uint8) << 5
        last, before, far = data[end - 1], data[np.maximum(end - 2, 0)], data[np.maximum(end - 3, 0)]
        ascii_word = (((before | 32) >= 97) & ((before | 32) <= 122)) | ((before >= 48) & (before <= 57))
        latin = (far == 0xC3) & (before >= 128) & (before != 0x97) & (before != 0xB7) & (end - start > 2)
        mark = ((last == 46) | (last == 44)) & (end - start > 1) & (ascii_word | latin)
        at = np.arange(len(start)) + np.cumsum(mark) - mark
        s, e = np.zeros(len(start) + int(mark.sum()), np.int64), np.zeros(len(start) + int(mark.sum()), np.int64)
        s[at], e[at] = start, end - mark
        s[at[mark] + 1], e[at[mark] + 1] = end[mark] - 1, end[mark]
        place = np.arange(s[0], len(data)) - np.repeat(s, np.diff(np.r_[s, len(data)]))
        value = (lower[s[0] :].astype(np.uint64) + np.uint64(1)) * mixed(place.astype(np.uint64) + np.uint64(1))
        value[space[s[0] :]] = 0
        hashes = mixed(np.add.reduceat(value, s - s[0]) + (e - s).astype(np.uint64))
        different, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        text = lower.tobytes()
        first, n, ids = self.found(different, lambda k: [text[a:b].decode() for a, b in zip(s[one[k]].tolist(), e[one[k]].tolist(), strict=True)], (e - s)[one])
        n, first = n[which], first[which]
        upto = np.r_[0, np.cumsum(n)]
        out = ids[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        edges = (2 * upto[np.searchsorted(s, begin)]).tolist()
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def of_text(self, text: bytes) -> bytes:
        """Ids of one long text, read in parts that end between words."""
        out, low = [], 0
        while low < len(text):
            high = min(len(text), low + SLICE)
            if high < len(text):
                gap = _GAP.search(text, high)
                high = gap.start() if gap else len(text)
            out += self.ids([text[low:high]])
            low = high
        return b"".join(out)


#: One per vocabulary and Python worker, which serves many tasks.
_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, id_col: str, text: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass: (id, part, first, n, ids) with ``first`` the tokens before a document in its partition."""
    path = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, at, part = word_tokens(path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], "<u2").tobytes()
        for ids, texts in slices(batches, SLICE):
            own = tokens.ids(texts) if sum(map(len, texts)) <= 2 * SLICE else [tokens.of_text(t) for t in texts]
            out = [x + end for x in own]
            n = np.array([len(x) // 2 for x in out], np.int64)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(out), part, np.int64)), pa.array(first), pa.array(n), pa.array(out, pa.binary())], ["id", "part", "first", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(run, f"id {kind}, part long, first long, n long, ids binary")


def offsets(tokens: DataFrame) -> DataFrame:
    """Second pass: ``tokens`` with ``base``, the tokens of all partitions before its own.

    One row per partition reaches the prefix sum, however large the partitions are.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.expr("sum(total) OVER (ORDER BY part)") - F.col("total")).alias("base"))
    return tokens.join(F.broadcast(base), "part")  # rows: input partitions, a few hundred thousand at 100 TB


def cut(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces that the window borders make of each document, with their ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, length, sequence, offset, crc, piece = [], [], [], [], [], [], []
            begin = (batch.column("base").to_numpy() + batch.column("first").to_numpy()).tolist()
            for k, (at, ids) in enumerate(zip(begin, batch.column("ids"), strict=True)):
                data = np.frombuffer(ids.as_buffer(), "<u2")
                low = 0
                while low < len(data):
                    high = min(len(data), (((at + low) // window + 1) * window) - at)
                    own = data[low:high].astype("<u4")
                    rows.append(k), start.append(low), length.append(high - low), crc.append(zlib.crc32(own))
                    sequence.append((at + low) // window), offset.append((at + low) % window), piece.append(data[low:high].tobytes())
                    low = high
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column("n").take(take)]
                + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(piece, pa.binary()), batch.column("part").take(take)],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"],
            )

    kind = placed.schema["id"].dataType.simpleString()
    return placed.select("id", "base", "first", "n", "ids", "part").mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents, laid end to end and cut at every ``window`` tokens.

    Each document is its tokens and ``end_id``; null and empty texts are ``end_id`` alone. The
    tokens are written once to the shared folder with their partition, which fixes the order:
    both passes then read the same rows, whatever executors are lost. Only the last sequence of
    all is shorter than the window. Repeated rows are separate documents; an empty table gives
    no pieces; other columns of ``docs`` are ignored. The tokenizer must drop white space and
    treat space-separated pieces apart, as that of ``word_bpe_49k.json`` does.
    """
    return cut(offsets(written(tokenized(docs, id_col, text, path, end_id))), window)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n, ids): whole windows of 16-bit ids; the last is padded to ``window``.

    A task joins the pieces that follow each other in it. A window that it doesn't hold whole
    becomes a boundary record, of which a task makes two; only boundary records are shuffled,
    to be joined by window. A last sequence whose length is a power of two stays as it is.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sequence_id", "offset", "n", "ids"]
        now, begin, size, held, out = None, 0, 0, [], []
        for batch in batches:
            for seq, at, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (seq, at) != (now, begin + size):
                    if held:
                        out.append((now, begin, size, b"".join(held)))
                    now, begin, size, held = seq, at, 0, []
                size += n
                held.append(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, begin, size, b"".join(held))], names)

    runs = written(pieces.select("sequence_id", "offset", "length", "ids").mapInArrow(join, "sequence_id long, offset long, n long, ids binary"))
    whole = F.col("n") == window
    met = runs.filter(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("n").alias("n"))
    met = met.select("sequence_id", "n", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    pad = F.repeat(F.lit(pad_id.to_bytes(2, "little").hex()), F.when(power, F.lit(0)).otherwise(window - F.col("n")).cast("int"))
    return runs.filter(whole).select("sequence_id", "n", "ids").union(met.select("sequence_id", "n", F.concat("ids", F.unhex(pad)).alias("ids")))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens, one row per piece."""
    return pack(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
