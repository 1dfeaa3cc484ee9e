"""Language identification by prediction by partial matching with frozen statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents

#: Bytes of text a language is learned from, at most (about), by the hash of the id.
SAMPLE_BYTES = 6_000_000
#: Bytes of context. Contexts seen fewer times than LEAST fall back to shorter ones.
ORDER = 3
LEAST = 3
#: Bytes of a long text that are scored at once.
PART = 1 << 20
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
_SPLIT = b" " * ORDER


def letters(text: str | None) -> bytes:
    """The whole text in lower case, every run of other characters as one space; empty without letters."""
    if not text:
        return b""
    plain = _OTHER.sub(" ", text.lower()).strip()
    return plain.encode("utf-8", "replace") + b" " if any(map(str.isalpha, plain)) else b""


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ORDER + 1 bytes that end inside a text, as 32-bit numbers, and their counts."""
    data = np.frombuffer(_SPLIT + _SPLIT.join(texts), np.uint8).astype(np.uint32)
    grams = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    grams = grams[~((data[2:-1] == 32) & (data[3:] == 32))]
    return np.unique(grams, return_counts=True)


class ContextTrees:
    """One byte context tree per language, merged into one table of states.

    A state is the longest known context of the last bytes. ``bits[state * size + symbol]``
    has the code length of that next symbol in every language. In a language's tree a context
    gives a seen symbol count / (n + d) and the escape d / (n + d), where n counts the symbols
    seen there and d the different ones (escape method C). What escapes is shared among the
    unseen symbols as the next shorter context would, with the seen ones excluded. The shortest
    context escapes to equal shares. Each byte that was learned is a symbol; all others, which no
    language knows, are one more. So a context's probabilities sum to one in each language.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        if not counts:
            return
        byte_n = sum((np.bincount(g & 255, c, 256) for g, c in counts.values()), np.zeros(256))
        order = np.flatnonzero(byte_n)
        size = self.size = min(len(order) + 1, 256)
        self.symbol = np.full(256, size - 1, np.uint32)
        self.symbol[order] = np.arange(len(order))
        coded = {}
        for lang, (g, c) in counts.items():
            code = np.zeros(len(g), np.uint32)
            for shift in (24, 16, 8, 0):
                code = code * size + self.symbol[(g >> shift) & 255]
            coded[lang] = (code, c)
        # known contexts by length, over all languages
        known = [np.zeros(1, np.int64)]
        for k in range(1, ORDER + 1):
            all_codes = np.concatenate([(code // size) % size**k for code, _ in coded.values()])
            seen = np.bincount(all_codes, np.concatenate([c for _, c in coded.values()]), size**k)
            known.append(np.flatnonzero(seen >= LEAST))
        first = np.cumsum([0, *map(len, known)])
        self.state = np.zeros(size**ORDER, np.int32)
        longest = np.arange(size**ORDER)
        for k in range(1, ORDER + 1):
            where = np.full(size**k, -1, np.int64)
            where[known[k]] = first[k] + np.arange(len(known[k]))
            at = where[longest % size**k]
            self.state[at >= 0] = at[at >= 0]
        self.bits = np.zeros((first[-1] * size, len(self.langs)), np.float32)
        for col, lang in enumerate(self.langs):
            code, c = coded[lang]
            shorter = np.full((1, size), 1 / size)
            short_at = np.zeros(size ** max(ORDER, 1), np.int64)
            for k in range(ORDER + 1):
                where = np.full(size**k, -1, np.int64)
                where[known[k]] = np.arange(len(known[k]))
                ctx = where[(code // size) % size**k]
                n = np.bincount(ctx[ctx >= 0] * size + (code % size)[ctx >= 0], c[ctx >= 0], len(known[k]) * size).reshape(-1, size)
                parent = shorter if k == 0 else shorter[short_at[known[k] % size ** (k - 1)]]
                total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
                free = np.where(n > 0, 0, parent)
                left = free.sum(1, keepdims=True)
                escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0)
                p = np.where(n > 0, n / np.maximum(total + np.where(left > 0, kinds, 0), 1), escape * free / np.maximum(left, 1e-300))
                p = np.where(total > 0, p, parent)
                self.bits[first[k] * size : first[k + 1] * size, col] = -np.log2(np.maximum(p, 1e-12)).reshape(-1)
                shorter, short_at = p, where
                # a context of one length that is known has all its suffixes known, as they occur at least as often

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; a text starts after spaces. Long texts are read in parts."""
        out = np.zeros((len(texts), len(self.langs)))
        long = [i for i, t in enumerate(texts) if len(t) > PART]
        for i in long:
            whole = _SPLIT + texts[i]
            for low in range(0, len(texts[i]), PART):
                out[i] += self._bits(whole[low : low + PART + ORDER]).sum(axis=0, dtype=np.float64)
        lens = np.array([0 if len(t) > PART else len(t) for t in texts], np.int64)
        bits = self._bits(_SPLIT + _SPLIT.join(b"" if len(t) > PART else t for t in texts))
        begin = np.cumsum(lens + ORDER) - lens - ORDER
        full = lens > 0
        edges = np.stack([begin[full], begin[full] + lens[full]], 1).reshape(-1)
        if len(edges):
            padded = np.concatenate([bits, np.zeros((1, bits.shape[1]), np.float32)])
            out[full] = np.add.reduceat(padded, edges, axis=0, dtype=np.float64)[::2]
        return out

    def _bits(self, data: bytes) -> np.ndarray:
        """Code length in each language of each byte after the first ORDER."""
        code = self.symbol[np.frombuffer(data, np.uint8)]
        context = (code[:-3] * np.uint32(self.size) + code[1:-2]) * np.uint32(self.size) + code[2:-1]
        return self.bits[self.state[context].astype(np.int64) * self.size + code[3:]]


def learned(train: DataFrame) -> ContextTrees:
    """Trees from (lang, id, text): about :data:`SAMPLE_BYTES` of each language's whole texts.

    A language's texts are counted in one task, which their bound allows; the driver gets at
    most one count per different gram.
    """
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    share = {k: min(1.0, SAMPLE_BYTES / max(n or 0, 1)) for k, n in sizes.items()}
    if not share:
        return ContextTrees({})
    limits = train.sparkSession.createDataFrame([(k, int(s * 1_000_003) + 1) for k, s in share.items()], "lang string, below long")
    picked = train.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.col("below"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, n = gram_counts([letters(t) for t in pdf["text"]])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "grams": [grams.astype("<u4").tobytes()], "n": [n.astype("<i8").tobytes()]})

    rows = picked.select("lang", "text").groupBy("lang").applyInPandas(count, "lang string, grams binary, n binary").collect()
    return ContextTrees({r["lang"]: (np.frombuffer(r["grams"], "<u4"), np.frombuffer(r["n"], "<i8")) for r in rows})


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document.

    Learns from the documents that are not held out and have a text and a language. The
    prediction is the language in which the whole text takes the fewest bits (ties: the first
    by name); the score is its share of 2^-bits. A null text and a text without letters give
    ``und`` and 0, and so does every text when nothing was learned. A prediction sees the text
    alone. Rows that repeat are predicted one by one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    trees = rows.sparkSession.sparkContext.broadcast(learned(rows.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "id", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees.value
        for batch in batches:
            low, held, texts = 0, 0, []
            for k, t in enumerate(batch.column(2)):
                texts.append(letters(t.as_py()))
                held += len(texts[-1])
                if held < 1 << 20 and k < batch.num_rows - 1:
                    continue
                lang_pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known.langs:
                    bits = known.code_lengths(texts)
                    best = bits.argmin(1)
                    share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    for i, x in enumerate(texts):
                        if x:
                            lang_pred[i], score[i] = known.langs[best[i]], share[i]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.array(lang_pred, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"]
                )
                low, held, texts = k + 1, 0, []

    kind = rows.schema["id"].dataType.simpleString()
    return bounded_batches(rows).select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; those whose crc32(doc_id) is a multiple of 5 are held out."""
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return identify(documents(spark, sf_dir), out).withColumnRenamed("id", "doc_id")
