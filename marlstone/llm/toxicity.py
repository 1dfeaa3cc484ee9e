"""Toxicity by a classifier chain over word features, trained with out-of-fold predictions."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, documents, replaced, written

#: Documents of the labelled sample that the chain is fitted on, at most (about).
SAMPLE = 20_000
FOLDS = 3
#: Labelled documents that a word must occur in to be a feature.
LEAST = 4
WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that are features beside whole words: inflected forms share them.
STEMS = (4, 5, 6)


def features(text: str | None) -> set[str]:
    """The distinct lower-case words of a whole text and their beginnings, these with a ``*``."""
    words = set(WORD.findall(text.lower())) if text else set()
    stems = {f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k}
    return words | stems


def known_features(text: str | None, words: set[str], stems: dict[int, set[str]]) -> list[str]:
    """Those of a text's features that the sets have; stems by length, without their ``*``."""
    own = set(WORD.findall(text.lower())) if text else set()
    found = list(own & words)
    for k, known in stems.items():
        found += [f"{x}*" for x in {w[:k] for w in own} & known]
    return found


class Linear:
    """Logistic regression over feature presence and dense extra columns."""

    def __init__(self, weights: np.ndarray, extra: np.ndarray, bias: float) -> None:
        self.weights, self.extra, self.bias = weights, extra, bias

    @staticmethod
    def fit(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, l2: float = 0.02, steps: int = 150) -> Linear:
        """Adam on the mean loss; rows and cols are the coordinates of the words present."""
        n, k = len(y), extra.shape[1]
        w = np.zeros(width + k + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = np.bincount(rows, w[cols], n) + extra @ w[width:-1] + w[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(n, 1)
            grad = np.r_[np.bincount(cols, g[rows], width), extra.T @ g, g.sum()] + l2 / max(n, 1) * np.r_[w[:-1], 0]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        return Linear(w[:width], w[width:-1], float(w[-1]))

    def predict(self, rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(rows, self.weights[cols], n) + extra @ self.extra + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(found: list[np.ndarray], width: int, labels: np.ndarray, fold: np.ndarray) -> list[dict]:
    """One model per category, as plain numbers: weights of the features and of earlier categories.

    ``found`` has the numbers of the features of each document. Category k is fitted on them and
    on the out-of-fold probabilities of the categories before k: each document's come from
    models that never saw it, so that later models learn from inputs like those they get for
    new documents. The model that is kept is fitted on all documents.
    """
    n, models = len(found), []
    rows = np.repeat(np.arange(n), [len(x) for x in found])
    cols = np.concatenate([*found, np.zeros(0)]).astype(np.int64)
    before = np.zeros((n, 0))
    for y in labels.T.astype(float):
        held_out = np.zeros(n)
        for f in range(FOLDS):
            test = fold == f
            index, own = np.cumsum(~test) - 1, ~test[rows]
            model = Linear.fit(index[rows[own]], cols[own], before[~test], y[~test], width)
            held_out[test] = model.predict(rows, cols, before, n)[test]
        model = Linear.fit(rows, cols, before, y, width)
        models.append({"words": model.weights.tolist(), "earlier": model.extra.tolist(), "bias": model.bias})
        before = np.c_[before, held_out]
    return models


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, categories: dict[str, Column], most: int = SAMPLE, seed: int = 5) -> DataFrame:
    """About ``most`` labelled documents, by the hash of their id, with their categories; written once.

    Of labels that repeat an id, one that is true decides.
    """
    rows = labels.count()
    share = min(1.0, most / max(rows, 1))
    chosen = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    picked = labels.filter(chosen).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in categories.items()])
    return written(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id"))  # at most about `most` rows


def informative(sample: DataFrame, categories: list[str], least: int = LEAST, score: float = 20.0, most: int = 50_000) -> list[str]:
    """Features of at least ``least`` sampled documents whose presence depends on a category.

    The test is the chi-square statistic of the two-by-two table, which rare random words fail.
    The ``most`` features of the highest statistic are kept, which bounds the model.
    Tasks count their own documents' features, so a common word is one row a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(len(categories) + 1)]
        for batch in batches:
            flags = np.array([batch.column(2 + k).to_pylist() for k in range(len(categories))]).T
            for t, own in zip(batch.column(1).to_pylist(), flags, strict=True):
                found = features(t)
                counts[0].update(found)
                for k in np.flatnonzero(own):
                    counts[k + 1].update(found)
        words = list(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())] + [pa.array([c[w] for w in words], pa.int64()) for c in counts], ["feature", "n", *categories])

    per = bounded_batches(sample).select("id", "text", *categories).mapInArrow(count, f"feature string, n long, {', '.join(f'{c} long' for c in categories)}")
    per = per.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in categories]).filter(F.col("n") >= least)
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    best = F.lit(0.0)
    for c in categories:
        share = (total[c] or 0) / max(total["n"], 1)
        if 0 < share < 1:
            spread = F.col("n") * share * (1 - share) * F.greatest(1 - F.col("n") / total["n"], F.lit(1e-9))
            best = F.greatest(best, F.pow(F.col(c) - F.col("n") * share, F.lit(2)) / spread)
    rows = per.withColumn("score", best).filter(F.col("score") >= score).orderBy(F.desc("score"), "feature").limit(most).select("feature").collect()
    return [r[0] for r in rows]


def by_kind(known: list[str]) -> tuple[set[str], dict[int, set[str]]]:
    """Whole words, and beginnings by length without their ``*``."""
    return {w for w in known if w[-1] != "*"}, {k: {w[:-1] for w in known if w[-1] == "*" and len(w) == k + 1} for k in STEMS}


def train(sample: DataFrame, categories: list[str]) -> dict:
    """The chain, fitted in one task on the bounded sample; only the model returns to the driver."""
    known = informative(sample, categories)
    at = {w: k for k, w in enumerate(known)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = by_kind(known)
        for batch in batches:
            own = [sorted(at[w] for w in known_features(t, words, stems)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(own), np.int32)), batch.column(0), pa.array(own, pa.list_(pa.int32()))] + [batch.column(2 + k) for k in range(len(categories))],
                ["g", "id", "found", *categories],
            )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        models = fit_chain(list(pdf["found"]), len(known), pdf[categories].to_numpy(), np.arange(len(pdf)) % FOLDS)
        return pd.DataFrame({"models": [json.dumps(models)]})

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("id", "text", *categories).mapInArrow(numbers, f"g int, id {kind}, found array<int>, {', '.join(f'{c} int' for c in categories)}")
    fitted = rows.groupBy("g").applyInPandas(fit, "models string").collect()
    none = [{"words": [0.0] * len(known), "earlier": [0.0] * k, "bias": -30.0} for k in range(len(categories))]
    return {"words": known, "models": json.loads(fitted[0][0]) if fitted else none}


def scored(docs: DataFrame, chain: dict, categories: list[str], text: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with <prefix><category> columns; each probability feeds the models after it.

    The whole text counts. Null and empty texts have no words, hence probability 0 throughout.
    """
    weights = {w: [m["words"][k] for m in chain["models"]] for k, w in enumerate(chain["words"])}
    models = chain["models"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = by_kind(list(weights))
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text) if at is None else at
            out = np.zeros((batch.num_rows, len(models)))
            for i, t in enumerate(batch.column(at)):
                if not (s := t.as_py()):
                    continue
                known = np.array([weights[w] for w in known_features(s, words, stems)]).reshape(-1, len(models)).sum(axis=0)
                for k, m in enumerate(models):
                    z = known[k] + float(np.dot(m["earlier"], out[i, :k])) + m["bias"]
                    out[i, k] = 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(batch.num_columns)] + [pa.array(out[:, k]) for k in range(len(models))], [*batch.schema.names, *[f"{prefix}{c}" for c in categories]]
            )

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, *[StructField(f"{prefix}{c}", DoubleType()) for c in categories]])
    return bounded_batches(docs).mapInArrow(run, schema)


def label_categories() -> dict[str, Column]:
    """The chain's categories from the labels: abuse in good text, in poor text, and last abuse at all."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return {"toxic_prose": toxic & good, "toxic_junk": toxic & ~good, "toxic": toxic}


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5, most: int = SAMPLE, prefix: str = "") -> DataFrame:
    """``docs`` with the chain's probabilities and ``toxic``: its last category at ``threshold`` or more.

    The last link reads the probabilities of all links before it, which were out-of-fold ones
    when it was fitted. Without labelled documents nothing is toxic. Repeated rows are scored one
    by one. The names of added columns start with ``prefix``; they replace columns of these names.
    """
    categories = label_categories()
    chain = train(labelled_sample(docs, labels, id_col, text, categories, most), list(categories))
    names = [f"{prefix}p_{c}" for c in categories]
    kept = docs.select(replaced(docs, [*names, f"{prefix}toxic"]))
    return scored(kept, chain, list(categories), text, f"{prefix}p_").withColumn(f"{prefix}toxic", F.col(names[-1]) >= threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their probabilities by category and whether they are toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")
