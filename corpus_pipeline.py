"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. What a stage returns is written as Parquet and read again as the
``docs`` of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import ngram_join, packing, pii, source_mixing, toxicity
from marlstone.llm.common import SPACE_CLASS, WORD_CLASS, documents, small, written


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic; it is fitted on ``labels``."""
    judged = toxicity.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), prefix="__chain_")
    return _like(judged.filter(~F.col("__chain_toxic")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id; a null id comes last.

    Rows are told apart by a key that is written with them, so null and repeated ids lose none
    but copies.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    groups = written(ngram_join.similar_groups(rows, "__row").filter("id <> component_id").select(F.col("id").alias("__row"), F.col("component_id").alias("__group")))
    members = small(groups.union(groups.select(F.col("__group").alias("__row"), "__group").distinct()), 1_000_000)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row")))
    of_group = written(rows.select("__row", "doc_id").join(members, "__row"))
    kept = of_group.groupBy("__group").agg(first.alias("first")).select(F.col("first.row").alias("__row"))
    gone = written(of_group.select("__row").join(small(kept), "__row", "left_anti"))
    return _like(rows.join(small(gone, 1_000_000), "__row", "left_anti"), docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind; null texts stay null."""
    found = pii.find_pii(docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text"))
    clean = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("spans")))
    rows = found.select("__row", clean.alias("__clean")).select("__row.*", "__clean")
    return _like(rows.withColumn("text", F.col("__clean")).withColumn("n_chars", F.length("text").cast("long")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the mix, shard by shard in random order; a document cut at its source's target is cut after a word.

    Draws belong to rows by a key that is written with them, so null and repeated ids lose none.
    """
    docs, plain = written(docs.withColumn("__row", F.monotonically_increasing_id())), docs
    drawn = source_mixing.mix(docs, row="__row").filter("taken > 0")
    per = written(drawn.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("shard", "place", "taken", "size")).alias("__draws")))  # at most 4 a row
    shards = (per.agg(F.max(F.array_max("__draws.shard"))).first()[0] or 0) + 1
    rows = docs.join(small(per, 300_000), "__row").withColumn("__d", F.explode("__draws"))
    cut = F.array_join(F.slice(F.split("text", f"(?<={WORD_CLASS})(?={SPACE_CLASS})", -1), F.lit(1), F.col("__d.taken").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("__d.taken") < F.col("__d.size"), cut).otherwise(F.col("text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return _like(rows.repartition(shards, "__d.shard").sortWithinPartitions("__d.shard", "__d.place"), plain)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the label model and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
