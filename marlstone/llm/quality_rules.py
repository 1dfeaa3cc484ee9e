"""Quality rules judged by host: rule failures per host, shrunk with an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE_CLASS, WORD_CLASS, documents, small, words, written

WINDOW = 5
RULES = ("base", "symbols", "dup_lines")
#: Standard deviations above the prior's mean at its upper quartile; of a one-sided bound of 95%.
QUARTILE, BOUND = 0.6745, 1.645


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with the word and line measures of each whole text.

    Added columns: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).
    Null or empty text counts as a text without words. Everything is computed inside the row,
    so nothing is shuffled and a long text costs n log n at most. Windows of five words are
    compared by their 64-bit xxHash.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_CLASS))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    step = docs.select(
        *keep,
        F.length(F.regexp_replace(t, SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        words(F.col(text)).alias("__words"),
    )
    w = F.col("__words")
    step = step.withColumn(
        "__hashes",
        F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    h = F.col("__hashes")
    step = step.withColumn(
        "__sorted",
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )
    s = F.col("__sorted")
    twice = F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return step.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(s) > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def rule_failures() -> dict[str, Column]:
    """The rules by name: base (too few or too repetitive words), symbols, repeated lines."""
    c = F.col
    return {
        "base": (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words")),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


def host_verdicts(measured: DataFrame, host: str, max_rate: float = 0.5) -> DataFrame:
    """One row per host (null is a host): n, shrunk rate per rule, host_ok, and for each rule whether it is watched.

    The prior of each rule is a beta distribution fitted by moments to the hosts' failure
    rates, less the variance that sampling alone gives these rates; a host's rate is its
    posterior mean, so that a host with few documents stays near the prior, and hosts that
    differ no more than by chance get one rate. The prior's strength is kept between 1 and a
    million documents. A host with a rate above ``max_rate`` is bad. It is watched in a rule if
    it stands out from the other hosts: its rate is above the prior's upper quartile, and the
    lower bound of its posterior above the prior's mean. So hosts that are alike are not watched,
    however often the rule fails.
    """
    fails = rule_failures()
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e.cast("long")).alias(r) for r, e in fails.items()]
    )
    long = hosts.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("fails")) for r in fails])).alias("x")).select(
        "host", "n", "x.rule", "x.fails"
    )
    rate = F.col("fails") / F.col("n")
    prior = long.groupBy("rule").agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("all"), F.avg(1 / F.col("n")).alias("r"))
    v = F.col("all") - F.col("m") * (1 - F.col("m")) * F.col("r")
    strength = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("m") * (1 - F.col("m")) / v - 1))).otherwise(F.lit(1e6))
    prior = prior.select("rule", "m", strength.alias("k"))
    shrunk = long.join(F.broadcast(prior), "rule").withColumn("rate", (F.col("fails") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k")))
    p, m, k = F.col("rate"), F.col("m"), F.col("k")
    apart = (p - BOUND * F.sqrt(p * (1 - p) / (F.col("n") + k + 1)) > m) & (p > m + QUARTILE * F.sqrt(m * (1 - m) / (k + 1)))
    own = {r: F.max(F.when(F.col("rule") == r, p)) for r in fails}
    return shrunk.groupBy("host").agg(
        F.max("n").alias("host_n"),
        *[x.alias(f"rate_{r}") for r, x in own.items()],
        *[F.bool_or((F.col("rule") == r) & apart).alias(f"watch_{r}") for r in fails],
        (F.max("rate") <= max_rate).alias("host_ok"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Measures, base verdict and the verdict that a document gets through its host.

    All documents of a bad host go, and so do those that fail a rule in which their host is
    watched; in other hosts a document that fails it may be sound and stays. Equal documents of
    two hosts can so get different verdicts.
    The measures go to a scratch table first: the texts are read once, the hosts' sums come
    from partial aggregates, and the verdicts return by a broadcast join if the hosts are few
    (:data:`~marlstone.llm.common.BROADCAST_ROWS`), else by a shuffle join that splits skewed hosts.
    An empty table gives no rows; repeated rows are judged one by one. Columns other than id,
    text and host are not read, so their names can't clash.
    """
    measured = written(text_measures(docs.select(F.col(id_col), F.col(text), F.col(host).alias("__host")), text))
    verdicts = host_verdicts(measured, "__host", max_rate)
    joined = measured.join(small(written(verdicts)), F.col("__host").eqNullSafe(F.col("host")), "left")
    fails = rule_failures()
    seen = [F.col(f"watch_{r}") & f for r, f in fails.items()]
    watched = seen[0] | seen[1] | seen[2]
    return joined.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        fails["base"].alias("base_failed"), (~fails["base"] & F.col("host_ok") & ~watched).alias("kept"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged with their source as the host."""
    return judge(documents(spark, sf_dir)).drop("n_lines")


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base, 10 * n_symbols > n_words AS symbols,
         10 * n_dup_lines > 3 * n_lines AS dup_lines FROM m
), h AS (
  SELECT source, rule, count(*) AS n, sum(bad::INT) AS fails
  FROM (SELECT source, 'base' AS rule, base AS bad FROM f UNION ALL SELECT source, 'symbols', symbols FROM f
        UNION ALL SELECT source, 'dup_lines', dup_lines FROM f) GROUP BY source, rule
), p AS (
  SELECT rule, avg(fails / n) AS mu, var_pop(fails / n) AS a, avg(1 / n) AS r FROM h GROUP BY rule
), k AS (
  SELECT rule, mu, CASE WHEN a - mu * (1 - mu) * r > 0 THEN greatest(1.0, least(1e6, mu * (1 - mu) / (a - mu * (1 - mu) * r) - 1)) ELSE 1e6 END AS k FROM p
), sh AS (
  SELECT source, rule, n, mu, k, (fails + mu * k) / (n + k) AS rate FROM h JOIN k USING (rule)
), ap AS (
  SELECT *, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > mu AND rate > mu + 0.6745 * sqrt(mu * (1 - mu) / (k + 1)) AS apart FROM sh
), hv AS (
  SELECT source, max(rate) <= 0.5 AS ok, bool_or(rule = 'symbols' AND apart) AS watch_symbols, bool_or(rule = 'dup_lines' AND apart) AS watch_dup_lines
  FROM ap GROUP BY source
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
       NOT base AND ok AND NOT (watch_symbols AND symbols) AND NOT (watch_dup_lines AND dup_lines) AS kept
FROM f JOIN hv ON f.source IS NOT DISTINCT FROM hv.source
"""
