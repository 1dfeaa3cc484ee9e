"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy with an allow list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import documents, fresh, let, replaced
from marlstone.llm.spans import listed, matches, of_kind

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Strings whose entropy is measured, and the symbols that are counted, by character class. A
#: ``=`` ends a string, so a name is not measured with its value; as padding it belongs to the string.
PADDING = r"={1,2}(?![A-Za-z0-9+/_=-])"
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{20,}}+(?:{PADDING})?|[A-Za-z0-9+/_-]{{18,19}}+{PADDING})"
CLASSES = {
    "hex": ("0123456789abcdef", r"^[0-9a-fA-F]+$", 3.0),
    "upper": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^[0-9A-Z]+$", 3.6),
    "base64": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", r"^[A-Za-z0-9+/_=-]+$", 3.8),
}
#: Candidates that are never secrets as a whole: one class of symbols only, UUIDs, dates, paths and names of word-like segments.
ALLOWED = (
    r"^[0-9+/_=-]+$", r"^[A-Za-z+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:[A-Za-z]{3,}[0-9]{0,4}[/_-]+){2,}+(?:(?:[A-Za-z]{3,}[0-9]{1,4}|[A-Za-z]+|[0-9]{1,4})(?:[/_-]+|=*$))*+$",
)
#: Examples and runs; no window that one of them touches counts.
EXAMPLES = r"(?i)example|placeholder|dummy|changeme|abcdefgh|01234567|12345678"


def window_entropy(s: Column, symbols: str, width: int) -> Column:
    """The largest Shannon entropy in bits of any ``width`` adjacent characters of ``s``.

    One pass: a symbol enters and one leaves, their counts change by one, and so does the sum
    of c log2 c, from which the entropy follows. Characters outside ``symbols`` count as one more.
    """
    n = len(symbols) + 1
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(symbols)), F.lit(0)), F.lit(n)))

    def f(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def body(code: Column) -> Column:
        zero = F.struct(
            F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("i"),
        )

        def step(a: Column, x: Column) -> Column:
            out = F.when(a["i"] >= width, F.get(code, a["i"] - width)).otherwise(F.lit(0))

            def change(o: Column) -> Column:
                c_out = F.when(o > 0, F.get(a["counts"], o - 1)).otherwise(F.lit(0))
                c_in = F.get(a["counts"], x - 1) - F.when(o == x, F.lit(1)).otherwise(F.lit(0))
                total = a["sum"] + F.when(o > 0, f(c_out - 1) - f(c_out)).otherwise(F.lit(0.0)) + f(c_in + 1) - f(c_in)
                counts = F.transform(a["counts"], lambda c, j: c + F.when(j == x - 1, 1).otherwise(0) - F.when(j == o - 1, 1).otherwise(0))
                held = F.least(a["i"] + 1, F.lit(width)).cast("double")
                best = F.when(a["i"] + 1 >= width, F.greatest(a["best"], F.log2(held) - total / held)).otherwise(a["best"])
                return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"), (a["i"] + 1).alias("i"))

            return let(out, change)

        return F.aggregate(code, zero, step, lambda a: a["best"])

    return let(codes, body)


def entropy_spans(text: Column, width: int = 20) -> Column:
    """Spans of candidate strings, not allow-listed, with a window above its class's threshold that no example touches."""
    found = F.filter(matches(text, CANDIDATE), lambda x: ~x["s"].rlike("|".join(f"(?:{p})" for p in ALLOWED)))

    def high(x: Column) -> Column:
        rule = None
        for symbols, shape, least in CLASSES.values():
            s = F.lower(x["s"]) if symbols.islower() or symbols == CLASSES["hex"][0] else x["s"]
            test = F.exists(F.split(s, EXAMPLES, -1), lambda part: window_entropy(part, symbols, width) >= least)  # noqa: B023
            rule = F.when(x["s"].rlike(shape), test) if rule is None else rule.when(x["s"].rlike(shape), test)
        return rule.otherwise(F.lit(False))

    return F.filter(found, high)


def find_secrets(docs: DataFrame, text: str = "text", width: int = 20) -> DataFrame:
    """``docs`` with ``base_spans`` (the fixed patterns) and ``spans`` (entropy spans added).

    Both are arrays of (start, rank, kind, end) by start and then kind; positions count code
    points. Null text is an empty text. Nothing is shuffled; repeated rows are scanned one by
    one; a text costs one scan a pattern, and only its candidate strings cost more. Columns of
    ``docs`` stay, but one that is named as an added one gives way to it.
    """
    t, more = F.coalesce(F.col(text), F.lit("")), fresh(docs, "more")
    assign = F.filter(matches(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 1)) >= 12)
    base = F.sort_array(F.concat(of_kind(assign, "assign", 0), of_kind(matches(t, ACCESS), "access", 1), of_kind(matches(t, HEX), "hex", 2)))
    kept = replaced(docs, ["base_spans", "spans"])
    found = docs.select(*kept, base.alias("base_spans"), of_kind(entropy_spans(t, width), "entropy", 3).alias(more))
    return found.select(*kept, "base_spans", F.sort_array(F.concat("base_spans", more)).alias("spans"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, as counts, a digest of the base spans, and all spans."""
    d = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

