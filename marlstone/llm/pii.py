"""Personal data: fixed patterns, and spans added by weak supervision.

Labelers (patterns, gazetteers, context words) vote on candidate spans; expectation
maximisation estimates how reliable each labeler is and how likely each candidate; a span
classifier trained on these soft labels decides which candidates to add. All of it is built
from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import documents, fresh, let, replaced, small, written
from marlstone.llm.spans import listed, matches, no_spans, of_kind, placed

KINDS = ("email", "ip", "card", "phone")
#: Kinds without a fixed pattern of the contract; only the classifier adds their spans.
MORE_KINDS = ("iban", "key", "name")
# Each pattern starts where a run starts or where the last match ended, so no run is scanned twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What parts digits that single spaces or hyphens do not join.
NOT_JOINED = r"[^0-9]{2,}|[^0-9\x20-]"
HIDDEN_EMAIL = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}){1,4}"

# Looser forms: addresses with marked dots, of eight groups, or with other numbers of parts; accounts; credentials; names.
LOOSE_IP = (
    r"(?=[0-9]{1,3}\x20?[\[(])(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(](?:\.|dot)[\])]\x20?[0-9]{1,3}){3}(?![0-9])|(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    r"|(?=[0-9]{1,4}\.[0-9])(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,}+(?![0-9])"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KEY_NAMES, MORE_KEY_NAMES = "password|passwd|secret|token|api_?key", "passphrase|passcode|pwd|pin|access_?key|auth"
KEY = rf"""(?=[pPsStTaA][aAsSwWiIeEoOpPcCuU])(?i:{KEY_NAMES}|{MORE_KEY_NAMES})["']?\x20{{0,3}}[:=]\x20{{0,3}}["']?[A-Za-z0-9+/_.=-]{{4,}}+["']?"""

# Gazetteers and context words of the labelers.
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sra?|Señora?)\.?"
GIVEN_NAMES = (
    "Anna|Antonio|Barbara|Carlos|Carmen|Charles|Christine|David|Elizabeth|Emma|Francois|Françoise|Hans|Heinz|Isabel|James|Jean|Jennifer|John|José|Juan|Julia|Karl|Klaus|"
    "Laura|Linda|Louis|Manuel|Maria|María|Marie|Mary|Michael|Michel|Monika|Nathalie|Patricia|Paul|Peter|Petra|Philippe|Pierre|Robert|Sabine|Sarah|Sophie|Susan|Thomas|Ursula|William|Wolfgang"
)
WORD_OF_NAME = r"\p{Lu}[\p{L}'-]+"
NAME = rf"(?=\p{{Lu}}\p{{L}}+[.\x20])(?<!\p{{L}})(?:{TITLES}\x20{WORD_OF_NAME}|(?:{GIVEN_NAMES})\x20{WORD_OF_NAME})(?:\x20{WORD_OF_NAME}){{0,2}}"
IBAN_COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK"
DOMAIN_ENDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl"
CALLING_CODES = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CARD_STARTS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30[0-5]|3[68]"
CONTEXT = {
    "email": r"mail|contact|kontakt|correo|courriel|write to|@",
    "ip": r"\bip\b|addr|host|server|serveur|servidor",
    "card": r"card|karte|carte|tarjeta|visa|master|credit|kredit",
    "phone": r"phone|tel|call|mobile|handy|fax|ruf|móvil|appel|llam",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "key": r"login|user|admin|account|config|export|server|credential",
    "name": r"name|dear|liebe|cher|estimad|regards|sincerely|gruß|contact|author|signed",
}
#: Characters left of a candidate that the context labeler reads.
LEFT = 24
ROUNDS = 20
#: A candidate is added from this probability on.
SURE = 0.9


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def body(d: Column) -> Column:
        n = F.length(d)

        def step(a: Column, i: Column) -> Column:
            v = F.substring(d, n - i, F.lit(1)).cast("int")
            return a + F.when(i % 2 == 1, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0

    return let(digits, body)


def digit_chains(text: Column, least: int) -> Column:
    """Maximal chains of digits joined by single spaces or hyphens, in texts with ``least`` digits in a chain."""
    parts, gaps = F.split(text, NOT_JOINED, -1), F.regexp_extract_all(text, F.lit(NOT_JOINED), F.lit(0))
    chains = placed(F.concat(F.array(F.lit("")), gaps), parts)
    bare = F.transform(
        F.filter(chains, lambda x: F.length(_digits(x["s"])) >= least),
        lambda x: F.struct(
            (x["start"] + F.when(x["s"].rlike("^[ -]"), 1).otherwise(0)).cast("int").alias("start"),
            (x["end"] - F.when(x["s"].rlike("[ -]$"), 1).otherwise(0)).cast("int").alias("end"),
            F.regexp_replace(x["s"], "^[ -]|[ -]$", "").alias("s"),
        ),
    )
    return F.when(text.rlike(f"(?:[0-9][ -]?){{{least}}}"), bare).otherwise(no_spans())


def is_card(s: Column) -> Column:
    d = _digits(s)
    return F.length(d).between(12, 19) & luhn(d)


def is_iban(s: Column) -> Column:
    """Whether the account number, moved by four places and with letters as 10 to 35, leaves 1 modulo 97."""

    def step(a: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return (a * F.when(letter, 100).otherwise(10) + F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97

    def body(x: Column) -> Column:
        signs = F.filter(F.split(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4)), ""), lambda c: c != "")
        return F.aggregate(signs, F.lit(0), step) == 1

    return let(F.regexp_replace(s, " ", ""), body)


def base_matches(text: Column) -> dict[str, Column]:
    """The spans of the fixed patterns by kind, leftmost and non-overlapping within a kind."""
    phone = F.filter(matches(text, PHONE, "+"), lambda x: F.length(_digits(x["s"])).between(9, 15))
    return {
        "email": matches(text, EMAIL, "@"),
        "ip": F.filter(matches(text, IP), lambda x: x["s"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(digit_chains(text, 12), lambda x: is_card(x["s"])),
        "phone": phone,
    }


def base_spans(text: Column) -> Column:
    """All base spans as (start, rank, kind, end), sorted."""
    return F.sort_array(F.concat(*[of_kind(m, k, KINDS.index(k)) for k, m in base_matches(text).items()]))


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """(key, kind, start, end, base, votes, features): base spans and looser ones, one row each.

    ``key`` is the MD5 of the text. Votes are those of the labelers in order: pattern (that of
    the contract, or the strict form or check sum of a looser one), gazetteer, context words on
    the left, clean borders, grouping.
    """
    t = F.col("t")
    base = base_matches(t)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    loose_digits = F.filter(digit_chains(t, 9), lambda x: F.length(_digits(x["s"])) <= 19)
    loose = {
        "email": F.when(t.rlike(r"[\[(](?:at|AT)[\])]"), matches(t, HIDDEN_EMAIL)).otherwise(no_spans()),
        "ip": matches(t, LOOSE_IP),
        "iban": matches(t, IBAN),
        "key": F.when(t.rlike("[:=]"), matches(t, KEY)).otherwise(no_spans()),
        "name": matches(t, NAME),
        "card": F.filter(loose_digits, lambda x: F.length(_digits(x["s"])) >= 12),
        "phone": F.filter(loose_digits, lambda x: F.length(_digits(x["s"])).between(9, 15)),
    }

    def tagged(spans: Column, kind: str, valid: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), F.lit(kind).alias("kind"), F.lit(valid).alias("base")))

    found = F.concat(*[tagged(m, k, True) for k, m in base.items()], *[tagged(m, k, False) for k, m in loose.items()])

    def clear(found: Column) -> Column:
        return let(F.filter(found, lambda x: x["base"]), lambda taken: F.filter(found, lambda x: x["base"] | ~F.exists(taken, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))

    rows = rows.select("t", F.explode(let(found, clear)).alias("x")).select(F.md5("t").alias("key"), "t", "x.*")
    left = F.lower(F.substring(F.col("t"), F.greatest(F.col("start") - LEFT + 1, F.lit(1)), F.least(F.col("start"), F.lit(LEFT))))
    before, after = F.substring(F.col("t"), F.col("start"), F.when(F.col("start") > 0, 1).otherwise(0)), F.substring(F.col("t"), F.col("end") + 1, F.lit(1))
    rows = rows.select("key", "kind", "start", "end", "base", "s", left.alias("left"), before.alias("before"), after.alias("after"))
    d, kind = _digits(F.col("s")), F.col("kind")

    def by_kind(tests: dict[str, Column]) -> Column:
        out = F.lit(0)
        for k, test in tests.items():
            out = F.when(kind == k, test.cast("int")).otherwise(out)
        return out

    pattern = by_kind({
        "ip": F.col("s").contains(":") | F.regexp_replace("s", r"\x20?[\[(](?:\.|dot)[\])]\x20?", ".").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), "iban": is_iban(F.col("s")),
        "key": F.col("s").rlike(r"[:=].{0,4}(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{12,}"), "name": F.col("s").rlike(rf"^{TITLES}\x20"),
    })
    gazetteer = by_kind({
        "email": F.lower("s").rlike(rf"(?:\.|dot[\])])\x20?(?:{DOMAIN_ENDS})$"), "ip": ~F.col("s").rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."),
        "card": d.rlike(f"^(?:{CARD_STARTS})"), "phone": F.col("s").rlike(rf"^\+(?:{CALLING_CODES})"),
        "iban": F.col("s").rlike(f"^(?:{IBAN_COUNTRIES})"), "key": F.col("s").rlike(f"^(?i:{KEY_NAMES})"), "name": F.col("s").rlike(rf"(?:^|\x20)(?:{GIVEN_NAMES})(?:\x20|$)"),
    })
    context = by_kind({k: F.col("left").rlike(p) for k, p in CONTEXT.items()})
    clean = (~F.col("before").rlike("[A-Za-z0-9]") & ~F.col("after").rlike("[A-Za-z0-9]")).cast("int")
    grouped = by_kind({"email": F.col("s").contains("."), "ip": F.lit(True), "card": F.col("s").rlike("[ -]"), "phone": F.col("s").rlike(r"[ ().-]"),
                       "iban": F.length("s") >= 15, "key": F.col("s").rlike("[\"']"), "name": F.size(F.split("s", " ")) >= 3})
    votes = F.array(F.greatest(F.col("base").cast("int"), pattern), gazetteer, context, clean, grouped)
    features = F.array(
        F.concat(F.lit("length "), F.least(F.floor(F.length("s") / 4), F.lit(10)).cast("string")), F.concat(F.lit("digits "), F.least(F.length(d), F.lit(20)).cast("string")),
        F.concat(F.lit("before "), F.when(F.col("before") == "", "edge").when(F.col("before").rlike(r"\s"), "space").when(F.col("before").rlike(r"[A-Za-z0-9]"), "word").otherwise("mark")),
        F.concat(F.lit("context "), context.cast("string")), F.concat(F.lit("lead "), F.substring("s", 1, 1)),
        F.concat(F.lit("groups "), F.least(F.size(F.split("s", r"[ ().-]+")), F.lit(6)).cast("string")),
    )
    return rows.select("key", "kind", "start", "end", "base", votes.alias("votes"), features.alias("features"))


def label_model(found: DataFrame, n_labelers: int = 5) -> DataFrame:
    """(kind, votes, n, p): the probability of each vote pattern, by expectation maximisation.

    Two classes, labelers independent given the class. A kind is one row here: its at most 2^5
    patterns and their counts over all documents. Every labeler starts as mostly right.
    """
    patterns = found.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    per = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"))

    def likely(votes: Column, rates: Column) -> Column:
        return F.aggregate(F.zip_with(votes, rates, lambda v, r: F.when(v == 1, r).otherwise(1 - r)), F.lit(1.0), lambda a, x: a * x)

    def posterior(p: Column, votes: Column) -> Column:
        yes, no = p["pi"] * likely(votes, p["a"]), (1 - p["pi"]) * likely(votes, p["b"])
        return yes / (yes + no)

    def round_(p: Column, _: Column) -> Column:
        weighted = F.transform("pats", lambda x: F.struct(x["votes"].alias("votes"), x["n"].cast("double").alias("n"), (x["n"] * posterior(p, x["votes"])).alias("y")))

        def body(w: Column) -> Column:
            total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["n"])
            yes = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["y"])
            j = F.sequence(F.lit(0), F.lit(n_labelers - 1))
            a = F.transform(j, lambda k: (F.aggregate(w, F.lit(1.6), lambda s, x: s + x["y"] * F.get(x["votes"], k))) / (yes + 2))
            b = F.transform(j, lambda k: (F.aggregate(w, F.lit(0.4), lambda s, x: s + (x["n"] - x["y"]) * F.get(x["votes"], k))) / (total - yes + 2))
            return F.struct(((yes + 1) / (total + 2)).alias("pi"), a.alias("a"), b.alias("b"))

        return let(weighted, body)

    start = F.struct(F.lit(0.5).alias("pi"), F.array_repeat(F.lit(0.8), n_labelers).alias("a"), F.array_repeat(F.lit(0.2), n_labelers).alias("b"))
    per = per.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_))
    flat = per.select("kind", F.col("model"), F.explode("pats").alias("x"))
    return flat.select("kind", "x.votes", "x.n", posterior(F.col("model"), F.col("x.votes")).alias("p"))


def added_spans(docs: DataFrame, text: str) -> DataFrame:
    """(key, more): the spans that the classifier adds to a text, by the MD5 of the text.

    The classifier is naive Bayes over span features, trained on the label model's soft labels
    of all candidates; its tables have one row per kind and feature value.
    """
    found = written(candidates(docs, text))
    soft = label_model(found).select("kind", "votes", "p")  # at most 32 rows a kind
    labelled = found.join(F.broadcast(soft), ["kind", "votes"])
    sums = [F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")]
    prior = labelled.groupBy("kind").agg(*sums)
    per = labelled.select("kind", "p", F.explode("features").alias("f")).groupBy("kind", "f").agg(*sums)
    per = per.join(F.broadcast(prior.select("kind", F.col("yes").alias("y"), F.col("no").alias("z"))), "kind")
    weight = F.log((F.col("yes") + 0.5) / (F.col("y") + 1)) - F.log((F.col("no") + 0.5) / (F.col("z") + 1))
    table = per.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("f", weight))).alias("w"))
    prior = prior.select("kind", F.log((F.col("yes") + 1) / (F.col("no") + 1)).alias("bias"))
    model = F.broadcast(table.join(F.broadcast(prior), "kind"))  # a row per kind
    odds = F.aggregate("features", F.col("bias"), lambda a, f: a + F.coalesce(F.element_at("w", f), F.lit(0.0)))
    sure = found.filter("NOT base").join(model, "kind").withColumn("p", 1 / (1 + F.exp(-odds))).filter(F.col("p") >= SURE)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS + MORE_KINDS]), F.col("kind")).cast("int") - 1
    return sure.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("more"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` (the fixed patterns) and ``spans`` (the classifier's added).

    Both are sorted arrays of (start, rank, kind, end) in code points. Null text is an empty
    text. Texts are scanned twice and never shuffled unless more than
    :data:`~marlstone.llm.common.BROADCAST_ROWS` different texts have added spans; equal texts get
    equal spans. Columns of ``docs`` stay as they are, but one that is named as an added one
    gives way to it.
    """
    t, key, more = F.coalesce(F.col(text), F.lit("")), fresh(docs, "key_of_text"), fresh(docs, "more")
    added = small(written(added_spans(docs, text))).select(F.col("key").alias(key), F.col("more").alias(more))
    kept = replaced(docs, ["base_spans", "spans"])
    joined = docs.select(*kept, F.md5(t).alias(key), base_spans(t).alias("base_spans")).join(added, key, "left")
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    return joined.select(*kept, "base_spans", F.sort_array(F.concat("base_spans", F.coalesce(more, F.array().cast(kind)))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        piece = F.substring(text, a["at"] + 1, x["start"] - a["at"])
        return F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(a["out"], piece, F.lit("["), x["kind"], F.lit("]")).alias("out"))
        )

    rest = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents, as counts, a digest of the base spans, and all spans with their number."""
    d = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    n = [F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select(
        "doc_id", *n, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )
