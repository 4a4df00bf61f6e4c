"""Personal data: patterns propose spans, checksums confirm them, nearby words
adjust their scores.

Edge cases: null text counts as empty and has no span; empty tables give empty
results; repeated rows and ids each give their own row; other columns of the
input are not read (redact() passes them on).  Every text is scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import fresh, let, read

# Possessive loops: nothing that follows them could use a character they give back,
# and the regular-expression engine runs them without recursion on texts of any length.
EMAIL_CHAR = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{EMAIL_CHAR})|\G){EMAIL_CHAR}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# An account number's head; the run of words that may hold its rest is only looked at.
# Words end at ASCII letters, digits and underscores, whatever the engine's own idea of a word.
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
IBAN = rf"{BEGIN}(?=([A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}{END}))[A-Z]{{2}}[0-9]{{2}}"
#: Lengths of account numbers by country, without spaces.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
SSN = rf"{BEGIN}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{END}"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: kind: (score without context, words nearby that raise it, words that lower it)
CONTEXT = {
    "email": (0.8, "mail|email|contact|write|reach", "noreply|example"),
    "ip": (0.6, "ip|host|server|address|login|client", "version|release|section"),
    "card": (0.7, "card|visa|credit|debit|payment|charge|paid", "order|isbn|tracking|serial"),
    "phone": (0.7, "phone|tel|call|mobile|fax|dial|text", "order|isbn|tracking|serial"),
    "iban": (0.8, "iban|account|bank|transfer|bic|swift", "order|serial|part"),
    "ssn": (0.3, "ssn|social|security|taxpayer|tin", "order|serial|part"),
}
NEARBY, RAISE, LOWER, LEAST = 40, 0.2, 0.3, 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(ds: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.get(ds, i).cast("int")
            twice = (F.size(ds) - i) % 2 == 0
            return acc + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.size(ds) - 1), F.lit(0), add) % 10 == 0

    return let(F.split(number, ""), total)


def mod97(value: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97: the first four
    characters go last, letters count as 10..35, the rest is 1."""
    plain = F.regexp_replace(value, " ", "")

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    turned = let(plain, lambda v: F.concat(F.substring(v, 5, F.length(v)), F.substring(v, 1, 4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def account(run: Column) -> Column:
    """The account number that a run of words begins with, or null: of the parts
    that end at a word's end and pass mod 97, that of the country's length, else
    the longest."""
    plain = lambda v: F.regexp_replace(v, " ", "")
    lengths = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n)])

    def parts(ws: Column) -> Column:
        return F.transform(F.sequence(F.size(ws), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(ws, 1, k), " "))

    def best(passed: Column) -> Column:
        own = F.filter(passed, lambda v: F.length(plain(v)) == F.try_element_at(lengths, F.substring(v, 1, 2)))
        return F.coalesce(F.get(own, F.lit(0)), F.get(passed, F.lit(0)))

    passing = F.filter(let(F.split(run, " "), parts), lambda v: (F.length(plain(v)) >= 15) & mod97(v))
    return let(passing, best)


def card_like(value: Column) -> Column:
    return let(digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


def octets(value: Column) -> Column:
    """Four numbers of at most 255 each, however many zeros lead."""
    return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.concat(F.lit("0"), F.substring(q, 1, 4)).cast("int") <= 255)))


def scored(text: Column, found: Column) -> Column:
    """The spans with scores: by kind, and by words within NEARBY characters."""

    def score(s: Column) -> Column:
        left = F.substring(text, F.greatest(s["start"] - NEARBY, F.lit(0)) + 1, F.least(s["start"], F.lit(NEARBY)))
        around = F.lower(F.concat(left, F.lit(" "), F.substring(text, s["end"] + 1, F.lit(NEARBY))))
        value = F.lit(0.0)
        for kind, (base, more, less) in CONTEXT.items():
            own = F.lit(base) + F.when(around.rlike(f"{BEGIN}(?:{more})"), RAISE).otherwise(0.0) - F.when(around.rlike(f"{BEGIN}(?:{less})"), LOWER).otherwise(0.0)
            value = F.when(s["kind"] == kind, own).otherwise(value)
        return F.round(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)), 2)

    return F.transform(found, lambda s: s.withField("score", score(s)))


def pii_spans(text: Column) -> tuple[Column, Column]:
    """(base spans, proposed further spans)."""
    email = spans.find(text, EMAIL, "email", 0, lambda v: F.lit(True), when=text.contains("@"))
    ip = spans.find(text, IP, "ip", 1, octets, when=text.contains("."))
    card = spans.find(text, CARD, "card", 2, card_like)
    phone = spans.find(text, PHONE, "phone", 3, lambda v: F.length(digits(v)).between(8, 15), when=text.contains("+"))
    iban = spans.find_ahead(text, IBAN, "iban", 4, account)
    ssn = spans.find(text, SSN, "ssn", 5, lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), when=text.contains("-"))
    return F.concat(email, ip, card, phone), F.concat(iban, ssn)


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base, found): span structs by kind, then start.  Spans of
    further kinds need a score of LEAST and may not touch a base span."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, more = pii_spans(F.col("text"))
    parts = rows.select("doc_id", "text", F.struct(base.alias("base"), more.alias("more")).alias("p"))

    def finish(p: Column) -> Column:
        own = scored(F.col("text"), F.filter(p["more"], lambda s: ~spans.overlaps(s, p["base"])))
        found = F.concat(scored(F.col("text"), p["base"]), F.filter(own, lambda s: s["score"] >= LEAST))
        return F.struct(p["base"].alias("base"), spans.by_rank(found).alias("found"))

    return parts.select("doc_id", "text", let(F.col("p"), finish).alias("q")).select("doc_id", "text", "q.base", "q.found")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by <KIND>; all columns stay, null
    texts too, and n_chars (where there is one) counts the new text."""
    base, more = pii_spans(F.coalesce(F.col(text_col), F.lit("")))
    key = fresh(docs, "proposed")
    held = docs.withColumn(key, F.struct(base.alias("base"), more.alias("more")))
    text = F.col(text_col)
    found = let(F.col(key), lambda p: spans.by_start(F.concat(
        p["base"],
        F.filter(scored(text, F.filter(p["more"], lambda s: ~spans.overlaps(s, p["base"]))), lambda s: s["score"] >= LEAST),
    )))
    clean = let(found, lambda f: spans.replaced(text, f, lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
    out = held.withColumn(text_col, clean).drop(key)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in out.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]],
        spans.digest(spans.joined(spans.by_rank(F.col("base")))).alias("base_sha256"),
        spans.joined(F.col("found")).alias("spans"),
        F.concat_ws(",", F.transform(F.col("found"), lambda s: s["score"].cast("string"))).alias("scores"),
    )
