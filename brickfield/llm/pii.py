"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Base kinds are reported whenever their check holds: email, ip (parts at most 255), card (Luhn) and phone (10 to 15
digits). Three kinds are added: iban (its country's length, mod-97), as one word or in printed groups; and two weak
patterns whose score passes only beside a context word: ssn, and local, a telephone number of ten digits without a country.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows and extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brickfield.llm.common import packed, unpacked
from brickfield.llm.spans import count_of, listing, walk, with_spans

# The length of an IBAN by its country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())

# The kinds in their order with their patterns. The guards before a match let the search skip starts
# inside a run of digits or name characters, or that no IBAN has; they change no match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
}
BASE = ("email", "ip", "card", "phone")
#: Words near a span that raise its score.
CONTEXT = {
    "email": r"(?i:mail|contact)", "ip": r"(?i:\bip\b|host|server|address)", "card": r"(?i:card|visa|credit|payment)",
    "phone": r"(?i:phone|call|tel|mobile)", "iban": r"(?i:iban|account|bank)", "ssn": r"(?i:ssn|social|security)", "local": r"(?i:phone|call|tel|mobile)",
}
#: Score of a span on its own and what a context word adds.
ALONE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "local": 0.3}
NEARBY = 0.2
#: The least score of an added kind. Base kinds stay whatever their score.
LEAST = 0.5


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """True if the digits pass the Luhn check."""
    d = digits(hit)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(F.reverse(d), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def mod97(hit: Column) -> Column:
    """True if the IBAN's remainder is 1: its first four characters moved to the end, letters read as 10 to 35."""
    whole = F.replace(hit, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(whole, 5, 100), F.substring(whole, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + (c - 55)) % 97).otherwise((rest * 10 + (c - 48)) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def small_parts(hit: Column) -> Column:
    """True if no dotted part is over 255."""
    parts = F.split(F.regexp_replace(hit, r"(?<![0-9])0+(?=[0-9])", ""), r"\.")
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))


def checks(kind: str, hit: Column, before: Column, after: Column) -> Column:
    if kind == "local":  # not a part of a longer number
        return ~F.rlike(before, F.lit(r"[0-9+][\x20.()-]{0,2}$")) & ~F.rlike(after, F.lit("^[0-9]"))
    if kind == "ip":
        return small_parts(hit)
    if kind == "card":
        return luhn(hit)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    near = F.rlike(before, F.lit(CONTEXT[kind])) | F.rlike(after, F.lit(CONTEXT[kind]))
    return F.lit(ALONE[kind]) + F.when(near, F.lit(NEARBY)).otherwise(F.lit(0.0))


def spans_in(docs: DataFrame, text: str) -> DataFrame:
    """docs packed, with `base` and `added`: arrays of spans with kind, text and score; and how many of each base kind."""
    df = packed(docs, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        passes = (lambda hit, before, after, k=kind: checks(k, hit, before, after)) if kind in BASE else (
            lambda hit, before, after, k=kind: checks(k, hit, before, after) & (score(k, before, after) >= LEAST))
        df = with_spans(df, f"_{kind}", "_t", pattern, rank, kind, passes, lambda hit, before, after, k=kind: score(k, before, after))
    cols = [f"_{k}" for k in PATTERNS]
    df = df.withColumn("base", F.concat(*cols[: len(BASE)])).withColumn("added", F.concat(*cols[len(BASE) :]))
    for k in BASE:
        df = df.withColumn(f"n_{k}", count_of(F.col(f"_{k}")))
    return df.drop("_t", *cols)


def find_pii(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with `base` and `added`, and `n_` and each base kind, under a prefix; columns of docs that bear those very names give way."""
    own = ["base", "added", *[f"n_{k}" for k in BASE]]
    kept = [c for c in docs.columns if c not in [prefix + c for c in own]]
    return spans_in(docs, text).select(*unpacked(kept), *[F.col(c).alias(prefix + c) for c in own])


def pii_digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"))
    spans = F.sort_array(F.concat("base", "added"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"), listing(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 1)), ",").alias("scores"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; of overlapping spans the first one stands."""
    found, said = spans_in(docs, text), F.col("row").getField(text)
    found = found.withColumn("_s", F.sort_array(F.concat("base", "added")))
    span = lambda i: F.get(F.col("_s"), i)
    stands = lambda at, i: span(i)["start"] >= at
    move = lambda at, i: F.when(stands(at, i), span(i)["end"]).otherwise(at)
    piece = lambda at, i: F.concat(F.substring(said, at + 1, span(i)["start"] - at), F.lit("<"), span(i)["kind"], F.lit(">"))
    pieces = walk(F.size("_s"), F.lit(0), move, stands, piece, "string")
    end = F.aggregate(F.sequence(F.lit(0), F.size("_s") - 1), F.lit(0), move)
    clean = F.concat(F.array_join(pieces, ""), F.substring(said, end + 1, F.length(said)))
    return found.select(*unpacked(docs.columns, **{text: F.when(F.size("_s") > 0, clean).otherwise(said)}))
