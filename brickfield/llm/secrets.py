"""Secrets: certain patterns, and weak candidates linked to the other parts of a credential.

Base kinds stand on their own: assign, access and hex. Weak parts are secret (a run of exactly 40 base64 characters with
upper and lower case and a digit) and endpoint (a URL's scheme and host). They are reported only when parts that
complement each other share a scope: a secret needs an access identifier within REACH characters, an endpoint a secret
so linked within REACH characters. Each is linked to the nearest such part, of equally near ones to the first, and the
chains of links are the credentials. The links are interval joins, bucketed by REACH: matches of one kind don't overlap, so
a part meets as many others as fit around it at most.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows are reported as often as they
stand; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brickfield.llm.common import materialize
from brickfield.llm.spans import SPAN, count_of, listing, no_spans, with_spans

# The kinds in their order with their patterns.
PATTERNS = {
    "assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "secret": r"[A-Za-z0-9+/]{40,}",
    "endpoint": r"https?://[A-Za-z0-9.-]+",
}
BASE = ("assign", "access", "hex")
#: Characters between two parts of one credential at most.
REACH = 256


def checks(kind: str, hit: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(hit, PATTERNS["assign"], 2)) >= 12
    if kind == "secret":
        return (F.length(hit) == 40) & F.rlike(hit, F.lit("[A-Z]")) & F.rlike(hit, F.lit("[a-z]")) & F.rlike(hit, F.lit("[0-9]"))
    return F.lit(True)


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, a row key, base spans and weak ones."""
    df = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_t"))
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        df = with_spans(df, f"_{kind}", "_t", pattern, rank, kind, lambda hit, before, after, k=kind: checks(k, hit))
    cols = [f"_{k}" for k in PATTERNS]
    counts = [count_of(F.col(f"_{k}")).alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", "row", *counts, F.concat(*cols[:3]).alias("base"), F.concat(*cols[3:]).alias("weak"))


def nearest(parts: DataFrame, others: DataFrame) -> DataFrame:
    """row, start and end of parts that have one of others within REACH characters, and to_start and to_end, the nearest one."""
    first, last = F.floor((F.col("start") - REACH) / REACH), F.floor((F.col("end") + REACH) / REACH)
    spread = others.select("row", F.explode(F.sequence(first, last)).alias("bucket"), F.col("start").alias("to_start"), F.col("end").alias("to_end"))
    left = parts.select("row", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / REACH), F.floor(F.col("end") / REACH))).alias("bucket"))
    apart = F.greatest(F.lit(0), F.col("to_start") - F.col("end"), F.col("start") - F.col("to_end"))
    pairs = left.join(spread, ["row", "bucket"]).where(apart <= REACH)
    best = F.min(F.struct(apart.alias("apart"), "to_start", "to_end"))
    return pairs.groupBy("row", "start", "end").agg(best.alias("b")).select("row", "start", "end", "b.to_start", "b.to_end")


def link(proposed: DataFrame) -> DataFrame:
    """row, the weak spans that complementary parts confirm, and the credentials. proposed must be cheap to read again."""
    both = proposed.where((F.size("weak") > 0) & (F.col("n_access") > 0)).select("row", F.explode(F.concat("base", "weak")).alias("s"))
    spans = both.select("row", "s.*").distinct()  # rows that repeat have the same spans
    of = lambda kind: spans.where(F.col("kind") == kind)
    secrets = materialize(nearest(of("secret"), of("access")), "secret-links")
    endpoints = materialize(nearest(of("endpoint"), secrets), "secret-endpoints")
    ends = secrets.select("row", "start", "end").unionByName(endpoints.select("row", "start", "end"))
    confirmed = of("secret").unionByName(of("endpoint")).join(ends, ["row", "start", "end"], "left_semi")
    confirmed = confirmed.groupBy("row").agg(F.collect_set(F.struct("start", "rank", "end", "kind", "hit", "score")).cast(SPAN).alias("added"))
    hosts = endpoints.select("row", F.col("to_start").alias("start"), F.col("start").alias("endpoint_start"), F.col("end").alias("endpoint_end"))
    chains = secrets.join(hosts, ["row", "start"], "left").select(
        "row", F.col("start").alias("secret_start"), F.col("end").alias("secret_end"), F.col("to_start").alias("access_start"), F.col("to_end").alias("access_end"),
        "endpoint_start", "endpoint_end",
    )
    chains = chains.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*chains.columns[1:]))).alias("credentials"))
    return confirmed.join(chains, "row")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per document: doc_id, counts of base kinds, base and added spans, and credentials.

    A credential has the places of a secret, its access identifier and its endpoint: one row for each endpoint linked to
    the secret, or one without an endpoint.
    """
    proposed = materialize(propose(docs, text), "secret-spans")
    none = F.array().cast("array<struct<secret_start:int,secret_end:int,access_start:int,access_end:int,endpoint_start:int,endpoint_end:int>>")
    found = proposed.join(link(proposed), "row", "left")
    return found.withColumn("added", F.coalesce("added", no_spans())).withColumn("credentials", F.coalesce("credentials", none)).drop("row", "weak")


def chain(c: Column) -> Column:
    """A credential as the places of its parts."""
    parts = [F.concat_ws(":", F.lit(k), c[f"{k}_start"], c[f"{k}_end"]) for k in ("access", "secret", "endpoint")]
    return F.concat_ws("+", parts[0], parts[1], F.when(c["endpoint_start"].isNotNull(), parts[2]))


def secrets_digest(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    return found.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listing(F.concat("base", "added")).alias("spans"), F.array_join(F.transform("credentials", chain), ",").alias("credentials"),
    )
