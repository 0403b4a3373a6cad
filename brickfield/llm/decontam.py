"""Benchmark decontamination with word windows.

A window is `width` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Words are
runs of digits, a-z and non-ASCII characters after A-Z are lower-cased. A document word inside any occurrence of a window
is hit.

Every window of L words holds L - g + 1 grams of g words, one of which starts at a multiple of L - g + 1 words in the
document, wherever the window lies. So it is enough to probe each document's grams at those multiples against the hash
set of all the windows' grams; the few that are found are verified by comparing whole windows. The set is broadcast while
it has at most MOST_BROADCAST rows, and so are the windows while their strings have at most common.MOST_BYTES besides;
beyond that each join shuffles on its keys.

Defined cases: null or empty texts have no words and are never hit; an item without words gives no window, one without an
id is named by the empty string; repeated rows are reported as often as they stand; an empty benchmark hits nothing;
extra columns pass through decontaminate() and are not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brickfield.llm.common import MOST_DROPPED, ascii_lower, bounded, fits, materialize, packed, unpacked

#: A word of a text whose A-Z are lower-cased, and the same of any text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a broadcast gram set (a hash each) or window table at most; a window table is bounded in bytes too.
MOST_BROADCAST = 2_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(ANY_WORD), F.lit(0)), F.array().cast("array<string>"))


def run_of(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def grams_at(words: Column, starts: Column, n: int, width: int) -> Column:
    """Hashes of the runs of n words. lower() may join letters that are to differ; verification tells them apart."""

    def gram(i: Column) -> Column:
        return F.struct(F.lit(width).alias("width"), i.alias("at"), F.xxhash64(F.lit(width), F.lower(run_of(words, i, n))).alias("gram"))

    return F.transform(starts, gram)


def shape(width: int) -> tuple[int, int]:
    """Words in a gram and the distance of probes, for windows of so many words."""
    gram = (width + 1) // 2
    return gram, width - gram + 1


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """window, width and the ids of the items that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.size("w"), F.lit(width)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("width"))
    rows = items.select("item", "width", F.explode(F.transform(starts, lambda i: run_of(F.col("w"), i, F.col("width")))).alias("window"))
    return rows.groupBy("window", "width").agg(F.collect_set("item").alias("items"))


def around(probes: DataFrame) -> DataFrame:
    """probes with `near`, the words of all windows that may hold the gram at `at`, from `base` on, instead of w.

    They start at most a step less one before it.
    """
    step = F.col("width") - F.floor((F.col("width") + 1) / 2).cast("int") + 1
    rows = probes.withColumn("base", F.greatest(F.col("at") - step + 1, F.lit(0)))
    near = F.when(F.col("width") > 0, F.slice("w", F.col("base") + 1, F.col("at") - F.col("base") + F.col("width")))
    return rows.withColumn("near", near).drop("w")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """A row per distinct (doc_id, text): copies, n_words, hits (start, width in words) and items."""
    windows = materialize(windows_of(benchmark, width), "decontam-windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # at most `width` numbers
    # A probe of width 0 stands for the document itself; its hash is its own, so a shuffle spreads these too.
    sets, probes = [], [F.array(F.struct(F.lit(0).alias("width"), F.lit(0).alias("at"), F.coalesce("row", F.lit(0)).alias("gram")))]
    n = F.size("w")
    for k in widths:
        g, step = shape(k)
        own = windows.where(F.col("width") == k).select(F.split("window", " ").alias("w"))
        sets.append(own.select(F.explode(grams_at(F.col("w"), F.sequence(F.lit(0), F.lit(step - 1)), g, k)).alias("found")).select("found.gram"))
        at = F.when(n >= g, F.sequence(F.lit(0), n - g, F.lit(step))).otherwise(F.array().cast("array<int>"))
        probes.append(grams_at(F.col("w"), at, g, k))
    grams = windows.select(F.lit(None).cast("long").alias("gram")).limit(0)
    for s in sets:
        grams = grams.unionByName(s)
    grams = materialize(grams.distinct().withColumn("seen", F.lit(True)), "decontam-grams")
    small = fits(grams, MOST_BROADCAST)

    scan = docs.select("doc_id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("w")).withColumn("n_words", n.cast("long"))
    # Outer, though probes are never empty: else the optimizer infers a filter that computes them, words and all, twice.
    probed = scan.withColumn("probes", F.concat(*probes)).select("doc_id", "row", "n_words", "w", F.inline_outer("probes"))
    is_hit = (F.col("width") == 0) | F.col("seen")
    # A probe takes the words around it along; before a shuffle rather than the whole text's, which would be there for each.
    found = around(probed.join(F.broadcast(grams), "gram", "left").where(is_hit)) if small else around(probed).join(grams.hint("merge"), "gram", "left").where(is_hit)

    starts = F.filter(F.sequence("base", "at"), lambda s: s + F.col("width") <= F.col("base") + F.size("near"))
    tries = F.transform(starts, lambda s: F.struct(s.alias("start"), ascii_lower(run_of(F.col("near"), s - F.col("base"), F.col("width"))).alias("window")))
    tries = F.when(F.col("width") > 0, tries)
    tried = found.withColumn("tries", tries).select("doc_id", "row", "n_words", "width", F.inline_outer("tries"))
    hits = tried.join(bounded(windows, MOST_BROADCAST), ["window", "width"], "left").where((F.col("width") == 0) | F.col("items").isNotNull())
    per_doc = hits.groupBy("doc_id", "row").agg(
        F.count(F.when(F.col("width") == 0, 1)).alias("copies"), F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("width") > 0, F.struct("start", "width"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    words = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["width"] - 1))))
    return per_doc.withColumn("hit_words", words)


def leak_digest(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The columns of the decontamination report, one row per document."""
    found = find_leaks(docs, benchmark, width)
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents") -> DataFrame:
    """docs without the documents that are hit, or ("spans") without their hit words and what follows each of them."""
    found = find_leaks(docs, benchmark, width).where(F.size("hit_words") > 0)
    found = materialize(found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("hit_words").alias("_hit")), "decontam-hits")
    rows, same = packed(docs, "doc_id", F.xxhash64("text").alias("hash")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_row"))
    if remove == "documents":
        return rows.join(bounded(found.select("_id", "_row"), MOST_DROPPED), same, "left_anti").select(*unpacked(docs.columns))
    text = F.col("row.text")
    words, between = words_of(text), F.split(text, ANY_WORD, -1)
    kept = F.filter(F.transform(words, lambda w, i: F.when(~F.array_contains(F.col("_hit"), i), F.concat(w, F.get(between, i + 1)))), lambda x: x.isNotNull())
    cut = F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
    return rows.join(found, same, "left").select(*unpacked(docs.columns, text=F.when(F.col("_hit").isNotNull(), cut).otherwise(text)))
