"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Only DataFrame functions are used.  The n-grams of a text are its words and the last three characters of each word;
each is hashed into one of ``BUCKETS`` buckets.  Bucket counts over all documents give the raw multinomial, those over
trusted documents the target; a document's score is the mean log ratio of its n-grams, and it passes at ``THRESHOLD``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

#: Buckets of the two multinomials: what is gathered on the driver is bounded by them.
BUCKETS = 1 << 16
#: Blocks of trusted ids that are broadcast at most; adjoining ids of 67 million documents have as many.
BLOCKS = 1 << 20
#: Pseudo-count of a bucket, and the mean log ratio (nats an n-gram) from which a document passes.
SMOOTHING, THRESHOLD = 1.0, -0.5
#: Log ratios are rounded to this fraction, so that sums don't depend on their order.
UNIT = 1 << 20

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"#*$%&|<>"
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def hashed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with words, word hashes ``wh`` and the n-grams' buckets ``grams``."""
    out = docs.withColumn("words", words_of(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    out = out.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w))).withColumn("ends", F.transform("words", lambda w: _bucket(F.xxhash64(F.substring(w, -3, 3), F.lit(3)))))
    return out.withColumn("grams", F.concat("ends", F.transform("wh", _bucket))).drop("ends")


def _place(ident: Column) -> tuple[Column, Column]:
    """The block of 64 ids in which ``ident`` lies, and its bit there."""
    return F.shiftright(ident, 6), ident.bitwiseAND(F.lit(63)).cast("int")


def blocks_of(ids: DataFrame, ident: str) -> DataFrame:
    """The ids as a set: a row (block, mask) per block of 64 ids that holds any; null ids are left out."""
    block, bit = _place(F.col(ident).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return ids.select(block.alias("block"), one.alias("one")).filter("block IS NOT NULL").groupBy("block").agg(F.bit_or("one").alias("mask"))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str, ident: str) -> list[int]:
    """The log ratio of each bucket in 1 / UNIT, counted over all documents and all trusted ones; all zero without
    trusted documents.

    The trusted ids are written as blocks, in which ids that lie close take a bit each.  At most BLOCKS of them are
    broadcast, so that no text moves; of more, which many scattered ids have, Spark joins both sides as their sizes ask.
    """
    known = written(blocks_of(trusted, ident), "trusted")
    few = known.count() <= BLOCKS
    block, bit = _place(F.col(ident).cast("long"))
    flagged = docs.select(F.col(text).alias("text"), block.alias("block"), bit.alias("bit")).join(F.broadcast(known) if few else known, "block", "left")
    flagged = flagged.select("text", F.when(F.getbit("mask", "bit") == 1, 1).alias("trusted"))
    grams = hashed(flagged, "text").select("trusted", F.explode("grams").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    rows = counts.collect()
    dropped(known)
    raw, target = sum(r.raw for r in rows), sum(r.target for r in rows)
    if not target:
        return [0] * BUCKETS
    import math

    base = math.log((raw + SMOOTHING * BUCKETS) / (target + SMOOTHING * BUCKETS))
    out = [round(base * UNIT)] * BUCKETS
    for r in rows:
        out[r.bucket] = round((math.log((r.target + SMOOTHING) / (r.raw + SMOOTHING)) + base) * UNIT)
    return out


def base_rules(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to what ``hashed`` returns."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = docs.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = (
        lines.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines", "words")
    )
    # windows by hash; only texts with an equal pair go on to sorting and covering
    window = lambda i: F.xxhash64(*(F.get("wh", i + k) for k in range(WINDOW)))
    out = out.withColumn("_win", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), window)))
    out = out.withColumn("_pairs", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = lambda x, j: (F.get("_pairs", j - 1)["h"] == x["h"]) | (F.get("_pairs", j + 1)["h"] == x["h"])
    out = out.withColumn("_at", F.when(F.col("_pairs").isNotNull(), F.sort_array(F.transform(F.filter("_pairs", again), lambda x: x["i"]))))
    gap = lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - v, F.lit(WINDOW)))
    out = out.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.aggregate(F.transform("_at", gap), F.lit(0), lambda a, b: a + b)).cast("long"))
    return out.drop("_win", "_pairs", "_at").withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", ident: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    ``trusted`` has the ids of trusted documents.  ``llr`` is null for a text without words.  A null text has no words
    and so fails the base rules; null ids are never trusted; without trusted documents every llr is 0 and passes.
    Repeated rows are judged alike, and columns other than the two named are ignored.
    """
    ratios = log_ratios(docs, trusted, text, ident)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    out = base_rules(hashed(rows, "text"), "text")
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(table, g))
    out = out.withColumn("llr", total / (F.size("grams") * F.lit(float(UNIT))))
    out = out.withColumn("llr", F.when(F.col("n_words") > 0, F.col("llr")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", kept.alias("kept"))
