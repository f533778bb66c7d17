"""Quality rules with host-level verdicts; DataFrame functions only.

A document fails the base rule if it has fewer than `min_words` words, or if more than half of its
words lie in three-word windows that occur at least twice in it. Failures are aggregated by host (the
`source` column). A host's failure rate is shrunk towards the corpus by a beta prior fitted to all
hosts by the method of moments, so that a host with few documents is not judged on them alone; a
host whose shrunk rate exceeds `max_rate` is rejected, and its verdict is joined back to its documents.

Scale. Repeated windows are found inside the row: 64-bit hashes of the windows are sorted with
their positions, neighbours with equal hashes are repeats. Host counts combine before the
shuffle, the prior needs one row of five sums, and the join back to the documents is left to
Spark, which broadcasts the hosts' table if its files are small and splits a hot host otherwise.

Results for odd input: a null, empty or blank text has no words and fails; a null host is a host of
its own; repeated rows count each; an empty table gives an empty table; other columns are ignored
(assess, keep_good: passed through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE_CHARS, SPACES, kept_table

MIN_WORDS, MAX_REPEATED, MAX_RATE = 50, 50, 0.5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_measures(docs: DataFrame) -> DataFrame:
    """docs and _sl_<measure> for each of MEASURES, and _sl_base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    n = F.size("_sl_words")

    def windows() -> Column:
        three = F.arrays_zip(F.col("_sl_words").alias("a"), F.expr("slice(_sl_words, 2, size(_sl_words))").alias("b"), F.expr("slice(_sl_words, 3, size(_sl_words))").alias("c"))
        hashed = F.transform(three, lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("i")))
        return F.sort_array(F.slice(hashed, F.lit(1), n - 2))

    def repeated(x: Column, k: Column) -> Column:
        at = F.col("_sl_windows")
        return ((k > 0) & (F.get(at, k - 1)["h"] == x["h"])) | ((k < F.size(at) - 1) & (F.get(at, k + 1)["h"] == x["h"]))

    def reach(p: Column, k: Column) -> Column:
        after = F.get(F.col("_sl_places"), k + 1)
        return F.least(F.lit(3), F.coalesce(after - p, F.lit(3)))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    named = (
        docs.withColumn("_sl_words", words)
        .withColumn("_sl_windows", F.when(n >= 3, windows()))
        .withColumn("_sl_places", F.sort_array(F.transform(F.filter("_sl_windows", repeated), lambda x: x["i"])))
        .withColumn("_sl_lines", lines)
        .withColumns(
            {
                "_sl_n_words": n.cast("long"),
                "_sl_word_chars": F.char_length(F.array_join("_sl_words", "")).cast("long"),
                "_sl_n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
                "_sl_n_dup_lines": (F.size("_sl_lines") - F.size(F.array_distinct("_sl_lines"))).cast("long"),
                "_sl_n_repeat_words": F.coalesce(F.aggregate(F.transform("_sl_places", reach), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
            }
        )
    )
    failed = (F.col("_sl_n_words") < MIN_WORDS) | (100 * F.col("_sl_n_repeat_words") > MAX_REPEATED * F.col("_sl_n_words"))
    return named.withColumn("_sl_base_failed", failed).drop("_sl_words", "_sl_windows", "_sl_places", "_sl_lines")


def host_rates(rows: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """rows (host, failed): for each host n_docs, n_failed, rate (shrunk) and rejected."""
    hosts = kept_table(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    docs, failed, squares, count = hosts.agg(F.sum(n), F.sum(f), F.sum(f * f / n), F.count(F.lit(1))).first()
    a, b = beta_prior(docs or 0.0, failed or 0.0, squares or 0.0, count)
    rate = (f + a) / (n + (a + b))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def beta_prior(docs: float, failed: float, squares: float, hosts: int) -> tuple[float, float]:
    """Moments fit: squares is the sum over hosts of n_failed**2 / n_docs."""
    if docs == 0:
        return 0.5, 0.5
    mean = failed / docs
    within = mean * (1 - mean)
    between = squares / docs - mean * mean - within * (hosts - 1) / docs
    strength = MAX_STRENGTH if between <= 0 else within / between - 1
    strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
    return mean * strength, (1 - mean) * strength


def _judged(measured: DataFrame, max_rate: float) -> DataFrame:
    hosts = host_rates(measured.select(F.col("_sl_host").alias("host"), F.col("_sl_base_failed").alias("failed")), max_rate)
    verdicts = hosts.select(F.col("host").alias("_sl_judged"), F.col("rate").alias("_sl_host_rate"), F.col("rejected").alias("_sl_rejected"))
    joined = measured.join(verdicts, F.col("_sl_host").eqNullSafe(F.col("_sl_judged"))).drop("_sl_judged")
    return joined.withColumn("_sl_good", ~F.col("_sl_base_failed") & ~F.col("_sl_rejected"))


def assess(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per document: doc_id, host, MEASURES, base_failed, host_rate, kept; measured in one pass."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("_sl_host"))
    measured = kept_table(with_measures(narrow).drop("text"), "measures")
    named = {f"_sl_{c}": c for c in (*MEASURES, "base_failed", "host", "host_rate")} | {"_sl_good": "kept"}
    return _judged(measured, max_rate).withColumnsRenamed(named).drop("_sl_rejected")


def keep_good(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """docs without those that fail the base rule or whose host is rejected.

    The measured documents are written once, so that texts are parsed once; only narrow columns
    are read again for the hosts.
    """
    measured = with_measures(docs).withColumn("_sl_host", F.col("source").cast("string"))
    once = kept_table(measured.select(*[F.col(f"`{c}`") for c in docs.columns], "_sl_host", "_sl_base_failed"), "measured")
    return _judged(once, max_rate).filter("_sl_good").select(*[F.col(f"`{c}`") for c in docs.columns])
