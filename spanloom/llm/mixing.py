"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Sizes are words. The sources, ordered by code point with null last, get the `weights` in turn, and
share `share` times all words by them; a target stops at `cap` times its source's words, and the
excess goes to the others by weight, until none is above (the common level is found by a few one-row
sums). Within a source a document of s words gets level * ceil(sqrt(s)) expected copies, `cap` at most, where the level is such
that the expected words are the target: longer documents go in more often, but less than in proportion to their
words. The whole part are certain copies, the fraction f is the inclusion probability of one more. Which
documents get it: each has a uniform u, drawn from its doc_id and text by MD5, and documents are ranked by their odds u/(1-u)
divided by the inclusion odds f/(1-f), the Pareto order; the sample has the fixed size of the words still
missing, that is documents are taken in that order while the middle of the next one lies within it.

Scale. Texts are read once, for sizes and keys (mixed: and written once, so that rows keep their places). Levels are found
from counts by source and size, of which a source of n words has at most sqrt(2n). The cut in a source's order is
found without sorting the source: words are summed in 4096 bins of the rank, the bin that holds the cut is split into 4096 again, and
only that cell (a 16-millionth of the source or so) is ordered, equal rows folded. Sums combine before the
shuffle, so a hot source costs no more than another. The sources' table joins by Spark's own choice:
broadcast when its files are small, else by sort-merge that splits hot sources. Sources are numbered by a range sort and
the counts of its partitions.

Results for odd input: a null or blank text has size 0 and is never taken; a null source is a source; a null doc_id
draws by its text; rows with equal doc_id and text draw alike, and where the cut falls among them the first in the table go in; an
empty table gives an empty one; other columns are ignored (mixed: passed through). Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import kept_table, word_count

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, 42
BINS = 4096


def draw_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), own).cast("binary"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 sum."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def numbered(sources: DataFrame) -> DataFrame:
    """sources with _sl_number, their position by code point, null last."""
    in_order = kept_table(sources.orderBy(F.col("_sl_source").asc_nulls_last()).withColumn("_sl_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_sl_at", 33)
    # One row for each partition of the sort.
    before = in_order.groupBy(part.alias("_sl_part")).agg(F.count(F.lit(1)).alias("_sl_n"))
    before = before.withColumn("_sl_before", F.sum("_sl_n").over(Window.orderBy("_sl_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_sl_n")
    joined = in_order.join(before, part == F.col("_sl_part"))
    within = F.col("_sl_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn("_sl_number", F.coalesce("_sl_before", F.lit(0)) + within).drop("_sl_at", "_sl_part", "_sl_before")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sized (_sl_source, _sl_size): for each source its words and target."""
    sources = sized.groupBy("_sl_source").agg(F.sum("_sl_size").alias("_sl_source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_sl_number") % len(weights) + 1).cast("int"))
    weighed = kept_table(numbered(sources).withColumn("_sl_weight", weight).drop("_sl_number"), "weights")
    most = F.lit(cap) * F.col("_sl_source_size")
    total = share * (weighed.agg(F.sum("_sl_source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = most < F.lit(level) * F.col("_sl_weight")
        n, stopped, open_weight = weighed.agg(F.count(F.when(above, 1)), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("_sl_weight")))).first()
        if n == full or not open_weight:
            break
        full, level = n, (total - (stopped or 0.0)) / open_weight
    return weighed.withColumn("_sl_target", F.least(most, F.lit(level) * F.col("_sl_weight"))).drop("_sl_weight")


def copies(size: Column, level: Column, cap: Column) -> Column:
    """Expected copies of a document; without a level its source is taken up to the cap."""
    return F.when(size > 0, F.least(cap, F.coalesce(level * F.ceil(F.sqrt(size.cast("double"))), cap))).otherwise(F.lit(0.0))


def with_levels(rows: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets with _sl_level, and _sl_rest, the words that certain copies leave to the sample."""
    sizes = rows.filter("_sl_size > 0").groupBy("_sl_source", "_sl_size").agg(F.count(F.lit(1)).alias("_sl_n"))
    sizes = sizes.withColumnRenamed("_sl_source", "_s1").join(targets, F.col("_s1").eqNullSafe(F.col("_sl_source"))).drop("_s1")
    words = F.col("_sl_n").cast("decimal(38,0)") * F.col("_sl_size")
    weight = F.ceil(F.sqrt(F.col("_sl_size").cast("double")))
    down = Window.partitionBy("_sl_source").orderBy(F.col("_sl_size").desc())
    above = F.coalesce(F.sum(words.cast("decimal(38,0)")).over(down.rowsBetween(Window.unboundedPreceding, -1)).cast("double"), F.lit(0.0))
    upto = F.sum((words * weight).cast("decimal(38,0)")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    tried = sizes.withColumn("_sl_tried", (F.col("_sl_target") - F.lit(cap) * above) / upto)
    # The largest size that isn't above the cap at the level that all larger ones, held at the cap, leave.
    level = F.max_by("_sl_tried", F.when(F.col("_sl_tried") * weight <= cap, F.col("_sl_size")))
    levels = tried.groupBy(F.col("_sl_source").alias("_s2")).agg(level.alias("_sl_level"))
    levelled = targets.join(levels, F.col("_sl_source").eqNullSafe(F.col("_s2")), "left").drop("_s2")
    whole = F.floor(copies(F.col("_sl_size"), F.col("_sl_level"), F.lit(cap)))
    certain = sizes.join(levels, F.col("_sl_source").eqNullSafe(F.col("_s2"))).groupBy(F.col("_sl_source").alias("_s3")).agg(F.sum((words * whole).cast("decimal(38,0)")).cast("double").alias("_sl_certain"))
    joined = levelled.join(certain, F.col("_sl_source").eqNullSafe(F.col("_s3")), "left")
    return joined.withColumn("_sl_rest", F.col("_sl_target") - F.coalesce("_sl_certain", F.lit(0.0))).drop("_s3", "_sl_certain")


def _ranked(rows: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """rows joined with plan; certain copies _sl_whole, and the rank _sl_rank in (0, 1) with its two bins, null without a draw."""
    joined = rows.join(plan.withColumnRenamed("_sl_source", "_sl_planned"), F.col("_sl_source").eqNullSafe(F.col("_sl_planned"))).drop("_sl_planned")
    joined = joined.withColumn("_sl_expected", copies(F.col("_sl_size"), F.col("_sl_level"), F.lit(cap)))
    joined = joined.withColumn("_sl_whole", F.floor("_sl_expected").cast("long"))
    u, f = uniform(F.col("_sl_key")), F.col("_sl_expected") - F.col("_sl_whole")
    odds = (u / (1 - u)) / (f / (1 - f))
    ranked = joined.withColumn("_sl_rank", F.when(f > 0, odds / (1 + odds))).drop("_sl_expected")
    fine = F.col("_sl_rank") * BINS
    first = F.least(F.floor(fine), F.lit(BINS - 1))
    return ranked.withColumns({"_sl_bin": first, "_sl_cell": F.least(F.floor((fine - first) * BINS), F.lit(BINS - 1))})


def _cut(binned: DataFrame, bin_name: str, start: Column) -> DataFrame:
    """binned (_sl_source, bin, _sl_words, ...): for each source the bin in which its sum passes _sl_rest."""
    order = Window.partitionBy("_sl_source").orderBy(bin_name)
    upto = binned.withColumn("_sl_upto", start + F.sum("_sl_words").over(order))
    passed = upto.filter(F.col("_sl_upto") >= F.col("_sl_rest")).withColumn("_sl_first", F.row_number().over(order)).filter("_sl_first = 1")
    return passed.withColumn("_sl_start", F.col("_sl_upto") - F.col("_sl_words")).drop("_sl_words", "_sl_upto", "_sl_first", "_sl_rest")


def _last_place(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """(_s4, _sl_limit): where the cut falls among equal rows, the place of the last that goes in.

    Rows are counted by the partition that wrote them; only one partition's are put in order.
    """
    some = cuts.filter("_sl_last_n < _sl_last_of").select(F.col("_s3").alias("_s4"), "_sl_last", F.col("_sl_last_n").alias("_sl_left"))
    tied = ranked.join(some, F.col("_sl_source").eqNullSafe(F.col("_s4")) & (F.struct("_sl_rank", "_sl_key") == F.col("_sl_last")))
    tied = tied.withColumn("_sl_part", F.shiftright("_sl_at", 33))
    by_part = Window.partitionBy("_s4").orderBy("_sl_part")
    parts = tied.groupBy("_s4", "_sl_part").agg(F.count(F.lit(1)).alias("_sl_n"), F.first("_sl_left").alias("_sl_left")).withColumn("_sl_upto", F.sum("_sl_n").over(by_part))
    part = parts.filter(F.col("_sl_upto") >= F.col("_sl_left")).groupBy(F.col("_s4").alias("_s5")).agg(F.min_by(F.struct("_sl_part", (F.col("_sl_left") - F.col("_sl_upto") + F.col("_sl_n")).alias("k")), "_sl_part").alias("p"))
    inside = tied.join(part, F.col("_s4").eqNullSafe(F.col("_s5")) & (F.col("_sl_part") == F.col("p._sl_part")))
    number = F.row_number().over(Window.partitionBy("_s4").orderBy("_sl_at"))
    return inside.withColumn("_sl_number", number).filter("_sl_number = p.k").select("_s4", F.col("_sl_at").alias("_sl_limit"))


def mix_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """rows (_sl_key, _sl_source, _sl_size, _sl_at): a row for each source with all that decides on its documents."""
    targets = kept_table(source_targets(rows, weights, share, cap), "targets")
    targets = kept_table(with_levels(rows, targets, cap), "levels")
    ranked = kept_table(_ranked(rows, targets, cap).filter("_sl_rank is not null").select("_sl_source", "_sl_key", "_sl_at", "_sl_size", "_sl_rest", "_sl_rank", "_sl_bin", "_sl_cell"), "ranked")

    bins = ranked.groupBy("_sl_source", "_sl_bin").agg(F.sum("_sl_size").alias("_sl_words"), F.first("_sl_rest").alias("_sl_rest"))
    bins = _cut(bins, "_sl_bin", F.lit(0)).select(F.col("_sl_source").alias("_s1"), F.col("_sl_bin").alias("_sl_cut_bin"), "_sl_start")
    inside = ranked.join(bins, F.col("_sl_source").eqNullSafe(F.col("_s1")) & (F.col("_sl_bin") == F.col("_sl_cut_bin"))).drop("_s1")
    cells = inside.groupBy("_sl_source", "_sl_cut_bin", "_sl_cell").agg(F.sum("_sl_size").alias("_sl_words"), F.first("_sl_rest").alias("_sl_rest"), F.first("_sl_start").alias("_sl_start"))
    cells = _cut(cells, "_sl_cell", F.col("_sl_start")).select(F.col("_sl_source").alias("_s2"), F.col("_sl_cell").alias("_sl_cut_cell"), F.col("_sl_start").alias("_sl_cell_start"))
    last = inside.join(cells, F.col("_sl_source").eqNullSafe(F.col("_s2")) & (F.col("_sl_cell") == F.col("_sl_cut_cell"))).drop("_s2")
    same = last.groupBy("_sl_source", "_sl_cut_bin", "_sl_cut_cell", "_sl_rank", "_sl_key").agg(F.count(F.lit(1)).alias("_sl_n"), *[F.first(c).alias(c) for c in ("_sl_size", "_sl_rest", "_sl_cell_start")])
    before = Window.partitionBy("_sl_source").orderBy("_sl_rank", "_sl_key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_sl_cell_start") + F.coalesce(F.sum(F.col("_sl_n") * F.col("_sl_size")).over(before), F.lit(0))
    fit = F.floor((F.col("_sl_rest") - start) / F.col("_sl_size") + 0.5)
    same = same.withColumn("_sl_in", F.least(F.greatest(fit, F.lit(0)), F.col("_sl_n")))
    ends = F.max(F.when(F.col("_sl_in") > 0, F.struct(F.struct("_sl_rank", "_sl_key").alias("row"), "_sl_in", "_sl_n"))).alias("_sl_end")
    cuts = same.groupBy(F.col("_sl_source").alias("_s3"), "_sl_cut_bin", "_sl_cut_cell").agg(ends)
    cuts = kept_table(cuts.select("_s3", "_sl_cut_bin", "_sl_cut_cell", F.col("_sl_end.row").alias("_sl_last"), F.col("_sl_end._sl_in").alias("_sl_last_n"), F.col("_sl_end._sl_n").alias("_sl_last_of")), "cuts")
    limits = _last_place(ranked, cuts)
    planned = targets.join(cuts.drop("_sl_last_n", "_sl_last_of"), F.col("_sl_source").eqNullSafe(F.col("_s3")), "left").drop("_s3", "_sl_rest")
    return kept_table(planned.join(limits, F.col("_sl_source").eqNullSafe(F.col("_s4")), "left").drop("_s4"), "mix-plan")


def with_copies(rows: DataFrame, plan: DataFrame, cap: float = CAP) -> DataFrame:
    """rows and _sl_source_size, _sl_target, _sl_copies."""
    ranked = _ranked(rows, plan, cap)
    place, cut = F.struct("_sl_bin", "_sl_cell"), F.struct(F.col("_sl_cut_bin").alias("_sl_bin"), F.col("_sl_cut_cell").alias("_sl_cell"))
    row, last = F.struct("_sl_rank", "_sl_key"), F.col("_sl_last")
    within = (row < last) | ((row == last) & (F.col("_sl_limit").isNull() | (F.col("_sl_at") <= F.col("_sl_limit"))))
    extra = F.when(F.col("_sl_rank").isNotNull() & F.coalesce((place < cut) | ((place == cut) & within), F.lit(False)), 1).otherwise(0)
    return ranked.withColumn("_sl_copies", F.col("_sl_whole") + extra)


def sized_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with what decides on a row: its key, source, words and place."""
    text = F.col("text").cast("string")
    return docs.withColumns({"_sl_doc_id": F.col("doc_id").cast("long"), "_sl_key": draw_key(F.col("doc_id").cast("long"), text, seed), "_sl_source": F.col("source").cast("string"), "_sl_size": word_count(text), "_sl_at": F.monotonically_increasing_id()})


NARROW = ("_sl_doc_id", "_sl_key", "_sl_source", "_sl_size", "_sl_at")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (words)."""
    rows = kept_table(sized_rows(docs, seed).select(*NARROW), "sizes")
    out = with_copies(rows, mix_plan(rows, weights, share, cap), cap)
    return out.select(
        F.col("_sl_doc_id").alias("doc_id"),
        F.col("_sl_size").alias("size"),
        F.col("_sl_source_size").alias("source_size"),
        F.col("_sl_target").alias("target"),
        F.col("_sl_copies").alias("copies"),
        (F.col("_sl_size") * F.col("_sl_copies")).alias("taken"),
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, numbered in the column copy from 1."""
    rows = kept_table(sized_rows(docs, seed), "sized")
    out = with_copies(rows, mix_plan(rows.select(*NARROW), weights, share, cap), cap).filter("_sl_copies > 0")
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "copy"]
    return out.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_sl_copies"))).alias("copy"))
