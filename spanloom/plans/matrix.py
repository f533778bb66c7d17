"""The matrix of regions by samples by bins, as one declarative plan.

regions: region_id, group_idx, chrom, start, end, strand, exons (array of (start, end), or null)
signal:  sample_idx, chrom, start, end, value; intervals of one sample don't overlap
chroms:  sample_idx, chrom, length

values() gives the array of a region's values, by sample, then bin. Without blocks regions and intervals of the signal are
brought together by tiles of the chromosome, in sorted partitions, and kernels on Arrow batches fold the intervals into bins
(operators.bin_values); a region is shuffled once, with the columns that its rows carry, and pairs of regions and intervals never are.
Spliced layouts, and regions too long for a kernel, meet the signal bin by bin: the bins are laid out by
expressions, cut to the counted pieces, and the empty grid is added as rows without signal to the same
aggregation, so that no join brings it back; counts combine before the shuffle. cells() and rows() are two forms of the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, StructField, StructType

from spanloom.functions.chroms import normal_chrom
from spanloom.operators import aggregate
from spanloom.operators.bin_values import MOST_HITS, kernel
from spanloom.operators.intervals import TILE, overlap_join
from spanloom.options import General, Layout, ReferencePoint
from spanloom.operators.rows import filter_rows
from spanloom.plans.bins import reference_counts_sql, with_bins


#: Least width of the tiles on which windows meet the signal; some times the usual window.
WINDOW_TILE = 1024
#: Regions on a tile that one salt takes.
FULL = 1 << 14
#: Bases of a window, over all samples, up to which lengths need not be known beforehand; bases of the windows of one partition.
SHORT, PART_BASES = 1 << 13, 1 << 25


def clean_signal(signal: DataFrame) -> DataFrame:
    """Signal with normal chromosome names, widened values, and without values that are no numbers."""
    value = F.col("value").cast("double")
    return signal.select("sample_idx", normal_chrom(F.col("chrom")).alias("norm"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), value.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("r_start") < F.col("r_end")))


def _counted_pieces(bins: DataFrame, metagene: bool) -> DataFrame:
    """(region_id, norm, bin, l_start, l_end): the parts of bins that may count."""
    if not metagene:
        return bins.select("region_id", "norm", "bin", F.col("b_start").alias("l_start"), F.col("b_end").alias("l_end"))
    parts = F.filter(F.transform("included", lambda p: F.struct(F.greatest(p["s"], F.col("b_start")).alias("s"), F.least(p["e"], F.col("b_end")).alias("e"))), lambda p: p["s"] < p["e"])
    return bins.select("region_id", "norm", "bin", F.explode(parts).alias("p")).select("region_id", "norm", "bin", F.col("p.s").alias("l_start"), F.col("p.e").alias("l_end"))


def cells_by_bin(regions: DataFrame, signal: DataFrame, chroms: DataFrame, layout: Layout, general: General, n_samples: int, tile: int | None = None) -> DataFrame:
    """(region_id, sample_idx, bin, value), one row for every cell, by a join of bins and signal."""
    # A region becomes hundreds of rows: deal the regions out first, however few files they came in.
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = regions.select("region_id", "chrom", "start", "end", "strand", "exons").repartition(parts, "region_id")
    planned = with_bins(dealt.withColumn("norm", normal_chrom(F.col("chrom"))), layout, general)
    carried = ["region_id", "norm", "too_short", *(["included"] if general.metagene else [])]
    # Every layout has bins; the outer form keeps Spark from laying them out once more to see whether there are any.
    bins = planned.select(*carried, F.explode_outer("bins").alias("b")).select(*carried, "b.bin", F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"), "b.beyond")

    pieces = _counted_pieces(bins.filter(~F.col("too_short")), general.metagene)
    tile = max(tile or TILE, 2 << max(0, general.bin_size - 1).bit_length())
    met = overlap_join(pieces, clean_signal(signal), "norm", tile)
    width = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    nothing = {"counted": F.lit(None).cast("long"), "masked": F.lit(None).cast("boolean")}
    covered = met.select("region_id", "sample_idx", "bin", width.alias("w"), "x").withColumns(nothing)

    sizes = chroms.select(F.col("sample_idx").alias("_s"), normal_chrom(F.col("chrom")).alias("_norm"), F.col("length").alias("_length"))
    grid = bins.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    grid = grid.join(sizes, (F.col("sample_idx") == F.col("_s")) & (F.col("norm") == F.col("_norm")), "left")
    if general.metagene:
        # A piece that lies off the chromosome as a whole is not counted.
        real = F.filter("included", lambda p: (p["s"] < F.col("_length")) & (p["e"] > 0))
        counted = F.aggregate(real, F.lit(0).cast("bigint"), lambda a, p: a + F.greatest(F.least(p["e"], F.col("b_end")) - F.greatest(p["s"], F.col("b_start")), F.lit(0).cast("bigint")))
    else:
        counted = F.greatest(F.col("b_end") - F.col("b_start"), F.lit(0))
    masked = F.col("beyond") & F.col("_length").isNotNull() if layout.nan_after_end else F.lit(False)
    empty = grid.select("region_id", "sample_idx", "bin", F.lit(None).cast("long").alias("w"), F.lit(None).cast("double").alias("x"), counted.cast("long").alias("counted"), masked.alias("masked"))

    parts = aggregate.partials(general.statistic) | {"counted": F.max("counted"), "masked": F.max("masked")}
    folded = covered.unionByName(empty).groupBy("region_id", "sample_idx", "bin").agg(*[c.alias(n) for n, c in parts.items()])
    value = F.when(~F.col("masked"), aggregate.value(general.statistic, general.missing_as_zero))
    return folded.select("region_id", "sample_idx", "bin", value.alias("value"))


def _widths(least: int, length: Column) -> Column:
    """The width of the tiles that a window of that length lies on: `least` or the next doubling that isn't shorter."""
    wide = [least]
    while wide[-1] < MOST_HITS:
        wide.append(wide[-1] * 2)
    out = F.lit(wide[-1])
    for w in reversed(wide[:-1]):
        out = F.when(length <= w, F.lit(w)).otherwise(out)
    return out.cast("long")


def _filled(column: Column, kind: DataType) -> Column:
    """An array, empty where it is null: at a null list Spark's Arrow writer goes over its rows since the last list once more for every row."""
    return F.coalesce(column, F.array().cast(kind))


def values_by_window(regions: DataFrame, signal: DataFrame, chroms: DataFrame, layout: Layout, general: General, n_samples: int, least: int, reaches: dict[int, int], carried: list[str], parts: int | None = None) -> DataFrame:
    """`carried` columns of regions without blocks, and values, where windows and signal meet on tiles.

    reaches: the longest window by the width of its tiles. A window belongs to the tile that it starts on, an interval to all tiles
    whose windows may reach it. A tile of many regions is dealt out under several salts, each with the tile's intervals.
    """
    masks, even = layout.nan_after_end, isinstance(layout, ReferencePoint)
    parts = parts or int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = with_bins(regions.withColumn("norm", normal_chrom(F.col("chrom"))), layout, general)
    # What can be told from the window's start and direction is not shuffled.
    if even:
        needed = {"minus": F.coalesce(F.col("strand") == "-", F.lit(False))}
        if masks:
            needed |= {c: F.expr(f"CAST({n} AS int)") for c, n in zip(("left", "right"), reference_counts_sql(layout, general.bin_size), strict=True)}
    else:
        needed = {f"_r_{c}": F.col(c) for c in ("start", "end", "strand")}
    region = needed | {f"_r_{c}": F.col(c) for c in carried}
    until = F.lit(None).cast("long") if even else F.col("window_end")
    width = _widths(least, F.col("window_end") - F.col("window_start"))
    windows = named.select("norm", width.alias("width"), F.col("window_start").alias("at"), until.alias("until"), *[v.alias(c) for c, v in region.items()], F.xxhash64("region_id").alias("dealt"))
    windows = windows.withColumn("tile", F.floor(F.col("at") / F.col("width")))
    keys = ["norm", "width", "tile"]
    # One row per FULL regions at most.
    full = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FULL)
    full = F.broadcast(full.select(*[F.col(c).alias(f"_{c}") for c in keys], F.ceil(F.col("_n") / FULL).alias("_salts")))

    def with_salts(df: DataFrame) -> DataFrame:
        same = F.col("norm").eqNullSafe(F.col("_norm")) & (F.col("width") == F.col("_width")) & (F.col("tile") == F.col("_tile"))
        return df.join(full, same, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    windows = with_salts(windows).withColumn("salt", F.pmod("dealt", "_salts"))

    def spots(w: int, reach: int) -> Column:
        first, last = F.floor((F.col("r_start") - reach + 1) / w), F.floor((F.col("r_end") - 1) / w)
        return F.transform(F.sequence(first, last), lambda t: F.struct(F.lit(w).cast("long").alias("width"), t.alias("tile")))

    near = clean_signal(signal).filter(F.col("norm").isNotNull() & F.col("sample_idx").between(0, n_samples - 1))
    spread = near.select("*", F.explode(F.concat(*[spots(w, reach) for w, reach in sorted(reaches.items())])).alias("spot")).select("norm", "spot.*", F.col("sample_idx").cast("int").alias("sample_idx"), F.col("r_start").alias("at"), F.col("r_end").alias("until"), "x")
    hits = with_salts(spread).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
    kinds = {c: windows.schema[c].dataType for c in region}
    # What differs between neighbours stands side by side, behind what doesn't.
    masking = [c for c in region if c in ("left", "right")]
    columns = [*keys, "salt", "sample_idx", "until", "x", *masking, "at", *[c for c in region if c not in masking]]
    direction = "minus" if even else "_r_strand"
    # In the order of place, rows of one shuffled block differ in a few bytes next to each other, and compress well.
    windows = windows.withColumns({"sample_idx": F.lit(None).cast("int"), "x": F.lit(None).cast("double")}).select(*columns).sortWithinPartitions(*keys, "salt", "at", direction)
    hits = hits.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()}).select(*columns)

    met = windows.union(hits).repartition(parts, *keys, "salt")
    if masks:
        # The same rows as of the signal, so that its shuffle can serve both.
        named_chroms = chroms.filter(normal_chrom(F.col("chrom")).isNotNull() & F.col("sample_idx").between(0, n_samples - 1))
        has = named_chroms.groupBy(normal_chrom(F.col("chrom")).alias("_has")).agg(F.collect_set("sample_idx").alias("has"))
        met = met.join(F.broadcast(has), F.col("norm") == F.col("_has"), "left").drop("_has")
    met = met.sortWithinPartitions(*keys, "salt", F.col("sample_idx").asc_nulls_last(), "at", "until", direction)
    if even:
        # The kernel lays out bins of one width itself: as rows of Arrow they took most of the time.
        extra = list(needed)
    else:
        # Bins are laid out here, so that none is shuffled; an interval has none.
        met = with_bins(met.withColumns({c: F.col(f"_r_{c}") for c in ("start", "end", "strand")}), layout, general)
        none = F.array().cast(met.schema["bins"].dataType)
        extra = ["too_short", F.when(F.col("sample_idx").isNull(), F.col("bins")).otherwise(none).alias("bins")]
    lists = [c for c in carried if isinstance(kinds[f"_r_{c}"], ArrayType)]
    own = [_filled(F.col(f"_r_{c}"), kinds[f"_r_{c}"]).alias(c) if c in lists else F.col(f"_r_{c}").alias(c) for c in carried]
    own = F.struct(*own, *[F.col(f"_r_{c}").isNull().alias(f"_no_{c}") for c in lists])
    run = kernel(n_samples, layout.n_bins(general.bin_size), general.statistic, general.missing_as_zero, masks, general.bin_size if even else None, layout.counts(general.bin_size)[0])
    out = [StructField(c, kinds[f"_r_{c}"]) for c in carried] + [StructField(f"_no_{c}", BooleanType()) for c in lists] + [StructField("values", ArrayType(DoubleType()))]
    if masks:
        extra.append(_filled(F.col("has"), met.schema["has"].dataType).alias("has"))
    found = met.select(*keys, "salt", "sample_idx", "until", "x", "at", own.alias("region"), *extra).mapInArrow(run, StructType(out))
    return found.select(*[F.when(~F.col(f"_no_{c}"), F.col(c)).alias(c) if c in lists else c for c in carried], "values") if lists else found


def _folded(cells_: DataFrame) -> DataFrame:
    return cells_.groupBy("region_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "bin", "value"))), lambda c: c["value"]).alias("values"))


def _with_values(regions: DataFrame, signal: DataFrame, chroms: DataFrame, layout: Layout, general: General, n_samples: int, tile: int | None, carried: list[str]) -> DataFrame:
    """`carried` columns of regions and values: by sample, then bin; one row per region."""

    def by_bin(own: DataFrame) -> DataFrame:
        folded = _folded(cells_by_bin(own, signal, chroms, layout, general, n_samples, tile))
        return folded if carried == ["region_id"] else own.select(*dict.fromkeys(["region_id", *carried])).join(folded, "region_id").select(*carried, "values")

    def by_window(own: DataFrame, reaches: dict[int, int], parts: int | None = None) -> DataFrame:
        return values_by_window(own, signal, chroms, layout, general, n_samples, least, reaches, carried, parts)

    if general.metagene:
        return by_bin(regions)
    around, least = layout.upstream + layout.downstream, tile or WINDOW_TILE
    if isinstance(layout, ReferencePoint) and around * n_samples <= SHORT:
        width = least
        while width < around:
            width *= 2
        return by_window(regions, {width: around})
    window = with_bins(regions, layout, general)
    length = F.coalesce(F.col("window_end") - F.col("window_start"), F.lit(0))
    fits = length <= MOST_HITS // max(1, n_samples)
    found = window.groupBy(_widths(least, length).alias("width"), fits.alias("fits")).agg(F.max(length).alias("longest"), F.sum(length).alias("total")).collect()
    # A partition holds a bounded number of bases.
    total = sum(r.total for r in found if r.fits)
    parts = max(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total * n_samples // PART_BASES)
    reaches = {r.width: max(1, r.longest) for r in found if r.fits} or {least: 1}
    if all(r.fits for r in found):
        return by_window(regions, reaches, parts)
    short, long = (window.filter(c).select(*regions.columns) for c in (fits, ~fits))
    return by_window(short, reaches, parts).unionByName(by_bin(long))


def values(regions: DataFrame, signal: DataFrame, chroms: DataFrame, layout: Layout, general: General, n_samples: int, tile: int | None = None) -> DataFrame:
    """(region_id, values): by sample, then bin; one row per region."""
    return _with_values(regions, signal, chroms, layout, general, n_samples, tile, ["region_id"])


def cells(regions: DataFrame, signal: DataFrame, chroms: DataFrame, layout: Layout, general: General, n_samples: int, tile: int | None = None) -> DataFrame:
    """(region_id, sample_idx, bin, value), one row for every cell, covered or not."""
    if general.metagene:
        return cells_by_bin(regions, signal, chroms, layout, general, n_samples, tile)
    n = layout.n_bins(general.bin_size)
    long = values(regions, signal, chroms, layout, general, n_samples, tile).select("region_id", F.posexplode("values").alias("k", "value"))
    return long.select("region_id", F.expr(f"CAST(k div {n} AS int)").alias("sample_idx"), F.expr(f"CAST(k % {n} AS int)").alias("bin"), "value")


def rows(regions: DataFrame, signal: DataFrame, chroms: DataFrame, layout: Layout, general: General, n_samples: int, columns: list[str] | None = None) -> DataFrame:
    """One row per region: its columns, window_start, window_end and values (by sample, then bin); or `columns` of it and values.

    A column that isn't asked for is not shuffled; the kernel hides from Spark which are used later.
    """
    if columns is not None:
        return _with_values(regions, signal, chroms, layout, general, n_samples, None, columns)
    found = _with_values(regions, signal, chroms, layout, general, n_samples, None, regions.columns)
    return with_bins(found, layout, general).select(*regions.columns, "window_start", "window_end", "values")


def matrix(regions: DataFrame, signal: DataFrame, chroms: DataFrame, layout: Layout, general: General, n_samples: int, columns: list[str] | None = None) -> DataFrame:
    """The rows that the filters leave, not yet in order."""
    return filter_rows(rows(regions, signal, chroms, layout, general, n_samples, columns), general)
