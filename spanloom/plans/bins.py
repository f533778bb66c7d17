"""Layouts of bins as columns: for each region an array of (bin, start, end, beyond).

Everything is an expression on the columns start, end, strand and exons (sorted (start, end), or null)
of a region, so planning needs no Python and no shuffle. Coordinates are signed; bins may
reach past either end of a chromosome. `bin` counts in reading direction: the 5' end comes first.

Spliced layouts work in the space of a region's blocks laid end to end. A zone is a list of
genomic pieces and a number of bins; bin i of n covers the offsets from floor(total*i/n) to
floor(total*(i+1)/n), at least one base. Offsets are mapped back through the pieces. Bases outside all
pieces (introns) never count, which is what the column `included` is for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.options import Anchor, General, Layout, ReferencePoint, ScaleRegions

_PIECES = "array<struct<s:bigint,e:bigint>>"
_NONE = f"CAST(array() AS {_PIECES})"


def anchor_sql(anchor: Anchor) -> str:
    if anchor is Anchor.CENTER:
        return "((`start` + `end`) div 2)"
    last, first = ("`end`", "`start`") if anchor is Anchor.TES else ("`start`", "`end`")
    return f"(CASE WHEN strand = '-' THEN {first} ELSE {last} END)"


def reference_counts_sql(layout: ReferencePoint, size: int) -> tuple[str, str]:
    """How many bins before and after the anchor, in reading direction, lie within the region."""
    up, down = layout.counts(size)
    length = "greatest(`end` - `start`, 0)"
    return {
        Anchor.TSS: (str(up), f"least({length} div {size}, {down})"),
        Anchor.TES: (f"least({length} div {size}, {up})", str(down)),
        Anchor.CENTER: (
            f"least((CASE WHEN strand = '-' THEN {length} - {length} div 2 ELSE {length} div 2 END) div {size}, {up})",
            f"least((CASE WHEN strand = '-' THEN {length} div 2 ELSE {length} - {length} div 2 END) div {size}, {down})",
        ),
    }[layout.anchor]


def reference_bins_sql(layout: ReferencePoint, size: int) -> str:
    up, down = layout.counts(size)
    ref = anchor_sql(layout.anchor)
    left, right = reference_counts_sql(layout, size)
    start = f"CASE WHEN strand = '-' THEN {ref} - (i - {up} + 1) * {size} ELSE {ref} + (i - {up}) * {size} END"
    return f"""transform(sequence(0, {up + down - 1}), i -> named_struct(
        'bin', i, 'start', CAST({start} AS bigint), 'end', CAST({start} + {size} AS bigint),
        'beyond', CASE WHEN i < {up} THEN i < {up} - {left} ELSE i - {up} >= {right} END))"""


def even_bins_sql(start: str, length: str, count: int) -> str:
    """`count` bins over a stretch; empty ones where it has no length, widened ones where it has too little."""
    if count == 0:
        return "CAST(array() AS array<struct<start:bigint,end:bigint>>)"
    low = f"({length}) * i div {count}"
    return f"""transform(sequence(0, {count - 1}), i -> CASE WHEN ({length}) <= 0
        THEN named_struct('start', CAST({start} AS bigint), 'end', CAST({start} AS bigint))
        ELSE named_struct('start', CAST({start} + {low} AS bigint),
                          'end', CAST({start} + greatest(({length}) * (i + 1) div {count}, {low} + 1) AS bigint)) END)"""


def scale_bins_sql(layout: ScaleRegions, size: int) -> str:
    up, five, body, three, down = layout.counts(size)
    length = "greatest(`end` - `start`, 0)"
    u5 = f"least({layout.unscaled_5}, {length})"
    u3 = f"least({layout.unscaled_3}, {length} - {u5})"

    def zones(first: int, n_first: int, near: str, n_near: int, far: str, n_far: int, last: int, n_last: int) -> str:
        parts = (
            even_bins_sql(f"`start` - {first}", str(first), n_first),
            even_bins_sql("`start`", near, n_near),
            even_bins_sql(f"`start` + {near}", f"{length} - {near} - {far}", body),
            even_bins_sql(f"`end` - {far}", far, n_far),
            even_bins_sql("`end`", str(last), n_last),
        )
        return f"concat({', '.join(parts)})"

    plus = zones(layout.upstream, up, u5, five, u3, three, layout.downstream, down)
    minus = zones(layout.downstream, down, u3, three, u5, five, layout.upstream, up)
    return f"CASE WHEN strand = '-' THEN {minus} ELSE {plus} END"


def too_short_sql(layout: ScaleRegions, size: int, total: str) -> str:
    """Whether the scaled part is shorter than a bin, of a region that is `total` long."""
    return f"({layout.body} > 0 AND {total} - {layout.unscaled_5} - {layout.unscaled_3} < {size})"


def _clip(low: str, high: str) -> str:
    """The pieces of the blocks between two offsets."""
    return f"filter(transform(_blocks, b -> named_struct('s', greatest(b.s, b.s + ({low}) - b.c), 'e', least(b.e, b.s + ({high}) - b.c))), p -> p.s < p.e)"


def _flank(start: str, end: str, count: int) -> str:
    return f"array(named_struct('s', CAST({start} AS bigint), 'e', CAST({end} AS bigint)))" if count else _NONE


def _zone(pieces: str, count: int) -> str:
    return f"named_struct('iv', CAST({pieces} AS {_PIECES}), 'n', {count})"


def _reference_zones(layout: ReferencePoint, size: int) -> tuple[str, str]:
    """Zones in genomic order, for + and for - regions."""
    up, down = layout.counts(size)
    first, last = "_blocks[0].s", "element_at(_blocks, -1).e"

    def pad_left(pieces: str, wanted: int, have: str) -> str:
        if layout.nan_after_end or not wanted:
            return pieces
        return f"(CASE WHEN {have} < {wanted} THEN concat(array(named_struct('s', {first} - ({wanted} - ({have})), 'e', {first})), {pieces}) ELSE {pieces} END)"

    def pad_right(pieces: str, wanted: int, have: str) -> str:
        if layout.nan_after_end or not wanted:
            return pieces
        return f"(CASE WHEN {have} < {wanted} THEN concat({pieces}, array(named_struct('s', {last}, 'e', {last} + ({wanted} - ({have}))))) ELSE {pieces} END)"

    def head(count: int) -> str:
        return _zone(pad_right(_clip("0", str(count * size)), count * size, "_total"), count)

    def tail(count: int) -> str:
        return _zone(pad_left(_clip(f"_total - {count * size}", "_total"), count * size, "_total"), count)

    def before(count: int) -> str:
        return _zone(_flank(f"{first} - {count * size}", first, count), count)

    def after(count: int) -> str:
        return _zone(_flank(last, f"{last} + {count * size}", count), count)

    def middle(left: int, right: int) -> str:
        half = "(_total div 2)"
        a = pad_left(_clip(f"{half} - {left * size}", half), left * size, half)
        b = pad_right(_clip(half, f"{half} + {right * size}"), right * size, f"(_total - {half})")
        return f"array({_zone(a, left)}, {_zone(b, right)})"

    if layout.anchor is Anchor.TSS:
        return f"array({before(up)}, {head(down)})", f"array({tail(down)}, {after(up)})"
    if layout.anchor is Anchor.TES:
        return f"array({tail(up)}, {after(down)})", f"array({before(down)}, {head(up)})"
    return middle(up, down), middle(down, up)


def _scale_zones(layout: ScaleRegions, size: int) -> tuple[str, str]:
    up, five, body, three, down = layout.counts(size)
    first, last = "_blocks[0].s", "element_at(_blocks, -1).e"

    def zones(n_up: int, near: int, n_near: int, far: int, n_far: int, n_down: int) -> str:
        left = f"least({near}, _total)"
        right = f"greatest(_total - {far}, {left})"
        parts = (
            _zone(_flank(f"{first} - {n_up * size}", first, n_up), n_up),
            _zone(_clip("0", left), n_near),
            _zone(_clip(left, right), body),
            _zone(_clip(right, "_total"), n_far),
            _zone(_flank(last, f"{last} + {n_down * size}", n_down), n_down),
        )
        return f"array({', '.join(parts)})"

    return zones(up, layout.unscaled_5, five, layout.unscaled_3, three, down), zones(down, layout.unscaled_3, three, layout.unscaled_5, five, up)


#: Pieces of a zone with the offset at which each starts, and their length.
_OFFSETS = """transform(_zones, z -> named_struct('n', z.n,
    'iv', transform(z.iv, (x, k) -> named_struct('s', x.s, 'e', x.e, 'c', aggregate(slice(z.iv, 1, k), 0L, (a, y) -> a + y.e - y.s))),
    'total', aggregate(z.iv, 0L, (a, y) -> a + y.e - y.s)))"""


def _spliced_bins(size: int, fixed_width: bool) -> str:
    """Bins of all zones. fixed_width: a zone that is too short has fewer bins, and empty ones beyond its end."""
    used = f"least(z.n, CAST(z.total div {size} AS int))" if fixed_width else "z.n"
    anchor = "coalesce(get(z.iv, 0).s, 0L)"
    low, high = "(z.total * i div {u})".replace("{u}", used), "(z.total * (i + 1) div {u})".replace("{u}", used)
    begin = f"coalesce(get(filter(z.iv, x -> {low} >= x.c AND {low} < x.c + x.e - x.s), 0).s + {low} - get(filter(z.iv, x -> {low} >= x.c AND {low} < x.c + x.e - x.s), 0).c, element_at(z.iv, -1).e)"
    stop = f"greatest({high}, {low} + 1)"
    finish = f"coalesce(get(filter(z.iv, x -> {stop} > x.c AND {stop} <= x.c + x.e - x.s), 0).s + {stop} - get(filter(z.iv, x -> {stop} > x.c AND {stop} <= x.c + x.e - x.s), 0).c, element_at(z.iv, -1).e)"
    empty = f"named_struct('start', {anchor}, 'end', {anchor}, 'beyond', true)"
    past = "named_struct('start', element_at(z.iv, -1).e, 'end', element_at(z.iv, -1).e, 'beyond', true)"
    real = f"named_struct('start', {begin}, 'end', greatest({finish}, {begin} + 1), 'beyond', false)"
    return f"""flatten(transform(_offsets, z -> CASE WHEN z.n = 0 THEN CAST(array() AS array<struct<start:bigint,end:bigint,beyond:boolean>>)
        ELSE transform(sequence(0, z.n - 1), i -> CASE WHEN z.total <= 0 THEN {empty} WHEN i >= {used} THEN {past} ELSE {real} END) END))"""


def with_bins(regions: DataFrame, layout: Layout, general: General) -> DataFrame:
    """regions and bins, included (null: everything), too_short, window_start, window_end."""
    size, n = general.bin_size, layout.n_bins(general.bin_size)
    reference = isinstance(layout, ReferencePoint)
    flip = f"transform(_bins, (b, k) -> named_struct('bin', CASE WHEN strand = '-' THEN {n - 1} - k ELSE k END, 'start', b.`start`, 'end', b.`end`, 'beyond', b.beyond))"
    if general.metagene:
        plus, minus = (_reference_zones if reference else _scale_zones)(layout, size)
        # A region without blocks is one block.
        blocks = "CASE WHEN size(exons) > 0 THEN array_sort(transform(exons, x -> named_struct('s', x.`start`, 'e', x.`end`))) ELSE array(named_struct('s', `start`, 'e', `end`)) END"
        planned = (
            regions.withColumn("_exons", F.expr(blocks))
            .withColumn("_blocks", F.expr("transform(_exons, (x, k) -> named_struct('s', x.s, 'e', x.e, 'c', aggregate(slice(_exons, 1, k), 0L, (a, y) -> a + y.e - y.s)))"))
            .withColumn("_total", F.expr("aggregate(_exons, 0L, (a, y) -> a + y.e - y.s)"))
            .withColumn("_zones", F.expr(f"CASE WHEN strand = '-' THEN {minus} ELSE {plus} END"))
            .withColumn("_offsets", F.expr(_OFFSETS))
            .withColumn("_bins", F.expr(_spliced_bins(size, reference)))
            .withColumn("bins", F.expr(flip))
            .withColumn("included", F.expr("filter(flatten(transform(_zones, z -> z.iv)), x -> x.s < x.e)"))
        )
        if reference:
            planned = planned.withColumn("too_short", F.lit(False))
        else:
            planned = planned.withColumn("too_short", F.expr(f"CASE WHEN size(exons) > 0 THEN {too_short_sql(layout, size, '_total')} ELSE {_plain_short(layout, size)} END"))
        planned = planned.drop("_exons", "_blocks", "_total", "_zones", "_offsets", "_bins")
    elif reference:
        planned = regions.withColumn("bins", F.expr(reference_bins_sql(layout, size))).withColumn("included", F.expr(f"CAST(NULL AS {_PIECES})")).withColumn("too_short", F.lit(False))
    else:
        bins = f"transform({scale_bins_sql(layout, size)}, x -> named_struct('start', x.`start`, 'end', x.`end`, 'beyond', false))"
        planned = regions.withColumn("_bins", F.expr(bins)).withColumn("bins", F.expr(flip)).drop("_bins")
        planned = planned.withColumn("included", F.expr(f"CAST(NULL AS {_PIECES})")).withColumn("too_short", F.expr(_plain_short(layout, size)))
    if reference and not general.metagene:
        up, down = layout.counts(size)
        first = f"CAST({anchor_sql(layout.anchor)} - CASE WHEN strand = '-' THEN {down * size} ELSE {up * size} END AS bigint)"
        return planned.withColumn("window_start", F.expr(first)).withColumn("window_end", F.expr(f"{first} + {n * size}L"))
    edges = "included, x -> x.s), transform(included, x -> x.e" if general.metagene and not reference else "bins, x -> x.`start`), transform(bins, x -> x.`end`"
    low, high = edges.split("), ")
    return planned.withColumn("window_start", F.expr(f"array_min(transform({low}))")).withColumn("window_end", F.expr(f"array_max({high}))"))


def _plain_short(layout: ScaleRegions, size: int) -> str:
    """As too_short_sql, with the unscaled ends cut to the region."""
    length = "greatest(`end` - `start`, 0)"
    u5 = f"least({layout.unscaled_5}, {length})"
    return f"({layout.body} > 0 AND {length} - {u5} - least({layout.unscaled_3}, {length} - {u5}) < {size})"
