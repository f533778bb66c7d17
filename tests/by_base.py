"""Matrices base by base in plain Python, from the definitions."""

from __future__ import annotations

import statistics

from spanloom.options import Anchor, General, Layout, ReferencePoint, Statistic


def even(start: int, length: int, n: int) -> list[tuple[int, int]]:
    if length <= 0:
        return [(start, start)] * n
    return [(start + length * i // n, start + max(length * (i + 1) // n, length * i // n + 1)) for i in range(n)]


def reference_bins(region, layout: ReferencePoint, size: int):
    up, down = layout.counts(size)
    start, end, minus = region["start"], region["end"], region["strand"] == "-"
    ref = (start + end) // 2 if layout.anchor is Anchor.CENTER else (end if minus == (layout.anchor is Anchor.TSS) else start)
    have = lambda length: max(length, 0) // size
    length = end - start
    left, right = {
        Anchor.TSS: (up, min(have(length), down)),
        Anchor.TES: (min(have(length), up), down),
        Anchor.CENTER: (min(have(length - length // 2 if minus else length // 2), up), min(have(length // 2 if minus else length - length // 2), down)),
    }[layout.anchor]
    out = []
    for i in range(up + down):
        offset = (i - up) * size
        bases = range(ref - offset - size, ref - offset) if minus else range(ref + offset, ref + offset + size)
        out.append((list(bases), i < up - left if i < up else i - up >= right))
    return out


def spliced_zone(bases: list[int], n: int) -> list[list[int]]:
    """Bases of a zone, end to end, in n bins; one at least for each."""
    t = len(bases)
    return [bases[t * i // n : max(t * (i + 1) // n, t * i // n + 1)] for i in range(n)]


def spliced_bins(region, layout: Layout, size: int):
    minus = region["strand"] == "-"
    blocks = region["exons"] or [(region["start"], region["end"])]
    line = [p for a, b in blocks for p in range(a, b)]
    first, last = blocks[0][0], blocks[-1][1]
    at = lambda k: line[k] if 0 <= k < len(line) else (first + k if k < 0 else last + k - len(line))
    if isinstance(layout, ReferencePoint):
        up, down = layout.counts(size)
        left, right = (down, up) if minus else (up, down)
        point = len(line) // 2 if layout.anchor is Anchor.CENTER else (len(line) if minus == (layout.anchor is Anchor.TSS) else 0)
        bins = spliced_zone([at(point + d) for d in range(-left * size, 0)], left) + spliced_zone([at(point + d) for d in range(right * size)], right)
    else:
        up, five, body, three, down = layout.counts(size)
        u5, u3 = layout.unscaled_5, layout.unscaled_3
        if minus:
            up, five, three, down, u5, u3 = down, three, five, up, u3, u5
        near = min(u5, len(line))
        far = max(len(line) - u3, near)
        zones = ((range(first - up * size, first), up), (line[:near], five), (line[near:far], body), (line[far:], three), (range(last, last + down * size), down))
        bins = [b for z, n in zones if n for b in (spliced_zone(list(z), n) if len(z) else [[]] * n)]
    return [(b, False) for b in (bins[::-1] if minus else bins)]


def scale_bins(region, layout, size: int):
    up, five, body, three, down = layout.counts(size)
    start, end, minus = region["start"], region["end"], region["strand"] == "-"
    length = max(end - start, 0)
    u5 = min(layout.unscaled_5, length)
    u3 = min(layout.unscaled_3, length - u5)
    near, far, n_near, n_far, n_up, n_down = (u3, u5, three, five, down, up) if minus else (u5, u3, five, three, up, down)
    bins = even(start - n_up * size, n_up * size, n_up) + even(start, near, n_near) + even(start + near, length - near - far, body) + even(end - far, far, n_far) + even(end, n_down * size, n_down)
    return [(list(range(a, b)), False) for a, b in (bins[::-1] if minus else bins)]


def too_short(region, layout: Layout, general: General) -> bool:
    if isinstance(layout, ReferencePoint) or not layout.body:
        return False
    if general.metagene and region["exons"]:
        return sum(b - a for a, b in region["exons"]) - layout.unscaled_5 - layout.unscaled_3 < general.bin_size
    length = max(region["end"] - region["start"], 0)
    u5 = min(layout.unscaled_5, length)
    return length - u5 - min(layout.unscaled_3, length - u5) < general.bin_size


def summary(values: list[float], statistic: Statistic) -> float:
    return {
        Statistic.MEAN: lambda v: sum(v) / len(v),
        Statistic.MEDIAN: statistics.median,
        Statistic.MIN: min,
        Statistic.MAX: max,
        Statistic.STD: statistics.pstdev,
        Statistic.SUM: sum,
    }[statistic](values)


def matrix(regions, signal, lengths, layout: Layout, general: General) -> dict:
    """{(region_id, sample, bin): value or None}. signal: {(sample, chrom): [(start, end, value)]}; lengths: {(sample, chrom): n}."""
    bases = {key: {p: v for a, b, v in rows for p in range(a, b)} for key, rows in signal.items()}
    out = {}
    n_samples = 1 + max(s for s, _ in lengths)
    for r in regions:
        bins = (spliced_bins if general.metagene else reference_bins if isinstance(layout, ReferencePoint) else scale_bins)(r, layout, general.bin_size)
        short = too_short(r, layout, general)
        for s in range(n_samples):
            length = lengths.get((s, r["chrom"]))
            own = bases.get((s, r["chrom"]), {})
            for k, (places, beyond) in enumerate(bins):
                values = [own[p] for p in places if p in own]
                if general.missing_as_zero:
                    values += [0.0] * (len(places) - len(values))
                value = summary(values, general.statistic) if values and not short and length is not None else None
                if value is None and general.missing_as_zero:
                    value = 0.0
                if layout.nan_after_end and beyond and length is not None:
                    value = None
                out[r["region_id"], s, k] = value
    return out
