"""Values of all bins of a region at once, from the signal's intervals that its window meets.

Regions and intervals of one stretch of a chromosome come to the kernel as rows of their own, so that an interval is held once
for all regions there; numpy kernels on Arrow batches find for every bin the intervals in it by binary search and fold them.
No cell, and no pair of a region and an interval, is shuffled. The statistics are those of operators.aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from spanloom.options import Statistic

#: Cells that the kernels take at once; bounds their temporaries to some tens of MB.
CELLS = 1 << 18
#: Bases of one region's window over all samples, and so intervals, that a kernel takes at most; longer windows go bin by bin.
MOST_HITS = 1 << 22


def parts(counts: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most CELLS cells and CELLS intervals, or of one row."""
    ends, first, rows = np.cumsum(counts), 0, len(counts)
    per_part = max(1, CELLS // max(1, cells))
    while first < rows:
        before = ends[first - 1] if first else 0
        last = min(int(np.searchsorted(ends, before + CELLS, side="right")), first + per_part)
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def weighted_medians(cell: np.ndarray, x: np.ndarray, w: np.ndarray, n_cells: int) -> np.ndarray:
    """Median of the bases of each cell, the mean of the middle two of an even number; NaN without any."""
    total = np.bincount(cell, w, n_cells).astype(np.int64)
    order = np.lexsort((x, cell))
    x, upto = x[order], np.cumsum(w[order])
    start = np.cumsum(total) - total
    out = np.full(n_cells, np.nan)
    full = total > 0
    low = np.searchsorted(upto, (start + (total - 1) // 2)[full], side="right")
    high = np.searchsorted(upto, (start + total // 2)[full], side="right")
    out[full] = (x[low] + x[high]) / 2
    return out


def meetings(begin: np.ndarray, end: np.ndarray, group: np.ndarray, own: np.ndarray, sample: np.ndarray, s: np.ndarray, e: np.ndarray, n_samples: int) -> tuple[np.ndarray, ...]:
    """Which intervals the cells of rows meet, by row, sample, then bin: order, first, last, cell_begin, cell_end, s, e.

    A row of `group` meets the intervals whose `own` is that group. All groups and samples follow each other on one line, each
    `span` long, on which cells and the intervals, put in `order`, have places; a cell meets those from first up to last.
    """
    low = min(int(begin.min(initial=0)), int(s.min(initial=0)))
    span = max(int(end.max(initial=0)), int(e.max(initial=0))) - low + 2
    offset = (own * n_samples + sample) * span - low
    s, e, order = s + offset, e + offset, slice(None)
    if (s[1:] < s[:-1]).any():
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
    shift = ((group[:, None] * n_samples + np.arange(n_samples)) * span - low)[:, :, None]
    cell_begin, cell_end = (begin[:, None, :] + shift).ravel(), (end[:, None, :] + shift).ravel()
    return order, np.searchsorted(e, cell_begin, side="right"), np.searchsorted(s, cell_end, side="left"), cell_begin, cell_end, s, e


def values(begin: np.ndarray, end: np.ndarray, short: np.ndarray, row: np.ndarray, sample: np.ndarray, s: np.ndarray, e: np.ndarray, x: np.ndarray, n_samples: int, statistic: Statistic, zero: bool, group: np.ndarray | None = None) -> np.ndarray:
    """(rows, samples, bins), NaN for missing. begin and end: (rows, bins); row, sample, s, e, x: the intervals.

    The intervals are those of single rows or, with `group`, of groups of rows.
    """
    rows, bins = begin.shape
    n_cells = rows * n_samples * bins
    order, first, last, cell_begin, cell_end, s, e = meetings(begin, end, np.arange(rows) if group is None else group, row, sample, s, e, n_samples)
    x, width = x[order], cell_end - cell_begin
    n = np.where((width > 0) & ~np.repeat(short, n_samples * bins), np.maximum(last - first, 0), 0)
    cell = np.repeat(np.arange(n_cells), n)
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    w = np.minimum(e[at], cell_end[cell]) - np.maximum(s[at], cell_begin[cell])
    x = x[at]
    width = np.maximum(width, 0)
    covered = np.bincount(cell, w, n_cells)
    bases = width if zero else covered
    with np.errstate(divide="ignore", invalid="ignore"):
        if statistic in (Statistic.MEAN, Statistic.SUM, Statistic.STD):
            total = np.bincount(cell, w * x, n_cells)
            if statistic is Statistic.SUM:
                out = np.where(covered > 0, total, np.nan)
            elif statistic is Statistic.MEAN:
                out = np.where(covered > 0, total / bases, np.nan)
            else:
                square = np.bincount(cell, w * x * x, n_cells)
                out = np.where(covered > 0, np.sqrt(np.maximum(bases * square - total * total, 0.0)) / bases, np.nan)
        elif statistic is Statistic.MEDIAN:
            if zero:
                gap = np.flatnonzero(covered < width)
                cell, w, x = np.concatenate([cell, gap]), np.concatenate([w, (width - covered)[gap].astype(np.int64)]), np.concatenate([x, np.zeros(len(gap))])
            out = weighted_medians(cell, x, w, n_cells)
        else:
            fold, start = (np.minimum, np.inf) if statistic is Statistic.MIN else (np.maximum, -np.inf)
            out = np.full(n_cells, np.nan)
            some = np.flatnonzero(n)
            if len(some):
                out[some] = fold.reduceat(x, (np.cumsum(n) - n)[some])
            if zero:
                gap = (covered > 0) & (covered < width)
                out[gap] = fold(out[gap], 0.0)
    if zero:
        out[np.isnan(out)] = 0.0
    return out.reshape(rows, n_samples, bins)


def kernel(n_samples: int, n_bins: int, statistic: Statistic, zero: bool, masks: bool, size: int | None = None, before: int = 0):
    """For mapInArrow: intervals and regions in the order of their groups (norm, width, tile, salt), to the columns of `region` and values.

    A row with sample_idx is an interval (at, until, x), one without is a region. In a group the intervals come
    first, by sample and place; they are held until the group ends. Regions that follow each other with the same bins are computed once.
    With `size` the bins follow each other in that width from the window's start, backwards where `minus`, and no row carries them;
    of the `before` bins that come first and of the others, `left` and `right` next to the border between them lie within the region.
    """
    cells = n_samples * n_bins

    def numbers(column: pa.Array) -> np.ndarray:
        return column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        counts = np.diff(column.offsets.to_numpy().astype(np.int64))
        if column.null_count:
            counts[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
        return counts, column.flatten()

    def layout(b: pa.RecordBatch) -> tuple[np.ndarray | None, ...]:
        """begin, end, beyond (rows, bins) and short; a bin without a place counts as that of a short region."""
        if size is not None:
            at, minus = b.column("at"), b.column("minus").fill_null(False).to_numpy(zero_copy_only=False)[:, None]
            k = np.arange(n_bins)[None, :]
            begin = at.fill_null(0).to_numpy(zero_copy_only=False)[:, None] + np.where(minus, n_bins - 1 - k, k) * size
            beyond = None
            if masks:
                left, right = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False)[:, None] for c in ("left", "right"))
                beyond = (k < before - left) | (k >= before + right)
            return begin, begin + size, beyond, ~at.is_valid().to_numpy(zero_copy_only=False)
        _, laid = listed(b.column("bins"))
        place = np.arange(b.num_rows).repeat(n_bins) * n_bins + laid.field("bin").to_numpy(zero_copy_only=False)
        short = b.column("too_short").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        scattered = []
        for name in ("start", "end", "beyond"):
            column = laid.field(name)
            own = column.fill_null(False if name == "beyond" else 0).to_numpy(zero_copy_only=False)
            flat = np.empty(len(own), own.dtype)
            flat[place] = own
            scattered.append(flat.reshape(-1, n_bins))
            if column.null_count:
                nowhere = np.zeros(len(own), bool)
                nowhere[place] = ~column.is_valid().to_numpy(zero_copy_only=False)
                short = short | nowhere.reshape(-1, n_bins).any(axis=1)
        return *scattered, short

    def computed(begin: np.ndarray, end: np.ndarray, short: np.ndarray, group: np.ndarray, own: np.ndarray, hits: list[np.ndarray]) -> np.ndarray:
        """(rows, cells), in parts of bounded size."""
        low, high = begin.min(axis=1, keepdims=True), end.max(axis=1, keepdims=True)
        _, first, last, *_ = meetings(low, high, group, own, *hits[:3], n_samples)
        counts = np.maximum(last - first, 0).reshape(len(begin), n_samples).sum(axis=1)
        out = np.empty((len(begin), cells))
        for a, z in parts(counts, cells):
            near = slice(*np.searchsorted(own, [group[a], group[z - 1] + 1]))
            sample, s, e, x = (v[near] for v in hits)
            out[a:z] = values(begin[a:z], end[a:z], short[a:z], own[near], sample, s, e, x, n_samples, statistic, zero, group[a:z]).reshape(z - a, cells)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column("norm").dictionary_encode().indices, *(b.column(c) for c in ("width", "tile", "salt"))]
            opens = np.any([np.diff(numbers(k), prepend=0) != 0 for k in keys], axis=0)
            opens[0] = False
            group = np.cumsum(opens)
            ends = [tuple(b.column(c)[k].as_py() for c in ("norm", "width", "tile", "salt")) for k in (0, b.num_rows - 1)]
            if ends[0] != open_group:
                held = []
            open_group = ends[1]
            is_hit = b.column("sample_idx").is_valid().to_numpy(zero_copy_only=False)
            own, new = group[is_hit], [b.column(c).to_numpy(zero_copy_only=False)[is_hit] for c in ("sample_idx", "at", "until", "x")]
            new[:3] = [v.astype(np.int64) for v in new[:3]]
            held.append(new)
            if not is_hit.all():
                # The group that is open since the last batch has number 0.
                hits = [np.concatenate(v) for v in zip(*held, strict=True)]
                own = np.concatenate([np.zeros(len(hits[0]) - len(own), np.int64), own])
                held = [[v[own == group[-1]] for v in hits]]
                found = b.filter(pa.array(~is_hit))
                yield from answered(found, group[~is_hit], own, hits)
            elif group[-1]:
                held = [[v[own == group[-1]] for v in new]]

    def answered(b: pa.RecordBatch, group: np.ndarray, own: np.ndarray, hits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        begin, end, beyond, short = layout(b)
        fresh = np.ones(b.num_rows, bool)
        fresh[1:] = (group[1:] != group[:-1]) | (short[1:] != short[:-1]) | (begin[1:] != begin[:-1]).any(axis=1) | (end[1:] != end[:-1]).any(axis=1)
        which = np.cumsum(fresh) - 1
        distinct = computed(begin[fresh], end[fresh], short[fresh], group[fresh], own, hits)
        if masks:
            counts, flat = listed(b.column("has"))
            has, of = np.zeros((b.num_rows, n_samples), bool), flat.to_numpy(zero_copy_only=False).astype(np.int64)
            there = (of >= 0) & (of < n_samples)
            has[np.arange(b.num_rows).repeat(counts)[there], of[there]] = True
        step = max(1, (CELLS << 4) // cells)
        region = b.column("region")
        for a in range(0, b.num_rows, step):
            z = min(a + step, b.num_rows)
            found = distinct[which[a:z]]
            if masks:
                found.reshape(-1, n_samples, n_bins)[has[a:z, :, None] & beyond[a:z, None, :]] = np.nan
            flat = found.ravel()
            offsets = pa.array(np.arange(z - a + 1, dtype=np.int32) * cells)
            listing = pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([*region.slice(a, z - a).flatten(), listing], [*(f.name for f in region.type), "values"])

    return run
