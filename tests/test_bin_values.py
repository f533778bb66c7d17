"""The kernels of bins against single bases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spanloom.operators import bin_values
from spanloom.options import Statistic

FOLD = {
    Statistic.MEAN: np.mean,
    Statistic.SUM: np.sum,
    Statistic.MIN: np.min,
    Statistic.MAX: np.max,
    Statistic.STD: np.std,
    Statistic.MEDIAN: np.median,
}


@pytest.mark.parametrize("zero", [False, True])
@pytest.mark.parametrize("statistic", list(Statistic))
def test_like_single_bases(statistic, zero):
    rng = random.Random(3)
    for _ in range(25):
        rows, samples, bins = rng.randrange(1, 6), rng.randrange(1, 4), rng.randrange(1, 6)
        begin = np.array([[rng.randrange(-30, 60) for _ in range(bins)] for _ in range(rows)])
        end = begin + np.array([[rng.choice([0, 0, 1, 5, 8, 25]) for _ in range(bins)] for _ in range(rows)])
        short = np.array([rng.random() < 0.2 for _ in range(rows)])
        hits, base = [], {}
        for r in range(rows):
            for s in range(samples):
                at = 0
                while at < 70:
                    a = at + rng.choice([0, 0, 3, 11])
                    at = a + rng.randrange(1, 14)
                    hits.append((r, s, a, at, float(rng.randrange(-5, 30))))
                    base |= {(r, s, p): hits[-1][4] for p in range(a, at)}
        rng.shuffle(hits)
        columns = [np.array(c) for c in zip(*hits, strict=True)]
        found = bin_values.values(begin, end, short, *columns, samples, statistic, zero)
        for r in range(rows):
            for s in range(samples):
                for b in range(bins):
                    own = [base.get((r, s, p)) if not short[r] else None for p in range(begin[r, b], end[r, b])]
                    seen = [x for x in own if x is not None]
                    # Without any base of signal a bin is missing, or zero.
                    own = [x or 0.0 for x in own] if zero else seen
                    expected = FOLD[statistic](own) if seen else 0.0 if zero else np.nan
                    assert found[r, s, b] == pytest.approx(expected, abs=1e-9, nan_ok=True)


def test_parts_cover_all_rows(monkeypatch):
    monkeypatch.setattr(bin_values, "CELLS", 20)
    counts = np.array([3, 0, 50, 1, 1, 19, 2, 0, 0])
    found = list(bin_values.parts(counts, 4))
    assert [x for a, z in found for x in range(a, z)] == list(range(9)) and all(z - a == 1 or (counts[a:z].sum() <= 20 and z - a <= 5) for a, z in found)
    assert list(bin_values.parts(np.zeros(0, np.int64), 4)) == []
