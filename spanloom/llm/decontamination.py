"""Benchmark decontamination by spaced-seed hashing.

Texts are read as tokens: runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII
characters. Each fixed mask picks some token positions of a window and ignores the rest, so that a
window still hashes alike after a substitution at an ignored place. Hashes of all benchmark windows
and of all training windows are joined; each hit fixes an alignment of a benchmark item with a
document, and the aligned tokens around it are compared exactly. It is an overlap if the whole item lies in the document
with `similarity` or more of its tokens equal; else if the best-scoring segment (+1 for an equal
token, minus `penalty` for another) has at least min(`min_tokens`, tokens of the item) tokens, of which
`similarity` or more are equal. An item of which e tokens may differ is also cut into e + 1 parts, each looked up
as it is: wherever the e tokens lie, one part is whole. At the default bounds every best segment has `RUN` equal
tokens in a row, so all runs of that many are looked up too. An item
of fewer than `MIN_ITEM` tokens says too little to match anything. Tokens are compared by 64-bit hashes.

Scale. The documents are read once per block of the benchmark and never shuffled. The hash join is a
map-side join against one block at a time; a block holds at most about `block_bytes` of benchmark
text (items are dealt to blocks by hash), so driver and executor memory do not grow with the
benchmark: a larger benchmark makes more blocks. Texts and items that repeat a word are met by runs, not by pairs of
windows, and hits are laid out in bounded parts.

Results for odd input: null or empty texts and items never match; an item with a repeated item_id
reports its best overlap once; a row of docs that occurs twice is reported twice; an empty benchmark or table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import doc_texts, slices, utf8

#: Positions that count, of a window of ten tokens; every position is ignored by some mask.
MASKS = ("1101100111", "1110011011", "1011111100", "0111101101")
MIN_TOKENS, SIMILARITY, PENALTY = 13, 0.8, 3
MIN_ITEM = 5
RUN = 4
#: Alignments compared, and hits laid out, at once.
ALIGNMENTS, HITS = 1 << 12, 1 << 20
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, start int, end int, n_tokens int, n_equal int, item_tokens int"

_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 128:
        _LOWER[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_BYTE[0] = 0


@dataclass
class Tokens:
    """Hashes of the tokens of several texts, with the text and the byte range of each."""

    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    first: np.ndarray  # index of each text's first token, and one past the last


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    lower = _LOWER[data]
    inside = lower != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = offsets[:-1]
    at = at[at < len(data)]
    opens[at] = inside[at]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return Tokens(np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, np.zeros(len(offsets), np.int64))
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    hashes = np.add.reduceat(_BYTE[lower] * _PLACE[place & 255], starts)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    first = np.searchsorted(starts, offsets)
    return Tokens(hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), starts, first)


def token_end(data: np.ndarray, at: int, most: int) -> int:
    """End of the token that starts at byte `at`, in a text that ends at `most`."""
    while at < most and _LOWER[data[at]]:
        at += 1
    return at


def window_hashes(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k : k + n] * _STEP[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out


def parts(n: int, similarity: float) -> list[tuple[int, int]]:
    """Ranges of an item of n tokens, one more than the tokens that may differ."""
    least = next(k for k in range(n + 1) if k >= similarity * n)
    cuts = np.linspace(0, n, min(n, n - least + 1) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


class Block:
    """The windows of a bounded part of the benchmark, by hash."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        texts = [(i, t.encode()) for i, t in items if t]
        offsets = np.cumsum([0, *(len(t) for _, t in texts)])
        data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
        tok = tokens(data, offsets)
        self.ids = [i for i, _ in texts]
        self.items = [tok.hashes[a:b] for a, b in zip(tok.first, tok.first[1:], strict=False)] if len(tok.hashes) else []
        found, whole = [], [(k, x) for k, x in enumerate(self.items) if len(x) >= MIN_ITEM]
        cuts = {(k, at, end - at) for k, x in whole for at, end in parts(len(x), similarity)}
        self.masks = [*MASKS, *("1" * n for n in sorted({RUN} | {n for _, _, n in cuts}))]
        for m, mask in enumerate(self.masks):
            for k, item in whole:
                h = window_hashes(item, mask, m)
                at = np.arange(len(h))
                if m >= len(MASKS) and len(mask) != RUN:
                    at = np.array([p for p in at.tolist() if (k, p, len(mask)) in cuts], np.int64)
                found.append(np.stack([h[at], np.full(len(at), k, np.uint64), at.astype(np.uint64)]))
        every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.uint64)
        every = every[:, np.lexsort((every[2], every[1], every[0]))]
        # Of equal windows that follow each other in an item the first stands for all, with their number.
        opens = np.ones(every.shape[1], bool)
        opens[1:] = (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1]) | (every[2, 1:] != every[2, :-1] + np.uint64(1))
        first = np.flatnonzero(opens)
        self.long = np.diff(np.append(first, every.shape[1]))
        every = every[:, first]
        self.hashes, self.item, self.place = every[0], every[1].astype(np.int64), every[2].astype(np.int64)
        bits = max(16, int(32 * max(1, len(self.hashes))).bit_length())
        self.shift = np.uint64(64 - min(bits, 26))
        self.filter = np.zeros(1 << min(bits, 26), bool)
        self.filter[self.hashes >> self.shift] = True

    def hits(self, tok: Tokens) -> np.ndarray:
        """Rows (text, item, token of tok at which the item would start), each once.

        A run of equal windows in a text (a repeated word) that meets such a run in an item gives the range of places that
        their pairs give, not the pairs; ranges are laid out in parts of HITS rows at most, made distinct as they come.
        """
        kept, fresh, n_fresh = np.zeros((0, 3), np.int64), [], 0
        for m, mask in enumerate(self.masks):
            h = window_hashes(tok.hashes, mask, m)
            at = np.flatnonzero(self.filter[h >> self.shift])
            at = at[tok.rows[at] == tok.rows[at + len(mask) - 1]]
            opens = np.ones(len(at), bool)
            opens[1:] = (h[at[1:]] != h[at[:-1]]) | (at[1:] != at[:-1] + 1) | (tok.rows[at[1:]] != tok.rows[at[:-1]])
            first = np.flatnonzero(opens)
            long, at = np.diff(np.append(first, len(at))), at[first]
            low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for top, stop in _parts(high - low):
                n = (high - low)[top:stop]
                entry = np.repeat(low[top:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
                begin = np.repeat(at[top:stop], n) - self.place[entry] - self.long[entry] + 1
                width = np.repeat(long[top:stop], n) + self.long[entry] - 1
                rows, items = np.repeat(tok.rows[at[top:stop]], n), self.item[entry]
                for a, z in _parts(width):
                    w = width[a:z]
                    places = np.repeat(begin[a:z] - np.cumsum(w) + w, w) + np.arange(w.sum())
                    fresh.append(np.stack([np.repeat(rows[a:z], w), np.repeat(items[a:z], w), places], axis=1))
                    n_fresh += len(places)
                    if n_fresh > HITS:
                        kept, fresh, n_fresh = _distinct(np.concatenate([kept, *fresh])), [], 0
        return _distinct(np.concatenate([kept, *fresh]))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct rows in order; by one number for each where they fit."""
    if not len(rows):
        return rows
    low, span = rows.min(axis=0), np.ptp(rows, axis=0) + 1
    if int(span[0]) * int(span[1]) * int(span[2]) >= 1 << 62:
        return np.unique(rows, axis=0)
    a, b, c = (rows - low).T
    key = np.unique((a * span[1] + b) * span[2] + c)
    return np.stack([key // (span[1] * span[2]), key // span[2] % span[1], key % span[2]], axis=1) + low


def _parts(n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of n whose sums are HITS at most, or of one entry."""
    out, first, ends = [], 0, np.cumsum(n)
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, side="right")))
        out.append((first, last))
        first = last
    return out


def likely(block: Block, tok: Tokens, hits: np.ndarray, min_tokens: int, similarity: float) -> np.ndarray:
    """The hits with as many equal tokens in all as the shortest overlap needs."""
    out = []
    sizes = np.array([len(x) for x in block.items], np.int64)
    begins = np.cumsum(sizes) - sizes
    every = np.concatenate(block.items) if block.items else np.zeros(0, np.uint64)
    for top in range(0, len(hits), ALIGNMENTS):
        part = hits[top : top + ALIGNMENTS]
        row, k, diagonal = part.T
        a, b = np.maximum(tok.first[row], diagonal), np.minimum(tok.first[row + 1], diagonal + sizes[k])
        n = b - a
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(a - ends + n, n)
        same = tok.hashes[at] == every[at + np.repeat(begins[k] - diagonal, n)]
        equal = np.add.reduceat(same, ends - n, dtype=np.int64)
        out.append(part[equal >= similarity * np.minimum(min_tokens, sizes[k])])
    return np.concatenate(out) if out else hits


def best_segment(equal: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """(start, end, equal tokens) of the best-scoring segment."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -penalty))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[0])
    return start, end, int(equal[start:end].sum())


def overlaps(block: Block, data: np.ndarray, offsets: np.ndarray, min_tokens: int, similarity: float, penalty: int) -> list[tuple]:
    """(text, item_id, start, end, tokens, equal tokens, item's tokens): the best of each text and item; code points."""
    tok = tokens(data, offsets)
    best: dict[tuple, tuple] = {}
    for row, k, diagonal in likely(block, tok, block.hits(tok), min_tokens, similarity).tolist():
        item, first, last = block.items[k], int(tok.first[row]), int(tok.first[row + 1])
        if best.get((row, block.ids[k]), (0, 0, 0, 0))[0] >= len(item):
            continue  # no alignment has more equal tokens, and those that follow begin later
        a, b = max(first, diagonal), min(last, diagonal + len(item))
        same = tok.hashes[a:b] == item[a - diagonal : b - diagonal]
        start, end, equal = best_segment(same, penalty)
        if b - a == len(item) and same.sum() >= similarity * len(item):
            start, end, equal = 0, len(item), int(same.sum())
        n = end - start
        if n < min(min_tokens, len(item)) or equal < similarity * n:
            continue
        key, found = (row, block.ids[k]), (equal, n, -(a + start), len(item))
        if key not in best or found > best[key]:
            best[key] = found
    out = []
    for (row, item_id), (equal, n, minus, whole) in best.items():
        t, begin, most = -minus, int(offsets[row]), int(offsets[row + 1])
        points = [len(data[begin:x].tobytes().decode("utf-8", "replace")) for x in (int(tok.starts[t]), token_end(data, int(tok.starts[t + n - 1]), most))]
        out.append((row, item_id, *points, n, equal, whole))
    return sorted(out)


def _search(docs: DataFrame, items: list[tuple[int, str]], min_tokens: int, similarity: float, penalty: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, similarity)
        for b in batches:
            data, offsets = utf8(b.column(1))
            ids, out = b.column(0), []
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                for row, *rest in overlaps(block, data[part[0] : part[-1]], part - part[0], min_tokens, similarity, penalty):
                    out.append((ids[first + row].as_py(), *rest))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "n_tokens", "n_equal", "item_tokens"])

    return doc_texts(docs).mapInArrow(run, SCHEMA)


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, penalty: int = PENALTY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item that overlap: where, how long, how many tokens equal."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size) // block_bytes
    found = None
    for k in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        part = _search(docs, sorted(((r.item_id, r.text) for r in rows if r.text), key=lambda x: (x[0] is None, x)), min_tokens, similarity, penalty)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows whose text overlaps an item of the benchmark, whatever their doc_id."""
    key = F.xxhash64(F.col("text").cast("string"))
    by_text = docs.select(key.alias("doc_id"), "text")
    bad = benchmark_overlaps(by_text, benchmark, **how).select(F.col("doc_id").alias("_sl_bad_key")).distinct()
    return docs.join(bad, key == F.col("_sl_bad_key"), "left_anti")
