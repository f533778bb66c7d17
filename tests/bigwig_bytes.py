"""bigWig files written byte by byte, with two levels of chromosome tree and of index."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path


def bed_graph(chrom: int, rows) -> tuple[int, int, int, bytes]:
    head = struct.pack("<IIIIIBBH", chrom, rows[0][0], rows[-1][1], 0, 0, 1, 0, len(rows))
    return chrom, rows[0][0], rows[-1][1], head + b"".join(struct.pack("<IIf", *r) for r in rows)


def variable_step(chrom: int, span: int, rows) -> tuple[int, int, int, bytes]:
    head = struct.pack("<IIIIIBBH", chrom, rows[0][0], rows[-1][0] + span, 0, span, 2, 0, len(rows))
    return chrom, rows[0][0], rows[-1][0] + span, head + b"".join(struct.pack("<If", *r) for r in rows)


def fixed_step(chrom: int, start: int, step: int, span: int, values, kind: int = 3) -> tuple[int, int, int, bytes]:
    end = start + step * (len(values) - 1) + span
    head = struct.pack("<IIIIIBBH", chrom, start, end, step, span, kind, 0, len(values))
    return chrom, start, end, head + b"".join(struct.pack("<f", v) for v in values)


def write(path: Path, chroms: list[tuple[str, int]], blocks, deflate: bool = True) -> str:
    """blocks as made above, ordered by chromosome and start; chromosomes are numbered as listed."""
    key = max(len(n) for n, _ in chroms)
    out = bytearray(64)
    tree_at = len(out)
    out += struct.pack("<IIIIQQ", 0x78CA8C91, 2, key, 8, len(chroms), 0)
    leaves = [list(enumerate(chroms))[k : k + 2] for k in range(0, len(chroms), 2)]
    root = len(out)
    out += struct.pack("<BBH", 0, 0, len(leaves)) + bytes(len(leaves) * (key + 8))
    for k, leaf in enumerate(leaves):
        struct.pack_into(f"<{key}sQ", out, root + 4 + k * (key + 8), leaf[0][1][0].encode(), len(out))
        out += struct.pack("<BBH", 1, 0, len(leaf))
        for number, (name, length) in leaf:
            out += struct.pack(f"<{key}sII", name.encode(), number, length)
    data_at = len(out)
    out += struct.pack("<Q", len(blocks))
    placed, largest = [], 0
    for chrom, start, end, raw in blocks:
        data = zlib.compress(raw) if deflate else raw
        largest = max(largest, len(raw))
        placed.append((chrom, start, end, len(out), len(data)))
        out += data
    index_at = len(out)
    out += struct.pack("<IIQIIIIQII", 0x2468ACE0, 2, len(placed), 0, 0, len(chroms), 0, index_at, 1, 0)
    groups = [placed[k : k + 2] for k in range(0, len(placed), 2)]
    root = len(out)
    out += struct.pack("<BBH", 0, 0, len(groups)) + bytes(len(groups) * 24)
    for k, group in enumerate(groups):
        struct.pack_into("<IIIIQ", out, root + 4 + k * 24, group[0][0], group[0][1], group[-1][0], max(g[2] for g in group), len(out))
        out += struct.pack("<BBH", 1, 0, len(group))
        for chrom, start, end, at, size in group:
            out += struct.pack("<IIIIQQ", chrom, start, chrom, end, at, size)
    struct.pack_into("<IHHQQQHHQQIQ", out, 0, 0x888FFC26, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 0, largest if deflate else 0, 0)
    path.write_bytes(out)
    return str(path)
