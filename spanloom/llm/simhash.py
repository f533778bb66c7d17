"""SimHash near-duplicates by anchor-point covering.

Every document gets a 64-bit SimHash of its word shingles. Two fingerprints link when they differ in
at most `threshold` bits, and linked fingerprints form classes.

Finding the links. The 64 bits are cut into blocks of 22, 21 and 21 bits, and each block is padded to
23 bits and rounded to the binary Golay code, a perfect covering code of radius 3: every 23-bit word
has exactly one code word (its anchor) within 3 bits. The three anchors together are the home of a
fingerprint. A second fingerprint that differs by d1+d2+d3 <= threshold bits in the three blocks is
within 3+dj bits of the home's anchor in block j. So each fingerprint is replicated to all anchors
within the covering radius plus a threshold that the blocks share, and is compared with the homes there:
no pair is missed, and a pair meets exactly once (at the home of its smaller member).

Scale. The replicas per fingerprint are a constant (about 120 for threshold 2), there are 2**36
anchors, and copies were folded to distinct fingerprints before. A home compares with distinct
fingerprints only and can have at most 1+64+2016 partners, so the links are linear in the input.
The anchor join is an equi-join that adaptive execution splits where an anchor is crowded; classes
go back to the documents by a join in which fingerprints with many copies are broadcast.

Results for odd input: a null or wordless text has fingerprint zero and links like any other; fewer
words than a shingle hash as one sequence; repeated rows share a fingerprint and so a class; a class
whose doc_ids are all null has a null class id; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from spanloom.llm.common import doc_texts, join_by_key, kept_table
from spanloom.llm.components import star_components

SEED = 42
#: Generator of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1, and the blocks of a fingerprint.
GOLAY = 0b110001110101
BLOCKS = ((0, 22), (22, 21), (43, 21))
RADIUS = 3


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of every word shingle in order; of the whole sequence where it is shorter than one."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    if len(tokens) < width:
        return np.array([xxh64_intdigest(joined, SEED)], "<u8")
    ends = list(accumulate((len(w) + 1 for w in tokens)))
    starts = [0, *ends[: len(tokens) - width]]
    return np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], "<u8")


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a text's word shingles (repeats count), each hashed by XXH64; 0 without words."""
    hashes = shingle_hashes(text, width)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes; 255 rows at a time are summed in byte lanes."""
    total, lanes = np.zeros(64, np.int64), 255
    for at in range(0, len(hashes), lanes * 64):
        part = hashes[at : at + lanes * 64]
        rows = -len(part) % lanes
        bits = np.unpackbits(np.concatenate([part, np.zeros(rows, "<u8")]).view(np.uint8), bitorder="little")
        sums = bits.view("<u8").reshape(-1, lanes, 8).sum(axis=1, dtype="<u8")
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): text_key tells rows with equal doc_id but different texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, width) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_key", "fp"])

    narrow = doc_texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return narrow.mapInArrow(run, "doc_id long, text_key long, fp long")


@lru_cache(maxsize=4)
def golay(threshold: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tables by syndrome: its two linear halves, and the error patterns of excess 0..threshold over RADIUS."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    low, high = (np.array([remainder(w << s) for w in range(1 << 12)], np.int64) for s in (0, 12))
    patterns, level = [[] for _ in range(RADIUS + threshold + 1)], [0]
    for weight in range(RADIUS + threshold + 1):
        patterns[weight] = level
        level = [w | 1 << b for w in level for b in range(w.bit_length(), 23)]
    by_excess = []
    for excess in range(threshold + 1):
        found: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(RADIUS + 1) if excess == 0 else (RADIUS + excess,):
            for w in patterns[weight]:
                found[low[w & 0xFFF] ^ high[w >> 12]].append(w)
        table = np.full((1 << 11, max(map(len, found))), -1, np.int64)
        for s, row in enumerate(found):
            table[s, : len(row)] = row
        by_excess.append(table)
    return low, high, by_excess


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within the radius plus the threshold: (index into fps, anchor). threshold 0: the homes."""
    low, high, patterns = golay(max(threshold, 0))
    fps = fps.astype(np.uint64)
    near = []
    for at, bits in BLOCKS:
        w = ((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = low[w & 0xFFF] ^ high[w >> 12]
        # The upper 12 of 23 bits name a code word.
        near.append([np.where(p[s] < 0, -1, (w[:, None] ^ p[s]) >> 11) for p in patterns])
    rows, keys = [], []
    for a in range(threshold + 1):
        for b in range(threshold + 1 - a):
            for c in range(threshold + 1 - a - b):
                x, y, z = near[0][a][:, :, None, None], near[1][b][:, None, :, None], near[2][c][:, None, None, :]
                key = ((x << 24) | (y << 12) | z).reshape(len(fps), -1)
                real = ((x >= 0) & (y >= 0) & (z >= 0)).reshape(len(fps), -1)
                i, j = np.nonzero(real)
                rows.append(i)
                keys.append(key[i, j])
    return np.concatenate(rows), np.concatenate(keys)


def covered(fps: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp) for every anchor of every fingerprint within the radius plus the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 2048):
                part = every[at : at + 2048]
                i, key = anchors(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[i])], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `threshold` bits, each once."""
    homes = covered(fps, 0).withColumnRenamed("fp", "a").alias("h")
    replicas = covered(fps, threshold).withColumnRenamed("fp", "b").alias("r")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return replicas.join(homes, (F.col("h.anchor") == F.col("r.anchor")) & near).select("a", "b")


def simhash_classes(docs: DataFrame, threshold: int = 2, width: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, text_key, fp, component_id (smallest doc_id reachable), keeper.

    keeper is true for the rows of the one (doc_id, text) that stands for its class.
    """
    rows = kept_table(fingerprints(docs, width), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    folded = kept_table(rows.groupBy("fp").agg(first.alias("first"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = star_components(links(folded, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    near = roots.join(folded, roots.node == folded.fp)
    least = near.groupBy("root").agg(F.min("first").alias("first"), F.min("low").alias("low"))
    joined = near.select("fp", "root").join(least, "root").select("fp", F.col("first").alias("near_first"), F.col("low").alias("near_low"))
    classes = folded.join(joined, "fp", "left").select(
        "fp",
        "n",
        F.coalesce("near_first", "first").alias("first"),
        F.coalesce("near_low", "low").alias("component_id"),
    )
    out = join_by_key(rows, kept_table(classes, "simhash-classes"), ["fp"], F.xxhash64("doc_id", "text_key"), rows.count())
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select("doc_id", "text_key", "fp", "component_id", same.alias("keeper"))


def drop_near_duplicates(docs: DataFrame, threshold: int = 2, width: int = 3) -> DataFrame:
    """The columns of docs, one row for each class: that of the smallest doc_id."""
    from pyspark.sql import Window

    keepers = simhash_classes(docs, threshold, width).filter("keeper").select(F.col("doc_id").alias("_sl_id"), F.col("text_key").alias("_sl_key")).distinct()
    keyed = docs.withColumn("_sl_text_key", F.xxhash64(F.col("text").cast("string")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_sl_id")) & (F.col("_sl_text_key") == F.col("_sl_key"))
    one = Window.partitionBy("_sl_id", "_sl_key").orderBy("_sl_id")
    return keyed.join(keepers, on).withColumn("_sl_copy", F.row_number().over(one)).filter("_sl_copy = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
