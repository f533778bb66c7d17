"""Substring deduplication by content-defined chunking.

A gear rolling hash of the last 16 bytes runs over each text; a chunk ends where the hash falls under a bound,
at least `MIN_CHUNK` and at most `MAX_CHUNK` bytes after the chunk before, and never inside a
character. As the places depend on the bytes nearby only, chunks fall into step again soon after
an insertion. Chunks are deduplicated by a 128-bit digest: the smallest doc_id that has a chunk keeps its
first occurrence there, every other occurrence is a repeat. Repeats that follow each other in a
text make a run, and runs of at least `min_chars` code points are reported as spans to drop; shorter ones
(a stock phrase, a common heading) are left alone.

Scale. Within a document equal chunks are folded before anything is shuffled. One shuffle combines
(digest, smallest doc_id, count), map-side first, so that a chunk of a third of all documents is one row
for each task; only digests that occur more than once meet the chunks again, in an equi-join that broadcasts the digests of
a large share of all chunks. Runs are formed within a text, equal rows folded. Chunks are computed twice
rather than written.

Results for odd input: null and empty texts have no chunks; rows with the same doc_id are one document
(spans of each text are reported under it, once for equal rows); a null doc_id counts as the largest; an empty table gives no rows; other columns are ignored
(drop_repeats: passed through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from spanloom.llm.common import doc_texts, join_by_key, kept_table, slices, utf8

MIN_CHUNK, MEAN_TAIL, MAX_CHUNK = 16, 24, 128
MIN_CHARS = 100
GEAR = np.random.default_rng(11).integers(0, 1 << 16, 256, dtype=np.uint16)
WINDOW = 16


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the sum of GEAR[byte j places back] << j, in 16 bits, by doubling."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    return h


def cut_places(data: np.ndarray, candidates: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of data[begin:end], given the places where the hash allows one."""
    out, last = [], begin
    for p in [*candidates, end]:
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            while data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if p - last >= MIN_CHUNK or p == end and p > last:
            out.append(p)
            last = p
    return out


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """For each text its chunk ends."""
    allowed = gear_hash(data) < (1 << 16) // MEAN_TAIL
    allowed[:-1] &= (data[1:] & 0xC0) != 0x80
    places = np.flatnonzero(allowed) + 1
    first = np.searchsorted(places, offsets, side="right")
    places = places.tolist()
    for k in range(len(offsets) - 1):
        yield cut_places(data, places[first[k] : first[k + 1]], int(offsets[k]), int(offsets[k + 1]))


def _chunk_rows(docs: DataFrame, folded: bool) -> DataFrame:
    """folded: (h1, h2, doc_id, n), once for each document and digest. Else every chunk with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, (every, bounds) = b.column(0), utf8(b.column(1))
            for top, stop in slices(bounds):
                data, offsets = every[bounds[top] : bounds[stop]], bounds[top : stop + 1] - bounds[top]
                raw, rows, digests, numbers, begins, ends = data.tobytes(), [], [], [], [], []
                for k, cuts in enumerate(chunks(data, offsets)):
                    starts = [int(offsets[k]), *cuts[:-1]]
                    keys = [xxh3_128_digest(raw[a:z]) for a, z in zip(starts, cuts, strict=False)]
                    if folded:
                        count: dict[bytes, int] = {}
                        for key in keys:
                            count[key] = count.get(key, 0) + 1
                        keys = list(count)
                        numbers += count.values()
                    else:
                        seen: set[bytes] = set()
                        for i, key in enumerate(keys):
                            numbers.append(-i - 1 if key in seen else i)
                            seen.add(key)
                        begins += starts[: len(keys)]
                        ends += cuts
                    rows.append(len(keys))
                    digests += keys
                pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                out = {
                    "h1": pa.array(np.ascontiguousarray(pairs[:, 0])),
                    "h2": pa.array(np.ascontiguousarray(pairs[:, 1])),
                    "doc_id": ids.slice(top, stop - top).take(pa.array(np.repeat(np.arange(len(rows)), rows))),
                    "number": pa.array(numbers, pa.int32()),
                }
                if not folded:
                    texts = [xxh3_64_intdigest(raw[a:z]) for a, z in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                    out["text_key"] = pa.array(np.repeat(np.array(texts, np.uint64).view(np.int64), rows))
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    base = np.repeat(points[offsets[:-1]], rows)
                    out["start"] = pa.array((points[np.array(begins, np.int64)] - base).astype(np.int32))
                    out["end"] = pa.array((points[np.array(ends, np.int64)] - base).astype(np.int32))
                yield pa.RecordBatch.from_pydict(out)

    return doc_texts(docs).mapInArrow(run, "h1 long, h2 long, doc_id long, number int" + ("" if folded else ", text_key long, start int, end int"))


def repeated_spans(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, start, end, n_chunks, kept_doc_id): spans that another document, or an earlier place, keeps.

    start and end are code points, end exclusive; kept_doc_id is the smallest document that keeps a
    chunk of the span.
    """
    folded = _chunk_rows(docs, True).groupBy("h1", "h2").agg(F.min("doc_id").alias("kept_doc_id"), F.sum("number").alias("n"))
    repeats = kept_table(folded.filter("n > 1"), "repeated-chunks")
    total = repeats.agg(F.sum("n")).first()[0] or 0
    hits = join_by_key(_chunk_rows(docs, False), repeats, ["h1", "h2"], F.xxhash64("text_key", "number"), total)
    again = F.col("number") < 0
    lost = hits.filter(again | ~F.col("doc_id").eqNullSafe(F.col("kept_doc_id")))
    lost = lost.select("doc_id", "text_key", F.when(again, -F.col("number") - 1).otherwise(F.col("number")).alias("place"), "start", "end", "kept_doc_id")
    # Equal rows fold before a text's places meet.
    lost = lost.groupBy("doc_id", "text_key", "place").agg(*[F.min(c).alias(c) for c in ("start", "end", "kept_doc_id")])
    runs = lost.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("place")))
    spans = runs.groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"), F.min("kept_doc_id").alias("kept_doc_id"))
    return spans.filter(F.col("end") - F.col("start") >= min_chars).drop("run", "text_key")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : max(at, start)])
        at = max(at, end)
    return "".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the texts that are left; the other columns as they were.

    A document without doc_id, or whose doc_id has several texts, can't be told from others and keeps its text.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    named = doc_texts(docs).groupBy(F.col("doc_id").alias("_sl_id")).agg((F.min(key) == F.max(key)).alias("_sl_one")).filter("_sl_one").drop("_sl_one")
    spans = repeated_spans(docs, min_chars).join(named, F.col("doc_id") == F.col("_sl_id")).groupBy("_sl_id").agg(F.collect_list(F.struct("start", "end")).alias("_sl_spans"))
    marked = docs.join(spans, F.col("doc_id").cast("long") == F.col("_sl_id"), "left").drop("_sl_id")
    text_at, schema = docs.columns.index("text"), docs.withColumn("text", F.col("text").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:-1])
            pairs = zip(columns[text_at].to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
            columns[text_at] = pa.array([without_spans(t, [(s["start"], s["end"]) for s in cut]) if cut else t for t, cut in pairs], pa.string())
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return marked.mapInArrow(run, schema)
