"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of fewer than
`min_chars` code points are never dropped. Batches of documents arrive one after the other. A batch's
distinct keys are merge-joined with the runs written so far: keys that no run holds (the anti-join) go into the
batch's own new run with the document that keeps the line; keys known already only add to the
count of documents. Runs are sorted by hash and live in levels: when a level has `fanout` runs, they
are compacted into one run of the next level, so a batch of n keys is rewritten O(log n) times.
After the last batch, keys found in at least `min_docs` documents lose their lines everywhere but in
the keeping document. Batches run from the largest doc_ids to the smallest, so the first run to hold
a key holds its largest doc_id.

Scale. Runs lie in buckets by hash, each a sorted file, and a manifest names them: a batch is shuffled and sorted once, old
runs never are, and a later job goes on from the manifest. Only 16-byte hashes, counts and ids are shuffled for the decision; counts are combined
before the shuffle, and (key, document) pairs are made distinct first, so that a line of a third of all documents stays
spread (the documents of one key meet in sums and maxima, never in a list); lines of a large share of documents meet their keeper by broadcast. Texts meet their documents' lists of dropped keys by doc_id once.

Results for odd input: a null or empty text is one empty line, which is kept; rows of the same doc_id
are one document; a null doc_id is the smallest document, and its rows count as one; an empty table gives an
empty table; other columns pass through drop_repeated_lines untouched.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from spanloom.llm.common import SPACE_BYTES, doc_texts, drop_path, join_by_key, kept_table, new_path, write_file

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
#: Keys of all documents for each bucket of a run.
BUCKET_KEYS = 4_000_000


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16-byte hash of the line's key; None for a key too short to drop."""
    key = line.strip(SPACE_BYTES).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2), once for each row and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found, counts = b.column(0), [], []
            for text in b.column(1).cast(pa.binary()):
                keys = {line_key(x, min_chars) for x in (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")} - {None}
                found += keys
                counts.append(len(keys))
            pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            which = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([ids.take(which), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["doc_id", "h1", "h2"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, h1 long, h2 long")


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark takes the order of a bucket that is one file as given."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Sorted runs (h1, h2, n_docs, keeper, has_keeper) in levels, in a folder of the shared one.

    A run is a table in `buckets` buckets by (h1, h2), each one sorted file. So a batch is merge-joined with the runs, and
    runs with each other, bucket by bucket: the batch alone is shuffled and sorted. A manifest in the
    folder lists the runs; opened again by `root`, in another session too, they take further batches.
    """

    SCHEMA = "h1 long, h2 long, n_docs long, keeper long, has_keeper boolean"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None, root: str | None = None):
        self.spark, self.root, self.version = spark, root or new_path(spark, "line-runs"), 0
        self._done: list[str] = []
        self.fanout, self.buckets, self.levels = fanout, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), [[]]
        if root:
            rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest-*.json").json(f"{root}/manifests").collect()
            last = max(rows, key=lambda r: r.version)
            self.version, self.fanout, self.buckets, self.levels = last.version, last.fanout, last.buckets, [list(x) for x in last.levels]

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _save_manifest(self) -> None:
        """A new file, then the one before goes; the latest that is there counts."""
        self.version += 1
        text = json.dumps({"version": self.version, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels})
        name = lambda v: f"{self.root}/manifests/manifest-{v}.json"
        write_file(self.spark, name(self.version), text)
        if self.version > 1:
            drop_path(self.spark, name(self.version - 1))

    def _table(self, path: str) -> DataFrame:
        name = "sl_run_" + path.rsplit("-", 1)[1]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA.replace(' long', ' BIGINT')}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _merged(self, old: str, new: str) -> DataFrame:
        """Two runs as one, by a merge join."""
        side = lambda path, k: self._table(path).select("h1", "h2", *[F.col(c).alias(f"{c}{k}") for c in ("n_docs", "keeper", "has_keeper")])
        both = side(old, 1).join(side(new, 2).hint("merge"), ["h1", "h2"], "full")
        n = F.coalesce("n_docs1", F.lit(0)) + F.coalesce("n_docs2", F.lit(0))
        # A key has its keeper in the first run that held it.
        first, second = (F.coalesce(f"has_keeper{k}", F.lit(False)) for k in (1, 2))
        return both.select("h1", "h2", n.cast("long").alias("n_docs"), F.when(first, F.col("keeper1")).when(second, F.col("keeper2")).alias("keeper"), (first | second).alias("has_keeper"))

    def _write(self, run: DataFrame) -> str:
        """run is dealt to buckets already; where one isn't a single file, Spark sorts when it reads it."""
        path = f"{self.root}/run-{uuid.uuid4().hex}"
        run.sortWithinPartitions("h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable("sl_run_" + path.rsplit("-", 1)[1])
        return path

    def _drop(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS sl_run_{path.rsplit('-', 1)[1]}")
        drop_path(self.spark, path)

    def merged(self) -> DataFrame:
        """All runs compacted into one."""
        paths = self.paths()[::-1]
        if not paths:
            return self.spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in self.SCHEMA.split(", "))])
        if len(paths) > 1:
            self._compact(paths, len(self.levels) - 1)
            self.levels[:-1] = [[] for _ in self.levels[:-1]]
            self._save_manifest()
            self._clear()
        return self._table(self.paths()[0])

    def _compact(self, paths: list[str], level: int) -> None:
        """paths, the oldest first, become one run of the level."""
        with sorted_scans(self.spark):
            while len(paths) > 1:
                new = self._write(self._merged(paths[0], paths[1]))
                self._done += paths[:2]
                paths = [new, *paths[2:]]
        self.levels[level] = [*[p for p in self.levels[level] if p not in self._done], *paths]

    def _clear(self) -> None:
        for path in self._done:
            self._drop(path)
        self._done = []

    def joined(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch's own run: keys that some run holds have no keeper."""
        own = keys.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        fresh = F.lit(True)
        for k, path in enumerate(self.paths()):
            held = self._table(path).filter("has_keeper").select("h1", "h2", F.lit(True).alias(f"held{k}"))
            own = own.join(held.hint("merge"), ["h1", "h2"], "left")
            fresh = fresh & F.col(f"held{k}").isNull()
        return own.select("h1", "h2", "n_docs", F.when(fresh, F.col("keeper")).alias("keeper"), fresh.alias("has_keeper"))

    def add(self, keys: DataFrame) -> None:
        """keys: (doc_id, h1, h2) of documents that no earlier batch held."""
        with sorted_scans(self.spark):
            self.levels[0].append(self._write(self.joined(keys).repartition(self.buckets, "h1", "h2")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self._compact(old, level + 1)
            level += 1
        self._save_manifest()
        self._clear()


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(_sl_drop_id, _sl_dropped): for each document that loses lines, the hashes h1, h2 of their keys."""
    keys = kept_table(line_keys(docs, min_chars), "line-keys")
    shares = [k / batches for k in range(1, batches)]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).na.drop()
    cuts = sorted(set(ids.approxQuantile("doc_id", shares, 0.01)), reverse=True) if shares else []
    bounds = [None, *(int(c) for c in cuts), None]
    total = keys.count()
    runs = LineRuns(docs.sparkSession, fanout, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_KEYS))
    for above, below in zip(bounds[1:], bounds, strict=False):
        part = keys if below is None else keys.filter(F.col("doc_id").isNull() | (F.col("doc_id") < below))
        runs.add(part if above is None else part.filter(F.col("doc_id") >= above))
    common = kept_table(runs.merged().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper", F.col("n_docs").alias("n")), "common-lines")
    met = join_by_key(keys, common, ["h1", "h2"], F.xxhash64("doc_id"), total)
    lost = met.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy(F.col("doc_id").alias("_sl_drop_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("_sl_dropped"))


def split_lines(text: bytes | None, dropped: set[bytes], min_chars: int = MIN_CHARS) -> tuple[list[bytes], int]:
    """The lines that stay, and the number of all lines."""
    lines = (text or b"").split(b"\n")
    return [x for x in lines if line_key(x, min_chars) not in dropped] if dropped else lines, len(lines)


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """Every column of docs, and _sl_n_lines, _sl_n_dropped, _sl_kept (text): the text without dropped lines.

    A text that loses no line, null included, stays as it is.
    """
    min_chars = how.get("min_chars", MIN_CHARS)
    marked = docs.join(dropped_keys(docs, **how), F.col("doc_id").cast("long").eqNullSafe(F.col("_sl_drop_id")), "left").drop("_sl_drop_id")
    schema = docs.withColumns({"_sl_n_lines": F.lit(0).cast("long"), "_sl_n_dropped": F.lit(0).cast("long"), "_sl_kept": F.lit(None).cast("string")}).schema
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, rows = b.column(b.num_columns - 1), []
            for text, lost in zip(b.column(text_at).cast(pa.binary()), lists, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                if lost.is_valid:
                    pairs = lost.values
                    raw_keys = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], axis=1).astype("<i8").tobytes()
                    stay, n = split_lines(raw, {raw_keys[i : i + 16] for i in range(0, len(raw_keys), 16)}, min_chars)
                    rows.append((n, n - len(stay), b"\n".join(stay)))
                else:
                    rows.append(((raw or b"").count(b"\n") + 1, 0, raw))
            n, dropped, kept = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return marked.mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with the text that is left; n_chars, if there, counts its code points. No document goes.

    A document whose lines all go has an empty text.
    """
    out = deduplicated(docs, **how)
    new = {"text": F.col("_sl_kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_sl_n_dropped") > 0, F.char_length("_sl_kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])


def sha256(text: bytes | None) -> str:
    return hashlib.sha256(text or b"").hexdigest()
