"""bigWig files as a Spark data source.

`spark.read.format("bigwig").load(path)` gives (chrom, start, end, value), the full-resolution intervals
of one file. The driver reads the header, the chromosome tree and the index, and deals the data
blocks to partitions; filters on chrom, start and end that Spark pushes down leave blocks out by
the index, as does the option `ranges`, a JSON list of (chromosome, start, end). Executors read and inflate their own blocks, which needs a path that they can open (a shared mount).
Zoom levels and summaries are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from spanloom.functions.chroms import normal_chrom_name

# Fixed values of the format.
MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
BLOCK_HEADER = struct.Struct("<IIIIIBBH")
SCHEMA = "chrom string, start long, end long, value float"


class BigWigError(ValueError):
    """Not a bigWig file, or one that is damaged."""


@dataclass(frozen=True)
class Chrom:
    number: int
    name: str
    length: int


@dataclass(frozen=True)
class Block:
    chrom: int
    start: int
    end_chrom: int
    end: int
    offset: int
    size: int


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


class BigWigFile:
    """The metadata of a file, and its blocks."""

    def __init__(self, path: str):
        self.path = local_path(path)
        with open(self.path, "rb") as f:
            head = f.read(64)
            if len(head) < 64 or struct.unpack_from("<I", head)[0] != MAGIC:
                raise BigWigError(f"{path} is no little-endian bigWig file")
            self.tree_at, _, self.index_at = struct.unpack_from("<QQQ", head, 8)
            self.inflated = struct.unpack_from("<I", head, 52)[0]
            self.chroms = sorted(self._chroms(f), key=lambda c: c.number)

    def _at(self, f, offset: int, size: int) -> bytes:
        f.seek(offset)
        data = f.read(size)
        if len(data) < size:
            raise BigWigError(f"{self.path} ends early")
        return data

    def _chroms(self, f) -> Iterator[Chrom]:
        magic, _, key_size, value_size = struct.unpack("<IIII", self._at(f, self.tree_at, 16))
        if magic != TREE_MAGIC or value_size != 8:
            raise BigWigError(f"{self.path} has no chromosome tree")
        open_nodes = [self.tree_at + 32]
        while open_nodes:
            at = open_nodes.pop()
            leaf, _, count = struct.unpack("<BBH", self._at(f, at, 4))
            data = self._at(f, at + 4, count * (key_size + 8))
            for k in range(count):
                key = data[k * (key_size + 8) :][:key_size]
                rest = data[k * (key_size + 8) + key_size :][:8]
                if leaf:
                    number, length = struct.unpack("<II", rest)
                    yield Chrom(number, key.rstrip(b"\0").decode(), length)
                else:
                    open_nodes.append(struct.unpack("<Q", rest)[0])

    def blocks(self, ranges: list[tuple[int, int, int]] | None = None) -> list[Block]:
        """Data blocks that meet the ranges (chromosome number, start, end), or all; in order of place in the file."""
        out: list[Block] = []
        merged: list[tuple[int, int, int]] = []
        for c, s, e in sorted(ranges or []):
            if merged and merged[-1][0] == c and s <= merged[-1][2]:
                merged[-1] = (c, merged[-1][1], max(e, merged[-1][2]))
            else:
                merged.append((c, s, e))
        starts = [r[:2] for r in merged]
        with open(self.path, "rb") as f:
            if struct.unpack("<I", self._at(f, self.index_at, 4))[0] != INDEX_MAGIC:
                raise BigWigError(f"{self.path} has no index")
            open_nodes = [self.index_at + 48]
            while open_nodes:
                at = open_nodes.pop()
                leaf, _, count = struct.unpack("<BBH", self._at(f, at, 4))
                item = struct.Struct("<IIIIQQ" if leaf else "<IIIIQ")
                for entry in item.iter_unpack(self._at(f, at + 4, count * item.size)):
                    if ranges is not None:
                        # Of the ranges that begin before the entry ends the last one ends last.
                        k = bisect_left(starts, entry[2:4])
                        if not k or (merged[k - 1][0], merged[k - 1][2]) <= entry[:2]:
                            continue
                    if leaf:
                        out.append(Block(*entry))
                    else:
                        open_nodes.append(entry[4])
        return sorted(out, key=lambda b: b.offset)


def decode(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(chromosome number, starts, ends, values) of a block, inflated if it is deflated; none of an unknown type."""
    if data[:1] == b"\x78":
        data = zlib.decompress(data)
    chrom, start, _, step, span, kind, _, count = BLOCK_HEADER.unpack_from(data)
    body = data[BLOCK_HEADER.size :]
    if kind == BED_GRAPH:
        rows = np.frombuffer(body, [("s", "<u4"), ("e", "<u4"), ("v", "<f4")], count)
        return chrom, rows["s"].astype(np.int64), rows["e"].astype(np.int64), rows["v"]
    if kind == VARIABLE_STEP:
        rows = np.frombuffer(body, [("s", "<u4"), ("v", "<f4")], count)
        starts = rows["s"].astype(np.int64)
        return chrom, starts, starts + span, rows["v"]
    if kind == FIXED_STEP:
        starts = start + step * np.arange(count, dtype=np.int64)
        return chrom, starts, starts + span, np.frombuffer(body, "<f4", count)
    return chrom, *(np.zeros(0, t) for t in (np.int64, np.int64, np.float32))


@dataclass
class Wanted:
    """What pushed filters ask for: chromosomes (None: any), and bounds of overlap."""

    chroms: set[str] | None = None
    start_below: int | None = None
    end_above: int | None = None

    def take(self, f: Filter) -> bool:
        name = getattr(f, "attribute", None)
        if isinstance(f, EqualTo) and name == ("chrom",):
            self.chroms = {f.value} & (self.chroms or {f.value})
        elif isinstance(f, In) and name == ("chrom",):
            self.chroms = set(f.value) & (self.chroms or set(f.value))
        elif isinstance(f, (LessThan, LessThanOrEqual)) and name == ("start",):
            bound = f.value + isinstance(f, LessThanOrEqual)
            self.start_below = bound if self.start_below is None else min(bound, self.start_below)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == ("end",):
            bound = f.value - isinstance(f, GreaterThanOrEqual)
            self.end_above = bound if self.end_above is None else max(bound, self.end_above)
        else:
            return False
        return True


class BlockRun(InputPartition):
    """Consecutive blocks that one task reads."""

    def __init__(self, number: int):
        super().__init__(number)
        self.blocks: list[Block] = []


class BigWigReader(DataSourceReader):
    #: Deflated bytes for each task.
    RUN_BYTES = 8 << 20

    def __init__(self, path: str, run_bytes: int = RUN_BYTES, ranges: list | None = None):
        self.path, self.run_bytes, self.wanted, self.ranges = path, run_bytes, Wanted(), ranges

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.wanted.take(f)
            yield f  # blocks are left out by them; rows are still checked by Spark

    def partitions(self) -> list[BlockRun]:
        file = BigWigFile(self.path)
        w, ranges = self.wanted, None
        if w.chroms is not None or w.start_below is not None or w.end_above is not None:
            ranges = [(c.number, w.end_above if w.end_above is not None else 0, w.start_below if w.start_below is not None else c.length) for c in file.chroms if w.chroms is None or c.name in w.chroms]
        elif self.ranges is not None:
            numbers: dict[str, list[int]] = {}
            for c in file.chroms:
                numbers.setdefault(normal_chrom_name(c.name), []).append(c.number)
            ranges = [(k, s, e) for name, s, e in self.ranges for k in numbers.get(normal_chrom_name(name), [])]
        runs, size = [BlockRun(0)], 0
        for b in file.blocks(ranges):
            if size and size + b.size > self.run_bytes:
                runs.append(BlockRun(len(runs)))
                size = 0
            runs[-1].blocks.append(b)
            size += b.size
        return runs

    def read(self, partition: BlockRun) -> Iterator[pa.RecordBatch]:
        names = {c.number: c.name for c in BigWigFile(self.path).chroms} if partition.blocks else {}
        with open(local_path(self.path), "rb") as f:
            for b in partition.blocks:
                f.seek(b.offset)
                chrom, starts, ends, values = decode(f.read(b.size))
                if len(starts):
                    yield pa.RecordBatch.from_pydict({"chrom": pa.array([names.get(chrom)] * len(starts), pa.string()), "start": pa.array(starts), "end": pa.array(ends), "value": pa.array(values.astype(np.float32))})


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BigWigReader:
        if "path" not in self.options:
            raise BigWigError("a bigWig source needs a path")
        return BigWigReader(self.options["path"], int(self.options.get("runBytes", BigWigReader.RUN_BYTES)), json.loads(self.options["ranges"]) if "ranges" in self.options else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BigWigSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_signal(spark: SparkSession, paths: list[str], ranges: list[tuple[str, int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(signal, chroms) of the files, in the order of their samples; a NaN in a file is left out.

    With ranges (chromosome, start, end), blocks that meet none of them are not read.
    """
    register(spark)
    signal, sizes = None, []
    for k, path in enumerate(paths):
        reader = spark.read.format("bigwig")
        reader = reader if ranges is None else reader.option("ranges", json.dumps(ranges))
        part = reader.load(path).withColumn("sample_idx", F.lit(k)).filter(~F.isnan("value"))
        signal = part if signal is None else signal.unionByName(part)
        sizes += [(k, c.name, c.length) for c in BigWigFile(path).chroms]
    if signal is None:
        raise BigWigError("no score files")
    return signal, spark.createDataFrame(sizes, "sample_idx int, chrom string, length long")


def read_range(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Intervals of one file that overlap a range; the chromosome may be spelled with or without chr."""
    register(spark)
    names = {c.name for c in BigWigFile(path).chroms}
    same = chrom if chrom in names else next((n for n in sorted(names) if normal_chrom_name(n) == normal_chrom_name(chrom)), None)
    if same is None:
        raise BigWigError(f"{path} has no chromosome {chrom}")
    return spark.read.format("bigwig").load(path).filter((F.col("chrom") == same) & (F.col("start") < end) & (F.col("end") > start))
