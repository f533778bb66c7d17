"""What the text operators share: tables in the shared folder, Arrow buffers, word counting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that the numpy kernels take at once; bounds their temporaries to some tens of MB.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table of ours through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


class Scratch:
    """Kept tables that can go once the last of what is made from them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths = []


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words without building the list of them: what is left of runs of non-space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (starting at 0) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row makes a range of its own."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, typed; whatever other columns there are stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: A key with more than a HOT-th of all rows is joined by broadcast; there can't be more than HOT such keys.
HOT = 20_000


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, total: int) -> DataFrame:
    """Inner join on long keys that holds up where a few keys have most rows of left.

    right has each key once, and in n how many rows of left have it; total is the sum of n. Keys with more
    than total / HOT rows, at most HOT of them, are matched by broadcast; their rows are dealt by
    `spread` (a long) among those that meet the rest of right in a shuffle.
    """
    others = [c for c in right.columns if c not in (*keys, "n")]
    most = total / HOT
    hot = right.filter(F.col("n") > most).drop("n").withColumn("_sl_hot", F.lit(True)).withColumnsRenamed({c: f"_sl_hot_{c}" for c in others})
    cold = right.filter(F.col("n") <= most).drop("n").withColumn("_sl_cold", F.lit(True)).withColumnsRenamed({c: f"_sl_cold_{c}" for c in (*keys, *others)})
    first = left.join(F.broadcast(hot), keys, "left").withColumn("_sl_at", F.when(F.col("_sl_hot"), spread).otherwise(F.col(keys[0])))
    on = (F.col("_sl_at") == F.col(f"_sl_cold_{keys[0]}")) & F.col("_sl_hot").isNull()
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"_sl_cold_{k}"))
    found = first.join(cold, on, "left").filter(F.col("_sl_hot") | F.col("_sl_cold"))
    picked = [F.when(F.col("_sl_hot"), F.col(f"_sl_hot_{c}")).otherwise(F.col(f"_sl_cold_{c}")).alias(c) for c in others]
    return found.select(*[F.col(f"`{c}`") for c in left.columns], *picked)
