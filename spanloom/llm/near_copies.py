"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A SimHash of a pair at 0.8 differs in ten bits or so, too many for anchors alone. So candidates are the links of
five-word SimHashes (see simhash) and the texts that share a band: BANDS groups of ROWS minima of the shingles
under random maps. A pair at 0.8 shares none with odds of (1 - 0.8**ROWS)**BANDS, 3 in a million, and less above. Every candidate
is then verified on the shingles, compared as 64-bit hashes, so no other pair links. Linked texts form classes.

Scale. Texts of equal words are folded before anything else, and only texts that share a band go on. A shingle
that no other of these texts has can't be shared, which bounds the similarity of a text to any other by numbers alone. The
members of a band are first compared with its centre, the member with the smallest share of such
shingles, and with the links of SimHash, so a large group of near copies costs a multiple of its size.
Texts whose band still holds two classes are then joined by prefixes: of two texts at 0.8, the rarest fifth of one's shingles meets
that of the other (no pair is missed), and a pair is only made where the place of the shared
shingle leaves room for 0.8 and the classes differ; the largest class of a shingle doesn't meet itself.
Texts of candidates alone are read again, once; the shingles of the few keys with many partners are broadcast.

Results for odd input: null and wordless texts are copies of each other; fewer words than a shingle are one
sequence; case of ASCII letters and kinds of space don't count; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from spanloom.llm.common import HOT, Scratch, doc_texts, join_by_key, kept_table
from spanloom.llm.components import star_components
from spanloom.llm.simhash import SEED, links, majority, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Keys with more than a MANY-th of the pairs have their shingles broadcast.
MANY = 1000

_random = np.random.default_rng(32)
_TIMES = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of the minima of distinct shingles; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, at : at + 1024] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    least ^= least >> np.uint64(31)
    out = (least * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(text: bytes) -> int:
    return _signed(xxh64_intdigest(b" ".join(text.lower().split()), SEED))


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary()))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, key, fp, bands): key names the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t in _bytes(b.column(2)):
                hashes = shingle_hashes(t, WIDTH)
                distinct = np.unique(hashes)
                out.append((_key(t), _signed(majority(hashes)) if len(hashes) else 0, bands(distinct)))
            columns = list(zip(*out, strict=True)) or [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "text_key", "key", "fp", "bands"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, key long, fp long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def shingle_sets(docs: DataFrame, folded: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shingles): the sorted distinct shingles of the folded texts that keys (key) names."""
    wanted = folded.join(keys, "key", "left_semi").select(F.col("first.doc_id").alias("want_id"), F.col("first.text_key").alias("want_key"))
    # Joined alike at every size: the wanted grow with the documents.
    texts = _keyed(docs).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_key") == F.col("want_key")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(_bytes(b.column(0)))
            sets = [np.unique(shingle_hashes(t, WIDTH)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_key(t) for t in texts], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    # Repeated rows of a document have equal sets.
    return texts.select("text").mapInArrow(run, "key long, shingles array<long>").dropDuplicates(["key"])


def verified(sets: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose shingles have the similarity; a may be in many of them."""
    total = pairs.count()
    right = pairs.groupBy("a").count().withColumnRenamed("count", "n").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    left = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "y")
    both = join_by_key(left, scratch.keep(right, "partners"), ["a"], F.col("b"), total * HOT // MANY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= SIMILARITY * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "y", "x").mapInArrow(run, "a long, b long")


def room(common: Column, size: Column) -> Column:
    """Whether `common` shingles can give the similarity, `size` being the sum of the sizes of both texts."""
    return (1 + SIMILARITY) * common >= SIMILARITY * size - 1e-6


def measured(sets: DataFrame) -> DataFrame:
    """(key, size, core): the number of shingles, and of those that another of the sets has too."""
    every = sets.select("key", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    lone = every.filter("n = 1").groupBy("key").agg(F.count(F.lit(1)).alias("lone"))
    sizes = sets.select("key", F.size("shingles").cast("long").alias("size"))
    return sizes.join(lone, "key", "left").select("key", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("core"))


def by_prefix(sets: DataFrame, apart: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of apart (key, size, root) with different roots that may have the similarity."""
    tokens = scratch.keep(apart.join(sets, "key").select("key", "size", "root", F.explode("shingles").alias("s")), "tokens")
    counts = scratch.keep(tokens.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    ranked = join_by_key(tokens, counts.withColumn("common", F.col("n")), ["s"], F.col("key"), tokens.count())
    place = F.row_number().over(Window.partitionBy("key").orderBy("common", "s")) - 1
    prefix = ranked.withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-6)).select("s", "key", "size", "root", "place")
    prefix = scratch.keep(prefix, "prefixes")
    classes = prefix.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n"))
    hubs = classes.groupBy("s").agg(F.max(F.struct("n", "root")).alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("s", F.col("hub.root").alias("hub"))
    x = prefix.join(hubs, "s").filter("root <> hub").toDF("s", "a", "size_a", "root_a", "place_a", "hub")
    y = prefix.toDF("t", "b", "size_b", "root_b", "place_b")
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    on = (F.col("s") == F.col("t")) & (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("hub")) | (F.col("a") < F.col("b"))) & room(left, F.col("size_a") + F.col("size_b"))
    return x.join(y, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(docs: DataFrame, folded: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): links of folded keys whose classes are those of all pairs at the similarity."""
    members = folded.select("key", F.explode("bands").alias("band"))
    several = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    shared = scratch.keep(members.join(several.hint("merge"), "band"), "bands")
    by_fp = scratch.keep(folded.groupBy("fp").agg(F.min("key").alias("one"), F.max("key").alias("last")), "fingerprints")
    same = by_fp.filter("one <> last").select("one", "last")
    close = links(by_fp).join(by_fp.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b").select("x", "y")
    close = scratch.keep(same.unionAll(close).toDF("a", "b"), "close")
    keys = shared.select("key").unionAll(close.select(F.explode(F.array("a", "b")))).distinct()
    sets = scratch.keep(shingle_sets(docs, folded, keys), "shingles")
    nodes = scratch.keep(measured(sets), "sizes")
    placed = scratch.keep(shared.join(nodes, "key"), "placed")

    centre = F.max(F.struct((F.col("core") / F.col("size")).alias("share"), "size", "key", "core")).alias("c")
    centres = placed.groupBy("band").agg(centre).select("band", F.col("c.key").alias("a"), F.col("c.size").alias("size_a"), F.col("c.core").alias("core_a"))
    stars = placed.join(centres, "band").filter(F.col("key") != F.col("a")).filter(room(F.least("core", "core_a"), F.col("size") + F.col("size_a")))
    first = scratch.keep(stars.select("a", F.col("key").alias("b")).unionAll(close).distinct(), "candidates")
    found = scratch.keep(verified(sets, first, scratch).toDF("u", "v"), "near")

    roots = star_components(found)
    rooted = scratch.keep(nodes.join(roots, F.col("key") == F.col("node"), "left").select("key", "size", "core", F.coalesce("root", "key").alias("root")), "rooted")
    placed = shared.join(rooted, "key")
    mixed = placed.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("size").alias("low")).filter("r <> s").select("band", "low")
    apart = placed.join(mixed, "band").filter(room(F.col("core"), F.col("size") + F.col("low"))).select("key", "size", "root").distinct()
    rest = by_prefix(sets, scratch.keep(apart, "apart"), scratch)
    done = first.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    rest = scratch.keep(rest.join(done, ["a", "b"], "left_anti"), "candidates")
    return found.unionAll(verified(sets, rest, scratch).toDF("u", "v"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The columns of docs, one row for each class: that of the smallest doc_id."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(signatures(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    folded = scratch.keep(rows.groupBy("key").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("fp", "bands")]), "signatures-distinct")
    roots = star_components(near_links(docs, folded, scratch))
    classes = folded.join(roots, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    no_id = lambda c: [F.coalesce(c, F.lit(0)), c.isNull()]
    keepers = classes.select(*no_id(F.col("first.doc_id")), "first.text_key").toDF("_sl_keep", "_sl_keep_null", "_sl_keep_key")
    keepers = kept_table(keepers, "keepers")
    scratch.clear()
    given = no_id(F.col("doc_id").cast("long"))
    keyed = docs.withColumns({"_sl_id": given[0], "_sl_null": given[1], "_sl_key": F.xxhash64(F.col("text").cast("string"))})
    on = [F.col(f"_sl_{a}") == F.col(f"_sl_keep{b}") for a, b in (("id", ""), ("null", "_null"), ("key", "_key"))]
    # Keys of the join and of the window are the same, so that texts are shuffled once.
    one = Window.partitionBy("_sl_id", "_sl_null", "_sl_key").orderBy(F.lit(0))
    return keyed.join(keepers, on).withColumn("_sl_copy", F.row_number().over(one)).filter("_sl_copy = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
