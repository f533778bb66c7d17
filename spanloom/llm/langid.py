"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one mark, and the n-grams of one to three
characters are hashed to `DIMENSIONS` places. A feature is the share of an n-gram in the text's n-grams
times its inverse document frequency. The model is trained by follow-the-regularised-leader
(per-coordinate steps, L1 and L2 penalties, so that most weights are exactly zero) and calibrated by one
temperature that minimises the log loss on documents held back from it.

Labelled rows are those whose crc32(doc_id) mod 5 is not 0 and whose lang is not null. Document
frequencies count all of them; the weights are fitted on at most `PER_LANGUAGE` documents of each
language, those with the smallest hashes of doc_id and text, of a fifth of which `CUT` characters each serve for the calibration.
A prediction uses the whole text and nothing else.

Scale. Three passes over the texts in numpy, none of which shuffles them: frequencies (summed by
place, at most DIMENSIONS rows for each task), the bounded sample (a filter by the counts of the
languages leaves about four times as many rows to put in order), and prediction. The model is a table of DIMENSIONS times languages.

Results for odd input: a null text or one without letters is `und` with score 0; a null lang
is not learned from; a null doc_id counts as held out; with one language alone it is predicted with
score 1, with none everything is `und`; more than `MOST_LANGUAGES` languages are an error; repeated rows count each; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import doc_texts, kept_table, slices, utf8

DIMENSIONS = 1 << 16
PER_LANGUAGE, EPOCHS = 600, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
SCALE = 100.0
#: Bound on the languages, and so on the sample and the model.
MOST_LANGUAGES = 512
#: Characters of a held-back document that calibrate; whole ones are too easy to say how sure the model may be.
CUT = 24
MARK = 32


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or MARK if it is no letter."""
    table = np.full(0x110000, MARK, np.uint32)
    for c in [*range(0x3400), *range(0x3400, 0x40000)]:
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, bounds of each text in them, whether each text has a letter) of the n-grams of UTF-8 texts."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    c = letter_table()[np.minimum(points, 0x10FFFF)]
    first = np.zeros(len(c) + 1, bool)
    first[starts] = True
    first = first[:-1]
    letter = c != MARK
    # A mark that follows a mark, or opens a text, is dropped.
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]
    bounds = np.concatenate([[0], np.cumsum(keep)])[starts]
    c = c[keep].astype(np.uint64)
    opens = np.zeros(len(c) + 1, bool)
    opens[bounds] = True
    opens, mark = opens[:-1], np.array([MARK], np.uint64)
    one_back = np.where(opens, mark, np.concatenate([mark, c])[:-1])
    two_back = np.where(opens, mark, np.concatenate([mark, one_back])[:-1])
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = (one ^ one_back) * np.uint64(0xBF58476D1CE4E5B9)
    three = (two ^ two_back) * np.uint64(0x94D049BB133111EB)
    out = (np.stack([one, two, three], axis=1) >> np.uint64(48)).astype(np.int64)
    letters = np.concatenate([[0], np.cumsum(letter)])[starts]
    return out.reshape(-1), bounds * 3, np.diff(letters) > 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the rows to learn from."""
    return _texts(docs).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of those that have each place, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int8), 0
        for b in batches:
            every, at = utf8(b.column(0))
            for top, stop in slices(at):
                places, bounds, _ = grams(every[at[top] : at[stop]], at[top : stop + 1] - at[top])
                for a, z in zip(bounds, bounds[1:], strict=False):
                    own = places[a:z]
                    if z - a < DIMENSIONS // 16:
                        total[np.unique(own)] += 1
                    else:
                        seen[own] = 1
                        total += seen
                        seen[own] = 0
                n += stop - top
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(total[some], n))})

    table = rows.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    places, counts = table.column(0).to_numpy(), table.column(1).to_numpy()
    df = np.zeros(DIMENSIONS, np.int64)
    df[places[places >= 0]] = counts[places >= 0]
    return int(counts[places < 0].sum()), df


def features(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    places, _, _ = grams(data, np.array([0, len(data)]))
    index, count = np.unique(places, return_counts=True)
    return index, (count * (SCALE / max(1, len(places)))) * idf[index]


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (DIMENSIONS, classes) by FTRL-proximal with elastic-net penalties; the order is fixed."""
    z, n = (np.zeros((DIMENSIONS, classes)) for _ in range(2))

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            index, x = samples[k]
            w = weights(index)
            p = softmax((x @ w)[None, :])[0]
            p[labels[k]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    return weights(slice(None))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 0.5 to 20 with the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, r = np.log(0.5), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, float]:
    """(languages, table of idf times weight by place and language, temperature)."""
    rows = labelled(docs)
    n, df = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1.0) * (df > 0)
    drawn = rows.select("lang", "doc_id", F.xxhash64("text").alias("key"), F.xxhash64("doc_id", "text", F.lit(9)).alias("draw"))
    # Draws are uniform: the smallest `per_language` lie within four times their share, and only those are put in order.
    sizes = kept_table(drawn.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count(F.lit(1))).alias("share")), "languages")
    if (languages := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages are more than {MOST_LANGUAGES}; the model has a column for each")
    near = F.col("draw") / F.lit(2.0**64) + 0.5 < F.col("share")
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "key")
    chosen = kept_table(drawn.join(sizes, "lang").filter(near).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language), "sample")
    # Repeated rows draw one number each; only their first counts.
    chosen = chosen.groupBy("doc_id", "key", "lang").agg(F.min("k").alias("k"))
    texts = rows.withColumn("key", F.xxhash64("text")).join(chosen, ["doc_id", "key", "lang"]).dropDuplicates(["k", "lang"])

    def part(text: str, k: int) -> str:
        """The whole text; of one that calibrates, some characters from its middle."""
        return text if k % 5 else text[len(text) // 2 :][:CUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(part(t.as_py(), k).encode(), idf) for t, k in zip(b.column(2), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], ["lang", "k", "place", "x"])

    table = texts.select("lang", "k", "text").mapInArrow(run, "lang string, k int, place array<int>, x array<float>").toArrow().sort_by([("lang", "ascending"), ("k", "ascending")])
    langs = table.column("lang").to_pylist()
    classes = sorted(set(langs))
    if not classes:
        return [], np.zeros((DIMENSIONS, 1), np.float32), 1.0
    labels = np.array([classes.index(x) for x in langs])
    samples = [(i.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(np.float64)) for i, x in zip(table.column("place"), table.column("x"), strict=True)]
    calibrate = np.array(table.column("k").to_pylist()) % 5 == 0
    w = train([s for s, c in zip(samples, calibrate, strict=True) if not c], labels[~calibrate], len(classes))
    scores = np.array([x @ w[i] for (i, x), c in zip(samples, calibrate, strict=True) if c]).reshape(-1, len(classes))
    return classes, (idf[:, None] * w).astype(np.float32), temperature(scores, labels[calibrate])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    classes, table, heat = model
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            every, at = utf8(b.column(2))
            langs, scores = [], []
            for top, stop in slices(at):
                places, bounds, known = grams(every[at[top] : at[stop]], at[top : stop + 1] - at[top])
                sizes = np.diff(bounds)
                sums = np.zeros((stop - top, weights.shape[1]))
                full = np.flatnonzero(sizes)
                if len(full):
                    for c in range(weights.shape[1]):
                        sums[full, c] = np.add.reduceat(weights[:, c][places], bounds[:-1][full], dtype=np.float64)
                p = softmax(sums * (SCALE / np.maximum(sizes, 1))[:, None] / heat)
                best = p.argmax(axis=1)
                known = known & bool(classes)
                langs += [classes[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                scores.append(np.where(known, p.max(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["doc_id", "held_out", "lang_pred", "score"])

    narrow = doc_texts(docs)
    return narrow.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, fit(docs, per_language))
