from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ("kept", "n_words", "h1", "host", "fp", "anchor", "size", "target", "spans", "score", "node", "root", "edits", "dropped", "rank", "text_key", "url_host", "label", "k", "n", "start", "end")


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    base = prose(rng, 90)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t \n", "en", "a", 5),
        (4, base, "en", "a", len(base)),
        (5, base, "en", None, len(base)),
        (5, base, "en", None, len(base)),
        (6, base + " tail", "de", "b", None),
        (None, base, "en", "b", 3),
        (None, None, None, None, None),
        (7, prose(rng, 40_000), "en", "a", 1),
        (8, "word " * 200, "en", "c", 1),
        (9, "Ünïcode ß 漢字 " * 30 + "\n" + "A line that is repeated in many documents here\n" + prose(rng, 60), "fr", "c", 1),
        (10, "a line that is REPEATED in many documents here \nother\n\n" + prose(rng, 60), "fr", "c", 1),
        (11, "\tA line that is repeated in many documents here\n" + prose(rng, 70), "fr", "é", 1),
        (12, "x" * 30_000, "en", "d", 1),
        (13, "one two", "en", "d", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_dir(spark, odd, empty, tmp_path_factory):
    """Folders of tables: odd ones, and empty ones."""
    out = {}
    for name, docs in (("odd", odd), ("empty", empty)):
        path = tmp_path_factory.mktemp(name)
        docs.write.parquet(f"{path}/documents.parquet")
        bench = [(1, None), (2, ""), (3, "one two"), (None, "x y z")] if name == "odd" else []
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        pages = [(1, None, None), (2, "no scheme", "<a href='http://x.net/a'>"), (None, "http://A.Example.NET/en/x?y", None), (4, "http://u.net", "<a href=//b.com>"), (4, "http://u.net", "<a href=//b.com>")] if name == "odd" else []
        spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
        out[name] = str(path)
    return out
