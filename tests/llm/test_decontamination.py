"""Every placement of the substitutions that the similarity allows."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from spanloom.llm import decontamination as dc
from tests.llm.conftest import SCHEMA, prose


def found(item: list[str], texts: list[str]) -> set[int]:
    block = dc.Block([(1, " ".join(item))])
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *(len(t) for t in raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return {r[0] for r in dc.overlaps(block, data, offsets, dc.MIN_TOKENS, dc.SIMILARITY, dc.PENALTY)}


@pytest.mark.parametrize("n", [*range(dc.MIN_ITEM, 20), 20, 24, 30, 45, 59])
def test_every_allowed_placement_is_found(n):
    rng = random.Random(n)
    item = [f"i{k}" for k in range(n)]
    most = max(e for e in range(n) if n - e >= dc.SIMILARITY * n)
    if n < 20:
        places = list(itertools.combinations(range(n), most))
    else:
        places = [rng.sample(range(n), most) for _ in range(300)] + [[k for k in range(n) if k % 5 == r][:most] for r in range(5)]
    texts = []
    for at in places:
        w = [f"sub{k}" if k in at else x for k, x in enumerate(item)]
        texts.append(f"{prose(rng, 5)} {' '.join(w)} {prose(rng, 5)}")
    assert found(item, texts) == set(range(len(texts)))


def test_one_substitution_too_many_is_no_overlap():
    item = [f"i{k}" for k in range(10)]
    texts = [" ".join("sub" if k in at else x for k, x in enumerate(item)) for at in itertools.combinations(range(10), 3)]
    assert found(item, texts) == set()


def test_rows_go_by_their_text(spark):
    rng = random.Random(4)
    item, clean = prose(rng, 20), prose(rng, 50)
    rows = [(None, item), (None, clean), (1, item), (1, clean), (2, None), (3, f"{clean} {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    left = dc.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    key = lambda r: str(r)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted([(None, clean), (1, clean), (2, None)], key=key)


def slow_hits(block: dc.Block, items: list[list[str]], text: list[str]) -> set[tuple[int, int]]:
    """(item, place) of every window of a mask, a run or a part that text and item share."""
    out = set()
    for k, item in enumerate(items):
        cuts = {(a, z - a) for a, z in dc.parts(len(item), dc.SIMILARITY)}
        for m, mask in enumerate(block.masks):
            for q in range(len(item) - len(mask) + 1):
                if m >= len(dc.MASKS) and len(mask) != dc.RUN and (q, len(mask)) not in cuts:
                    continue
                for p in range(len(text) - len(mask) + 1):
                    if all(text[p + i] == item[q + i] for i, x in enumerate(mask) if x == "1"):
                        out.add((k, p - q))
    return out


def test_hits_of_repeated_words():
    rng = random.Random(5)
    for _ in range(60):
        items = [rng.choices("ab", k=rng.randrange(5, 30)) if rng.random() < 0.5 else ["a"] * rng.randrange(5, 40) for _ in range(3)]
        text = [x for _ in range(rng.randrange(1, 5)) for x in (["a"] * rng.randrange(1, 40) if rng.random() < 0.5 else rng.choices("ab", k=rng.randrange(20)))]
        block = dc.Block([(k, " ".join(x)) for k, x in enumerate(items)])
        raw = " ".join(text).encode()
        tok = dc.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert {(k, p) for _, k, p in block.hits(tok).tolist()} == slow_hits(block, items, text)


@pytest.mark.parametrize("words", ["word ", "a b "])
def test_a_megabyte_of_one_word(words):
    item = (words * 200).split()[:200]
    # Two words in turn make no runs, and so more pairs.
    text = (words * ((1_000_000 if words == "word " else 200_000) // len(words))).strip()
    began = time.process_time()
    assert found(item, [text]) == {0}
    assert time.process_time() - began < 120
