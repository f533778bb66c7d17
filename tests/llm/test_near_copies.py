"""The pipeline's near copies against all pairs in plain Python."""

from __future__ import annotations

import random

from spanloom.llm.near_copies import drop_near_copies
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_simhash import classes


def slow_set(text: str | None) -> frozenset[str]:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow_left(texts: list[str | None]) -> int:
    sets = [slow_set(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return len(set(classes(range(len(sets)), near).values()))


def near_texts() -> list[str]:
    """Groups of copies with one to eight words of theirs replaced, similarities on both sides of 0.8; a chain."""
    rng = random.Random(21)
    texts = []
    for k in range(60):
        base = prose(rng, rng.randrange(50, 300)).split()
        for _ in range(rng.randrange(2, 6)):
            w = list(base)
            for at in rng.sample(range(len(w)), max(1, len(w) * (k % 8) // 180)):
                w[at] = f"sub{rng.randrange(9999)}"
            texts.append(" ".join(w))
    long = prose(rng, 400).split()
    texts += [" ".join(long[k * 15 : k * 15 + 200]) for k in range(12)]
    return texts + [prose(rng, 120) for _ in range(60)]


def test_every_pair_of_the_similarity_is_found(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    left = [r.doc_id for r in drop_near_copies(docs).collect()]
    sets = [slow_set(t) for t in texts]
    roots = classes(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    assert sorted(left) == sorted(set(roots.values()))


def test_one_large_group(spark):
    """Copies with none to ten words replaced, some alike: most are near the base, few are near each other."""
    rng = random.Random(22)
    base = prose(rng, 150).split()
    texts = []
    for k in range(250):
        w = list(base)
        for at in rng.sample(range(len(w)), k % 11):
            w[at] = f"sub{rng.randrange(9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    sets = [slow_set(t) for t in texts]
    roots = classes(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    assert 1 < len(set(roots.values())) < 200
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == sorted(set(roots.values()))


def test_a_row_without_id_is_not_kept_before_others(spark):
    text = prose(random.Random(1), 80)
    docs = spark.createDataFrame([(i, text, "en", "s", 0) for i in (None, 5, 4)], SCHEMA)
    assert [r.doc_id for r in drop_near_copies(docs).collect()] == [4]


def test_odd_rows(spark, odd, odd_rows, empty):
    left = drop_near_copies(odd)
    assert left.columns == odd.columns and left.count() == slow_left([r[1] for r in odd_rows])
    assert drop_near_copies(empty).count() == 0
