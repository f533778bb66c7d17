from __future__ import annotations

import random
import struct

import xxhash

from spanloom.llm import simhash
from spanloom.llm.components import star_components


def slow_fingerprint(text: str | None) -> int:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints(odd_rows):
    for _, text, *_ in odd_rows:
        assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_links_find_every_pair(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            y = x
            for b in rng.sample(range(64), rng.randrange(5)):
                y ^= 1 << b
            fps.add(y)
    fps |= {0, (1 << 64) - 1, 1 << 63, 3 << 62, 1}
    signed = [struct.unpack("<q", struct.pack("<Q", x))[0] for x in fps]
    for threshold in (0, 1, 2, 3):
        expected = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= threshold}
        found = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), threshold).collect()]
        assert len(found) == len(set(found)) and set(found) == expected, threshold


def test_components(spark):
    rng = random.Random(2)
    pairs = [(a, a + 1) for a in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5, 2000 + k) for k in range(80)] + [(7, 7)]
    found = {r.node: r.root for r in star_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    expected = classes({x for p in pairs for x in p}, pairs)
    assert found == expected


def test_classes(spark, odd, odd_rows):
    found = simhash.simhash_classes(odd).collect()
    fps = [slow_fingerprint(r[1]) for r in odd_rows]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    roots = classes(range(len(fps)), near)
    expected = []
    for i, r in enumerate(odd_rows):
        ids = [odd_rows[j][0] for j in range(len(fps)) if roots[j] == roots[i] and odd_rows[j][0] is not None]
        expected.append((r[0], fps[i], min(ids, default=None)))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found), key=key) == sorted(expected, key=key)


def test_one_of_each_class_stays(spark, odd, odd_rows):
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    fps = [slow_fingerprint(r[1]) for r in odd_rows]
    assert left.count() == len(set(classes(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]).values()))
