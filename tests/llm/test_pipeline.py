"""The pipeline's rows against a plain version of each stage, one after the other."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from spanloom.llm.queries import oracle_sql
from tests.duck import connect
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_near_copies import slow_set
from tests.llm.test_simhash import classes
from tests.llm.test_texts import slow_lines

NAMES = ("doc_id", "text", "lang", "source", "n_chars")
TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())


def corpus(rng: random.Random, items: list[str]) -> list[tuple]:
    line = "This line of more than twenty characters is on every page of the site"
    texts = [prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    texts += [f"{prose(rng, 70)}\n{line}\n{prose(rng, 30)}" for _ in range(12)]
    base = [prose(rng, 150).split() for _ in range(6)]
    for w in base:
        for k in range(6):
            edited = list(w)
            for at in rng.sample(range(150), k):
                edited[at] = f"new{rng.randrange(99)}"
            texts.append(" ".join(edited))
    texts += [texts[0]] * 5 + [texts[1].upper()]
    texts += [f"{prose(rng, 60)} {i} {prose(rng, 60)}" for i in items[:8]]
    hurt = items[8].split()
    hurt[5] = "changed"
    texts += [f"{prose(rng, 60)} {' '.join(hurt)}", None, "", "too short", "word " * 300, f"{prose(rng, 90)} {items[0].split()[0]}"]
    rows = [(k, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for k, t in enumerate(texts)]
    # A host that mostly fails takes its good documents along.
    rows += [(1000 + k, "x y z", "en", "bad", 5) for k in range(40)] + [(1040 + k, prose(rng, 80), "en", "bad", 5) for k in range(3)]
    rows += [(None, prose(rng, 90), "fr", "a", 1)]
    rng.shuffle(rows)
    return rows


def run_sql(rows: list[tuple], folder, name: str) -> list[tuple]:
    folder.mkdir()
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES), folder / "documents.parquet")
    return connect(str(folder)).sql(oracle_sql()[name]).fetchall()


def test_rows_like_a_plain_version(spark, tmp_path):
    rng = random.Random(41)
    items = [prose(rng, 40) for _ in range(9)]
    rows = corpus(rng, items)
    where = tmp_path / "in"
    where.mkdir()
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    found = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.run(spark, str(where)).collect())

    kept = {r[0] for r in run_sql(rows, tmp_path / "q", "op2_quality_rules") if r[-1]}
    left = [r for r in rows if r[0] in kept]
    assert None in kept and not kept & {*range(1000, 1043)} and len(left) < len(rows) - 40
    texts = {k: t for k, _, _, t in slow_lines(left)}
    left = [(i, texts[-1 if i is None else i], *rest) for i, _, *rest in left]
    sets = [slow_set(r[1]) for r in left]
    roots = classes(range(len(left)), [(a, b) for a in range(len(left)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    best: dict[int, int] = {}
    order = lambda k: (left[k][0] is None, left[k][0] or 0)
    for k, root in roots.items():
        best[root] = min(best.get(root, k), k, key=order)
    n = len(left)
    left = [left[k] for k in sorted(best.values())]
    assert len(left) < n - 20
    # Passages that are in whole, or but for one word.
    tainted = [r for r in left if any(sum(a == b for a, b in zip(r[1].split()[at:], i.split(), strict=False)) >= 32 for i in items for at in range(len(r[1].split())))]
    assert len(tainted) == 9
    left = [r for r in left if r not in tainted]
    taken = run_sql(left, tmp_path / "m", "op4_source_mixing")
    by_id = {r[0]: r for r in left}
    expected = Counter()
    for i, size, _, _, words in taken:
        if words:
            expected[i, by_id[i][1], by_id[i][3]] = words // size
    assert found == expected
