"""Token counts that follow edits.

A byte-level BPE tokenizer splits a text into pre-tokens by a pattern and encodes each alone, so a
text's count is the sum over its pre-tokens. A pre-token always starts at white space that
follows another character, whatever else the text holds. A document's tree cuts the text at such places into
leaves, runs of whole pre-tokens of about `LEAF` characters; inner nodes hold the sums of characters
and tokens below them. An edit is found by descent along the sums of characters. Whether a place is a cut
depends on the two characters around it, so the text between the last cut before the edit and the
first one after it whose two characters are untouched is all that is encoded again, and the
sums above its leaves are updated.

Scale. Documents are independent: trees are built, edited and read map-side, with memory for
one text at a time. Stored trees (tree_table) are two numbers per leaf. A join by doc_id brings edits to their
trees.

Results for odd input: a null text counts as empty, with no tokens; edits with a null or unknown doc_id match
no document; edits of a document must not overlap, and are given in code points of its old text; repeated rows count
each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import doc_texts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the pattern that splits texts for the ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 256
_encoders: dict[bytes, Callable[[str], int]] = {}


def counter(ranks: bytes) -> Callable[[str], int]:
    """Counts the tokens of a text; made once for each worker and tokenizer."""
    if ranks not in _encoders:
        import tiktoken

        pairs = dict(line.split() for line in ranks.splitlines() if line)
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs.items()}, special_tokens={})
        _encoders[ranks] = lambda text: len(encoding.encode_ordinary(text))
    return _encoders[ranks]


def is_cut(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Ends of the leaves: the first cut at least `leaf` characters on, again and again, and the end."""
    out, at = [], 0
    while at + leaf < len(text):
        places = [p for p in (text.find(" ", at + leaf), text.find("\n", at + leaf, at + 4 * leaf)) if p >= 0]
        at = min(places, default=len(text))
        while at < len(text) and not is_cut(text, at):
            at += 1
        if at < len(text):
            out.append(at)
    return [*out, len(text)] if text else []


class Tree:
    """A document's text and, in heap order, the sums of (characters, tokens) over its leaves."""

    def __init__(self, text: str, leaves: list[tuple[int, int]]):
        self.text, self.recounted = text, 0
        self._build(leaves)

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.size = len(leaves)
        self.width = 1 << max(0, self.size - 1).bit_length()
        self.nodes = [(0, 0)] * self.width + list(leaves) + [(0, 0)] * (self.width - self.size)
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        (a, b), (c, d) = self.nodes[2 * k], self.nodes[2 * k + 1]
        self.nodes[k] = (a + c, b + d)

    @property
    def tokens(self) -> int:
        return self.nodes[1][1]

    @property
    def leaves(self) -> list[tuple[int, int]]:
        return self.nodes[self.width : self.width + self.size]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(index, start) of the leaf that holds a place of the text; the last one for its end."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place >= start + self.nodes[k][0] and self.nodes[k + 1][0]:
                start += self.nodes[k][0]
                k += 1
        return k - self.width, start

    def replace(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        """Put leaves in place of those from first to last; as many of them, then only the sums above change."""
        if len(leaves) != last - first:
            old = self.leaves
            self._build(old[:first] + leaves + old[last:])
            return
        low, high = first + self.width, last + self.width
        self.nodes[low:high] = leaves
        high -= 1
        while low > 1 and low <= high:
            low, high = low >> 1, high >> 1
            for k in range(low, high + 1):
                self._sum(k)


def counted(text: str, count: Callable[[str], int], leaf: int = LEAF) -> list[tuple[int, int]]:
    """(characters, tokens) of each leaf."""
    ends = cuts(text, leaf)
    return [(b - a, count(text[a:b])) for a, b in zip([0, *ends], ends, strict=False)]


def build(text: str | None, ranks: bytes) -> Tree:
    return Tree(text or "", counted(text or "", counter(ranks)))


def edit(tree: Tree, start: int, end: int, new: str, ranks: bytes) -> None:
    """Replace text[start:end] by new; adds the characters that were encoded again to tree.recounted."""
    old = tree.text
    tree.text = old[:start] + new + old[end:]
    first, begin = tree.leaf_at(start) if tree.size else (0, 0)
    while first > 0 and begin >= start:  # both characters of the cut must lie before the edit
        first -= 1
        begin -= tree.nodes[tree.width + first][0]
    last, stop = tree.leaf_at(end) if tree.size else (0, 0)
    while last < tree.size and stop <= end:  # and after it
        stop += tree.nodes[tree.width + last][0]
        last += 1
    stop = len(old) if last == tree.size else stop
    region = tree.text[begin : stop + len(tree.text) - len(old)]
    span = last - first
    # As many leaves as before, if they get neither tiny nor large.
    leaves = counted(region, counter(ranks), LEAF if not span or not LEAF <= len(region) / span <= 4 * LEAF else max(1, len(region) // span))
    tree.recounted += len(region)
    tree.replace(first, last, leaves)


def apply_edits(tree: Tree, edits: list[tuple[int, int, str]], ranks: bytes) -> Tree:
    """Edits (start, end, new) in places of the old text; from the last to the first, so that places hold."""
    for start, end, new in sorted(edits, reverse=True):
        edit(tree, start, end, new, ranks)
    return tree


def repeated_lines(text: str) -> list[tuple[int, int, str]]:
    """Edits that delete each line, with the line feed before it, that equals an earlier one of the text."""
    seen, out, at = set(), [], 0
    for line in text.split("\n"):
        if line in seen:
            if out and out[-1][1] == at - 1:
                out[-1] = (out[-1][0], at + len(line), "")
            else:
                out.append((at - 1, at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    return out


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_LEAVES = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
_TREE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("leaves", _LEAVES)])
_DDL = "doc_id long, text string, n_tokens long, leaves array<struct<chars:int,tokens:int>>"


def _row(doc_id: int | None, text: str | None, tree: Tree) -> dict:
    return {"doc_id": doc_id, "text": text, "n_tokens": tree.tokens, "leaves": [{"chars": a, "tokens": b} for a, b in tree.leaves]}


def tree_table(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text, n_tokens, leaves): trees to store."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([_row(doc_id, text, build(text, shared.value))], _TREE)

    return doc_texts(docs).mapInArrow(run, _DDL)


def edited_table(trees: DataFrame, edits: DataFrame, path: str = RANKS) -> DataFrame:
    """trees after edits (doc_id, start, end, new), and n_recounted: the characters that were encoded again."""
    shared = trees.sparkSession.sparkContext.broadcast(read_ranks(path))
    own = edits.groupBy(F.col("doc_id").alias("_sl_id")).agg(F.collect_list(F.struct("start", "end", "new")).alias("edits"))
    joined = trees.select("doc_id", "text", "leaves").join(own, F.col("doc_id") == F.col("_sl_id"), "left").drop("_sl_id")
    schema = _TREE.append(pa.field("n_recounted", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tree = Tree(row["text"] or "", [(x["chars"], x["tokens"]) for x in row["leaves"]])
                apply_edits(tree, [(e["start"], e["end"], e["new"]) for e in row["edits"] or ()], shared.value)
                yield pa.RecordBatch.from_pylist([_row(row["doc_id"], tree.text if row["edits"] else row["text"], tree) | {"n_recounted": tree.recounted}], schema)

    return joined.mapInArrow(run, _DDL + ", n_recounted long")


def counts(docs: DataFrame, edits_of: Callable[[str], list[tuple[int, int, str]]] = repeated_lines, path: str = RANKS) -> DataFrame:
    """Counts before and after the edits that `edits_of` makes of each text.

    doc_id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after, n_recounted (characters encoded again).
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    names = ("n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_recounted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, ...]] = []
            for text in b.column(1).to_pylist():
                tree = build(text, shared.value)
                (chars, tokens), edits = tree.nodes[1], edits_of(tree.text)
                apply_edits(tree, edits, shared.value)
                out.append((chars, tokens, len(edits), *tree.nodes[1], tree.recounted))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])

    return doc_texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))
