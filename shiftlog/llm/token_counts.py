"""Token counts that follow edits.

Every document keeps a segment tree over its pre-tokens: a leaf is a run of
text between two safe boundaries (see ``bpe.runs``) and holds its characters
and tokens; inner nodes hold sums.  An edit finds the leaves it touches, plus
the boundary context of two characters on either side, by descending the
character sums; only these leaves are encoded again and only the sums above
them change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.llm.bpe import encoder, read_file, runs
from shiftlog.llm.common import extended, rows_of, text_of

#: Runs in a leaf when a tree is built.
LEAF_RUNS = 32
#: Characters that decide a boundary lie at most this far from it.
CONTEXT = 2

EDIT = "struct<start:int,length:int,insert:string>"
TREE = "struct<chars:array<int>,tokens:array<int>>"


class Tree:
    """Sums of characters and tokens in heap order: node ``i`` has the sums
    of nodes ``2i`` and ``2i + 1``; leaves begin at ``len / 2``."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.half = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, text: str, count) -> Tree:
        pieces = runs(text) if text else []
        leaves = ["".join(pieces[i:i + LEAF_RUNS]) for i in range(0, len(pieces), LEAF_RUNS)]
        half = 1
        while half < len(leaves):
            half *= 2
        pad = [0] * (half - len(leaves))
        tree = cls([0] * half + [len(x) for x in leaves] + pad,
                   [0] * half + [count(x) for x in leaves] + pad)
        for i in range(half - 1, 0, -1):
            for sums in (tree.chars, tree.tokens):
                sums[i] = sums[2 * i] + sums[2 * i + 1]
        return tree

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last leaf with text
        for a place at the end) and its first character."""
        node, begin = 1, 0
        while node < self.half:
            left = self.chars[2 * node]
            go = place - begin >= left and self.chars[2 * node + 1] > 0
            node, begin = 2 * node + go, begin + go * left
        return node, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        more, of = chars - self.chars[leaf], tokens - self.tokens[leaf]
        while leaf:
            self.chars[leaf] += more
            self.tokens[leaf] += of
            leaf //= 2

    def edit(self, text: str, start: int, length: int, insert: str, count) -> tuple[str, int]:
        """The text after an edit and the characters that were encoded."""
        start = min(max(start, 0), len(text))
        end = min(start + max(length, 0), len(text))
        first, a = self.find(max(start - CONTEXT, 0))
        last, b = self.find(min(end + CONTEXT, len(text)))
        b += self.chars[last]
        region = text[a:start] + insert + text[end:b]
        for leaf in range(first + 1, last + 1):
            if self.chars[leaf]:
                self.put(leaf, 0, 0)
        self.put(first, len(region), count(region))
        return text[:start] + insert + text[end:], len(region)


def build_trees(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``docs`` with column ``tree``: the segment tree of each whole text.

    Null text is the empty text.  All other columns pass, so a column named
    ``tree`` is replaced; rows are independent (no shuffle), so repeated or
    null ids keep one result per row, and an empty table gives no rows.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_file(rank_path))
    docs = docs.drop("tree").withColumn("text", text_of())
    kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(content.value, pattern).count
        for batch in batches:
            trees = [Tree.build(t, count) for t in rows_of(batch, "text")[0]]
            column = pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column],
                                             names=[*batch.schema.names, "tree"])

    return docs.mapInArrow(build, extended(docs, tree=TREE))


def apply_edits(docs: DataFrame, rank_path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """``docs`` (with ``text``, ``tree`` and an array of edits) with
    ``edited_text``, ``edited_tree`` and ``n_reencoded``, the characters that
    were encoded again.

    Edits apply in order, each to the text its predecessor left; places
    outside the text are moved to its nearest end.  Null edits, and null
    inserts, are none.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_file(rank_path))
    kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(content.value, pattern).count
        for batch in batches:
            texts, trees, again = [], [], []
            for text, tree, todo in zip(*rows_of(batch, "text", "tree", edits)):
                tree, n = Tree(tree["chars"], tree["tokens"]), 0
                for e in todo or []:
                    text, cost = tree.edit(text, e["start"] or 0, e["length"] or 0,
                                           e["insert"] or "", count)
                    n += cost
                texts.append(text)
                trees.append({"chars": tree.chars, "tokens": tree.tokens})
                again.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array(trees, kind),
                 pa.array(again, pa.int64())],
                names=[*batch.schema.names, "edited_text", "edited_tree", "n_reencoded"])

    return docs.mapInArrow(apply, extended(docs, edited_text="string", edited_tree=TREE,
                                           n_reencoded="bigint"))


def n_tokens(tree: str):
    """Tokens of a whole document: the sum in its tree's root (node 1)."""
    return F.element_at(F.col(tree)["tokens"], 2)
