"""Edit-aware token counts: a segment tree over each document's pre-token runs.

A leaf is a run of about LEAF characters that ends with white space, where the tokenizer never joins pieces; its count is the ids of its text.
Inner nodes hold the characters and ids below them. An edit takes the leaves it touches, and those after them as long as the text so far
doesn't end with white space, encodes that region afresh and updates the sums on the way up. What the edit doesn't touch isn't encoded again.
Trees are kept as a column of bytes, so the edits of a later job start from them and encode no text as a whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.bpe import default_path, encoder
from spindrel.llm.shingles import slices

#: Characters that a leaf should hold; a longer run without white space is one leaf.
LEAF = 64
_BLANK = " \t\n\x0b\x0c\r"


def runs(text: str) -> list[str]:
    """text in parts of about LEAF characters, each but the last ending with white space."""
    out, at = [], 0
    while at < len(text):
        to = at + LEAF
        while to < len(text) and text[to - 1] not in _BLANK:
            to += 1
        out.append(text[at:to])
        at = to
    return out


class CountTree:
    """Token counts of one text under edits; ``encoded`` sums the characters that were encoded so far."""

    def __init__(self, text: str, count) -> None:
        self.count, self.encoded = count, 0
        self._build([self._leaf(r) for r in runs(text)])

    def _leaf(self, text: str) -> tuple[str, int]:
        self.encoded += len(text)
        return text, self.count(text)

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.texts = [t for t, _ in leaves] + [""] * (self.width - len(leaves))
        self.chars = [0] * self.width + [len(t) for t in self.texts]
        self.tokens = [0] * self.width + [n for _, n in leaves] + [0] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def dump(self) -> bytes:
        """How many leaves, the code points and ids of each, and the text."""
        leaves = [(t, n) for t, n in zip(self.texts, self.tokens[self.width :]) if t]
        return struct.pack("<I", len(leaves)) + np.array([(len(t), n) for t, n in leaves], "<u4").tobytes() + self.text().encode("utf-8", "surrogatepass")

    @classmethod
    def load(cls, raw: bytes, count) -> "CountTree":
        """The tree of dump, without any encoding."""
        (n,) = struct.unpack_from("<I", raw)
        text, at, leaves = raw[4 + 8 * n :].decode("utf-8", "surrogatepass"), 0, []
        for chars, tokens in np.frombuffer(raw, "<u4", 2 * n, 4).reshape(n, 2).tolist():
            leaves.append((text[at : at + chars], tokens))
            at += chars
        tree = cls("", count)
        tree._build(leaves)
        return tree

    @property
    def total(self) -> int:
        return self.tokens[1]

    def __len__(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and the characters before that leaf; the last leaf with text beyond the end."""
        i, before = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while i < self.width:
            i *= 2
            if at - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replaces ``cut`` characters from ``at`` by ``put``; both are clipped to the text."""
        at = max(0, min(at, len(self)))
        to = max(at, min(at + cut, len(self)))
        i, before = self._find(at)
        j, after = self._find(max(at, to - 1))
        region = "".join(self.texts[i : j + 1])
        region = region[: at - before] + put + region[to - before :]
        # Boundary context: text before a leaf ends with white space, so the region can only touch what comes after it.
        while j + 1 < self.width and region and region[-1] not in _BLANK:
            j += 1
            region += self.texts[j]
        parts = [self._leaf(r) for r in runs(region)]
        room = j - i + 1
        if len(parts) > room:  # more leaves than the region has places: the tree is laid out afresh, known counts stay
            leaves = [(t, n) for t, n in zip(self.texts, self.tokens[self.width :])]
            self._build([x for x in leaves[:i] + parts + leaves[j + 1 :] if x[0]])
            return
        for k in range(room):
            t, n = parts[k] if k < len(parts) else ("", 0)
            self.texts[i + k] = t
            self.chars[self.width + i + k], self.tokens[self.width + i + k] = len(t), n
        a, b = self.width + i, self.width + j
        while a > 1:
            a, b = a // 2, b // 2
            for k in range(a, b + 1):
                self._sum(k)


def _build(batches: Iterator[pa.RecordBatch], path: str, extra: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).text
    for whole in batches:
        for batch in slices(whole):
            trees = [CountTree(t or "", lambda t: len(encode(t)) // 4) for t in batch.column(extra).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], pa.array([t.total for t in trees], pa.int64()), pa.array([t.dump() for t in trees], pa.binary())], [*batch.schema.names[:extra], "n_tokens", "tree"])


def _edit(batches: Iterator[pa.RecordBatch], path: str, extra: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).text
    for whole in batches:
        for batch in slices(whole, "tree"):
            rows, trees = [], []
            for raw, edits in zip(batch.column(extra).to_pylist(), batch.column(extra + 1).to_pylist()):
                count = lambda t: len(encode(t)) // 4
                tree = CountTree.load(raw, count) if raw is not None else CountTree("", count)
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
                rows.append((tree.total, len(tree), tree.encoded))
                trees.append(tree.dump())
            kinds = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], *kinds, pa.array(trees, pa.binary())], [*batch.schema.names[:extra], "edited_tokens", "edited_chars", "encoded_again", "tree"])


def _schema(rows: DataFrame, keep: list[str], more: str) -> str:
    return "".join(f"`{c}` {f.dataType.simpleString()}, " for c, f in zip(keep, rows.schema.fields)) + more


def build_trees(docs: DataFrame, keep: list[str], path: str | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with n_tokens, the ids of the whole text, and tree, its count tree as bytes, to be written and edited later.

    A null text is empty. Repeated rows are rows like others; an empty docs gives no rows.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string"))
    path, names = path or default_path(), [f"c{i}" for i in range(len(keep))] + ["text"]
    return rows.toDF(*names).mapInArrow(lambda it: _build(it, path, len(keep)), _schema(rows, keep, "n_tokens long, tree binary"))


def edit_trees(trees: DataFrame, keep: list[str], path: str | None = None, tree_col: str = "tree", edits_col: str = "edits") -> DataFrame:
    """Count trees after a batch of edits: the columns ``keep`` with edited_tokens, edited_chars, encoded_again (characters that the edits made it encode) and tree, as it is now.

    ``edits`` is an array of (at, cut, put) structs, applied in order; places are code points of the text as it is then, clipped to it. Null edits, and nulls
    in one, do nothing; a null tree is that of an empty text.
    """
    edits = F.expr(f"transform(`{edits_col}`, e -> named_struct('at', cast(e.at as long), 'cut', cast(e.cut as long), 'put', cast(e.put as string)))")
    rows = trees.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{tree_col}`"), edits.alias("__edits"))
    path, names = path or default_path(), [f"c{i}" for i in range(len(keep))] + ["tree", "edits"]
    return rows.toDF(*names).mapInArrow(lambda it: _edit(it, path, len(keep)), _schema(rows, keep, "edited_tokens long, edited_chars long, encoded_again long, tree binary"))


def count_tokens(docs: DataFrame, keep: list[str], path: str | None = None, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts of whole texts before and after their edits: build_trees and edit_trees in one pass, for trees that nobody keeps.

    Returns the columns ``keep`` with n_tokens, edited_tokens, edited_chars and encoded_again; nulls, repeats and empty tables are as there.
    """
    plain = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, plain)], F.col(f"`{edits_col}`").alias("edits"), F.col(f"`{text_col}`").alias("text"))
    out = edit_trees(build_trees(rows, [*plain, "edits"], path), [*plain, "n_tokens"], path).drop("tree")
    return out.toDF(*keep, "n_tokens", "edited_tokens", "edited_chars", "encoded_again")
