"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as runs of letters and digits in lower case. An item's occurrence with at most k edits shares at least
m - q + 1 - k q of its m - q + 1 q-grams with the text, and those lie on diagonals at most k apart. So q-grams of the text are looked up in the
benchmark's table, hits are counted in bands of diagonals that overlap by half, bands below the bound are dropped, and what
remains is aligned within the band. Items longer than PART letters are looked for part by part, and all items longer than PIECE letters by pieces that
overlap by half as well, so a verbatim passage of 3 PIECE / 2 letters is found wherever in an item it starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.scratch import save
from spindrel.llm.shingles import slices

#: Letters of a q-gram; letters of a part of an item; edits that a part may have, in hundredths of its letters.
Q, PART, EDITS = 12, 120, 5
#: Letters of a piece, which is a shorter part; pieces start at every half of it.
PIECE = 60
#: Letters of a shorter item below which it must stand in a text exactly and whole.
SHORT = 24
#: Letters and single spaces of an item below which it isn't looked for: a word or two that any text may hold is no leak. short_items lists these items.
LEAST = 12
#: Letters of benchmark text that are sent to all tasks at once, as an index of some 35 bytes a letter; a larger benchmark is used in blocks of this size.
BLOCK = 2 << 20
#: Letters of a text that are looked at together; bounds a worker's arrays.
WINDOW = 1 << 20
_DROP = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Letters and digits of the text in lower case, words apart by one space."""
    return _DROP.sub(" ", text.lower()).strip()


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q = 12 code points from each place on: of 4, of 8, then of the 8 and the 4 after them."""
    h = codes.astype(np.uint64)
    if len(h) < Q:
        return h[:0]

    def join(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        out = a[: len(b)] * np.uint64(0x9E3779B97F4A7C15 + k)
        out += b
        out ^= out >> np.uint64(29)
        return out

    two = join(h, h[1:], 0)
    four = join(two, two[2:], 2)
    eight = join(four, four[4:], 4)
    out = join(eight, four[8:], 6)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def parts(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of an item: of near equal lengths of at most PART, then the overlapping pieces; a short item has one part."""
    n = len(codes)
    k = -(-n // PART)
    cuts = [n * i // k for i in range(k + 1)] if k else []
    starts = [*range(0, n - PIECE, PIECE // 2), n - PIECE] if n > PIECE else []
    return list(dict.fromkeys([*zip(cuts, cuts[1:]), *((a, a + PIECE) for a in starts)]))


def banded(a: np.ndarray, b: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(fewest edits that make a of some stretch of b, its start, its end) if at most ``edits``; the stretch may lie anywhere in b, which is already cut to the band.

    Each row of the table is computed at once. The end is the first of the best; the start comes from the same table over both strings backwards from there, and of several starts the one
    that leaves the stretch nearest to a's length counts, the longer of two.
    """
    row = np.zeros(len(b) + 1, np.int64)
    steps = np.arange(len(b) + 1)
    for i, c in enumerate(a):
        turn = np.minimum(row[:-1] + (b != c), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([i + 1], turn)) - steps) + steps
        if row.min() > edits:
            return None
    end = int(row.argmin())
    k = int(row[end])
    if k > edits:
        return None
    if not k:
        return 0, end - len(a), end
    back = b[:end][::-1][: len(a) + k]
    steps = np.arange(len(back) + 1)
    row = steps
    for i, c in enumerate(a[::-1]):
        turn = np.minimum(row[:-1] + (back != c), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([i + 1], turn)) - steps) + steps
    length = min(np.flatnonzero(row == k).tolist(), key=lambda n: (abs(n - len(a)), -n))
    return k, end - length, end


class Index:
    """The q-grams of a block of benchmark parts: distinct values with, for each, the parts that hold it and where."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST) -> None:
        texts = [(item, _codes(p)) for item, text in items if len(p := plain(text or "")) >= max(1, least)]
        self.codes = np.concatenate([c for _, c in texts]) if texts else np.empty(0, np.uint32)
        rows, g, where, part, base = [], [], [], [], 0
        for item, codes in texts:
            h = grams(codes)
            for a, b in parts(codes):
                k = 0 if b - a < SHORT else (b - a) * EDITS // 100
                n = max(0, b - a - Q + 1)
                g.append(h[a : a + n])
                where.append(np.arange(n, dtype=np.uint8))
                part.append(np.full(n, len(rows), np.int32))
                rows.append((item, base + a, b - a, k, max(1, n - k * Q)))
            base += len(codes)
        columns = list(zip(*rows)) if rows else [()] * 5
        self.item, self.at, self.size, self.edits, self.need = (np.array(c, np.int64) for c in columns)
        self.width = 2 * np.maximum(1, self.edits)
        g, where, part = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((g, np.uint64), (where, np.uint8), (part, np.int32)))
        order = np.argsort(g, kind="stable")
        self.where, self.part = where[order], part[order]
        self.values, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g)).astype(np.int32)
        self._rest()

    def _rest(self) -> None:
        """What is made anew in each worker: the short parts' words, and the table that most q-grams of a text fail at, of some sixteen places a q-gram."""
        self.words = [(int(self.item[i]), "".join(map(chr, self._own(i)))) for i in np.flatnonzero(self.size < Q)]
        self.shift = np.uint64(64 - min(26, max(12, (16 * len(self.values)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.values >> self.shift).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "shift", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._rest()

    def _own(self, i: int) -> np.ndarray:
        return self.codes[self.at[i] : self.at[i] + self.size[i]]

    def find(self, text: str, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the regions of a plain text that hold a part of an item.

        A longer text is read in windows that end at a space and overlap by more than a part can be long.
        """
        if len(text) <= 2 * window:
            return self._find(text)
        out, a = set(), 0
        while a < len(text):
            b = text.find(" ", a + window + 4 * PART)
            b = len(text) if b < 0 else b
            out |= {(item, s + a, e + a, k) for item, s, e, k in self._find(text[a:b])}
            if b == len(text):
                break
            a = max(a + 1, text.rfind(" ", a, b - 3 * PART) + 1 or b - 3 * PART)
        return sorted(out)

    def _find(self, text: str) -> list[tuple[int, int, int, int]]:
        out = []
        codes = _codes(text)
        for item, word in self.words:
            out += [(item, m.start(), m.end(), 0) for m in re.finditer(rf"(?<!\S){re.escape(word)}(?!\S)", text)]
        h = grams(codes)
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.values):
            return out
        slot = np.searchsorted(self.values, h[at])
        known = slot < len(self.values)
        known[known] = self.values[slot[known]] == h[at][known]
        at, slot = at[known], slot[known]
        if not len(at):
            return out
        count = np.diff(self.first)[slot]
        hit = np.repeat(self.first[slot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, part, where = np.repeat(at, count), self.part[hit].astype(np.int64), self.where[hit].astype(np.int64)
        # of each part, no band can have enough hits if the text as a whole hasn't
        seen, place = np.unique(part, return_inverse=True)
        enough = (np.bincount(place) >= self.need[seen])[place]
        if not enough.any():
            return out
        at, part, where = at[enough], part[enough], where[enough]
        width = self.width[part]
        diagonal = at - where + PART  # not negative
        bands = len(codes) + 3 * PART
        for shift in (0, 1):  # bands of width 2k that overlap by half: edits of up to k lie in one of them whole
            band = (diagonal + shift * (width // 2)) // width
            key = part * bands + band
            order = np.lexsort((where, key))
            k, w = key[order], where[order]
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
            ids, counts = np.unique(k[fresh], return_counts=True)
            ids = ids[counts >= self.need[ids // bands]]
            for i, b in zip((ids // bands).tolist(), (ids % bands).tolist()):
                own, edits, wide = self._own(i), int(self.edits[i]), int(self.width[i])
                low = max(0, b * wide - shift * (wide // 2) - PART - edits)
                found = banded(own, codes[low : low + wide + len(own) + 2 * edits + 1], edits)
                if found is not None:
                    out.append((int(self.item[i]), low + found[1], low + found[2], found[0]))
        return sorted(set(out))


def _search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    best = {}
                    for item, a, b, k in index.find(plain(text)):
                        old = best.get(item, (k, a, b))
                        best[item] = (min(old[0], k), min(old[1], a), max(old[2], b))
                    rows += [(doc, item, a, b, k) for item, (k, a, b) in best.items()]
            kinds = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)]
            yield pa.RecordBatch.from_arrays(kinds, ["doc_id", "item_id", "start", "end", "edits"])


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")


def short_items(benchmark: DataFrame, least: int = LEAST, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, text) of the items that are too short to be looked for: fewer than ``least`` letters and single spaces, or none at all."""
    return _items(benchmark, item_col, text_col).where(F.length(F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}\p{M}]+", " "))) < least)


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about BLOCK letters; one block is on the driver at a time."""
    now, size = [], 0
    for item, text in _items(benchmark, item_col, text_col).toLocalIterator():
        now.append((item, text))
        size += len(text)
        if size >= BLOCK:
            yield now
            now, size = [], 0
    if now:
        yield now


def _passes(benchmark: DataFrame, least: int, item_col: str, run) -> list[DataFrame]:
    """run(index) for each block of the benchmark. Of several blocks each result is written before the next block is read, so no more than one index and the block after it are held."""
    out, items = [], blocks(benchmark, item_col)
    now = next(items, None)
    while now is not None:
        found, now = run(Index(now, least)), next(items, None)
        out.append(save(found, "leaks") if out or now is not None else found)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the documents that hold a part of a benchmark item with at most EDITS percent of edits.

    One row for each document row and item; start and end are the outermost places of the item's parts in the document's plain text, edits the fewest of one part. All texts are
    searched whole for all items of ``least`` letters or more (short_items lists the others). Null and empty texts or items have no leaks; repeated rows have a leak each; an empty docs or benchmark gives no rows. The benchmark is a stated query set: it reaches
    the tasks in blocks of bounded size, with one pass over docs for each.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits long"
    found = _passes(benchmark, least, item_col, lambda index: rows.mapInArrow(lambda it: _search(it, index), schema))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def _clean(batches: Iterator[pa.RecordBatch], index: Index, text_at: int, leaked: bool = False) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, whole.schema.names[text_at]):
            keep = [bool(t and index.find(plain(t))) == leaked for t in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", least: int = LEAST) -> DataFrame:
    """docs without the rows whose text holds a part of a benchmark item, as find_leaks finds it; all columns stay as they are.

    A benchmark of one block is a filter. Of several blocks each writes the SHA-256 of the texts that hold one of its items, and these texts go by an anti-join.
    """
    items = blocks(benchmark, item_col)
    first, more = next(items, None), next(items, None)
    if first is None:
        return docs
    at = docs.columns.index(text_col)
    if more is None:
        index = Index(first, least)
        return docs.mapInArrow(lambda it: _clean(it, index, at), docs.schema)
    name = F.sha2(F.col(f"`{text_col}`").cast("string"), 256).alias("__sha")
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    leaked = _passes(benchmark, least, item_col, lambda index: texts.mapInArrow(lambda it: _clean(it, index, 0, True), "text string").select(F.sha2("text", 256).alias("__sha")).distinct())
    return docs.withColumn("__sha", name).join(reduce(DataFrame.union, leaked).distinct(), "__sha", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
