"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

Leaves are phrases; a paragraph is a line, and a section ends at a blank line or after a paragraph whose own hash says so, so that an edit moves no later border. Each
inner hash covers its children's hashes in order, of 16 bytes all; only the leaf hashes that are kept to compare texts by are short. The fingerprint is the root followed by the tree, so equal texts have equal fingerprints, roots alone test
equality, and unequal branches of two trees lead to the edits.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.sampling import least_by_hash

#: Bytes of a hash, and of a leaf's hash as it is kept.
FULL, SMALL = 16, 4
#: One paragraph in so many ends a section.
SECTION = 8
#: Borders depend on the words beside them alone (six letters that many languages have, and marks), so an edit moves the few around it.
_PHRASE = re.compile(r".{12,120}?[dhlptxDHLPTX.!?$|*]\s+|.{60,120}?\s+|.{1,120}", re.S)


def _hash(data: bytes, size: int = FULL) -> bytes:
    return blake2b(data, digest_size=size).digest()


def phrases(line: str) -> list[str]:
    """The line's phrases, in order and complete: a phrase has 12 to about 120 code points and ends after a word with one of these last letters if it can."""
    return _PHRASE.findall(line)


class Tree:
    """root: 16 bytes; sections: lists of paragraphs, each the short hashes and code points of its phrases; marks: the paragraphs' hashes by section."""

    def __init__(self, sections: list[list[list[tuple[bytes, int]]]], marks: list[list[bytes]]) -> None:
        self.sections, self.marks = sections, marks
        self.tops = [_hash(b"s" + b"".join(m)) for m in marks]
        self.root = _hash(b"d" + b"".join(self.tops))

    @classmethod
    def of(cls, text: str) -> "Tree":
        sections, marks, now, own = [], [], [], []
        for line in text.split("\n"):
            found = phrases(line)
            hashes = [_hash(b"l" + s.encode("utf-8", "surrogatepass")) for s in found]
            now.append([(h[:SMALL], len(s)) for h, s in zip(hashes, found)])
            own.append(_hash(b"p" + b"".join(hashes)))
            if not line.strip() or own[-1][0] % SECTION == 0:
                sections.append(now)
                marks.append(own)
                now, own = [], []
        if now:
            sections.append(now)
            marks.append(own)
        return cls(sections, marks)

    def leaves(self, places: list[tuple[int, int]]) -> Counter:
        """Code points by leaf hash in the paragraphs at these (section, paragraph) places."""
        out = Counter()
        for i, j in places:
            for h, n in self.sections[i][j]:
                out[h] += n
        return out

    def size(self) -> int:
        return sum(n for s in self.sections for p in s for _, n in p)

    def dump(self) -> str:
        """root:tree; the tree has a byte string of counts, code points, leaf hashes and marks, in base 64."""
        counts = [len(self.sections)] + [len(s) for s in self.sections] + [len(p) for s in self.sections for p in s]
        leaves = [x for s in self.sections for p in s for x in p]
        raw = np.array([len(counts), *counts, *[n for _, n in leaves]], "<u4").tobytes() + b"".join(h for h, _ in leaves) + b"".join(m for s in self.marks for m in s)
        return self.root.hex() + ":" + base64.b64encode(raw).decode()

    @classmethod
    def load(cls, fingerprint: str) -> "Tree":
        raw = base64.b64decode(fingerprint.partition(":")[2])
        n = int.from_bytes(raw[:4], "little")
        counts = np.frombuffer(raw, "<u4", n, 4).tolist()
        k = counts[0]
        per_section, per_paragraph = counts[1 : 1 + k], counts[1 + k :]
        total = sum(per_paragraph)
        sizes = np.frombuffer(raw, "<u4", total, 4 + 4 * n).tolist()
        at = 4 + 4 * n + 4 * total
        leaves = iter([(raw[at + SMALL * i : at + SMALL * (i + 1)], m) for i, m in enumerate(sizes)])
        lines = iter([[next(leaves) for _ in range(c)] for c in per_paragraph])
        at += SMALL * total
        marks = iter([raw[at + FULL * i : at + FULL * (i + 1)] for i in range(len(per_paragraph))])
        return cls([[next(lines) for _ in range(c)] for c in per_section], [[next(marks) for _ in range(c)] for c in per_section])


def _unmatched(a: list[bytes], b: list[bytes]) -> list[int]:
    """Places of a whose hashes b lacks, as often as it lacks them."""
    left = Counter(b)
    out = []
    for i, h in enumerate(a):
        if left[h] > 0:
            left[h] -= 1
        else:
            out.append(i)
    return out


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) places of a that lie in sections b lacks and whose own hashes the sections of b that a lacks lack too: equal branches are skipped from the top."""
    if a.root == b.root:
        return []
    own = [(i, j) for i in _unmatched(a.tops, b.tops) for j in range(len(a.marks[i]))]
    other = [m for i in _unmatched(b.tops, a.tops) for m in b.marks[i]]
    return [own[k] for k in _unmatched([a.marks[i][j] for i, j in own], other)]


def likeness(a: Tree, b: Tree) -> float:
    """Share of the code points of both texts that lie in phrases of both: 1 for equal roots, less for any others.

    Only paragraphs in branches that differ are compared phrase by phrase; all else lies in equal branches, which match whole.
    """
    if a.root == b.root:
        return 1.0
    x, y = a.leaves(differing(a, b)), b.leaves(differing(b, a))
    total = a.size() + b.size()
    apart = sum(x.values()) + sum(y.values()) - 2 * sum((x & y).values())
    return min(1 - apart / total, 1 - 1 / (total + 1)) if total else 0.0


def likeness_of(a: str, b: str) -> float:
    """The likeness of two fingerprints."""
    return likeness(Tree.load(a), Tree.load(b))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([Tree.of(t or "").dump() for t in batch.column(batch.num_columns - 1).to_pylist()], pa.string())], [*batch.schema.names[:-1], "fingerprint"])


def fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with the fingerprint of the whole text; null texts are empty, an empty docs gives no rows."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", fingerprint string"
    return rows.mapInArrow(_fingerprints, schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, own, doc_id, text) by part and descending id -> each own row with its edited text's fingerprint; the row after it is its next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None  # (part, doc_id, text, tree)

    def one(row, text, tree):
        _, doc, own, own_tree = row
        k = len(own) // 3
        edited = own[: len(own) - k] + text[:k]
        changed = own_tree if edited == own else Tree.of(edited)
        return doc, len(own), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_tree.dump(), changed.dump(), likeness(own_tree, changed), likeness(own_tree, tree)

    for batch in batches:
        rows = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

        for part, own, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            text = text.as_py() or ""
            tree = Tree.of(text)
            if last is not None and last[0] == part:
                rows.append(one(last, text, tree))
            last = (part, doc, text, tree) if own else None
            if len(rows) >= 512:
                yield out()
                rows = []
        yield out()


#: Rows of the sample, for each part, that the order is cut by.
PER_PART = 32
_ORDER = "struct(coalesce(doc_id, -9223372036854775808L) AS id, if(doc_id IS NULL, 0, 1) AS known, xxhash64(text) AS h)"


def _part_of(cuts: list[tuple[int, int, int]]):
    """How many cuts lie above a row's place in the order, by one look at every k-th cut and one at those between; cuts ascend."""
    if not cuts:
        return F.lit(0)
    k = max(1, int(len(cuts) ** 0.5))
    one = lambda c: F.struct(F.lit(c[0]).cast("long").alias("id"), F.lit(c[1]).alias("known"), F.lit(c[2]).cast("long").alias("h"))
    groups = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    at = F.size(F.filter(F.array(*[one(g[0]) for g in groups]), lambda c: c <= F.col("__order")))
    inside = F.size(F.filter(F.element_at(F.array(*[F.array(*map(one, g)) for g in groups]), F.greatest(at, F.lit(1))), lambda c: c <= F.col("__order")))
    return F.lit(len(cuts)) - F.when(at == 0, 0).otherwise((at - 1) * k + inside)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: its last third replaced by the start of the next document, in descending id order (after the last: the first).

    The order, by id and of rows with one id by a hash of the text, is cut into parts at places of a bounded sample of rows (PER_PART a part), so null ids or one id of many rows are
    cut up as well; the first row of each part also goes to the part before it, so that every row meets its next. Only the places of these rows, one a part, are gathered beforehand. Null
    texts are empty; rows without id come last in the order; an empty docs gives no rows; a single row is its own next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("__order", F.expr(_ORDER))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = sorted(tuple(r[0]) for r in least_by_hash(rows.select("__order", F.xxhash64("__order").alias("by")), ["by"], PER_PART * parts).select("__order").collect())
    cuts = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if len(some) > 1 else []
    tagged = rows.withColumn("part", _part_of(cuts))
    heads = {r["part"]: r["top"] for r in tagged.groupBy("part").agg(F.max("__order").alias("top")).collect()}
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first part's first row is the next of the very last
    # A row that stands first in its part is copied to the part before; of several with this place, the one with the least text.
    first = spark.createDataFrame([(p, heads[p], before[p]) for p in order], "part int, top struct<id: long, known: int, h: long>, halo int")
    tops = tagged.join(F.broadcast(first), "part").where("__order = top")
    tops = tops.groupBy("part", "halo").agg(F.min(F.struct("text", "doc_id", "__order")).alias("r")).select(F.col("halo").alias("part"), F.lit(False).alias("own"), "r.doc_id", "r.text", "r.__order")
    both = tagged.select("part", F.lit(True).alias("own"), "doc_id", "text", "__order").union(tops)
    dealt = both.repartitionById(max(parts, len(cuts) + 1), F.col("part")).sortWithinPartitions(F.desc("own"), F.desc("__order"), "text").select("part", "own", "doc_id", "text")
    return dealt.mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
