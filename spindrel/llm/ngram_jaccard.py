"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the incidence matrix are the distinct sets (equal sets are one *class*), columns are shingle
hashes. The product with its transpose is never formed: each class enters it with its first ``p`` shingles only, in an order that has
the common ones last, where ``p = m + m // 2 + 2`` and ``m = n - ceil(t * n)`` is how many of its n shingles a partner can lack.
Two linked classes then share ``p - m`` of these columns at least (for the smaller p - m of the two). The columns are
dealt to blocks; a block multiplies its columns and adds up overlap counts of the pairs whose sizes allow a link, and
pairs whose summed count stays below the bound are discarded. The others are compared exactly. Any order that is the same for all sets
gives these counts, so a sample is enough to tell what is common: it decides what the product costs, not what it finds.

A column with more than ``longest`` classes isn't multiplied. A class counts how many such columns it has; the
bound is lowered by the smaller count, and as long as that count is below p - m, no link of the class can be lost. Classes with more are
*crowded*; those that share a long column and are near in size form clusters, and each cluster goes through a second product over
all its shingles, in blocks of bounded size. First each block meets itself and the leading blocks of like sizes; what isn't in the cluster's largest group after that
meets all other blocks of like sizes, so a large group of near copies costs about as many products as it has blocks, and pairs inside the group need none. A product
hands on the links that join its classes, not all of them, and no two different texts that are linked are left apart.

Columns that a sample of the incidence matrix proves to be long are never gathered: their rows go to the second product from where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.components import components
from spindrel.llm.scratch import drop, freed, save
from spindrel.llm.shingles import buffers, mix, shingle_sets, slices

#: Classes of a column above which the first product leaves it to the second.
LONGEST = 32


def lacking(n, num: int, den: int):
    """How many of n shingles a linked set can lack."""
    return n - (num * n + den - 1) // den


def kept(n, num: int, den: int):
    """How many of n shingles enter the product."""
    m = lacking(n, num, den)
    return np.minimum(n, m + m // 2 + 2)


def shared(n, num: int, den: int):
    """How many of these two linked sets share at least, if n is the smaller."""
    return kept(n, num, den) - lacking(n, num, den)


def _class_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from all others, in two halves; the first names the class."""
    h = blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


#: Bytes of text, about, whose shingles are counted, and how many of the commonest are listed at most (5 MB for each task).
RANK_SAMPLE, RANKED = 1 << 26, 1 << 19


def _shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(shingle_sets(*buffers(batch.column(0)), words))).view(np.int64))], ["gram"])


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of the texts, sorted, and a level for each that grows with its count."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = texts.where(F.expr(f"pmod(xxhash64(text), {1 << 30}) < {int(RANK_SAMPLE / size * (1 << 30))}")) if size > RANK_SAMPLE else texts
    counts = some.where("text is not null").select("text").mapInArrow(lambda it: _shingles(it, words), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = save(counts.where("n > 1").select("gram", F.expr("cast(floor(2 * log2(n)) as int)").alias("level")), "common")
    least, listed = None, 0
    for r in sorted(counted.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["level"]):
        listed += r["k"]
        if listed > RANKED:
            break
        least = r["level"]
    found = counted.where(F.col("level") >= F.lit(least)).toArrow()
    drop(counted)
    grams, level = found.column("gram").to_numpy().view(np.uint64), found.column("level").to_numpy().astype(np.int8)
    order = np.argsort(grams)
    return grams[order], level[order]


def _first(s: np.ndarray, k: int, grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """k shingles of a sorted set: those that aren't listed in hash order, then those of lower levels."""
    if k >= len(s) or not len(grams):
        return s[:k]
    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
    return s[np.argsort(np.where(grams[at] == s, level[at], 0), kind="stable")[:k]]


def _incidence(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            n, cls, least = [], [], []
            for s in shingle_sets(*buffers(batch.column(1)), words):
                n.append(len(s))
                cls.append(_class_of(s) if len(s) else (None, None))
                least.append(_first(s, int(kept(len(s), num, den)), *common).tobytes() if len(s) else None)
            halves = [pa.array([c[i] for c in cls], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *halves, pa.array(least, pa.binary())], ["doc_id", "n", "cls", "rest", "least"])


#: Rows of the incidence matrix's sample, about; long columns are found in it.
COLUMN_SAMPLE = 1 << 18
#: Rows of the sample of whole columns, about; it tells how many overlap counts there will be.
WHOLE_SAMPLE = 1 << 18


#: Rows of overlap counts that are shuffled at once at least: as many as enter the product, or so many if these are more.
OVERLAPS = 1 << 24


def _columns(batches: Iterator[pa.RecordBatch], take) -> Iterator[pa.RecordBatch]:
    """(cls, n, least) -> (gram, cls, n), a row for each shingle that enters the product and that take(grams, cls) takes."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            each = part.column(2).to_pylist()
            counts = [len(b) // 8 for b in each]
            cls, n = (np.repeat(part.column(i).to_numpy(), counts) for i in (0, 1))
            gram = np.frombuffer(b"".join(each), np.int64)
            if (some := take(gram, cls)) is not None:
                gram, cls, n = gram[some], cls[some], n[some]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(cls), pa.array(n.astype(np.int32))], ["gram", "cls", "n"])


def _in_sample(share: float):
    """Takes a share of the rows, by a hash of gram and class."""
    top = np.uint64(min(2**64 - 1, int(share * 2**64)))
    return lambda gram, cls: mix(gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cls.astype(np.uint64)) <= top


def _whole_columns(share: float):
    """Takes a share of the columns whole, by a hash of the gram."""
    top = np.uint64(min(2**64 - 1, int(share * 2**64)))
    return lambda gram, cls: mix(gram.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) <= top


def _known(grams: np.ndarray, inside: bool):
    """Takes the rows whose gram is one of the sorted grams, or isn't."""
    if not len(grams):
        return (lambda gram, cls: np.zeros(len(gram), bool)) if inside else (lambda gram, cls: None)
    return lambda gram, cls: (grams[np.minimum(np.searchsorted(grams, gram), len(grams) - 1)] == gram) == inside


def _multiply(batches: Iterator[pa.RecordBatch], num: int, den: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Columns sorted by (gram, n) -> pairs of each short column, and (cls, gram) of each long one.

    Rows are (long, x, y, nx, ny). A column may go over several batches; of a long one only its gram is remembered.
    """
    names = ["long", "x", "y", "nx", "ny"]

    def table(long, x, y, nx, ny):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), long)), pa.array(x), pa.array(y), pa.array(nx), pa.array(ny)], names)

    rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
    over = None  # the gram of a long column that goes on

    def close(g, c, n):
        cut = np.flatnonzero(np.diff(g)) + 1
        start = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((start, [len(g)])))
        long = np.repeat(size > longest, size)
        if long.any():
            yield table(True, c[long], g[long], n[long], np.zeros(int(long.sum()), np.int32))
        for k in np.unique(size[(size > 1) & (size <= longest)]):
            i, j = np.triu_indices(int(k), 1)
            at = start[size == k]
            for part in np.array_split(at, max(1, len(at) * len(i) // 500_000)):
                a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                fits = n[a].astype(np.int64) * den >= n[b].astype(np.int64) * num  # n[a] <= n[b]
                a, b = a[fits], b[fits]
                swap = c[a] > c[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                if len(a):
                    yield table(False, c[a], c[b], n[a], n[b])

    for batch in batches:
        g, c, n = (np.concatenate((r, batch.column(i).to_numpy())) for i, r in enumerate(rest))
        if over is not None:
            k = int(np.searchsorted(g != over, True))  # rows of one gram stand together
            if k:
                yield table(True, c[:k], g[:k], n[:k], np.zeros(k, np.int32))
            if k < len(g):
                over = None
            g, c, n = g[k:], c[k:], n[k:]
        if not len(g):
            rest = [g, c, n]
            continue
        last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
        if last:
            yield from close(g[:last], c[:last], n[:last])
        rest = [g[last:], c[last:], n[last:]]
        if len(rest[0]) > longest:
            over = rest[0][0]
            yield table(True, rest[1], rest[0], rest[2], np.zeros(len(rest[0]), np.int32))
            rest = [r[:0] for r in rest]
    if len(rest[0]):
        yield from close(*rest)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, limit=2 << 20):
            sets = list(shingle_sets(*buffers(batch.column(1)), words))
            names = [_class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*[pa.array([c[i] for c in names], pa.int64()) for i in (0, 1)], pa.array([s.tobytes() for s in sets], pa.binary())], ["first", "rest", "grams"])


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch, x, y = whole.slice(at, 256), [], []
            for a, b, s, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = np.concatenate((s, t))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common * den >= (len(both) - common) * num:
                    x.append(a)
                    y.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Enough of the links of a symmetric boolean matrix to join what they join, by breadth-first search."""
    a, b, fresh = [], [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(linked[i] & fresh)
            fresh[near] = False
            a += [i] * len(near)
            b += near.tolist()
            queue += near.tolist()
    return a, b


def _product(table: pa.Table, num: int, den: int) -> pa.Table:
    """The sets of a block, or of two (cls, second, grams) -> links that join them, from the product of their incidence matrices, column block by column block.

    Of two blocks only pairs across count.
    """
    cls, second = table.column("cls").to_numpy(), table.column("second").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    n = np.array([len(x) for x in sets])
    grams, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    several = held[column] > 1
    row, column = row[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(sets)),) * 2
    overlap = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, (c, c + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[i:j], column[i:j] - c] = 1
        overlap += part[a] @ part[b].T
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[np.ix_(a, b)] = overlap.astype(np.float64) * (num + den) >= num * (n[a][:, None] + n[b]).astype(np.float64)
    linked |= linked.T
    linked &= cls[:, None] != cls
    a, b = _forest(linked)
    return pa.table({"x": pa.array(cls[a], pa.int64()), "y": pa.array(cls[b], pa.int64())})


#: Shingles that a block of the second product should hold, and the least that a class counts for: some 500 classes a block at most.
BLOCK, LEAST = 1 << 17, 1 << 8


#: Rows of three numbers that are sent to all tasks at most; of more, the table is joined by key.
MOST_SENT = 1 << 18


def _sent(few: DataFrame, name: str) -> DataFrame:
    few = save(few, name)
    return F.broadcast(few) if few.count() <= MOST_SENT else few


def _dealt(members: DataFrame, name: str) -> DataFrame:
    """(comp, span, cls, weight) with the column ``name``: the block of each, of about BLOCK shingles, by a hash of the class."""
    room = members.groupBy("comp", "span").agg(F.ceil(F.sum("weight") * 4 / (3 * BLOCK)).cast("long").alias("room")).where("room > 1")
    return members.join(_sent(room, "rooms"), ["comp", "span"], "left").withColumn(name, F.expr("pmod(xxhash64(cls), coalesce(room, 1))")).drop("room")


#: Pairs of blocks that are multiplied at once, each of some 2 MB: what a wave has shuffled is deleted before the next.
WAVE = 256


def _each_product(table: pa.Table, num: int, den: int) -> pa.Table:
    """The links of clusters (comp, cls, grams) that share a turn, each by its own product."""
    table = table.sort_by("comp").append_column("second", pa.array(np.zeros(len(table), bool)))
    comp = table.column("comp").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(comp)) + 1).tolist(), len(table)]
    return pa.concat_tables(_product(table.slice(a, b - a), num, den) for a, b in zip(cuts, cuts[1:]))


#: Pairs that are compared at once in clusters that don't fit a block, each with both its sets.
PAIRS = 1 << 16


def _within_pairs(pairs: DataFrame, sizes: DataFrame, sets_of, num: int, den: int) -> DataFrame:
    """(x, y) that may be linked -> links. Clusters of such pairs go through a product that each set enters once, however many pairs it is in; those that don't fit a block go pair by pair, some at a time."""
    clusters = components(pairs).select(F.col("node").alias("cls"), "comp").join(sizes, "cls")
    members = save(clusters.withColumn("weight", F.greatest(F.col("n"), F.lit(LEAST))), "pair-clusters")
    weights = save(members.groupBy("comp").agg(F.sum("weight").alias("all")), "weights")
    small = weights.where(F.col("all") <= BLOCK)
    turns = -(-int(small.agg(F.sum("all")).first()[0] or 0) // BLOCK)
    dealt = sets_of(members.join(small.select("comp"), "comp", "left_semi").select("cls", "comp")).withColumn("turn", F.expr(f"pmod(xxhash64(comp), {max(1, turns)})"))
    links = save(dealt.groupBy("turn").applyInArrow(lambda t: _each_product(t.select(["comp", "cls", "grams"]), num, den), "x long, y long"), "links")
    large = weights.where(F.col("all") > BLOCK)
    if large.limit(1).count():
        inside = save(members.join(large.select("comp"), "comp", "left_semi").select("cls"), "large-pair-clusters")
        sets = save(sets_of(inside), "sets")
        rest = save(pairs.join(inside.select(F.col("cls").alias("x")), "x", "left_semi"), "large-pairs")
        waves = -(-rest.count() // PAIRS)
        for k in range(waves):
            wave = rest.where(F.expr(f"pmod(xxhash64(x), {waves}) = {k}"))
            both = wave.join(sets.select(F.col("cls").alias("x"), F.col("grams").alias("s")), "x").join(sets.select(F.col("cls").alias("y"), F.col("grams").alias("t")), "y")
            links = links.union(save(both.select("x", "y", "s", "t").mapInArrow(lambda it: _compare(it, num, den), "x long, y long"), "links"))
        drop(inside, sets, rest)
    drop(members, weights)
    return links


def _within_clusters(long: DataFrame, sets_of, num: int, den: int, bound) -> DataFrame:
    """(cls, gram, n) of crowded classes -> links among them.

    Linked classes that no short column shows have all columns that they must share, bound of the smaller's size, among their long ones. So if each class leaves out one less than that of its
    long columns, the last in order, they still have one in common. Their sizes are in the same span or in spans side by side, as a span reaches as far as linked sizes can differ. A class is tied to
    its columns' spans and these to the next, so links never leave a cluster of tied classes.
    """
    span = F.floor(F.log("n") / max(0.02, 1.000001 * float(np.log(den / num)))).cast("long")
    each = long.groupBy("cls").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("gram")).alias("grams"))
    some = F.greatest(F.lit(1), F.size("grams") - F.expr(bound(f"(({num} * n + {den - 1}) div {den})")).cast("int") + 1)
    tied = save(each.select("cls", span.alias("span"), F.explode(F.slice("grams", F.lit(1), some)).alias("gram")), "tied")
    beside = tied.select("gram", "span").distinct().select(F.xxhash64("gram", "span").alias("x"), F.xxhash64("gram", F.col("span") + 1).alias("y"))
    clusters = components(tied.select(F.col("cls").alias("x"), F.xxhash64("gram", "span").alias("y")).union(beside))
    drop(tied)
    sizes = long.groupBy("cls").agg(F.first("n").alias("n"))
    members = save(clusters.withColumnRenamed("node", "cls").join(sizes, "cls").withColumn("weight", F.greatest(F.col("n"), F.lit(LEAST))), "clusters")
    # a cluster that fits a block is one; others are dealt span by span
    large = members.groupBy("comp").agg(F.sum("weight").alias("all")).where(F.col("all") > BLOCK).select("comp", F.lit(True).alias("large"))
    members = members.join(_sent(large, "large-clusters"), "comp", "left").withColumn("span", F.when(F.col("large"), span).otherwise(-1)).drop("large")
    members = save(_dealt(members, "block"), "members")
    blocks = save(members.groupBy("comp", "span", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")), "blocks")
    sets = save(sets_of(members.select("cls").distinct()), "crowded-sets")

    def products(first: DataFrame, second: DataFrame | None, count: int, name: str) -> DataFrame:
        """Links of count turns: (turn, comp, span, block) sides of own pairs, or also second sides that meet the first."""
        sides = first.select("turn", "comp", "span", "cls", F.lit(False).alias("second"))
        if second is not None:
            sides = sides.union(second.select("turn", "comp", "span", "cls", F.lit(True).alias("second")))
        waves, out = -(-count // WAVE), []
        for k in range(waves):
            wave = sides.where(F.expr(f"pmod(xxhash64(turn), {waves}) = {k}")) if waves > 1 else sides
            dealt = wave.join(sets, "cls").select("turn", "cls", "second", "grams")
            out.append(save(dealt.groupBy("turn").applyInArrow(lambda t: _product(t, num, den), "x long, y long"), name))
        return reduce(DataFrame.union, out)

    own = products(members.withColumn("turn", F.struct("comp", "span", "block")), None, blocks.count(), "own-links")
    several = blocks.where("span >= 0")
    if not several.limit(1).count():
        drop(sets)
        return own

    def near(a: str, b: str) -> str:
        return f"{a}.comp = {b}.comp and {a}.span - {b}.span in (-1, 0, 1) and {a}.least * {num} <= {b}.most * {den} and {b}.least * {num} <= {a}.most * {den}"

    def turns(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of blocks of one cluster whose sizes allow links; each span of a meets three spans of b."""
        beside = a.withColumn("other", F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1))).alias("a")
        pairs = beside.join(b.alias("b"), F.expr(f"a.comp = b.comp and a.other = b.span and {near('a', 'b')}"))
        return pairs.select(F.col("a.comp").alias("comp"), F.col("a.span").alias("i"), F.col("a.block").alias("ib"), F.col("b.span").alias("j"), F.col("b.block").alias("jb"), F.struct("a.comp", F.col("a.span").alias("i"), F.col("a.block").alias("ib"), F.col("b.span").alias("j"), F.col("b.block").alias("jb")).alias("turn"))

    def side(of: DataFrame, which: DataFrame, k: str) -> DataFrame:
        return of.join(which.select("turn", "comp", F.col(k).alias("span"), F.col(k + "b").alias("block")), ["comp", "span", "block"])

    def across(first: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """Links of pairs of blocks, the first side's classes from first."""
        return products(side(first, pairs, "i"), side(members, pairs, "j"), count, name) if (count := pairs.count()) else own.limit(0)

    led = save(turns(several, several.where("block = 0")).where("not (i >= j and ib = jb)"), "turns")  # of two leading blocks, the pair counts once
    ahead = across(members, led, "leading-links")
    groups = components(own.union(ahead)).select(F.col("node").alias("cls"), F.col("comp").alias("label"))
    spread = save(members.where("span >= 0").join(groups, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "spread")
    largest = spread.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("comp").agg(F.max(F.struct("k", "label")).alias("top")).select("comp", F.col("top.label").alias("label"))
    rest = save(_dealt(spread.join(_sent(largest, "largest-groups"), ["comp", "label"], "left_anti").select("comp", "span", "cls", "n", "weight"), "block"), "rest")
    tail = rest.groupBy("comp", "span", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    last = save(turns(tail, several.where("block > 0")), "turns")  # leading blocks have met all
    out = own.union(ahead).union(across(rest, last, "other-links"))
    drop(sets, spread, rest, led, last)
    return out


#: Bits of the map of keys that tasks get, in words of 64.
BITS = 1 << 23


def _among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is in wanted, and a few others: a map of bits that all tasks get tells them, so rows stay where they are."""
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    words = wanted.select(place.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    near = rows.withColumn("at", place).withColumn("word", F.expr("at div 64")).join(F.broadcast(words), "word").where("(shiftright(bits, cast(at % 64 as int)) & 1) = 1")
    return near.select(*rows.columns)


def _apart(rows: DataFrame) -> DataFrame:
    """Incidence rows with a class of its own for each set, should two sets share the first half of their 128 bits; ``first`` keeps that half."""
    rows = rows.withColumn("first", F.col("cls"))
    shared = rows.where("cls is not null").groupBy("cls").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).where("a <> b").select("cls", F.lit(True).alias("shared"))
    if not shared.limit(1).count():
        return rows
    return save(rows.join(shared, "cls", "left").withColumn("cls", F.expr("if(shared, xxhash64(first, rest), cls)")).drop("shared"), "incidence")


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links all texts whose sets of ``words``-word shingles have a Jaccard likeness of ``percent`` / 100 or more.

    Returns (members, links). members has a row for each row of docs: (doc_id, n_shingles, cls, component_id); component_id is the smallest doc_id reachable by links,
    its own included. links has the pairs (x, y) of classes found linked; between near copies of a large group these
    are enough links to join the group, not all of its pairs. Rows of a null or wordless text have the empty set, a null class and their own id as component. Rows with
    equal sets (copies, or ids that repeat) are one class. A row without id is in the class of its text, but can't give a component its id. Other columns of docs are not read. An empty docs gives two empty tables.
    """
    with freed(docs.sparkSession):
        return _join(docs, words, percent, 100, longest, id_col, text_col)


def _join(docs: DataFrame, words: int, num: int, den: int, longest: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    common = _common(texts, words)
    incidence = save(texts.mapInArrow(lambda it: _incidence(it, words, num, den, common), "doc_id long, n long, cls long, rest long, least binary"), "incidence")
    wide = _apart(incidence)
    rows = save(wide.select("doc_id", "n", "cls", "first", "rest"), "rows")
    classes = save(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("rest").alias("rest")), "classes")
    # One row of each class enters the product: the one with the least id, and of several such rows any, as their sets are equal.
    reps = save(wide.where("cls is not null and doc_id is not null").select("doc_id", "cls", "n", "least").join(classes.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"], "left_semi").select("cls", "n", "least"), "reps")
    drop(incidence, *([wide] if hasattr(wide, "saved_at") else []))
    # (An id that repeats with equal sets gives a class twice in a column; such pairs of x = y fall out below.)
    schema, grams = "gram long, cls long, n int", reps.agg(F.sum(F.octet_length("least")) / 8).first()[0] or 0
    sample = reps.mapInArrow(lambda it, take=_in_sample(COLUMN_SAMPLE / max(1, grams)): _columns(it, take), schema)
    # a column is in this list if more of it is in the sample than makes it long, so the list has COLUMN_SAMPLE / longest columns at most, about
    seen = np.array(sorted(r["gram"] for r in sample.groupBy("gram").agg(F.countDistinct("cls").alias("n")).where(F.col("n") > longest).select("gram").collect()), np.int64)
    columns = reps.mapInArrow(lambda it: _columns(it, _known(seen, False)), schema)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = columns.repartition(parts, "gram").sortWithinPartitions("gram", "n", "cls")
    product = dealt.mapInArrow(lambda it: _multiply(it, num, den, longest), "long boolean, x long, y long, nx int, ny int")
    share = min(1.0, WHOLE_SAMPLE / max(1, grams))
    whole = reps.mapInArrow(lambda it, take=_whole_columns(share): _columns(it, take), schema).groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= longest)
    waves = max(1, -(-int((whole.agg(F.sum(F.expr("k * (k - 1) / 2"))).first()[0] or 0) / share) // int(max(OVERLAPS, grams))))
    counts = []
    for k in range(waves):
        of = F.expr(f"if(long, {k} = 0, x <> y and pmod(xxhash64(x, y), {waves}) = {k})")
        counts.append(save(product.where(of).groupBy("long", "x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("c")), "overlaps"))
    overlaps = reduce(DataFrame.union, counts)
    long = counts[0].where("long").select(F.col("x").alias("cls"), F.col("y").alias("gram"), F.col("nx").alias("n"))
    if len(seen):
        long = long.union(reps.mapInArrow(lambda it: _columns(it, _known(seen, True)), schema).select("cls", "gram", "n").distinct())
    long = save(long, "long-columns")
    drop(reps)
    held = save(long.groupBy("cls").agg(F.count(F.lit(1)).alias("h"), F.first("n").alias("n")), "held")

    def bound(n):
        m = f"({n} - ({num} * {n} + {den - 1}) div {den})"
        return f"(least({n}, {m} + {m} div 2 + 2) - {m})"

    pairs = overlaps.where("not long").drop("long")
    for k in "xy":
        pairs = pairs.join(held.select(F.col("cls").alias(k), F.col("h").alias(f"h{k}")), k, "left").fillna(0, [f"h{k}"])
    pairs = pairs.where(f"c >= least({bound('nx')}, {bound('ny')}) - least(hx, hy)").select("x", "y")
    reach = classes.select("cls", "first", "rest", F.col("rep").alias("doc_id"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(cls, grams) of the classes in wanted and its other columns, from the text of one row each."""
        wanted = save(wanted.join(reach, "cls"), "wanted")
        found = _among(_among(texts, "doc_id", wanted).mapInArrow(lambda it: _sets(it, words), "first long, rest long, grams binary"), "first", wanted)
        more = [c for c in wanted.columns if c not in ("first", "rest", "doc_id", "n")]
        return found.join(wanted.select("first", "rest", *more), ["first", "rest"]).groupBy("first", "rest").agg(F.first("grams").alias("grams"), *[F.first(c).alias(c) for c in more]).drop("first", "rest")

    pairs = save(pairs.distinct(), "pairs")
    drop(*counts)
    links = _within_pairs(pairs, classes.select("cls", "n"), sets_of, num, den)
    drop(pairs)
    crowded = held.where(f"h >= {bound(f'(({num} * n + {den - 1}) div {den})')}").select("cls", "n")
    crowds = save(long.join(crowded.select("cls"), "cls", "left_semi"), "long")
    drop(long, held)
    if crowds.limit(1).count():
        links = links.union(_within_clusters(crowds, sets_of, num, den, bound))
    drop(crowds)
    comps = components(links)
    ids = save(classes.join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp")), "ids")
    label = ids.join(ids.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("cls", "component_id")
    members = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(label, "cls", "left")
    return members.select("doc_id", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), links
