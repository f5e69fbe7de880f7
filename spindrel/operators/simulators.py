"""Corpora and spectra drawn from generative models. Each row's draws come from (seed, row) and each topic's from (seed, topic), so results don't depend on how tasks lie."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.plans.catalog import Catalog

CATALOG = Catalog()
Children = dict[int, list[int]]

CORPUS = "doc_id long, pos long, term int, node int"


def _root(children: Children) -> int:
    below = {c for cs in children.values() for c in cs}
    roots = sorted(set(children) - below)
    if len(roots) != 1:
        raise ValueError(f"a graph needs one root, not {roots}")
    return roots[0]


def walk_corpus(spark: SparkSession, docs: int, words: int, children: Children, terms: int, stop: str = "leaf", alpha: Callable[[int, int], float] | float = 1.0, topic: Callable[[int], np.ndarray] | float = 0.1, seed: int = 0) -> DataFrame:
    """(doc_id, pos, term, node): a document draws shares over the edges out of each inner node of an acyclic graph, a slot walks from the root by them and its node draws the word.

    ``stop``: 'leaf' walks to a leaf; 'path' walks to a leaf and takes one of the nodes on the way, each as likely; 'exit' has at each inner node, beside its edges, an edge of weight 1 that
    ends the walk there. ``alpha``: the weight of an edge (parent, child), or one number; ``topic``: a node's distribution of terms, or the weight of a Dirichlet that draws it.
    """
    if stop not in ("leaf", "path", "exit"):
        raise ValueError(f"unknown stop {stop}")
    root = _root(children)
    nodes = sorted({*children, *(c for cs in children.values() for c in cs)})
    weigh = alpha if callable(alpha) else (lambda a, b: float(alpha))
    weights = {a: [1.0] * (stop == "exit") + [float(weigh(a, b)) for b in cs] for a, cs in children.items() if cs}
    topics = {n: np.asarray(topic(n), float) if callable(topic) else np.random.default_rng([seed, 1, n]).dirichlet(np.full(terms, float(topic))) for n in nodes}

    def write(batches):
        import pandas as pd

        for batch in batches:
            for doc in batch["id"]:
                r = np.random.default_rng([seed, 2, int(doc)])
                shares = {a: r.dirichlet(w) for a, w in weights.items()}
                at = []
                for _ in range(words):
                    way = [root]
                    while way[-1] in weights:
                        k = int(r.choice(len(weights[way[-1]]), p=shares[way[-1]])) - (stop == "exit")
                        if k < 0:
                            break
                        way.append(children[way[-1]][k])
                    at.append(way[int(r.integers(len(way)))] if stop == "path" else way[-1])
                yield pd.DataFrame({"doc_id": doc, "pos": np.arange(words), "term": [int(r.choice(terms, p=topics[n])) for n in at], "node": at})

    return spark.range(docs).mapInPandas(write, CORPUS)


def nested_corpus(spark: SparkSession, docs: int, words: int, terms: int, alpha: float = 1.0, beta: float = 1.0, gamma: tuple[float, float] = (1.0, 1.0), topic: float = 0.1, seed: int = 0) -> DataFrame:
    """(doc_id, pos, term, path) of a nested hierarchical Dirichlet process over a tree of unbounded width and depth; path: child numbers with '.' between, '' the root.

    Each node has global stick lengths (1, alpha). A document has at each node its own sticks (1, beta), whose atoms are children drawn by the global sticks, the same for all documents, and
    a chance ~ Beta(gamma) to stop there. Sticks are broken as far as draws ask.
    """

    def write(batches):
        import pandas as pd

        def numbers(*key) -> np.random.Generator:
            return np.random.default_rng([seed, *key])

        class Sticks:
            def __init__(self, r, b):
                self.r, self.b, self.lengths, self.left = r, b, [], 1.0

            def draw(self, r) -> int:
                u, total = r.random(), 0.0
                for i in range(10_000_000):
                    if i == len(self.lengths):
                        v = self.r.beta(1.0, self.b)
                        self.lengths.append(self.left * v)
                        self.left *= 1 - v
                    total += self.lengths[i]
                    if total > u or self.left < 1e-12:
                        return i

        topics: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for doc in batch["id"]:
                r = numbers(2, int(doc))
                world: dict[tuple, Sticks] = {}
                own: dict[tuple, Sticks] = {}
                stops: dict[tuple, float] = {}
                atoms: dict[tuple, int] = {}
                paths, found = [], []
                for _ in range(words):
                    path: tuple[int, ...] = ()
                    while r.random() >= stops.setdefault(path, r.beta(*gamma)):
                        key = (len(path), *path)
                        k = own.setdefault(path, Sticks(r, beta)).draw(r)
                        if (path, k) not in atoms:
                            atoms[path, k] = world.setdefault(path, Sticks(numbers(3, *key), alpha)).draw(numbers(4, k, *key))
                        path += (atoms[path, k],)
                    if path not in topics:
                        topics[path] = numbers(5, len(path), *path).dirichlet(np.full(terms, topic))
                    paths.append(".".join(map(str, path)))
                    found.append(int(r.choice(terms, p=topics[path])))
                yield pd.DataFrame({"doc_id": doc, "pos": np.arange(words), "term": found, "path": paths})

    return spark.range(docs).mapInPandas(write, "doc_id long, pos long, term int, path string")


def grid_topics(side: int) -> np.ndarray:
    """2 * side topics over the side * side cells of a grid: its rows, then its columns, each with equal shares."""
    cells = np.arange(side * side)
    return np.stack([(cells // side == k) / side for k in range(side)] + [(cells % side == k) / side for k in range(side)])


def grid_corpus(spark: SparkSession, docs: int, words: int, side: int = 5, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, pos, term, node) of documents that mix the topics of a grid."""
    topics = grid_topics(side)
    return walk_corpus(spark, docs, words, {2 * side: list(range(2 * side))}, side * side, alpha=alpha, topic=lambda n: topics[n] if n < 2 * side else np.full(side * side, side**-2.0), seed=seed)


def draw_spectra(spark: SparkSession, rows: int, compounds: list[tuple[float, list[tuple[float, float, float, float, float, float]]]], xs: list[float], seed: int = 0) -> DataFrame:
    """(id, xs, ys): sums of bell curves. A compound is its abundance and its peaks, each with mean and deviation of the logarithms of place, height and width."""

    def write(batches):
        import pandas as pd

        x = np.array(xs, float)
        for batch in batches:
            out = []
            for i in batch["id"]:
                r, y = np.random.default_rng([seed, int(i)]), np.zeros(len(x))
                for abundance, peaks in compounds:
                    for p in peaks:
                        place, height, width = (r.lognormal(p[a], p[a + 1]) for a in (0, 2, 4))
                        y += abundance * height * np.exp(-0.5 * ((x - place) / width) ** 2)
                out.append(y.tolist())
            yield pd.DataFrame({"id": batch["id"], "xs": [x.tolist()] * len(out), "ys": out})

    return spark.range(rows).mapInPandas(write, "id long, xs array<double>, ys array<double>")


def uniform_density(x: F.Column, low: float, high: float) -> F.Column:
    """Density of the uniform distribution on [low, high]."""
    if not low < high:
        raise ValueError("low must be below high")
    return F.when(x.isNull(), None).otherwise(F.when((x >= low) & (x <= high), 1.0 / (high - low)).otherwise(0.0))


_TREE = {0: [1, 2], 1: [3, 4], 2: [5, 6]}


@CATALOG.query("simulate_leaf_walk")
def _leaf(spark, sf_dir):
    return walk_corpus(spark, 50, 40, _TREE, 30)


@CATALOG.query("simulate_path_walk")
def _path(spark, sf_dir):
    return walk_corpus(spark, 50, 40, _TREE, 30, stop="path")


@CATALOG.query("simulate_exit_walk")
def _exit(spark, sf_dir):
    return walk_corpus(spark, 50, 40, _TREE, 30, stop="exit")


@CATALOG.query("simulate_nested")
def _nested(spark, sf_dir):
    return nested_corpus(spark, 50, 40, 30)


@CATALOG.query("simulate_grid")
def _grid(spark, sf_dir):
    return grid_corpus(spark, 50, 40)


@CATALOG.query("simulate_spectra")
def _spectra(spark, sf_dir):
    peak = lambda at, height: (float(np.log(at)), 0.05, float(np.log(height)), 0.05, float(np.log(0.1)), 1e-6)
    return draw_spectra(spark, 20, [(1.0, [peak(1, 10), peak(2, 15)]), (1.0, [peak(3, 20), peak(4, 25)])], [i / 20 for i in range(100)])
