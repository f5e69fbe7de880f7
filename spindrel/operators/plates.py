"""Models of random variables over plates: declared on names and index sets, drawn forward as tables, printed as a log joint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.plans.catalog import Catalog

CATALOG = Catalog()


@dataclass(frozen=True)
class Ref:
    """A variable at some indexes, each the name of a plate or another Ref whose value is the index: Ref("topic", Ref("z", "doc", "slot"))."""

    name: str
    at: tuple

    def __init__(self, name: str, *at) -> None:
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "at", at)

    def __str__(self) -> str:
        return self.name + (f"[{', '.join(map(str, self.at))}]" if self.at else "")


class PlateModel:
    """``sets`` gives the size of each plate. A variable is added after nothing in particular: what it refers to is looked up when it is drawn, and a circle of references is an error.

    A variable's table has a column for each of its plates and ``value``. Each reference is one join on its indexes; draws come from (seed, variable, indexes), so they repeat.
    """

    def __init__(self, sets: dict[str, int], seed: int = 0) -> None:
        self.sets, self.seed, self.variables = sets, seed, {}

    def _add(self, name: str, over: tuple[str, ...], kind: str, args: tuple, f=None) -> Ref:
        if name in self.variables:
            raise ValueError(f"{name} is there already")
        if unknown := [p for p in over if p not in self.sets]:
            raise ValueError(f"unknown plates {unknown}")
        inside = {p for a in args if isinstance(a, Ref) for p in self._plates(a)}
        if inside - set(over):
            raise ValueError(f"{name} refers to plates that it doesn't lie in: {sorted(inside - set(over))}")
        self.variables[name] = (over, kind, args, f)
        return Ref(name, *over)

    def _plates(self, ref: Ref) -> set[str]:
        return {q for a in ref.at for q in (self._plates(a) if isinstance(a, Ref) else [a])}

    def constant(self, name: str, value, *over: str) -> Ref:
        return self._add(name, over, "constant", (), value)

    def dirichlet(self, name: str, alpha: Ref, *over: str) -> Ref:
        """Shares drawn with the weights of an array."""
        return self._add(name, over, "dirichlet", (alpha,))

    def categorical(self, name: str, p: Ref, *over: str) -> Ref:
        """A place in an array of shares."""
        return self._add(name, over, "categorical", (p,))

    def deterministic(self, name: str, f: Callable[..., Column], args: list[Ref], *over: str) -> Ref:
        """A function of columns, applied to what it refers to."""
        return self._add(name, over, "deterministic", tuple(args), f)

    def sample(self, spark: SparkSession, *wanted: str) -> dict[str, DataFrame]:
        """The tables of the wanted variables, of one draw."""
        made: dict[str, DataFrame] = {}

        def value(df: DataFrame, ref: Ref, out: str, open_now: tuple) -> DataFrame:
            """df with the value of ref in the column out."""
            table = draw(ref.name, open_now)
            over = self.variables[ref.name][0]
            if len(over) != len(ref.at):
                raise ValueError(f"{ref} needs {len(over)} indexes")
            names = [f"{out}_{i}" for i in range(len(over))]
            for n, a in zip(names, ref.at):
                df = value(df, a, n, open_now) if isinstance(a, Ref) else df.withColumn(n, F.col(a))
            right = table.select(*[F.col(p).alias(n) for p, n in zip(over, names)], F.col("value").alias(out))
            return (df.join(right, names) if names else df.crossJoin(F.broadcast(right))).drop(*names)  # without indexes it is one row

        def draw(name: str, open_now: tuple) -> DataFrame:
            if name in made:
                return made[name]
            if name not in self.variables:
                raise ValueError(f"unknown variable {name}")
            if name in open_now:
                raise ValueError(f"a circle of references: {' -> '.join((*open_now, name))}")
            over, kind, args, f = self.variables[name]
            size, step = int(np.prod([self.sets[p] for p in over], dtype=np.int64)), 1
            df = spark.range(size)
            for p in reversed(over):
                df = df.withColumn(p, F.expr(f"(id div {step}L) % {self.sets[p]}L"))
                step *= self.sets[p]
            for i, a in enumerate(args):
                df = value(df, a, f"__arg{i}", (*open_now, name))
            # hashes as fractions: one for a categorical draw, a seed for the rest
            hashed = F.xxhash64(F.lit(self.seed), F.lit(name), "id")
            if kind == "constant":
                out = F.array(*[F.lit(float(x)) for x in f]) if isinstance(f, (list, tuple, np.ndarray)) else F.lit(f)
            elif kind == "deterministic":
                out = f(*[F.col(f"__arg{i}") for i in range(len(args))])
            elif kind == "categorical":
                u = F.pmod(hashed, F.lit(1 << 53)) / F.lit(float(1 << 53))
                passed = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["k"] + (a["s"] + x <= u).cast("long")).alias("k"))
                out = F.least(F.aggregate("__arg0", F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("k")), passed, lambda a: a["k"]), F.size("__arg0").cast("long") - 1)
            else:

                @F.pandas_udf("array<double>")
                def shares(alpha, key):
                    import pandas as pd

                    return pd.Series([np.random.default_rng(int(k) & 0xFFFFFFFFFFFFFFFF).dirichlet(a).tolist() for a, k in zip(alpha, key)])

                out = shares("__arg0", hashed)
            made[name] = df.select(*over, out.alias("value"))
            return made[name]

        return {n: draw(n, ()) for n in wanted}

    def log_joint(self, latex: bool = False) -> str:
        """A line for each random variable, in the order in which they were added, with a sum for each plate."""
        lines = []
        for name, (over, kind, args, _) in self.variables.items():
            me, a = str(Ref(name, *over)), ", ".join(map(str, args))
            body = {"dirichlet": f"log Dirichlet({me} | {a})", "categorical": f"log {a}[{me}]", "deterministic": f"log indicator({me} = f({a}))"}.get(kind)
            if body:
                sums = "".join(f"\\sum_{{{p}=1}}^{{{self.sets[p]}}} " if latex else f"sum_{p} " for p in over)
                lines.append(sums + (body.replace("log ", "\\log ") if latex else body))
        return "\n+ ".join(lines)


def topic_mixture(docs: int, words: int, topics: int, terms: int, seed: int = 0) -> PlateModel:
    """Documents that mix topics: theta[doc], z[doc, slot], phi[topic], w[doc, slot]."""
    m = PlateModel({"doc": docs, "slot": words, "topic": topics}, seed)
    alpha, beta = m.constant("alpha", [0.5] * topics), m.constant("beta", [0.1] * terms)
    theta, phi = m.dirichlet("theta", alpha, "doc"), m.dirichlet("phi", beta, "topic")
    z = m.categorical("z", theta, "doc", "slot")
    m.categorical("w", Ref(phi.name, z), "doc", "slot")
    return m


@CATALOG.query("plate_sample")
def _sample(spark, sf_dir):
    return topic_mixture(50, 40, 4, 30).sample(spark, "w")["w"]
