"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction has a state h that its update gate moves towards a candidate:
a = E[byte] + h U, z = (1 + s(a_z)) / 2, h <- h + z (s(a_c) - h), with s the softsign. Both states of a position
give its language probabilities; a document's are the mean over all its bytes. Training is backpropagation through time with Adam.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.sampling import least_by_hash_within
from spindrel.llm.shingles import slices

#: Units of each direction; bytes that are read before the states start afresh; parts of texts read at once.
UNITS, WINDOW, LANES = 8, 256, 2048
#: Texts of the training sample at most, parts taken of each, and code points of a part.
SAMPLE, PARTS, PART = 3000, 3, 90
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _softsign(a: np.ndarray, room: np.ndarray) -> None:
    np.abs(a, out=room)
    room += 1
    a /= room


def _run(table: np.ndarray, u: np.ndarray, x: np.ndarray, order: range, keep: bool = False):
    """Yields (t, state after byte t), or with keep (t, state before, softsigns, gate, state after); x is (time, lane)."""
    lanes, units = x.shape[1], u.shape[0]
    h = np.zeros((lanes, units), u.dtype)
    a, room, add = (np.empty((lanes, 2 * units), u.dtype) for _ in range(3))
    for t in order:
        np.take(table, x[t], axis=0, out=a, mode="clip")
        np.matmul(h, u, out=add)
        a += add
        _softsign(a, room)
        z = a[:, :units] * 0.5
        z += 0.5
        step = a[:, units:] - h
        step *= z
        if keep:
            before, h = h, h + step
            yield t, before, a.copy(), z, h
        else:
            h += step
            yield t, h


class Network:
    def __init__(self, languages: list[str], seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.languages, c = languages, len(languages)
        f = lambda *shape, scale=0.3: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"Ef": f(256, 2 * UNITS), "Uf": f(UNITS, 2 * UNITS), "Eb": f(256, 2 * UNITS), "Ub": f(UNITS, 2 * UNITS), "Vf": f(UNITS, c), "Vb": f(UNITS, c), "b": np.zeros(c, np.float32)}

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradient; x: (time, lane) bytes, y: language of each lane, w: (time, lane) weights of the positions."""
        p, steps = self.p, len(x)
        fw = list(_run(p["Ef"], p["Uf"], x, range(steps), True))
        bw = list(_run(p["Eb"], p["Ub"], x, range(steps - 1, -1, -1), True))[::-1]
        hf, hb = np.stack([s[4] for s in fw]), np.stack([s[4] for s in bw])
        logits = hf @ p["Vf"] + hb @ p["Vb"] + p["b"]
        logits -= logits.max(-1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(-1, keepdims=True)
        lanes = np.arange(x.shape[1])
        loss = float(-(np.log(q[:, lanes, y] + 1e-9) * w).sum())
        d = q
        d[:, lanes, y] -= 1
        d *= w[:, :, None]
        g = {"Vf": np.tensordot(hf, d, ((0, 1), (0, 1))), "Vb": np.tensordot(hb, d, ((0, 1), (0, 1))), "b": d.sum((0, 1))}
        for k, states, order in (("f", fw, range(steps - 1, -1, -1)), ("b", bw, range(steps))):
            u, out = p["U" + k], d @ p["V" + k].T
            gu, ge, dh = np.zeros_like(u), np.zeros_like(p["E" + k]), np.zeros((x.shape[1], UNITS), np.float32)
            for t in order:
                _, before, s, z, _ = states[t]
                dh = dh + out[t]
                slope = (1 - np.abs(s)) ** 2
                da = np.concatenate((dh * (s[:, UNITS:] - before) * 0.5, dh * z), 1) * slope
                gu += before.T @ da
                np.add.at(ge, x[t], da)
                dh = dh * (1 - z) + da @ u.T
            g["U" + k], g["E" + k] = gu, ge
        return loss, g

    def fit(self, parts: list[tuple[bytes, int]], rounds: int = 400, lanes: int = 192, seed: int = 5) -> None:
        """Adam over random lanes; each language has the same weight."""
        r = np.random.default_rng(seed)
        longest = max(1, min(WINDOW, max((len(b) for b, _ in parts), default=1)))
        x = np.zeros((len(parts), longest), np.uint8)
        for i, (b, _) in enumerate(parts):
            x[i, : len(b)] = np.frombuffer(b[:longest], np.uint8)
        y, n = np.array([k for _, k in parts]), np.array([min(len(b), longest) for b, _ in parts])
        weight = 1 / np.maximum(1, np.bincount(y, minlength=len(self.languages)))
        chance = weight[y] / weight[y].sum()
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            i = r.choice(len(parts), lanes, p=chance)
            w = (np.arange(longest)[:, None] < n[i]).astype(np.float32) / max(1, n[i].sum())
            _, g = self.gradient(np.ascontiguousarray(x[i].T), y[i], w)
            rate = 0.03 * min(1, step / 20) * (1 - step / (rounds + 1))
            for k, a in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                a -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def windows(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(lane, language) sums of the positions' probabilities; x: (time, lane) bytes, n: bytes of each lane."""
        p = self.p
        back = np.empty((len(x), x.shape[1], len(self.languages)), np.float32)
        for t, h in _run(p["Eb"], p["Ub"], x, range(len(x) - 1, -1, -1)):
            np.matmul(h, p["Vb"], out=back[t])
        back += p["b"]
        out = np.zeros(back.shape[1:], np.float32)
        for t, h in _run(p["Ef"], p["Uf"], x, range(len(x))):
            q = back[t]
            q += h @ p["Vf"]
            np.exp(q, out=q)  # states are within 1, so sums stay far from overflow
            q *= ((t < n) / (q @ np.ones(q.shape[1], np.float32)))[:, None].astype(np.float32)
            out += q
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(text, language), the mean over all bytes of each text; zeros for an empty one."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // WINDOW)
        total, out = int(lanes.sum()), np.zeros((len(texts), len(self.languages)))
        x = np.zeros((total, WINDOW), np.uint8)
        flat, at = x.reshape(-1), 0
        for t, k in zip(texts, lanes.tolist()):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += k * WINDOW
        doc = np.repeat(np.arange(len(texts)), lanes)
        n = np.minimum(WINDOW, sizes[doc] - WINDOW * (np.arange(total) - (np.cumsum(lanes) - lanes)[doc]))
        for a in range(0, total, LANES):
            part = self.windows(np.ascontiguousarray(x[a : a + LANES].T), n[a : a + LANES])
            np.add.at(out, doc[a : a + LANES], part)
        return out / np.maximum(1, out.sum(1, keepdims=True))


def held_out(id_col: str = "doc_id", mod: int = 3, rest: int = 1):
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from (doc_id, text, lang) rows: parts of at most ``sample`` texts, within each language the ones with the least hash of id and text.

    The languages are those of all rows whose text has a letter, however few; the sample is shared out evenly among them (more languages than ``sample`` have a text each).
    """
    known = labelled.where("lang is not null").select("doc_id", "text", "lang").where("text rlike '\\\\p{L}'")
    some = least_by_hash_within(known, "lang", ["doc_id", "text"], sample).withColumn("h", F.xxhash64("text"))
    starts = [F.substring("text", F.expr(f"1 + cast(pmod(h, greatest(1, length(text) - {PART})) * {k} / {max(1, PARTS - 1)} as int)"), F.lit(PART)) for k in range(PARTS)]
    rows = some.select("lang", F.array(*starts).alias("parts")).collect()
    rows.sort(key=lambda r: (r["parts"], r["lang"]))
    languages = sorted({r["lang"] for r in rows}) or [UNDETERMINED]
    number = {k: i for i, k in enumerate(languages)}
    parts = [(p.lower().encode(), number[r["lang"]]) for r in rows for p in r["parts"] if _LETTER.search(p)]
    network = Network(languages)
    if parts and len(languages) > 1:
        network.fit(parts)
    return network


def _predict(batches: Iterator[pa.RecordBatch], network: Network, at: int, kept: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, whole.schema.names[at]):
            texts = batch.column(at).to_pylist()
            known = [bool(t) and _LETTER.search(t) is not None for t in texts]
            p = network.probabilities([t.lower().encode() if k else b"" for t, k in zip(texts, known)])
            best = p.argmax(1)
            langs = [network.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known)]
            scores = np.where(known, np.clip(p[np.arange(len(texts)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:kept], "lang_pred", "score"])


def identify(docs: DataFrame, network: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score (probability of lang_pred, pooled over every byte of the text).

    A text that is null or has no letter gets ``und`` and 0. Texts are read whole, in lower case; an empty docs gives no rows.
    """
    at, extra = (keep.index(text_col), 0) if text_col in keep else (len(keep), 1)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{text_col}`").cast("string").alias("__text")] * extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]) + ", lang_pred string, score double"
    return rows.mapInArrow(lambda it: _predict(it, network, at, len(keep)), schema)
