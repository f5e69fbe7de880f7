"""Main text of web pages: a recurrent labeller of blocks.

A page is cut into blocks, the leaf sequences of text between block-level tags. Each block becomes a vector from hashed tokens of its tag path
(tags, classes, ids, roles), its hashed words, and a few numbers; a bidirectional LSTM in numpy reads a page's vectors in both directions and
says of each block, with the whole page as context, whether it is main text. It is trained by backpropagation through time on pages that are made here, with
many names and orders of menus, notices, adverts, comments and so on.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.shingles import slices, word_hashes

#: Buckets of path and word tokens, units of a direction, width of a block's vector.
PATHS, WORDS, UNITS, WIDTH = 1024, 512, 16, 24
_NUMBERS = 6
#: Tokens of blocks that are embedded at once, and blocks (of several pages, padding included) that are read at once; a longer page is read by itself.
TOKENS, CELLS = 1 << 20, 1 << 13
#: A comment, a tag with its attributes, or other markup. A quote opens a quoted value only straight after the equals sign, as in browsers; groups never give back
#: what they took, so matching is linear. A tag that the page's end cuts off counts as one.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?>[\s/]++|[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)|\Z))?+)*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)|<\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[0-9]+")
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
HIDDEN = set("script style head title noscript template svg iframe object canvas select option textarea button audio video math map datalist".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img td th output meter progress".split())
#: Opening one of these ends an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What may stand in a head; any other tag, and text, ends a head that is still open.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Block:
    """text with white space made single; path: buckets of the elements around it; tag: the nearest that isn't inline; linked: its code points inside links."""

    __slots__ = ("linked", "path", "tag", "text")

    def __init__(self, text: str, path: tuple[int, ...], tag: str, linked: int) -> None:
        self.text, self.path, self.tag, self.linked = text, path, tag, linked


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % PATHS


def _names_of(tag: str, attributes: str) -> tuple[int, ...]:
    """Buckets of one element: its tag, and the words of its class, id and role."""
    out = [tag]
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        out += [f"{'role:' if k.lower() == 'role' else ''}{t.lower()}" for t in _TOKEN.findall(a or b or c)]
    return tuple(dict.fromkeys(map(_bucket, out)))


_short_names = lru_cache(maxsize=4096)(_names_of)


def _names(tag: str, attributes: str) -> tuple[int, ...]:
    return _short_names(tag, attributes) if len(attributes) < 500 else _names_of(tag, attributes)


class _Open:
    """An open element: its tag, the buckets of it and all around it (each once, so never more than PATHS), and the nearest tag that isn't inline."""

    __slots__ = ("block", "path", "tag")

    def __init__(self, tag: str, names: tuple[int, ...], around: "_Open | None") -> None:
        path, self.tag = around.path if around else (), tag
        new = tuple(n for n in names if n not in path)
        self.path = path + new if new else path
        self.block = tag if tag not in INLINE else around.block if around else "body"


class _Stack:
    """Open elements, with the places of each tag and of all that aren't inline: no step looks through the whole stack."""

    def __init__(self) -> None:
        self.items: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.hidden = 0

    def push(self, tag: str, names: tuple[int, ...]) -> None:
        for k in (tag,) if tag in INLINE else (tag, "#block"):
            self.places.setdefault(k, []).append(len(self.items))
        self.items.append(_Open(tag, names, self.top))
        self.hidden += tag in HIDDEN

    def pop(self, to: int) -> None:
        while len(self.items) > to:
            tag = self.items.pop().tag
            for k in (tag,) if tag in INLINE else (tag, "#block"):
                self.places[k].pop()
            self.hidden -= tag in HIDDEN

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    @property
    def top(self) -> _Open | None:
        return self.items[-1] if self.items else None


def blocks(page: str) -> list[Block]:
    """The blocks of a whole page in order; unclosed, cut off and misnested tags are taken as browsers do, roughly. Time grows with the page's length, whatever its nesting."""
    out: list[Block] = []
    stack = _Stack()
    words: list[str] = []
    linked = at = 0
    where: _Open | None = None

    def text(part: str) -> None:
        nonlocal linked, where
        if stack.hidden and stack.top.tag == "head" and part.strip():
            stack.pop(len(stack.items) - 1)
        if part and not stack.hidden:
            if not words or where is None:
                where = stack.top
            words.append(part)
            if stack.places.get("a"):
                linked += len(part.strip())

    def close() -> None:
        nonlocal linked, where
        if words:
            t = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            if t:
                out.append(Block(t, where.path if where else (), where.block if where else "body", min(linked, len(t))))
            words.clear()
        linked, where = 0, None

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        end, tag = m["end"], m["name"].lower()
        block = tag not in INLINE
        if stack.hidden and stack.top.tag == "head" and (tag in ("body", "html", "br") if end else tag not in IN_HEAD):
            stack.pop(len(stack.items) - 1)
        if tag in ("br", "td", "th"):
            text(" ")
        if block and not stack.hidden:
            close()
        if end:
            if (i := stack.last(tag)) >= 0:
                stack.pop(i)
            continue
        if tag in VOID:
            continue
        if block and tag not in HIDDEN:  # an open paragraph, with what is open in it, ends here
            i = stack.last("#block")
            if i >= 0 and stack.items[i].tag == "p":
                stack.pop(i)
        if tag in ENDS and (i := stack.last(*ENDS[tag])) > stack.last(*_HOLDS[tag]):
            stack.pop(i)
        if m["attributes"].endswith("/") and tag in ("svg", "math", "script"):
            continue
        stack.push(tag, _names(tag, m["attributes"]))
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.start() if stop else len(page)
    text(page[at:])
    close()
    return out


_MARKS = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def places(pages: list[list[Block]]) -> np.ndarray:
    """Of each block of all pages, the share of its page's blocks that stand before it."""
    size = np.array([len(p) for p in pages])
    return (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) / np.repeat(size, size)


def features(pages: list[list[Block]], place: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each page (block, bucket, weight) of its tokens, by block, and (block, number); all words of a block count. ``place`` stands for places(pages) where the blocks are parts of pages."""
    flat = [b for p in pages for b in p]
    raw = [b.text.encode("utf-8", "surrogatepass") for b in flat]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    h, of = word_hashes(b"".join(raw).translate(_MARKS), offsets)
    words = np.bincount(of, minlength=len(flat))
    key, times = np.unique(of * WORDS + (h % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    paths = [(*b.path, _bucket("leaf:" + b.tag)) for b in flat]
    block = np.concatenate((np.repeat(np.arange(len(flat)), [len(x) for x in paths]), key // WORDS))
    bucket = np.concatenate((np.fromiter((x for p in paths for x in p), np.int64), PATHS + key % WORDS))
    weight = np.concatenate((np.full(len(block) - len(key), 0.7), 2 * times / words[key // WORDS])).astype(np.float32)
    order = np.argsort(block, kind="stable")
    block, bucket, weight = block[order], bucket[order], weight[order]
    chars = np.array([len(b.text) for b in flat], np.float32)
    marks = np.array([sum(map(b.text.count, ".!?,;")) for b in flat], np.float32)
    linked = np.array([b.linked for b in flat], np.float32)
    size = np.array([len(p) for p in pages])
    ends = np.cumsum(size)
    place = places(pages) if place is None else place
    numbers = np.column_stack((np.log1p(chars) / 8, linked / chars, np.log1p(words) / 6, np.minimum(marks / chars * 5, 0.3), place, np.ones(len(flat)))).astype(np.float32)
    cuts = np.searchsorted(block, np.concatenate(([0], ends)))
    return [(block[a:b] - (e - n), bucket[a:b], weight[a:b], numbers[e - n : e]) for a, b, e, n in zip(cuts, cuts[1:], ends.tolist(), size.tolist())]


class Labeller:
    """Block vector x = tanh(path and word embeddings + numbers), a BiLSTM over x, and a probability from both states."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale=0.2: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"E": f(PATHS + WORDS, WIDTH), "N": f(_NUMBERS, WIDTH), "v": f(2 * UNITS + WIDTH), "c": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {"W" + k: f(WIDTH, 4 * UNITS), "U" + k: f(UNITS, 4 * UNITS), "d" + k: np.repeat(np.float32([0, 1, 0, 0]), UNITS)}

    def vectors(self, pages):
        """(time, page, WIDTH) vectors, the mask of real blocks, and what the gradient needs."""
        steps = max(len(f[3]) for f in pages)
        a = np.zeros((len(pages), steps, WIDTH), np.float32)
        mask = np.zeros((steps, len(pages)), bool)
        for j, (block, bucket, weight, numbers) in enumerate(pages):  # every block has tokens
            a[j, : len(numbers)] = np.add.reduceat(self.p["E"][bucket] * weight[:, None], np.searchsorted(block, np.arange(len(numbers)))) + numbers @ self.p["N"]
            mask[: len(numbers), j] = True
        return np.tanh(a.transpose(1, 0, 2)), mask

    def direction(self, k: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States of one direction for all steps; a page's state stays zero until its first block."""
        p, steps = self.p, len(x)
        h, c = (np.zeros((x.shape[1], UNITS), np.float32) for _ in range(2))
        into = x @ p["W" + k] + p["d" + k]
        out, kept = np.empty((steps, x.shape[1], UNITS), np.float32), {}
        for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
            a = into[t] + h @ p["U" + k]
            s = 1 / (1 + np.exp(-a[:, : 3 * UNITS]))
            i, f, o = s[:, :UNITS], s[:, UNITS : 2 * UNITS], s[:, 2 * UNITS :]
            g, m = np.tanh(a[:, 3 * UNITS :]), mask[t][:, None]
            old = (h, c)
            c = (f * c + i * g) * m
            tc = np.tanh(c)
            h = o * tc * m
            out[t] = h
            if keep:
                kept[t] = (*old, s, g, tc)
        return (out, kept) if keep else out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        p = self.p
        return np.concatenate((self.direction("f", x, mask), self.direction("b", x, mask), x), 2) @ p["v"] + p["c"]

    def gradient(self, pages, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy over all blocks and its gradient; labels: (time, page)."""
        p = self.p
        x, mask = self.vectors(pages)
        hf, kf = self.direction("f", x, mask, True)
        hb, kb = self.direction("b", x, mask, True)
        top = np.concatenate((hf, hb, x), 2)
        q = 1 / (1 + np.exp(-(top @ p["v"] + p["c"])))
        n = mask.sum()
        loss = float(-(np.log(np.where(labels, q, 1 - q) + 1e-9) * mask).sum() / n)
        d = (q - labels) * mask / n
        g = {k: np.zeros_like(a) for k, a in p.items()}
        g["v"], g["c"] = np.tensordot(d, top, 2), d.sum(keepdims=True).reshape(1)
        dtop = d[:, :, None] * p["v"]
        dx = dtop[:, :, 2 * UNITS :].copy()
        for k, kept, dh_all, order in (("f", kf, dtop[:, :, :UNITS], range(len(x) - 1, -1, -1)), ("b", kb, dtop[:, :, UNITS : 2 * UNITS], range(len(x)))):
            dh = dc = np.zeros((x.shape[1], UNITS), np.float32)
            for t in order:
                h0, c0, s, gg, tc = kept[t]
                m = mask[t][:, None]
                i, f, o = s[:, :UNITS], s[:, UNITS : 2 * UNITS], s[:, 2 * UNITS :]
                dh = (dh + dh_all[t]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                ds = np.concatenate((dc * gg, dc * c0, dh * tc), 1) * s * (1 - s)
                da = np.concatenate((ds, dc * i * (1 - gg * gg)), 1)
                g["U" + k] += h0.T @ da
                g["W" + k] += x[t].T @ da
                g["d" + k] += da.sum(0)
                dx[t] += da @ p["W" + k].T
                dh, dc = da @ p["U" + k].T, dc * f
        da = (dx * (1 - x * x)).transpose(1, 0, 2)
        bucket = np.concatenate([f[1] for f in pages])
        each = np.concatenate([da[j][block] * weight[:, None] for j, (block, _, weight, _) in enumerate(pages)])
        order = np.argsort(bucket, kind="stable")
        known, first = np.unique(bucket[order], return_index=True)
        g["E"][known] = np.add.reduceat(each[order], first)
        for j, f in enumerate(pages):
            g["N"] += f[3].T @ da[j, : len(f[3])]
        return loss, g

    def fit(self, pages, labels: list[np.ndarray], rounds: int = 2000, batch: int = 24, seed: int = 9) -> float:
        """Adam; what is kept is a running mean of the weights, which errs less than the last ones."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        mean = {k: a.copy() for k, a in self.p.items()}
        loss = 0.0
        for step in range(1, rounds + 1):
            some = r.integers(0, len(pages), batch)
            y = np.zeros((max(len(labels[j]) for j in some), batch), bool)
            for i, j in enumerate(some):
                y[: len(labels[j]), i] = labels[j]
            loss, g = self.gradient([pages[j] for j in some], y)
            rate = 0.02 * min(1, step / 20) * (1 - step / (rounds + 1))
            for k, a in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                a -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
                mean[k] += max(1 / step, 0.01) * (a - mean[k])
        self.p = mean
        return loss

    def rows(self, flat: list[Block], place: np.ndarray) -> np.ndarray:
        """(block, WIDTH) vectors, made from so many blocks at once that their tokens stay few."""
        out, a = np.empty((len(flat), WIDTH), np.float32), 0
        while a < len(flat):
            b, size = a, 0
            while b < len(flat) and (b == a or size < TOKENS):
                size += len(flat[b].path) + len(flat[b].text) // 4 + 8
                b += 1
            [(block, bucket, weight, numbers)] = features([flat[a:b]], place[a:b])
            starts = np.searchsorted(block, np.arange(b - a))
            out[a:b] = np.tanh(np.add.reduceat(self.p["E"][bucket] * weight[:, None], starts) + numbers @ self.p["N"])
            a = b
        return out

    def main(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Whether each block of each page is main text. Pages of like lengths are read together, as many as fit CELLS blocks, the padding included."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            n = next((k for k in range(1, len(order)) if (k + 1) * len(pages[order[k]]) > CELLS), len(order))
            some, order = order[:n], order[n:]
            group = [pages[i] for i in some]
            size = np.array([len(p) for p in group])
            x = np.zeros((int(size.max()), len(group), WIDTH), np.float32)
            mask = np.arange(len(x))[:, None] < size
            x.transpose(1, 0, 2)[mask.T] = self.rows([b for p in group for b in p], places(group))
            keep = self.logits(x, mask) > 0
            for j, i in enumerate(some):
                out[i] = keep[: size[j], j].tolist()
        return out


# Names that the made pages give to their parts.
_PARTS = {
    "menu": ["nav", "menu", "navbar", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "site-nav", "navigation", "primary-menu", "links", "pagination", "pager", "toc"],
    "header": ["header", "site-header", "masthead", "top-bar", "topbar", "branding", "logo", "banner-top", "page-header", "hero"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "colophon", "legal", "page-footer", "credits", "foot"],
    "sidebar": ["sidebar", "aside", "widget", "related", "related-posts", "recommended", "secondary", "rail", "right-col", "trending", "most-read", "tags", "author-box", "see-also"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "disclaimer", "cookie-notice", "message", "paywall", "warning"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor", "adbox", "google-ad", "promotion", "commercial"],
    "form": ["form", "login", "newsletter", "subscribe", "signup", "search", "search-form", "contact-form", "register", "share", "social", "share-buttons", "newsletter-box"],
    "comments": ["comments", "comment", "comment-list", "responses", "discussion", "disqus", "respond", "replies", "reader-comments", "comment-body", "user-comments"],
}
_MAIN = ["article", "content", "main-content", "post", "entry", "entry-content", "post-body", "story", "article-body", "main", "text", "post-content", "body", "page-content", "story-body", "single"]
_SAYS = {
    "menu": "home about contact news sports menu login archive products services help",
    "header": "welcome site daily your online journal search",
    "footer": "copyright all rights reserved privacy policy terms of use imprint contact",
    "sidebar": "related popular read more recent posts tags categories trending about the author",
    "notice": "we use cookies to improve accept consent privacy settings this site",
    "advert": "advertisement sponsored buy now offer sale discount free shipping deal",
    "form": "subscribe email newsletter sign up name password submit send login search share",
    "comments": "reply says posted ago comment like report user great thanks i agree",
}
_TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "advert": ["div", "aside", "section"], "form": ["form", "div", "section"], "comments": ["section", "div", "ol"]}


def made_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks; part names, words, lengths and order are drawn anew."""
    syllables = ["ra", "to", "ne", "li", "ves", "ond", "ka", "mer", "si", "quo", "the", "an", "ing", "er", "és", "ü", "ción"]
    pick = lambda x: x[int(r.integers(len(x)))]
    word = lambda: "".join(pick(syllables) for _ in range(int(r.integers(1, 4))))

    def prose(n: int) -> str:
        out = []
        for i in range(n):
            w = word()
            out.append((w.capitalize() if i == 0 or out[-1].endswith(".") else w) + (pick([".", ",", "", "", "", "", "", ""])))
        return " ".join(out).rstrip(",.") + pick([".", ".", "."])

    def attributes(names: list[str], sure: float) -> str:
        if r.random() > sure:
            return "" if r.random() < 0.6 else f' class="{word()}"'
        c = pick(names)
        if r.random() < 0.3:
            c += pick([" ", "-", "_"]) + word()
        if r.random() < 0.15:
            c = pick(["wrap", "container", "row", "box", "block", word()]) + " " + c
        return f' {pick(["class", "class", "class", "id"])}="{c}"'

    def item(kind: str) -> str:
        said = _SAYS[kind].split()
        n = int(r.integers(1, 5)) if kind in ("menu", "header", "form") else int(r.integers(2, 14)) if kind != "comments" else int(r.integers(3, 40))
        out = " ".join(pick(said) if r.random() < (0.6 if r.random() < 0.5 else 0.0) else word() for _ in range(n))
        return (out.capitalize() if r.random() < 0.4 else out) + pick(["", "", "", ".", ",", ":"])

    def part(kind: str) -> str:
        tag = pick(_TAGS[kind])
        own = tag not in ("div", "section", "ul", "ol")
        inside = []
        for _ in range(int(r.integers(1, 8 if kind in ("menu", "comments", "sidebar") else 3))):
            t = item(kind)
            link = r.random() < {"menu": 0.95, "sidebar": 0.6, "footer": 0.4, "header": 0.4, "advert": 0.4}.get(kind, 0.1)
            t = f'<a href="/{word()}">{t}</a>' if link else t
            if kind == "comments":
                t = pick([f"<p>{t}</p>", f'<div class="comment"><p>{prose(int(r.integers(3, 50)))}</p></div>', f"<li><p>{prose(int(r.integers(3, 30)))}</p></li>", f'<article class="comment"><p>{prose(int(r.integers(3, 30)))}</p></article>'])
            elif kind == "form":
                t = pick([f"<label>{t}</label><input name=q>", f"<p>{t}</p><button>{word()}</button>", f"<p>{t}</p>"])
            elif kind in ("menu", "sidebar") and tag != "ul":
                t = pick([f"<ul><li>{t}</li></ul>", t if kind == "sidebar" else f"<ul><li>{t}</li></ul>", f"<h3>{item(kind)}</h3><p>{t}</p>" if kind == "sidebar" else f"<span>{t}</span>", f"<p>{t}</p>"])
            else:
                t = f"<li>{t}</li>" if tag in ("ul", "ol") else pick([f"<p>{t}</p>", t, f"<div>{t}</div>"])
            inside.append(t)
        if kind in ("notice", "advert") and r.random() < 0.4:
            inside = [prose(int(r.integers(2, 30)))]
        if kind == "footer" and r.random() < 0.6:
            inside = [f"&copy; {word()}.example.net &middot; {prose(int(r.integers(1, 10)))}"]
        return f"<{tag}{attributes(_PARTS[kind], 0.35 if own else 1.0)}>{''.join(inside)}</{tag}>"

    main, texts = [], []

    def say(t: str, shape: str) -> None:
        texts.append(html.unescape(re.sub(r"<[^>]*>", "", t)))
        main.append(shape.format(t))

    if r.random() < 0.85:
        say(prose(int(r.integers(1, 9))), pick(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]))
    for _ in range(int(r.integers(15, 50) if r.random() < 0.08 else r.integers(1, 14))):
        n = int(r.integers(1, 8 if r.random() < 0.6 else 3)) if r.random() < 0.4 else int(r.integers(5, 120))
        t = prose(n)
        if r.random() < 0.12:  # articles speak of the same things too, so words alone decide nothing
            said = " ".join(_SAYS.values()).split()
            t = " ".join(pick(said) if r.random() < 0.7 else word() for _ in range(n)).capitalize() + "."
        elif r.random() < 0.04:  # a word said again and again
            t = f"{word()} " + f"{word()} " * int(r.integers(5, 60))
        if r.random() < 0.2:
            t = f'{t} <a href="/x">{word()}</a> {word()}'
        say(t, pick(["<p>{}</p>"] * 14 + ["<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<p><b>{}<br>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>"]))
    if r.random() < 0.25:
        at = int(r.integers(len(main) + 1))
        main.insert(at, part(pick(["advert", "sidebar", "form", "notice"])))
    tag = pick(["article", "article", "article", "main", "div", "section"])
    body = f"<{tag}{attributes(_MAIN, 0.5 if tag in ('article', 'main') else 1.0)}>{''.join(main)}</{tag}>"
    if r.random() < 0.3:
        body = f"<main{attributes(_MAIN, 0.3)}>{body}{part('comments') if r.random() < 0.4 else ''}</main>"
    if r.random() < 0.3:
        body = f'<div class="{pick(["wrapper", "container", "page", "layout", word()])}">{body}{part("sidebar") if r.random() < 0.5 else ""}</div>'
    top = [part(k) for k in ("header", "menu", "notice", "advert", "form") if r.random() < 0.55]
    low = [part(k) for k in ("comments", "sidebar", "advert", "form", "notice", "footer") if r.random() < 0.5]
    r.shuffle(top)
    end = "</body></html>" if r.random() < 0.9 else ""
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{''.join(top)}{body}{''.join(low)}{end}", texts


@lru_cache(maxsize=1)
def trained(pages: int = 2400, seed: int = 1) -> Labeller:
    """The labeller after training on made pages; the same for every call and table."""
    r = np.random.default_rng(seed)
    data, labels = [], []
    for _ in range(pages):
        page, texts = made_page(r)
        found, known = blocks(page), {_SPACE.sub(" ", t).strip() for t in texts}
        if found:
            data.append(found)
            labels.append(np.array([b.text in known for b in found]))
    model = Labeller()
    model.fit(features(data), labels)
    return model


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page: its main blocks in page order with an empty line between them."""
    found = [blocks(p or "") for p in pages]
    return ["\n\n".join(b.text for b, k in zip(p, keep) if k) for p, keep in zip(found, model.main(found))]


def _extract(batches: Iterator[pa.RecordBatch], model: Labeller, kept: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, whole.schema.names[kept], 2 << 20):
            texts = extract(batch.column(kept).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:kept], "text", "n_chars"])


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """The columns ``keep`` of pages with text (empty if the page has no main text) and n_chars, its code points.

    Null pages are empty; whole pages are read; repeated rows are rows like others; an empty table gives no rows. Columns of pages named like the results are read under other names.
    """
    model = model or trained()
    names = [f"c{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string"))
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, rows.schema.fields)) + ", text string, n_chars long"
    return rows.toDF(*names, "page").mapInArrow(lambda it: _extract(it, model, len(keep)), schema)
