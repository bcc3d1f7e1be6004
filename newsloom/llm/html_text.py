"""Main text of web pages: a recurrent labeller over the sequence of leaf blocks.

A page is read into leaf blocks, runs of text between the borders of block
elements. Each block enters as hashed vectors of its tag path (tags, classes, ids
and roles of its ancestors), hashed vectors of its words and a few numbers; a
bidirectional LSTM over all blocks of the page labels each as main text or not, so
that every decision sees the whole document. The labelled blocks, joined in page
order, are the text.

The network is trained in numpy on the driver, on ``PAGES`` pages that are laid
out at random here (there are no labelled pages): articles in many kinds of
containers among menus, headers, footers, sidebars, notices, adverts, forms and
comments. Their number is the documented bound of the training sample.

A null html counts as empty; a page without main text gives an empty text. Broken
markup, open tags and blocks of any length are read to their end; an open head ends
where something begins that may not stand in a head. Formulas, drawings and fallback
content of noscript, object and canvas are text like any other, for the labeller to
judge. Elements share the paths of their ancestors, so deeply nested pages take time
in proportion to their length. Rows repeated as
a whole are extracted alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches

PATHS, WORDS = 1 << 14, 1 << 16
SIZE, HIDDEN, NUMBERS = 16, 16, 5
PAGES, EPOCHS, BATCH, RATE = 3500, 4, 32, 0.01
CELLS_AT_ONCE = 1 << 14

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style template title iframe head".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary"
    " table tbody td textarea tfoot th thead tr ul button label".split()
)
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}


def _hash(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


# --- pages as blocks ------------------------------------------------------------


class Path:
    """What an element adds to the tokens (tags, classes, ids, roles) of its ancestors."""

    __slots__ = ("added", "parent")

    def __init__(self, parent: Path | None, added: tuple[str, ...]) -> None:
        self.parent, self.added = parent, added


Block = tuple[str, Path, str, int]


class BlockReader(HTMLParser):
    """Collects (text, path, last token of the path, characters inside links) of the leaf blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.root = Path(None, ())
        self.open: list[tuple[str, tuple[str, ...], Path]] = []
        self.borders: list[int] = []  # places of the open block elements
        self.held: dict[str, int] = {}  # how many open elements have a token
        self.parts: list[str] = []
        self.linked = self.links = self.dropped = 0
        self.path, self.last = self.root, ""

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.path, self.last, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, keep: int) -> None:
        if self.borders and self.borders[-1] >= keep:
            self._flush()
        while len(self.open) > keep:
            tag, names, _ = self.open.pop()
            for name in names:
                self.held[name] -= 1
            self.links -= tag == "a"
            self.dropped -= tag in DROPPED
        while self.borders and self.borders[-1] >= keep:
            self.borders.pop()

    def _end_head(self) -> None:
        if self.held.get("head"):
            self._pop(next(i for i, x in enumerate(self.open) if x[0] == "head"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            if self.borders and (self.open[self.borders[-1]][0] == "p" or self.open[self.borders[-1]][0] in CLOSES.get(tag, ())):
                self._pop(self.borders[-1])
        if tag in VOID:
            return
        names = {tag: None}
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                cleaned = "".join(c if c.isalnum() else " " for c in value.lower())
                names |= {f"{key[0]}:{w}": None for w in cleaned.split()}
        above = self.open[-1][2] if self.open else self.root
        added = tuple(x for x in names if not self.held.get(x))
        for name in names:
            self.held[name] = self.held.get(name, 0) + 1
        if tag in BLOCKS:
            self.borders.append(len(self.open))
        self.open.append((tag, tuple(names), Path(above, added) if added else above))
        self.links += tag == "a"
        self.dropped += tag in DROPPED

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.held.get(tag):
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if self.dropped:
            return
        if not self.parts:
            self.path, self.last = (self.open[-1][2], self.open[-1][1][-1]) if self.open else (self.root, "")
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def blocks_of(html: str) -> list[Block]:
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    reader._flush()
    return reader.blocks


class Features:
    """Blocks as (paths, word hashes, numbers); remembers the hashes of words.

    Paths are, of a page: the parent and the added hashes of every node, parents first,
    and of every block its node, the number of tokens and the hash of the last one.
    """

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, blocks: list[Block]) -> tuple[tuple, list[list[int]], np.ndarray]:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        place: dict[int, int] = {}
        parents, added, tokens = [], [], []
        at, sizes, lasts = [], [], []
        words, numbers = [], np.zeros((len(blocks), NUMBERS), np.float32)
        for i, (text, path, last, linked) in enumerate(blocks):
            new, node = [], path
            while node is not None and id(node) not in place:
                new.append(node)
                node = node.parent
            above = -1 if node is None else place[id(node)]
            for node in reversed(new):
                parents.append(above)
                added.append([_hash(p, PATHS) for p in node.added])
                tokens.append(len(node.added) + (tokens[above] if above >= 0 else 0))
                above = place[id(node)] = len(parents) - 1
            at.append(above)
            sizes.append(tokens[above] + 1)
            lasts.append(_hash(f"^{last}", PATHS))
            split = text.lower().split()
            for w in split:
                if w not in known:
                    known[w] = _hash(w, WORDS)
            words.append([known[w] for w in split])
            ends = sum(text.count(c) for c in ".!?")
            numbers[i] = (
                np.log1p(len(split)) / 5,
                min(1.0, linked / len(text)),
                min(1.0, 5 * ends / (len(split) + 1)),
                i / len(blocks),
                np.log1p(len(blocks)) / 5,
            )
        return (parents, added, at, sizes, lasts), words, numbers


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return np.array([v for x in lists for v in x], np.int64), of


class Paths:
    """The paths of several pages: sums of a table's rows go down from parents to children, gradients up."""

    def __init__(self, pages: list[tuple]) -> None:
        self.parents, added, at, sizes, lasts = [], [], [], [], []
        for parents, more, nodes, n, last in pages:
            start = len(self.parents)
            self.parents += [p + start if p >= 0 else -1 for p in parents]
            added += more
            at += [x + start for x in nodes]
            sizes += n
            lasts += last
        self.hashes, self.of = _joined(added)
        self.at, self.lasts = np.array(at, np.int64), np.array(lasts, np.int64)
        self.weight = (1.0 / np.array(sizes)).astype(np.float32)

    def means(self, table: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(self.parents), table.shape[1]), np.float32)
        if len(self.hashes):
            first = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]])
            sums[self.of[first]] = np.add.reduceat(table[self.hashes], first, axis=0)
        for i, p in enumerate(self.parents):
            if p >= 0:
                sums[i] += sums[p]
        return (sums[self.at] + table[self.lasts]) * self.weight[:, None]

    def gradients(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, values) of the table, from those of the means."""
        d = d * self.weight[:, None]
        nodes = np.zeros((len(self.parents), d.shape[1]), np.float32)
        np.add.at(nodes, self.at, d)
        for i in range(len(self.parents) - 1, -1, -1):
            if self.parents[i] >= 0:
                nodes[self.parents[i]] += nodes[i]
        return np.concatenate([self.hashes, self.lasts]), np.concatenate([nodes[self.of], d])


def _means(table: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the table's rows per block, and 1 / their number."""
    weight = (1.0 / np.maximum(np.bincount(of, minlength=n), 1)).astype(np.float32)
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(values):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[starts]] = np.add.reduceat(table[values], starts, axis=0)
    return out * weight[:, None], weight


# --- the network ----------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1.0))


def _lstm(gates: np.ndarray, mask: np.ndarray, rec: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    steps, n, _ = gates.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        u = gates[t] + h @ rec
        s = _sigmoid(u[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(u[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = m * (f * c + i * g)
        th = np.tanh(new)
        if keep:
            tape.append((t, h, c, i, f, o, g, th))
        h, c = m * o * th, new
        out[t] = h
    return out, tape


def _lstm_back(d_out: np.ndarray, mask: np.ndarray, rec: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    d_gates, d_rec = np.zeros((*d_out.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(rec)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    d_c = np.zeros_like(d_h)
    for t, h, c, i, f, o, g, th in reversed(tape):
        m = mask[t][:, None]
        d_h = (d_h + d_out[t]) * m
        d_c = (d_c + d_h * o * (1 - th * th)) * m
        d_u = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * th * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
        d_gates[t] = d_u
        d_rec += h.T @ d_u
        d_h, d_c = d_u @ rec.T, d_c * f
    return d_gates, d_rec


class Labeller:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, by: float) -> np.ndarray:
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.p = {"path": normal(PATHS, SIZE, by=0.3), "word": normal(WORDS, SIZE, by=0.01)}
        for d in "fb":
            self.p[f"in_{d}"] = normal(2 * SIZE + NUMBERS, 4 * HIDDEN, by=0.3)
            self.p[f"bias_{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"rec_{d}"] = normal(HIDDEN, 4 * HIDDEN, by=0.2)
        self.p |= {"out": normal(2 * HIDDEN, by=0.3), "out_bias": np.zeros(1, np.float32)}

    def run(self, pages: list[tuple], keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits (time x pages, by the longest page) of pages given as features."""
        p = self.p
        lengths = [len(x[1]) for x in pages]
        cells = np.concatenate([t * len(pages) + k for k, n in enumerate(lengths) for t in [np.arange(n)]])
        paths = Paths([page[0] for page in pages])
        words = _joined([x for page in pages for x in page[1]])
        a = paths.means(p["path"])
        b, wb = _means(p["word"], *words, len(cells))
        x = np.concatenate([3 * a, b, np.concatenate([page[2] for page in pages])], axis=1)
        steps = max(lengths)
        mask = np.zeros(steps * len(pages), np.float32)
        mask[cells] = 1
        mask = mask.reshape(steps, len(pages))
        outs, tapes = [], []
        for d in "fb":
            gates = np.zeros((steps * len(pages), 4 * HIDDEN), np.float32)
            gates[cells] = x @ p[f"in_{d}"] + p[f"bias_{d}"]
            out, tape = _lstm(gates.reshape(steps, len(pages), -1), mask, p[f"rec_{d}"], d == "b", keep)
            outs.append(out)
            tapes.append(tape)
        states = np.concatenate(outs, axis=2)
        return states @ p["out"] + p["out_bias"][0], (cells, paths, words, wb, x, mask, states, tapes)

    def gradients(self, pages: list[tuple], labels: list[np.ndarray]) -> tuple[dict, dict]:
        """Of all tables: dense ones, and {name: (rows, values)} of the hashed vectors."""
        p = self.p
        logits, (cells, paths, words, wb, x, mask, states, tapes) = self.run(pages, keep=True)
        wanted = np.zeros(mask.size, np.float32)
        wanted[cells] = np.concatenate(labels)
        d = (_sigmoid(logits) - wanted.reshape(mask.shape)) * mask / mask.sum()
        g = {"out": np.einsum("tb,tbk->k", d, states), "out_bias": np.array([d.sum()], np.float32)}
        d_states = d[:, :, None] * p["out"]
        d_x = np.zeros_like(x)
        for i, name in enumerate("fb"):
            half = np.ascontiguousarray(d_states[:, :, i * HIDDEN : (i + 1) * HIDDEN])
            d_gates, g[f"rec_{name}"] = _lstm_back(half, mask, p[f"rec_{name}"], tapes[i])
            flat = d_gates.reshape(-1, 4 * HIDDEN)[cells]
            g[f"in_{name}"], g[f"bias_{name}"] = x.T @ flat, flat.sum(axis=0)
            d_x += flat @ p[f"in_{name}"].T
        sparse = {
            "path": paths.gradients(3 * d_x[:, :SIZE]),
            "word": (words[0], (d_x[:, SIZE : 2 * SIZE] * wb[:, None])[words[1]]),
        }
        return g, sparse


def train(pages: list[tuple[str, list[int]]], seed: int = 3) -> Labeller:
    """From (html, label of each leaf block), by Adam."""
    net, reader = Labeller(seed), Features()
    features = [reader.of(blocks_of(html)) for html, _ in pages]
    labels = [np.array(x, np.float32) for _, x in pages]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    rng, t = np.random.default_rng(seed), 0

    def adam(name: str, at: np.ndarray | slice, grad: np.ndarray) -> None:
        m[name][at] = 0.9 * m[name][at] + 0.1 * grad
        v[name][at] = 0.99 * v[name][at] + 0.01 * grad * grad
        step = RATE * (m[name][at] / (1 - 0.9**t)) / (np.sqrt(v[name][at] / (1 - 0.99**t)) + 1e-6)
        net.p[name][at] -= step.astype(np.float32)

    for _ in range(EPOCHS):
        order = rng.permutation(len(pages))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            hidden = rng.random(len(some)) < 0.5  # half of the pages are learnt by their layout alone
            seen = [(features[k][0], [[] for _ in features[k][1]] if hide else features[k][1], features[k][2]) for k, hide in zip(some, hidden, strict=True)]
            dense, sparse = net.gradients(seen, [labels[k] for k in some])
            t += 1
            for name, grad in dense.items():
                adam(name, slice(None), grad)
            for name, (rows, values) in sparse.items():
                if not len(rows):
                    continue
                by = np.argsort(rows, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(rows[by]) > 0])
                adam(name, rows[by][starts], np.add.reduceat(values[by], starts, axis=0))
    return net


# --- pages to learn from --------------------------------------------------------


class Layouts:
    """Random pages: html and, for each of their leaf blocks, whether it is main text."""

    SYLLABLES = "ka lo mi ren ta su vo pel ni dar to ge fin ma ru es an ti or be".split()
    ARTICLES = (
        ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'),
        ("div", ' id="content"'), ("div", ' class="article-body"'), ("div", ' class="entry-content"'),
        ("section", ' class="story"'), ("div", ' class="post-content"'), ("div", ' role="main"'), ("div", ' id="main"'),
        ("div", ' class="article"'), ("section", ' id="article"'), ("div", ' class="text body"'),
    )
    ADVERTS = ("ad", "ads", "advert", "sponsored", "banner", "promo", "advertisement", "ad-slot")
    SIDES = ("sidebar", "side", "widget", "related", "popular", "rail", "recommended", "tags")
    NOTICES = ("cookie", "cookie-banner", "notice", "consent", "gdpr", "popup", "newsletter", "alert", "paywall", "modal")
    MENUS = ("menu", "navbar", "nav", "breadcrumb", "breadcrumbs", "topbar", "navigation", "pagination", "share", "social", "toolbar")
    COMMENTS = ("comments", "comment", "comment-list", "disqus", "replies", "responses", "reader-comments")
    PHRASES = {
        "menu": "home news sport about contact login register search menu",
        "footer": "© copyright all rights reserved terms privacy imprint contact",
        "notice": "we use cookies accept consent settings privacy",
        "comment": "reply says posted comments log in to comment",
        "form": "name email subscribe submit search send",
        "ad": "advertisement sponsored buy now",
        "side": "related most read popular share follow us",
    }

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, values: tuple | list) -> object:
        return values[int(self.rng.integers(len(values)))]

    def words(self, low: int, high: int, kind: str = "") -> str:
        n = int(self.rng.integers(low, high + 1))
        usual = self.PHRASES[self.pick(list(self.PHRASES))].split()  # such words stand in articles, too
        out = [
            self.pick(usual) if self.chance(0.05) else "".join(self.pick(self.SYLLABLES) for _ in range(int(self.rng.integers(1, 4))))
            for _ in range(n)
        ]
        if kind and self.chance(0.5):
            out += self.PHRASES[kind].split()[: int(self.rng.integers(1, 8))]
        if n > 4 and self.chance(0.8):
            out = [w + "." if self.chance(0.12) else w for w in out]
        return " ".join(out).capitalize()

    def among(self, name: str) -> str:
        """The name alone or among class names that say nothing."""
        if not self.chance(0.15):
            return name
        filling = [f"{self.pick(self.SYLLABLES)}-{self.rng.integers(9)}" for _ in range(int(self.rng.integers(3, 18)))]
        filling.insert(int(self.rng.integers(len(filling) + 1)), name)
        return " ".join(filling)

    def block(self, opening: str, text: str, closing: str, label: int) -> None:
        self.html.append(f"{opening}{text}{closing}")
        self.labels.append(label)

    def listed(self, kind: str, label: int = 0) -> None:
        self.html.append("<ul>")
        for _ in range(int(self.rng.integers(2, 9))):
            link = ('<a href="/x">', "</a>") if not label or self.chance(0.1) else ("", "")
            self.block(f"<li>{link[0]}", self.words(1, 4 if not label else 15, kind), f"{link[1]}</li>", label)
        self.html.append("</ul>")

    def boxed(self, tag: str, names: tuple, kind: str) -> None:
        attribute = f' {self.pick(("class", "class", "id"))}="{self.among(self.pick(names))}"' if names else ""
        self.html.append(f"<{tag}{attribute}>")
        shape = self.rng.random()
        if shape < 0.35:
            self.block("", self.words(2, 40, kind), "", 0)
        elif shape < 0.6:
            self.listed(kind)
        else:
            for _ in range(int(self.rng.integers(1, 5))):
                self.block("<p>" if self.chance(0.7) else "<div>", self.words(2, 40, kind), "", 0)
                self.html.append("</p>" if "<p>" in self.html[-1] else "</div>")
        self.html.append(f"</{tag}>")

    def aside(self) -> None:
        """Something that is not main text."""
        kind = int(self.rng.integers(7))
        if kind == 0:
            self.boxed(self.pick(("div", "section", "aside", "ins")) if self.chance(0.9) else "aside", self.ADVERTS, "ad")
        elif kind == 1:
            self.boxed(*((("aside", ()) if self.chance(0.4) else (self.pick(("div", "section", "aside")), self.SIDES))), "side")
        elif kind == 2:
            self.boxed(self.pick(("div", "div", "section", "section", "dialog", "noscript")), self.NOTICES, "notice")
        elif kind == 3:
            self.boxed(*((("nav", ()) if self.chance(0.5) else (self.pick(("div", "ul")) if self.chance(0) else "div", self.MENUS))), "menu")
        elif kind == 4:
            self.html.append("<form>")
            for _ in range(int(self.rng.integers(1, 5))):
                tag = self.pick(("label", "p", "button", "div", "legend"))
                self.block(f"<{tag}>", self.words(1, 6, "form"), f"</{tag}>", 0)
            self.html.append("</form>")
        else:
            self.comments() if kind == 5 else self.boxed("div", self.ADVERTS, "ad")

    def comments(self) -> None:
        tag = self.pick(("section", "div", "ol"))
        self.html.append(f'<{tag} {self.pick(("class", "id"))}="{self.among(self.pick(self.COMMENTS))}">')
        if self.chance(0.5):
            self.block("<h3>", self.words(1, 3, "comment"), "</h3>", 0)
        for _ in range(int(self.rng.integers(1, 7))):
            inner = self.pick(("p", "p", "div", "div", "li", "li", "article"))
            extra = f' class="{self.pick(self.COMMENTS)}"' if self.chance(0.6) else ""
            self.block(f"<{inner}{extra}>", self.words(2, 60, "comment"), f"</{inner}>", 0)
        self.html.append(f"</{tag}>")

    def main(self) -> None:
        tag, attribute = self.pick(self.ARTICLES)
        if attribute:
            key, name = attribute.rstrip('"').split('="')
            attribute = f'{key}="{self.among(name)}"'
        wrapped = self.chance(0.3)
        self.html.append("<main>" if wrapped else "")
        self.html.append(f"<{tag}{attribute}>")
        if self.chance(0.85):
            self.block(f"<{(h := self.pick(('h1', 'h1', 'h2')))}>", self.words(2, 14), f"</{h}>", 1)
        closed = self.chance(0.7)
        for _ in range(int(self.rng.geometric(0.04 if self.chance(0.2) else 0.12))):
            shape = self.rng.random()
            if shape < 0.72:
                inner = self.pick(("", "", "<b>", "<em>", "<span>"))
                self.block(f"<p>{inner}", self.words(1, 4 if self.chance(0.3) else 90), "</p>" if closed else "<br>", 1)
            elif shape < 0.8:
                self.block(f"<{(h := self.pick(('h2', 'h3')))}>", self.words(1, 8), f"</{h}>", 1)
            elif shape < 0.85:
                self.listed("", 1)
            elif shape < 0.9:
                self.block("<blockquote>", self.words(5, 40), "</blockquote>", 1)
            elif shape < 0.93:
                self.block("<div>", self.words(5, 80), "</div>", 1)
            elif shape < 0.95:
                self.block("<table><tr><td>", self.words(1, 5), "</td></tr></table>", 1)
            else:
                self.aside()
        if self.chance(0.1):
            self.comments()
        self.html.append(f"</{tag}>")
        self.html.append("</main>" if wrapped else "")

    def page(self) -> tuple[str, list[int]]:
        self.html, self.labels = ["<html><head><title>x</title></head><body>"], []
        if self.chance(0.4):
            names = ("header", "site-header", "masthead", "top")
            self.boxed("header", (), "menu") if self.chance(0.5) else self.boxed("div", names, "menu")
        if self.chance(0.7):
            self.boxed("nav", (), "menu") if self.chance(0.6) else self.boxed("div", self.MENUS, "menu")
        for _ in range(int(self.rng.integers(0, 3))):
            self.aside()
        if self.chance(0.96):
            self.main()
        for _ in range(int(self.rng.integers(0, 3))):
            self.aside()
        if self.chance(0.85):
            self.boxed("footer", (), "footer") if self.chance(0.7) else self.boxed("div", ("footer", "bottom", "site-footer", "copyright"), "footer")
        self.html.append("</body></html>")
        return "".join(self.html), self.labels


def training_pages(n: int = PAGES, seed: int = 5) -> list[tuple[str, list[int]]]:
    layouts = Layouts(seed)
    made = (layouts.page() for _ in range(n))
    return [(html, labels) for html, labels in made if labels and len(blocks_of(html)) == len(labels)]


# --- tables ---------------------------------------------------------------------


def main_texts(net: Labeller, reader: Features, pages: list[str]) -> list[str]:
    blocks = [blocks_of(html) for html in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    while order:
        longest = len(blocks[order[-1]])
        some = [order.pop() for _ in range(min(len(order), max(1, CELLS_AT_ONCE // longest)))]
        logits, _ = net.run([reader.of(blocks[i]) for i in some])
        for k, i in enumerate(some):
            out[i] = "\n\n".join(b[0] for b, x in zip(blocks[i], logits[:, k], strict=False) if x > 0)
    return out


def extracted(pages: DataFrame, net: Labeller, keys: dict[str, Column], html: str = "html") -> DataFrame:
    """The key columns, text and n_chars (code points) of every page."""
    names = list(keys)
    rows = pages.select(*[c.alias(n) for n, c in keys.items()], F.coalesce(F.col(html), F.lit("")).alias("_html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = pages.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Features()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = main_texts(shared.value, reader, part["_html"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part[n] for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*names, "text", "n_chars"],
                )

    return map_batches(rows, extract, f"{kept}, text string, n_chars long")
