"""Main text of web pages: a recurrent labeller over the blocks of a page.

A page becomes its sequence of leaf blocks: runs of text between block tags, each with its path of
tags and classes. Hashed path steps, hashed words and a few sizes make a vector; a bidirectional LSTM
reads the whole sequence and every block is labelled from both directions, so from the whole page.

There are no labelled pages. The model learns from a bounded sample of pages whose containers say
what they hold (article and main; nav, footer, forms and named boxes), with further boxes of such kinds put
in at random places, and with steps of the paths hidden at random so that context has to do.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import map_arrow, without_columns

SAMPLE_PAGES = 400
SAMPLE_CHARS = 200_000
TEACHING_BLOCKS = 128
PATH_DIM = 512
PATH_ELEMENTS = 64
PATH_NAMES = 32
WORD_DIM = 24
HIDDEN = 16
STEPS = 480
BATCH = 16
RATE = 0.01
SEED = 11
CHUNK_BLOCKS = 2048
GROUP_BLOCKS = 16_384

# A quote that is never closed does not hold the tag open: it then ends at the next ">".
REST = r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+"
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>script|style|iframe|textarea|title)(?=[\s/>]){REST}>.*?(?=</(?P=raw)[\s/>]|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    rf"|</?(?P<tag>[a-zA-Z][^\s>/]*+)(?P<rest>{REST})(?:>|\Z)",
    re.S | re.I,
)
DRAWN = re.compile(r"<(?:svg|select|template)(?=[\s/>])", re.I)
SILENT = re.compile(rf"(?:\s++|<!--.*?-->|<(?!/?(?:noscript|object|iframe)[\s/>])/?[a-zA-Z]{REST}>|<iframe(?=[\s/>]){REST}>[^<]*+</iframe\s*+>)*+</(noscript|object)\s*+>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"\w+")

# Fixed value: elements that flow inside a block; every other tag ends it.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Fixed value: elements without content, and the head, whose end may be left out.
VOID = set("area base br col embed hr img input link meta param source track wbr head".split())
# Fixed value: elements that a new element of the same kind closes.
CLOSES_ITSELF = set("p li dt dd tr td th option".split())
# Fixed value: elements whose text is none of the page's, if they are closed.
APART = set("svg select template".split())
# Fixed value: elements that stand in for others and may be empty.
STAND_IN = set("noscript object".split())
# Fixed value: elements whose content is no markup.
RAW = set("script style iframe textarea title".split())
# Fixed value: containers of main text, for teaching.
MAIN = set("article main".split())
# Fixed value: containers and names of everything else, for teaching.
OTHER = set(
    "nav header footer aside form button dialog menu ad ads advert advertisement alert banner breadcrumb comment comments consent cookie "
    "copyright disclaimer discussion login modal navbar newsletter notice notification pager pagination popup promo related reply "
    "responses share sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
# Fixed value: those of them that are elements.
TAGS = set("nav header footer aside form button dialog menu".split())
# Fixed value: names that say nothing about what a box holds, for teaching.
PLAIN = "area author block body box content date group head heading inner item items label large left list main meta name panel right section small text title top wrap wrapper".split()
# Fixed value: what else a block of main text may stand in, for teaching.
LEAVES = [("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("blockquote",), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("h2",), ("h3",), ("section", "p"), ("div", "p"), ("dl", "dd")]


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def ends_with_slash(m: re.Match) -> bool:
    return m["rest"].rstrip().endswith("/")


def apart(html: str) -> dict[int, int]:
    """Where a drawing, choice list or template starts and ends; one that is never closed is not listed."""
    found: dict[int, int] = {}
    if not DRAWN.search(html):
        return found
    opened: dict[str, list[int]] = {name: [] for name in APART}
    for m in MARKUP.finditer(html):
        tag = (m["tag"] or "").lower()
        if tag not in APART:
            continue
        if html[m.start() + 1] != "/":
            if not ends_with_slash(m):
                opened[tag].append(m.start())
        elif opened[tag]:
            found[opened[tag].pop()] = m.end()
    return found


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in order, references decoded, white space made one space, trimmed.

    A path holds the innermost ``PATH_ELEMENTS`` elements with ``PATH_NAMES`` words of their names each, so deep nesting
    and long names cost no more than others. Scripts, styles, titles, inputs of text, closed drawings, choice lists and
    templates hold no text of the page; of those that are never closed or close themselves, drawings, choice lists and
    templates end nothing and hide nothing. ``noscript`` and ``object`` are elements like others. Takes linear time.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = links = 0

    def close():
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            path = tuple(s for _, steps in stack[-PATH_ELEMENTS:] for s in steps)
            found.append(Block(path, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def add(data: str):
        nonlocal linked
        pieces.append(data)
        linked += len(data.strip()) if links else 0

    at, hidden = 0, apart(html)
    for m in MARKUP.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag in RAW:
            continue
        if tag in APART:
            at = hidden.get(m.start(), at)
            continue
        if tag in STAND_IN and html[m.start() + 1] != "/" and (silent := SILENT.match(html, at)):
            at = silent.end()
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if html[m.start() + 1] == "/" else 1))
            continue
        close()
        if html[m.start() + 1] == "/":
            if opened[tag]:
                while (last := stack.pop()[0]) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
                links = 0
        elif tag not in VOID and not ends_with_slash(m):
            if tag in CLOSES_ITSELF and stack and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1
            names = " ".join("".join(g) for g in NAMES.findall(m["rest"])).lower()
            stack.append((tag, (tag, *WORD.findall(names.replace("-", " ").replace("_", " "))[:PATH_NAMES])))
            opened[tag] += 1
    if at < len(html):
        add(html[at:])
    close()
    return found


def bucket(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h >> 31 else -1.0


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: hashed path steps, hashed words, sizes."""
    out = np.zeros((len(page), PATH_DIM + WORD_DIM + 4), np.float32)
    seen: dict[str, tuple[int, float]] = {}
    paths: dict[tuple[str, ...], np.ndarray] = {}
    for row, b in zip(out, page, strict=True):
        if b.path not in paths:
            v = np.zeros(PATH_DIM, np.float32)
            for depth, step in enumerate(reversed(b.path)):
                i, sign = bucket("/" + step, PATH_DIM)
                v[i] += sign * (1.0 if depth < 3 else 0.7)
            paths[b.path] = v
        row[:PATH_DIM] = paths[b.path]
        words = b.text.split(" ")
        for w in words:
            if w not in seen:
                seen[w] = bucket(w.lower(), WORD_DIM)
            i, sign = seen[w]
            row[PATH_DIM + i] += sign
        own = row[PATH_DIM : PATH_DIM + WORD_DIM]
        own /= max(1.0, float(np.sqrt((own * own).sum())))
        row[-4:] = (np.log1p(len(words)) / 4, np.log1p(len(b.text)) / 6, b.linked / len(b.text), b.text[-1] in ".!?…")
    return out


def teacher(page: list[Block]) -> np.ndarray:
    """1 main text, 0 other, -1 not told, by the innermost container that says."""
    out = np.full(len(page), -1)
    for i, b in enumerate(page):
        for step in reversed(b.path):
            if step in OTHER:
                out[i] = 0
                break
            if step in MAIN:
                out[i] = 1
                break
    return out


def put_in(kind: str, around: tuple[str, ...], main: list[Block], rng: np.random.Generator) -> list[Block]:
    """The blocks of a box of some kind: its name alone or among other names, one or more like items in it."""

    def name() -> str:
        return PLAIN[rng.integers(len(PLAIN))] if rng.random() < 0.7 else f"n{rng.integers(10**6)}"

    def named(tag: str) -> tuple[str, ...]:
        words = [kind, *(name() for _ in range(rng.integers(0, 3)))]
        return (tag, *(words[i] for i in rng.permutation(len(words))))

    if kind in TAGS:
        holder = (kind, name()) if rng.random() < 0.3 else (kind,)
    else:
        holder = named(("div", "section", "ul", "p")[rng.integers(4)])
    if rng.random() < 0.3:
        holder = (*holder, *(named("div") if rng.random() < 0.5 else ("div", name())))
    item = ((), (), ("p",), ("div",), ("ul", "li"), ("li",), named("li"), named("div"))[rng.integers(8)]
    out = []
    for _ in range(rng.integers(1, 5)):
        words = main[rng.integers(len(main))].text.split(" ")
        start = int(rng.integers(len(words))) if rng.random() < 0.7 else 0
        text = " ".join(words[start : start + int(rng.integers(1, 100) if rng.random() < 0.4 else rng.integers(1, 20))])
        leaf = ((), (), ("p",), ("p",), ("p", name()), ("h2",), ("h3",), ("h4",))[rng.integers(8)]
        out.append(Block((*around, *holder, *item, *leaf), text, len(text) if rng.random() < 0.25 else 0))
    return out


def varied(page: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page with further boxes and short blocks of main text put in, and with containers renamed or hidden at random.

    Of a long page a random run of ``TEACHING_BLOCKS`` blocks.
    """
    body, told = list(page), list(labels)
    main = [b for b, y in zip(page, labels, strict=True) if y == 1]
    kinds = sorted(OTHER)
    for _ in range(rng.integers(0, 5)):
        if not main:
            break
        at = int(rng.integers(0, len(body) + 1))
        around = main[0].path[:-1] if rng.random() < 0.5 else ("html", "body")
        added = put_in(kinds[rng.integers(len(kinds))], around, main, rng)
        body[at:at] = added
        told[at:at] = [0] * len(added)
    for _ in range(rng.integers(0, 3) if main else 0):
        inside = np.flatnonzero(np.array(told) == 1)
        at = int(inside[rng.integers(len(inside))]) + 1
        leaf = (*main[0].path[:-1], *LEAVES[rng.integers(len(LEAVES))])
        for _ in range(rng.integers(1, 5)):
            words = main[rng.integers(len(main))].text.split(" ")
            start = int(rng.integers(len(words)))
            body.insert(at, Block(leaf, " ".join(words[start : start + int(rng.integers(1, 20))]), 0))
            told.insert(at, 1)
    swap = None
    if rng.random() < 0.5:
        swaps = (("main",), ("main", "article"), ("div", "content"), ("div", "post", "body"), ("section",), ("div", "entry"), ("div",), ("div", f"n{rng.integers(10**6)}"), ("div", PLAIN[rng.integers(len(PLAIN))]), ("body",))
        swap = swaps[rng.integers(len(swaps))]
    hide = rng.random() < 0.2
    changed = (0.0, 0.15, 0.4)[rng.integers(3)]
    out = []
    for b, y in zip(body, told, strict=True):
        path = b.path
        if y == 1 and path[-1] == "p" and rng.random() < changed:
            path = (*path[:-1], *LEAVES[rng.integers(len(LEAVES))])
        if swap:
            path = tuple(x for s in path for x in (swap if s == "article" else (s,)))
        if hide:
            path = tuple(s for s in path if rng.random() < 0.7)
        out.append(Block(path, b.text, b.linked))
    if len(out) > TEACHING_BLOCKS:
        start = int(rng.integers(len(out) - TEACHING_BLOCKS + 1))
        out, told = out[start : start + TEACHING_BLOCKS], told[start : start + TEACHING_BLOCKS]
    return out, np.array(told)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {"out": rng.normal(0, 0.1, 2 * hidden).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            scale = 1 / np.sqrt(width + hidden)
            self.weights["x" + d] = rng.normal(0, scale, (width, 4 * hidden)).astype(np.float32)
            self.weights["h" + d] = rng.normal(0, scale, (hidden, 4 * hidden)).astype(np.float32)
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1.0
            self.weights["b" + d] = b

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """Hidden states of one direction over (time, batch, width), and what the way back needs."""
        n, size, _ = x.shape
        h, c = np.zeros((size, self.hidden), np.float32), np.zeros((size, self.hidden), np.float32)
        given = x @ self.weights["x" + d] + self.weights["b" + d]
        steps, states = [None] * n, np.zeros((n, size, self.hidden), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            g = given[t] + h @ self.weights["h" + d]
            i, f, o, u = (sigmoid(g[:, : self.hidden]), sigmoid(g[:, self.hidden : 2 * self.hidden]), sigmoid(g[:, 2 * self.hidden : 3 * self.hidden]), np.tanh(g[:, 3 * self.hidden :]))
            m = mask[t][:, None]
            new = f * c + i * u
            steps[t] = (i, f, o, u, c, new, h, m)
            c = m * new + (1 - m) * c
            h = m * (o * np.tanh(new)) + (1 - m) * h
            states[t] = h
        return states, steps

    def _back(self, x: np.ndarray, states_grad: np.ndarray, steps: list, d: str) -> dict[str, np.ndarray]:
        n, size, _ = x.shape
        gates = np.zeros((n, size, 4 * self.hidden), np.float32)
        grad_h, grad_c = np.zeros((size, self.hidden), np.float32), np.zeros((size, self.hidden), np.float32)
        recurrent = np.zeros_like(self.weights["h" + d])
        for t in range(n - 1, -1, -1) if d == "f" else range(n):
            i, f, o, u, c, new, h, m = steps[t]
            grad_h = grad_h + states_grad[t]
            active, tanh = m * grad_h, np.tanh(new)
            grad_new = m * grad_c + active * o * (1 - tanh**2)
            gates[t] = np.concatenate(
                [grad_new * u * i * (1 - i), grad_new * c * f * (1 - f), active * tanh * o * (1 - o), grad_new * i * (1 - u**2)], axis=1
            )
            recurrent += h.T @ gates[t]
            grad_c = grad_new * f + (1 - m) * grad_c
            grad_h = gates[t] @ self.weights["h" + d].T + (1 - m) * grad_h
        flat = gates.reshape(-1, gates.shape[-1])
        return {"x" + d: x.reshape(-1, x.shape[-1]).T @ flat, "h" + d: recurrent, "b" + d: flat.sum(axis=0)}

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = max(map(len, pages))
        x = np.zeros((n, len(pages), pages[0].shape[1]), np.float32)
        mask = np.zeros((n, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1.0
        return x, mask

    def given(self, page: list[Block]) -> np.ndarray:
        """What the blocks of a page feed to the gates of both directions; dense vectors exist for a chunk at a time."""
        both = np.concatenate([self.weights["xf"], self.weights["xb"]], axis=1)
        bias = np.concatenate([self.weights["bf"], self.weights["bb"]])
        out = np.empty((len(page), both.shape[1]), np.float32)
        for at in range(0, len(page), CHUNK_BLOCKS):
            part = page[at : at + CHUNK_BLOCKS]
            out[at : at + len(part)] = vectors(part) @ both + bias
        return out

    def _pass(self, given: list[np.ndarray], d: str) -> list[np.ndarray]:
        """What one direction says of every block, for pages from the longest to the shortest, each from its first row on."""
        size, cells = self.hidden, np.zeros((len(given[0]), len(given), 4 * self.hidden), np.float32)
        for k, g in enumerate(given):
            cells[: len(g), k] = g
        weights, out = self.weights["h" + d], self.weights["out"][: self.hidden] if d == "f" else self.weights["out"][self.hidden :]
        h, c = np.zeros((len(given), size), np.float32), np.zeros((len(given), size), np.float32)
        said = np.zeros(cells.shape[:2], np.float32)
        lengths = np.array([len(g) for g in given])
        active = np.searchsorted(-lengths, -np.arange(len(cells)), side="left")
        for t in range(len(cells)):
            n = active[t]
            g = cells[t, :n] + h[:n] @ weights
            gates = sigmoid(g[:, : 3 * size])
            c = gates[:, size : 2 * size] * c[:n] + gates[:, :size] * np.tanh(g[:, 3 * size :])
            h = gates[:, 2 * size :] * np.tanh(c)
            said[t, :n] = h @ out
        return [said[: len(g), k] for k, g in enumerate(given)]

    def scores(self, given: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page, from what ``given`` says of the pages.

        Keeps no steps. Pages run together in groups of at most ``GROUP_BLOCKS`` padded cells; a longer page runs alone.
        """
        order = sorted((k for k, g in enumerate(given) if len(g)), key=lambda k: -len(given[k]))
        found = [np.zeros(0, np.float32) for _ in given]
        while order:
            many = max(1, GROUP_BLOCKS // len(given[order[0]]))
            group, order = order[:many], order[many:]
            gates = 4 * self.hidden
            forth = self._pass([given[k][:, :gates] for k in group], "f")
            back = self._pass([given[k][::-1, gates:] for k in group], "b")
            for k, f, b in zip(group, forth, back, strict=True):
                found[k] = sigmoid(f + b[::-1] + self.weights["bias"])
        return found

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], moments: dict, rate: float) -> float:
        """One Adam step on a batch; blocks labelled -1 do not count. Returns the mean loss."""
        x, mask = self.padded(pages)
        forth, forth_steps = self._run(x, mask, "f")
        back, back_steps = self._run(x, mask, "b")
        both = np.concatenate([forth, back], axis=2)
        p = sigmoid(both @ self.weights["out"] + self.weights["bias"])
        want, told = np.zeros_like(p), np.zeros_like(p)
        for k, y in enumerate(labels):
            want[: len(y), k], told[: len(y), k] = y == 1, y >= 0
        grad = (p - want) * told / max(1.0, told.sum())
        states = grad[:, :, None] * self.weights["out"]
        grads = {"out": (both * grad[:, :, None]).sum(axis=(0, 1)), "bias": np.array([grad.sum()], np.float32)}
        grads |= self._back(x, states[:, :, : self.hidden], forth_steps, "f")
        grads |= self._back(x, states[:, :, self.hidden :], back_steps, "b")
        moments["t"] = moments.get("t", 0) + 1
        for name, g in grads.items():
            g = np.clip(g, -1, 1)
            m, v = moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[name] = m, v
            self.weights[name] = (self.weights[name] - rate * (m / (1 - 0.9 ** moments["t"])) / (np.sqrt(v / (1 - 0.999 ** moments["t"])) + 1e-8)).astype(np.float32)
        loss = -(want * np.log(p + 1e-7) + (1 - want) * np.log(1 - p + 1e-7)) * told
        return float(loss.sum() / max(1.0, told.sum()))


def train(samples: list[str], steps: int = STEPS, seed: int = SEED) -> Labeller | None:
    """A labeller taught by the containers of sampled pages, in as many steps however few they are.

    None if no page says anything.
    """
    rng = np.random.default_rng(seed)
    pages = [(p, y) for p in map(blocks, samples) if p and (y := teacher(p)).max() >= 0]
    if not pages:
        return None
    model, moments = Labeller(PATH_DIM + WORD_DIM + 4, seed=seed), {}
    for done in range(steps):
        batch = [varied(*pages[i], rng) for i in rng.integers(0, len(pages), BATCH)]
        model.fit([vectors(p) for p, _ in batch], [y for _, y in batch], moments, RATE * (1 - done / steps) + 1e-4)
    return model


def fit_labeller(pages: DataFrame, id: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> Labeller | None:
    """Train on a bounded sample: about ``sample`` whole pages of at most ``SAMPLE_CHARS`` characters, drawn by a hash of the id.

    Where no page is that short, the shortest one teaches.
    """
    rows = pages.where(F.length(F.col(f"`{html}`")) > 0).select(F.col(f"`{id}`").alias("id"), F.col(f"`{html}`").alias("html"))
    short = rows.where(F.length("html") <= SAMPLE_CHARS)
    total = short.count()
    if not total:
        return train([r["html"] for r in rows.orderBy(F.length("html"), "id", "html").limit(1).collect()])
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    share = int((1 << 20) * min(1.0, 1.2 * sample / total))
    drawn = short.where(chance <= F.lit(share)).orderBy(chance, "id", "html").limit(sample).collect()
    return train([r["html"] for r in drawn])


def main_texts(model: Labeller | None, htmls: list[str | None]) -> list[str]:
    """Main text of each page: its main blocks in order, joined by newlines."""
    if model is None:
        return [""] * len(htmls)
    parsed = [blocks(h or "") for h in htmls]
    scores = model.scores([model.given(page) for page in parsed])
    return ["\n".join(b.text for b, y in zip(page, p, strict=True) if y >= 0.5) for page, p in zip(parsed, scores, strict=True)]


def extract(pages: DataFrame, model: Labeller | None, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole html in ``into``; columns so named give way.

    A null or empty html, a page without main text, and any page if no model could be taught give an
    empty text. Rows, repeated ones included, map one to one. A page of any length is read and labelled
    whole, in about 1 KB a block. The model (about 300 KB) travels with the function.
    """
    pages = without_columns(pages, into)
    place = pages.columns.index(html)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield [*part.columns, pa.array(main_texts(model, part.column(place).to_pylist()), pa.string())]

    return map_arrow(pages, run, StructType([*pages.schema.fields, StructField(into, StringType())]))
