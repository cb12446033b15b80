"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks in page order. Each block has a vector of hashed
tag-path features (names, class and id words of all open elements), hashed words and a few
measures. A bidirectional LSTM in numpy reads the whole sequence, so each block is classified
with the context of the document, and the blocks taken as article text are joined.

The labeller is trained here, with a fixed seed, on pages that a generator builds from random
words in many layouts with known labels; no page of the input takes part.

A page of very many blocks is read in windows: the forward reading carries its state from window to
window, the backward one from the last window to the first, so labels are those of one long sequence.

Defined results: null and empty html give an empty text; unclosed, misnested and cut-off markup is
read as far as it goes; pages of any length, depth and number of blocks are read whole; a slash at
the end of a tag closes void elements and foreign ones (in svg and math) only; repeated rows are
extracted each; other columns don't matter.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeline.llm.shared import prepare
from gradeline.llm.textops import SpanHash, column_bytes, lower_ascii, word_spans
from gradeline.llm.textops import blocks as text_slices

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 256, 64, 8, 16
DIM = PATH_DIM + WORD_DIM + MEASURES

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {}
#: Blocks of a longer page are labelled in windows of so many.
WINDOW = 4096
_HASH = SpanHash(71)
_ENDS = np.isin(np.arange(256), list(b".,:;!?"))
_FOREIGN = frozenset(["svg", "math"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template svg iframe object textarea select option button title head".split())
_INLINE = frozenset("svg script style noscript template".split())
_RAW = frozenset("script style textarea title iframe noscript xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


@lru_cache(maxsize=65_536)
def _hashed(token: str, dim: int) -> int:
    return zlib.crc32(token.encode()) % dim


@lru_cache(maxsize=65_536)
def _open_features(name: str, attributes: str) -> tuple[int, ...]:
    found = [_hashed("tag " + name, PATH_DIM)]
    for m in _ATTR.finditer(attributes):
        for w in _WORDS.findall(m[2] or m[3] or m[4] or ""):
            found.append(_hashed("name " + w.lower(), PATH_DIM))
    return tuple(found)


def page_blocks(page: str) -> list[tuple[str, tuple, int, int]]:
    """(text, path features, depth, characters in links) of the text blocks in page order.

    Path features are the sorted features of all open elements and the last two of them. Open elements are
    counted by name and by feature as they come and go, so the work grows with the page, whatever its depth.
    """
    out: list[tuple[str, tuple, int, int]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack each name is open
    features: dict[int, int] = {}
    text: list[str] = []
    linked = hidden = 0

    def path() -> tuple:
        last: list[int] = []
        for _, own in reversed(stack):
            last = [*own[-2:], *last][-2:]
            if len(last) == 2:
                break
        return tuple(sorted(features)), tuple(last)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((joined, path(), len(stack), linked))
            text.clear()
        linked = 0

    def pop_to(n: int) -> None:
        nonlocal hidden
        while len(stack) > n:
            name, own = stack.pop()
            places[name].pop()
            hidden -= name in _HIDDEN
            for x in own:
                if features[x] == 1:
                    del features[x]
                else:
                    features[x] -= 1

    def close_item(name: str) -> None:
        """End the open items of the same list or table, outermost first."""
        stop = max((places[n][-1] for n in _STOPS.get(name, ()) if places.get(n)), default=-1)
        inner = [places[n][k] for n in _CLOSES[name] if places.get(n) and (k := bisect_right(places[n], stop)) < len(places[n])]
        if inner:
            pop_to(min(inner))

    at = 0
    while m := _TOKEN.match(page, at):
        piece = m[0]
        at = m.end()
        if piece[0] != "<" or piece == "<":
            if not hidden:
                decoded = html.unescape(piece) if "&" in piece else piece
                text.append(decoded)
                if places["a"]:
                    linked += len(decoded)
            continue
        if piece.startswith("<![CDATA["):
            continue
        named = _NAME.match(piece)
        if not named:
            continue
        name = named[1].lower()
        if piece[1] == "/":
            if name in _BLOCK or name in _HIDDEN - _INLINE:
                flush()
            if places.get(name):
                pop_to(places[name][-1])
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES:
                close_item(name)
            elif places["p"]:  # a paragraph ends where a block begins, with what is still open in it
                pop_to(places["p"][-1])
            if name == "body":
                pop_to(0)
        elif name == "br":
            text.append(" ")
        if name in _VOID or (piece.endswith("/>") and (name in _FOREIGN or places["svg"] or places["math"])):
            continue
        own = _open_features(name, piece[len(named[0]) :])
        places[name].append(len(stack))
        stack.append((name, own))
        for x in own:
            features[x] = features.get(x, 0) + 1
        hidden += name in _HIDDEN
        if name in _RAW:
            if name not in _RAW_END:
                _RAW_END[name] = re.compile(rf"</{name}\b[^>]*>?", re.I)
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            pop_to(len(stack) - 1)
    flush()
    return out


@lru_cache(maxsize=16_384)
def _path_row(path: tuple) -> np.ndarray:
    row = np.zeros(PATH_DIM, np.float32)
    names, last = path
    row[list(names)] = 1
    for k, x in enumerate(reversed(last)):  # the innermost elements count more
        row[x] += 1.0 / (k + 1)
    return row


def word_counts(texts: list[str]) -> np.ndarray:
    """Hashed words of each text, all of them; a word weighs 0.3, less in texts of more than 12 words."""
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    trailing = (ends - starts > 1) & _ENDS[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    place = (_HASH.words(data, starts, ends - trailing) % np.uint64(WORD_DIM)).astype(np.int64)
    words = np.diff(first)
    at = np.repeat(np.arange(len(texts)), words) * WORD_DIM + place
    counts = np.bincount(at, minlength=len(texts) * WORD_DIM).reshape(-1, WORD_DIM)
    return (counts * (0.3 * np.minimum(1, 12 / np.maximum(words, 1)))[:, None]).astype(np.float32)


def vectors(found: list[tuple[str, tuple, int, int]], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """A row of DIM for each block of a page, or for a window of its blocks."""
    part = found[lo:hi]
    x = np.zeros((len(part), DIM), np.float32)
    if part:
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = word_counts([b[0] for b in part])
    for i, (text, path, depth, linked) in enumerate(part):
        x[i, :PATH_DIM] = _path_row(path)
        n, at = text.count(" ") + 1, lo + i
        x[i, PATH_DIM + WORD_DIM :] = (
            np.log1p(n) / 3, linked / max(len(text), 1), min(sum(map(text.count, ".!?")) / n * 4, 2), text[-1] in ".!?…", min(depth, 30) / 10,
            "©" in text or "@" in text, at / max(len(found) - 1, 1), min(at, 20) / 20,
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BlockLabeller:
    """Bidirectional LSTM with one output for each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.15, (DIM, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p["b" + d] = bias
        self.p["o"] = rng.normal(0, 0.2, (2 * HIDDEN,)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool = False, state: list | None = None):
        """Outputs of one direction; ``state`` holds what the reading starts with and then what it ends with."""
        steps, batch, _ = x.shape
        h, c = state or (np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32))
        out = np.empty((steps, batch, HIDDEN), np.float32)
        saved = []
        z_all = x @ self.p["x" + d] + self.p["b" + d]
        for t in range(steps):
            z = z_all[t] + h @ self.p["h" + d]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            c_new = (f * c + i * g) * mask[t]
            tc = np.tanh(c_new)
            if keep:
                saved.append((h, c, i, f, o, g, tc))
            h = o * tc * mask[t]
            c = c_new
            out[t] = h
        if state is not None:
            state[:] = [h, c]
        return out, saved

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: steps, batch, DIM; mask: steps, batch, 1. The backward reading starts at each sequence's end."""
        fwd, s1 = self._run("f", x, mask, keep)
        bwd, s2 = self._run("b", x[::-1], mask[::-1], keep)
        both = np.concatenate([fwd, bwd[::-1]], axis=2)
        return both @ self.p["o"] + self.p["c"][0], both, s1, s2

    def _back(self, d: str, x, mask, saved, dh_all, grad):
        dh_next = np.zeros_like(dh_all[0])
        dc_next = np.zeros_like(dh_all[0])
        dz_all = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tc = saved[t]
            dh = (dh_all[t] + dh_next) * mask[t]
            dc = (dc_next + dh * o * (1 - tc**2)) * mask[t]
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            grad["h" + d] += h.T @ dz
            dh_next, dc_next = dz @ self.p["h" + d].T, dc * f
        grad["x" + d] += np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
        grad["b" + d] += dz_all.sum((0, 1))

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            groups = [order[k : k + batch] for k in range(0, len(order), batch)]
            for group in groups:
                x, mask = padded([pages[k][0] for k in group])
                y = np.zeros(mask.shape[:2], np.float32)
                for b, k in enumerate(group):
                    y[: len(pages[k][1]), b] = pages[k][1]
                logit, both, s1, s2 = self.logits(x, mask, True)
                d = (_sigmoid(logit) - y) * mask[:, :, 0] / mask.sum()
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["o"] += np.tensordot(d, both, axes=([0, 1], [0, 1]))
                grad["c"] += d.sum()
                dh = d[:, :, None] * self.p["o"]
                self._back("f", x, mask, s1, dh[:, :, :HIDDEN], grad)
                self._back("b", x[::-1], mask[::-1], s2, dh[::-1, :, HIDDEN:], grad)
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g**2
                    self.p[k] = self.p[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def label(self, pages: list[list], cells: int = 1 << 14, window: int = WINDOW) -> list[np.ndarray]:
        """Whether each block of each page is article text; pages of like length go together, long ones alone."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            if len(pages[order[at]]) > window:
                out[order[at]] = self._label_long(pages[order[at]], window)
                at += 1
                continue
            end = at + 1
            while end < len(order) and len(pages[order[end]]) <= window and len(pages[order[end]]) * (end - at + 1) <= cells:
                end += 1
            group = order[at:end]
            logit = self.logits(*padded([vectors(pages[k]) for k in group]))[0]
            for b, k in enumerate(group):
                out[k] = logit[: len(pages[k]), b] > 0
            at = end
        return out

    def _label_long(self, page: list, window: int) -> np.ndarray:
        """The same for one page in windows with carried state."""
        cuts = [(a, min(a + window, len(page))) for a in range(0, len(page), window)]
        sums = np.full(len(page), self.p["c"][0])
        for d, part, windows in (("f", self.p["o"][:HIDDEN], cuts), ("b", self.p["o"][HIDDEN:], cuts[::-1])):
            state: list = []
            for a, b in windows:
                x = vectors(page, a, b)[:, None, :]
                got, _ = self._run(d, x if d == "f" else x[::-1], np.ones((b - a, 1, 1), np.float32), state=state)
                sums[a:b] += (got if d == "f" else got[::-1])[:, 0] @ part
        return sums > 0


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), DIM), np.float32)
    mask = np.zeros((steps, len(pages), 1), np.float32)
    for b, p in enumerate(pages):
        x[: len(p), b] = p
        mask[: len(p), b] = 1
    return x, mask


class PageMaker:
    """Random pages with known article blocks."""

    CONTENT = "content main-content article post entry story article-body entry-content post-body page-content text body-text prose".split()
    NAV = "menu nav navbar breadcrumb pagination main-menu site-nav top-menu nav-links tabs".split()
    HEAD = "header masthead topbar site-header logo brand page-header banner-top".split()
    FOOT = "footer copyright legal site-footer bottom colophon page-footer".split()
    SIDE = "sidebar side widget related rail aside secondary recommended trending tag-cloud".split()
    ADS = "ad ads advert advertisement sponsored promo banner ad-slot adbox sponsor".split()
    NOTICE = "notice cookie cookie-banner alert consent gdpr newsletter popup modal message announcement paywall subscribe".split()
    COMMENTS = "comments comment-list replies comment reader-comments discussion respond responses".split()
    FORM = "form search login signup contact-form search-box newsletter-form".split()
    LABELS = "Home About Contact Login Search Subscribe Share Reply Comments Next Previous Menu Privacy Terms News Help Archive".split()

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.syllables = ["".join(self.r.choice(list("bcdfghklmnprstvwz"), 1)) + "".join(self.r.choice(list("aeiouéäñ"), 1)) for _ in range(40)] + ["an", "er", "on", "th", "en", "st", "que", "ch"]

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def word(self) -> str:
        return "".join(self.pick(self.syllables) for _ in range(int(self.r.integers(1, 5))))

    def sentence(self, least: int = 3, most: int = 16) -> str:
        words = [self.word() for _ in range(int(self.r.integers(least, most)))]
        if self.chance(0.03):
            words = [w + self.pick(["###", "$$$", "&amp;&amp;", "!!"]) for w in words]
        return " ".join(words).capitalize() + self.pick([".", ".", ".", "!", "?", ""])

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(int(self.r.integers(1, 7)) if self.chance(0.8) else 1))

    def attr(self, names, p: float = 1.0) -> str:
        if not self.chance(p):
            return ""
        return f' {self.pick(["class", "class", "id"])}="{self.pick(names)}"'

    def text(self, s: str, good: bool) -> str:
        """Mark the block's truth by an invisible character that is taken out before reading."""
        return ("\x01" if good else "\x02") + s

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.word()}">{self.text(self.pick(self.LABELS) if self.chance(0.5) else self.word(), False)}</a>' for _ in range(n)]
        shape = self.pick(["li", "li", "span", "div"])
        if shape == "li":
            return "<ul>" + "".join(f"<li>{x}" + self.pick(["</li>", "</li>", ""]) for x in items) + "</ul>"
        return "".join(f"<{shape}>{x}</{shape}>" for x in items) if shape == "div" else self._inline(items)

    def _inline(self, items: list[str]) -> str:
        return "<div>" + " | ".join(items) + "</div>"

    def junk_text(self) -> str:
        return self.text(self.pick([self.sentence(), self.paragraph(), self.sentence(2, 6), self.pick(self.LABELS) + " " + self.sentence(1, 4)]), False)

    def wrap(self, names, inner: str, tags=("div", "section", "div", "p", "span")) -> str:
        tag = self.pick(list(tags))
        return f"<{tag}{self.attr(names)}>{inner}</{tag}>"

    def boiler(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.pick([f"<nav>{self.links(int(r.integers(2, 9)))}</nav>", f"<nav{self.attr(self.NAV)}>{self.links(int(r.integers(2, 9)))}</nav>", f"<div{self.attr(self.NAV)}>{self.links(int(r.integers(2, 9)))}</div>"])
        if kind == "header":
            inner = self.pick([f"<a href='/'>{self.junk_text()}</a>", f"<p>{self.junk_text()}</p>", f"<h1>{self.junk_text()}</h1><p>{self.junk_text()}</p>", self.links(3)])
            return self.pick([f"<header{self.attr(self.HEAD, 0.4)}>{inner}</header>", f"<div{self.attr(self.HEAD)}>{inner}</div>"])
        if kind == "footer":
            inner = self.pick([self.text("&copy; " + self.sentence(1, 6) + " &middot; " + self.sentence(), False), f"<p>{self.junk_text()}</p>", self.links(4) + f"<p>{self.junk_text()}</p>"])
            return self.pick([f"<footer{self.attr(self.FOOT, 0.3)}>{inner}</footer>", f"<div{self.attr(self.FOOT)}>{inner}</div>"])
        if kind == "side":
            inner = f"<h3>{self.junk_text()}</h3>" + "".join(self.pick([f"<p>{self.junk_text()}</p>", self.links(3)]) for _ in range(int(r.integers(1, 4))))
            return self.pick([f"<aside{self.attr(self.SIDE, 0.5)}>{inner}</aside>", f"<div{self.attr(self.SIDE)}>{inner}</div>"])
        if kind == "ad":
            inner = self.pick([self.junk_text(), self.junk_text(), f"<p>{self.junk_text()}</p>", f'<a href="#">{self.junk_text()}</a>'])
            return ("<!-- ad 1 -->" if self.chance(0.3) else "") + self.wrap(self.ADS, inner, ("div", "div", "aside", "section"))
        if kind == "notice":
            inner = self.pick([self.junk_text(), f"<p>{self.junk_text()}</p><button>OK</button>"])
            return self.wrap(self.NOTICE, inner, ("div", "div", "section", "aside", "p"))
        if kind == "form":
            return f"<form{self.attr(self.FORM, 0.5)}><label>{self.junk_text()}</label><input type=text>" + (f"<p>{self.junk_text()}</p>" if self.chance(0.5) else "") + "<button>Go</button></form>"
        items = "".join(self.pick([f'<li>{self.junk_text()}</li>', f'<div class="comment"><p>{self.junk_text()}</p></div>', f"<p>{self.junk_text()}</p>"]) for _ in range(int(r.integers(1, 7))))
        head = f"<h3>{self.junk_text()}</h3>" if self.chance(0.6) else ""
        return self.pick([f"<section{self.attr(self.COMMENTS)}>{head}{items}</section>", f"<div{self.attr(self.COMMENTS)}>{head}<ul>{items}</ul></div>"])

    def content(self, inside: tuple[str, ...]) -> str:
        out = []
        if self.chance(0.85):
            out.append(f"<h1{self.attr(['title', 'headline', 'entry-title'], 0.2)}>{self.text(self.sentence(2, 12), True)}</h1>")
        n = int(self.r.integers(1, 14)) if self.chance(0.8) else int(self.r.integers(14, 40))
        for _ in range(n):
            k = self.r.random()
            p = self.text(self.paragraph(), True)
            if k < 0.62:
                out.append(f"<p>{p}" + ("</p>" if self.chance(0.9) else ""))
            elif k < 0.78:
                out.append(self.pick([f"<p><b>{self.text(self.sentence(), True)}<br>", f"<h2>{self.text(self.sentence(2, 9), True)}</h2>", f"<h3>{self.text(self.sentence(2, 9), True)}</h3>"]))
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.text(self.sentence(), True)}</li>" for _ in range(int(self.r.integers(1, 6)))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote>{p}</blockquote>")
            elif k < 0.90:
                out.append(f"<pre>{p}</pre>")
            elif k < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{self.text(self.word(), True)}</td><td>{self.text(self.word(), True)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.95:
                out.append(f'<p>{self.text(self.sentence(), True)} <a href="/x">{self.word()}</a> {self.sentence()}</p>')
            elif inside:
                out.append(self.boiler(self.pick(list(inside))))
        return "".join(out)

    def page(self) -> tuple[list, np.ndarray]:
        """The blocks of a page and whether each is article text."""
        kinds = ["nav", "header", "ad", "notice", "side", "form"]
        before = [self.boiler(self.pick(kinds)) for _ in range(int(self.r.integers(0, 5)))]
        after = [self.boiler(self.pick(["footer", "footer", "comments", "side", "ad", "notice", "nav", "form"])) for _ in range(int(self.r.integers(0, 5)))]
        body = self.content(("ad", "notice", "side", "form") if self.chance(0.5) else ())
        if self.chance(0.15):
            body += self.boiler("comments")
        shape = self.r.random()
        if shape < 0.45:
            body = f"<article{self.attr(self.CONTENT, 0.3)}>{body}</article>"
        elif shape < 0.6:
            body = f"<main><div{self.attr(self.CONTENT, 0.6)}>{body}</div></main>"
        elif shape < 0.7:
            body = f"<main{self.attr(self.CONTENT, 0.2)}>{body}</main>"
        elif shape < 0.92:
            body = f"<div{self.attr(self.CONTENT)}>{body}</div>"
        else:
            body = f"<div id='wrap'><div{self.attr(self.CONTENT)}><article>{body}</article></div></div>"
        whole = "".join(before) + body + "".join(after)
        if self.chance(0.25):
            whole = f"<div{self.attr(['page', 'wrapper', 'container', 'site', 'layout'])}>{whole}</div>"
        page = f"<html><head><title>x</title><style>p{{}}</style></head><body>{whole}</body></html>"
        found, truth = [], []
        for text, path, depth, linked in page_blocks(page):
            mark = next((c for c in text if c in "\x01\x02"), None)
            clean = text.replace("\x01", "").replace("\x02", "").strip()
            if mark and clean:
                found.append((clean, path, depth, linked))
                truth.append(mark == "\x01")
        return found, np.array(truth, np.float32)


#: Weights that ``train_labeller`` made with its defaults; ``python -m gradeline.llm.html_text`` makes them again.
WEIGHTS = Path(__file__).with_name("html_labeller.npz")
_trained: list[BlockLabeller] = []


def train_labeller(pages: int = 700, epochs: int = 8, seed: int = 5) -> BlockLabeller:
    """A labeller trained on pages of the generator."""
    maker = PageMaker(seed)
    made = [p for p in (maker.page() for _ in range(pages)) if len(p[1]) and len(p[1]) <= 120]
    labeller = BlockLabeller(seed)
    labeller.train([(vectors(found), truth) for found, truth in made], epochs)
    return labeller


def trained_labeller() -> BlockLabeller:
    """The labeller with the stored weights, or a newly trained one where there are none; once for each process."""
    if not _trained:
        if WEIGHTS.exists():
            labeller = BlockLabeller()
            with np.load(WEIGHTS) as held:
                labeller.p = {k: held[k] for k in labeller.p}
        else:
            labeller = train_labeller()
        _trained.append(labeller)
    return _trained[0]


def main_text(pages: list[str | None], labeller: BlockLabeller) -> list[str]:
    """The article text of each page."""
    found = [page_blocks(p or "") for p in pages]
    labels = labeller.label(found)
    return ["\n".join(b[0] for b, good in zip(f, keep, strict=False) if good) for f, keep in zip(found, labels, strict=True)]


def extract_pages(pages: DataFrame, labeller: BlockLabeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    prepare(pages.sparkSession)
    labeller = labeller or trained_labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = main_text(part.column("html").to_pylist(), labeller)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    picked = pages.selectExpr("cast(page_id as long) as page_id", "url", "html")
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train_labeller().p)
