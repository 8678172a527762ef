"""Main-text extraction by a recurrent labeller of a page's blocks.

A page is read into blocks, the texts between block-level tags, in page order.  Each block becomes
a vector of its hashed tag path (with the words of class, id and role), its hashed words and a few
counts.  A bidirectional LSTM in numpy reads the sequence of a page's vectors and labels every
block with the whole page as context; the blocks labelled as main text are the result.

The network is trained here, on pages that ``layouts`` writes from a fixed seed in many common
layouts, so the model is the same for every input and never sees the pages it is applied to.

Scripts, styles, templates, controls and the head hold no blocks at all.  White space inside a block
(``br`` included) becomes one space, character references are decoded, blocks are joined by LF.

Defined cases: null or empty html, and a page without main text, give an empty text; unclosed or
stray tags never fail; a page of any length is read whole; repeated rows give equal results;
further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.shared import fresh_names, lean, without
from rillmark.llm.words import words

PATHS, WORDS, COUNTS = 160, 32, 10
HIDDEN = 20
SEED = 11
#: A comment, a tag, or a bogus comment; what never ends runs to the end of the page, so that no place
#: is read twice.  Quotes only delimit a value right behind an equals sign.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+")
_DIGIT = re.compile(r"\d")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_SKIP = {"head", "template", "noscript", "select", "button", "svg", "math", "object", "audio", "video", "canvas", "datalist"}
#: Start tags that don't end an open head; its end tag may be left out.
_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
#: Open elements that a block's path or an implied end tag looks at, at either end of a deeper stack.
_DEPTH = 128
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = {"article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # slots of the hashed tag path
    linked: int  # characters inside links
    label: int  # of a training page: 1 main, 0 other


def _slot(text: str) -> int:
    value = 2166136261
    for byte in text.encode():
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return (value ^ value >> 15) % PATHS


@cache
def _element_slots(tag: str, names: str) -> tuple[int, ...]:
    parts = {part.lower() for part in _PART.findall(names)}
    return (_slot("<" + tag), *sorted(_slot("." + part) for part in parts))


@cache
def _leaf_slot(tag: str) -> int:
    return _slot("leaf " + tag)


def blocks(page: str) -> Iterator[Block]:
    """The non-empty blocks of a page in order; its time is linear in the page."""
    stack: list[tuple[str, tuple[int, ...], int]] = []
    count: Counter[str] = Counter()  # of the open elements
    parts: list[str] = []
    linked = anchors = 0
    at = skipping = 0

    def close() -> Block | None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        own, linked = linked, 0
        parts.clear()
        if not text:
            return None
        near = stack if len(stack) <= 2 * _DEPTH else stack[:_DEPTH] + stack[-_DEPTH:]
        leaf = next((tag for tag, _, _ in reversed(near) if tag not in _INLINE), "")
        path = {slot for _, slots, _ in near for slot in slots} | {_leaf_slot(leaf)}
        label = next((y for _, _, y in reversed(near) if y >= 0), 0)
        return Block(text, tuple(path), own, label)

    def leave(keep: int) -> None:
        """End the open elements from the one at ``keep`` on."""
        nonlocal skipping, anchors
        for gone, _, _ in stack[keep:]:
            skipping -= gone in _SKIP
            anchors -= gone == "a"
            count[gone] -= 1
        del stack[keep:]

    def leave_head(body: bool = False) -> None:
        """End an innermost open head, or any when the body begins."""
        if body and count["head"]:
            leave([x[0] for x in stack].index("head"))
        elif stack and stack[-1][0] == "head":
            leave(len(stack) - 1)

    def text(piece: str) -> None:
        nonlocal linked
        if skipping and piece.strip():
            leave_head()
        if piece and not skipping:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if anchors:
                linked += len(piece.strip())

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if not count[tag]:
                if tag in ("br", "p") and not skipping and (block := close()):
                    yield block
                continue
            keep, crossing = len(stack) - 1, False
            while stack[keep][0] != tag and not crossing:
                crossing = tag in _INLINE and stack[keep][0] not in _INLINE
                keep -= 1
            if crossing:
                continue  # an inline end tag doesn't end blocks
            if tag not in _INLINE and not skipping and (block := close()):
                yield block
            leave(keep)
            continue
        if skipping and tag not in _HEAD:
            leave_head(tag == "body")
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            if not skipping:
                parts.append(" ")
            continue
        if tag not in _INLINE:
            if not skipping and (block := close()):
                yield block
            ends = _CLOSES.get(tag, {"p"} if tag in _ENDS_P else ())
            if ends:
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - _DEPTH), -1):
                    if stack[k][0] in ends:
                        leave(k)
                    elif stack[k][0] not in _INLINE:
                        break
        if tag in _VOID or found[3].endswith("/") and tag not in _INLINE:
            continue
        names = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(found[3])) if "=" in found[3] else ""
        label = int(found[3][found[3].index("data-y=") + 8]) if "data-y=" in found[3] and found[3][found[3].index("data-y=") + 8 :][:1] in ("0", "1") else -1
        stack.append((tag, _element_slots(tag, names), label))
        count[tag] += 1
        skipping += tag in _SKIP
        anchors += tag == "a"
    if not skipping and (block := close()):
        yield block


def vectors(found: list[Block]) -> np.ndarray:
    """One row of features for each block."""
    out = np.zeros((len(found), PATHS + WORDS + COUNTS), np.float32)
    if not found:
        return out
    n = np.array([len(b.path) for b in found])
    out[np.repeat(np.arange(len(found)), n), np.concatenate([np.array(b.path) for b in found])] = 1
    texts = [b.text for b in found]
    for part in words(pa.array(texts, pa.large_string())):
        rows = np.repeat(np.arange(part.first, part.first + len(part.at) - 1), np.diff(part.at))
        np.add.at(out, (rows, PATHS + (part.hashes % np.uint64(WORDS)).astype(np.int64)), 1)
    counts = out[:, PATHS : PATHS + WORDS]
    total = counts.sum(1)
    counts /= np.maximum(total, 1)[:, None]
    length = np.array([len(t) for t in texts], np.float32)
    marks = np.array([sum(map(t.count, ".,;:!?")) for t in texts], np.float32)
    place = PATHS + WORDS
    out[:, place] = np.log1p(length) / 6
    out[:, place + 1] = np.log1p(total) / 4
    out[:, place + 2] = np.minimum(1, np.array([b.linked for b in found]) / np.maximum(length, 1))
    out[:, place + 3] = np.minimum(1, marks / np.maximum(total, 1))
    out[:, place + 4] = [t[-1] in ".!?:;\"'" for t in texts]
    out[:, place + 5] = ["©" in t for t in texts]
    out[:, place + 6] = [t[:1].isupper() for t in texts]
    out[:, place + 7] = length > 200
    out[:, place + 8] = [_DIGIT.search(t) is not None for t in texts]
    out[:, place + 9] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output over both states."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for side in "fb":
            self.p[side + "x"] = draw.normal(0, 0.15, (inputs, 4 * hidden))
            self.p[side + "h"] = draw.normal(0, 0.15, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p[side + "c"] = bias
        self.p["o"] = draw.normal(0, 0.3, 2 * hidden)
        self.p["d"] = np.zeros(1)

    def _run(self, side: str, x: np.ndarray, live: np.ndarray, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        """x: (lanes, steps, 4 hidden), inputs already multiplied; live: (lanes, steps); from ``state`` on,
        and the state at the end."""
        h, c = state or np.zeros((2, x.shape[0], self.hidden))
        states, trace = np.zeros((x.shape[0], x.shape[1], self.hidden)), []
        n = self.hidden
        order = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
        for t in order:
            gates = x[:, t] + h @ self.p[side + "h"]
            i, f, o = _sigmoid(gates[:, :n]), _sigmoid(gates[:, n : 2 * n]), _sigmoid(gates[:, 2 * n : 3 * n])
            g = np.tanh(gates[:, 3 * n :])
            mask = live[:, t, None]
            new = f * c + i * g
            if keep:
                trace.append((t, h, c, i, f, o, g, new, mask))
            c = np.where(mask, new, c)
            h = np.where(mask, o * np.tanh(new), h)
            states[:, t] = h
        return states, trace, (h, c)

    def odds(self, pages: list[list[Block]], most_blocks: int) -> list[np.ndarray]:
        """Probability of main text for each block of each page.

        Both directions go over windows of ``most_blocks`` blocks at most and carry their states on, so a page of
        any length needs the memory of a window."""
        lengths = np.array([len(p) for p in pages])
        steps, width = int(lengths.max()), max(1, most_blocks // len(pages))
        out = np.full((len(pages), steps), self.p["d"][0])
        places = list(range(0, steps, width))
        x = None
        for k, side in enumerate("fb"):
            state = None
            for w in places if side == "f" else reversed(places):
                live = np.arange(w, min(w + width, steps)) < lengths[:, None]
                if x is None or len(places) > 1:
                    x = vectors([b for p in pages for b in p[w : w + width]])
                padded = np.zeros((*live.shape, 4 * self.hidden))
                padded[live] = x @ self.p[side + "x"] + self.p[side + "c"]
                states, _, state = self._run(side, padded, live, False, state)
                out[:, w : w + width] += states @ self.p["o"][k * self.hidden : (k + 1) * self.hidden]
        return [_sigmoid(row[:n]) for row, n in zip(out, lengths, strict=True)]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        lanes, steps, n = len(lengths), int(lengths.max()), self.hidden
        live = np.arange(steps) < lengths[:, None]
        runs, out = {}, np.full((lanes, steps), self.p["d"][0])
        for k, side in enumerate("fb"):
            padded = np.zeros((lanes, steps, 4 * n))
            padded[live] = x @ self.p[side + "x"] + self.p[side + "c"]
            runs[side] = self._run(side, padded, live, True)
            out += runs[side][0] @ self.p["o"][k * n : (k + 1) * n]
        p = _sigmoid(out[live])
        loss = -float(np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
        error = np.zeros((lanes, steps))
        error[live] = (p - y) / len(y)
        slopes = {"d": np.array([error.sum()]), "o": np.concatenate([np.einsum("ls,lsh->h", error, runs[s][0]) for s in "fb"])}
        for k, side in enumerate("fb"):
            own = self.p["o"][k * n : (k + 1) * n]
            inputs = np.zeros((lanes, steps, 4 * n))
            back = np.zeros_like(self.p[side + "h"])
            dh, dc = np.zeros((lanes, n)), np.zeros((lanes, n))
            for t, h, c, i, f, o, g, new, mask in reversed(runs[side][1]):
                dh_all = dh + error[:, t, None] * own
                squashed = np.tanh(new)
                dnew = np.where(mask, dc + dh_all * o * (1 - squashed**2), 0)
                gates = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), np.where(mask, dh_all * squashed, 0) * o * (1 - o), dnew * i * (1 - g**2)], 1)
                inputs[:, t] = gates
                back += h.T @ gates
                dh = np.where(mask, gates @ self.p[side + "h"].T, dh_all)
                dc = np.where(mask, dnew * f, dc)
            flat = inputs[live]
            slopes[side + "x"], slopes[side + "h"], slopes[side + "c"] = x.T @ flat, back, flat.sum(0)
        return loss, slopes


# ---------------------------------------------------------------------------------------------
# Training pages.  Fixed values: names that pages commonly give to their parts.
MAIN_NAMES = ["content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text", "article", "page-content", "entry", "body-text"]
MENU_NAMES = ["menu", "nav", "navbar", "main-nav", "breadcrumb", "breadcrumbs", "topbar", "navigation", "site-menu", "toc", "skip-links"]
SIDE_NAMES = ["sidebar", "widget", "related", "recommended", "popular", "more-stories", "aside", "tags", "trending", "secondary", "rail"]
NOTICE_NAMES = ["cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "overlay", "paywall", "disclaimer"]
ADVERT_NAMES = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor", "promotion"]
SHARE_NAMES = ["share", "social", "pagination", "pager", "share-buttons", "follow", "toolbar", "meta-links"]
FOOT_NAMES = ["footer", "site-footer", "copyright", "bottom", "page-footer", "legal", "colophon"]
HEAD_NAMES = ["header", "site-header", "masthead", "logo", "branding", "top", "page-header"]
FORM_NAMES = ["newsletter", "subscribe", "login", "search", "signup", "search-form", "contact-form"]
COMMENT_NAMES = ["comments", "comment-list", "comment", "responses", "discussion", "replies", "disqus", "comment-body"]


def layouts(seed: int, pages: int) -> Iterator[str]:
    """Training pages; ``data-y`` tells whether what an element holds is main text."""
    draw = np.random.default_rng(seed)
    syllables = ["".join(draw.choice(list("bcdfghklmnprstvwz"), 1)) + "".join(draw.choice(list("aeiouéüñ"), 1)) + "".join(draw.choice(["", "n", "r", "s", "t", "l"], 1)) for _ in range(80)]

    def chance(p: float) -> bool:
        return draw.random() < p

    def one(options: list[str]) -> str:
        return options[draw.integers(len(options))]

    def phrase(n: int) -> str:
        return " ".join("".join(one(syllables) for _ in range(draw.integers(1, 4))) for _ in range(n))

    def sentence() -> str:
        out = phrase(int(draw.integers(1, 18))).capitalize()
        return out.replace(" ", ", ", 1) + one([".", ".", ".", "!", "?"]) if chance(0.3) else out + "."

    def paragraph() -> str:
        if chance(0.06):  # cells or words in a row
            return one([" | ", " ", ", ", " - "]).join(phrase(1) for _ in range(int(draw.integers(1, 14)))) + one(["", ".", " |"])
        out = " ".join(sentence() for _ in range(int(draw.choice([1, 1, 1, 2, 3, 5, 8]))))
        if chance(0.15):
            out = f'{out} <a href="/x">{phrase(2)}</a> {sentence()}'
        return f"<b>{out}</b>" if chance(0.05) else out

    def links(n: int, y: str = "") -> str:
        item = one(["li", "li", "span", "div", "p"])
        inner = "".join(f'<{item}><a href="/{i}">{phrase(int(draw.integers(1, 4)))}</a></{item}>' for i in range(n))
        return f"<ul{y}>{inner}</ul>" if item == "li" else f"<div{y}>{inner}</div>"

    def named(tags: list[str], names: list[str], inner: str, bare: float = 0.2) -> str:
        tag = one(tags)
        attribute = "" if chance(bare) and tag != "div" else f' {one(["class", "class", "id"])}="{one(names)}"'
        return f'<{tag}{attribute} data-y="0">{inner}</{tag}>'

    def few(inner, most: int = 3) -> str:
        return "".join(inner() for _ in range(int(draw.integers(1, most + 1))))

    def plain() -> str:
        tag = one(["p", "p", "div", "span", "p"])
        return f"<{tag}>{sentence() if chance(0.6) else paragraph()}</{tag}>" if chance(0.7) else sentence()

    def menu() -> str:
        return named(["nav", "nav", "div", "ul"], MENU_NAMES, links(int(draw.integers(2, 9))), 0.6)

    def advert() -> str:
        return named(["div", "div", "aside", "section"], ADVERT_NAMES, few(plain, 2), 0.1)

    def notice() -> str:
        return named(["div", "section", "aside"], NOTICE_NAMES, few(plain, 2) + ("<button>ok</button>" if chance(0.5) else ""), 0)

    def side() -> str:
        return named(["aside", "aside", "div", "section"], SIDE_NAMES, f"<h3>{phrase(2)}</h3>" * chance(0.6) + (links(int(draw.integers(2, 7))) if chance(0.6) else few(plain)), 0.4)

    def share() -> str:
        return named(["div", "ul"], SHARE_NAMES, links(int(draw.integers(2, 5))), 0)

    def form() -> str:
        return named(["form", "form", "div"], FORM_NAMES, f"<form><label>{phrase(2)}</label><input> {plain()}</form>" if chance(0.5) else f"<p>{sentence()}</p><label>{phrase(1)}</label><input name='q'>", 0.5)

    def comments() -> str:
        each = "".join(f'<{t} class="{one(COMMENT_NAMES)}"><b>{phrase(1)}</b><p>{paragraph()}</p></{t}>' for t in [one(["li", "div", "article"])] * int(draw.integers(1, 6)))
        return named(["section", "div", "ol", "div"], COMMENT_NAMES, f"<h3>{phrase(2)}</h3>" * chance(0.6) + each, 0)

    def footer() -> str:
        inner = f"&copy; {phrase(2)} &middot; {sentence()}" if chance(0.5) else few(plain, 2) + links(int(draw.integers(2, 6))) * chance(0.6)
        return named(["footer", "footer", "div"], FOOT_NAMES, inner, 0.6)

    def header() -> str:
        inner = f"<h1>{phrase(2)}</h1>" * chance(0.4) + f"<a href='/'>{phrase(2)}</a>" * chance(0.7) + f"<p>{sentence()}</p>" * chance(0.5) + menu() * chance(0.4)
        return named(["header", "header", "div"], HEAD_NAMES, inner, 0.6)

    def body() -> str:
        kind = draw.random()
        if kind < 0.62:
            tag = "div" if chance(0.06) else "p"
            return f"<{tag}>{paragraph()}" + f"</{tag}>" * (tag == "div" or chance(0.9))
        if kind < 0.70:
            return f"<p><b>{paragraph()}<br>"
        if kind < 0.78:
            return f"<h{draw.integers(2, 5)}>{phrase(int(draw.integers(1, 8))).capitalize()}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(int(draw.integers(2, 6)))) + "</ul>"
        if kind < 0.90:
            return f"<blockquote><p>{paragraph()}</p></blockquote>" if chance(0.6) else f"<blockquote>{paragraph()}</blockquote>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{phrase(2)}</td><td>{draw.integers(1, 999)}</td></tr>" for _ in range(int(draw.integers(1, 5)))) + "</table>"
        if kind < 0.96:
            return f"<figure><img src='/i'><figcaption>{sentence()}</figcaption></figure>"
        return f"<pre>{phrase(6)}</pre>"

    def article() -> str:
        title = f"<h1>{phrase(int(draw.integers(1, 12))).capitalize()}</h1>"
        if chance(0.15):
            title = f"<header>{title}</header>"
        inner = [title * chance(0.85)] + [body() for _ in range(int(draw.choice([1, 2, 3, 5, 8, 12, 18])))]
        for extra, p in ((advert, 0.2), (share, 0.15), (side, 0.12), (notice, 0.08), (form, 0.08)):
            if chance(p):
                inner.insert(int(draw.integers(1, len(inner) + 1)), extra())
        if chance(0.12):
            inner.append(comments())
        if chance(0.1):
            inner.append(f'<footer data-y="0"><p>{sentence()}</p></footer>')
        tag = one(["article", "article", "article", "main", "div", "section"])
        attribute = f' {one(["class", "id"])}="{one(MAIN_NAMES)}"' if tag in ("div", "section") or chance(0.3) else ""
        out = f'<{tag}{attribute} data-y="1">{"".join(inner)}</{tag}>'
        return f"<main>{out}</main>" if chance(0.15) else out

    for _ in range(pages):
        parts = []
        for part, p in ((notice, 0.25), (header, 0.5), (menu, 0.75), (advert, 0.4), (form, 0.15), (side, 0.15)):
            if chance(p):
                parts.append(part())
        parts.append(article() if chance(0.97) else "")
        for part, p in ((share, 0.2), (comments, 0.3), (side, 0.35), (form, 0.2), (advert, 0.25), (footer, 0.85), (notice, 0.1)):
            if chance(p):
                parts.append(part())
        inner = "".join(parts)
        if chance(0.3):
            inner = f'<div id="{one(["page", "wrapper", "container", "site", "root"])}">{inner}</div>'
        yield f"<html><head><title>{phrase(3)}</title></head><body>{inner}" + "</body></html>" * chance(0.9)


def train(pages: int = 1500, epochs: int = 5, batch: int = 24, seed: int = SEED) -> Labeller:
    """Fit the labeller with Adam on ``pages`` generated pages."""
    read = [(vectors(found), np.array([b.label for b in found], float)) for found in (list(blocks(page)) for page in layouts(seed, pages)) if found]
    model = Labeller(PATHS + WORDS + COUNTS, HIDDEN, seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    draw, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = draw.permutation(len(read))
        order = np.concatenate([c[np.argsort([len(read[i][1]) for i in c])] for c in np.array_split(order, 4)])
        starts = draw.permutation(np.arange(0, len(order), batch))
        for i in starts:
            own = [read[j] for j in order[i : i + batch]]
            x, y = np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own])
            _, slopes = model.gradients(x, np.array([len(o[1]) for o in own]), y)
            step += 1
            rate = 0.012 * (0.5**epoch if epoch > 1 else 1)
            for k, g in slopes.items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


@cache
def trained() -> Labeller:
    """The process's labeller: the same for every process, as all seeds are fixed."""
    return train()


def main_texts(model: Labeller, pages: list[str], most_blocks: int = 20_000) -> list[str]:
    """The main text of every page; pages of like length are labelled together."""
    read = [list(blocks(page)) for page in pages]
    out = [""] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(read[i])) if read[i]]
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * len(read[order[end]]) <= most_blocks:
            end += 1
        own = order[begin:end]
        for i, p in zip(own, model.odds([read[i] for i in own], most_blocks), strict=True):
            out[i] = "\n".join(b.text for b, q in zip(read[i], p, strict=True) if q >= 0.5)
        begin = end
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``pages`` with main_text and n_chars (its code points).

    A kept column with the name of a result is left out."""
    keep = without([c for c in pages.columns if c != html_col] if keep is None else keep, "main_text", "n_chars")
    [body] = fresh_names(pages, "body")
    shared = pages.sparkSession.sparkContext.broadcast(trained().p)
    rows = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias(body))
    schema = pages.select(*keep, F.lit("").alias("main_text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(PATHS + WORDS + COUNTS, HIDDEN, SEED)
        model.p = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                texts = main_texts(model, batch.column(body).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(lean(run), schema)
