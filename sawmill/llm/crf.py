"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A leaf block is a run of text between two borders of block elements.  Its features are the tags, class and id words and
roles of its ancestors and the shape of its text; the two labels are main and other.  The field is trained on labelled
pages (maximum likelihood by forward-backward and Adam) and pages are decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowmap import map_texts

_BLOCKS = frozenset("html head title body header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend label button select option textarea address details summary dialog hr noscript iframe menu center ins hgroup optgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ALONE = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "head": (), "body": ("head", "title", "p")}
_STOPS = frozenset("ul ol dl table td th div section article aside main body blockquote form nav header footer".split())
_ENDS_P = _BLOCKS - frozenset("html head title body button label option select ins noscript iframe".split())
_LEAD = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|</?[!?]", re.S)
_SPECIAL = re.compile(r"[>\"']")
_RAW = re.compile(r"(script|style)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style")}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _markup(page: str):
    """(start, end, slash, tag, attributes, raw) of each piece of markup from a place that is sent in: a tag is None for
    comments and the like; raw, script or style where its text is to be skipped.

    A tag ends at the first > outside quotes, or at the first of all if a quote in it is never closed.  Where the quotes
    behind a place lead to is remembered, so stray quotes cost a page its size and not its square.
    """
    ends: dict[int, int] = {}
    last = page.rfind(">")

    def quoted_end(at: int) -> int:
        seen, found = [], -1
        while m := _SPECIAL.search(page, at):
            q = m.start()
            if page[q] == ">":
                found = q
                break
            if q in ends:
                found = ends[q]
                break
            seen.append(q)
            at = page.find(page[q], q + 1) + 1
            if not at:
                break
        ends.update(dict.fromkeys(seen, found))
        return found

    at = yield
    while m := _LEAD.search(page, at):
        start, behind = m.span()
        if m[2] is None:
            if not page.startswith("<!--", start):
                # a declaration ends at the next >; a page that ends within markup has none
                behind = page.find(">", behind) + 1 if page[start + 1] != "/" else 0
                if not behind:
                    if last > start:
                        at = m.end()
                        continue
                    behind = len(page)
            at = yield start, behind, "", None, "", None
            continue
        end = quoted_end(behind)
        raw = _RAW.match(m[2]) if end >= 0 and not m[1] else None
        if end < 0:
            end = page.find(">", behind)
        if end < 0:
            at = yield start, len(page), "", None, "", None
        elif raw:
            at = yield start, end + 1, "", None, page[start + 1 + raw.end() : end], raw[1].lower()
        else:
            at = yield start, end + 1, m[1], m[2], page[behind:end], None


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = ["t:" + tag]
    for kind, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        for w in _PART.findall(value):
            out.append(("r:" if kind.lower() == "role" else "c:") + w.lower())
    if attributes and _HIDDEN.search(attributes):
        out.append("hidden")
    return tuple(dict.fromkeys(out))


class Names:
    """The names of an element and its ancestors: a chain, of which each link holds those that the links above lack, so that
    deep pages cost their size and not its square."""

    __slots__ = ("above", "new")

    def __init__(self, above: Names | None, new: tuple[str, ...]):
        self.above, self.new = above, new


@dataclass
class Block:
    """``within``: names of all ancestors; ``others``: the features that are the block's own."""

    text: str
    within: Names | None
    others: list[str]

    @property
    def features(self) -> list[str]:
        chain, at = [], self.within
        while at is not None:
            chain.append(at.new)
            at = at.above
        return ["in " + x for new in reversed(chain) for x in new] + self.others


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, broken pages included; scripts, styles and comments are no text.

    Tags of other elements than blocks just go, svg, math, object, canvas and template among them: their text is that of
    the block that they stand in, or of the blocks within them.
    """
    out: list[Block] = []
    # (tag, own names, names of all ancestors and itself)
    stack: list[tuple[str, tuple, Names]] = [("", (), Names(None, ()))]
    opened: dict[str, int] = {}  # open elements of each tag
    known: set[str] = set()  # names of all open elements
    parts: list[str] = []
    linked = [0, 0]  # raw characters inside links, depth of links
    cache: dict[tuple, tuple] = {}

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join(entities.unescape(raw).split()) if not raw.isspace() else ""
            if text:
                tag, own, names = stack[-1]
                out.append(Block(text, names, ["own " + x for x in own] + _shape(text, linked[0] / max(1, len(raw)))))
            linked[0] = 0

    def cut(i: int) -> None:
        for tag, _, names in stack[i:]:
            opened[tag] -= 1
            known.difference_update(names.new)
        del stack[i:]

    def close(tag: str) -> None:
        if not opened.get(tag):
            return
        i = len(stack) - 1
        while stack[i][0] != tag:
            i -= 1
        flush()
        cut(i)

    at = foreign = 0
    markup = _markup(page)
    next(markup)
    while True:
        try:
            start, end, ends, tag, attributes, raw = markup.send(at)
        except StopIteration:
            break
        if start > at:
            t = page[at:start]
            parts.append(t)
            if linked[1]:
                linked[0] += len(t)
        at = end
        if raw:
            # up to its end, or that of the page; within svg or math it may end itself, as in XML
            if not (foreign and attributes.endswith("/")):
                at = _RAW_END[raw].search(page, at).end()
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _BLOCKS:
            if tag in ("svg", "math") and not (attributes and attributes.endswith("/")):
                foreign = max(0, foreign + (-1 if ends else 1))
            if tag == "a":
                linked[1] = max(0, linked[1] + (-1 if ends else 1)) if ends or not linked[1] else linked[1]
            elif tag in ("br", "img", "input", "wbr"):
                parts.append(" ")
            continue
        if ends:
            close(tag)
            continue
        flush()
        linked[1] = 0
        alone = _ALONE.get(tag, ())
        ended = any(opened.get(x) for x in alone) or (opened.get("p") and tag in _ENDS_P)
        for i in range(len(stack) - 1, 0, -1) if ended else ():
            if stack[i][0] in alone or (stack[i][0] == "p" and tag in _ENDS_P):
                cut(i)
                break
            if stack[i][0] in _STOPS and stack[i][0] not in alone:
                break
        if tag in _VOID:
            continue
        own = cache.get((tag, attributes))
        if own is None:
            own = cache[tag, attributes] = _names(tag, attributes)
        new = tuple(x for x in own if x not in known)
        known.update(new)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, own, Names(stack[-1][2], new)))
    if at < len(page):
        parts.append(page[at:])
    flush()
    for i, b in enumerate(out):
        b.others.append(f"place {i * 5 // max(1, len(out))}")
    if out:
        out[0].others.append("first")
        out[-1].others.append("last")
    return out


def _shape(text: str, link: float) -> list[str]:
    n = text.count(" ") + 1
    out = ["any", f"links {int(min(link, 0.999) * 4) if link else -1}", f"words {n.bit_length()}"]
    if text[-1] in ".!?…:\"”»":
        out.append("ends")
    if "©" in text or "(c)" in text:
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    if n > 2 and text.isupper():
        out.append("upper")
    if "," in text:
        out.append("comma")
    if "@" in text or "http" in text:
        out.append("address")
    return out


@dataclass
class Field:
    """weight: of main by feature; move[i][j]: of label j behind label i; start, stop: of the first and last label."""

    weight: dict[str, float]
    move: list[list[float]]
    start: list[float]
    stop: list[float]

    def evidence(self, found: list[Block]) -> list[float]:
        """Of each block the sum of its features' weights for main; those of a chain of names are summed once."""
        get, sums, out = self.weight.get, {None: 0.0}, []
        for block in found:
            chain, at = [], block.within
            while at not in sums:
                chain.append(at)
                at = at.above
            total = sums[at]
            for at in reversed(chain):
                total = sums[at] = total + sum([get("in " + x, 0.0) for x in at.new])
            out.append(total + sum([get(f, 0.0) for f in block.others]))
        return out

    def labels(self, found: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to other."""
        if not found:
            return []
        (m00, m01), (m10, m11) = self.move
        back, a, b = [], 0.0, 0.0
        for i, e in enumerate(self.evidence(found)):
            if not i:
                a, b = self.start[0], self.start[1] + e
                continue
            x, y, z, w = a + m00, b + m10, a + m01, b + m11
            back.append((y > x, w > z))
            a, b = max(x, y), max(z, w) + e
        now = int(b + self.stop[1] > a + self.stop[0])
        out = [now]
        for step in reversed(back):
            now = int(step[now])
            out.append(now)
        return out[::-1]

    def main_text(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, keep in zip(found, self.labels(found), strict=True) if keep)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 220, rate: float = 0.08, l2: float = 3e-5) -> Field:
    """Maximum likelihood of the labels of ``pages`` (all of them in each step)."""
    pages = [p for p in pages if p[0]]
    names = {f: i for i, f in enumerate(sorted({f for found, _ in pages for b in found for f in b.features}))}
    n, long = len(pages), max((len(p[0]) for p in pages), default=0)
    index = [np.array([names[f] for f in b.features]) for found, _ in pages for b in found]
    flat = np.concatenate(index) if index else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(index)), [len(x) for x in index]) if index else flat
    page = np.repeat(np.arange(n), [len(p[0]) for p in pages]) if n else flat
    place = np.concatenate([np.arange(len(p[0])) for p in pages]) if n else flat
    gold = np.concatenate([np.array(p[1]) for p in pages]) if n else flat
    size = np.array([len(p[0]) for p in pages])
    y = np.zeros((n, long), np.int64)
    y[page, place] = gold
    inside = np.arange(long)[None, :] < size[:, None]
    params = np.zeros(len(names) + 8)
    k = len(names)
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for step in range(1, rounds + 1 if n else 1):
        w, move, start, stop = params[:k], params[k : k + 4].reshape(2, 2), params[k + 4 : k + 6], params[k + 6 :]
        e = np.zeros((n, long, 2))
        e[page, place, 1] = np.bincount(of, w[flat], len(index))
        f = np.zeros((n, long, 2))
        f[:, 0] = e[:, 0] + start
        for t in range(1, long):
            f[:, t] = np.logaddexp(f[:, t - 1, :1] + move[0], f[:, t - 1, 1:] + move[1]) + e[:, t]
        g = np.zeros((n, long, 2))
        g[rows, size - 1] = stop
        for t in range(long - 2, -1, -1):
            later = np.logaddexp(move[:, 0] + (e[:, t + 1, :1] + g[:, t + 1, :1]), move[:, 1] + (e[:, t + 1, 1:] + g[:, t + 1, 1:]))
            g[:, t] = np.where((t < size - 1)[:, None], later, g[:, t])
        z = np.logaddexp(*(f[rows, size - 1] + stop).T)
        p = np.exp(f + g - z[:, None, None]) * inside[:, :, None]
        grad = np.zeros_like(params)
        grad[:k] = np.bincount(flat, (p[page, place, 1] - gold)[of], k)
        pair = inside[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                both = np.exp(np.minimum(f[:, :-1, i] + move[i, j] + e[:, 1:, j] + g[:, 1:, j] - z[:, None], 0)) * pair
                grad[k + 2 * i + j] = both.sum() - ((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum()
            grad[k + 4 + i] = p[:, 0, i].sum() - (y[:, 0] == i).sum()
            grad[k + 6 + i] = p[rows, size - 1, i].sum() - (y[rows, size - 1] == i).sum()
        grad = grad / n + l2 * params
        m1 += 0.1 * (grad - m1)
        m2 += 0.01 * (grad * grad - m2)
        params = params - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    weight = {f: float(params[i]) for f, i in names.items() if abs(params[i]) > 1e-4}
    tail = params[k:].tolist()
    return Field(weight, [tail[0:2], tail[2:4]], tail[4:6], tail[6:8])


def extract(df: DataFrame, field: Field, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``text``, the page's main blocks joined by line feeds ('' if none).  Null, empty and broken
    pages are pages like others; every row stays.  A column named ``text`` is replaced."""
    held = df.sparkSession.sparkContext.broadcast(field)
    make = lambda: lambda pages: [pa.array([held.value.main_text(p.decode("utf-8", "replace")) for p in pages], pa.string())]
    return map_texts(df, html_col, make, [T.StructField("text", T.StringType())], keep)
