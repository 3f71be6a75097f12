"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags.  A block is described by hashed vectors of its whole
tag path (the distinct tags, classes, ids and roles of all open elements, at any depth), hashed vectors of all its words,
and a few shape numbers; a bidirectional LSTM in numpy reads the page's whole sequence of blocks in both directions, and a
logistic output says for each block whether it belongs to the article.

A page's labels depend on the page alone: sums run element by element in a fixed order, whatever pages are in the batch.
Pages of like length run together, `CELLS` padded blocks at most, and a longer page alone, so memory grows with the
longest page and not with its company.

The labeller is trained here, on pages composed by a seeded generator (menus, headers, footers, sidebars, notices,
adverts, forms, comments around and inside an article, in many spellings), so it learns from structure and needs no
labelled crawl.  Training takes seconds and is done once per process.

Defined results: null and empty pages have an empty text; every page is read whole, however long; rows that repeat an id
are extracted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_NAMED = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_RAW = re.compile(r"<(script|style|noscript|template|textarea|svg|iframe|select|object)\b", re.I)
_ENDS = re.compile("""[>"']""")
_MARKS = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
# Tags inside a line of text, tags without content, and tags that a paragraph ends at.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

PATH_BUCKETS, WORD_BUCKETS, DIM, WORD_DIM, SHAPES, HIDDEN = 2_048, 2_048, 20, 8, 8, 16
IN = DIM + WORD_DIM + SHAPES
#: Padded blocks of pages that run together, pages of them, blocks that are described at a time, and numbers that a stretch of the recurrence holds.
CELLS, TOGETHER, SLICE, STRETCH = 32_768, 64, 2_048, 1 << 20


class Element:
    """An open element with the marks of its own tag, and the element around it."""

    __slots__ = ("name", "marks", "above", "buckets")

    def __init__(self, name: str, marks: tuple[str, ...], above: Element | None):
        self.name, self.marks, self.above, self.buckets = name, marks, above, None

    def path(self) -> tuple[str, ...]:
        own, at = [], self
        while at:
            own.append(at.marks)
            at = at.above
        return tuple(x for marks in reversed(own) for x in marks)


@dataclass(slots=True)
class Block:
    element: Element | None
    text: str
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        """Marks of all open elements, the outermost first."""
        return self.element.path() if self.element else ()


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """The places of >, " and ' in a page, and for each where a tag ends that is outside of quotes there: after the next > that no
    quotes hold, or -1 where there is none.  One pass from the end, since what follows a place is the same for all tags before it."""
    at = [m.start() for m in _ENDS.finditer(page)]
    ends = [-1] * (len(at) + 1)
    following = {'"': -1, "'": -1}  # the next one of each quote
    for k in range(len(at) - 1, -1, -1):
        c = page[at[k]]
        if c == ">":
            ends[k] = at[k] + 1
        else:
            if following[c] >= 0:
                ends[k] = ends[following[c] + 1]
            following[c] = k
    return at, ends


def _tags(page: str) -> Iterator[tuple[int, int, str, str | None, str]]:
    """Markup in order: (start, end, "/" of a closing tag, name, attributes); comments, declarations, and elements whose content
    is no text have no name.  A < that begins none of these is text.  The time is linear in the page, however it is broken."""
    places, ends = _tag_ends(page)
    closing: dict[str, re.Pattern] = {}
    declared = True  # whether a > may still follow
    at = page.find("<")
    while at >= 0:
        end, close, name, attributes = -1, "", None, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at + 2) + 1 if declared else 0
            declared = end > 0
            end = end or -1
        elif m := _NAMED.match(page, at):
            end = ends[bisect.bisect_left(places, m.end())]
            if end > 0 and (raw := _RAW.match(page, at)):
                kind = raw[1].lower()
                if kind not in closing:
                    closing[kind] = re.compile(rf"</{kind}\s*>", re.I)
                last = closing[kind].search(page, end)
                end = last.end() if last else len(page)
            elif end > 0:
                close, name, attributes = m[1], m[2], page[m.end() : end - 1]
        if end > 0:
            yield at, end, close, name, attributes
            at = page.find("<", end)
        else:
            at = page.find("<", at + 1)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; scripts, styles and markup are gone, character references decoded, white space plain."""
    out: list[Block] = []
    stack: list[Element] = []
    held: list[str] = []
    linked = link_depth = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, linked))
            held.clear()
        linked = 0

    for start, end, close, name, attributes in _tags(page):
        if start > at:
            held.append(page[at:start])
            if link_depth:
                linked += start - at
        at = end
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                held.append(" ")
            elif name == "a":
                link_depth = max(0, link_depth - 1) if close else 1
            continue
        flush()
        link_depth = 0
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
        else:
            if stack and stack[-1].name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in CLOSES_ITSELF.get(name, ()):
                    break
                if stack[k].name == name and name in CLOSES_ITSELF:
                    del stack[k:]
                    break
            if name not in VOID and not attributes.rstrip().endswith("/"):
                marks = [name]
                for _, value in _MARKS.findall(attributes):
                    marks += ["." + x for x in _NAME.findall(value.lower())]
                stack.append(Element(name, tuple(marks), stack[-1] if stack else None))
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def _bucket(x: str, n: int, known: dict[str, int]) -> int:
    if (b := known.get(x)) is None:
        if len(known) > 200_000:
            known.clear()
        b = known[x] = zlib.crc32(x.encode()) % n
    return b


def _times(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x @ weights, summed over the inner numbers one after the other, so a row's result does not depend on other rows."""
    out = x[..., :1] * weights[0]
    for k in range(1, len(weights)):
        out += x[..., k : k + 1] * weights[k]
    return out


class Labeller:
    """Embeddings of path marks and words, one LSTM each way, and the logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(0, 0.3, s)).astype(np.float32)
        self.w = {"path": draw(PATH_BUCKETS, DIM), "word": draw(WORD_BUCKETS, WORD_DIM) * np.float32(0.3), "out": draw(2 * HIDDEN + IN) * np.float32(0.3), "shift": np.zeros(1, np.float32)}
        for way in "fb":
            self.w |= {f"x{way}": draw(IN, 4 * HIDDEN), f"h{way}": draw(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1
        self.marks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _path(self, element: Element | None) -> list[int]:
        """Buckets of the distinct marks of the open elements, then of the last two marks; an element adds its own to those
        of the elements around it, once."""
        if element is None:
            return [_bucket("none", PATH_BUCKETS, self.marks)]
        todo, at = [], element
        while at and at.buckets is None:
            todo.append(at)
            at = at.above
        seen = at.buckets if at else {}
        for at in reversed(todo):
            own = {_bucket(x, PATH_BUCKETS, self.marks): None for x in at.marks}
            if own.keys() - seen.keys():
                seen = seen | own
            at.buckets = seen
        last = element.marks[-2:]
        if len(last) < 2 and element.above:
            last = (element.above.marks[-1], *last)
        return [*seen, *(_bucket("last" + x, PATH_BUCKETS, self.marks) for x in last)]

    def describe(self, page: list[Block], first: int = 0, many: int | None = None) -> tuple[list[list[int]], list[dict[int, int]], np.ndarray]:
        """Path buckets, word buckets with their counts, and shape numbers of blocks, the first of which is number `first` of `many`."""
        many = many or len(page)
        paths, words, shapes = [], [], np.zeros((len(page), SHAPES), np.float32)
        for i, b in enumerate(page):
            paths.append(self._path(b.element))
            low = b.text.lower()
            w = low.split()
            counts: dict[int, int] = {}
            for x in w:
                k = _bucket(x, WORD_BUCKETS, self.words)
                counts[k] = counts.get(k, 0) + 1
            words.append(counts)
            size, at = len(b.text), first + i
            shapes[i] = (np.log1p(size) / 8, min(1, b.linked / size), len(w) < 4, b.text[-1] in ".!?…", at / many, min(1, at / 10), "©" in low or "copyright" in low, min(1, (many - at) / 10))
        return paths, words, shapes

    def inputs(self, described: tuple[list[list[int]], list[dict[int, int]], np.ndarray]) -> np.ndarray:
        paths, words, shapes = described

        def mean(table: np.ndarray, rows: list, counts: list) -> np.ndarray:
            many = np.array([len(r) for r in rows])
            flat = np.fromiter((x for r in rows for x in r), np.int64, many.sum())
            times = np.fromiter((x for r in counts for x in r), np.float32, many.sum())
            begin = np.cumsum(many) - many
            return np.add.reduceat(table[flat] * times[:, None], begin, axis=0) / np.add.reduceat(times, begin)[:, None]

        ones = [[1] * len(r) for r in paths]
        return np.concatenate([mean(self.w["path"], paths, ones), mean(self.w["word"], words, [r.values() for r in words]), shapes], axis=1)

    def features(self, page: list[Block]) -> np.ndarray:
        """The inputs of a whole page, described slice by slice."""
        out = np.zeros((len(page), IN), np.float32)
        for at in range(0, len(page), SLICE):
            out[at : at + SLICE] = self.inputs(self.describe(page[at : at + SLICE], at, len(page)))
        return out

    def _run(self, x: np.ndarray, live: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (pages x blocks x HIDDEN); live marks real blocks.  keep gathers what the backward pass needs."""
        n, steps, _ = x.shape
        z = x @ self.w[f"x{way}"] + self.w[f"b{way}"]
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + h @ self.w[f"h{way}"]
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = live[:, t, None]
            before_c, before_h = c, h
            c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c)
            h = m * (o * tc) + (1 - m) * h
            out[:, t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, m, before_c, before_h, tc))
        return out

    def _states(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Hidden states of both directions (2 x pages x blocks x HIDDEN), the two run side by side."""
        n, steps, _ = x.shape
        weights = np.stack([self.w["hf"], self.w["hb"]])[:, :, None]
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        out, part = np.zeros((2, n, steps, HIDDEN), np.float32), np.zeros((2, n, 4 * HIDDEN), np.float32)
        stretch = max(1, STRETCH // (8 * HIDDEN * n))
        for at in range(0, steps, stretch):
            to = min(at + stretch, steps)
            z = np.stack([_times(x[:, at:to], self.w["xf"]) + self.w["bf"], (_times(x[:, steps - to : steps - at], self.w["xb"]) + self.w["bb"])[:, ::-1]])
            z = np.ascontiguousarray(z.transpose(2, 0, 1, 3))
            for t in range(at, to):
                a = z[t - at]
                for k in range(HIDDEN):
                    np.multiply(h[:, :, k : k + 1], weights[:, k], out=part)
                    a += part
                gates = 1 / (1 + np.exp(-np.clip(a[:, :, : 3 * HIDDEN], -30, 30)))
                m = np.stack([live[:, t], live[:, steps - 1 - t]])[:, :, None]
                c = m * (gates[:, :, HIDDEN : 2 * HIDDEN] * c + gates[:, :, :HIDDEN] * np.tanh(a[:, :, 3 * HIDDEN :])) + (1 - m) * c
                h = m * (gates[:, :, 2 * HIDDEN :] * np.tanh(c)) + (1 - m) * h
                out[0, :, t], out[1, :, steps - 1 - t] = h[0], h[1]
        return out

    def chance(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's inputs, the chance of each block to be article text."""
        steps = max(map(len, pages))
        x, live = np.zeros((len(pages), steps, IN), np.float32), np.zeros((len(pages), steps), np.float32)
        for k, p in enumerate(pages):
            x[k, : len(p)], live[k, : len(p)] = p, 1
        ahead, back = self._states(x, live)
        out = self.w["out"][:, None]
        z = _times(ahead, out[:HIDDEN]) + _times(back, out[HIDDEN : 2 * HIDDEN]) + _times(x, out[2 * HIDDEN :]) + self.w["shift"]
        p = 1 / (1 + np.exp(-np.clip(z[:, :, 0], -30, 30)))
        return [p[k, : len(q)] for k, q in enumerate(pages)]

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 6, batch: int = 24, rate: float = 0.02, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        described = [self.describe(b) for b, _ in pages]
        cache = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.w.items()}
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                steps = max(len(pages[k][1]) for k in own)
                x, live, y = np.zeros((len(own), steps, IN), np.float32), np.zeros((len(own), steps), np.float32), np.zeros((len(own), steps), np.float32)
                for r, k in enumerate(own):
                    n = len(pages[k][1])
                    x[r, :n], live[r, :n], y[r, :n] = self.inputs(described[k]), 1, pages[k][1]
                kept: dict[str, list] = {"f": [], "b": []}
                both = np.concatenate([self._run(x, live, "f", kept["f"]), self._run(x, live, "b", kept["b"]), x], axis=2)
                p = 1 / (1 + np.exp(-np.clip(both @ self.w["out"] + self.w["shift"], -30, 30)))
                err = (p - y) * live / live.sum()
                grad = {"out": np.einsum("nt,ntd->d", err, both), "shift": err.sum(keepdims=True).reshape(1)}
                d_both = err[:, :, None] * self.w["out"]
                d_x = d_both[:, :, 2 * HIDDEN :].copy()
                for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
                    d_z = np.zeros((len(own), steps, 4 * HIDDEN), np.float32)
                    dh, dc = np.zeros((len(own), HIDDEN), np.float32), np.zeros((len(own), HIDDEN), np.float32)
                    d_hw = np.zeros_like(self.w[f"h{way}"])
                    for t, i, f, o, g, m, c0, h0, tc in reversed(kept[way]):
                        dh = dh + d_both[:, t, part]
                        step = dh * m
                        dc_own = (dc + step * o * (1 - tc**2) / np.maximum(m, 1)) * m
                        d = np.concatenate([dc_own * g * i * (1 - i), dc_own * c0 * f * (1 - f), step * tc * o * (1 - o), dc_own * i * (1 - g**2)], axis=1)
                        d_z[:, t] = d
                        d_hw += h0.T @ d
                        dh = d @ self.w[f"h{way}"].T + dh * (1 - m)
                        dc = dc_own * f + dc * (1 - m)
                    grad |= {f"x{way}": np.einsum("nti,ntj->ij", x, d_z), f"h{way}": d_hw, f"b{way}": d_z.sum((0, 1))}
                    d_x += d_z @ self.w[f"x{way}"].T
                grad |= {"path": np.zeros_like(self.w["path"]), "word": np.zeros_like(self.w["word"])}
                for r, k in enumerate(own):
                    paths, words, _ = described[k]
                    for name, rows, part in (("path", paths, slice(0, DIM)), ("word", words, slice(DIM, DIM + WORD_DIM))):
                        times = [list(q.values()) if isinstance(q, dict) else [1] * len(q) for q in rows]
                        g = d_x[r, : len(rows), part] / np.array([sum(q) for q in times])[:, None]
                        g = np.repeat(g, [len(q) for q in rows], axis=0) * np.concatenate(times)[:, None]
                        np.add.at(grad[name], np.concatenate([np.fromiter(q, np.int64) for q in rows]), g)
                for name, g in grad.items():
                    g = np.clip(g, -1, 1).astype(np.float32)
                    cache[name] = 0.95 * cache[name] + 0.05 * g * g
                    self.w[name] -= rate * g / np.sqrt(cache[name] + 1e-6)
        return self


def made_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A composed page and, for each of its blocks, whether it is article text."""
    pick = lambda *x: x[rng.integers(len(x))]
    vocab = ["".join(pick("ba", "do", "ki", "lu", "me", "ra", "sto", "the", "vi", "än", "ño", "ès", "t", "n") for _ in range(rng.integers(1, 5))) for _ in range(60)]
    word = lambda: vocab[rng.integers(len(vocab))]
    line = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))

    def prose(a: int = 1, b: int = 6) -> str:
        odd = rng.random() < 0.1  # articles of poor prose are articles too
        return " ".join(line(2, 14).capitalize() + pick(*".!?.") for _ in range(rng.integers(a, b))) if not odd else pick(line(1, 40).upper(), " | ".join(word() for _ in range(rng.integers(3, 30))), " ".join(word() + pick("***", "$$$", "&amp;&amp;") for _ in range(rng.integers(3, 30))), word() + ".")

    parts: list[tuple[str, int | None]] = []  # markup, label of the blocks in it (None: no block)
    add = lambda markup, label=None: parts.append((markup, label))

    def mark(*names: str) -> str:
        return pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{pick("box", "wrap", "col", "x")} {pick(*names)}"')

    def deep() -> tuple[str, str]:
        """Opening and closing tags of many plain elements."""
        kinds, plain = pick(("div",), ("div",), ("div", "section"), ("div", "section", "ul><li")), pick(0.7, 1.0)
        names = [pick(*kinds) for _ in range(rng.integers(1, 40))]
        tags = [f"<{x}>" if rng.random() < plain or "><" in x else f"<{x}{mark('row', 'inner', 'body', 'block', 'col', 'level')}>" for x in names]
        return "".join(tags), "".join("</li></ul>" if "><" in x else f"</{x}>" for x in reversed(names))

    def menu(outer: str) -> None:
        add(outer + "<ul>")
        for _ in range(rng.integers(2, 9)):
            add(f'<li><a href="/{word()}">{line(1, 3)}</a></li>', 0)
        add("</ul>" + re.sub(r"<(\w+)[^>]*>", r"</\1>", outer))

    def side_text(outer: str, text: list[str], inner: str = "p") -> None:
        opened, closed = deep() if rng.random() < 0.05 else ("", "")
        add(outer + opened)
        for x in text:
            add(pick(f"<{inner}>{x}</{inner}>", f"<div>{x}</div>") if rng.random() < 0.8 or len(text) > 1 else x, 0)
        add(closed + re.sub(r"<(\w+)[^>]*>", r"</\1>", outer))

    def advert() -> None:
        side_text(f"<{(t := pick('div', 'aside', 'section', 'ins'))}{mark('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'promo')}>", [pick(prose(1, 3), line(2, 9), "Advertisement")])

    def notice() -> None:
        side_text(f"<{pick('div', 'section', 'aside')}{mark('cookie', 'cookies', 'notice', 'consent', 'alert', 'gdpr', 'banner', 'popup', 'modal', 'newsletter', 'paywall')}>", [pick("We use cookies. " + prose(1, 3), prose(1, 3), "Please " + prose(1, 2))] + (["Accept all"] if rng.random() < 0.4 else []))

    def sidebar() -> None:
        if rng.random() < 0.5:
            menu(pick("<aside>", f"<div{mark('sidebar', 'related', 'widget', 'recent', 'links', 'popular', 'tags')}>", f"<aside{mark('sidebar', 'related')}>"))
        else:
            side_text(pick("<aside>", f"<div{mark('sidebar', 'related', 'widget', 'recent', 'side', 'promo')}>", f"<section{mark('related', 'sidebar', 'more')}>"), [pick(line(1, 4), prose(1, 4)) for _ in range(rng.integers(1, 4))])

    def form() -> None:
        add(f"<form{pick('', mark('search', 'subscribe', 'login', 'newsletter', 'contact'))}>")
        for _ in range(rng.integers(1, 4)):
            add(pick(f"<p>{line(1, 9)}</p>", f"<div><label>{line(1, 4)}</label></div>", f"<button>{line(1, 3)}</button>", f"<fieldset>{line(1, 6)}</fieldset>"), 0)
        add("<input type=text></form>")

    def share() -> None:
        side_text(f"<div{mark('share', 'social', 'byline', 'meta', 'breadcrumb', 'tags', 'pagination')}>", [line(1, 6) for _ in range(rng.integers(1, 3))])

    def header() -> None:
        if rng.random() < 0.5:
            side_text(f"<{pick('header', 'div class=\"header\"', 'div id=\"masthead\"', 'header class=\"site\"')}>".replace("</div class", "</div"), [pick(line(1, 5), prose(1, 3)) for _ in range(rng.integers(1, 3))])
        if rng.random() < 0.8:
            menu(pick("<nav>", f"<nav{mark('menu', 'main', 'navbar')}>", f"<div{mark('nav', 'menu', 'navigation', 'topbar', 'breadcrumbs')}>", "<header>"))

    def comments() -> None:
        outer = pick(f"<section{mark('comments', 'discussion', 'responses', 'replies')}>", f"<div{mark('comments', 'comment-list', 'disqus', 'reader-comments')}>")
        add(outer)
        if rng.random() < 0.6:
            add(f"<h{(k := pick(2, 3))}>{pick('Comments', 'Kommentare', 'Comentarios', line(1, 3))}</h{k}>", 0)
        if rng.random() < 0.4:  # replies to replies
            inner = pick("<ul><li><div>", "<ol><li><div>", "<ul class=\"children\"><li class=\"comment\"><div>", "<div><div><div>", "<div class=\"reply\"><div><div class=\"body\">")
            levels = rng.integers(3, 14)
            for _ in range(levels):
                add(f"{inner}<p>{prose()}</p></div>", 0)
            add(("</div></div>" if inner.startswith("<div") else f"</li></{inner[1:3]}>") * levels)
        for _ in range(rng.integers(1, 5)):
            wrap = pick("div class=\"comment\"", "article class=\"comment\"", "li", "div")
            add(f"<{wrap}><p>{prose()}</p></{wrap.split()[0]}>", 0)
        add(re.sub(r"<(\w+)[^>]*>", r"</\1>", outer))

    def footer() -> None:
        side_text(pick("<footer>", "<footer>", f"<div{mark('footer', 'foot', 'copyright', 'colophon', 'legal')}>", "<footer class=\"site\">"), [pick("&copy; " + line(1, 4) + " &middot; " + prose(1, 2), "Copyright " + line(1, 6), prose(1, 3), line(1, 5)) for _ in range(rng.integers(1, 3))])

    def article() -> None:
        outer = pick("<article>", "<article>", "<article>", f"<article{mark('post', 'entry', 'story')}>", "<main><article>", "<main>", f"<div{mark('article', 'content', 'post', 'entry-content', 'story', 'main-content', 'post-body')}>", '<div itemprop="articleBody">', '<section class="article-body">')
        add(outer)
        opened, closed = deep() if rng.random() < 0.3 else ("", "")
        add(opened)
        if rng.random() < 0.85:
            add(f"<h1>{line(2, 12)}</h1>", 1)
        if rng.random() < 0.2:
            share()
        for _ in range(rng.integers(1, 3) if rng.random() < 0.3 else rng.integers(1, 14)):
            kind = rng.random()
            if kind < 0.74:
                text = prose()
                cut = text.find(" ")
                add(pick(f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text[:cut]}<em>{text[cut:]}</em></p>", f"<p>{text} <a href='/x'>{word()}</a>.</p>", f"<p>{text}"), 1)
            elif kind < 0.82:
                add(f"<h{(k := pick(2, 3, 4))}>{line(1, 8)}</h{k}>", 1)
            elif kind < 0.87:
                add("<ul>")
                for _ in range(rng.integers(2, 5)):
                    add(f"<li>{pick(line(2, 12), prose(1, 2))}</li>", 1)
                add("</ul>")
            elif kind < 0.91:
                add(f"<blockquote><p>{prose()}</p></blockquote>" if rng.random() < 0.5 else f"<blockquote>{prose()}</blockquote>", 1)
            elif kind < 0.93:
                add(f"<pre>{line(2, 20)}</pre>", 1)
            elif kind < 0.95:
                add(f"<figure><img src=x><figcaption>{line(2, 9)}</figcaption></figure>", 1)
            elif kind < 0.97:
                advert()
            elif kind < 0.985:
                form()
            else:
                pick(sidebar, notice, share)()
        add(closed)
        if rng.random() < 0.1:
            comments()
        add("</article></main>" if "><" in outer else re.sub(r"<(\w+)[^>]*>", r"</\1>", outer))

    add(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{line(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
    parts[-1] = (parts[-1][0], 0)
    wrapped = rng.random() < 0.4
    if wrapped:
        add(f"<div{mark('page', 'container', 'wrapper', 'site', 'main')}>")
    header()
    for f, chance in ((notice, 0.3), (advert, 0.5), (sidebar, 0.2), (form, 0.15), (share, 0.15)):
        if rng.random() < chance:
            f()
    article()
    for f, chance in ((share, 0.2), (comments, 0.35), (sidebar, 0.35), (advert, 0.3), (form, 0.2), (notice, 0.2)):
        if rng.random() < chance:
            f()
    if rng.random() < 0.85:
        footer()
    if wrapped:
        add("</div>")
    add("</body></html>")
    page = "".join(x for x, _ in parts)
    labels = [y for x, y in parts if y is not None]
    return page, labels


def made_pages(n: int = 700, seed: int = 17) -> list[tuple[list[Block], list[int]]]:
    """Composed pages as blocks with labels; a page whose blocks do not fall one to one on its parts is left out."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        page, labels = made_page(rng)
        b = blocks(page)
        if len(b) == len(labels):
            out.append((b, labels))
    return out


_TRAINED: dict[int, Labeller] = {}


def trained(n: int = 700) -> Labeller:
    """The labeller fitted on composed pages; once per process."""
    if n not in _TRAINED:
        _TRAINED[n] = Labeller().fit(made_pages(n))
    return _TRAINED[n]


def extract_texts(model: Labeller, pages: list[str | None], threshold: float = 0.5) -> list[str]:
    """The article text of each page: its blocks in page order, joined by one space."""
    cut = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
    at = 0
    while at < len(order):  # pages of like length run together
        to = at + 1
        while to < len(order) and to - at < TOGETHER and (to - at + 1) * len(cut[order[to]]) <= CELLS:
            to += 1
        own = order[at:to]
        for k, p in zip(own, model.chance([model.features(cut[k]) for k in own])):
            out[k] = " ".join(b.text for b, x in zip(cut[k], p) if x >= threshold)
            cut[k] = []
        at = to
    return out


def extract(df: DataFrame, model: Labeller | None = None, id_col: str = "page_id", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or trained()
    url = F.col("url") if "url" in df.columns else F.lit(None).cast("string")
    weights = model.w

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Labeller()
        own.w = weights
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                texts = extract_texts(own, part["html"].tolist(), threshold)
                yield pd.DataFrame({"page_id": part["page_id"].array, "url": part["url"].array, "text": texts, "n_chars": [len(x) for x in texts]})

    rows = small_batches(df).select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
