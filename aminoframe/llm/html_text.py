"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of blocks of words and of tags.  Tags score negative; a block's words score by what speaks for
them being main text: the names of the elements they stand in, class and id names, and how many of them are links.  All
weights are learnt from labelled pages (``labelled_pages``): words nothing speaks against score positive.  One linear
scan finds the contiguous run with the largest sum.  Boilerplate takes part in the scan with its negative scores, and
the blocks inside the run that score negative themselves (an advert within an article) are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages

_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_QUOTED = re.compile(r"=\s*([\"'])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Elements whose content is no markup, and those whose content is no text.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_NO_TEXT = {"noscript", "template", "select", "svg", "math", "object", "canvas", "audio", "video"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_ROOM = {"table", "td", "th", "ul", "ol", "dl", "select", "div", "section", "article", "main", "aside", "nav"}
#: Elements that a start tag ends, and those that it can't reach beyond.
_IMPLIED = {t: ({"p"}, _ROOM | {"li", "dd", "button"}) for t in "p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside main nav header footer form pre blockquote".split()}
_IMPLIED |= {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
#: Elements whose name says nothing about their words.
_SILENT = {"div", "html", "body", "head", "table", "tbody", "thead", "tr", "ul", "ol", "dl"}
#: Elements of this depth have no elements of their own; deeper ones count as their parent, as in browsers.
DEPTH = 500


class _Finder:
    """Where a string stands next; each is looked for only once over the whole page."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {}

    def after(self, what: str, at: int) -> int:
        known = self.last.get(what, -2)
        if known == -1 or known >= at:
            return known
        self.last[what] = self.page.find(what, at)
        return self.last[what]

    def end_tag(self, name: str, at: int) -> int:
        known = self.last.get(("/", name), -2)
        if known == -1 or known >= at:
            return known
        found = re.compile(f"</{name}(?=[\\s/>])", re.I).search(self.page, at)
        self.last["/", name] = found.start() if found else -1
        return self.last["/", name]


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) in order: "text" (with its references), "start" or "end" of an element by name.

    Comments, declarations and the content of scripts, styles and the like are left out.  Time is linear in the page.
    """
    find, at, n = _Finder(page), 0, len(page)
    while at < n:
        less = find.after("<", at)
        if less < 0:
            yield "text", page[at:], ""
            return
        if less > at:
            yield "text", page[at:less], ""
        following = page[less + 1 : less + 2]
        if following in ("!", "?"):
            comment = page.startswith("<!--", less)
            close = find.after("-->" if comment else ">", less + 2)
            at = n if close < 0 else close + (3 if comment else 1)
            continue
        name = _NAME.match(page, less + 1 + (following == "/"))
        end = find.after(">", less) if name else -1
        if end < 0:
            if name:  # an element that the end of the page cuts off
                return
            yield "text", "<", ""
            at = less + 1
            continue
        seek = name.end()
        while (quote := _QUOTED.search(page, seek, end)) is not None:
            close = find.after(quote[1], quote.end())
            if close < 0:
                break
            seek = close + 1
            end = find.after(">", seek)
            if end < 0:
                return
        tag, at = name[0].lower(), end + 1
        if following == "/":
            yield "end", tag, ""
            continue
        attributes = page[name.end() : end]
        if tag in _RAW:
            close = find.end_tag(tag, at)
            if close < 0 and tag in ("script", "style"):
                return
            if close >= 0:
                at = find.after(">", close) + 1 or n
            continue
        yield "start", tag, attributes


def evidence(tag: str, attributes: str, inside: Counter) -> dict[str, float]:
    """What an element says about the words in it: its name, and its class, id and role names whole and in parts.

    The parts of a name share its weight: a name that holds a boilerplate word among others says half as much.
    """
    found: dict[str, float] = {}
    if tag in ("article", "main", "header", "footer"):
        apart = inside["aside"] or inside["nav"] or inside["form"]
        found[f"{tag} apart" if apart else f"inner {tag}" if tag[-2:] == "er" and (inside["article"] or inside["main"]) else tag] = 1.0
    elif tag not in _SILENT and tag not in _INLINE:
        found[tag] = 1.0
    if "=" in attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id", "role"):
                for name in (m[2] or m[3] or m[4] or "").lower().split()[:20]:
                    found["=" + name] = 1.0
                    parts = [x for x in re.split(r"[-_:]+", name) if x]
                    for x in parts:
                        found["~" + x] = max(found.get("~" + x, 0.0), 1 / len(parts))
    return found


@dataclass
class Block:
    """Words between two tags that part blocks; ``said`` is the evidence of all open elements."""

    text: str
    words: int
    linked: int
    said: dict[str, float]
    path: tuple[int, ...]


@dataclass
class _Open:
    tag: str
    said: dict[str, float]
    number: int
    path: tuple[int, ...] = field(default=())


def blocks(page: str) -> Iterator[Block | str]:
    """Blocks and the names of the tags between them, in page order."""
    stack = [_Open("", {}, 0, (0,))]
    inside: Counter = Counter()
    held: list[tuple[str, bool, dict]] = []
    number = 0

    def close() -> Block | None:
        text = " ".join(entities.unescape("".join(t for t, _, _ in held)).split())
        if not text:
            held.clear()
            return None
        sizes = [len(t.split()) for t, _, _ in held]
        said = held[max(range(len(held)), key=lambda i: sizes[i])][2]
        block = Block(text, len(text.split()), sum(s for s, (_, link, _) in zip(sizes, held, strict=True) if link), said, stack[-1].path)
        held.clear()
        return block

    def pop(to: int) -> None:
        for x in stack[to:]:
            inside[x.tag] -= 1
        del stack[to:]

    for kind, tag, attributes in markup(page):
        if kind == "text":
            if not inside["no text"]:
                held.append((tag, inside["a"] > 0, stack[-1].said))
            continue
        parts = tag not in _INLINE
        if parts:
            block = close()
            if block:
                yield block
        elif tag == "br" and kind == "start":
            held.append((" ", False, stack[-1].said))
        if kind == "end":
            if inside[tag] > 0:
                at = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if any(x.tag not in _INLINE for x in stack[at + 1 :]) and not parts:
                    at = len(stack)  # an inline element doesn't end the blocks inside it
                inside["no text"] -= sum(x.tag in _NO_TEXT for x in stack[at:])
                pop(at)
        else:
            if tag in _IMPLIED:
                ends, bounds = _IMPLIED[tag]
                if any(inside[x] > 0 for x in ends):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in ends:
                            inside["no text"] -= sum(x.tag in _NO_TEXT for x in stack[i:])
                            pop(i)
                            break
                        if stack[i].tag in bounds:
                            break
            if tag not in _VOID and not (attributes.endswith("/") and tag in _NO_TEXT) and len(stack) < DEPTH:
                number += 1
                said = evidence(tag, attributes, inside)
                top = stack[-1]
                stack.append(_Open(tag, top.said | {k: max(v, top.said.get(k, 0.0)) for k, v in said.items()} if said else top.said, number, (*top.path, number) if tag in ("article", "main") else top.path))
                inside[tag] += 1
                inside["no text"] += tag in _NO_TEXT
        if parts:
            yield tag
    block = close()
    if block:
        yield block


class Weights:
    """Log-odds of being main text, learnt from labelled pages by logistic regression; and what tags cost."""

    #: A piece of evidence needs so many blocks to be learnt; what speaks for a block counts up to MOST in all, so that
    #: no number of promising wrappers outweighs an advert's name.
    LEAST, MOST = 8, 2.0
    #: The odds of words of which nothing is known; not learnt, so text that nothing speaks against is always positive.
    PLAIN = 0.5

    def __init__(self, pages: list[tuple[str, list[str]]], steps: int = 400) -> None:
        found: dict[tuple[frozenset, float], list[int]] = {}  # blocks of the same evidence: how many, how many main
        tags = {True: Counter(), False: Counter()}
        for page, wanted in pages:
            left, last = Counter(wanted), False
            for x in blocks(page):
                if isinstance(x, str):
                    tags[last][x] += 1
                else:
                    last = left[x.text] > 0
                    left[x.text] -= last
                    n = found.setdefault((frozenset(x.said.items()), round(x.linked / x.words, 1)), [0, 0])
                    n[0] += 1
                    n[1] += last
        seen: Counter = Counter()
        for (said, _), (n, _) in found.items():
            seen.update(dict.fromkeys((k for k, _ in said), n))
        names = {k: i + 2 for i, k in enumerate(sorted(k for k, n in seen.items() if n >= self.LEAST))}
        x = np.zeros((len(found), len(names) + 2), dtype=np.float32)
        x[:, 0] = 1
        for i, (said, linked) in enumerate(found):
            x[i, 1] = linked
            for k, v in said:
                if k in names:
                    x[i, names[k]] = v
        n, y = (np.array(c, dtype=np.float32) / sum(n for n, _ in found.values()) for c in zip(*found.values(), strict=True))
        w = np.zeros(x.shape[1], dtype=np.float32)
        w[0] = self.PLAIN
        m = v = np.zeros_like(w)
        for t in range(1, steps + 1):
            speaks_for, against = np.maximum(w, 0), np.minimum(w, 0)
            speaks_for[:2], against[:2] = 0, w[:2]
            good = x @ speaks_for
            off = n / (1 + np.exp(-(np.minimum(good, self.MOST) + x @ against))) - y
            g = np.where(w > 0, x.T @ (off * (good < self.MOST)), x.T @ off)
            g[0], g[1] = 0, x[:, 1] @ off
            g += 1e-4 * np.r_[0, w[1:]]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.bias, self.link = float(w[0]), float(w[1])
        self.said = {k: float(w[i]) for k, i in names.items()}
        total = {side: sum(c.values()) + 1 for side, c in tags.items()}
        odds = {t: math.log((tags[True][t] + 1) / total[True]) - math.log((tags[False][t] + 1) / total[False]) for t in {*tags[True], *tags[False]}}
        #: Tags count against a region, those that mostly stand outside main texts more so.
        self.tags = {t: -0.1 * min(3.0, max(0.5, 1.0 - o)) for t, o in odds.items()}

    def odds(self, block: Block) -> float:
        said = [self.said.get(k, 0.0) * v for k, v in block.said.items()]
        good = min(self.MOST, sum(x for x in said if x > 0))
        return self.bias + self.link * block.linked / block.words + good + sum(x for x in said if x < 0)

    def score(self, block: Block) -> float:
        """Of the whole block: at most 1 a word for main text, at most 0.5 against it."""
        return block.words * max(-0.5, min(1.0, self.odds(block) / 2))

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.1)


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of the largest sum, the first of them, as (begin, end); empty if none is above 0."""
    best, found, run, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        run += score
        if run <= 0:
            run, begin = 0.0, i + 1
        elif run > best:
            best, found = run, (begin, i + 1)
    return found


_LEARNT: list[Weights] = []


def weights() -> Weights:
    if not _LEARNT:
        _LEARNT.append(Weights(labelled_pages()))
    return _LEARNT[0]


def main_text(page: str, w: Weights | None = None) -> str:
    """Blocks of the best run, one to a line; "" if no run scores above 0.

    If the run lies in an article or main element, it is widened to all of it: the element's end is the text's, even
    where an advert before the last paragraph costs more than that paragraph has.
    """
    w = w or weights()
    found = list(blocks(page))
    scores = [w.tag(x) if isinstance(x, str) else w.score(x) for x in found]
    lo, hi = best_run(scores)
    inner = [x.path for x in found[lo:hi] if not isinstance(x, str) and w.odds(x) >= 0]
    if not inner:
        return ""
    depth = min(map(len, inner))
    while len({p[:depth] for p in inner}) > 1:
        depth -= 1
    if depth > 1:
        within = inner[0][:depth]
        chosen = [x for x in found if not isinstance(x, str) and x.path[:depth] == within]
    else:
        chosen = [x for x in found[lo:hi] if not isinstance(x, str)]
    return "\n".join(x.text for x in chosen if w.odds(x) >= 0)


def _extract(w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                text = [main_text(p or "", w) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null html counts as empty and has the empty text, as have pages in which nothing scores above 0.  Character
    references are decoded, white space inside a block is one space, blocks stand in page order with one newline
    between.  An article inside comments or an aside is no main text.  Unclosed elements, tags that the page's end cuts
    off and stray signs are allowed; time is linear in a page's length, and elements nested deeper than ``DEPTH`` count
    as their parent.  Rows that repeat an id are pages of their own; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(weights()), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
