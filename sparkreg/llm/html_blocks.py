"""Leaf blocks of an HTML page: their text, tag path and link share."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Elements that do not start a block of their own (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template iframe svg math object canvas select option optgroup datalist "
                    "textarea button title head audio video map".split())
#: What a head may hold; any other start tag, or text, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements whose start tag ends a dropped element that has no end tag.
FLOW = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                 "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search "
                 "section summary table tbody td tfoot th thead tr ul".split())
#: Parses in which elements without end tags are told apart.
PASSES = 8
#: Elements whose content is not markup: it ends at their end tag.
RAW = frozenset("script style textarea title iframe".split())
#: Elements that do not break a block either, though their content is dropped.
NO_BREAK = RAW | {"noscript", "template"}
#: Elements of a path that a block keeps: the outermost and the innermost.
OUTER, INNER = 16, 48

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+[^>]*)(?:>|\Z)""",
    re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    link_chars: int


def _node(tag: str, attrs: str) -> tuple[str, ...]:
    """The tag and the pieces of its class, id and role names."""
    out = [tag]
    for m in NAMES.finditer(attrs) if attrs else ():
        out += [f".{p.lower()}" for p in PIECES.findall(m[1] or m[2] or m[3] or "")]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order.  Text is decoded, white space inside a
    block becomes one space; markup, comments, scripts, styles and the
    content of controls are left out.  Tags that are cut off or never closed
    end with the page; a head ends at the first thing it may not hold, and a
    dropped element that has no end tag of its own at the next start tag of a
    flow element.  Of a path deeper than ``OUTER`` + ``INNER`` elements the
    middle is left out (never of the text)."""
    lost: set[int] = set()
    for _ in range(PASSES):
        out, more = _parse(page, lost)
        if more <= lost:
            return out
        lost |= more
    return _parse(page, None)[0]


class _Parse:
    """One parse.  The dropped elements at the places ``lost``, or all if
    None, end at the next start tag of a flow element."""

    def __init__(self, page: str, lost: set[int] | None):
        self.page, self.lost = page, lost
        self.out: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...], int]] = []
        self.open = Counter()                        # open elements by name
        self.marks: list[int] = []                   # where in the stack the dropped ones are
        self.blocks: list[int] = []                  # and the elements that start a block
        self.filled: set[int] = set()
        self.unclosed: set[int] = set()              # dropped, hold a flow element, have no end tag of their own
        self.parts: list[str] = []
        self.links = 0
        self.no_end: set[str] = set()                # raw elements that no end tag follows any more
        self._run()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                way = self.stack if len(self.stack) <= OUTER + INNER else self.stack[:OUTER] + self.stack[-INNER:]
                self.out.append(Block(text, tuple(p for _, n, _ in way for p in n), min(self.links, len(text))))
            self.parts, self.links = [], 0

    def _pop_to(self, k: int, own: bool = False) -> None:
        for i, (t, _, place) in enumerate(self.stack[k:]):
            self.open[t] -= 1
            if place in self.filled and (i or not own):
                self.unclosed.add(place)
        del self.stack[k:]
        for places in (self.marks, self.blocks):
            while places and places[-1] >= k:
                places.pop()

    def _leave(self, tag: str | None) -> None:
        """Closes what a start tag, or text, ends of the dropped elements."""
        for k in reversed(self.marks):
            t, _, place = self.stack[k]
            if t == "head":
                if tag not in HEAD:
                    self._pop_to(k)
            elif tag not in FLOW:
                break
            else:
                self.filled.add(place)
                if self.lost is not None and place not in self.lost:
                    break
                self._pop_to(k)

    def _text(self, piece: str) -> None:
        if self.marks and self.stack[-1][0] == "head" and piece.strip(" \t\n\f\r"):
            self._leave(None)
        if not self.marks:
            self.parts.append(piece)
            self.links += len(piece) * (self.open["a"] > 0)

    def _end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag not in INLINE or not self.blocks or self.blocks[-1] < k:      # an inline end tag closes no block
                    self._pop_to(k, own=True)
                return

    def _start(self, tag: str, attrs: str, place: int) -> None:
        if tag not in INLINE:                        # a block ends an open paragraph, an item an open item
            if self.blocks and (self.stack[self.blocks[-1]][0] == "p" or self.stack[self.blocks[-1]][0] == tag == "li"):
                self._pop_to(self.blocks[-1])
            self.blocks.append(len(self.stack))
        if tag in DROPPED:
            self.marks.append(len(self.stack))
        self.stack.append((tag, _node(tag, attrs), place))
        self.open[tag] += 1

    def _run(self) -> None:
        page, at = self.page, 0
        while m := TOKEN.search(page, at):
            if m.start() > at:
                self._text(page[at:m.start()])
            at = m.end()
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            if self.marks and not m["end"]:
                self._leave(tag)
            if not self.marks and tag not in INLINE and tag not in NO_BREAK:
                self._flush()
            if m["end"]:
                self._end(tag)
                continue
            if tag in VOID or m["attrs"].endswith("/") and tag not in RAW:
                continue
            if tag in RAW and tag not in self.no_end:
                if end := RAW_END[tag].search(page, at):
                    at = end.end()
                    continue
                self.no_end.add(tag)                 # without an end tag it is an element like the other dropped ones
            self._start(tag, m["attrs"], m.start())
        if at < len(page):
            self._text(page[at:])
        self._flush()
        self._pop_to(0)


def _parse(page: str, lost: set[int] | None) -> tuple[list[Block], set[int]]:
    done = _Parse(page, lost)
    return done.out, done.unclosed
