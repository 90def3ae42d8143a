"""Per-page helper: a flat element table of one HTML text and a small selector matcher over it."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_HIDDEN = {"script", "style", "noscript", "template", "head", "title"}
# A start tag of the key closes an open tag of the first set unless a tag of the second set lies between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
_P = {"p"}
_P_SCOPE = {"button", "table", "td", "th", "caption", "object"}
_BREAK = None  # a line break among the text pieces
# Elements whose content is text up to their own end tag, whatever it looks like.
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style", "title", "textarea")}

# Possessive parts: a tag is matched in one pass, also when a quote is never closed.
_NAME = r"""[^\s"'>/=][^\s>/=]*+"""
_ATTRIBUTES = re.compile(rf"""({_NAME})(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?""")
_SKIPPED = rf"""{_NAME}(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?"""
_MARKUP = re.compile(
    rf"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_SKIPPED}|["'=])*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*+>""", re.S
)
_FOLD, _LINES, _SPACES = re.compile(r"[ \t\r\n\f]+"), re.compile(r" *\n[ \n]*"), re.compile(r" {2,}")
# What a process or a page keeps stays small: so many texts of tags, and no longer ones.
_KEPT, _KEPT_CHARS = 2048, 256
_TAGS: dict[str, tuple] = {}
_WRITTEN: dict[str, dict[str, str]] = {}


def _keep(kept: dict, text: str, value):
    if len(text) <= _KEPT_CHARS:
        if len(kept) >= _KEPT:
            kept.clear()
        kept[text] = value
    return value


def _tag(name: str) -> tuple:
    """What a tag does: name, sets of tags it closes with their scopes, then whether it is void, hidden, a block, a break, raw."""
    tag = name.lower()
    closes = ([_CLOSES[tag]] if tag in _CLOSES else []) + ([(_P, _P_SCOPE)] if tag in _CLOSES_P else [])
    return _keep(_TAGS, name, (tag, closes, tag in _VOID, tag in _HIDDEN, tag in _BLOCK, tag in _BLOCK or tag == "br", tag in _RAW_END))


def _attributes(text: str) -> dict[str, str]:
    values = _WRITTEN.get(text)
    if values is not None:
        return values
    values = {}
    for name, double, single, bare in _ATTRIBUTES.findall(text):
        value = double or single or bare
        values.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return _keep(_WRITTEN, text, values)


class Document:
    """Elements in document order; the descendants of element i are the elements i+1 .. end[i]-1.

    Attributes are parsed, and elements listed by tag or class, when a selector asks for them.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.end = ["#root"], [-1], [0]
        self.first_piece, self.last_piece = [0], [0]
        self.pieces: list[str | None] = []
        self._hidden: list[int] = []  # pieces that are not shown
        self._written = [""]  # attributes as they are written
        self._listed: dict[str, dict[str, list[int]]] = {}
        self._children: dict[int, list[int]] = {}
        self._kept: dict[tuple, set[int]] = {}  # elements of the page by compound
        self._found: dict[str, list[int]] = {}  # elements of the page by selector, for searches in blocks
        self._tops: dict[str, dict[int, int]] = {}  # for chains: the first element that a match needs
        self._flat: dict[int, str] = {}
        self._read(html)

    def _read(self, html: str):
        tags, parents, ends, firsts, lasts, written = self.tag, self.parent, self.end, self.first_piece, self.last_piece, self._written
        pieces, hidden = self.pieces, self._hidden
        opened, roles = [0], [("#root", (), False, False, False, False, False)]  # the open elements, and what their tags do
        count: dict[str, int] = {}  # open elements by tag
        veiled = 0  # open elements that hide their content

        def close(depth: int):
            nonlocal veiled
            while len(opened) > depth:
                index, (tag, _, _, hides, block, _, _) = opened.pop(), roles.pop()
                count[tag] = count.get(tag, 0) - 1
                ends[index] = len(tags)
                lasts[index] = len(pieces)
                if hides:
                    veiled -= 1
                if block:
                    pieces.append(_BREAK)

        def close_open(inner, scope):
            for tag in inner:
                if count.get(tag):
                    break
            else:
                return
            for depth in range(len(opened) - 1, 0, -1):
                name = roles[depth][0]
                if name in inner:
                    return close(depth)
                if name in scope:
                    return

        def add_text(text: str):
            if veiled:
                hidden.append(len(pieces))
            pieces.append(text)

        at, reading = 0, True
        while reading:
            reading = False
            for found in _MARKUP.finditer(html, at):
                start, stop = found.span()
                if start > at:
                    text = html[at:start]
                    add_text(unescape(text) if "&" in text else text)
                at = stop
                closing, name, attributes = found.groups()
                if name is None:
                    continue
                role = _TAGS.get(name) or _tag(name)
                tag, closes, void, hides, _, breaks, raw = role
                if closing:
                    if roles[-1][0] == tag:
                        close(len(opened) - 1)
                    elif count.get(tag):  # otherwise nothing to close: no walk through the open elements
                        for depth in range(len(opened) - 1, 0, -1):
                            if roles[depth][0] == tag:
                                close(depth)
                                break
                    continue
                for inner, scope in closes:
                    close_open(inner, scope)
                if breaks:
                    pieces.append(_BREAK)
                index, place = len(tags), len(pieces)
                tags.append(tag)
                written.append(attributes)
                parents.append(opened[-1])
                ends.append(index + 1)
                firsts.append(place)
                lasts.append(place)
                if not void:
                    opened.append(index)
                    roles.append(role)
                    count[tag] = count.get(tag, 0) + 1
                    if hides:
                        veiled += 1
                if raw:
                    end = _RAW_END[tag].search(html, at)
                    end = end.start() if end else len(html)
                    if end > at:
                        text = html[at:end]
                        add_text(unescape(text) if tag in ("title", "textarea") and "&" in text else text)
                    at, reading = end, True
                    break
        if at < len(html):
            text = html[at:]
            add_text(unescape(text) if "&" in text else text)
        close(0)

    def attributes(self, index: int) -> dict[str, str]:
        return _attributes(self._written[index])

    def _by_tag(self) -> dict[str, list[int]]:
        if "tag" not in self._listed:
            listed = self._listed["tag"] = defaultdict(list)
            for index, tag in enumerate(self.tag):
                listed[tag].append(index)
        return self._listed["tag"]

    def _by_class(self) -> dict[str, list[int]]:
        if "class" not in self._listed:
            listed = self._listed["class"] = defaultdict(list)
            for index, text in enumerate(self._written):
                if text and ("class" in text or "class" in text.lower()):
                    for name in set(_attributes(text).get("class", "").split()):
                        listed[name].append(index)
        return self._listed["class"]

    def _siblings(self, index: int) -> list[int]:
        """Children of the parent of `index`; the lists are built for the few selectors that ask for them."""
        if not self._children:
            for child, parent in enumerate(self.parent):
                self._children.setdefault(parent, []).append(child)
        return self._children[self.parent[index]]

    def text_content(self, index: int) -> str:
        return "".join([text for text in self.pieces[self.first_piece[index]:self.last_piece[index]] if text])

    def inner_text(self, index: int) -> str:
        """Text as a reader sees it: no scripts, white space folded, one line per block."""
        first, last = self.first_piece[index], self.last_piece[index]
        pieces = self.pieces[first:last]
        if self._hidden and self.tag[index] not in _HIDDEN:
            hidden = self._hidden[bisect_left(self._hidden, first):bisect_left(self._hidden, last)]
            for place in reversed(hidden):
                del pieces[place - first]
        if not pieces:
            return ""
        shown = ["\n" if text is _BREAK else _FOLD.sub(" ", text) for text in pieces]
        if len(shown) == 1:
            return shown[0].strip(" \n")
        return _SPACES.sub(" ", _LINES.sub("\n", "".join(shown))).strip(" \n")

    def ancestor(self, index: int, tag: str) -> int | None:
        index = self.parent[index]
        while index > 0:
            if self.tag[index] == tag:
                return index
            index = self.parent[index]
        return None

    def select(self, scope: int, selector: str) -> list[int]:
        """Descendants of `scope` that match, in document order. Nothing outside `scope`, nor `scope` itself, counts as ancestor."""
        found = self._found.get(selector)
        if found is None:
            found = self._search(selector)
        if not scope or not found:
            return found
        return self.part(scope, found, self._tops.get(selector), True)

    def searches(self, selectors: tuple[str, ...]) -> list[tuple]:
        """For `part`, the searches of the page for selectors that are found in it."""
        return [(found, self._tops.get(selector)) for selector in selectors if (found := self.select(0, selector))]

    def part(self, scope: int, found: list[int], tops: dict[int, int] | None, every: bool) -> list[int]:
        """What of a search of the page lies in `scope`, or the first of it. Blocks share one search of the page per selector."""
        low = bisect_left(found, scope + 1)
        if low == len(found) or found[low] >= self.end[scope]:
            return []
        if tops is None and not every:
            return [found[low]]
        part = found[low:bisect_left(found, self.end[scope], low)]
        if tops is not None:
            part = [index for index in part if tops[index] > scope]
        return part if every else part[:1]

    def first(self, scope: int, selector: str) -> int | None:
        found = self.select(scope, selector)
        return found[0] if found else None

    def _search(self, selector: str) -> list[int]:
        chains = parse_selector(selector)
        if len(chains) == 1 and len(chains[0]) == 1:
            found = self._holding(chains[0][0][1])
        else:
            tops = self._tops[selector] = {}
            for chain in chains:
                for index, top in self._chain_tops(chain):
                    if top > tops.get(index, 0):
                        tops[index] = top
            found = sorted(tops)
        self._found[selector] = found
        return found

    def _chain_tops(self, chain) -> list[tuple[int, int]]:
        """Elements that match a chain, each with the first element of the match that reaches least far back.

        All elements of a match lie in a block exactly if the first of them comes after the block's own element.
        """
        ends = self._holding(chain[-1][1])
        held = []
        for _, compound in chain[:-1]:
            if not ends:
                return []
            if compound not in self._kept:
                self._kept[compound] = set(self._holding(compound))
            held.append(self._kept[compound])
            if not held[-1]:
                return []
        if any(combinator != " " for combinator, _ in chain[1:]):
            known: dict[tuple[int, int], int] = {}
            pairs = [(index, self._top(index, chain, len(held), held, known)) for index in ends]
        elif not held:
            pairs = [(index, index) for index in ends]
        else:
            pairs = [(index, self._top_above(index, held)) for index in ends]
        return [pair for pair in pairs if pair[1]]

    def _top_above(self, index: int, held: list[set[int]]) -> int:
        """For descendants only: the nearest fitting ancestors are the match that reaches least far back."""
        place = len(held) - 1
        above = self.parent[index]
        while above > 0:
            if above in held[place]:
                if not place:
                    return above
                place -= 1
            above = self.parent[above]
        return 0

    def _top(self, index: int, chain, place: int, held: list[set[int]], known: dict[tuple[int, int], int]) -> int:
        """The same with any combinators, for the first `place + 1` compounds; 0 without a match."""
        if place < len(held) and index not in held[place]:
            return 0
        if not place:
            return index
        top = known.get((index, place))
        if top is not None:
            return top
        top, combinator = 0, chain[place][0]
        if combinator == "+":
            siblings = self._siblings(index)
            at = bisect_left(siblings, index)
            top = self._top(siblings[at - 1], chain, place - 1, held, known) if at else 0
        else:
            above = self.parent[index]
            while above > top:
                top = max(top, self._top(above, chain, place - 1, held, known))
                if combinator == ">":
                    break
                above = self.parent[above]
        known[index, place] = top
        return top

    def _holding(self, compound) -> list[int]:
        """All elements of the page that pass the tests of one compound."""
        pool = None
        for test in compound:
            if test[0] in ("class", "tag"):
                pool = (self._by_class() if test[0] == "class" else self._by_tag()).get(test[1], [])
                break
        if pool is None:
            pool, test = range(1, len(self.tag)), None
        for other in compound:
            if other is not test:
                pool = self._passing(pool, other)
        return pool if isinstance(pool, list) else list(pool)

    def _passing(self, pool, test) -> list[int]:
        if not pool:
            return []
        kind, value, *more = test
        if kind == "tag":
            return [index for index in pool if self.tag[index] == value]
        if kind == "class":
            return [index for index in pool if value in self.attributes(index).get("class", "").split()]
        if kind == "attr":
            operator, wanted = more
            pairs = [(index, self.attributes(index).get(value)) for index in pool if self._written[index]]
            if operator is None:
                return [index for index, found in pairs if found is not None]
            if operator == "=":
                return [index for index, found in pairs if found == wanted]
            return [index for index, found in pairs if found is not None and wanted != "" and wanted in found]
        if kind == "nth":
            return [index for index in pool if bisect_left(self._siblings(index), index) + 1 == value]
        if kind == "has":
            return [index for index in pool if self.select(index, value)]
        if kind == "not":
            without = set(self.select(0, value))
            return [index for index in pool if index not in without]
        # has-text; lower case depends on the neighbours of a sigma only, so else a word is in the page if it is in an element
        if "σ" not in value and "ς" not in value and value not in self._folded(0):
            return []
        return [index for index in pool if value in self._folded(index)]

    def _folded(self, index: int) -> str:
        text = self._flat.get(index)
        if text is None:
            text = " ".join(self.text_content(index).split()).lower()
            if len(text) <= _KEPT_CHARS or not index:
                self._flat[index] = text
        return text


_TOKEN = re.compile(
    r"""(?P<space>\s*(?P<comb>[+>])\s*|\s+)|(?P<tag>[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"?(?P<value>[^\]"]*)"?)?\]|:(?P<fn>[\w-]+)\("""
)


_PARSED: dict[str, tuple] = {}


def parse_selector(selector: str) -> tuple:
    """Alternatives of a selector, each a tuple of `(combinator, tests)` from left to right."""
    if selector not in _PARSED:
        _PARSED[selector] = _parse(selector)
    return _PARSED[selector]


def _parse(selector: str) -> tuple:
    chains, chain, tests, combinator, at = [], [], [], " ", 0
    text = selector.strip()
    while at < len(text):
        if text[at] == ",":
            chains.append((*chain, (combinator, tuple(tests))))
            chain, tests, combinator = [], [], " "
            at += 1 + len(text[at + 1:]) - len(text[at + 1:].lstrip())
            continue
        found = _TOKEN.match(text, at)
        if found is None:
            raise ValueError(f"selector not understood: {selector!r} at {at}")
        at = found.end()
        if found["space"] is not None:
            if at < len(text) and text[at] != ",":
                chain.append((combinator, tuple(tests)))
                tests, combinator = [], found["comb"] or " "
        elif found["tag"]:
            tests.append(("tag", found["tag"].lower()))
        elif found["cls"]:
            tests.append(("class", found["cls"]))
        elif found["attr"]:
            tests.append(("attr", found["attr"].lower(), found["op"], found["value"]))
        else:
            close, depth = at, 1
            while depth:
                depth += {"(": 1, ")": -1}.get(text[close], 0)
                close += 1
            argument, at = text[at:close - 1].strip(), close
            if found["fn"] == "nth-child":
                tests.append(("nth", int(argument)))
            elif found["fn"] in ("has", "not"):
                parse_selector(argument)
                tests.append((found["fn"], argument))
            elif found["fn"] == "has-text":
                tests.append(("has-text", " ".join(argument.strip("\"'").split()).lower()))
            else:
                raise ValueError(f"selector not understood: {selector!r}")
    chains.append((*chain, (combinator, tuple(tests))))
    return tuple(chains)
