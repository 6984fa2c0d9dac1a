"""Web pages as trees of blocks: a forgiving HTML reader in linear time.

Nodes are block elements and, as leaves, the runs of inline content between their borders. Markup that never shows text
(``MUTE``, and the raw contents of ``RAW``) is left out; character references are decoded; white space within a run is one
space. Omitted end tags (``p``, ``li``, cells, ...), unclosed and crossed inline tags, and stray end tags are handled as
browsers do, as far as it matters for blocks.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
MUTE = frozenset("button select datalist template noscript svg math object canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: So many open inline tags around a text mark it.
NEAR = 8
#: A start tag ends the open elements listed first, unless one of those listed last stands between.
_CELLS = ("table", "td", "th", "caption", "html")
_LISTS = ("ul", "ol", "menu", "dir", "dl", "article", "section", "nav", "aside", *_CELLS)
ENDS = {
    "li": (("li",), _LISTS), "dd": (("dd", "dt"), _LISTS), "dt": (("dd", "dt"), _LISTS), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_BORDER = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.IGNORECASE) for name in RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def names(value: str) -> list[str]:
    """The lower-case words of a class or id: cut at hyphens, digits and capitals."""
    return [x.lower() for x in _PARTS.findall(value)]


class Page:
    """A page's nodes in order: parent, tag ("" for a leaf), marks (words of class, id, role, inline tags), label, text, link characters.

    ``label`` is what ``data-main="1"`` or ``"0"`` says on the nearest element, for pages to learn from (0 where none does).
    """

    def __init__(self, html: str | None):
        self.parent, self.tag, self.marks, self.label, self.text, self.links = [-1], ["html"], [()], [0], [""], [0]
        self._stack: list[list] = [["html", 0, ()]]  # name, node (-1: inline), marks
        self._where: dict[str, list[int]] = {"html": [0]}
        self._at, self._mute = [0], 0
        self._clear()
        if html:
            self._read(html)
        self._flush()

    def _clear(self) -> None:
        self._run, self._run_marks, self._run_links = [], set(), 0

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split())
        if text:
            parent = self._at[-1]
            for values, value in ((self.parent, parent), (self.tag, ""), (self.marks, tuple(sorted(self._run_marks))), (self.label, self.label[parent]), (self.text, text), (self.links, min(self._run_links, len(text)))):
                values.append(value)
        if self._run or self._run_marks:
            self._clear()

    def _say(self, text: str) -> None:
        if self._mute or not text:
            return
        text = unescape(text) if "&" in text else text
        self._run.append(text)
        if text.isspace():
            return
        if self._where.get("a"):
            self._run_links += len(text.strip())
        for name, node, marks in self._stack[: -1 - NEAR : -1]:
            if node >= 0:
                break
            if name:
                self._run_marks.add("n:" + name)
                self._run_marks.update(marks)

    def _pop_to(self, depth: int) -> None:
        """Close everything from ``depth`` of the stack on."""
        self._flush()
        while len(self._stack) > depth:
            name, node, _ = self._stack.pop()
            if name:
                self._where[name].pop()
                self._mute -= name in MUTE
            if node >= 0:
                self._at.pop()

    def _last(self, tags) -> int:
        return max((self._where[t][-1] for t in tags if self._where.get(t)), default=-1)

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._run.append(" ")
            return
        if name == "html" or name in VOID and name != "hr":
            return
        if name == "body" and self._where.get("body"):
            return
        block = name in BLOCK
        if block:
            p = self._last(("p",))
            if p > self._last(("button", *_CELLS)):
                self._pop_to(p)
            if name in ENDS:
                closed = self._last(ENDS[name][0])
                if closed > self._last(ENDS[name][1]):
                    self._pop_to(closed)
            elif name in HEADINGS and self._stack[-1][0] in HEADINGS:
                self._pop_to(len(self._stack) - 1)
            self._flush()
        if name == "hr":
            return
        marks, label = [], None
        if "=" in attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in ("class", "id"):
                    marks += ["c:" + x for x in names(value)]
                elif key in ("role", "itemprop"):
                    marks.append(f"r:{value.lower()}")
                elif key == "aria-hidden" or key == "style" and "display:none" in value.replace(" ", ""):
                    marks.append("hidden")
                elif key == "data-main":
                    label = int(value == "1")
        depth = len(self._stack)
        node = -1
        if block and not self._mute:
            parent, node = self._at[-1], len(self.parent)
            for values, value in ((self.parent, parent), (self.tag, name), (self.marks, tuple(marks)), (self.label, self.label[parent] if label is None else label), (self.text, ""), (self.links, 0)):
                values.append(value)
            self._at.append(node)
        self._mute += name in MUTE
        self._stack.append([name, node, tuple(marks)])
        self._where.setdefault(name, []).append(depth)

    def _end(self, name: str) -> None:
        at = self._where.get(name)
        if name in BLOCK and not self._mute:
            self._flush()
        if not at or name == "html":
            return
        if name in BLOCK or name in MUTE:
            if name in ("p", "li", "dd", "dt") and at[-1] < self._last(_CELLS):
                return
            self._pop_to(at[-1])
        else:  # blocks opened since stay open
            depth = at.pop()
            if depth == len(self._stack) - 1:
                self._stack.pop()
            else:
                self._stack[depth][0] = ""

    def _read(self, html: str) -> None:
        at, size, last = 0, len(html), html.rfind(">")
        last_quote = {'"': html.rfind('"'), "'": html.rfind("'")}
        quoted = True
        while True:
            m = _OPEN.search(html, at)
            if m is None:
                break
            begin, i = m.span()
            self._say(html[at:begin])
            if m.group(1):
                if html.startswith((">", "->"), i):
                    at = html.index(">", i) + 1
                    continue
                end = html.find("-->", i)
                at = size if end < 0 else end + 3
                continue
            if i > last:  # no tag can end any more: the rest is text
                self._say(html[begin:])
                at = size
                break
            name = (m.group(3) or "").lower()
            if not name or m.group(2):
                at = html.index(">", i) + 1
                if name:
                    self._end(name)
                continue
            end, j = -1, i
            while quoted:
                b = _BORDER.search(html, j)
                if b is None:
                    quoted = False  # a quote that swallows all tags to come is no quote
                elif b.group() == ">":
                    end = b.start()
                    break
                else:
                    j = b.end()
                    if j <= last_quote[b.group(1)]:
                        j = html.index(b.group(1), j) + 1
            if end < 0:
                end = html.index(">", i)
            at = end + 1
            if name in RAW:
                close = _RAW_END[name].search(html, at)
                if close is None:
                    at = size
                else:
                    after = html.find(">", close.end())
                    at = size if after < 0 else after + 1
                continue
            self._start(name, html[i:end])
        self._say(html[at:])
