"""Elements of a page: a tokenizer with HTML's attribute states and a tree whose nodes know parent and siblings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: An element that opens ends open ones of these tags, unless one of the fences lies between.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)),
}
#: Elements that end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split()
)
#: Elements without text of their own for a reader.
UNREAD = frozenset("script style template".split())
#: Open elements that nest; deeper ones become siblings.
MAX_DEPTH = 512

_BLANK = " \t\n\f\r"
_MARK = re.compile(r"<!--|</?[A-Za-z]|<[!?]|</.")
_NAME = re.compile(rf"[^{_BLANK}/>]*")
_ATTRIBUTE = re.compile(rf"[{_BLANK}/]*([^{_BLANK}/>][^{_BLANK}/>=]*)?")
_EQUALS = re.compile(rf"[{_BLANK}]*=[{_BLANK}]*")
_UNQUOTED = re.compile(rf"[^{_BLANK}>]*")
_COMMENT_END = re.compile(r"--!?>")


def attributes(source: str, at: int) -> tuple[dict[str, str], int] | None:
    """The attributes from `at` on and the place behind the tag's end; None where the page ends inside the tag.

    A quote opens a value only right after the equals sign; elsewhere it is a character like any other.
    """
    found: dict[str, str] = {}
    while True:
        part = _ATTRIBUTE.match(source, at)
        at, name = part.end(), part[1]
        if not name:
            return (found, at + 1) if at < len(source) else None
        value, equals = "", _EQUALS.match(source, at)
        if equals:
            at = equals.end()
            quote = source[at : at + 1]
            if quote in ("'", '"'):
                close = source.find(quote, at + 1)
                if close < 0:
                    return None
                value, at = source[at + 1 : close], close + 1
            else:
                plain = _UNQUOTED.match(source, at)
                value, at = plain[0], plain.end()
        found.setdefault(name.lower(), unescape(value))


def tokens(source: str) -> Iterator[tuple[str, str | None, dict[str, str]]]:
    """(text, None, {}), (tag, "", attributes) and (tag, "/", {}) in order, in time linear in the page.

    Text is decoded. A tag or comment that the page ends in goes, with what follows it, as in browsers. Text of
    raw elements comes as it is written, between their tags; after <plaintext> all is text.
    """
    at, size = 0, len(source)
    while at < size:
        found = _MARK.search(source, at)
        if not found or found.start() > at:
            yield unescape(source[at : found.start() if found else size]), None, {}
        if not found:
            return
        mark = found[0]
        if mark == "<!--":
            begin = found.end()
            short = next((n for n in (">", "->") if source.startswith(n, begin)), None)
            if short:
                at = begin + len(short)
                continue
            close = _COMMENT_END.search(source, begin)
            if not close:
                return
            at = close.end()
        elif not mark[-1].isalpha() or not mark[-1].isascii():  # <! and <? and </ before anything else: a comment to the next >
            close = source.find(">", found.start() + 2)
            if close < 0:
                return
            at = close + 1
        else:
            closing = mark[1] == "/"
            name = _NAME.match(source, found.end() - 1)
            tag, bare = name[0].lower(), source.startswith(">", name.end())
            rest = ({}, name.end() + 1) if bare else attributes(source, name.end())
            if rest is None:
                return
            attrs, at = rest
            if closing:
                yield tag, "/", {}
                continue
            yield tag, "", attrs
            if tag == "plaintext":
                yield source[at:], None, {}
                return
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[{_BLANK}/>])", re.I).search(source, at)
                text = source[at : end.start() if end else size]
                if text:
                    yield unescape(text) if tag in ("textarea", "title") else text, None, {}
                at = end.start() if end else size


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def below(self) -> Iterator[Element | str]:
        """Everything inside, in document order; without recursion."""
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            yield node
            if isinstance(node, Element):
                todo += reversed(node.children)

    def all(self, tag: str, test: Callable[[Element], bool] = lambda e: True) -> Iterator[Element]:
        return (e for e in self.below() if isinstance(e, Element) and e.tag == tag and test(e))

    def first(self, tag: str, test: Callable[[Element], bool] = lambda e: True) -> Element | None:
        return next(self.all(tag, test), None)

    def inside(self, tag: str, within: Element | None = None) -> bool:
        """Whether an element `tag` lies around this one, below `within` if that is given."""
        node = self.parent
        while node is not None and node is not within:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def next_sibling(self) -> Element | None:
        """The element after this one with the same parent."""
        siblings = [c for c in self.parent.children if isinstance(c, Element)] if self.parent else [self]
        place = next(i for i, c in enumerate(siblings) if c is self)
        return siblings[place + 1] if place + 1 < len(siblings) else None

    def class_has(self, part: str) -> bool:
        return part in self.attrs.get("class", "")

    def text(self, separator: str = "") -> str:
        """The trimmed, non-empty pieces of text inside, without scripts and styles."""
        out: list[str] = []
        todo: list[Element | str] = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node.strip())
            elif node.tag not in UNREAD:
                todo += reversed(node.children)
        return separator.join(t for t in out if t)


def parse(source: str) -> Element:
    """The tree of a page. End tags are implied where HTML implies them; an end tag without an open element is ignored."""
    root = Element("#root")
    stack, open_tags = [root], {}

    def close(upto: int) -> None:
        for node in stack[upto:]:
            open_tags[node.tag] -= 1
        del stack[upto:]

    for value, kind, attrs in tokens(source):
        if kind is None:
            if value:
                stack[-1].children.append(value)
            continue
        if kind == "/":
            if open_tags.get(value):
                close(max(i for i, e in enumerate(stack) if e.tag == value))
            continue
        ends, fences = IMPLIED_ENDS.get(value, ((), ()))
        if value in ENDS_PARAGRAPH and open_tags.get("p"):
            ends, fences = (*ends, "p"), (*fences, "button", "td", "th", "li")
        if any(open_tags.get(t) for t in ends):
            upto = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    upto = i
                elif stack[i].tag in fences:
                    break
            close(upto)
        node = Element(value, attrs, stack[-1])
        stack[-1].children.append(node)
        if value not in VOID and (len(stack) < MAX_DEPTH or value in RAW):
            stack.append(node)
            open_tags[value] = open_tags.get(value, 0) + 1
    return root
