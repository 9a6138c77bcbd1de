"""A small tolerant HTML reader: element trees, blocks of text."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the given kind (as far as the next holder).
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select menu".split())


class Element:
    __slots__ = ("tag", "key", "names", "children")

    def __init__(self, tag: str, names: tuple = ()):
        self.tag, self.names = tag, names
        self.key = ".".join((tag, *names))
        self.children: list = []            # Element or str (raw text)


def _names(attributes: str) -> tuple:
    """Tokens of class, id and role, their letter runs joined by hyphens, without digits."""
    if not attributes or "=" not in attributes:
        return ()
    out: list = []
    for _, v in _ATTRIBUTE.findall(attributes):
        out += filter(None, ("-".join(_NAME.findall(token)) for token in v.lower().split()))
    return tuple(dict.fromkeys(out))


def parse(text: str | None) -> Element:
    """The element tree of a page, however broken; an unfinished tag at the end is dropped."""
    root = Element("#page")
    if not text:
        return root
    stack, at, n = [root], 0, len(text)
    match = _TOKEN.match
    open_: dict = {}                        # how many elements of a tag are open

    def close(k):
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    while at < n:
        m = match(text, at)
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                stack[-1].children.append(token)
            continue
        if m[4] != ">":                     # cut off inside a tag
            break
        tag = name.lower()
        if m[1]:
            if open_.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag not in INLINE:               # a block ends an open paragraph
            if open_.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
            ends = CLOSES.get(tag)
            if ends and any(open_.get(t) for t in ends.split()):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in HOLDERS:
                        break
                    if stack[k].tag in ends.split():
                        close(k)
                        break
        e = Element(tag, _names(m[3]))
        stack[-1].children.append(e)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(text, at)
            e.children.append(text[at:end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(e)
            open_[tag] = open_.get(tag, 0) + 1
    return root


def blocks(root: Element, skip, fixed=None) -> list:
    """Texts of the blocks below an element in page order: character references decoded,
    white space reduced to one space, trimmed, empty ones left out. ``skip(element, path)``
    leaves out a whole subtree; the path is the keys from the root down to the element. A block
    whose texts are all ``fixed(path, text)`` is left out too. Walks without recursion, so depth
    has no limit."""
    out: list = []
    run: list = []
    varies = fixed is None

    def flush():
        nonlocal varies
        if run:
            t = " ".join(html.unescape("".join(run)).split())
            if t and varies:
                out.append(t)
            run.clear()
        varies = fixed is None

    todo: list = [(root, False, "")]
    while todo:
        node, closing, path = todo.pop()
        if isinstance(node, str):
            run.append(node)
            if not varies and not node.isspace() and not fixed(path, node):
                varies = True
        elif closing:
            flush()
        elif node.tag == "br":
            run.append(" ")
        elif not skip(node, path):
            if node.tag not in INLINE:
                flush()
                todo.append((node, True, path))
            below = path if node is root else f"{path}/{node.key}"
            todo.extend((c, False, below) for c in reversed(node.children))
    flush()
    return out
