"""Pages as sequences of leaf blocks: the text between two block-level tags, with the elements it stands in."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

# Elements of HTML by how they part text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    # formulas stand in their sentence
    " math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts mprescripts mspace mpadded mphantom merror menclose mtable mtr mtd maction semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())  # nothing inside is a tag; without an end tag they run to the page's end
UNSEEN = frozenset("noscript template iframe object svg select".split())  # without an end tag they end with their parent
CLOSED_BY = {
    "p": frozenset("p div ul ol li table article section aside header footer nav form h1 h2 h3 h4 h5 h6 blockquote pre main figure dl hr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in RAW}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    words: tuple[str, ...]  # of its class, id and role
    parent: Element | None
    depth: int  # of elements around it


@dataclass
class Block:
    inmost: Element | None  # the element it stands in; the others are its parents, which all blocks share
    text: str
    linked: int  # characters inside links


def steps(page: list[Block]) -> Iterator[tuple[int, list[Element], Block]]:
    """For each block the number of elements left since the block before, and those entered, from the outside.

    Blocks are in page order, so an element is entered and left about once, however deep it lies.
    """
    before: Element | None = None
    for block in page:
        left, entered, now = 0, [], block.inmost
        while before is not now:
            if now is None or (before is not None and before.depth >= now.depth):
                before, left = before.parent, left + 1
            else:
                entered.append(now)
                now = now.parent
        yield left, entered[::-1], block
        before = block.inmost


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space made single.

    Any text parses: unclosed elements end where HTML lets them or at the end, unknown end tags and a tag that the
    page's end cuts off are passed over. Line breaks inside a block count as white space. Text of elements that a
    browser doesn't show (``RAW`` and ``UNSEEN``) is in no block, and such elements don't part the text around them.
    Memory and time grow in proportion to the page, however deep its elements are nested.
    """
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # tags in the stack
    out: list[Block] = []
    parts: list[str] = []
    links, linked = 0, 0
    hidden: int | None = None  # the place in the stack of an element of UNSEEN, if inside one
    around: Counter[str] = Counter()  # open inline elements of the block
    inside: Counter[str] = Counter()  # and of the hidden element

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def push(name: str, words: tuple[str, ...] = ()) -> None:
        stack.append(Element(name, words, stack[-1] if stack else None, len(stack)))
        opened[name] += 1

    def cut(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    def place(name: str) -> int:
        if not opened[name]:
            return -1
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == name)

    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        whole, at = token[0], token.end()
        if whole[0] != "<" or whole == "<":
            if hidden is not None:
                continue
            piece = html.unescape(whole) if "&" in whole else whole
            parts.append(piece)
            if links:
                linked += len(piece.strip())
            continue
        name = token[2] or token[5]
        if not name:
            continue
        name = name.lower()
        end, closed = bool(token[1] or token[4]), whole.endswith("/>")
        if name in RAW and not end:
            if not (closed and hidden is not None and stack[hidden].tag == "svg"):
                over = _RAW_END[name].search(page, at)
                at = over.end() if over else len(page)
            continue
        if hidden is not None:
            if name in INLINE:
                leaves = end and not inside[name] and around[name] > 0
                if not leaves:
                    if not closed and name not in VOID:
                        inside[name] = max(0, inside[name] + (-1 if end else 1))
                    continue
            elif end:
                found = place(name)
                leaves = 0 <= found < hidden
                if not leaves:
                    if found >= 0:
                        cut(found)
                    if found == hidden:
                        hidden = None
                    continue
            else:
                while len(stack) > hidden + 1 and name in CLOSED_BY.get(stack[-1].tag, ()):
                    cut(len(stack) - 1)
                if name not in VOID and not (closed and (name == "svg" or stack[hidden].tag == "svg")):
                    push(name)
                continue
            cut(hidden)
            hidden = None
        if name in UNSEEN:
            if not end and not (closed and name == "svg"):
                hidden = len(stack)
                inside.clear()
                push(name)
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = max(0, links + (-1 if end else 1))
        if name in INLINE or name == "br":
            around[name] = max(0, around[name] + (-1 if end else 1))
            continue
        flush()
        links = 0
        around.clear()
        if end:
            found = place(name)
            if found >= 0:
                cut(found)
        elif name not in VOID:
            while stack and name in CLOSED_BY.get(stack[-1].tag, ()):
                cut(len(stack) - 1)
            words: tuple[str, ...] = ()
            if token[3] and "=" in token[3]:
                words = tuple(w.lower() for m in _NAMED.finditer(token[3]) for w in _PIECE.findall(m[1] or m[2] or m[3] or ""))
            push(name, words)
    if hidden is not None:
        cut(hidden)
    flush()
    return out
