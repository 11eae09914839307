"""What a page holds, in order: block tags with the path they stand under, and the text after each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

#: Kinds of place: never main text, undecided, inside the element that holds the main text.
DROPPED, PLAIN, MAIN = 0, 1, 2

# Elements of HTML by what they mean for a text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rb rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSED_BY_LIKE = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
LIST_OWNERS = set("ul ol menu dl table select".split())
HEAD_TAGS = set("base link meta title style script noscript template".split())
DROPPED_TAGS = RAW | set(
    "head nav header footer aside form noscript template svg math button select dialog menu object canvas audio video".split()
)
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class names and ids that mark what is not main text.
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination pager popup promo promoted promotion related respond share sharing sidebar sidebars signup social sponsor "
    "sponsored subscribe subscription teaser toolbar widget widgets".split()
)
MAIN_TAGS = {"article", "main"}
#: Elements nested deeper are not kept open, as in browsers; their text is read all the same.
MAX_DEPTH = 512
#: Their names speak of what the page has, not of what the element is.
WHOLE_PAGE = {"html", "body", "main"}

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)
      | <(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)
    """,
    re.X | re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _hash(parent: int, text: str) -> int:
    """A signed 64-bit number, as Spark's longs are."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


START = _hash(0, "page")


@dataclass
class Outline:
    """One entry per block tag, the first for the start of the page.

    ``tags`` are hashes of a tag, its class and id without digits, and its path; ``texts`` the text up
    to the next block tag, white space as one blank; ``areas`` where that text stands; ``links`` how
    many of its words stand in links.
    """

    tags: list[int] = field(default_factory=list)
    areas: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def text_tokens(self) -> list[int]:
        """Hash of each text under its tag; 0 where there is none."""
        return [_hash(tag, text) if text else 0 for tag, text in zip(self.tags, self.texts)]


@dataclass
class _Open:
    name: str
    path: int
    area: int
    link: bool
    block: bool


def _speaks_of(name: str, rest: str) -> tuple[str, bool]:
    """What tells elements of one name apart, and whether the names drop the element."""
    marks, drop = [], False
    for kind, value in _ATTRIBUTE.findall(rest):
        kind, value = kind.lower(), value.strip("\"'")
        if kind == "hidden":
            drop |= value.lower() != "false"
        elif kind == "role":
            drop |= value.lower().strip() in DROPPED_ROLES
        else:
            marks.append(_DIGITS.sub("#", value))
            if name in WHOLE_PAGE:
                continue
            # Names on an article tell what it comes with; only a whole name says what it is.
            words = value.lower().split() if name == "article" else (w.lower() for w in _WORD.findall(value))
            drop |= any(w in DROPPED_WORDS for w in words)
    return " ".join([name, *marks]), drop


def _close_until(stack: list[_Open], names: set[str], walls: set[str]) -> None:
    """Closes the innermost element of ``names`` unless one of ``walls`` comes before it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in walls:
            return


def _closed_before(stack: list[_Open], name: str) -> None:
    """Elements that the start of ``name`` ends although nothing closes them."""
    if name == "body" or (name not in HEAD_TAGS and name not in INLINE):
        _close_until(stack, {"head"}, {"body"})
    if name in CLOSES_P:
        _close_until(stack, {"p"}, CLOSES_P - {"p"} | {"td", "th", "li"})
    if name in CLOSED_BY_LIKE:
        likes = CLOSED_BY_LIKE[name]
        while any(e.name in likes for e in stack[_owner(stack):]):
            _close_until(stack, likes, LIST_OWNERS)


def _owner(stack: list[_Open]) -> int:
    """Where the innermost list or table begins its content."""
    return next((i + 1 for i in range(len(stack) - 1, 0, -1) if stack[i].name in LIST_OWNERS), 1)


def outline(page: str | None) -> Outline:
    """The outline of a page; of NULL only its start. Any text gives one, however broken its markup is."""
    page = page or ""
    out = Outline()
    stack = [_Open("", START, PLAIN, False, True)]
    pieces: list[str] = []
    links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw and (stack[-1].area != DROPPED or out.areas[-1] == DROPPED):
            raw = html.unescape(raw)
            pieces.append(raw)
            if stack[-1].link:
                links += len(raw.split())

    def entry(tag: int) -> None:
        nonlocal links
        if out.tags:
            out.texts.append(" ".join("".join(pieces).split()))
            out.links.append(links)
        pieces.clear()
        links = 0
        out.tags.append(tag)
        out.areas.append(stack[-1].area)

    entry(START)
    at = 0
    while found := _TAG.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if not name:
            continue
        name = name.lower()
        if found["close"] or found["close2"]:
            _end_tag(stack, name, entry)
            continue
        rest = found["rest"] or found["rest2"] or ""
        block = name not in INLINE
        if block:
            _closed_before(stack, name)
        elif name == "br":
            pieces.append(" ")
        mark, drop = _speaks_of(name, rest) if rest else (name, False)
        top = stack[-1]
        area = top.area
        if drop or name in DROPPED_TAGS:
            area = DROPPED
        elif name in MAIN_TAGS and area == PLAIN:
            area = MAIN
        path = _hash(top.path, mark) if block else top.path
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
        if name not in VOID and len(stack) < MAX_DEPTH:
            stack.append(_Open(name, path, area, top.link or name == "a", block))
        if block:
            entry(path)
    say(page[at:])
    entry(START)
    # The closing entry only flushed the text of the last one.
    out.tags.pop()
    out.areas.pop()
    return out


def _end_tag(stack: list[_Open], name: str, entry) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == name:
            closed = stack[i]
            del stack[i:]
            if closed.block:
                entry(_hash(closed.path, "/"))
            return
        if name in INLINE and stack[i].block:
            return
    if name not in INLINE:
        entry(_hash(stack[-1].path, f"/{name}"))
