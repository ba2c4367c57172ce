"""Main text of HTML pages by two-pass block rules.

Pass 1 cuts a page into blocks at block-level tags and classes each block:
inside menus, headers, footers, sidebars, notices, adverts, forms or reader
comments it is bad; inside the article container it is good unless it is
mostly links; elsewhere stop-word density, length and link density decide,
and short blocks stay open.  Text whose language has no stop words here is
judged by length, sentence marks and link density.  Pass 2 gives each open
block the label of its nearest decided neighbours: both good is good, both bad
is bad, and if they differ the nearer one decides.

A class or id that only contains a telling word among others ("has-sidebar",
"site-header") is weaker evidence than one that is that word: it yields where
it would leave a page without any text.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import small_batches, strings, tidy, with_columns

# fixed values: block-level elements of HTML
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
# fixed values: elements that hold raw text which is no text of the page, and those of them that reach to the page's end if left open
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
TO_END = frozenset("script style textarea xmp".split())
# fixed values: elements whose content is no text of the page; those that stand in a line take the place of a space
MUTE = frozenset("head template svg math object canvas audio video select button datalist".split())
IN_LINE = frozenset("svg math object canvas audio video select button iframe textarea embed img".split())
# fixed values: of these, the ones that an opening block ends if they were left open
ENDED = frozenset("head select button datalist".split())
# fixed values: elements that never hold content
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# containers that are never main text, by element and by a word of class, id or role (our own choice)
BAD_ELEMENTS = frozenset("nav footer aside form menu dialog search fieldset".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
GOOD_ELEMENTS = frozenset(["article", "main"])
# parts of a compound class that make it speak of the page or of the article (our own choice)
MODIFIERS = frozenset("has with no not is without show hide hidden toggle js".split())
GOOD_WORDS = frozenset("article content post main entry body text story".split())
# first parts of a compound class that speak of its content whatever follows ("comment-body"), and words that an article's own parts may bear
ALIEN = frozenset("ad ads advert advertisement comment comments cookie related reply replies sponsor sponsored".split())
OWN = frozenset(["header", "masthead"])
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
# fixed values: frequent function words of the corpus languages
STOP_WORDS = frozenset(
    "the of and a to in is was it for with as on be at by i this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up what about"
    " der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis"
    " le la les de des du et est un une en que qui dans pour pas sur au plus par ce il ne se son avec sont ou mais comme elle nous vous leur été cette aux ses"
    " el los las y que del se con para una su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)

# comments, declarations, and tags whose attribute values may be quoted or not
_TAG = r"</?[a-zA-Z][^\s/>]*+(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>))?+)?+|=)*+>"
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>?|<\?[^>]*>?|" + _TAG, re.S)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
# one attribute: name, and value in three ways of quoting
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_PARTS = re.compile(r"[a-z]+")
_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in RAW}
_BREAK = re.compile(r"\s*<br\b[^>]*>", re.I)


def _class_evidence(value: str, in_good: bool) -> tuple[bool, bool]:
    """(a whole class is a bad word, a compound class holds one) of a lower-cased class or id value; an article's own header is no evidence."""
    whole = compound = False
    for token in value.split():
        if token in BAD_WORDS:
            whole = True
            continue
        parts = _PARTS.findall(token)
        if len(parts) < 2 or parts[0] in MODIFIERS or BAD_WORDS.isdisjoint(parts) and parts[0] not in ALIEN:
            continue
        if parts[0] in ALIEN or (parts[-1] not in GOOD_WORDS and not (in_good and BAD_WORDS.intersection(parts) <= OWN)):
            compound = True
    return whole, compound


def _alien(value: str) -> bool:
    """Whether the class of an article says that it is a comment, an advert or another page's teaser."""
    return any(token.replace("_", "-").partition("-")[0] in ALIEN for token in value.split())


def _verdict(name: str, tag: str, in_good: bool) -> tuple[int, bool]:
    """What an opening tag says of its content: -1 bad, 1 good, 0 nothing; and whether that rests on a compound class only."""
    if name in BAD_ELEMENTS or (name == "header" and not in_good):
        return -1, False
    good, doubtful = int(name in GOOD_ELEMENTS), False
    if len(tag) > len(name) + 2:
        for m in _ATTR.finditer(tag, _NAME.match(tag).end()):
            key, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return -1, False
            if key == "role" and value in BAD_ROLES:
                return -1, False
            if key == "class" and name == "article" and _alien(value):
                return -1, True
            if key in ("class", "id") and name not in ("html", "body", "article", "main"):
                whole, compound = _class_evidence(value, in_good)
                if whole:
                    return -1, False
                doubtful |= compound
            if key == "role" and value in ("main", "article"):
                good = 1
    return (-1, True) if doubtful and not good else (good, False)


class Block:
    __slots__ = ("kind", "linked", "parts", "place")

    def __init__(self, place: int, kind: str = ""):
        self.place, self.parts, self.linked, self.kind = place, [], 0, kind

    def text(self) -> str:
        return " ".join(_html.unescape("".join(self.parts)).split())


def blocks_of(page: str, compound: bool = True) -> tuple[list[tuple[str, int, float, str]], bool]:
    """((text, place, link density, tag) of the page's non-empty blocks, whether a compound class excluded any).

    place: -1 in bad containers, 1 in the article, 0 elsewhere; tag: the one
    that opened the block.  Without ``compound`` such classes say nothing.
    """
    out: list[tuple[str, int, float, str]] = []
    stack: list[tuple[str, int]] = []  # open containers that say something, and those nested in them
    depth: dict[str, int] = {}
    place, links, at, n, doubted = 0, 0, 0, len(page), False
    muted, levels, inner, endless = "", 0, {}, set()
    whole = page.rfind(">") + 1  # no tag ends behind this place
    block = Block(0)

    def close(kind: str = ""):
        nonlocal block
        if block.parts:
            text = block.text()
            if text:
                out.append((text, block.place, min(1.0, block.linked / max(1, sum(map(len, block.parts)))), block.kind))
        block = Block(place, kind)

    def add(s: str):
        if s:
            block.parts.append(s)
            if links:
                block.linked += len(s.strip())

    m = _TOKEN.search(page, 0, whole)
    while m:
        tag = m[0]
        if not muted:
            add(page[at : m.start()])
        at = m.end()
        if tag[1] in "!?":
            m = _TOKEN.search(page, at, whole)
            continue
        name, closing = _NAME.match(tag)[1].lower(), tag[1] == "/"
        if name in RAW and not closing:
            if not muted and name in IN_LINE:
                add(" ")
            end = None if name in endless else _END[name].search(page, at)
            if not end:
                endless.add(name)
            if end or name in TO_END:
                at = end.end() if end else n
            elif not muted:
                muted, levels, inner = "button", 1, {}  # left open: up to the next block
            m = _TOKEN.search(page, at, whole)
            continue
        if muted:
            if closing and name == muted:
                levels -= 1
                muted = muted if levels else ""
                stays = True
            elif closing and inner.get(name):
                inner[name] -= 1
                stays = True
            elif closing:
                stays = name not in BLOCK  # else it closes what the muted element stands in
            elif name == muted:
                levels += name != "button"
                stays = True
            else:
                stays = not (muted in ENDED and name in BLOCK)
                if stays and name not in VOID and not tag.endswith("/>"):
                    inner[name] = inner.get(name, 0) + 1
            if stays:
                m = _TOKEN.search(page, at, whole)
                continue
            muted = ""
        if name in MUTE and not closing:
            if name in IN_LINE:
                add(" ")
            if not (name in ("svg", "math") and tag.endswith("/>")):
                muted, levels, inner = name, 1, {}
            m = _TOKEN.search(page, at, whole)
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            twice = _BREAK.match(page, at)
            if twice:  # two line breaks end a block
                at = twice.end()
                close(block.kind)
            else:
                add(" ")
        elif name in BLOCK:
            close("" if closing else name)
        elif name in IN_LINE:
            add(" ")
        if not (name in VOID or tag.endswith("/>") and name not in BLOCK):
            if closing:
                if depth.get(name):
                    while stack:
                        top, was = stack.pop()
                        depth[top] -= 1
                        place = was
                        if top == name:
                            break
                    if name in BLOCK or not block.parts:
                        block.place = place
            else:
                v, doubtful = _verdict(name, tag, place == 1)
                if doubtful:
                    doubted |= place != -1
                    v = v if compound else 0
                if v or name in depth or (name in BLOCK and name not in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and stack):
                    stack.append((name, place))
                    depth[name] = depth.get(name, 0) + 1
                    if v and place != -1:
                        place = v
                    if name in BLOCK or v:
                        if block.parts:
                            close(name)
                        block.place = place
        m = _TOKEN.search(page, at, whole)
    if not muted:
        cut = _OPEN.search(page, max(at, whole))  # a tag left open at the end
        add(page[at : cut.start() if cut else n])
    close()
    return out, doubted


_LETTERS = re.compile(r"[^\W\d_]")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff0e\uff1f\u061f\u06d4\u0964\u0589\u1362]")


def stop_share(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def classify(text: str, place: int, link_density: float, kind: str = "", known: bool = True, low: float = 0.2, high: float = 0.3, short: int = 70, long: int = 200, most_links: float = 0.5) -> int | None:
    """Pass 1: 1 good, 0 bad, None open.

    ``known`` says whether the page's language has stop words here.  Scripts
    without spaces between words say as much in a third of the characters.
    """
    if place < 0:
        return 0
    if place > 0:
        return 1
    if link_density > most_links:
        return 0
    letters = _LETTERS.findall(text)
    latin = sum(map(bool, map(_LATIN.match, letters)))
    if not known or 2 * latin < len(letters):
        size = len(text) * (3 if text.count(" ") * 15 < len(text) else 1)
        if size < short:
            return 0 if link_density > 0.2 else None
        if size > long and _SENTENCE.search(text):
            return 1
        return None if _SENTENCE.search(text) else 0
    stops, words = stop_share(text)
    density = stops / max(1, words)
    if len(text) < short:
        return 0 if link_density > 0.2 else None
    if density >= high:
        return 1 if len(text) > long else None
    if density >= low:
        return None
    return 0


def main_text(page: str | None) -> str:
    """The page's main text: good blocks in page order, joined by two line ends."""
    blocks, doubted = blocks_of(page or "")
    out = _select(blocks)
    if doubted and not any(place > 0 for _, place, _, _ in blocks):
        # compound classes left no article: they are believed only if there is none without them either
        again = blocks_of(page or "", compound=False)[0]
        if not out or any(place > 0 for _, place, _, _ in again):
            out = _select(again) or out
    return out


def _menus(blocks: list[tuple[str, int, float, str]], short: int = 70) -> list[bool]:
    """Which blocks of an article belong to a list of nothing but short links; a list with any other item is text."""
    out, i = [False] * len(blocks), 0
    while i < len(blocks):
        if blocks[i][1] <= 0 or blocks[i][3] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            i += 1
            continue
        end = i
        while end < len(blocks) and blocks[end][1] > 0 and blocks[end][3] == blocks[i][3]:
            end += 1
        if all(links > 0.9 and len(text) < short for text, _, links, _ in blocks[i:end]):
            out[i:end] = [True] * (end - i)
        i = end
    return out


def _select(blocks: list[tuple[str, int, float, str]]) -> str:
    """Pass 1 and 2 over the blocks of a page."""
    open_text = [stop_share(t) for t, place, links, _ in blocks if place == 0 and links <= 0.5 and len(t) >= 70]
    known = not open_text or sum(s for s, _ in open_text) >= 0.08 * sum(w for _, w in open_text)
    labels = [classify(*b, known) for b in blocks]
    menu = _menus(blocks)
    if any(v and not m for v, m in zip(labels, menu, strict=True)):  # an article made of links alone is one
        labels = [0 if m else v for v, m in zip(labels, menu, strict=True)]
    before, last = [], None  # nearest decided block before each, and after
    for i, v in enumerate(labels):
        before.append(last)
        if v is not None:
            last = (i, v)
    after, last = [None] * len(labels), None
    for i in range(len(labels) - 1, -1, -1):
        after[i] = last
        if labels[i] is not None:
            last = (i, labels[i])
    keep = []
    for i, (text, *_) in enumerate(blocks):
        v = labels[i]
        if v is None:
            a, b = before[i], after[i]
            if a is None and b is None:
                v = 1  # nothing is decided on the page
            elif a is None or b is None:
                v = (a or b)[1]
            elif a[1] == b[1]:
                v = a[1]
            else:
                v = a[1] if i - a[0] <= b[0] - i else b[1]
        if v:
            keep.append(text)
    return "\n\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; n_chars counts code points.

    Row-local.  A null or empty page, or one without main text, has the empty
    text; repeated rows are extracted one by one; bytes that are no UTF-8
    count as U+FFFD; pages of any length are read whole, in time proportional
    to it; an empty table gives an empty one; other columns are ignored.
    """

    def run(batches):
        for b in small_batches(batches, "html"):
            texts = [main_text(p) for p in strings(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_columns(pages, page_id="long", url="string", html="string").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
