"""Main text of web pages by line-block distribution.

1. Markup is stripped to lines, one for each block element; inline elements don't break lines.
2. A line's length is that of its text outside hidden elements; lines in menus, headers, footers, sidebars, notices,
   forms and comments have length 0, and so have lines that are mostly links. Class names and ids are only
   hints: a wrapper that holds an article, a main element or the page's heading isn't hidden by one, and in an article
   a weak hint (``related-work``) doesn't hide text in which the distribution surges. A class that speaks of adverts
   hides nothing by itself: its element's windows are counted apart from the rest, at an ADVERT-th of their length.
3. Lengths are summed over windows of WIDTH lines. Text begins where the sum surges to a threshold and ends where it
   dives to 0. Article and main elements bound windows: no window crosses their edges, and in one where the sum surges
   all stretches between dives are text, so that short lines at its edges stay. In such an element windows dive, too,
   where WIDTH lines on end are labels: fewer than PLAIN characters that end no sentence (``Advertisement``, ``Follow
   us``), or mostly links; items of lists and tables, and the page's heading, are no labels. Elsewhere a stretch needs
   its own surge, to the whole of SURGE if an article surges.
4. All stretches of the page stay, in page order, with the links inside them; none is dropped or cut.

Every page takes this way. What the method can't see: outside articles, a short paragraph that WIDTH lines without
length part from the body, if it has fewer characters than the threshold; in articles, fewer than WIDTH labels on end
between paragraphs, which stay as subheadings would, and WIDTH lines of verse shorter than PLAIN, which go unless the
whole article is of that kind.

Defined results: null or empty html, or a page without text, gives an empty string; repeated rows are treated alike;
texts of any length take time and memory in proportion; markup that breaks off ends the text there; a character reference
that breaks off stays as it is written; other columns pass through, one named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import others, small_batches

WIDTH = 3
#: A window surges at SURGE characters, or at this share of the page's largest window if that is less.
SURGE, SURGE_SHARE = 86, 0.2
#: A line with more than this share of link text has length 0, unless it has PLAIN characters outside links.
LINKED, PLAIN = 0.5, 20

#: The divisor of lengths where a class speaks of adverts.
ADVERT = 10
#: The end of a sentence, with quotes and brackets that close after it.
SENTENCE = regex.compile(r"[\p{Sentence_Terminal}:;…]\p{P}*\Z")

#: A quote counts only as an attribute value's delimiter, after '='; else '>' ends a tag, if any '>' follows.
TOKEN = regex.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+|[^>]*+)>|<[!?/][^>]*+>|<(?=[a-zA-Z!/?])[^>]*+\Z""", regex.S)
ATTRIBUTE = regex.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Names that only say what a page has or lacks.
NEGATED = regex.compile(r"\b(?:no|not|has|with|without|hide|show)[_-][\w-]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title object canvas math xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
HIDDEN = frozenset("nav footer aside form menu dialog button select head".split())
SPACE = frozenset("br td th".split())
#: Elements whose short lines are text, not labels.
ITEMS = frozenset("h1 li dt dd pre caption figcaption option summary table tbody tfoot thead tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Parts of class names and ids that mark what isn't the article, wherever they stand ...
STRONG = frozenset("cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs pagination pager".split())
#: ... and such as articles have, too.
WEAK = frozenset("banner nav navbar navigation menu submenu header masthead topbar footer sidebar aside rail widget widgets notice notices alert related recommended recommendations toolbar search copyright legal disclaimer skip".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
TALK = frozenset("comment comments commentlist disqus respond replies".split())
WHOLE = frozenset("html body main".split())


class _Hint:
    """An element whose class, id or role hints that it isn't the article."""

    __slots__ = ("parent", "weak", "exact", "placed", "advert", "wraps", "first", "last", "chars", "hides", "apart")

    def __init__(self, parent: int, weak: bool, exact: bool, placed: bool, advert: bool, line: int):
        self.parent, self.weak, self.exact, self.placed, self.advert, self.wraps = parent, weak, exact, placed, advert, False
        self.first = self.last = line
        self.chars, self.hides = 0, True
        self.apart = 0  # the outermost hint that counts apart, 0 if another hides it or none does


class _Page:
    """Lines of a page. A line: its article or main element (0: none), its block's tag and its pieces; a piece: text, in a link, hidden
    by an element's kind, and the innermost hint it stands in (0: none)."""

    def __init__(self, page: str):
        self.lines: list[tuple[int, str, list[tuple[str, bool, bool, int]]]] = []
        self.hints = [_Hint(0, False, False, False, False, 0)]
        self.places = 0
        self.stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]  # tag, hidden, talk, place, hint
        self.at: dict[str, list[int]] = {}  # where on the stack the open elements of a tag are
        self.blocks: list[int] = []
        self.pieces: list[tuple[str, bool, bool, int]] = []
        self.links = 0
        self._read(page)
        self._decide()

    def _read(self, page: str) -> None:
        at, raw = 0, ""
        for m in TOKEN.finditer(page):
            tag = (m["tag"] or "").lower()
            if raw:
                if not (m["end"] and tag == raw):
                    continue
                raw, at = "", m.end()
                continue
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if not tag:
                continue
            if tag in SPACE and self.pieces:
                self._text(" ")
            if tag in RAW:
                if not m["end"] and not m["rest"].endswith("/"):
                    raw = tag
            elif m["end"]:
                self._close(tag)
            else:
                self._open(tag, m["rest"])
        if not raw and at < len(page):
            self._text(page[at:])
        self._flush()

    def _text(self, piece: str) -> None:
        _, hidden, _, _, hint = self.stack[-1]
        self.pieces.append((piece, self.links > 0, hidden, hint))

    def _flush(self) -> None:
        if self.pieces:
            self.lines.append((self.stack[-1][3], self.stack[self.blocks[-1]][0] if self.blocks else "", self.pieces))
            self.pieces = []

    def _pop(self) -> None:
        tag, _, _, _, hint = self.stack.pop()
        if tag:
            self.at[tag].pop()
            self.links -= tag == "a"
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        if hint and hint != self.stack[-1][4]:
            self.hints[hint].last = len(self.lines)

    def _close(self, tag: str) -> None:
        block, open_ = tag in BLOCK, self.at.get(tag)
        if block:
            self._flush()
        if not open_:
            return
        if not block and self.blocks and self.blocks[-1] > open_[-1]:  # an inline element ends inside a block: only it does
            place = open_.pop()
            self.links -= tag == "a"
            self.stack[place] = ("", *self.stack[place][1:])
            return
        upto = open_[-1]
        while len(self.stack) > upto:
            self._pop()

    def _open(self, tag: str, rest: str) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
            if self.at.get("p"):
                self._close("p")
        if tag in VOID or rest.endswith("/"):
            return
        _, hidden, talk, place, hint = self.stack[-1]
        named = {k.lower(): (a or b or c or "").lower() for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
        whole = set(NEGATED.sub("", f"{named.get('class', '')} {named.get('id', '')}").split()) if named else set()
        parts = {p for w in whole for p in regex.split("[_-]+", w)}
        talks = bool(parts & TALK) and tag not in WHOLE
        if tag in ("main", "h1") or tag == "article" and not talk and not talks:
            up = hint
            while up and not self.hints[up].wraps:
                self.hints[up].wraps = True
                up = self.hints[up].parent
        if tag in HIDDEN or tag == "header" and not place:
            hidden = True
        elif tag not in WHOLE and not (tag[0] == "h" and tag[1:].isdigit()):
            strong, advert = talks or bool(parts & STRONG) or named.get("role") in ROLES, bool(parts & ADVERTS)
            if strong or advert or parts & WEAK:
                self.hints.append(_Hint(hint, not (strong or advert), bool(whole & WEAK), place > 0, advert and not strong, len(self.lines)))
                hint = len(self.hints) - 1
        if tag in ("article", "main") and not place and not hidden and not talk and not talks:
            self.places += 1
            place = self.places
        self.at.setdefault(tag, []).append(len(self.stack))
        if block:
            self.blocks.append(len(self.stack))
        self.links += tag == "a"
        self.stack.append((tag, hidden, talk or talks, place, hint))

    def _decide(self) -> None:
        """Which hints hide their element."""
        total, used = 0, set()
        for place, _, pieces in self.lines:
            for text, _, hidden, hint in pieces:
                n = 0 if hidden else len(text.strip())
                total += n
                self.hints[hint].chars += n
                if n:
                    used.add(place)
        for h in reversed(self.hints[1:]):
            self.hints[h.parent].chars += h.chars
        plain = [self._length(pieces) for _, _, pieces in self.lines]
        for h in self.hints[1:]:
            if h.wraps:
                h.hides = False
            elif h.weak and not h.placed and used <= {0}:
                h.hides = 2 * h.chars <= total
            elif h.weak and h.placed and not h.exact:
                inside = plain[h.first : h.last]
                h.hides = max((sum(inside[i : i + WIDTH]) for i in range(len(inside))), default=0) < SURGE
        self.hints[0].hides = False
        for i, h in enumerate(self.hints[1:], 1):
            above = self.hints[h.parent]
            if above.hides:
                h.hides, h.apart = True, above.apart if h.advert or h.wraps or not h.hides else 0
            elif h.hides and h.advert:
                h.apart = i

    @staticmethod
    def _length(pieces: list) -> int:
        shown = [(" ".join(t.split()), link) for t, link, hidden, _ in pieces if not hidden]
        n, linked = sum(len(t) for t, _ in shown), sum(len(t) for t, link in shown if link)
        return n if linked <= LINKED * n else n - linked if n - linked >= PLAIN else 0

    def measured(self) -> list[_Line]:
        """The lines that hold more than white space."""
        out = []
        for place, tag, pieces in self.lines:
            if all(t.isspace() for t, _, _, _ in pieces):
                continue
            body = [p for p in pieces if not (p[2] or self.hints[p[3]].hides)]
            apart = next((self.hints[h].apart for _, _, hidden, h in pieces if not hidden and self.hints[h].apart), 0)
            line = _Line(_joined(body), 0, place, tag, apart)
            line.length = self._length(body) if line.text else 0
            if apart:
                line.both = _joined([p for p in pieces if not p[2] and (self.hints[p[3]].apart or not self.hints[p[3]].hides)])
                line.advert = self._length([p for p in pieces if self.hints[p[3]].apart]) / ADVERT
            out.append(line)
        return out


def _joined(pieces: list) -> str:
    return " ".join("".join(unescape(t) for t, _, _, _ in pieces).split())


class _Line:
    """Text without what is hidden (empty if all is), its length in the distribution, its article or main element, its
    block's tag, and the hint that is counted apart in it, with the text that has both and the length of that part."""

    __slots__ = ("text", "length", "place", "tag", "apart", "both", "advert")

    def __init__(self, text: str, length: int, place: int, tag: str, apart: int):
        self.text, self.length, self.place, self.tag, self.apart = text, length, place, tag, apart
        self.both, self.advert = "", 0.0

    def is_label(self) -> bool:
        return not self.length or self.tag not in ITEMS and len(self.text) < PLAIN and not SENTENCE.search(self.text)


def stretches(length: list) -> list[tuple[int, int]]:
    """First and end of the stretches of lines that a dive (WIDTH lines without length) bounds."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(length):
        if n:
            if out and i - out[-1][1] < WIDTH:
                out[-1] = out[-1][0], i + 1
            else:
                out.append((i, i + 1))
    return out


def without_labels(part: list[_Line]) -> list[int]:
    """Lengths of an element's lines, 0 where WIDTH lines with text on end are labels. In an element of labels only,
    all keep their length."""
    length = [line.length for line in part]
    shown = [i for i, line in enumerate(part) if line.text]
    labels = [part[i].is_label() for i in shown]
    if all(label or part[i].tag == "h1" for i, label in zip(shown, labels, strict=True)):
        return length
    first = 0
    for at in range(len(shown) + 1):
        if at == len(shown) or not labels[at]:
            if at - first >= WIDTH:
                for i in shown[first:at]:
                    length[i] = 0
            first = at + 1
    return length


def _runs(lines: list[_Line], key) -> list[tuple[int, int]]:
    bounds = [i for i in range(len(lines)) if not i or key(lines[i]) != key(lines[i - 1])]
    return list(zip(bounds, [*bounds, len(lines)][1:], strict=True))


def main_text(page: str) -> str:
    """The lines between surge and dive, joined by newlines."""
    found = _Page(page).measured()
    parts = _runs(found, lambda line: line.place)
    peak = lambda length: max((sum(length[i : i + WIDTH]) for i in range(len(length))), default=0)
    peaks = [peak([line.length for line in found[a:z]]) for a, z in parts]
    threshold = min(SURGE, SURGE_SHARE * max(peaks, default=0))
    framed = any(found[a].place and n and n >= threshold for (a, _), n in zip(parts, peaks, strict=True))
    kept: dict[int, str] = {}
    for (first, end), n in zip(parts, peaks, strict=True):
        part, element = found[first:end], found[first].place
        least = threshold if element or not framed else SURGE
        if not n or n < least:
            continue
        length = without_labels(part) if element else [line.length for line in part]
        for a, z in stretches(length):
            if element:  # its edges bound the first and last stretch
                a, z = (0 if a < WIDTH else a), (len(part) if len(part) - z < WIDTH else z)
            elif peak(length[a:z]) < least:
                continue
            kept |= {first + i: part[i].text for i in range(a, z)}
    for first, end in _runs(found, lambda line: line.apart):
        if found[first].apart:
            length = [line.advert for line in found[first:end]]
            kept |= {first + i: found[first + i].both for a, z in stretches(length) if peak(length[a:z]) >= SURGE for i in range(a, z)}
    return "\n".join(kept[i] for i in sorted(kept) if kept[i])


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Replaces the column ``html`` by ``out``: the page's main text (string, never null)."""
    small_batches(pages.sparkSession)
    rest = others(pages, html, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "") for x in b.column(b.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in rest), pa.array(texts, pa.string())], [*(f.name for f in rest), out])

    return pages.select(*[f"`{f.name}`" for f in rest], f"`{html}`").mapInArrow(run, T.StructType([*rest, T.StructField(out, T.StringType())]))
