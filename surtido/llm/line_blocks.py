"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block element; what stands in
navigation, adverts, forms, comments and the like leaves an empty line. Lines
weigh as much as their text, lines of links and, where a page marks its article,
lines outside it nothing. The weights of ``window`` consecutive lines are
summed: the main text begins at the first surge, where the sums rise from
nothing and reach the threshold, and ends at the last dive to nothing; marks
take the place of the threshold.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.llm.common import map_rows, struct_of

# Fixed values of HTML: elements by the way they are read.
_RAW = frozenset("script style noscript textarea title iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr img").split())
# Elements and words in class, id or role that mark what is no article.
_ASIDE = frozenset("nav footer aside form menu dialog button select head template svg math object canvas audio video".split())
_ASIDE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar footer comment comments commentlist disqus reply replies cookie cookies consent"
    " notice notices alert newsletter subscribe signup share sharing social related recommended popup modal pagination"
    " pager toolbar masthead contentinfo complementary search login").split())
#: Words that make a compound name speak of a relation to such a part, or of its absence.
_RELATION_WORDS = frozenset("no not non has have with without hide hidden is is-not disable disabled off enabled".split())
_SCOPES = ("article", "main")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(=?[^\s/>=]*+)(?:\s*+(=)\s*+(["'])?)?)?""")
_VALUE = re.compile(r"[^\s>]*+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


def _names_aside(value: str) -> bool:
    """Whether one of the names in a class, id or role attribute is that of a part outside the article."""
    for name in value.split():
        words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)
        words = [w.lower() for w in words]
        if not _ASIDE_WORDS.isdisjoint(words) and _RELATION_WORDS.isdisjoint(words):
            return True
    return False


def _is_aside(name: str, attributes: dict[str, str], scopes: int) -> bool:
    if name in _ASIDE or name == "header" and not scopes:
        return True
    if not attributes or name in ("html", "body", "main") or name in _INLINE:
        return False
    if attributes.get("hidden", "false").lower() != "false" or _NO_DISPLAY.search(attributes.get("style", "")):
        return True
    marks = [attributes[k] for k in ("class", "id", "role") if k in attributes]
    if name == "article":  # its class often speaks of the parts that it has
        return any(w.lower() in _ASIDE_WORDS for m in marks for w in m.split())
    return any(map(_names_aside, marks))


class _Page:
    """A page read forward, every character once: ``items`` gives texts and tags as they come."""

    def __init__(self, page: str):
        self.page, self._gone = page, {}

    def _find(self, what: str, at: int) -> int:
        """As ``str.find``; what was once not found is not looked for again."""
        if self._gone.get(what, len(self.page) + 1) <= at:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self._gone[what] = min(at, self._gone.get(what, at))
        return found

    def _attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from ``at``, the place after the tag, and whether it closes itself."""
        page, found, closing = self.page, {}, False
        while at < len(page) and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            closing = "/" in page[at : m.end()] and not m[1]
            if m[3]:
                end = self._find(m[3], m.end())
                if end < 0:  # never closed: the tag ends where the next one could
                    end = self._find(">", m.end())
                value, at = page[m.end() : end], end if page[end] == ">" else end + 1
            elif m[2]:
                v = _VALUE.match(page, m.end())
                value, at = v[0], v.end()
            else:
                value, at = "", max(m.end(), at + (m.end() == at))
            if m[1]:
                found.setdefault(m[1].lower(), value)
        return found, at + 1, closing

    def items(self) -> Iterator[tuple[str, bool, dict[str, str] | None, str]]:
        """(name, is an end tag, attributes, text): texts have no name, end tags no attributes."""
        page, at, text_from = self.page, 0, 0
        while (at := self._find("<", at)) >= 0:
            after = page[at + 1 : at + 2]
            if after in ("!", "?") or after == "/" and not page[at + 2 : at + 3].isalpha():
                if page.startswith("<!--", at):
                    end = self._find("-->", at + 4)
                    end = len(page) if end < 0 else end + 3
                else:
                    end = self._find(">", at) + 1
                if not end:  # no markup: nothing closes it
                    at += 1
                    continue
                yield "", False, None, page[text_from:at]
                at = text_from = end
                continue
            name = self._find(">", at) > 0 and _NAME.match(page, at + 1 + (after == "/"))
            if not name:
                at += 1  # a bare < is text
                continue
            yield "", False, None, page[text_from:at]
            attributes, at, closing = self._attributes(name.end())
            text_from = at
            lower = name[0].lower()
            if after == "/":
                yield lower, True, None, ""
                continue
            if not closing or lower not in _RAW:
                if lower in _RAW:
                    end = re.compile(rf"</{lower}(?=[\s/>])", re.I).search(page, at)
                    at = text_from = end.start() if end else len(page)
                yield lower, False, {**attributes, "/": ""} if closing else attributes, ""
        yield "", False, None, page[text_from:]


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, its characters in links, scope) by block; scope: 2 in an article, 1 in main, else 0.

    An element that is no article leaves one empty line.
    """
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    stack: list[str] = []
    opened: dict[str, list[int]] = {}  # places in the stack by name
    blocks: list[int] = []  # places of elements that are not inline
    aside, links, linked, scopes = 0, 0, 0, [0, 0]

    def flush() -> None:
        nonlocal linked
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            lines.append((text, linked, 2 if scopes[0] else 1 if scopes[1] else 0))
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal aside, links
        while len(stack) > depth:
            name = stack.pop()
            opened[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if aside and len(stack) < aside:
                aside = 0
                lines.append(("", 0, 0))
            if name == "a":
                links = max(0, links - 1)
            elif name in _SCOPES and not aside:
                scopes[_SCOPES.index(name)] = max(0, scopes[_SCOPES.index(name)] - 1)

    for name, ends, attributes, text in _Page(page).items():
        if not name:
            if text and not aside:
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        if name in _RAW:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in _INLINE and not aside:
            flush()
        if ends:
            if opened.get(name):
                # An inline end tag does not close the blocks opened since.
                place = opened[name][-1]
                if name not in _INLINE or not blocks or blocks[-1] < place:
                    close(place)
            continue
        if name in _VOID or "/" in attributes:
            continue
        if name not in _INLINE:
            # A block ends an open paragraph, and the inline elements left open in it.
            if blocks and (stack[blocks[-1]] == "p" or name == "li" and stack[blocks[-1]] == "li"):
                close(blocks[-1])
            blocks.append(len(stack))
        opened.setdefault(name, []).append(len(stack))
        stack.append(name)
        if aside:
            continue
        if _is_aside(name, attributes, scopes[0] + scopes[1]):
            aside = len(stack)
        elif name == "a":
            links += 1
        elif name in _SCOPES:
            scopes[_SCOPES.index(name)] += 1
    if not aside:
        flush()
    return lines


def _weights(lines: list[tuple[str, int, int]]) -> tuple[list[int], bool]:
    """What each line counts, and whether marks of the page decide it.

    An article counts where it holds at least half of the text around it, so
    that a teaser does not stand for the page; the main part counts wherever
    there is one.
    """
    articles, main, whole = (
        sum(len(t) for t, links, s in lines if s >= low and (low or 2 * links <= len(t))) for low in (2, 1, 0))
    around = main if any(s == 1 for t, _, s in lines if t) else whole
    if articles and 2 * articles >= around:
        return [len(t) if s == 2 else 0 for t, _, s in lines], True
    if any(s == 1 for t, _, s in lines if t):
        return [len(t) if s else 0 for t, _, s in lines], True
    return [0 if 2 * links > len(t) else len(t) for t, links, _ in lines], False


def main_text(page: str, window: int = 3, threshold: int = 86, share: float = 0.25) -> str:
    """The lines from the first surge to the last dive, joined by line feeds.

    Where a page marks its article (or its main part), other lines count as
    empty and every line with text surges. Without such marks, lines that are
    mostly links count as empty, and a stretch of sums surges if one of them
    reaches the threshold or, on pages with little text, ``share`` of the
    largest sum; the text goes on over a dive that excluded elements make, and
    ends at one that lines of links make after the last such stretch.
    """
    lines = lines_of(page)
    weights, marked = _weights(lines)
    if not any(weights):
        return ""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    enough = 1 if marked else min(threshold, share * max(sums))
    surge = next(i for i, total in enumerate(sums) if total >= enough)
    while surge and sums[surge - 1]:
        surge -= 1
    dive = len(sums) - next(i for i, total in enumerate(reversed(sums)) if total >= enough)
    # Up to the next line of links; excluded elements, empty lines, do not end the text.
    while dive < len(sums) and (weights[dive] or not lines[dive][0]):
        dive += 1
    return "\n".join(lines[i][0] for i in range(surge, dive) if weights[i])


def extract_main_text(pages: DataFrame, window: int = 3, threshold: int = 86, id_col: str = "page_id",
                      url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id and url columns and ``text``, the main text of each page.

    Null and empty pages, and pages without text, give an empty text. One
    output row for each input row, repeated rows and null ids included; other
    columns are not read; an empty table gives an empty table.
    """
    schema = struct_of(page_id="long", url="string", text="string")

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, page in taken:
            yield page_id, url, main_text(page, window, threshold)

    whole = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    found = map_rows(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), whole), rows, schema)
    return found.toDF(id_col, url_col, "text")
