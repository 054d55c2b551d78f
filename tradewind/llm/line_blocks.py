"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that each block of a page becomes one line; what stands in menus, headers, footers, sidebars,
notices, adverts, forms, scripts or reader comments leaves an empty line. The text lengths are summed over sliding
windows of lines. The text begins where the sums surge from nothing and ends at the last dive, the line from which on no
sum is a surge; every line between is kept, however short. If a page marks its content, by an article or other
elements, and what is marked holds at least half of the text in the windows that surge, lines outside it count as
empty and any text is a surge. Otherwise a surge must reach a share of the highest sum, unmarked lines that consist of
links count as empty unless they stand alone between lines of text, and after the dive the text goes on to the last
line that is marked or ends as a sentence, but not beyond a line with a copyright or legal notice.

Null html counts as empty: text "" with 0 characters. Markup that is cut off, unclosed or nested wrongly is read as
far as it goes; an unclosed script or style takes the rest of the page, other unclosed elements take nothing. Equal rows give equal results, an empty table an empty one; columns that are not named are ignored.
"""

from __future__ import annotations

import functools
import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.common import pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lines of a window; the least share of the highest window sum that is a surge where no content is marked, the length
# that is always one, and the least share of the text in surging windows that makes what is marked the content.
WINDOW, SURGE_SHARE, SURGE_CHARS, MARKED_SHARE = 3, 0.2, 250, 0.5

# Names of elements and of the classes, ids and roles that pages use.
RAW = "script style noscript template textarea title iframe svg canvas object annotation xmp noembed".split()
NO_TEXT = set("head nav aside footer form button select option datalist dialog menu audio video map".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr img math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msup msub msubsup mover"
    " munder munderover mstyle mpadded mtable mtr mtd".split()
)
BOILERPLATE = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead topbar header footer sidebar aside"
    " widget related recommended trending ad ads advert adverts advertisement advertising sponsor sponsored promo promotion"
    " banner notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup"
    " login share sharing social comment comments commentlist respond reply replies disqus discussion form search"
    " toolbar copyright legal hidden adsbygoogle".split()
)
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
CONTENT = set("article content main post entry story maincontent articlebody".split())
# What else a class name or id that stands for boilerplate as a whole may be made of: what it belongs to, what holds it.
BESIDE = set(
    "site page main post article entry top bottom box bar area block list link links button buttons item items icons wrap"
    " wrapper container section inner slot unit panel zone group text".split()
)
# Words before a boilerplate word that say what an element has, lacks or is about; words after one that name a state.
BELONGING = set("has have with no without is in on not category tag topic type format table column figure image overflow".split())
STATES = set("open opened closed active enabled disabled visible loaded ready free layout xs sm md lg xl print".split())
LEGAL = re.compile(r"©|\(c\)\s|(copyright|all rights reserved|imprint|privacy policy|terms of (use|service))\b", re.IGNORECASE)
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


@functools.cache
def _tokens(raw: tuple[str, ...]) -> re.Pattern:
    """Comments, tags, and whole elements named ``raw``."""
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{'|'.join(raw)})\b[^>]*>.*?(?:(?P<closed></(?P=raw)\s*>)|\Z)|<[!?][^>]*(?:>|\Z)"
        r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:"[^"]*+"|'[^']*+'|[^'">])*+)(?:>|\Z)"""
        r"|</?[a-zA-Z][^>]*(?:>|\Z)",
        re.DOTALL | re.IGNORECASE,
    )


def _found(page: str) -> Iterator[re.Match]:
    """The tokens of a page. What has no end tag from some place on is read as a tag from there on."""
    raw, at = tuple(RAW), 0
    while m := _tokens(raw).search(page, at):
        name = (m["raw"] or "").lower()
        if name and not m["closed"] and name not in ("script", "style"):
            raw = tuple(n for n in raw if n != name)
            continue
        yield m
        at = m.end()


_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _is_boilerplate(name: tuple[str, ...]) -> bool:
    """Whether a class name or id stands for boilerplate: by all of its words, by its first or by its last one.
    'cookie-law-info' and 'left-sidebar' do, 'category-social', 'with-sidebar' and 'menu-open' say something else."""
    words = BOILERPLATE.intersection(name)
    if not words:
        return False
    if (BOILERPLATE | BESIDE).issuperset(name):
        return True
    first, last = (word in BOILERPLATE and word != "hidden" for word in (name[0], name[-1]))
    return first and name[-1] not in STATES or last and not BELONGING.intersection(name[:-1])


def _cues(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is hidden or has a boilerplate role, whether a class name or id names it boilerplate, and
    whether it is named as the content."""
    names, drop = set(), False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            names |= {tuple(word.lower() for word in _WORDS.findall(name)) for name in value.split()}
            continue
        value = value.lower()
        if key == "role":
            drop |= value in BOILERPLATE_ROLES
            names |= {(value,)} & {("main",), ("article",)}
        else:
            drop |= key == "hidden" or (value == "true" if key == "aria-hidden" else "display:none" in value.replace(" ", ""))
    content = any(CONTENT.intersection(name) and not BOILERPLATE.intersection(name) for name in names)
    return drop, any(map(_is_boilerplate, names)), content


class _Lines:
    """The lines of one page: text, length that counts, and whether the line stands in marked content."""

    def __init__(self):
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def end(self, level: int) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            own = len(text) if self.linked < 0.6 * len(text) else 0
            self.lines.append((text, own, level))
        self.parts, self.linked = [], 0

    def gap(self) -> None:
        self.lines += [("", 0, 0)] * WINDOW


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, own length, level) per line; level 2 stands in an article, 1 in another element named as content."""
    out, at = _Lines(), 0
    skipped: list[str] = []  # open elements inside the boilerplate element that is being skipped
    open_: list[tuple[str, int]] = []  # open elements that mark content
    links, level = 0, 0
    for m in _found(page):
        if not skipped and m.start() > at:
            text = page[at : m.start()]
            out.parts.append(text)
            out.linked += len(text) if links else 0
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"] and not skipped:
                out.parts.append(" ")
            continue
        attributes = m["attributes"] or ""
        if m["end"]:
            if skipped:
                if name in skipped:
                    while skipped.pop() != name:
                        pass
                elif any(name == n for n, _ in open_) or name in ("body", "html"):
                    skipped = []  # the skipped element was never closed
                else:
                    continue
                if skipped:
                    continue
                out.gap()
                if not any(name == n for n, _ in open_):
                    continue
            if name == "a":
                links = 0
            if name not in INLINE:
                out.end(level)
            if any(name == n for n, _ in open_):
                while True:
                    n, level = open_.pop()
                    if n == name:
                        break
            continue
        if attributes.rstrip().endswith("/") or name in VOID:
            if not skipped and name not in INLINE:
                out.end(level)
            continue
        if skipped:
            if name == "article" and skipped[0] in ("p", "li", "td", "th", "tr", "dd", "dt"):
                skipped = []
            else:
                if not (name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and skipped[-1] == name and len(skipped) > 1):
                    skipped.append(name)
                continue
        drop, named, content = _cues(attributes) if attributes.strip() else (False, False, False)
        # Names alone never drop an article or what is named as content.
        drop |= named and not content and name != "article"
        if name in NO_TEXT or (name == "header" and level == 0) or (drop and name not in ("html", "body", "main")):
            out.end(level)
            if name == "body":
                continue
            skipped = [name]
            continue
        if name == "a":
            links = 1
        if name in INLINE:
            continue
        out.end(level)
        if name in ("article", "main") or content and name not in ("html", "body"):
            open_.append((name, level))
            level = max(level, 2 if name == "article" else 1)
        elif any(name == n for n, _ in open_):
            open_.append((name, level))
    if not skipped:
        rest = page[at:]
        out.parts.append(rest)
    out.end(level)
    return out.lines


def _sums(lengths: list[int]) -> list[int]:
    return [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]


def main_lines(lines: list[tuple[str, int, int]]) -> tuple[int, int, list[str]]:
    """Surge and dive, as numbers of lines (the dive is exclusive), and the texts between them."""
    lengths = [len(text) if level else own for text, own, level in lines]
    for k in range(1, len(lines) - 1):
        if lines[k][0] and not lengths[k] and lines[k - 1][1] and lines[k + 1][1]:
            lengths[k] = len(lines[k][0])
    marked = [length if level else 0 for length, (_, _, level) in zip(lengths, lines)]
    sums, inside = _sums(lengths), _sums(marked)
    if not any(sums):
        return 0, 0, []
    least = min(SURGE_CHARS, SURGE_SHARE * max(sums))
    surging = [(s, i) for s, i in zip(sums, inside) if s >= least]
    if any(marked) and sum(i for _, i in surging) >= MARKED_SHARE * sum(s for s, _ in surging):
        lengths, sums, least = marked, inside, 1
    # From the line with which the sums first surge, or the text without an empty window before it, to the last dive.
    surge = next(i for i, s in enumerate(sums) if s >= least)
    while surge and sums[surge - 1]:
        surge -= 1
    first = next(i for i in range(surge, len(lengths)) if lengths[i])
    dive = max(i for i, s in enumerate(sums) if s >= least) + 1
    last = dive
    for k in range(dive, len(lines)):
        text, _, level = lines[k]
        if LEGAL.match(text):
            break
        if lengths[k] and (level or SENTENCE.search(text)):
            last = k + 1
    return first, last, [lines[k][0] for k in range(first, last) if lengths[k]]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars`` (code points) and ``surge`` and ``dive``, the lines it lies between."""
    rows = pick(df, id=id_col, url=url_col, html=html_col)
    schema = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField(url_col, rows.schema["url"].dataType),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("surge", T.IntegerType()), T.StructField("dive", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_lines(page_lines(page or "")) for page in batch.column("html").to_pylist()]
            texts = [" ".join(lines) for *_, lines in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                 pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)
