"""Main text of web pages by two passes over text blocks.

A page becomes blocks (text between block-level tags), each with its length, its share of characters in links and its
share of stop words. The first pass calls long blocks with stop words and few links good, blocks of links bad, and the
rest ambiguous. The second pass gives each ambiguous block the label of its nearest decided neighbours. Elements
that cannot hold an article (menus, footers, forms, scripts, hidden ones) leave no blocks. A class, id, role or label that as a whole names a
part outside the article is evidence: blocks in such an element are bad in the first pass, unless the page would then have no
text at all. Character references are decoded, white space inside a block becomes one space, and good blocks are
joined in page order by a newline; nothing is dropped otherwise or capped. A form is left out unless it holds most of the page's text, as where
a page is written inside one; a head ends at its end tag or at the first thing that cannot be in it; where all text would be left out, only scripts and the like are.

Edge cases: null and empty pages give an empty text; unclosed tags, stray end tags and unclosed comments end where the
page ends; pages of any length and with any nesting are read once, in linear time (a tag's quoted value of more than 4,096
characters, and inline elements nested deeper than 64 around a paragraph, are not looked through); a page in a language without a
stop-word list is judged by length and links alone; a short block equally near two labels is bad outside of an article element
and good inside; repeated rows each get a row; a kept column named like a result is called ``<name>_kept``; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameline.llm.common import kept

# Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on with as be by at this from or an are not have but were they which their has had will would can all there been if more when who so no out up into than them its only some what about".split(),
    "de": "der die das und in zu den von mit ist auf für im dem nicht ein eine als auch es an er sie aus bei nach des sich war werden wird oder einer wie dass noch nur zum zur über so am hat aber um wir ich".split(),
    "fr": "de la le et les des en un une du que qui dans est pour sur par pas au il elle avec ne se ce plus sont ou son sa ses aux cette mais nous vous ont été leur comme tout on".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split(),
}
# Elements by their role in a page.
RAW = "script style textarea title xmp noembed noframes template".split()
NEVER = set("head nav footer aside button select option datalist iframe object svg math canvas map audio video dialog menu noscript script style template textarea title fieldset label input".split())
SCRIPTS = set("head script style template title noscript iframe object svg math canvas map audio video datalist select option textarea".split())  # of NEVER, what holds no text to read at all
OF_HEAD = set("title meta link base script style template noscript".split())  # anything else ends a head
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr label input br".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of a class, id or role that name a part outside the article.
OUTSIDE = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar sidebars side rail related recommended recommendations trending popular widget widgets share sharing social "
    "footer foot footnotes copyright header masthead topbar toolbar cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay paywall "
    "newsletter subscribe subscription signup login search comment comments commentlist disqus discussion replies reply respond responses onetrust cc "
    "complementary contentinfo search pagination pager hidden tags tagcloud skip".split()
)
# Parts of a class or id that say where or how large, not what.
NEUTRAL = set("site page main top bottom left right primary secondary global box bar block list item area section container wrapper wrap inner outer content widget module panel group row col links link text title heading form wide small large first last js window reader readers user users visitor visitors latest all the law info sdk".split())
# Parts of a header's class or id that say it is the article's own.
OWN_HEADER = set("entry post article story".split())
INSIDE = {"article", "main"}
DEEP = 64  # open inline elements looked through for an open paragraph

_ATTRS = r"(?:[^<>\"']++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b" + _ATTRS + r">.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>" + _ATTRS + r")>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/<>]*+)(?P<attrs2>[^<>]*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z][-a-zA-Z]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")
_WHITE = re.compile(r"\s+")
_STOPS = [frozenset(words) for words in STOP_WORDS.values()]


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    inside: bool
    outside: bool = False
    form: bool = False
    label: str = ""


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass. Shares are between 0 and 1, lengths are characters."""

    most_linked: float = 0.35
    short: int = 70
    long: int = 140
    stops: float = 0.06
    page_stops: float = 0.04


def names_outside(name: str) -> bool:
    """Whether a class or id as a whole names a part outside the article: ``sidebar-left``, but not ``with-sidebar``."""
    parts = [w.lower() for w in _PART.findall(name)]
    told = {w for w in parts if w in OUTSIDE}
    if told <= {"header"} and any(w in OWN_HEADER for w in parts):
        return False
    return bool(told) and all(w in OUTSIDE or w in NEUTRAL or w in OWN_HEADER for w in parts)


def read_attrs(attrs: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its names are evidence that it is outside the article."""
    hidden = outside = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _HIDING.search(value)):
            hidden = True
        elif name in ("class", "id", "role", "aria-label") and any(map(names_outside, value.split())):
            outside = True
    return hidden, outside


def own_header(attrs: str) -> bool:
    """Whether a header's class or id says that it is the article's own."""
    values = ["".join(v) for name, *v in _ATTR.findall(attrs) if name.lower() in ("class", "id")]
    return any(p.lower() in OWN_HEADER for v in values for p in _PART.findall(v))


def blocks_of(page: str, never: set[str] = NEVER) -> list[Block]:
    """The page's text blocks outside of elements that cannot hold an article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, whether they are left out, whether their names are evidence
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    state = {"linked": 0, "links": 0, "inside": 0, "heading": 0, "header": 0, "out": 0, "outside": 0, "form": 0}

    def flush() -> None:
        body = _WHITE.sub(" ", html.unescape("".join(text))).strip()
        if body and (not state["header"] or state["heading"]):
            out.append(Block(body, state["linked"], state["heading"] > 0, state["inside"] > 0, state["outside"] > 0, state["form"] > 0))
        text.clear()
        state["linked"] = 0

    def count(tag: str, by: int) -> None:
        open_tags[tag] += by
        if tag == "a":
            state["links"] += by
        elif tag in HEADINGS:
            state["heading"] += by
        elif tag in INSIDE:
            state["inside"] += by
        elif tag == "header":
            state["header"] += by
        elif tag == "form":
            state["form"] += by

    def close(tag: str) -> None:
        while open_tags[tag]:
            name, left_out, named = stack.pop()
            count(name, -1)
            state["out"] -= left_out
            state["outside"] -= named
            if name == tag:
                return

    def add(piece: str) -> None:
        if piece and open_tags["head"] and stack[-1][0] == "head" and not piece.isspace():
            close("head")
        if piece and not state["out"]:
            text.append(piece)
            if state["links"]:
                state["linked"] += len(_WHITE.sub(" ", html.unescape(piece)).strip())

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"] or m["end2"]:
            close(tag)
            continue
        if open_tags["head"] and tag not in OF_HEAD:
            close("head")
        if tag in VOID:
            continue
        if open_tags[tag] and (tag == "p" or tag == "li" or tag in HEADINGS):  # these close an open one of their kind
            for name, _, _ in islice(reversed(stack), DEEP):
                if name == tag:
                    close(tag)
                    break
                if name not in INLINE:
                    break
        attrs = m["attrs"] or m["attrs2"] or ""
        hidden, named = read_attrs(attrs) if attrs and tag not in ("body", "html") else (False, False)
        left_out = tag in never or (tag == "header" and not state["inside"] and never is NEVER and not own_header(attrs)) or hidden
        if attrs.endswith("/") and tag not in INLINE | {"p", "div"}:
            continue
        named = named and tag not in INSIDE
        stack.append((tag, left_out, named))
        count(tag, 1)
        state["out"] += left_out
        state["outside"] += named
    add(page[at:])
    flush()
    return out


def _stop_share(words: list[str], stops: frozenset[str]) -> float:
    return sum(w in stops for w in words) / len(words) if words else 0.0


def label_blocks(blocks: list[Block], rules: Rules = Rules()) -> None:
    """Sets each block's label to ``good`` or ``bad``."""
    words = [[w.lower() for w in _WORD.findall(b.text)] for b in blocks]
    every = [w for ws in words for w in ws]
    shares = [_stop_share(every, s) for s in _STOPS]
    stops = _STOPS[shares.index(max(shares))] if max(shares) >= rules.page_stops else None
    for b, ws in zip(blocks, words, strict=True):
        size, linked = len(b.text), b.linked / len(b.text)
        share = _stop_share(ws, stops) if stops else 1.0
        if b.outside or linked > rules.most_linked or (not b.inside and b.text.lower().removeprefix("copyright ").startswith("©")):
            b.label = "bad"
        elif size < rules.short:
            b.label = "bad" if linked and not b.inside else "short"
        elif share >= rules.stops:
            b.label = "good" if size >= rules.long or b.inside else "near"
        else:
            b.label = "near" if b.inside else "short"
    decided = [k for k, b in enumerate(blocks) if b.label in ("good", "bad")]
    contained = any(b.inside for b in blocks)
    first = [b.label for b in blocks]
    before, place = -1, 0
    for k, b in enumerate(blocks):
        while place < len(decided) and decided[place] < k:
            before, place = decided[place], place + 1
        if first[k] in ("good", "bad"):
            continue
        after = decided[place] if place < len(decided) else -1
        left, right = first[before] if before >= 0 else None, first[after] if after >= 0 else None
        default = "good" if b.inside or (not contained and first[k] == "near") else "bad"
        if left is None and right is None:
            b.label = "good" if b.inside or not contained else "bad"
        elif b.heading and right is not None:
            b.label = right
        elif left is None or right is None or left == right:
            b.label = right if left is None else left
        elif k - before == after - k or first[k] == "near":
            b.label = default if first[k] != "near" else "good"
        else:
            b.label = left if k - before < after - k else right
        if b.inside and b.label == "bad" and not b.linked and not b.outside:
            b.label = "good"
        elif contained and not b.inside and first[k] == "short":
            b.label = "bad"


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "") or blocks_of(page or "", SCRIPTS)  # a page that is all menu or footer is what it says
    in_forms = sum(len(b.text) for b in blocks if b.form)
    if 2 * in_forms <= sum(len(b.text) for b in blocks):  # else the form is around the page
        blocks = [b for b in blocks if not b.form]
    label_blocks(blocks)
    if any(b.outside for b in blocks) and not any(b.label == "good" for b in blocks):
        for b in blocks:  # names that would leave nothing say nothing
            b.outside = False
        label_blocks(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_main_text(pages: DataFrame, html_column: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) for each page; a map without a shuffle."""
    chosen = pages.select(*kept(keep, ["text", "n_chars", "__html"]), F.col(f"`{html_column}`").alias("__html"))
    keep = chosen.columns[:-1]
    schema = T.StructType([*(chosen.schema[k] for k in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("__html")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"]
            )

    return chosen.mapInArrow(run, schema)
