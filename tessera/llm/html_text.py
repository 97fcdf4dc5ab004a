"""Main text of web pages by two passes over blocks.

The page is cut into blocks at block-level tags. Pass 1 decides by stop-word density, length and link density; what stands in
navigation, forms, notices, comments and the like is out. Pass 2 gives each short, undecided block the label of its nearest decided
neighbours. An article tag is only a prior: inside it less density will do and the doubt goes towards keeping, beside it the doubt goes
towards leaving out. It is the other way round on a page with more dense text outside its articles than text inside them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hold_batches

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be at by this from or an not have but they which you were "
    "der die das und ist nicht ein eine zu den von mit sich des auf für im dem als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et un une du en que qui dans pour pas sur est au plus par avec ce il sont ne se elle ou "
    "el los las y del una al por con no su para es lo como más pero sus este ya entre cuando muy sin sobre".split()
)
#: Words of class and id attributes that mark what is no article.
OUT_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus dropdown footer footnav gdpr menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promoted promotion related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget widgets login search alert discussion rail aside".split()
)
#: Words that mark the head of a page, but within an article its own.
HEAD_NAMES = frozenset("header masthead teaser".split())
OUT_TAGS = frozenset("nav aside footer form button select menu dialog iframe fieldset object".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.30, 0.32
ARTICLE_LOW, ARTICLE_HIGH = 0.05, 0.20
MOST_LINKS = 0.33

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|textarea|template|svg|math|title|xmp|noembed|noframes|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?:[!?]|/?[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    article: bool
    out: bool
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: str = ""


def _is_out(tag: str, attrs: str, article: bool) -> bool:
    if tag in OUT_TAGS or (tag == "header" and not article):
        return True
    if not attrs.strip() or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and tag not in ("article", "main"):
            words = _NAME.findall(value)
            if not OUT_NAMES.isdisjoint(words) or not article and not HEAD_NAMES.isdisjoint(words):
                return True
        if name == "role" and value in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. Each tag is looked at once, however deep it stands."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, is an article, is out
    opened: Counter[str] = Counter()
    articles = outs = links = at = 0
    block = Block(False, False)

    def close() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                found.append(block)
        block = Block(articles > 0, outs > 0)

    def add(raw: str) -> None:
        if raw:
            block.parts.append(raw)
            if links:
                block.link_chars += len(raw.strip())

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                block.parts.append(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if m["end"] else links + 1
        elif tag == "br":
            block.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if m["end"]:
            while opened[tag]:  # what stands open above the tag closes with it
                name, article, out = stack.pop()
                opened[name] -= 1
                articles -= article
                outs -= out
                if name == tag:
                    break
            if tag in BLOCK_TAGS or not block.parts:
                links = 0 if tag in BLOCK_TAGS else links
                close()
            continue
        article = tag in ("article", "main") or 'role="main"' in m["attrs"] or "articlebody" in m["attrs"].lower()
        out = _is_out(tag, m["attrs"], articles > 0)
        if tag in BLOCK_TAGS or out:
            if (tag not in ("p", "li") or out) and not m["attrs"].endswith("/"):
                stack.append((tag, article, out))
                opened[tag] += 1
                articles += article
                outs += out
            close()
    add(page[at:])
    close()
    return found


def classified(page: str) -> list[Block]:
    """Blocks with label `good` or `bad`."""
    found = blocks(page)
    stops, links = [], []
    for b in found:
        words = _WORD.findall(b.text.lower())
        stops.append(sum(w in STOP_WORDS for w in words) / max(len(words), 1))
        links.append(b.link_chars / max(len(b.text), 1))
    texts = [(b, len(b.text), s) for b, s, k in zip(found, stops, links, strict=True) if not b.out and k <= MOST_LINKS]
    inside = sum(n for b, n, _ in texts if b.article)
    prior = inside > 0 and inside >= sum(n for b, n, s in texts if not b.article and n > LONG and s >= STOPS_HIGH)
    # in a language without stop words here, density can't tell the blocks of an article apart
    known = sum(n for _, n, s in texts if n >= SHORT and s >= ARTICLE_HIGH) > LONG
    beside = [b.article != prior for b in found]
    for b, density, linked in zip(found, stops, links, strict=True):
        b.article = b.article and prior
        if b.out:
            b.label = "bad"
        elif linked > MOST_LINKS:
            b.label = "bad" if linked > 0.8 or not b.article else "short"
        elif len(b.text) < SHORT:
            b.label = "short" if b.article or not b.link_chars else "bad"
        elif b.article:
            if density >= ARTICLE_HIGH or not known:
                b.label = "good"
            else:
                b.label = "near" if density >= ARTICLE_LOW or len(b.text) <= LONG else "bad"
        elif density >= STOPS_HIGH:
            b.label = "good" if len(b.text) > LONG else "near"
        elif density >= STOPS_LOW:
            b.label = "near"
        else:
            b.label = "bad"
    decided = [b.label if b.label in ("good", "bad") else "" for b in found]
    before, after, last = [""] * len(found), [""] * len(found), ""
    for i, v in enumerate(decided):
        before[i], last = last, v or last
    last = ""
    for i in range(len(found) - 1, -1, -1):
        after[i], last = last, decided[i] or last
    for i, b in enumerate(found):
        if b.label in ("short", "near"):
            sides = (before[i] or "bad", after[i] or "bad")
            if b.article:
                good = "good" in sides or "good" not in decided
            elif b.label == "near" and not beside[i]:
                good = "good" in sides or "good" not in decided
            else:
                good = sides == ("good", "good")
            b.label = "good" if good else "bad"
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classified(page or "") if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages. Null and empty pages, and pages without a good block, give an empty text.
    Repeated rows each get a row; only the three named columns are read; an empty table gives an empty result."""
    hold_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
