"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, left to right and in linear time, into flat blocks (text between block-level
tags).  A block has its word count and link density, those of the blocks before and behind it, whether
it stands in the page's article region, how strongly tags or class names say that it is furniture, and
whether it is a heading.  A small decision tree (Gini splits, trained at first use on blocks measured
from the labelled pages below) tells content from the rest.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared

# Tags and words of the format.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre search section select summary table "
    "tbody td textarea tfoot th thead tr ul video audio canvas".split()
)
SPACE_TAGS = frozenset("br img input".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu button select textarea dialog fieldset search iframe object video audio canvas legend optgroup option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGION_TAGS = frozenset("article main".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note tablist".split())
#: Words that make a class name or id one of furniture if all its other words are NEUTRAL ones.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs topbar toolbar masthead header footer sidebar aside rail banner "
    "promo promos promotion cookie cookies consent gdpr notice notices alert alerts disclaimer popup popover modal overlay toast "
    "newsletter subscribe subscription signup login signin register search form reply replies respond responses discussion related recommended "
    "recommendations suggestions trending popular share sharing social widget widgets pagination pager copyright legal colophon tags taglist skip paywall".split()
)
NEUTRAL_WORDS = frozenset("site global top bottom left right primary secondary main sub box block bar list links link items item posts articles stories buttons icons area region section module panel wrap strip slot inner outer col column message text title privacy policy user reader".split())
#: Words that tell adverts and reader comments wherever they stand in a name.
STRONG_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot adsense adsbygoogle sponsor sponsored sponsors promoted comment comments commentlist disqus".split())
#: Names with one of these speak of a page's layout and not of this element.
LAYOUT_WORDS = frozenset("no with has without wrapper layout page container".split())
REGION_NAMES = frozenset("content main article post story entry maincontent articlebody postbody entrycontent postcontent articlecontent storybody".split())
RAW_TAGS = frozenset("script style noscript template svg title noframes noembed xmp".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The attributes of a well-formed tag, up to its end; any other tag is read by attributes().
PLAIN = re.compile(r"""(?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?+)*+\s*+/?+>""")
KEY = re.compile(r"[\s/]*+([^\s/>=]++|=)?+\s*+")
BARE = re.compile(r"[^\s>]*+")
BLANK = re.compile(r"\s*+")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?+", re.I) for t in RAW_TAGS}
COMMENT_END = re.compile(r"--!?>")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")

# The labelled pages.  {+n} stands for n words of content, {-n} for n words of something else.
LABELLED = (
    "<header><a href=x>{-2}</a><form><label>{-2}</label></form></header><nav><ul><li><a href=x>{-1}</a><li><a href=x>{-2}</a><li><a href=x>{-1}</a></ul></nav><div class=ad>{-9}</div>"
    "<article><h1>{+7}</h1><p>{+60}<p>{+1}<p>{+120}<div class=ad>{-40}</div><p>{+3}<h2>{+2}</h2><p>{+9}<p>{+30}</article><div class=sidebar>{-25}</div><footer>{-8}</footer>",
    "<nav><a href=x>{-1}</a> <a href=x>{-1}</a></nav><main><h1><a href=x>{+6}</a></h1><p>{+12} <a href=x>{+9}</a><p><a href=x>{+12}</a><p>{+45} <a href=x>{+9}</a><ul><li>{+1}<li>{+4}<li><a href=x>{+3}</a> {+8}</ul>"
    "<p>{+2}<p><a href=x>{+2}</a><p>{+70}<ul><li><a href=x>{-2}</a><li><a href=x>{-4}</a><li><a href=x>{-3}</a><li><a href=x>{-1}</a></ul></main><div>{-30}</div><p>{-90}<h3>{-4}</h3><ul><li><a href=x>{-2}</a></ul><footer>{-20}</footer>",
    "<article><header><h1>{+3}</h1><p>{+4}</header><section><h2>{+1}</h2><p>{+25}</section><p class=notice>{-6}<p class=notice>{+60}<p>{+18}<div class=newsletter><h3>{-3}</h3><p>{-9}</div><aside>{-50}</aside><p>{+200}<div class=share><a href=x>{-1}</a> <a href=x>{-1}</a></div>"
    "<section id=comments><h2>{-1}</h2><p>{-35}<p>{-80}<p>{-2}</section></article><div class=related><h3>{-2}</h3><a href=x>{-8}</a></div>",
    "<article><p><a href=x>{+40}</a><p>{+5}<p><a href=x>{+20}</a><p>{+33}<nav><a href=x>{-2}</a></nav><p>{+80}<form>{-6}</form><p>{+1}<ol><li><a href=x>{+14}</a><li><a href=x>{+11}</a><li><a href=x>{+16}</a></ol></article><p>{-3}<p>{-1}<h4>{-5}</h4><p><a href=x>{-2}</a>",
    "<div class=main-nav><a href=x>{-1}</a> <a href=x>{-2}</a></div><h1>{+8}</h1><p>{+14}<p>{+60}<p>{+3}<p>{+90}<h2>{+3}</h2><p>{+45}<p>{+6}<p>{+60}<div class=cookie-notice>{-30}</div><div><a href=x>{-1}</a> <a href=x>{-2}</a></div><div><a href=x>{-3}</a></div><div class=footer>{-9}</div>",
    "<div><a href=x>{-2}</a></div><div><a href=x>{-1}</a></div><h2>{+5}</h2><p>{+40} <a href=x>{+3}</a><p>{+8}<p>{+25} <a href=x>{+9}</a><p>{+12} <a href=x>{+3}</a><p>{+35}<h3>{-2}</h3><div><a href=x>{-4}</a></div><div>{-4}</div><div><a href=x>{-3}</a></div><div>{-5}</div><div><a href=x>{-2}</a></div>",
    "<div class=header><h1>{-3}</h1>{-6}</div><p>{+30}<p>{+5}<p>{+100}<p>{+30} <a href=x>{+25}</a><div class=comments><h3>{-2}</h3><p>{-60}</div><div><a href=x>{-9}</a></div><div><a href=x>{-30}</a></div>",
    "<p>{+6}", "<h1>{+4}</h1><p>{+20}", "<div>{+50}</div>", "<div><a href=x>{-1}</a></div><div><a href=x>{-2}</a></div>",
    # In an article one linked line belongs to the text around it; of several in a row those of one or two words, and what stands among them, are a menu, longer ones are its sources or steps.
    # Elsewhere neither belongs to it, and short lines go with their neighbours.
    "<main>" + "".join(f"<p>{{+{40 - 4 * k}}}<p><a href=x>{{+{k}}}</a>" for k in range(1, 10)) + "<p>{+50}</main>",
    "<main>" + "".join("<p>{+%d}<ul>%s</ul>" % (44 - 4 * k, f"<li><a href=x>{{{'-' if k < 3 else '+'}{k}}}</a>" * 3) for k in range(1, 9)) + "<p>{+5}</main>",
    "<main>" + "".join(f"<p>{{+{30 + k}}}<ul><li><a href=x>{{-1}}</a><li><a href=x>{{-{k}}}</a><li><a href=x>{{-2}}</a></ul><p>{{+{12 + k}}}<p>{{+2}}<p><a href=x>{{+{k}}}</a><p>{{+1}}" for k in range(3, 12)) + "</main>",
    "<main>" + "".join(f"<p>{{+{k}}}<p>{{+{9 * k}}}" for k in range(1, 9)) + "</main>" + "".join(f"<p>{{-{k * k}}}" for k in range(1, 10)),
    "<main>" + "".join(f"<p>{{+30}}<p class=notice>{{-{k}}}<p>{{+8}}<p class=alert>{{+{30 + k}}}<p><a class=x>{{+3}}</a>" for k in (1, 4, 9, 16, 19)) + "</main>",
    "<main>" + "".join(f"<p>{{+{60 - 4 * k}}}<p class=notice>{{+{33 + k}}}<p>{{+{50 + k}}}<div class=related><a href=x>{{-{k}}}</a></div><p>{{+9}}<div class=ad><a href=x>{{-{3 * k}}}</a></div><div class=ad>{{-{9 * k}}}</div>" for k in range(1, 12)) + "</main>",
    "".join(f"<p>{{+{60 - 4 * k}}}<div class=cookie-notice>{{-{33 + k}}}</div><p>{{+{50 + k}}}<div class=menu>{{-{k}}}</div><p>{{+28}}<div class=ad>{{-{9 * k}}}</div>" for k in range(1, 9)),
    "".join(f"<p>{{+{30 + 5 * k}}}<p><a href=x>{{-{k}}}</a><p>{{+{22 + k}}}<p>{{+{k}}}" for k in range(1, 10)) + "<p>{+28}",
    "<p>{+30}" + "".join(f"<h3>{{-{1 + k % 3}}}</h3><p><a href=x>{{-{k}}}</a><p>{{-{1 + k // 2}}}<p><a href=x>{{-{9 - k}}}</a>" for k in range(1, 9)),
    "".join(f"<h2>{{+{1 + k}}}</h2><p>{{+{25 + 6 * k}}}<p>{{+{2 + k}}}<p>{{+{20 + 4 * k}}} <a href=x>{{+{k}}}</a>" for k in range(1, 9)),
)
#: How the prose of the labelled pages (texts of 20 words and more) is stretched.
STRETCHED = (1, 2, 5)


@functools.lru_cache(maxsize=1)
def labelled() -> np.ndarray:
    """Features of all blocks of the labelled pages, the label last."""
    rows = []
    for page, times in itertools.product(LABELLED, STRETCHED):
        filled = re.sub(r"\{([+-])(\d+)\}", lambda m: " ".join([m[1] + "word"] * int(m[2]) * (times if int(m[2]) >= 20 else 1)), page)
        found = blocks(filled)
        rows += [[*f, float(b[0].startswith("+"))] for f, b in zip(features(found), found, strict=True)]
    return np.array(rows)


def grow(x: np.ndarray, y: np.ndarray) -> tuple:
    """A tree of (feature, threshold, left if <=, right) and leaves (share of ones,): Gini, grown until pure."""
    if len(set(y.tolist())) < 2:
        return (float(y.mean()),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            p, q = y[left].mean(), y[~left].mean()
            cost = left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), left)
    if best is None:
        return (float(y.mean()),)
    _, f, t, left = best
    return (f, t, grow(x[left], y[left]), grow(x[~left], y[~left]))


@functools.lru_cache(maxsize=1)
def tree() -> tuple:
    rows = labelled()
    return grow(rows[:, :-1], rows[:, -1])


def is_content(of: tuple) -> bool:
    node = tree()
    while len(node) == 4:
        node = node[2] if of[node[0]] <= node[1] else node[3]
    return node[0] >= 0.5


def attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Names and values from `at`, behind a tag's name, and the place behind the tag.

    A quoted value ends at its quote; where there is none, or one in the midst of later text, it ends at the next `>`."""
    found, n = [], len(page)
    while at < n:
        m = KEY.match(page, at)
        at, name = m.end(), m[1]
        if name is None:
            break
        if name != "=" and page[at : at + 1] == "=":
            at = BLANK.match(page, at + 1).end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end >= 0 and (page[end + 1 : end + 2] in ("", " ", "\t", "\n", "\r", "\f", "/", ">") or page.find(">", at, end) < 0):
                    found.append((name.lower(), page[at + 1 : end]))
                    at = end + 1
                    continue
                end = page.find(">", at)
                end = n if end < 0 else end
                found.append((name.lower(), page[at + 1 : end]))
                at = end
                break
            m = BARE.match(page, at)
            found.append((name.lower(), m[0]))
            at = m.end()
        else:
            found.append((name.lower(), ""))
    return found, min(n, at + 1)


@functools.lru_cache(maxsize=4096)
def hints(attrs: str) -> tuple[int, bool, bool, bool]:
    """Of a start tag's attributes: how strongly names say furniture (2 adverts and comments), names a region, role or hiding says furniture, has a target."""
    sign, region, told, target = 0, False, False, False
    for name, raw in attributes(attrs, 0)[0]:
        value = html.unescape(raw)
        if name in ("class", "id"):
            for token in value.split():
                parts = {w.lower() for w in WORDS.findall(token)}
                if parts & LAYOUT_WORDS:
                    continue
                joined = "".join(c for c in token.lower() if c.isalnum())
                if parts & STRONG_WORDS or joined in STRONG_WORDS:
                    sign = 2
                elif joined in FURNITURE_WORDS or parts & FURNITURE_WORDS and parts <= FURNITURE_WORDS | NEUTRAL_WORDS:
                    sign = max(sign, 1)
                region |= joined in REGION_NAMES
        elif name == "role":
            told |= value.strip().lower() in FURNITURE_ROLES
        elif name == "hidden":
            told = True
        elif name == "aria-hidden":
            told |= value.strip().lower() == "true"
        elif name == "style":
            told |= bool(re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value, re.I))
        elif name == "href":
            target = True
    return sign, region, told, target


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """Texts ("", text, False), start tags (name, attributes, False) and end tags (name, "", True), in order.

    Comments, declarations and elements whose text is none of the page's are passed over; one that
    is never closed reaches to the end.  Every character is looked at a bounded number of times."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        while 0 <= lt and not (page[lt + 1 : lt + 2].isalpha() and page[lt + 1] < "\x7f" or page[lt + 1 : lt + 2] in ("!", "?") and lt + 1 < n or page[lt + 1 : lt + 2] == "/" and page[lt + 2 : lt + 3].isalpha() and page[lt + 2] < "\x7f"):
            lt = page.find("<", lt + 1)
        if lt < 0:
            yield "", page[at:], False
            return
        if lt > at:
            yield "", page[at:lt], False
        kind = page[lt + 1]
        if kind in "!?":
            if page.startswith("<!--", lt):
                # `<!-->` and `<!--->` are comments of their own.
                m = re.compile(r"-?>").match(page, lt + 4) or COMMENT_END.search(page, lt + 4)
                at = m.end() if m else n
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
        elif kind == "/":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            yield NAME.match(page, lt + 2)[0].lower(), "", True
        else:
            m = NAME.match(page, lt + 1)
            name, start = m[0].lower(), m.end()
            plain = PLAIN.match(page, start)
            at = plain.end() if plain else attributes(page, start)[1]
            if name in RAW_TAGS:
                m = ENDS[name].search(page, at)
                at = m.end() if m else n
            else:
                yield name, page[start:at], False


def blocks(page: str) -> list[tuple[str, int, int, int, int, bool]]:
    """Flat blocks in page order: text, words, words in links, region (1 in the article, 0 none on the page, -1 outside), sign of furniture (0, 1, 2), heading."""
    out: list = []
    parts: list[tuple[str, bool]] = []  # of the open block: text, and whether it is in a link
    stack: list[tuple] = []  # open block-level elements, each with the state before it
    # inner: furniture since the article region began, for pages whose furniture around it is never closed.
    region = weak = heading = link = False
    sign = inner = 0
    opened: dict[str, int] = {}

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                linked = sum(len(p.split()) for p, inside in parts if inside)
                out.append((text, len(text.split()), linked, region, weak, sign, heading, inner))
            parts.clear()

    def leave() -> str:
        nonlocal region, weak, sign, heading, inner
        name, region, weak, sign, heading, inner = stack.pop()
        opened[name] -= 1
        return name

    for tag, raw, ends in tokens(page):
        if not tag:
            parts.append((html.unescape(raw) if "&" in raw else raw, link))
        elif ends:
            if tag == "a":
                link = False
            elif tag in BLOCK_TAGS:
                close()
                if opened.get(tag):
                    while leave() != tag:
                        pass
        elif tag in BLOCK_TAGS:
            close()
            link = link and tag not in ("p", "li", "td", "tr", "ul", "ol", "table", "article", "section")
            if tag in ("hr", "html"):
                continue
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option") or stack[-1][0] in HEADINGS and tag in HEADINGS):
                leave()
            stack.append((tag, region, weak, sign, heading, inner))
            opened[tag] = opened.get(tag, 0) + 1
            named, content, told, _ = hints(raw) if "=" in raw or "hidden" in raw.lower() else (0, False, False, False)
            if tag != "body":
                own_region = tag in REGION_TAGS
                own = 2 if tag in FURNITURE_TAGS or told or tag == "header" and not region else 0 if own_region and named < 2 else named
                inner = 0 if own_region and not region else max(inner, own)
                sign = max(sign, own)
                region |= own_region
                weak |= content and not named
            heading = tag in HEADINGS
        elif tag == "a":
            link = hints(raw)[3]
        elif tag in SPACE_TAGS:
            parts.append((" ", link))
    close()
    strong = any(b[3] for b in out)
    some = strong or any(b[4] for b in out)
    lost = strong and all(s == 2 for _, _, _, r, _, s, _, _ in out if r)
    return [(t, w, n, (1 if (r if strong else k) else -1) if some else 0, i if lost and r else s, h) for t, w, n, r, k, s, h, i in out]


def features(found: list[tuple]) -> list[tuple]:
    """Of each block: region, sign, heading, words and link density, and the latter two of the blocks before and behind it."""
    near = [(0, 0.0), *((w, min(1.0, n / w)) for _, w, n, *_ in found), (0, 0.0)]
    return [(region, sign, heading, *near[i + 1], *near[i], *near[i + 2]) for i, (_, _, _, region, sign, heading) in enumerate(found)]


def main_text(page: str | None) -> str:
    """The content blocks, one a line; empty for a null or empty page, or one without content."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, f in zip(found, features(found), strict=True) if is_content(f))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text) for each row of pages.

    A null or empty page has the empty text; pages of any length and any broken markup are read whole, in linear time.  White space in a block becomes one space, blocks are
    joined by one line feed.  Repeated rows give repeated rows; other columns are ignored."""
    shared.tune(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("c0"), *(F.col(c).alias(f"c{i + 1}") for i, c in enumerate(keep)), F.col(html_col).cast("string").alias("page"))
    last = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(texts, pa.string())], [*b.schema.names[:last], "text"])

    from pyspark.sql.types import StringType, StructType

    out = rows.mapInArrow(run, StructType(rows.schema.fields[:last]).add("text", StringType()))
    return out.toDF(id_col, *keep, "text")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the main text of every page."""
    out = extract(shared.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
