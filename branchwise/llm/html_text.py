"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags (and at two line breaks in a row). Pass one labels each
block by itself: blocks of menus, headers, footers, asides, forms and the like (by tag, role, or a
word of class or id), blocks that are mostly links, and copyright lines are boilerplate; long blocks dense in
stop words are text. Everything else, short blocks and long ones poor in stop words (of another language, or rich in names), is
ambiguous. Outside articles pass two first settles the long ones, by the nearest block that is decided without boilerplate markup
(text where they differ or there is none); markup says nothing about the blocks beside it. Then it gives an ambiguous block the label of its nearest decided neighbours,
within the same ``article`` or ``main`` if it is in one that has text. Where two neighbours at the same distance differ,
the block is text if it holds a stop word. A block in a container without any decided block
is text. If a page has more text inside ``article`` or ``main`` than outside, what stands outside is boilerplate.

A class or id marks boilerplate if its name has no other words than marking ones and words of place (``share-bar``, not ``social-history``);
words that may name a subject as well (``related``) don't outweigh a long block dense in stop words.

Kept blocks are joined in page order by two line feeds; their white space is one space each, character
references are decoded. Nothing else is dropped or cut.

Defined results: null, empty and text-free html give an empty text with 0 characters; plain text
without tags is one block. Broken markup is read as ``html.parser`` reads it, an unclosed script or
comment hides the rest. Repeated rows and null ids pass through; result columns replace input columns of
the same name.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import table

LONG = 70
MAX_LINKS = 0.33
MIN_STOPS = 0.2

#: Frequent function words of five languages.
STOP_WORDS = frozenset((
    "the of and to in is that it for was on with as be by are at this from or an not have has you"
    " der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an bei"
    " de la le les et des en du un une est que pour dans qui sur au par pas plus avec ce il"
    " el los las y del se por con para una su al lo como más pero sus o este"
    " il di che e non per una del della sono con si da i").split())
#: Tags.
BLOCK_TAGS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead title tr ul").split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text, whatever is inside.
SILENT_TAGS = frozenset("script style noscript template head title svg math iframe object select button textarea canvas audio video".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav form menu".split())
STRONG_TAGS = frozenset("footer aside dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that mark boilerplate; the first ones also when they stand on an article.
COMMENT_WORDS = frozenset((
    "comment comments reply replies respond disqus ad ads advert adverts advertisement advertising sponsor sponsored promo"
    " promotion related recommended recommendations teaser widget").split())
#: Words that may as well name a subject: a long block dense in stop words is text for all they say.
WEAK_WORDS = frozenset("related form legal social search hidden alert disclaimer".split())
#: Words that say where or how in a compound class; a name of other words besides is a subject's (legal-news, form-factor).
PLACE_WORDS = frozenset((
    "bar box list wrap wrapper container inner outer section block area item items main primary secondary top bottom left right site page global"
    " mobile desktop js is has link links button buttons icon icons panel row col column group header body thread form text title module"
    " overlay post posts article articles content contents").split())
BOILER_WORDS = COMMENT_WORDS | frozenset((
    "nav navbar navigation menu sidebar aside footer banner cookie cookies consent gdpr notice notices popup"
    " modal overlay newsletter subscribe subscription social share sharing breadcrumb breadcrumbs pagination pager toolbar"
    " login signup copyright legal disclaimer form search alert hidden").split())

HEADER_WORDS = frozenset(("header", "masthead"))
#: How sure boilerplate is: a header's headings are an article's own; an article inside PLAIN markup is still one.
WEAK, HEADER, PLAIN, STRONG = 0.5, 1, 2, 3

_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marks_of(names: str) -> tuple[frozenset[str], bool]:
    """The marking words of class and id names, and whether weak ones are all there is.

    A name counts if it has nothing but marking words and words of place.
    """
    out: set[str] = set()
    for name in names.split():
        words = {m.lower() for m in _MARK.findall(name)}
        found = words & (BOILER_WORDS | HEADER_WORDS)
        if words - found <= PLACE_WORDS:
            out |= found
    return frozenset(out), bool(out) and out <= WEAK_WORDS


class Blocks(HTMLParser):
    """Collects (text, link characters, number of its article or main, boilerplate) per block.

    Open tags are a stack; where each name and each block tag was opened last is known, so no tag looks through the stack.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int, bool] | None] = []  # tag, silent, boilerplate, container, link; None: ended late
        self.open: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.links = 0
        self.blocks: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.in_links = self.breaks = self.containers = 0

    def state(self) -> tuple[bool, int, int]:
        return self.stack[-1][1:4] if self.stack else (False, 0, 0)

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, boiler, container = self.state()
            self.blocks.append((text, min(self.in_links, len(text)), container, boiler))
        self.parts, self.in_links, self.breaks = [], 0, 0

    def push(self, entry: tuple) -> None:
        self.open.setdefault(entry[0], []).append(len(self.stack))
        if entry[0] in BLOCK_TAGS:
            self.open_blocks.append(len(self.stack))
        self.links += entry[4]
        self.stack.append(entry)

    def forget(self, k: int) -> None:
        tag, link = self.stack[k][0], self.stack[k][4]
        self.open[tag].pop()
        if tag in BLOCK_TAGS:
            self.open_blocks.pop()
        self.links -= link

    def cut(self, k: int) -> None:
        """Ends the k-th open tag and all within."""
        while len(self.stack) > k:
            if self.stack[-1]:
                self.forget(len(self.stack) - 1)
            self.stack.pop()
        while self.stack and not self.stack[-1]:
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks > 1:
                self.end_block()
            return
        if tag in BLOCK_TAGS:
            self.end_block()
        if tag in VOID_TAGS:
            return
        if tag in ("p", "li", "a") and self.open.get(tag):  # these end by themselves
            if not self.open_blocks or self.open[tag][-1] >= self.open_blocks[-1]:
                self.cut(self.open[tag][-1])
        silent, boiler, container = self.state()
        given = {k: v or "" for k, v in attrs}
        marks, weak = marks_of(given.get("class", "") + " " + given.get("id", ""))
        silent = silent or tag in SILENT_TAGS
        if tag in ("article", "main"):
            boiler = STRONG if boiler == STRONG or marks & COMMENT_WORDS else 0
            if not container and not boiler:
                self.containers += 1
                container = self.containers
        elif tag not in ("html", "body"):
            if tag in STRONG_TAGS or marks & COMMENT_WORDS and not weak:
                boiler = STRONG
            elif (tag in BOILER_TAGS or given.get("role", "").lower() in BOILER_ROLES or marks & BOILER_WORDS and not weak
                    or "hidden" in given or given.get("aria-hidden") == "true"
                    or "display:none" in given.get("style", "").replace(" ", "").lower()):
                boiler = max(boiler, PLAIN)
            elif tag == "header" or marks & HEADER_WORDS:
                boiler = max(boiler, HEADER)
            elif weak:
                boiler = max(boiler, WEAK)
            if tag in HEADING_TAGS and container and boiler == HEADER:
                boiler = 0
        self.push((tag, silent, boiler, container, tag == "a" and "href" in given))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.end_block()
        if self.open.get(tag):
            k = self.open[tag][-1]
            if tag not in BLOCK_TAGS and self.open_blocks and self.open_blocks[-1] > k:
                self.forget(k)  # an inline tag that ends late ends no block
                self.stack[k] = None
            else:
                self.cut(k)

    def handle_data(self, data):
        if self.state()[0]:
            return
        if self.breaks and not data.isspace():
            self.breaks = 0
        self.parts.append(data)
        if self.links:
            self.in_links += len(" ".join(data.split()))


def first_pass(blocks: list[tuple[str, int, int, float]]) -> list[bool | None]:
    """True: text; False: boilerplate; None: ambiguous."""
    out: list[bool | None] = []
    for text, in_links, container, boiler in blocks:
        words = _WORD.findall(text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        dense = len(text) >= LONG and stops >= MIN_STOPS
        if boiler and not (boiler == WEAK and dense) or in_links > MAX_LINKS * len(text) or text.startswith("©"):
            out.append(False)
        elif len(text) < LONG:
            out.append(None)
        else:
            out.append(True if stops >= MIN_STOPS else None)
    return out


def second_pass(blocks: list[tuple[str, int, int, float]], labels: list[bool | None]) -> list[bool]:
    def nearest(places: list[int]) -> dict[int, tuple[float, bool | None]]:
        """Distance and label of the last decided block before each place."""
        at, label, found = 0, None, {}
        for n, k in enumerate(places):
            if labels[k] is not None:
                at, label = n, labels[k]
            found[k] = (n - at if label is not None else float("inf"), label)
        return found

    has_text = {b[2] for b, x in zip(blocks, labels, strict=True) if x}
    plain = [k for k, b in enumerate(blocks) if not b[2] and not b[3]]
    before, after = nearest(plain), nearest(plain[::-1])
    labels = list(labels)
    for k in plain:
        if labels[k] is None and len(blocks[k][0]) >= LONG:
            (d1, x1), (d2, x2) = before[k], after[k]
            labels[k] = x1 is not False or x2 is not False if d1 == d2 else x1 if d1 < d2 else x2
    out = list(labels)
    groups: dict[int, list[int]] = {}
    for k, b in enumerate(blocks):
        if not (b[2] and b[3]):  # what an article holds of boilerplate says nothing about the blocks around it
            groups.setdefault(b[2], []).append(k)
    for container, places in groups.items():
        if container and container not in has_text:  # nothing decided but what is boilerplate
            for k in places:
                out[k] = labels[k] is not False
            continue
        scope = places if container else range(len(blocks))
        before, after = nearest(list(scope)), nearest(list(scope)[::-1])
        for k in places:
            if labels[k] is None:
                (d1, x1), (d2, x2) = before[k], after[k]
                if x1 is None and x2 is None:
                    out[k] = True
                elif d1 != d2:
                    out[k] = x1 if d1 < d2 else x2
                else:
                    out[k] = x1 if x1 == x2 else any(w in STOP_WORDS for w in _WORD.findall(blocks[k][0].lower()))
    inside, outside = (sum(len(b[0]) for b, x in zip(blocks, out, strict=True) if x and bool(b[2]) == within) for within in (True, False))
    if inside and inside >= outside:
        out = [bool(x and b[2]) for x, b in zip(out, blocks, strict=True)]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.close()
    page.end_block()
    keep = second_pass(page.blocks, first_pass(page.blocks))
    return "\n\n".join(b[0] for b, x in zip(page.blocks, keep, strict=True) if x)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of ``df`` with text and n_chars."""
    def run(pages):
        import pandas as pd

        return pd.Series([main_text(p) for p in pages], dtype="object")

    keep = [F.col(f"`{c}`") for c in df.columns if c not in (html, "text", "n_chars")]
    out = df.select(*keep, F.pandas_udf(run, "string")(F.col(f"`{html}`").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
