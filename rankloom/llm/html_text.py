"""Main text of web pages by two passes of block rules.

Pass one cuts a page into blocks and classifies each by link density, length and
stop-word density: good, bad, or undecided when it is short or sparse in stop
words. Containers that hold no article text by what they are (menus, forms, footers ...)
or by one of their class names as a whole (``ad``, ``comments`` ...) make their blocks bad
at once; a class name that only has such a word in it does not. An article inside of a form or a
container that is bad by its class name (reader comments apart) is taken if the page has no other
and no longer text; a form's own blocks where the page has nothing else. Pass two gives every
undecided block the label of its nearest decided neighbours in the same region
(the article or main element, else the page); between unlike neighbours the nearer
one counts. Where an article or main element has good blocks, blocks outside of it are bad.

An article element is evidence of its own: inside it shorter and sparser blocks count as
good, ties between unlike neighbours go to good, and where nothing is decided, undecided
blocks are good.

Defined cases: null and empty pages, and pages without main text, give the empty
text; unclosed tags end with their container, unclosed comments and raw text (scripts,
styles, titles, text areas, iframes) with the page; ids and urls may be null or repeat,
each row is a page of its own; a page is read in one pass, in time linear in its length, whatever its depth and however broken its tags.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of the four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you
    als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht oder sich sie sind um und von vor war was wie wir zu zum zur über
    au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par pas pour qu que qui sa se ses son sont sur un une vous y à
    a al como con de del el ella en entre era es esta este fue ha la las le lo los más mi no nos o para pero por que se si sin sobre son su sus también un una y ya
    """.split()
)
# Elements by what they hold.
RAW = frozenset("script style textarea title iframe".split())
SKIPPED = frozenset("noscript template svg math object canvas audio video select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CONTAINER = frozenset("html body article main section div nav header footer aside form menu ul ol dl table thead tbody tfoot tr td th figure fieldset blockquote details dialog head".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog head".split())
# Class and id names, as a whole, of containers without article text.
NAMED = frozenset(
    """
    ad ads ad-slot ad-container advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list commentlist comments-area comment-respond
    consent cookie cookies cookie-banner cookie-notice copyright disqus disqus_thread footer site-footer form header site-header login masthead menu main-menu menubar modal nav nav-menu
    navbar main-navigation post-navigation navigation newsletter newsletter-signup notice notices pager pagination popup promo promoted promotion related related-posts replies reply respond
    rss search search-form share share-buttons sharing shoutbox sidebar left-sidebar right-sidebar widget-area signup skip-link social social-links sponsor sponsored subscribe subscription
    tags toolbar warning widget widgets
    """.split()
)
# Names that also mark the layout of what has an article in it; an article inside ends their effect.
LAYOUT = frozenset("sidebar left-sidebar right-sidebar banner header widget-area menu nav".split())
# Names of what readers say, in which an article isn't the page's.
SAID = frozenset("comment comments comment-list commentlist comments-area comment-respond disqus disqus_thread replies reply respond shoutbox".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"""((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_SPECIAL = re.compile("[\"'>]")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")

LINKS, SHORT, LONG, SPARSE, DENSE = 0.35, 70, 200, 0.08, 0.15


@dataclass
class Block:
    text: str
    linked: int
    region: int
    says: int
    heading: bool
    listed: int
    label: str = ""


#: What a container says of its blocks: nothing, bad unless an article begins inside, a form around them (bad where there is anything else), bad unless an article inside
#: is the best that the page has, bad. A region in the last but one is of second choice.
FREE, LAID_OUT, FORM, NAMED_BAD, BANNED = 0, 1, 2, 3, 4
#: Quoted tags that may fail before the page is walked from quote to quote.
FAILS = 16


class Tags:
    """The tags of a page, found in time linear in its length whatever stands in it.

    A tag ends at the first > outside of quotes, or where quotes don't close at the first > of all. A walk
    from quote to quote that fails marks the quotes it stood at: a later walk that comes to one of them fails as well.
    """

    def __init__(self, page: str):
        self.page, self.last, self.fails = page, page.rfind(">"), 0
        self.ends = {q: page.rfind(q) for q in "\"'"}
        self.doomed: set[int] = set()

    def _quoted(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin here, quotes respected; -1 if there is none."""
        if self.fails < FAILS:
            m = _QUOTED.match(self.page, at)
            if m:
                return m.end() - 1
            self.fails += 1
            return -1
        stood = []
        while m := _SPECIAL.search(self.page, at):
            at = m.start()
            if m[0] == ">":
                return at
            if at in self.doomed or self.ends[m[0]] <= at:
                break
            stood.append(at)
            at = self.page.find(m[0], at + 1) + 1
        self.doomed.update(stood)
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), at):
                end = page.find("-->", at + 4) + 3 if page.startswith("<!--", at) else page.find(">", at) + 1
                return at, end if end > at else len(page), False, "", ""
            m = _NAME.match(page, at) if at < self.last else None
            if m:
                end = self._quoted(m.end())
                if end < 0:
                    end = page.find(">", m.end())
                return at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
            at += 1
        return None


def _banned(tag: str, attributes: str, in_article: bool) -> int:
    if tag == "form":
        return FORM
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return BANNED
    if tag in ("html", "body", "main") or not attributes.strip():
        return FREE
    names = {w for m in _NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}
    if names & SAID or "hidden" in attributes.split():
        return BANNED
    if names & NAMED:
        return LAID_OUT if names & NAMED <= LAYOUT else NAMED_BAD
    return FREE


def blocks(page: str, seconds: set[int] | None = None) -> list[Block]:
    """The page's non-empty blocks in order; regions of second choice, inside what is bad by its name or a form, go into ``seconds``."""
    seconds = set() if seconds is None else seconds
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", FREE, 0, 0)]  # tag, what it says, region, list
    tags, lists = Tags(page), 0
    opened: Counter[str] = Counter()  # how often each tag is in the stack
    within: Counter[str] = Counter()  # how often in the part of it that is skipped
    parts: list[str] = []
    linked, links, regions, heading, at = 0, 0, 0, False, 0
    skipped = 0  # place in the stack of the outermost skipped element, 0 outside of any
    inside: Counter[str] = Counter()  # other tags opened in it

    def push(tag: str, says: int, region: int, listed: int) -> None:
        stack.append((tag, says, region, listed))
        opened[tag] += 1
        if skipped:
            within[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        if skipped:
            within[tag] -= 1
        return tag

    def resume() -> None:
        nonlocal skipped
        skipped = 0
        inside.clear()
        within.clear()

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(linked, len(text)), stack[-1][2], stack[-1][1], heading, stack[-1][3]))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not skipped:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    while found := tags.after(at):
        start, end, closing, tag, attributes = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, tags.last + 1)
                at = end.end() if end else len(page)
            continue
        if skipped or tag in SKIPPED:
            if not closing:
                if tag in SKIPPED or tag in CONTAINER:
                    if not attributes.endswith("/"):
                        if tag == stack[-1][0] == "option":
                            pop()
                        skipped = skipped or len(stack)
                        push(tag, *stack[-1][1:])
                else:
                    inside[tag] += 1
                continue
            if skipped and within[tag]:
                while pop() != tag:
                    pass
                if len(stack) <= skipped:
                    resume()
                continue
            if tag in SKIPPED or tag in CONTAINER and not opened[tag]:
                continue
            if inside[tag]:
                inside[tag] -= 1
                continue
            # The end of something around the skipped element ends it as well.
            while len(stack) > skipped:
                pop()
            resume()
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        links = 0
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if tag in CONTAINER:
            if not closing:
                _, says, region, listed = stack[-1]
                own = _banned(tag, attributes, bool(region))
                if tag in ("article", "main") and not region and max(says, own) != BANNED:
                    regions += 1
                    second, region = max(says, own) >= FORM, regions
                    says = own = FREE
                    if second:
                        seconds.add(region)
                if tag in ("ul", "ol"):
                    lists += 1
                    listed = lists
                push(tag, max(says, own), region, listed)
            elif opened[tag]:
                while pop() != tag:
                    pass
    add(page[at:])
    close()
    return out


def classify(found: list[Block]) -> None:
    """Pass one: good, bad or undecided ('').

    In an article a linked item of a list that also has items without links is undecided; a list of links alone is a menu.
    """
    dense = [b.linked > LINKS * len(b.text) for b in found]
    mixed = {b.listed for b, d in zip(found, dense, strict=True) if b.listed and not d}
    for b, linked in zip(found, dense, strict=True):
        n = len(b.text)
        words = _WORD.findall(b.text.lower())
        stops = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
        if b.says not in (FREE, FORM) or linked and not (b.region and b.listed in mixed):
            b.label = "bad"
        elif b.region:
            b.label = "good" if n >= SHORT and stops >= SPARSE else ""
        elif n >= SHORT and stops >= DENSE:
            b.label = "good"
        elif n >= LONG and stops < SPARSE / 2 or n < SHORT and b.linked:
            b.label = "bad"


def inherit(found: list[Block]) -> None:
    """Pass two: undecided blocks take the label of the nearest decided neighbours of their region."""
    for region in {b.region for b in found}:
        own = [b for b in found if b.region == region]
        # What is bad only for its links says nothing of its neighbours in an article.
        decided = [k for k, b in enumerate(own) if b.label == "good" or b.label and (not region or b.says != FREE)]
        labels = [b.label for b in own]
        place = 0
        for k, b in enumerate(own):
            if labels[k]:
                continue
            while place < len(decided) and decided[place] < k:
                place += 1
            before = decided[place - 1] if place else None
            after = decided[place] if place < len(decided) else None
            if before is None and after is None:
                b.label = "good" if region else "bad"
            elif before is None or after is None:
                side = labels[after if before is None else before]
                b.label = side
            elif labels[before] == labels[after]:
                b.label = labels[before]
            elif after - k == k - before:
                b.label = "good" if region or b.heading else "bad"
            else:
                b.label = labels[before] if k - before < after - k else labels[after]


def main_text(page: str | None) -> str:
    """The good blocks of the best choice that has any: articles; articles in a form or in what its name makes bad, or what stands in no article, whichever is longer; a form."""
    seconds: set[int] = set()
    found = blocks(page or "", seconds)
    classify(found)
    inherit(found)
    good = [b for b in found if b.label == "good"]
    in_form = lambda b: b.says == FORM
    first = [b for b in good if b.region and b.region not in seconds and not in_form(b)]
    second, outside = [b for b in good if b.region in seconds and not in_form(b)], [b for b in good if not b.region and not in_form(b)]
    size = lambda some: sum(len(b.text) for b in some)
    for some in (first, second if size(second) >= size(outside) else outside, [b for b in good if not b.region and in_form(b)]):
        if some:
            return "\n".join(b.text for b in some)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: id_col, url_col, text, n_chars (code points)."""
    kind = pages.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(read, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
