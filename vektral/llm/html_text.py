"""Main text of web pages by two-pass block rules.

The page is cut into tags and text; block tags begin and end blocks.  What stands in scripts,
styles, forms, menus, headers, footers, sidebars, notices, adverts or reader comments -- by tag, role
or a word of the class or id -- is never main text; the header of an article or main element itself, captions, formulas and a
button inside a sentence are parts of the text around them.  In pass one each other block is decided from its
length, the share of its characters in links and its share of stop words: long running text is good,
link lists and long texts without stop words are bad, short ones stay open; stop words are asked of
Latin script only, and only on pages of which a long block has them, else length and links decide.  In pass two an open block
takes the label of its nearest decided neighbour, good on a tie.  The page's own mark of its article
(article, main, or such a role or class) is evidence: it decides marked blocks that pass one would leave
open and overrules a bad verdict on their words, so that of the rules only the one on links is tested on
them.  Marked blocks that are mostly links stay open, three or more that are nothing else are bad.  On a page with a mark, open blocks look at
neighbours on their own side of it; without any, a marked block is good unless pass one finds main text
outside the mark, an unmarked one is bad.

Defined results: null, empty and tag-only pages give an empty text; unclosed, stray and wrongly nested
tags are mended by closing what is open; character references are decoded once; white space inside a
block becomes one space; blocks are joined by two line feeds.  Time grows in proportion to the page,
however its tags are nested.  Rows aren't combined, so repeated rows, null ids and null urls pass through,
and other columns are left out, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a quote that isn't closed within some thousand characters is an ordinary character
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,5000}+\"|'[^']{0,5000}+'|[\"'])*+)>|[^<]+|<", re.S)
#: The same where no tag ends any more: its groups never match.
REST = re.compile(r"(?:(?!)(.)(.))?(?:<!--.*\Z|[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
#: The first letter says the script.
LATIN = re.compile(r"[\W\d_]*[a-zA-Z\u00c0-\u024f]")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "annotation", "annotation-xml"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Tags whose start ends an open one of the same kind.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
EXCLUDED = set("nav header footer aside form head script style noscript button select menu dialog iframe template object textarea fieldset".split())
#: Elements whose sentences may hold a button.
SENTENCES = set("p li dd dt h1 h2 h3 h4 h5 h6 td th blockquote figcaption caption pre".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar note".split())
#: Words of class and id names that say so wherever they stand.
STRONG_SIGNS = set("""ads advert adverts advertisement advertising sponsored promo promoted nav navbar navigation breadcrumb breadcrumbs footer masthead
sidebar comments replies disqus cookie cookies consent gdpr popup modal newsletter pagination outbrain taboola""".split())
#: Words that say so only beside each other and beside words of STRUCTURE.
SIGNS = set("""ad banner sponsor promotion menu header aside widget related recommended comment respond reply notice notices alert overlay subscribe
subscription signup login share sharing social toolbar pager form search copyright legal disclaimer rail teaser skip""".split())
STRUCTURE = set("""area bar block body bottom box button buttons card center column container content cta fixed global google group holder icon icons inline inner
item items left link links list main mobile module outer page panel popular post posts primary right section side site slot small sticky stories
text thread title top unit widget widgets wrap wrapper""".split())
ARTICLE_SIGNS = {"article-body", "entry-content", "post-content", "article-content", "articlebody", "story-body"}
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = set("""a an and are as at be by for from has he in is it its not of on or she that the their they this to was were which will with you
als auch auf aus bei das dem den der des die ein eine einer er es für hat ich im ist mit nach nicht oder sich sie sind und von war wie wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une vous
al como con del el ella en entre era es esta este ha la las lo los más muy no para pero por que se ser si sin sobre son su sus un una y ya""".split())


class Block:
    __slots__ = ("article", "linked", "text")

    def __init__(self, text: str, linked: int, article: bool):
        self.text, self.linked, self.article = text, linked, article


def _excluded(tag: str, attributes: str, own: bool = False) -> tuple[bool, bool]:
    """Whether an element is excluded, and whether it is marked as the article; own says that it belongs to one."""
    bad, good = tag in EXCLUDED and not (own and tag == "header"), tag in ("article", "main")
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role":
                bad, good = bad or value in ROLES, good or value in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                bad = True
            elif name in ("class", "id") and tag not in ("body", "html"):
                names = set(value.split())
                if ARTICLE_SIGNS & names:
                    good = True
                elif tag not in ("article", "main"):
                    # has-sidebar and the like say what stands inside, not what the element is
                    bad = bad or any(_says(part) for part in names if not re.match("(has|with|without|no|is)[-_]", part))
    return bad, good


def _says(name: str) -> bool:
    """Whether a class or id names something that isn't main text: site-footer and share-buttons do, legal-news doesn't."""
    words = [w for w in re.split(r"[-_]+|(?<=[a-z])\d+", name) if w]
    return any(w in STRONG_SIGNS for w in words) or (any(w in SIGNS for w in words) and all(w in SIGNS or w in STRUCTURE for w in words))


def blocks(page: str) -> list[Block]:
    """The blocks of a page that aren't excluded, in page order."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool, bool]] = []  # tag, excluded, article: each with what stands around it
    text: list[str] = []
    linked = links = 0
    times: Counter[str] = Counter()  # of open tags
    unclosed: set[str] = set()
    buttons = 0  # open ones inside a sentence
    last = page.rfind(">")  # no tag ends after it

    def close(at: int, upto: int | None = None) -> None:
        for t, _, _ in open_tags[at:upto]:
            times[t] -= 1
        del open_tags[at:upto]

    def end() -> None:
        nonlocal linked
        if text:
            joined = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, linked, bool(open_tags) and open_tags[-1][2]))
            text.clear()
        linked = 0

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.match(page, pos) if pos <= last else REST.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece.startswith(("<!", "<?")):
                continue
            if not (open_tags and open_tags[-1][1]):
                text.append(piece)
                linked += len(piece.strip()) if links else 0
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "button" and buttons:
                buttons -= 1
                continue
            at = next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag) if times[tag] else None
            if at is not None:
                if any(t in BLOCK for t, _, _ in open_tags[at:]):
                    end()
                # an inline end tag doesn't close the blocks around it
                if tag in BLOCK or not any(t in BLOCK for t, _, _ in open_tags[at + 1 :]):
                    close(at)
                else:
                    close(at, at + 1)
            elif tag in BLOCK:
                end()
            continue
        if tag in RAW:
            ends = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            if ends or tag in ("script", "style"):
                pos = ends.end() if ends else n
            else:
                unclosed.add(tag)
            continue
        if tag == "button" and any(x.strip() for x in text) and open_tags and open_tags[-1][0] in SENTENCES:
            buttons += 1
            continue
        if tag in BLOCK:
            end()
            buttons = 0
            while open_tags and tag in CLOSES.get(open_tags[-1][0], ()):
                close(len(open_tags) - 1)
            if times["p"]:
                at = max(k for k, (t, _, _) in enumerate(open_tags) if t == "p")
                if not any(t in BLOCK for t, _, _ in open_tags[at + 1 :]):
                    close(at)  # a paragraph holds no block, whatever inline tags are left open
        if tag == "br":
            text.append(" ")
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            if tag == "a":
                links += 1
            _, around_bad, around_good = open_tags[-1] if open_tags else ("", False, False)
            bad, good = _excluded(tag, m[3], around_good)
            if bad and not around_bad and tag not in BLOCK:
                end()
            if tag in BLOCK or bad or good:  # others change nothing
                open_tags.append((tag, around_bad or bad, around_good or good))
                times[tag] += 1
    end()
    return out


def labels(found: list[Block], short: int = 70, long: int = 200, max_links: float = 0.33, list_links: float = 0.8, stop_low: float = 0.1, stop_high: float = 0.2) -> list[bool]:
    """Pass one and two: which blocks are main text."""
    share = []
    asked = any(not b.article and len(b.text) >= short for b in found)
    for b in found:
        words = [w.lower() for w in WORD.findall(b.text)] if asked and len(b.text) >= short else []
        share.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
    dense = [b.linked / max(1, len(b.text)) for b in found]
    # stop words say something where the page is in one of their languages, and of blocks in its script
    covered = any(s >= stop_low for b, s, d in zip(found, share, dense) if len(b.text) >= long and d <= max_links)
    covered = covered or not any(len(b.text) >= long and d <= max_links for b, d in zip(found, dense))
    decided: list[bool | None] = []
    for k, b in enumerate(found):
        good: bool | None = None
        if dense[k] > max_links:
            # a marked block may be a sentence around a link, but not one of a list of links
            run = k
            while run > 0 and k - run < 3 and dense[run - 1] > list_links and found[run - 1].article:
                run -= 1
            upto = k
            while upto + 1 < len(found) and upto - k < 3 and dense[upto + 1] > list_links and found[upto + 1].article:
                upto += 1
            listed = dense[k] > list_links and upto - run >= 2
            decided.append(None if b.article and not listed else False)
            continue
        if not b.article and len(b.text) >= short:
            if not (covered and LATIN.match(b.text)):
                good = True if len(b.text) >= long else None
            elif share[k] >= stop_high:
                good = True if len(b.text) >= long or dense[k] == 0 else None
            elif share[k] >= stop_low:
                good = True if len(b.text) >= long else None
            else:
                good = False if len(b.text) >= long else None
        decided.append(True if b.article else good)
    marked = any(b.article for b in found)
    plain = any(d and not b.article for b, d in zip(found, decided))
    n, inf = len(found), 1 << 30
    before, after = [inf] * n, [inf] * n
    for side, steps in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = {False: inf, True: inf}
        for k in steps:
            if decided[k] is not None:
                last[found[k].article] = k
            side[k] = last[found[k].article]
    out = []
    for k in range(n):
        if decided[k] is not None:
            out.append(bool(decided[k]))
        else:
            left = k - before[k] if before[k] < inf else inf
            right = after[k] - k if after[k] < inf else inf
            if left == right == inf:
                out.append(not plain if found[k].article else not marked)
            elif left == right:
                out.append(bool(decided[before[k]] or decided[after[k]]))
            else:
                out.append(bool(decided[before[k]] if left < right else decided[after[k]]))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, labels(found)) if good)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html)).mapInArrow(run, "page_id long, url string, text string, n_chars long")
