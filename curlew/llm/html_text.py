"""Main text of web pages by composite text density.

A page is read into a flat tree (parents before children) as a forgiving browser would read it: missing ends are implied, unknown ends are
skipped, a comment, script or tag that never ends takes the rest. Parts that say what they are (menus, footers, forms, adverts, comments:
by tag, role or the words of class and id) are left out. For every node left, the characters and tags of its subtree, and how many of each
belong to links, give its density: characters a tag, adjusted by a logarithm that falls to 0 where all is links. A container's density sum
is that of its children, runs of its own text among them.

The container of the largest sum holds the article. The smallest density between it and the body is the threshold: below the body, each
node that reaches it adds the container of the largest sum in its own subtree (or itself, a paragraph or heading). Where the page marks up
its article, or a single one, the chosen containers grow to it and what lies outside goes.
"""

from __future__ import annotations

import html
import math
import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.llm.registry import query, table

DEEPEST = 256  # deeper tags become siblings, as browsers have it; their text stays
SLICE_ROWS = 64  # pages that are Python objects at a time

# Tags of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("caption option optgroup tbody td tfoot th thead tr body legend".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF_BLOCK = HEADING | frozenset("p li dt tr thead tbody tfoot caption figcaption pre summary hr legend option optgroup".split())
# a start tag ends open ones of these names, as far as the nearest of the bounds
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot caption".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "a": (frozenset(["a"]), frozenset(["table"])),
}
# What is no part of an article.
OTHER_TAGS = RAW | frozenset(
    "nav footer aside form noscript object embed applet button select datalist input svg canvas audio video template dialog menu map search".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status tablist".split())
OTHER_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets notice notices cookie cookies "
    "consent gdpr banner popup modal overlay alert ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo "
    "promoted promotion form newsletter subscribe subscription signup login search share sharing social comment comments commentlist disqus "
    "respond reply replies related recommended recommendations pagination pager toolbar skip copyright hidden noprint".split()
)
UNSAID = frozenset("has with no without is hide show".split())  # words after which one of the above is no name

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_TAG_START, _ODD_COMMENT = re.compile("</?[a-zA-Z]"), re.compile("<[!?]|</(?![a-zA-Z])")
_COMMENT_END = re.compile(r"--!?>")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Page:
    """A flat tree: node 0 is the body; ``pieces`` are (node, text) in page order, with None where a block starts or ends."""

    def __init__(self, source: str):
        self.parent, self.name, self.about = [-1], ["body"], [""]
        self.pieces: list[tuple[int, str] | None] = []
        self.stack, self.open = [0], {"body": 1}
        self._read(source)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], html.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            start = source.find("<", at)
            if start < 0:
                start = size
            self._text(source[at:start])
            if start == size:
                return
            if source.startswith("<!--", start):
                end = _COMMENT_END.search(source, start + 2)
                at = end.end() if end else size
            elif _ODD_COMMENT.match(source, start):
                end = source.find(">", start)
                at = end + 1 if end >= 0 else size
            elif _TAG_START.match(source, start):
                tag = _TAG.match(source, start)
                if not tag:
                    return  # a tag that never ends
                at = tag.end()
                name = tag[2].lower()
                if tag[1]:
                    self._end(name)
                else:
                    self._start(name, tag[3])
                    if name in RAW:
                        end = _RAW_END[name].search(source, at)
                        at = end.start() if end else size
            else:
                self._text("<")
                at = start + 1

    def _pop(self) -> None:
        name = self.name[self.stack.pop()]
        self.open[name] -= 1
        if name in BLOCK:
            self.pieces.append(None)

    def _pop_to(self, names: frozenset[str], bounds: frozenset[str], through: bool = True) -> None:
        """Close everything up to the nearest open tag of these names, unless a bound (or a block, if not ``through``) comes first."""
        if not any(self.open.get(name) for name in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.name[self.stack[i]]
            if name in names:
                while len(self.stack) > i:
                    self._pop()
                return
            if name in bounds or (not through and name in BLOCK):
                return

    def _start(self, name: str, about: str) -> None:
        if name in ("html", "head", "body"):
            return
        if name in IMPLIED:
            self._pop_to(*IMPLIED[name])
        if name in ENDS_PARAGRAPH and self.open.get("p"):
            self._pop_to(frozenset(["p"]), frozenset(["td", "th", "caption", "table"]))
        if name in HEADING and self.name[self.stack[-1]] in HEADING:
            self._pop()
        while len(self.stack) > DEEPEST:
            self._pop()
        if name in BLOCK or name == "br":
            self.pieces.append(None)
        node = len(self.parent)
        self.parent.append(self.stack[-1])
        self.name.append(name)
        self.about.append(about)
        if name not in VOID:
            self.stack.append(node)
            self.open[name] = self.open.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if name in ("html", "head", "body") or not self.open.get(name):
            return
        cells = frozenset() if name in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption") else frozenset(["td", "th", "caption"])
        self._pop_to(frozenset([name]), cells, through=name in BLOCK or name == "a" or name in OTHER_TAGS)


def _names(about: str) -> tuple[str, list[str], bool]:
    """(role, words of class and id, whether the tag is hidden)."""
    role, words, hidden = "", [], False
    for key, value in _ATTRIBUTE.findall(about):
        key = key.lower()
        value = html.unescape(value.strip("\"'"))
        if key == "role":
            role = value.strip().lower()
        elif key in ("class", "id"):
            for token in value.split():
                words += ["", *(w.lower() for w in _NAME_WORD.findall(token))]
        elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return role, words, hidden


def other_parts(page: Page) -> list[bool]:
    """Per node, whether it is (in) a part that is no article: by tag, role, or a word of its class or id.

    Roles, words and forms do not count on a node around the article or the page's headline, nor a header inside an article."""
    size = len(page.parent)
    holds, headline = [name in ("article", "main") for name in page.name], [name == "h1" for name in page.name]
    for i in range(size - 1, 0, -1):
        up = page.parent[i]
        holds[up] = holds[up] or holds[i]
        headline[up] = headline[up] or headline[i]
    out, inside = [False] * size, [False] * size
    for i in range(1, size):
        up, name = page.parent[i], page.name[i]
        inside[i] = inside[up] or name in ("article", "main")
        if out[up]:
            out[i] = True
        elif name in OTHER_TAGS:
            out[i] = not (name == "form" and (holds[i] or headline[i]))
        elif name == "header":
            out[i] = not inside[i] and not holds[i]
        elif page.about[i] and name not in ("article", "main"):
            role, words, hidden = _names(page.about[i])
            named = any(word in OTHER_WORDS and before not in UNSAID for before, word in pairwise(["", *words]))
            out[i] = hidden or ((role in OTHER_ROLES or named) and not holds[i] and not headline[i])
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, linked_share: float) -> float:
    """Composite text density of a subtree, 0 if all its text is links; ``linked_share``: link characters of the body a character of the body."""
    unlinked = chars - link_chars
    if not unlinked:
        return 0.0
    tags = tags or 1
    base = math.log(chars / unlinked * link_chars + linked_share * chars + math.e)
    return chars / tags * math.log(chars / (link_chars or 1) * tags / (link_tags or 1)) / math.log(base) if base > 1 else chars / tags


def densities(page: Page, out: list[bool]) -> tuple[list[float], list[float]]:
    """(density, density sum) of every node; 0 for nodes that are left out."""
    size = len(page.parent)
    chars, tags, link_chars, link_tags = [0] * size, [0] * size, [0] * size, [0] * size
    linked = [False] * size
    for i in range(1, size):
        linked[i] = linked[page.parent[i]] or page.name[i] == "a"
    runs: list[tuple[int, int]] = []
    for piece in page.pieces:
        if piece and not out[piece[0]]:
            count = len(" ".join(piece[1].split()))
            if count:
                chars[piece[0]] += count
                link_chars[piece[0]] += count if linked[piece[0]] else 0
                runs.append((piece[0], count))
    for i in range(size - 1, 0, -1):
        if not out[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.name[i] == "a")
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    own = [0.0 if out[i] else density(chars[i], tags[i], link_chars[i], link_tags[i], share) for i in range(size)]
    sums = [0.0] * size
    for i in range(1, size):
        sums[page.parent[i]] += own[i]
    for node, count in runs:
        sums[node] += 0.0 if linked[node] else density(count, 1, 0, 0, share)
    return own, sums


def content(page: Page) -> list[bool]:
    """Per node, whether it belongs to the main text."""
    size = len(page.parent)
    out = other_parts(page)
    own, sums = densities(page, out)
    chosen = [False] * size
    containers = [i for i in range(size) if not out[i] and (i == 0 or (page.name[i] in BLOCK and page.name[i] not in LEAF_BLOCK))]
    best = max(containers, key=sums.__getitem__)
    if sums[best] <= 0:
        return chosen
    # the container of the largest sum in each subtree: the outer one of equals, then the first
    allowed, top = set(containers), [-1] * size
    for i in range(size - 1, 0, -1):
        if i in allowed and (top[i] < 0 or sums[i] >= sums[top[i]]):
            top[i] = i
        up = page.parent[i]
        if top[i] >= 0 and (top[up] < 0 or sums[top[i]] >= sums[top[up]]):
            top[up] = top[i]
    threshold, node = own[0], best
    while node > 0:
        threshold, node = min(threshold, own[node]), page.parent[node]
    chosen[best] = True
    for i in range(1, size):
        if not out[i] and own[i] > 0 and own[i] >= threshold and page.name[i] in BLOCK:
            chosen[i if page.name[i] in LEAF_BLOCK else top[i]] = True
    # the article's own element, or the page's main one, around what was chosen
    for kind in ("article", "main"):
        around = [-1] * size
        for i in range(1, size):
            around[i] = i if page.name[i] == kind and not out[i] and around[page.parent[i]] < 0 else around[page.parent[i]]
        outer = {i for i in around if i >= 0 and sums[i] > 0}
        if around[best] >= 0 or len(outer) == 1:
            chosen = [i in outer and (i == around[best] or len(outer) == 1 or own[i] >= threshold) for i in range(size)]
            break
    else:
        for i in range(1, size):
            chosen[i] = chosen[i] or (page.name[i] == "h1" and not out[i])
    for i in range(1, size):
        chosen[i] = (chosen[i] or chosen[page.parent[i]]) and not out[i]
    return chosen


def main_text(source: str | None) -> str:
    """The main text of a page: its blocks in order, white space made one blank; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    chosen, blocks, block = content(page), [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            if block:
                blocks.append(" ".join("".join(block).split()))
                block = []
        elif chosen[piece[0]]:
            block.append(piece[1])
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """``row`` (the input row), text, n_chars (code points) for each page, by its column html.

    Null and empty pages, and pages without any text that is not links, have an empty text. Repeated rows all return; an empty table
    gives no rows. Whole pages are read, however long; the time a page takes grows with its length."""
    kind = pages.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                texts = [main_text(source) for source in some.column("html").to_pylist()]
                columns = [some.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_chars"])

    return pages.select(F.struct("*").alias("row"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"row {kind}, text string, n_chars bigint")


@query("op13_html")
def op13_html(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract(pages).select("row.page_id", "row.url", "text", "n_chars")
