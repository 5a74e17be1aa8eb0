"""Main text of web pages by composite text density.

A page is read once into a flat tree (a row for each element, parents first), as browsers read it: void elements, implied end tags, raw
text. What can never be the article is left out by its element (menus, forms, scripts, ...) or by its names and role (adverts, notices, reader comments, ...).
Of the rest every element has a composite density: characters per tag, adjusted by the links among both (Sun, Song and Liao, SIGIR 2011); the sum of its
children's densities, its own text counting as a child, says how much of an article it holds. The element with the largest sum is the core. From
there the text is completed:

* an <article> or <main> around the core is the article; else the core grows to its parent while what that adds is mostly unlinked text, below the body;
* the least density on the path from the core to the body is the threshold: elements that reach it on a path of such elements have their own largest sum
  kept too (where the page names an article, other named articles alone);
* headings before the core, in elements around it, belong to it.

Lists of links inside are menus and go. Character references are decoded, white space in a block becomes one space, blocks are joined by an empty line.
A page is a row and nothing moves between tasks: the whole operator is one map.

Edge cases: null and empty pages, and pages without text, have an empty text; a page without markup is one block; unclosed elements end with their parents; as in browsers, a comment, script, style
or tag without its end reaches to the end of the page; elements nested any depth and pages of any length are read whole, in linear time; pages whose
names would leave nothing of the text are read again without regard to names; repeated rows get equal results; extra columns stay as they are, but for the
two names of the results, which get lexi_ before them; an empty table gives none.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, tidy

# Fixed values of HTML: elements without content, with raw text, and what ends an open paragraph, cell or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
HEAD = frozenset("head title meta link base script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption legend body".split()
)
ENDS_P = BLOCKS - frozenset("tbody tfoot thead tr caption legend body".split())
CELLS = frozenset("td th caption".split())
SCOPES = CELLS | frozenset("table object template".split())
TABLE_PARTS = frozenset("td th tr tbody thead tfoot caption table".split())
#: Elements that end when another of them begins in the same list or table.
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}

#: Elements that hold no main text.
NEVER = RAW | frozenset("head template noscript object embed applet svg canvas audio video map button select datalist nav aside footer menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
#: Words of classes and ids that say the same.
NAMES = re.compile(
    r"nav|navi|navbar|navigation|topnav|subnav|menus?|menubar|submenu|sidebars?|sidenav|sidepanel|ads?|adbox|adslot|adunit|adsense|adsbygoogle|adverts?|advertising|advertisements?|advertorial|banners?|sponsors?|sponsored|promos?|promoted|"
    r"comments?|commentlist|disqus|replies|respond|footers?|footnav|headers?|masthead|topbar|breadcrumbs?|crumbs|cookies?|consent|gdpr|notices?|notifications?|alerts?|disclaimer|newsletter|subscribe|subscription|signup|signin|login|paywall|popups?|modal|overlay|lightbox|"
    r"share|shares|sharing|sharebar|sharethis|addthis|social|related|recommended|recommendations|recirc|outbrain|taboola|widgets?|pagination|pager|paging|toolbar|search|searchbox|searchform|tagcloud|skiplink|copyright"
)
#: After such a word, they say the contrary, and headers after these are an article's own.
WITHOUT, OWN = frozenset("no not non has have with without".split()), frozenset("article entry post content story page section".split())

TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+)>|(!--)|([!?]|/(?![a-zA-Z])))""")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

FREE, NAMED, OUT = 0, 1, 2


def verdict(attributes: str) -> int:
    """OUT for hidden elements and those with a role beside the main text, NAMED for names that say so, else FREE."""
    found = FREE
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES or key == "style" and HIDDEN.search(value):
            return OUT
        if key in ("class", "id"):
            before = ""
            for word in WORDS.findall(value):
                word = word.lower()
                if NAMES.fullmatch(word) and before not in WITHOUT and not (before in OWN and word.startswith("header")):
                    found = NAMED
                before = word
    return found


def bounds(name: str) -> tuple[str, ...]:
    """What an element bounds: inline end tags, paragraphs, list items, table parts."""
    scope, block = name in SCOPES, name in BLOCKS
    return tuple(group for group, has in (("#block", block or scope), ("#scope", scope), ("#list", scope or name in ("ul", "ol", "dl", "menu", "select")), ("#table", name == "table")) if has)


BOUNDS = {name: bounds(name) for name in BLOCKS | SCOPES | {"select"}}


class Page:
    """A page's elements and pieces of text, in page order. Element 0 is the body.

    A piece is (element, text): a text of None is the border of a block.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.kinds, self.pieces = ["body"], [-1], [FREE], []
        self.stack, self.open = [0], defaultdict(list, {"#block": [0], "#scope": [0], "#list": [0], "#table": [0]})
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            m = TAG.match(html, lt)
            if not m:
                if html[lt + 1 : lt + 2].isalpha() and html[lt + 1].isascii() or html[lt + 1 : lt + 2] == "/":
                    self.text(html[at:lt])  # a tag without its end
                    break
                # a sign, with the text after it
                next_ = html.find("<", lt + 1)
                self.text(html[at : next_ if next_ >= 0 else n])
                at = next_ if next_ >= 0 else n
                continue
            if lt > at:
                self.text(html[at:lt])
            at = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self.end(name)
                else:
                    self.start(name, m[3])
                    if name in RAW:
                        close = RAW_END[name].search(html, at)
                        at = close.start() if close else n
            elif m[4]:
                if html.startswith((">", "->"), at):
                    at = html.index(">", at) + 1
                else:
                    close_ = COMMENT_END.search(html, at)
                    at = close_.end() if close_ else n
            else:
                at = html.find(">", at) + 1 or n
        self.pieces.append((0, None))

    def text(self, raw: str) -> None:
        if self.tags[self.stack[-1]] == "head" and not raw.isspace():
            self.pop(len(self.stack) - 1)
        self.pieces.append((self.stack[-1], references.unescape(raw) if "&" in raw else raw))

    def pop(self, depth: int) -> None:
        """Close the elements of the stack from depth on."""
        while len(self.stack) > depth:
            name = self.tags[self.stack.pop()]
            self.open[name].pop()
            for group in BOUNDS.get(name, ()):
                self.open[group].pop()
            if name in BLOCKS:
                self.pieces.append((self.stack[-1], None))
            elif name in CELLS:
                self.pieces.append((self.stack[-1], " "))

    def last(self, name: str) -> int:
        at = self.open[name]
        return at[-1] if at else -1

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            return
        if self.tags[self.stack[-1]] == "head" and name not in HEAD:
            self.pop(len(self.stack) - 1)
        if name in ENDS_P and self.last("p") > self.last("#scope"):
            self.pop(self.last("p"))
        if name in HEADINGS and self.tags[self.stack[-1]] in HEADINGS:
            self.pop(len(self.stack) - 1)
        if name in SIBLINGS:
            bound = self.last("#table" if name in TABLE_PARTS else "#list")
            for other in SIBLINGS[name]:
                if self.last(other) > bound:
                    self.pop(self.last(other))
        if name == "a" and self.last("a") > self.last("#block"):
            self.pop(self.last("a"))
        if name in BLOCKS:
            self.pieces.append((self.stack[-1], None))
        elif name == "br" or name in CELLS:
            self.pieces.append((self.stack[-1], " "))
        k = len(self.tags)
        self.tags.append(name)
        self.parents.append(self.stack[-1])
        self.kinds.append(OUT if name in NEVER else verdict(attributes) if attributes else FREE)
        if name not in VOID:
            self.open[name].append(len(self.stack))
            for group in BOUNDS.get(name, ()):
                self.open[group].append(len(self.stack))
            self.stack.append(k)

    def end(self, name: str) -> None:
        at = self.last(name)
        if name in TABLE_PARTS:
            bound = self.last("#table") - (name == "table")
        else:
            bound = self.last("#scope") - (name in SCOPES) if name in BLOCKS or name in SCOPES or name in NEVER else self.last("#block")
        if at > bound and at > 0:
            self.pop(at)

    def left_out(self, by_name: bool) -> list[bool]:
        """For each element whether it is no part of the main text, its parents' fault included.

        A name is not taken at its word for an element around an article, or around a first heading and most of the text. A header in an article is a part of it if it holds a heading.
        """
        n = len(self.tags)
        size, first, heading, around, article, out = [0] * n, [False] * n, [False] * n, [False] * n, [False] * n, [False] * n
        for k, text in self.pieces:
            size[k] += len(text or "")
        for k in range(n - 1, 0, -1):
            if self.kinds[k] != OUT:
                up, tag = self.parents[k], self.tags[k]
                size[up] += size[k]
                first[up] |= first[k] or tag == "h1"
                heading[up] |= heading[k] or tag in HEADINGS
                around[up] |= around[k] or tag == "main" or tag == "article" and self.kinds[k] == FREE
        for k in range(1, n):
            tag, up = self.tags[k], self.parents[k]
            article[k] = article[up] or tag in ("article", "main")
            named = by_name and (self.kinds[k] == NAMED or tag == "form") and tag != "main" and not around[k] and not (first[k] and 2 * size[k] > size[0])
            out[k] = out[up] or self.kinds[k] == OUT or tag == "header" and not (article[up] and heading[k]) or named
        return out


def density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Composite density: characters per tag, times the logarithm of both's proportions to links, to a base that grows with the links' share here and in the body."""
    if not chars:
        return 0.0
    links, tags = links or 1, tags or 1
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    return chars / tags * math.log(max(chars / links * (tags / (link_tags or 1)), 1.0)) / math.log(base)


def chosen(page: Page, out: list[bool]) -> list[bool] | None:
    """For each element whether its own text is main text; None if there is no text."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    own, chars, links, below, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for k in range(1, n):
        in_link[k] = in_link[parents[k]] or tags[k] == "a"
    for k, text in page.pieces:
        if text and not out[k] and not text.isspace():
            own[k] += len(" ".join(text.split()))
    for k in range(n - 1, -1, -1):
        chars[k] += own[k]
        links[k] += own[k] if in_link[k] else 0
        if k and not out[k]:
            up = parents[k]
            chars[up] += chars[k]
            links[up] += links[k]
            below[up] += below[k] + 1
            link_tags[up] += link_tags[k] + (tags[k] == "a")
    if not chars[0]:
        return None
    share = links[0] / chars[0]
    dense = [density(*x, share) for x in zip(chars, links, below, link_tags, strict=True)]
    total, best = [0.0] * n, list(range(n))  # sums of children's densities; the element of the largest sum at or below, the outermost of equals
    for k, c in enumerate(own):
        total[k] += density(c, c if in_link[k] else 0, 1, 1, share)
        if k and not out[k]:
            total[parents[k]] += dense[k]
    for k in range(n - 1, 0, -1):
        up = parents[k]
        if not out[k] and (total[best[k]] > total[best[up]] or total[best[k]] == total[best[up]] and best[k] < best[up] and best[up] != up):
            best[up] = best[k]
    core = best[0]

    path = [core]
    while path[-1]:
        path.append(parents[path[-1]])
    threshold = min(dense[k] for k in path)
    named = [k for k in path if tags[k] == "article"] or [k for k in path if tags[k] == "main"]
    home = named[-1] if named else core
    if not named:
        while home and parents[home] and 3 * (links[parents[home]] - links[home]) <= chars[parents[home]] - chars[home]:
            home = parents[home]
    kept = [False] * n
    kept[home] = True
    around, reached, flow = set(path), [False] * n, frozenset("p pre blockquote ul ol dl table figure".split())
    for k in range(n):
        up = parents[k]
        reached[k] = not out[k] and dense[k] >= threshold and (k == 0 or reached[up])
        if reached[k] and (not named or tags[k] in ("article", "main")) and total[best[k]] > 0:
            kept[best[k] if not named else k] = True
        if k and up in around and not out[k]:
            before = k < core and tags[k] in HEADINGS
            if before or not named and up == 0 and home and tags[k] in flow and 3 * links[k] <= chars[k]:
                kept[k] = True
    for k in range(1, n):
        kept[k] = (kept[k] or kept[parents[k]]) and not out[k]
        # a list of links is a menu
        if kept[k] and k not in around and tags[k] in ("ul", "ol", "dl", "div", "table", "section") and link_tags[k] >= 3 and 5 * links[k] > 4 * chars[k]:
            kept[k], out[k] = False, True
        elif out[parents[k]]:
            kept[k], out[k] = False, True
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    kept = chosen(page, page.left_out(True)) or chosen(page, page.left_out(False))
    if not kept:
        return ""
    blocks, block = [], []
    for k, text in page.pieces:
        if text is None:
            if block:
                blocks.append(" ".join("".join(block).split()))
                block = []
        elif kept[k]:
            block.append(text)
    return "\n\n".join(b for b in blocks if b)


def main_texts(pages: DataFrame, content: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All columns of pages but `content`, with the main text and its number of code points. Columns of these two names get lexi_ before theirs."""
    names = [f"lexi_{c}" if c in (text, n_chars) else c for c in pages.columns if c != content]
    plain = pages.select(quoted(content).cast("string").alias("c0"), *(quoted(c).alias(f"c{k + 1}") for k, c in enumerate(c for c in pages.columns if c != content)))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                found = [main_text(h) for h in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*b.schema.names[1:], "text", "n_chars"])

    inner = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[1:]), "text string", "n_chars long"])
    return plain.mapInArrow(tidy(run), inner).toDF(*names, text, n_chars)
