"""Main text of web pages by composite text density.

Each node of the DOM has a density: characters per tag, weighed down by the
share of its text and tags that are links, relative to the whole body. The node
whose children's densities have the largest sum holds the article. The smallest
density on its path to the body is the threshold: beside the article, what
reaches it belongs to it; inside, lists of links that don't are menus and go.
Formatting inside a block (bold, breaks) makes no node of its own.

What HTML says is no text of the article (menus, footers, form controls ...)
takes no part. Elements whose class, id or role is the name of such a thing, and
forms, are left out only where the densities agree: not around an article or
main, and not around the densest subtree where what is left without them is far
less dense. Where such a name is only part of another (``comment-list`` is a
list of comments, ``related-work`` is not), the element must also have far fewer
characters for each tag than the rest of the article.
"""

from __future__ import annotations

import html
import re
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grown, table, text_slices

# Attributes as the tokeniser of HTML reads them: a quote counts only where a value begins.
_ATTRIBUTES = r"""((?>[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?)?)*+)"""
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*))?)?""")
# Elements whose text is no text of the page, up to their end tag; then other tags.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|noscript|template|iframe|svg|textarea|title|annotation|annotation-xml)(?=[\s/>])" + _ATTRIBUTES.replace("((?>", "(?:(?>", 1) + r"(?:>|\Z)(?:.*?</\1(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRIBUTES + r"(?:>|\Z)",
    re.S | re.I,
)

# Element names of HTML and what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced msub msup msubsup munder mover munderover mmultiscripts mspace semantics".split()
)
LEFT_OUT = frozenset("head nav footer aside button input select menu dialog datalist optgroup option audio video canvas".split())
#: Of those, what stands inside a line of text and does not break it.
IN_LINE = frozenset("button input select datalist optgroup option audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An opened element closes those of the second set that are open above the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
# Words in class names, ids and roles that mark other things than the article.
OTHER_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted outbrain taboola"
    " sidebar sidenav menu submenu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar skip"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall"
    " social share sharing sharebar related recommended recommendations trending comment comments commentlist disqus reply replies respond"
    " widget pagination pager login search form complementary contentinfo alertdialog hidden invisible".split()
)
# Words that say no more than that something is a part of a page, or whose.
AROUND_NAMES = frozenset(
    "area bar block body box bottom card container content footer global group holder inner item items left links list main outer page panel posts reader readers"
    " region right row section site slot stories thread top unit user users view wrap wrapper zone".split()
)

#: Names are believed unless what they leave has less than this share of the largest sum of densities.
BELIEVED = 0.25
#: An element with such a word in its name goes if it has less than this share of the article's characters for each tag.
SPARSE = 0.5
#: A node with this share of its characters in this many links or more is a menu, below the threshold.
MENU_SHARE, MENU_LINKS = 0.8, 3


class Page:
    """A page as parallel lists in document order; parents come before children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out = ["body"], [-1], [False]
        self.links: list[int] = [0]  # tags of links right below a node
        self.inner: list[int] = [0]  # all tags right below it
        self.runs: list[tuple[int, int, str, bool]] = []  # node, block, text, in a link
        self.main = [False]
        self.named = [False]  # a form, or named as something beside the article
        self.hinted = [False]  # with the name of such a thing as part of its own
        stack: list[tuple[str, int, bool]] = [("body", 0, False)]  # name, node, in a link
        known: set[str] = set()  # names that were opened at all
        block = at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.runs.append((stack[-1][1], block, source[at : m.start()], stack[-1][2]))
            at = m.end()
            name = (m[3] or "").lower()
            if not name or name in ("html", "body"):
                continue
            node = stack[-1][1]
            if name not in INLINE and name not in IN_LINE:
                block += 1
            if m[2]:
                for k in range(len(stack) - 1, 0, -1) if name in known else ():
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break
                continue
            self._imply(stack, name)
            known.add(name)
            _, node, linked = stack[-1]
            if name in INLINE:
                self.inner[node] += name not in VOID or name == "img"
                if name == "a":
                    self.links[node] += 1
                if name not in VOID:
                    stack.append((name, node, linked or name == "a"))
                elif name == "br":
                    self.runs.append((node, block, " ", linked))
                continue
            if name in VOID:
                continue
            self.tag.append(name)
            self.parent.append(node)
            self.links.append(0)
            self.inner.append(0)
            own = attributes(m[4]) if "=" in m[4] or "hidden" in m[4] else {}
            self.main.append(self.main[node] or name in ("article", "main") or own.get("role", "").lower() == "main")
            self.out.append(self.out[node] or name in LEFT_OUT or (name == "header" and not self.main[node]) or _hidden(own))
            said = _other(own, re.fullmatch("h[1-6]", name) is not None)
            self.named.append(name == "form" or said == 2)
            self.hinted.append(said == 1 and name not in ("article", "main"))
            stack.append((name, len(self.tag) - 1, linked))
        if at < len(source):
            self.runs.append((stack[-1][1], block, source[at:], stack[-1][2]))
        if any(self.named):
            self._leave_out()
        if any(self.hinted):
            self._leave_out_sparse()

    def _leave_out(self) -> None:
        """Named elements go, but not those that hold the article or, where names leave little, the densest subtree."""
        n, plain = len(self.tag), list(self.out)
        text, holds = [False] * n, [False] * n
        for node, _, run, linked in self.runs:
            text[node] = text[node] or not (linked or self.out[node] or run.isspace())
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            text[p] = text[p] or text[i]
            own = self.main[i] and not self.main[p]  # an article or main inside no other
            holds[i] = holds[i] or (own and not self.named[i] and not self.out[i] and text[i])
            holds[p] = holds[p] or holds[i]
        densest = Densities(self) if not holds[0] else None
        self._without([not holds[i] or self.main[self.parent[i]] for i in range(n)], plain)
        if densest is not None and densest.blocks:
            left = Densities(self)
            if not left.blocks or left.sums[left.best] < BELIEVED * densest.sums[densest.best]:
                around = set(densest.path)
                self._without([i not in around for i in range(n)], plain)

    def _leave_out_sparse(self) -> None:
        """Elements whose name only hints at something else go where they are sparse beside the article."""
        d, n = Densities(self), len(self.tag)
        if not d.blocks:
            return
        around = next((i for i in d.path if self.tag[i] in ("article", "main")), d.best)
        inside, path, gone = [i == around for i in range(n)], set(d.path), [False] * n
        chars, tags = d.chars[around] - d.linked[around], d.tags[around]
        hinted = []
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.parent[i]]
            gone[i] = gone[self.parent[i]]  # here: below one that is hinted at already
            if self.hinted[i] and not gone[i] and i not in path and not self.out[i]:
                gone[i] = True
                hinted.append(i)
                if inside[i]:
                    chars, tags = chars - d.chars[i] + d.linked[i], tags - d.tags[i] - 1
        dense = chars / max(tags, 1.0)
        gone = [False] * n
        for i in hinted:
            gone[i] = (d.chars[i] - d.linked[i]) / max(d.tags[i], 1.0) < SPARSE * dense
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]]
            self.out[i] = self.out[i] or gone[i]

    def _without(self, may_go: list[bool], plain: list[bool]) -> None:
        for i in range(1, len(self.tag)):
            self.out[i] = plain[i] or self.out[self.parent[i]] or (self.named[i] and may_go[i])

    @staticmethod
    def _imply(stack: list, name: str) -> None:
        """Close what the start of ``name`` closes by the rules of HTML."""
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in IMPLIED:
            ends, borders = IMPLIED[name]
            cut = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in borders:
                    break
                if stack[k][0] in ends:
                    cut = k
            if cut:
                del stack[cut:]

    def blocks(self) -> list[tuple[int, str, int]]:
        """(node, text, characters in links) of the blocks that are not left out."""
        out: list[list] = []
        last = None
        for node, block, text, linked in self.runs:
            if self.out[node]:
                continue
            if last != (node, block):
                out.append([node, [], 0])
                last = (node, block)
            if "&" in text:
                text = html.unescape(text)
            out[-1][1].append(text)
            if linked:
                out[-1][2] += sum(map(len, text.split()))
        made = []
        for node, texts, linked in out:
            text = " ".join("".join(texts).split())
            if text:
                made.append((node, text, linked))
        return made

    def text(self) -> str:
        """Blocks of the article, in page order."""
        d = Densities(self)
        if not d.blocks:
            return ""
        n = len(self.tag)
        threshold = min(d.density[i] for i in d.path)
        root = next((i for i in d.path if self.tag[i] in ("article", "main")), None)
        if root is not None:
            # an article says itself where it ends; others beside it belong to it
            p = self.parent[root]
            keep = [i == root or (self.tag[i] == self.tag[root] == "article" and self.parent[i] == p) for i in range(n)]
            self._title(keep, root, d)
        else:
            # the subtree, and what reaches the threshold beside it, with headings
            near = {self.parent[d.best], d.best}
            keep = [i == d.best or (0 < i and d.density[i] >= threshold and d.linked[i] <= 0.5 * d.chars[i]) for i in range(n)]
            for i in range(1, n):
                if self.parent[i] in near and re.fullmatch("h[1-6]|hgroup|header|p", self.tag[i]) and d.linked[i] <= 0.5 * d.chars[i]:
                    keep[i] = True
            if d.best == 0 and not any(keep[1:]):
                keep[0] = True
        on_path = set(d.path)
        menus = [d.density[i] < threshold and d.anchors[i] >= MENU_LINKS and d.linked[i] >= MENU_SHARE * d.chars[i] and i not in on_path for i in range(n)]
        if root is not None:
            menus = self._leading(menus, keep, d)
        for i in range(1, n):
            keep[i] = (keep[i] or keep[self.parent[i]]) and not menus[i]
        return "\n\n".join([text for node, text, _ in d.blocks if keep[node]])

    def _title(self, keep: list[bool], root: int, d: Densities) -> None:
        """A heading right above an article that has no h1 of its own is its title."""
        within, above = list(keep), 0
        for i in range(1, len(keep)):
            within[i] = within[i] or within[self.parent[i]]
            if self.parent[i] == self.parent[root] and i < root and not self.out[i] and d.chars[i]:
                above = i
        if above and self.tag[above] in ("h1", "hgroup") and not any(t == "h1" and w and not o for t, w, o in zip(self.tag, within, self.out)):
            keep[above] = True

    def _leading(self, menus: list[bool], keep: list[bool], d: Densities) -> list[bool]:
        """Lists of links in an article are menus where they come before all of its text but headings; else they are part of it."""
        within, below = list(keep), list(menus)
        for i in range(1, len(menus)):
            within[i], below[i] = within[i] or within[self.parent[i]], below[i] or below[self.parent[i]]
        first = next((node for node, text, linked in d.blocks if within[node] and not below[node] and not re.fullmatch("h[1-6]", self.tag[node]) and 2 * linked < len(text)), 0)
        return [m and i < first for i, m in enumerate(menus)]


class Densities:
    """Composite text densities of a page's nodes, and the node whose children's have the largest sum."""

    def __init__(self, page: Page):
        self.blocks = page.blocks()
        if not self.blocks:
            return
        n = len(page.tag)
        self.chars, self.linked = [0.0] * n, [0.0] * n
        for node, text, links in self.blocks:
            self.chars[node] += len(text)
            self.linked[node] += links
        self.tags, self.anchors = [float(x) for x in page.inner], [float(x) for x in page.links]
        for i in range(n - 1, 0, -1):
            if not page.out[i]:
                p = page.parent[i]
                self.chars[p] += self.chars[i]
                self.linked[p] += self.linked[i]
                self.tags[p] += self.tags[i] + 1
                self.anchors[p] += self.anchors[i]
        whole = self.linked[0] / self.chars[0]
        self.density = [_density(c, t, lc, lt, whole) for c, t, lc, lt in zip(self.chars, self.tags, self.linked, self.anchors)]
        self.sums = [0.0] * n
        for i in range(1, n):
            if not page.out[i]:
                self.sums[page.parent[i]] += self.density[i]
        self.best = max(range(n), key=lambda i: (self.sums[i], -i))
        self.path = [self.best]
        while self.path[-1]:
            self.path.append(page.parent[self.path[-1]])


def _density(chars: float, tags: float, linked: float, anchors: float, whole: float) -> float:
    """Composite text density: characters per tag, by how much of it is links."""
    if not chars:
        return 0.0
    tags = max(tags, 1.0)
    plain = max(chars - linked, 1.0)
    base = log(chars / plain * linked + whole * chars + e)
    odds = chars / max(linked, 1.0) * tags / max(anchors, 1.0)
    return max(0.0, chars / tags * log(max(odds, 1e-9)) / log(base) if base > 1 + 1e-9 else chars / tags * log(max(odds, 1.0) + e))


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; of equal names the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def _other(own: dict[str, str], heading: bool = False) -> int:
    """2 if a class, id or role is the name of something beside the article, 1 if part of one is; ids of headings are anchors.

    A name of several parts is such a name if its other parts say nothing else.
    """
    found = 0
    for name in ("class", "role", *(() if heading else ("id",))):
        for word in own.get(name, "").split():
            if word.lower() in OTHER_NAMES:
                return 2
            parts = [x.lower() for x in _PARTS.findall(word)]
            others = [x in OTHER_NAMES for x in parts]
            if any(others):
                found = max(found, 2 if all(o or x in AROUND_NAMES for o, x in zip(others, parts)) and len(parts) > 1 else 1)
    return found


#: Parts of a name: between marks and digits, and from one capital to the next.
_PARTS = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _hidden(own: dict[str, str]) -> bool:
    return "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in "".join(own.get("style", "").lower().split())


def main_text(source: str | None) -> str:
    return Page(source or "").text()


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` without their html, with its main text and n_chars (code points).

    Null, empty and textless pages give an empty text. White space inside a
    block becomes one space; blocks are joined by empty lines. Broken markup
    (open comments, unclosed or crossed tags, stray quotes) is read as browsers
    would, as far as text goes; a tag that the page doesn't end takes the rest.
    Pages of any length are read whole. Of nodes with equal sums the first is
    taken. Taken names get a leading underscore; repeated rows give
    repeated rows; an empty table gives none.
    """
    kept = [c for c in pages.columns if c != source]
    schema = grown(pages.select(*[F.col(f"`{c}`") for c in kept]).schema, ("text", "string"), ("n_chars", "long"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, source):
                texts = [main_text(x) for x in part.column(source).to_pylist()]
                cols = [*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return pages.mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; cases as in ``extract``."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
