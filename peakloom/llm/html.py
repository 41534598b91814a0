"""Main text of web pages by tree scoring.

A page is read once into a flat list of elements and text blocks. Elements that
hold no article by their tag or because they are hidden are left out with all
below them. So are forms and those that are named as furniture (menu, sidebar,
notice, advert, ...) unless half of the page's prose stands in them, and those whose
class, id or role names comments if there is prose beside them: neither a name nor a
form's tag alone deletes an article. A part of a sentence is kept whatever its name. Each
remaining paragraph passes points for its length and commas to its ancestors,
less the further up; a container's points are discounted by the share of its
text that is link text. The best container is kept; where others come near it,
the branches that hold them are kept as well, and of the siblings those that
score well or are prose by their tag and have few links.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
LEFT_OUT = RAW | frozenset(
    "head nav footer aside button label legend select option datalist dialog menu svg math canvas object audio video map".split()
)
FORMS = frozenset(("form", "fieldset"))
PARAGRAPHS = frozenset("p li dd dt td th pre blockquote figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(
    "html body main article section div header hgroup center ul ol dl table thead tbody tfoot tr figure details "
    "nav footer aside form fieldset dialog menu legend".split()
)
BLOCKS = PARAGRAPHS | HEADINGS | CONTAINERS
#: Elements whose start ends an open element of the same kind, within the given container.
IMPLIED_END = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
#: Nouns that name what is no article, and those that name one. A name is judged by its last word, the noun.
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
AGAINST = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner breadcrumb breadcrumbs cookie cookies consent gdpr "
    "footer foot masthead menu menus modal nav navbar navigation newsletter notice notices notification alert pager pagination popup promo "
    "promotion promoted related recommended search share sharing sharedaddy shoutbox sidebar sidebars sidenav skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets contentinfo complementary dialog copyright login signup paywall disclaimer".split()
)
FAVOUR = frozenset("article articles body content entry main page post story text blog hentry".split())
#: Words that may follow the noun: comment-list, ad-slot, sidebar-left.
PARTS = frozenset(
    "list area section box block container wrapper wrap inner outer panel bar slot unit left right top bottom primary secondary links link buttons "
    "icons form thread group holder module region message text posts items widget".split()
)

#: A comment, a tag or a declaration. Nothing is given back once read, so that broken markup costs no more than other text.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][\w:.@-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")


def _named(name: str, inside: bool) -> str:
    """What one whole name of an element says: comments, against, lowers, favour or nothing. inside: it stands in an article."""
    words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
    favour = any(w in FAVOUR for w in words)
    nouns = words[:]
    while len(nouns) > 1 and nouns[-1] in PARTS and not favour:
        nouns.pop()
    noun = nouns[-1] if nouns else ""
    if noun in COMMENTS:
        return "comments"
    if noun in AGAINST or noun == "header" and not inside and not favour:
        return "against"
    return "favour" if favour else "lowers" if any(w in AGAINST for w in words) else ""


def _looked_at(attributes: str, inside: bool) -> tuple[str, int]:
    """What an element's attributes make of it (hidden, comments, against or nothing), and the points its names give."""
    said: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            said.update(_named(name, inside) for name in value.split())
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return "hidden", 0
    out = "comments" if "comments" in said else "against" if "against" in said else ""
    return out, 25 * ("favour" in said) - 25 * ("lowers" in said or out == "against")


class _Page:
    """Elements (parent, tag, points, whether a name speaks against them) and blocks (owner, text, length of link text) of a page in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.points, self.out, self.against, self.comments = [-1], ["#root"], [0.0], [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._named: list[bool] = [False]  # for each element, whether it or one above it in its block is named furniture
        self._furniture = 0
        self._stack, self._block_at = [0], [0]
        self._at: dict[str, list[int]] = defaultdict(list)  # places on the stack by tag
        self._pieces: list[str] = []
        self._links = 0
        self._in_link = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join(html.unescape("".join(self._pieces)).split())
            if text and self._furniture < 0.9 * len(text):
                self.blocks.append((self._stack[self._block_at[-1]], text, min(self._links, len(text))))
            self._pieces = []
        self._links = self._furniture = 0

    def _pop(self) -> None:
        tag = self.tag[self._stack.pop()]
        self._at[tag].pop()
        if self._block_at[-1] == len(self._stack):
            self._block_at.pop()
        self._in_link -= tag == "a"

    def _last(self, tags: frozenset[str] | tuple[str, ...]) -> int:
        """Place on the stack of the innermost open element of tags; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=0)

    def _close(self, tags: tuple[str, ...], stop: frozenset[str] | tuple[str, ...]) -> None:
        """Close up to the innermost open element of tags that no element of stop shields."""
        at = self._last(tags)
        if at and at >= self._last(stop):
            while len(self._stack) > at:
                self._pop()

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        for_text = self._text
        match = _TAG.search(source, 0)
        while match:
            if match.start() > at:
                for_text(source[at : match.start()])
            at = match.end()
            if match[2]:
                tag = match[2].lower()
                if match[1]:
                    self._end(tag)
                else:
                    self._start(tag, match[3])
                    if tag in RAW and not match[3].endswith("/"):
                        end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                        at = end.end() if end else n
                        self._end(tag)
            match = _TAG.search(source, at)
        if at < n:
            for_text(source[at:])

    def _text(self, text: str) -> None:
        if not self.out[self._stack[-1]]:
            self._pieces.append(text)
            if self._in_link > 0:
                self._links += len(text.strip())
                self._furniture += len(text.strip()) if self._named[self._stack[-1]] else 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in BLOCKS or tag == "hr":
            self._flush()
            self._close(("p", *HEADINGS) if tag in HEADINGS else ("p",), CONTAINERS | (PARAGRAPHS - {"p"}))
            while self._in_link > 0 and self.tag[self._stack[-1]] not in BLOCKS and len(self._stack) > 1 and tag != "div":
                self._pop()
            if tag in IMPLIED_END:
                same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                self._close(same, IMPLIED_END[tag])
        if tag in VOID:
            return
        above = self._stack[-1]
        out, said, points = self.out[above] or tag in LEFT_OUT, "", 0.0
        inside = bool(self._at["article"] or self._at["main"])
        if not out and attributes.strip(" /"):
            said, points = _looked_at(attributes, inside)
            out = said == "hidden"
        out = out or tag == "header" and not inside
        if out and not self.out[above]:
            self._keep_before_hole()
        block, whole = tag in BLOCKS, tag in ("html", "body", "article", "main")
        self.parent.append(above)
        self.tag.append(tag)
        self.points.append(points + (25 if tag in ("article", "main") else 0))
        self.out.append(out)
        self.against.append(block and not whole and (said == "against" or tag in FORMS))
        self.comments.append(block and not whole and said == "comments")
        self._named.append(not block and (said in ("against", "comments") or self._named[above]))
        if attributes.endswith("/") and tag not in BLOCKS:
            return
        self._at[tag].append(len(self._stack))
        if tag in BLOCKS:
            self._block_at.append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        self._in_link += tag == "a"

    def _keep_before_hole(self) -> None:
        """What is left out inside a block parts words as white space does."""
        if self._pieces:
            self._pieces.append(" ")

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
        elif tag in BLOCKS:
            self._flush()
            self._close((tag,), () if tag in CONTAINERS else CONTAINERS - {"tr", "ul", "ol"})
        else:
            self._close((tag,), BLOCKS)


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _left_by_name(page: _Page) -> list[bool]:
    """Elements that are left out by name, or as forms, with all below them.

    Furniture holds less than half of the page's prose. Comments have prose beside them: what stands inside one more
    element named so is left out as soon as what stands outside is an article; if it is not, as where the name tells
    that a post has comments, the next ones inside are looked at.
    """
    n = len(page.tag)
    prose = [0.0] * n
    for owner, text, linked in page.blocks:
        if linked <= 0.5 * len(text):
            prose[owner] += _points(text)
    own = prose[:]
    for node in range(n - 1, 0, -1):
        prose[page.parent[node]] += prose[node]
    out, depth = [False] * n, [0] * n
    for node in range(1, n):
        few = prose[node] < max(SOME, 0.5 * prose[0])
        out[node] = out[page.parent[node]] or page.against[node] and few
        depth[node] = depth[page.parent[node]] + page.comments[node]
    if deepest := max(depth):
        at = [0.0] * (deepest + 1)
        for node in range(n):
            at[depth[node]] += 0.0 if out[node] else own[node]
        level = next((k for k in range(deepest) if at[k] >= max(SOME, 0.15 * sum(at[k + 1 :]))), deepest)
        out = [o or depth[node] > level for node, o in enumerate(out)]
    return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, joined by two line feeds; empty if there is none."""
    if not source:
        return ""
    page = _Page(source)
    gone = _left_by_name(page)
    blocks = [b for b in page.blocks if not gone[b[0]]]
    if not blocks:
        return ""
    n = len(page.tag)
    score, length, links = page.points[:], [0] * n, [0] * n
    scored = [False] * n
    for owner, text, linked in blocks:
        length[owner] += len(text)
        links[owner] += linked
        tag = page.tag[owner]
        if tag in HEADINGS or linked > 0.5 * len(text):
            continue
        points = _points(text)
        node = page.parent[owner] if tag in PARAGRAPHS else owner
        for share in (1.0, 0.5, 1 / 6, 1 / 9):
            if node < 0:
                break
            score[node] += points * share
            scored[node] = True
            node = page.parent[node]
    for node in range(n - 1, 0, -1):
        length[page.parent[node]] += length[node]
        links[page.parent[node]] += links[node]
    density = [links[k] / length[k] if length[k] else 0.0 for k in range(n)]
    final = [score[k] * (1 - density[k]) if scored[k] else 0.0 for k in range(n)]
    best = max(range(n), key=lambda k: (final[k], -k))
    if final[best] <= 0:
        return "\n\n".join(text for _, text, linked in blocks if linked <= 0.5 * len(text))
    kept, best = _kept(page, final, scored, length, density, best)
    # Lists of links belong to an article that they stand in, such as its references; elsewhere they are menus.
    menus, within = [False] * n, [False] * n
    for k in range(1, n):
        within[k] = within[page.parent[k]] or k == best and page.tag[k] not in ("html", "body")
        is_menu = page.tag[k] in ("ul", "ol", "table", "div", "section") and length[k] > 0 and density[k] > 0.66 and not within[k]
        menus[k] = menus[page.parent[k]] or is_menu
    return "\n\n".join(text for owner, text, _ in blocks if kept[owner] and not menus[owner])


#: Points that make some prose; less is a line or two.
SOME = 10.0


def _kept(page: _Page, final: list[float], scored: list[bool], length: list[int], density: list[float], best: int) -> tuple[list[bool], int]:
    """Which elements stand in the article (the best container, branches with others like it, and siblings that read like it), and the best."""
    n, parent = len(page.tag), page.parent
    above = [best]
    while above[-1] > 0:
        above.append(parent[above[-1]])
    if (article := next((k for k in above if page.tag[k] == "article"), None)) is not None:
        best = article
        above = above[above.index(article) :]
    below = [False] * n
    for k in range(1, n):
        below[k] = k == best or below[parent[k]]
    below[0] = best == 0
    line = set(above)
    cousins = [k for k in range(1, n) if final[k] >= 0.5 * final[best] and scored[k] and not below[k] and k not in line]
    roots = {best: best}  # branch that holds it -> itself, as children of the common ancestor
    top = parent[best] if best else -1
    if cousins:
        paths = []
        for k in cousins:
            path = [k]
            while path[-1] not in line:
                path.append(parent[path[-1]])
            paths.append(path)
        top = max((p[-1] for p in paths), key=above.index)  # the outermost common ancestor
        roots = {above[above.index(top) - 1]: best}
        for path in paths:
            whole = path + above[above.index(path[-1]) + 1 :]
            roots[whole[whole.index(top) - 1]] = path[0]
    bar, kept = max(SOME, 0.2 * final[best]), [False] * n
    kept[best] = best == 0
    follows: dict[int, bool] = {}  # whether the sibling after a heading is kept
    later = False
    for k in range(n - 1, 0, -1):
        if parent[k] != top or length[k] == 0:
            continue
        if page.tag[k] in HEADINGS:
            follows[k] = later and density[k] < 0.25
            continue
        prose = page.tag[k] in SIBLINGS and density[k] < 0.25
        later = follows[k] = k in roots or scored[k] and final[k] >= bar or prose
    for k in range(1, n):
        kept[k] = kept[parent[k]] or follows.get(k, False)
    return kept, best


#: Elements beside the best container that belong to it if they have few links.
SIBLINGS = frozenset(("p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure"))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the columns of keep, text, n_chars (code points of text).

    A null or empty page, and one without text, has the empty text. Markup that is cut off or badly nested is read
    as far as it goes, in time that grows with its length. A page is read whole. Further columns are not looked at.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in some.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"]
                )

    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep) + ", text string, n_chars long"
    return pages.select(*keep, F.col(html_col).cast("string").alias("__html")).mapInArrow(rows, schema)
