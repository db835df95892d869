"""Main text of web pages by tree scoring.

A page is read into a tree (:class:`Page`) as browsers do for text: elements that close themselves or each other, raw
scripts, unclosed tags. Elements that never hold an article (menus, footers, forms, scripts, hidden ones)
and those whose class, id or role says so (adverts, notices, sidebars, reader comments) are set aside. Of
the rest each paragraph gets a point, one for each comma and one for each hundred characters up
to three, less the share of its text that is links, and passes them to the elements it stands in: whole to the
nearest that can hold an article, half to the next, a sixth, an eighth and a tenth to those above. Elements also have
points of their own, by tag and name; all is discounted by the share of linked text. The
best element, or the ``article`` or ``main`` it stands in, is the container. Siblings go with it: those of
its own kind, headings and paragraphs beside it, and those with a fifth of its points. What is
left are its blocks in page order; only lists of links are still taken out.

Character references are decoded; white space (as Unicode has it, no-break spaces too) inside a block becomes one space, a
line break counts as white space; blocks are trimmed and joined by one space.

Defined results: null and empty pages, and pages without text, give an empty text. A page without any markup is
one block. If names set everything aside, names are not looked at. A very long page is read whole, and nesting of any
depth in linear time. Equal pages give equal texts, repeated rows equal rows; ties of points go to the element that comes first. An
empty table gives an empty one. Other columns pass through, whatever their names; those named like a
result (text, n_chars) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import over_batches

# Element names, as the markup language has them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt tr td th tbody thead tfoot".split())
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
#: An element of the first name ends at the start of one of the second, unless one of the third stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Choices of this operator.
#: Never part of an article; those of the second set only where they don't hold one.
NEVER = set("script style noscript template head title iframe object svg canvas button select textarea datalist dialog audio video map nav footer aside menu search".split())
SELDOM = {"form", "header"}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tooltip".split())
#: Elements that can hold an article; others only hand points on.
HOLDERS = set("body article main section div td center".split())
POINTS = {"article": 30, "main": 25, "section": 5, "div": 5, "td": 3}
#: Words of a class or id that speak against an element, at the start or the end of a name; ``ANYWHERE``: wherever.
AGAINST = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup sidebar sidebars sidenav aside rail widget widgets nav navbar navigation menu menus menubar breadcrumb breadcrumbs share sharing shares social related recommended recommendations "
    "footer foot header masthead topbar login search pagination pager paywall toolbar skip skiplink copyright disclaimer outbrain taboola teaser teasers hidden trending".split()
)
ANYWHERE = set("comment comments commentlist disqus respond replies".split())
UNLESS = set("has have with no not without is enable enabled show".split())
FOR = set("article content main post entry story text body blog page prose markdown".split())
LINKS, LINKED = 3, 0.66
COMMENTS = re.compile(r"(?i)\W*(\d+\s+|reader |user |all )?(comments?|replies|kommentare?|commentaires?|comentarios?|leave a (comment|reply)|post a comment)\W*(\(?\d+\)?)?\W*")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>|<[!?/][^>]*+>|<(?=[a-zA-Z/!?])[^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_NAMED = re.compile(r"(?i)\b(?:class|id|role|style|aria-hidden|itemprop|hidden)\b")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMA = re.compile("[,،、，]")


def _stands(name: str) -> int:
    """What a class or id says: below 0 against an element, above 0 for it."""
    words = [w.lower() for w in _PIECES.findall(name)]
    if not words or words[0] in UNLESS:
        return 0
    if not ANYWHERE.isdisjoint(words) or words[0] in AGAINST or words[-1] in AGAINST:
        return -1
    return int(not FOR.isdisjoint(words))


class Page:
    """The tree of a page: for each element (in page order) its tag, parent, last descendant and what is known of it; text runs; blocks."""

    def __init__(self, html: str, names: bool = True):
        self.tag, self.parent, self.kind = ["#"], [0], [""]
        self.against, self.good, self.gone = [False], [0], [False]
        self.runs: list[tuple[int, str]] = []
        self.blocks: list[list[int]] = [[]]  # of places in runs
        self.names = names
        self._read(html)
        self._measure()

    # Reading

    def _read(self, html: str) -> None:
        self.stack, self.open, at = [0], {}, 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(html, at)
                if close or name in ("script", "style"):
                    if name == "xmp":
                        self._text(html[at : close.start()], raw=True)
                    at = close.end() if close else len(html)
                self._end(name)
        if at < len(html):
            self._text(html[at:])

    def _text(self, text: str, raw: bool = False) -> None:
        if "&" in text and not raw:
            text = unescape(text)
        self.blocks[-1].append(len(self.runs))
        self.runs.append((self.stack[-1], text))

    def _edge(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self.open.get(name):
            return
        if name == "body":
            self._end("head")
        if name in CLOSES_P and self.open.get("p"):
            self._close({"p"}, {"table", "td", "th", "button"})
        if name in ENDS:
            self._close(*ENDS[name])
        if name not in INLINE:
            self._edge()
        elif name == "br":
            self._text("\n", raw=True)
            return
        n = len(self.tag)
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        against, good, kind, gone = False, 0, "", name in NEVER
        if attributes and _NAMED.search(attributes):
            found = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            kind, role, style = found.get("class", "").strip(), found.get("role", "").lower(), found.get("style", "").replace(" ", "").lower()
            told = [_stands(x) for x in [*kind.split(), *found.get("id", "").split()]]
            against, good = -1 in told or role in ROLES, int(1 in told or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody")
            bare = re.sub(r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)""", "", attributes).lower().split()
            gone = gone or "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden", "").lower() == "true" or "hidden" in found or "hidden" in bare
        self.kind.append(f"{name} {kind}" if kind else "")
        self.against.append(self.names and against and name not in ("html", "body"))
        self.good.append(good)
        self.gone.append(gone)
        if name not in VOID and not attributes.rstrip().endswith("/") or name not in VOID and name in CLOSES_P:
            self.stack.append(n)
            self.open[name] = self.open.get(name, 0) + 1

    def _pop(self) -> None:
        name = self.tag[self.stack.pop()]
        self.open[name] -= 1
        if name not in INLINE:
            self._edge()

    def _close(self, names: set[str], bar: set[str]) -> None:
        """End the outermost open one of ``names`` that no element of ``bar`` stands in."""
        if not any(self.open.get(x) for x in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[k]]
            if name in bar:
                return
            if name in names:
                while len(self.stack) > k:
                    self._pop()
                if not names & bar and len(names) == 1:
                    return
                return self._close(names, bar)
            if name in ("article", "section", "main", "div", "body", "aside", "nav") and names != {"p"} or name in ("article", "main", "body"):
                return  # an open cell or paragraph far above is no business of this element

    def _end(self, name: str) -> None:
        if name == "p" and not self.open.get("p"):
            return self._edge()
        if not self.open.get(name):
            return self._edge() if name not in INLINE else None
        if name in INLINE:
            for k in range(len(self.stack) - 1, 0, -1):
                tag = self.tag[self.stack[k]]
                if tag == name:
                    break
                if tag not in INLINE:
                    return None  # it stands outside this block and ends with what it stands in
        while self.tag[self.stack[-1]] != name:
            self._pop()
        self._pop()
        return None

    # Measuring

    def _measure(self) -> None:
        n = len(self.tag)
        for i in range(1, n):
            p = self.parent[i]
            self.gone[i] = self.gone[i] or self.gone[p]
        chars, keeps, self.last = [0] * n, [False] * n, list(range(n))
        for at, text in self.runs:
            if not self.gone[at]:
                chars[at] += len(text.strip())
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.last[p] = max(self.last[p], self.last[i])
            if not self.gone[i]:
                chars[p] += chars[i]
                keeps[p] = keeps[p] or keeps[i] or self.tag[i] in ("article", "main", "h1") and not self.against[i]
        inside = [False] * n  # of an article
        for i in range(1, n):
            p, tag = self.parent[i], self.tag[i]
            inside[i] = inside[p] or tag in ("article", "main") and not self.against[i]
            holds = keeps[i] and chars[i] >= 0.4 * chars[0]
            named = self.against[i] and (not holds or any(_stands(x) < 0 and not ANYWHERE.isdisjoint(w.lower() for w in _PIECES.findall(x)) for x in self.kind[i].split()[1:]))
            seldom = tag in SELDOM and not holds and not (tag == "header" and inside[p] and keeps[i])
            self.gone[i] = self.gone[i] or self.gone[p] or named or seldom
        self.chars, self.linked, self.links = [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
            self.links[i] = int(self.tag[i] == "a" and not self.gone[i])
        for at, text in self.runs:
            if not self.gone[at]:
                size = len(text.strip())
                self.chars[at] += size
                self.linked[at] += size * in_link[at]
        for i in range(n - 1, 0, -1):
            if not self.gone[i]:
                for amount in (self.chars, self.linked, self.links):
                    amount[self.parent[i]] += amount[i]
        self.holder = [0] * n  # the nearest element that can hold an article
        for i in range(1, n):
            self.holder[i] = i if self.tag[i] in HOLDERS else self.holder[self.parent[i]]
        self.texts: list[tuple[int, str]] = []  # the block's first element, its text
        for block in self.blocks:
            own = [k for k in block if not self.gone[self.runs[k][0]]]
            if own and (text := " ".join("".join(self.runs[k][1] for k in own).split())):
                first = next(k for k in own if self.runs[k][1].strip())
                self.texts.append((self._outer(self.runs[first][0]), text))

    def _outer(self, i: int) -> int:
        """The block an element of a line stands in."""
        while self.tag[i] in INLINE and i:
            i = self.parent[i]
        return i

    def density(self, i: int) -> float:
        return self.linked[i] / self.chars[i] if self.chars[i] else 0.0

    # Choosing

    def scores(self) -> dict[int, float]:
        """The points of the elements that paragraphs pass some to."""
        points: dict[int, float] = {}
        for at, text in self.texts:
            if self.tag[at] in HEADINGS:
                continue
            worth = (1 + len(_COMMA.findall(text)) + min(len(text) / 100, 3)) * (1 - min(1.0, self.density(at)))
            i = self.holder[at]
            for share in (1, 1 / 2, 1 / 6, 1 / 8, 1 / 10):
                if i not in points:
                    points[i] = POINTS.get(self.tag[i], 0) + 25 * self.good[i]
                points[i] += share * worth
                if not i:
                    break
                i = self.holder[self.parent[i]]
        return {i: x * (1 - self.density(i)) for i, x in points.items()}

    def container(self, points: dict[int, float]) -> int:
        """The best element, or the article (else the main part) it stands in."""
        best = max(points, key=lambda i: (points[i], -i))
        up, main = best, None
        while up:
            if self.tag[up] == "article":
                return up
            main = main or (up if self.tag[up] == "main" else None)
            up = self.parent[up]
        return main or best

    def siblings(self, top: int, points: dict[int, float]) -> list[int]:
        """The container and the siblings that go with it, in page order."""
        if not top or self.tag[top] == "body":
            return [top]
        least, p = max(10.0, 0.2 * points.get(top, 0)), self.parent[top]
        whole = self.tag[top] in ("article", "main")
        titled = any(self.tag[at] == "h1" and top <= at <= self.last[top] for at, _ in self.texts)
        out = []
        i = p + 1
        while i <= self.last[p]:  # children of p
            tag, density = self.tag[i], self.density(i)
            if i == top:
                out.append(i)
            elif not self.gone[i] and self.chars[i]:
                alike = bool(self.kind[top]) and self.kind[i] == self.kind[top] and density < 0.5
                rich = points.get(i, 0) >= least and (not whole or tag == self.tag[top] and not self.kind[i] and not self.kind[top])
                beside = not whole and density < 0.25 and tag in ("p", "blockquote", "pre", "figure", "table", "ul", "ol", "dl", "h2", "h3", "h4")
                if alike or rich or beside or tag == "h1" and i < top and not titled:
                    out.append(i)
            i = self.last[i] + 1
        return out

    def main_text(self) -> str:
        if not self.texts:
            return ""
        points = self.scores()
        if points:
            top = self.container(points)
        else:  # headings alone
            top = next((i for i, tag in enumerate(self.tag) if tag in ("article", "main") and self.chars[i] and not self.gone[i]), 0)
        spans = [(i, self.last[i]) for i in self.siblings(top, points)]
        lists = [False] * len(self.tag)  # elements that are but links
        roots = {i for i, _ in spans}
        for i in range(1, len(self.tag)):
            links = self.links[i] >= LINKS and self.density(i) > LINKED and self.tag[i] in ("ul", "ol", "dl", "div", "section", "table", "p")
            lists[i] = i not in roots and (lists[self.parent[i]] or links and not any(i <= r <= self.last[i] for r in roots))
        kept = [(at, text) for at, text in self.texts if not lists[at] and any(a <= at <= b for a, b in spans)]
        return " ".join(text for _, text in self._without_comments(kept))

    def _without_comments(self, kept: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """The blocks before a heading that only says comments, if no heading of its rank comes behind it."""
        for k in range(len(kept) - 1, 0, -1):
            at, text = kept[k]
            level = HEADINGS.get(self.tag[at], 0)
            if level >= 2 and len(text) < 40 and COMMENTS.fullmatch(text):
                if not any(HEADINGS.get(self.tag[i], 9) <= level for i, _ in kept[k + 1 :]):
                    return kept[:k]
        return kept


def main_text(html: str) -> str:
    """The main text of one page."""
    return Page(html).main_text() or Page(html, names=False).main_text()


def extract(df: DataFrame, html: str = "html", keep_html: bool = True) -> DataFrame:
    """Add ``text``, the main text of each page, and ``n_chars``, its code points."""
    added = [("text", T.StringType()), ("n_chars", T.LongType())]
    kept = [f for f in df.schema.fields if f.name not in {*dict(added), *([] if keep_html else [html])}]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) if page else "" for page in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return over_batches(df.select(*dict.fromkeys([html, *[f.name for f in kept]])), run, schema)
