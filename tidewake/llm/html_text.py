"""Main text of web pages: boosted trees over block elements, decoded along the tree.

A page is cut into block elements; inline markup only marks link text. Each block has features of its tag, of the tokens
in its class, id and role, of those of its ancestors, of the density of text and links in its subtree, of its depth and
of its siblings. Boosted trees give each block the log odds of being article. The decoding then takes the choice of
greatest total likelihood in which a block below a dropped block is dropped too: what a block holds follows from one
pass up the tree, and what is kept from one pass down.

The trees are fitted on layouts of many kinds, in which sentences of a bounded sample of the table's pages fill articles,
menus, headers, footers, side bars, notices, adverts, forms and comments; labels are known as the layouts are made here.

Cases: a null or empty page, or one without kept blocks, has the empty text; elements that are never closed end with
their parent; unknown tags are blocks; stray end tags are ignored; deep nesting needs no recursion.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm import gbt
from tidewake.llm.common import chunks, text_bytes

#: Pages whose sentences fill the training layouts, and training pages made of them.
SAMPLE_PAGES = 200
TRAIN_PAGES = 800
#: Bytes of pages that are classified together (or one longer page).
TOGETHER = 1 << 19

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag, and elements without article text of their own.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = RAW | frozenset("head noscript template svg math object canvas audio video select button datalist map dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: An element of the key ends where one of the values starts, up to the nearest holder.
CLOSED_BY = {"p": frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"])}
HOLDERS = frozenset("table ul ol dl div article section body html td th blockquote main aside".split())

#: Tags with a feature of their own; fixed values.
TAGS = "article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table td blockquote pre figure figcaption dl body".split()
#: Kinds of tokens in class, id and role; fixed values.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc skip",
    "head": "header masthead banner topbar branding logo site-header top",
    "foot": "footer foot legal copyright colophon contentinfo bottom imprint",
    "side": "sidebar side aside rail related recommended popular trending widget teaser more complementary",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad dfp",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay paywall disclaimer toast warning",
    "comment": "comment comments discussion replies reply disqus respond thread reader-comments feedback",
    "share": "share social sharing follow twitter facebook tags meta byline author",
    "form": "form login signup subscribe newsletter search search-form contact register",
    "content": "content article post main body entry story text article-body post-content entry-content page prose",
}
KIND_OF = {t: k for k, kind in enumerate(TOKENS) for t in TOKENS[kind].split()}
TAG_OF = {t: k for k, t in enumerate(TAGS)}
#: By tag (the last place is for others): unit vectors, parts at a page's edge, and elements for articles.
ONE_HOT = np.eye(len(TAGS) + 1)
EDGE = np.array([t in ("nav", "header", "footer", "aside", "form") for t in TAGS] + [False])
ARTICLE = np.array([t in ("article", "main") for t in TAGS] + [False])

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z))", re.S)
#: Tags with a quote that never ends are read anew from each of their signs; after so many of them in a page a tag ends with
#: the next ">", whatever is quoted.
BROKEN_TAGS = 200
PLAIN_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
HEAD = re.compile(r"</head\s*>|<body\b", re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Nested:
    """Tags of one name in a page, and for each place the end of the element that was opened before it.

    A tag changes the depth by one, so the element ends with the first later tag after which the depth is one less; the
    tags of each depth are listed once, and looked up for every element.
    """

    def __init__(self, source: str, name: str):
        self.starts, self.depths, depth = [], [], 0
        self.ends: dict[int, tuple[list[int], list[int]]] = {}
        for m in re.compile(rf"<(/?){name}\b[^>]*>", re.I).finditer(source, 0, source.rfind(">") + 1):  # so each try ends soon
            step = -1 if m[1] else int(name not in RAW and not m[0].endswith("/>"))
            if step:
                self.starts.append(m.start())
                self.depths.append(depth)
                depth += step
                if step < 0:
                    at, ends = self.ends.setdefault(depth, ([], []))
                    at.append(len(self.starts) - 1)
                    ends.append(m.end())
        self.depths.append(depth)

    def end(self, pos: int) -> int:
        """The end of the element that was opened just before pos; -1 if it never ends."""
        k = bisect.bisect_left(self.starts, pos)
        at, ends = self.ends.get(self.depths[k] - 1, ([], []))
        j = bisect.bisect_left(at, k)
        return ends[j] if j < len(ends) else -1


class Page:
    """Block elements of a page in order, and the pieces of text in them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.kinds, self.links = [-1], [-1], [0], [0], [0]
        self.labels: list[int] = []
        self.pieces: list[tuple[int, int, str]] = []  # block, run of text without a block edge, text
        self.sizes = [0]
        self.events: dict[str, object] = {}
        self.read(source)

    def text(self, at: int, flow: int, raw: str, linked: bool) -> None:
        if raw:
            self.pieces.append((at, flow, raw))
            size = len(raw) - raw.count(" ") // 8 if not raw.isspace() else 0
            self.sizes[at] += size
            self.links[at] += size * linked

    def read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open blocks
        opened: dict[str, int] = {}
        at, flow, link, pos, size, broken = 0, 0, 0, 0, len(source), 0
        while pos < size:
            begin = source.find("<", pos)
            if begin < 0:
                self.text(at, flow, source[pos:], link > 0)
                break
            m = (TAG if broken < BROKEN_TAGS else PLAIN_TAG).match(source, begin)
            if not m:
                broken += source[begin + 1 : begin + 2].isalpha() or source[begin + 1 : begin + 2] == "/"
                self.text(at, flow, source[pos : begin + 1], link > 0)
                pos = begin + 1
                continue
            if begin > pos:
                self.text(at, flow, source[pos:begin], link > 0)
            pos = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if name == "br" or name == "wbr":
                self.pieces.append((at, flow, " " if name == "br" else ""))
                continue
            if m[1]:
                if name in INLINE:
                    link = max(0, link - (name == "a"))
                elif opened.get(name):
                    while True:
                        gone, _ = stack.pop()
                        opened[gone] -= 1
                        if gone == name:
                            break
                    at, flow, link = stack[-1][1], flow + 1, 0
                continue
            if name in HIDDEN:
                pos = self.skip(source, name, pos, m[3].endswith("/"))
                continue
            if name in INLINE:
                link += name == "a"
                continue
            while (top := stack[-1][0]) in CLOSED_BY and name in CLOSED_BY[top]:
                stack.pop()
                opened[top] -= 1
            for k in range(len(stack) - 1, 0, -1):  # an open p, li or cell above inline leftovers
                if stack[k][0] in HOLDERS:
                    break
                if stack[k][0] in CLOSED_BY and name in CLOSED_BY[stack[k][0]]:
                    while len(stack) > k:
                        opened[stack.pop()[0]] -= 1
                    break
            flow += 1
            at = stack[-1][1]
            if name in VOID:
                continue
            self.tag.append(TAG_OF.get(name, -1))
            self.parent.append(at)
            self.depth.append(self.depth[at] + 1)
            self.sizes.append(0)
            self.links.append(0)
            self.kinds.append(self.kinds_of(m[3]) if "=" in m[3] else 0)
            if "data-label=" in m[3]:
                self.labels.append(len(self.tag) - 1)
            at, link = len(self.tag) - 1, 0
            stack.append((name, at))
            opened[name] = opened.get(name, 0) + 1

    def skip(self, source: str, name: str, pos: int, closed: bool) -> int:
        """The place after a hidden element; one that never ends hides nothing but itself."""
        if closed and name not in RAW:
            return pos
        if name == "head":
            if name not in self.events:
                self.events[name] = [(m.start(), m.end(), m[0].startswith("</")) for m in HEAD.finditer(source)]
            found = self.events[name]
            k = bisect.bisect_left(found, (pos,))
            return pos if k == len(found) else found[k][1] if found[k][2] else found[k][0]
        if name not in self.events:
            self.events[name] = Nested(source, name)
        end = self.events[name].end(pos)
        return end if end >= 0 else len(source) if name in RAW else pos

    @staticmethod
    def kinds_of(attributes: str) -> int:
        out = 0
        for m in NAMED.finditer(attributes):
            for token in (m[1] or m[2] or m[3] or "").lower().split():
                whole = KIND_OF.get(token)
                for part in [token] if whole is not None else re.split(r"[-_:0-9]+", token):
                    kind = KIND_OF.get(part)
                    if kind is not None:
                        out |= 1 << kind
        return out

    def features(self) -> np.ndarray:
        n, kinds = len(self.tag), len(TOKENS)
        tag, parent, depth, own, links, mask = (np.array(x, np.int64) for x in (self.tag, self.parent, self.depth, self.sizes, self.links, self.kinds))
        below, linked, tags, paragraphs, upper = own.copy(), links.copy(), np.ones(n, np.int64), (tag == TAG_OF["p"]).astype(np.int64), mask.copy()
        inherited_tag = np.where(EDGE[tag], tag, -1)
        in_article = ARTICLE[tag].copy()
        for k in range(n - 1, 0, -1):
            p = parent[k]
            below[p] += below[k]
            linked[p] += linked[k]
            tags[p] += tags[k]
            paragraphs[p] += paragraphs[k]
        place, siblings = np.zeros(n), np.zeros(n, np.int64)
        for k in range(1, n):
            p = parent[k]
            upper[k] |= upper[p]
            if inherited_tag[k] < 0:
                inherited_tag[k] = inherited_tag[p]
            in_article[k] |= in_article[p]
            place[k] = siblings[p]
            siblings[p] += 1
        up = np.maximum(parent, 0)
        before = np.cumsum(own) - own
        total = max(1, int(below[0]))
        one = ONE_HOT[tag]
        bits = (mask[:, None] >> np.arange(kinds)) & 1
        upper_bits = (upper[up][:, None] >> np.arange(kinds)) & 1
        columns = [depth, np.log1p(own), np.log1p(below), linked / np.maximum(below, 1), below / tags, below / total, before / total, below / np.maximum(below[up], 1), place / np.maximum(siblings[up], 1), np.log1p(siblings[up]), np.log1p(siblings), np.log1p(paragraphs), paragraphs / tags, np.log1p(below[up]), linked[up] / np.maximum(below[up], 1), np.log1p(paragraphs[up]), in_article, linked[up] / np.maximum(below[up], 1)]
        return np.concatenate([np.stack(columns, axis=1), one, ONE_HOT[inherited_tag][:, EDGE], bits, upper_bits], axis=1)

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """Which blocks are kept: the likeliest choice in which no block is kept below a dropped one.

        A block that holds text of its own counts by its length, one without text little.
        """
        n = len(self.parent)
        weight = 0.1 + np.sqrt(np.array(self.sizes, float))
        keep, drop = -np.logaddexp(0, -margin) * weight, -np.logaddexp(0, margin) * weight
        keep, drop, parent = keep.tolist(), drop.tolist(), self.parent
        chosen = [False] * n
        for k in range(n - 1, 0, -1):
            chosen[k] = keep[k] > drop[k]
            keep[parent[k]] += max(keep[k], drop[k])
            drop[parent[k]] += drop[k]
        chosen[0] = True
        for k in range(1, n):
            chosen[k] = chosen[k] and chosen[parent[k]]
        return np.array(chosen)

    def kept_text(self, chosen: np.ndarray) -> str:
        blocks, last = [], None
        for at, flow, raw in self.pieces:
            if chosen[at]:
                if flow != last:
                    blocks.append([])
                    last = flow
                blocks[-1].append(raw)
        return " ".join(filter(None, (" ".join(html.unescape("".join(b)).split()) for b in blocks)))


def _tag_of(rng: np.random.Generator, semantic: str, tokens: str, plain: float = 0.4) -> tuple[str, str]:
    """An element for a part of a layout: its own tag, or a div (or section) with a telling class or id, or neither."""
    style = rng.random()
    names = tokens.split()
    token = names[rng.integers(len(names))]
    token = rng.choice([token, f"{token}-{rng.choice(['wrap', 'box', 'area', 'inner', 'list'])}", f"site-{token}", f"{token} {rng.choice(['row', 'wide', 'dark', 'x1'])}"])
    where = rng.choice(["class", "id"])
    if style < plain and semantic:
        return semantic, f' {where}="{token}"' if rng.random() < 0.4 else ""
    return str(rng.choice(["div", "div", "section"])), f' {where}="{token}"'


def training_page(rng: np.random.Generator, words: list[str]) -> str:
    """A page of a random layout; blocks of the article carry data-label."""

    def some(a: int, b: int) -> str:
        n = int(rng.integers(a, b))
        at = rng.integers(0, len(words), n)
        return " ".join(words[k] for k in at) + rng.choice([".", ".", "", "!"])

    def wrap(name: str, attributes: str, inner: str, label: bool = False) -> str:
        return f"<{name}{attributes}{' data-label=1' if label else ''}>{inner}</{name}>"

    def menu(n: int) -> str:
        item = lambda: f'<a href="/x">{some(1, 4)}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if rng.random() < 0.7 else " ".join(item() for _ in range(n))

    def part(kind: str) -> str:
        t = TOKENS
        if kind == "menu":
            return wrap(*_tag_of(rng, "nav", t["menu"]), menu(int(rng.integers(3, 12))))
        if kind == "head":
            return wrap(*_tag_of(rng, "header", t["head"]), f"<{rng.choice(['div', 'p', 'h2', 'h1'])}>{some(1, 6)}" + (menu(4) if rng.random() < 0.5 else "") + (f"<p>{some(3, 10)}</p>" if rng.random() < 0.5 else ""))
        if kind == "foot":
            return wrap(*_tag_of(rng, "footer", t["foot"]), rng.choice([f"&copy; {some(2, 12)}", f"<p>{some(4, 30)}</p>", menu(5) + f"<p>{some(5, 20)}</p>"]))
        if kind == "side":
            return wrap(*_tag_of(rng, "aside", t["side"]), f"<h3>{some(1, 4)}</h3>" + (menu(int(rng.integers(2, 8))) if rng.random() < 0.6 else "".join(f"<p>{some(5, 40)}</p>" for _ in range(rng.integers(1, 4)))))
        if kind == "advert":
            return wrap(*_tag_of(rng, "", t["advert"]), rng.choice([some(3, 25), f"<p>{some(5, 30)}</p>", f'<a href="/b">{some(3, 12)}</a>']))
        if kind == "notice":
            return wrap(*_tag_of(rng, "", t["notice"]), rng.choice([some(6, 30), f"<p>{some(6, 40)}</p><button>OK</button>"]))
        if kind == "form":
            return wrap(*_tag_of(rng, "form", t["form"], 0.7), f"<label>{some(1, 4)}</label><input type=text><p>{some(2, 12)}</p><button>{some(1, 2)}</button>")
        if kind == "share":
            return wrap(*_tag_of(rng, "", t["share"]), rng.choice([menu(3), some(2, 8), f"<p>{some(2, 8)}</p>"]))
        items = [wrap(*_tag_of(rng, "", "comment reply", 0), rng.choice([f"<b>{some(1, 3)}</b> <p>{some(5, 60)}</p>", f"<p>{some(5, 40)}</p><p>{some(3, 40)}</p>", some(4, 30)])) for _ in range(rng.integers(1, 6))]
        if rng.random() < 0.3:
            items = ["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"]
        return wrap(*_tag_of(rng, "section", t["comment"], 0), f"<h3>{some(1, 3)}</h3>" + "".join(items))

    def article() -> str:
        out = [f"<h1 data-label=1>{some(1, 12)}</h1>"] if rng.random() < 0.8 else []
        if out and rng.random() < 0.25:
            out = [f"<header data-label=1>{out[0]}" + (f"<p data-label=1>{some(4, 20)}</p>" if rng.random() < 0.4 else "") + "</header>"]
        short = rng.random() < 0.3  # a few words in one or two paragraphs
        for _ in range(rng.integers(1, 3) if short else rng.integers(1, 14)):
            u = rng.random() * (0.8 if short else 1)
            if u < 0.72:
                inner = some(1, 12) if short else some(1 if rng.random() < 0.3 else 4, 120)
                if rng.random() < 0.2:
                    inner += f' <a href="/y">{some(1, 5)}</a> {some(2, 30)}'
                if rng.random() < 0.15:
                    inner = "<b>" + inner + "<br>"
                out.append(f"<p data-label=1>{inner}" + ("</p>" if rng.random() < 0.85 else ""))
            elif u < 0.82:
                out.append(f"<h2 data-label=1>{some(2, 8)}</h2>")
            elif u < 0.88:
                out.append("<ul data-label=1>" + "".join(f"<li data-label=1>{some(3, 30)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif u < 0.89:
                out.append(f"<blockquote data-label=1><p data-label=1>{some(8, 50)}</p></blockquote>")
            elif u < 0.90:
                out.append("<table data-label=1>" + "".join(f"<tr data-label=1><td data-label=1>{some(1, 6)}</td><td data-label=1>{some(1, 6)}</td></tr>" for _ in range(rng.integers(1, 5))) + "</table>")
            elif u < 0.91:
                out.append(f"<div data-label=1>{some(8, 80)}</div>")
            else:
                out.append(part(str(rng.choice(["advert", "advert", "side", "share", "form", "notice", "comment"]))))
        return "".join(out)

    inner, u = article(), rng.random()
    name, attributes = ("article", rng.choice(["", "", ' class="post"'])) if u < 0.45 else ("main", "") if u < 0.55 else (str(rng.choice(["div", "section", "td"])), f' {rng.choice(["class", "id"])}="{rng.choice(TOKENS["content"].split())}"' if u < 0.85 else rng.choice(["", ' class="c12"']))
    make = rng.random()
    if make < 0.05:  # nothing but the article
        return inner if make < 0.03 else f"<html><body data-label=1>{inner}</body></html>"
    if make < 0.08:  # a page in the cells of a table
        cells = [f"<tr><td>{menu(4)}</td></tr>", f"<tr data-label=1><td data-label=1>{inner}</td></tr>", f"<tr><td>{some(2, 8)} {menu(2)}</td></tr>"]
        return f"<html><body data-label=1><table data-label=1>{''.join(cells)}</table></body></html>"
    if make < 0.16:  # a token of another kind around the article
        other = str(rng.choice(["side", "share", "menu", "head", "notice"]))
        name, attributes = str(rng.choice(["div", "section"])), f' class="{rng.choice(TOKENS[other].split())}-{rng.choice(["text", "body", "story", "page"])}"'
    body = wrap(name, attributes, inner + (part("comment") if rng.random() < 0.2 else ""), True) if rng.random() < 0.9 else inner
    if rng.random() < 0.4:
        side = part("side")
        body = wrap("div", rng.choice(["", ' id="wrap"', ' class="container"', ' class="row"']), body + side if rng.random() < 0.6 else side + body, True)
    before = [part(k) for k in ("notice", "head", "menu", "advert", "form") if rng.random() < 0.5]
    after = [part(k) for k in ("share", "comment", "side", "advert", "form", "foot", "notice") if rng.random() < 0.4]
    return f"<html><head><title>{some(2, 8)}</title></head><body data-label=1>" + "".join(before) + body + "".join(after) + "</body></html>"


def fit(texts: list[str], pages: int = TRAIN_PAGES, seed: int = 5) -> gbt.Trees:
    """Trees of layouts that are filled with words of the sampled texts (or of plain syllables where there are none)."""
    rng = np.random.default_rng(seed)
    words = [w for t in texts for w in t.split()[:400]][:20_000] or [a + b for a in ("la", "mi", "ko", "ter", "an") for b in ("", "ra", "so", "ne")]
    x, y, w = [], [], []
    for _ in range(pages):
        page = Page(training_page(rng, words))
        label = np.zeros(len(page.tag), bool)
        label[page.labels] = True
        label[0] = True
        x.append(page.features())
        y.append(label)
        w.append(0.2 + np.sqrt(np.array(page.sizes, float)) / 4)
    return gbt.fit(np.concatenate(x), np.concatenate(y).astype(float), np.concatenate(w))


def extract(pages: DataFrame, trees: gbt.Trees, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(text_bytes(batch.column(1))[1], TOGETHER):
                part = batch.slice(a, b - a)
                parsed = [Page(s or "") for s in part.column(1).to_pylist()]
                margin = trees.margin(np.concatenate([p.features() for p in parsed]))
                cut = np.cumsum([len(p.tag) for p in parsed])[:-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.kept_text(p.decode(m)) for p, m in zip(parsed, np.split(margin, cut))], pa.string())], [id_col, "text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string")


def fitted(pages: DataFrame, html_col: str = "html", most: int = SAMPLE_PAGES) -> gbt.Trees:
    """Trees for a table of pages: at most `most` different ones, chosen by hash, give the words of the layouts."""
    size = pages.filter(F.col(html_col).isNotNull()).agg(F.approx_count_distinct(F.xxhash64(html_col), 0.02)).first()[0]
    chosen = pages.filter(F.col(html_col).isNotNull()).filter(F.pmod(F.xxhash64(html_col), F.lit(1 << 20)) < min(1.0, 1.5 * most / max(1, size)) * (1 << 20)).select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h")).dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for s in batch.column(0).to_pylist():
                page = Page(s)
                texts.append(" ".join(page.kept_text(np.ones(len(page.tag), bool)).split()[:400]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    found = sorted(r["text"] for r in chosen.mapInArrow(run, "text string").collect())
    return fit(found[:most])
