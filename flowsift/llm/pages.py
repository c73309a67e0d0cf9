"""Main text of web pages by template deduction.

The tokens of a page are its structural places: the path of element names and
classes from the root.  Containers of one path under one parent differ in
context, so they are told apart by their order, counted from the first and from
the last sibling: menu, article and footer stay three tokens even where all are
plain ``div``s.  Over the pages of one host every token has an occurrence vector
(how often it occurs on each page).  Tokens with equal vectors form an
equivalence class.  A class is valid if its tokens occur on enough of the host's
pages and equally often on each; valid classes nest by their paths and make up
the host's template, elements like nav, footer and aside included.

A template token is boilerplate if its text is the same on all of its pages, or
takes few values for their number and is a small share of the host's text, or
is mostly links, or if it is flat, very small, and lies beside the one place
that holds nearly all text.  All that remains between boilerplate are the slots, and every
page's text is what its slots hold.  Names are evidence besides: elements such
as nav, footer or form are left out, and a class or id that is a word of
``NOISE`` means boilerplate unless the template shows blocks and half of the
host's text there.  An article or main element only breaks ties: slots outside
it are left out where it holds more of the page's slot text than they do.

Vectors are compared by a sum (xor of hashes of page and count).  What is
gathered of a host are its template tokens, at most twice those of a page.

Text: blocks in page order, white space inside a block as one space, character
references decoded.

Null and empty pages give an empty text.  Broken markup is read as browsers do:
unclosed elements end with their parents.  Repeated rows get equal texts and
count as one page in the template.  Pages without a host are one site.  An
empty table gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.text import small, unused
from flowsift.llm.urls import host_and_path
from flowsift.session import cut_lineage

#: Elements whose content is never main text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe input label math menu nav noscript object "
    "option script select style svg template textarea title video".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are told apart by their order among equal siblings.
CONTAINERS = frozenset("article aside center details div dl fieldset footer form header main nav ol section table ul".split())
#: Elements whose text no reader sees as text.
MUTE = frozenset("audio button canvas datalist embed head iframe input math noscript object option script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never boilerplate themselves.
FRAMES = frozenset("article body html main".split())
#: Classes and ids that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments cookie cookies consent disqus footer "
    "form header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond "
    "share sharing sidebar signup skyscraper social sponsor sponsored subscribe teaser toolbar widget".split()
)
_CLOSED_BY = {  # an open element that ends where another one starts
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"},
}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_PLACE = re.compile(r"[/#$]")  # marks of a token's place

#: A template token occurs on at least this share of the host's pages.
LEAST_SHARE = 0.5
#: Distinct pages from which text that is the same on all of them is the template's.
LEAST_PAGES = 3
#: Pages for each different text, and parts of the host's text for each part of the token's, from which a text that varies little is the template's.
FEW_TEXTS = 10
#: Share of the text left in a place that its main child holds at least, and of the host's text that what lies beside it holds at most.
MAIN_SHARE = 0.8
SMALL_SHARE = 0.1


class _Page(HTMLParser):
    """Elements of one page as a tree, its text pieces in order, and where blocks begin and end.

    ``nodes`` holds (parent, element, name with classes, left out by its element, inside an article);
    ``events`` holds (node, text), or (node, None) at the edge of a block.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[int, str, str, bool, bool]] = []
        self.events: list[tuple[int, str | None]] = []
        self.stack: list[int] = []
        self.feed(html)
        self.close()

    def _tag(self, at: int = -1) -> str:
        return self.nodes[self.stack[at]][1]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.handle_edge()
            while self.stack and self._tag() == "p":
                self.stack.pop()
        while self.stack and tag in _CLOSED_BY.get(self._tag(), ()):
            self.stack.pop()
        if tag in VOID:
            if tag in ("br", "hr"):
                self.handle_data(" ")
            return
        named = dict(attrs)
        marks = " ".join(filter(None, (named.get("class"), named.get("id"), named.get("role")))).lower()
        parent = self.stack[-1] if self.stack else -1
        dropped, article = self.nodes[parent][3:] if self.stack else (False, False)
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "")
        dropped = dropped or hidden or (tag in DROPPED and not (tag == "header" and article))
        article = article or tag in ("article", "main") or named.get("role") == "main"
        name = tag + ("." + ".".join(_PLACE.sub("_", _DIGITS.sub("0", marks)).split()) if marks else "")
        self.stack.append(len(self.nodes))
        self.nodes.append((parent, tag, name, dropped, article))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.handle_edge()
        for at in range(len(self.stack) - 1, -1, -1):
            if self._tag(at) == tag:
                del self.stack[at:]
                return
            if self._tag(at) in ("article", "body", "table") and tag not in ("body", "html"):
                return  # a stray end tag does not close what is around it

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.events.append((self.stack[-1] if self.stack else -1, data))

    def handle_edge(self) -> None:
        self.events.append((self.stack[-1] if self.stack else -1, None))

    def tokens(self) -> list[tuple[str, ...]]:
        """Tokens of every node: its path, and for containers also the path with their place from the last sibling."""
        last: dict[tuple[int, str], int] = {}
        place = []
        for parent, tag, name, _, _ in self.nodes:
            last[parent, name] = last.get((parent, name), 0) + 1
            place.append(last[parent, name])
        found: list[tuple[str, ...]] = []
        for (parent, tag, name, _, _), k in zip(self.nodes, place):
            base = f"{found[parent][0] if parent >= 0 else ''}/{name}"
            if tag not in CONTAINERS:
                found.append((base,))
            else:
                found.append((base if k == 1 else f"{base}#{k}", f"{base}${last[parent, name] - k + 1}"))
        return found


def _element(path: str) -> str:
    """Name of the path's last element."""
    return path[path.rfind("/") + 1:].split(".")[0].split("#")[0].split("$")[0]


def noisy(path: str) -> bool:
    """Whether a class or id of the path's last element is a word of ``NOISE``."""
    name = path[path.rfind("/") + 1:].split("#")[0].split("$")[0]
    return not NOISE.isdisjoint(name.split(".")[1:])


def census(html: str) -> dict[str, list[int]]:
    """For each token of a page how often it occurs, the text and link text below it, and a digest of these."""
    page = _Page(html)
    tokens, found = page.tokens(), {}
    above: list[tuple[tuple[str, ...], bool, bool]] = []  # tokens of a node and all around it; in a link; in a heading
    for (parent, tag, _, _, _), own in zip(page.nodes, tokens):
        around, link, heading = above[parent] if parent >= 0 else ((), False, False)
        above.append(((*around, *own), link or tag == "a", heading or tag in HEADINGS))
        if tag not in MUTE:
            for token in own:
                found.setdefault(token, [0, 0, 0, 0])[0] += 1
    mute = []
    for parent, tag, _, _, _ in page.nodes:
        mute.append(tag in MUTE or parent >= 0 and mute[parent])
    for node, data in page.events:
        data = data.strip() if data else ""
        if not data or node < 0 or mute[node]:
            continue
        around, link, heading = above[node]
        kind = 2 if link and not heading else 1
        mark = zlib.crc32(data.encode(errors="replace")) + 1
        for token in around:
            own = found[token]
            own[kind] += len(data)
            own[3] = (own[3] * 0x9E3779B97F4A7C15 + mark) & 0x7FFFFFFFFFFFFFFF
    return found


def extract(html: str, cut: frozenset[str], kept: frozenset[str] | None) -> str:
    """Text of the slots: of the article if it holds more of it, else of all; ``kept`` are tokens not cut for their names (None: all)."""
    page = _Page(html)
    out: list[bool] = []
    for (parent, tag, _, dropped, _), own in zip(page.nodes, page.tokens()):
        around = parent >= 0 and out[parent]
        boiler = tag not in FRAMES and (not cut.isdisjoint(own) or kept is not None and noisy(own[0]) and kept.isdisjoint(own))
        out.append(around or dropped or boiler)
    blocks: list[tuple[bool, str]] = []
    parts: list[str] = []
    within = False

    def end() -> None:
        block = _SPACE.sub(" ", "".join(parts)).strip()
        if block:
            blocks.append((within, block))
        parts.clear()

    for node, data in page.events:
        if data is None:
            end()
        elif node < 0 or not out[node]:
            article = node >= 0 and page.nodes[node][4]
            if article != within:
                end()
                within = article
            parts.append(data)
    end()
    inner = sum(len(b) for inside, b in blocks if inside)
    only = inner > sum(len(b) for inside, b in blocks if not inside)
    return " ".join(b for inside, b in blocks if inside or not only)


def beside_main(tokens: list[tuple], outer: set[str], cut: set[str]) -> list[str]:
    """Containers beside the place that holds nearly all text: flat ones with a very small share of it, whatever they say on each page.

    The walk goes from the place of all text to the one child that holds
    ``MAIN_SHARE`` of it and has blocks of its own, and ends where headings
    begin: what lies inside an article is never judged by its size.
    """
    text = {t[0]: t[2] for t in tokens}
    inside: dict[str, list[tuple]] = {}
    for t in tokens:
        inside.setdefault(t[0][:t[0].rfind("/")], []).append(t)
    whole = max(text.values(), default=0)
    at, found = min((p for p, n in text.items() if n == whole > 0), key=len, default=None), []
    while at is not None:
        children = inside.get(at, [])
        if any(_element(t[0]) in HEADINGS for t in children):
            break
        left = text[at] - sum(text[t[0]] for t in children if t[0] in cut and "$" not in t[0])
        main = [t for t in children if t[6] and t[0] in outer and "$" not in t[0] and t[2] >= MAIN_SHARE * left > 0]
        if len(main) != 1:
            break
        for path, pages, chars, links, _, valid, _ in children:
            if _element(path) in CONTAINERS and path not in outer and valid and pages >= LEAST_PAGES and chars + links <= SMALL_SHARE * whole:
                found.append(path)
        at = main[0][0]
    return found


def deduced(tokens: list[tuple[str, int, int, int, int, bool, bool]]) -> tuple[str | None, list[str], list[str]]:
    """Main slot, boilerplate and kept noisy tokens of one host.

    ``tokens`` are the template's: path, pages, text, link text, different texts, valid, once a page.
    """
    whole = max((t[2] for t in tokens), default=0)
    outer = {t[0][:t[0].rfind("/")] for t in tokens if _element(t[0]) in BLOCKS}  # hold blocks
    kept = sorted(t[0] for t in tokens if t[1] >= LEAST_PAGES and t[0] in outer and noisy(t[0]) and 2 * t[2] >= whole > 0)
    cut, below = [], {}
    for path, pages, text, links, texts, valid, _ in sorted(tokens):
        tag = _element(path)
        up = [path[:i] for i in range(1, len(path)) if path[i] == "/"]
        if tag in FRAMES or tag not in BLOCKS or any(u in below for u in up):
            continue
        few = texts == 1 or FEW_TEXTS * texts <= pages and FEW_TEXTS * (text + links) <= whole
        fixed = few and pages >= LEAST_PAGES and tag not in HEADINGS
        linked = links > text and tag not in HEADINGS
        if valid and (fixed or linked):
            cut.append(path)
        elif not (noisy(path) and path not in kept):
            continue
        below[path] = 0 if "$" in path else text  # a place from the last sibling is the same element's
    cut += beside_main(tokens, outer, set(cut))
    # the deepest place that holds all the text that is left
    left = {t[0]: t[2] - sum(n for b, n in below.items() if b == t[0] or b.startswith(t[0] + "/")) for t in tokens if t[6] and "$" not in t[0]}
    most = max(left.values(), default=0)
    slot = max((p for p, n in left.items() if n == most), key=lambda p: (len(p), p)) if most > 0 else None
    return slot, cut, kept


def templates(pages: DataFrame, url: str = "url", html: str = "html", least_share: float = LEAST_SHARE) -> DataFrame:
    """``site, slot, cut, kept``: each host's place that holds all main text, its boilerplate, and what is none despite its name."""
    site = host_and_path(F.col(url))[0]
    rows = pages.where(F.length(html) > 0).select(site.alias("site"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, ids, out = batch.column("site").to_pylist(), batch.column("page").to_pylist(), []
            for site, page, html in zip(sites, ids, batch.column("html").to_pylist()):
                out += [(site, page, path, *own) for path, own in census(html).items()]
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["site", "page", "token", "n", "chars", "links", "digest"])

    tokens = rows.mapInArrow(counted, "site string, page long, token string, n long, chars long, links long, digest long")
    once = tokens.groupBy("site", "token", "page").agg(*[F.max(c).alias(c) for c in ("n", "chars", "links", "digest")])
    # one row per host and token: how many pages, the vector's digest, the text
    vectors = cut_lineage(once.groupBy("site", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.when(F.min("digest") == F.max("digest"), 1).otherwise(F.greatest(F.lit(2), F.approx_count_distinct("digest", 0.02))).alias("texts")))
    totals = vectors.groupBy("site").agg(F.max("pages").alias("site_pages"))
    classes = vectors.groupBy("site", "pages", "vector").agg((F.max("most") == F.min("least")).alias("valid"))
    frequent = vectors.join(totals, "site").where(F.col("pages") >= least_share * F.col("site_pages"))
    facts = ["token", "pages", "chars", "links", "texts", "valid", (F.col("most") == 1).alias("once")]
    members = frequent.join(classes, ["site", "pages", "vector"]).groupBy("site").agg(F.collect_list(F.struct(*facts)).alias("tokens"))

    @F.udf("slot string, cut array<string>, kept array<string>")
    def template(own):
        return deduced([tuple(t) for t in own])

    return cut_lineage(members.select("site", template("tokens").alias("t")).select("site", "t.slot", "t.cut", "t.kept"))


def extracted(html: str, cut: Iterable[str] | None, kept: Iterable[str] | None) -> str:
    """What the slots of a page hold; if they are empty, all that is no boilerplate by its element."""
    return extract(html, frozenset(cut or ()), frozenset(kept or ())) or extract(html, frozenset(), None)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page instead of its html."""
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), out.lower())]
    site, cut, named, source = unused(pages, "_site", "_cut", "_kept", "_html")
    found = templates(pages, url, html).select(F.col("site").alias(site), F.col("cut").alias(cut), F.col("kept").alias(named))
    rows = pages.select(*kept, F.coalesce(F.col(html), F.lit("")).alias(source), host_and_path(F.col(url))[0].alias(site))
    met = rows.join(small(found), site, "left").select(*kept, cut, named, source)
    schema = met.select(*kept).withColumn(out, F.lit("")).schema

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(len(kept) + i).to_pylist() for i in range(3)]
            texts = [extracted(h, c, k) for c, k, h in zip(*given)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(texts, pa.string())], names=[*kept, out])

    return met.mapInArrow(slots, schema)
