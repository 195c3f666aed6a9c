"""Main text of web pages by equivalence classes of template tokens.

A page is read as a sequence of tokens: element starts (tag, class, id and, of boxes, which of their like, under the path of open elements) and text
runs under their path, within article and main elements, too. Over the different pages of one host (copies, pages of one token sequence,
count once under any number of urls) every token has an occurrence vector: how often each page holds it. Tokens with equal vectors form an equivalence class; a class is part of the host's template if its tokens
stand once on each of at least MIN_SHARE of the host's pages (MIN_PAGES at least) and there are two or more of them, one an
element. On a page the classes are laid over the token sequence, largest support first, and a class counts if all its tokens
are there and lie within one gap of every class already laid (or these within one of its gaps): the nested classes are the
template, what lies in its gaps are the slots. Template text is dropped.

The main slot follows from the template, too: from the page down, the block of the template that holds at least half of the text of the
slots around it, over all of the host's pages (template text doesn't count, nor do menus, forms and the like), as far as there is one. Blocks that
hold each other so are equal choices, and the outermost article or main element among them is taken, else the innermost block. On a page
that has this block its slots are the text, but for elements that say otherwise (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments of readers; blocks that are mostly links where the block is no article or main).

Where a host has no template, or a page not that block, names of elements decide: within article or main, else what is left.
Names of class and id never set html, body, main or an article with a name of its own aside. A main part within a block that is
set aside by a name is judged by the rest of the page: it counts if the name is a compound (has-sidebar) and it holds more text
than the page's other main parts, or than what stands outside of any; or if the page has no other text. A main part that the
template covers whole keeps its text.

Occurrence vectors are never gathered: copies are taken out by a digest of their tokens, map-side first; then a vector is represented
by two commutative 64-bit hashes over its pages, summed map-side per host and token, so a host that holds a third of all pages costs
a counter per token. A host's template is
bounded by the number of tokens that can stand on most of its pages. Pages are joined to their host's template; Spark
broadcasts the templates below its size limit and splits the hot host's pages above it.

Defined cases: null and empty html give empty text; a null url or one without a host belongs to the host ''; pages of a host
with fewer than MIN_PAGES different pages have no template and are judged by their elements; repeated rows each give a row; unclosed
and wrongly nested elements are closed as HTML implies, in one forward scan; a tag that never ends is text to the end of the page; character references are decoded once; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.url_filter import host_and_path
from ripplegraph.runtime import drop, materialize, ship

MIN_PAGES, MIN_SHARE = 4, 0.6
MASK = (1 << 64) - 1
OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "noembed", "noframes"}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
CLOSES = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "search", "fieldset"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adsbygoogle", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "cookie", "cookies", "consent", "notice", "notices", "disclaimer", "newsletter", "subscribe", "signup", "login", "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "popup", "modal", "overlay", "pagination", "pager", "widget", "toolbar", "skip"}
BOXES = {"html", "body", "div", "article", "main", "section", "center", "table", "tbody", "tr", "td", "dl", "form", "fieldset", "blockquote"}
STRUCTURAL = BLOCK | {"a", "td", "th", "button", "label", "span"}
PARAGRAPH_ENDS = ("table", "li", "div", "article", "section", "body", "td")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}


@dataclass
class Run:
    """A run of text: its token (0: white space only), kind of main part (0: none), whether it is aside, in a link, its block and the
    number of the box around it, and whether it is within the main slot's box."""

    token: int
    text: str
    main: int
    aside: bool
    link: bool
    block: int
    box: int
    inside: bool


@dataclass
class Page:
    tokens: list[tuple[int, bool]] = field(default_factory=list)  # (token, is it an element), in page order
    runs: list[Run] = field(default_factory=list)
    boxes: list[tuple[int, int, bool]] = field(default_factory=lambda: [(1, 0, False)])  # (token, number of the box around it, is it a main part)
    has_main: bool = False
    found: int = 0  # 1 if the main slot's box was met, 2 if that is a main part


#: Kinds of main part: one without doubt; one in a block whose compound name (with-menu, post-comments) has a word of NAMES; one in
#: a block that such a word names outright, or an article that is itself named so.
SURE, DOUBTED, NAMED = 1, 2, 3
_names: dict[tuple[str, str], tuple[str, bool, bool, int]] = {}


def _named(tag: str, attributes: str) -> tuple[str, bool, bool, int]:
    """The element's name without numbers, whether it starts a main part, whether it stands aside for sure, and whether it does by its
    names: 0 no, DOUBTED by a part of one, NAMED by a whole one."""
    key = (tag, attributes)
    if key not in _names:
        if len(_names) > 100_000:
            _names.clear()
        said = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        whole = f"{said.get('class', '')} {said.get('id', '')}".lower().split()
        named = NAMED if set(whole) & NAMES else DOUBTED if set(re.split(r"[^a-z]+", " ".join(whole))) & NAMES else 0
        main = tag in ("article", "main") or said.get("role", "").lower() in ("main", "article")
        if tag in ("html", "body", "main") or tag == "article" and not (whole and set(whole) <= NAMES):
            named = 0  # the page and its main parts; an article with no other name than comment or the like is a reader's or an advert
        aside = tag in ASIDE or said.get("role", "").lower() in ROLES or "hidden" in said
        _names[key] = f"{tag}.{re.sub(r'[0-9]+', '#', said.get('class', ''))}#{re.sub(r'[0-9]+', '#', said.get('id', ''))}", main, aside, named
    return _names[key]


class _Open:
    """An open element. `named` and `sure` say how far it stands aside, by its names and for sure."""

    __slots__ = ("tag", "token", "main", "sure", "link", "named", "box", "inside", "likes", "ended")

    def __init__(self, tag: str, token: int, main: int, sure: bool, link: bool, named: int, box: int, inside: bool, likes: dict):
        self.tag, self.token, self.main, self.sure, self.link, self.named, self.box, self.inside, self.likes, self.ended = tag, token, main, sure, link, named, box, inside, likes, False


def read_page(source: str, region: int = 0) -> Page:
    """The page's tokens and runs; `region` is the token of the main slot's box, if the host's template has one. One forward scan: open
    elements are found by tag, not by going through all of them."""
    page, at, block = Page(), 0, 0
    stack = [_Open("", 1, 0, False, False, 0, 0, False, {})]
    where: dict[str, list[int]] = {}  # the places of open elements on the stack by tag
    blocks: list[int] = []  # those of BLOCK

    def text(raw: str) -> None:
        top = stack[-1]
        if raw and not raw.isspace():
            token = xxhash.xxh64_intdigest(" ".join(raw.split()), top.token & MASK) & ~1
            page.tokens.append((token, False))
            page.runs.append(Run(token, raw, top.main, top.sure or top.named > 0, top.link, block, top.box, top.inside))
        elif raw and page.runs and page.runs[-1].block == block:
            page.runs.append(Run(0, " ", top.main, top.sure or top.named > 0, top.link, block, top.box, top.inside))

    def last(tag: str) -> int:
        return where[tag][-1] if where.get(tag) else 0

    def close(to: int) -> None:
        nonlocal block
        if blocks and blocks[-1] >= to:
            block += 1
        while len(stack) > to:
            gone = stack.pop()
            if not gone.ended:
                where[gone.tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    m = OPENS.search(source)
    while m:
        start = m.start()
        kind = m[0]
        if kind == "<!--":
            text(source[at:start])
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            m = OPENS.search(source, at)
            continue
        if kind in ("<!", "<?"):
            end = source.find(">", start)
            if end < 0:
                break
            text(source[at:start])
            at = end + 1
            m = OPENS.search(source, at)
            continue
        m = TAG.match(source, start)
        if not m:
            break  # a tag without an end
        text(source[at:start])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            place = last(tag)
            if place and (tag in BLOCK or not (blocks and blocks[-1] > place)):
                close(place)
            elif place:
                stack[where[tag].pop()].ended = True
            elif tag == "p":
                block += 1
        elif tag in RAW and not m[3].endswith("/"):
            end = RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
        elif tag == "br":
            text(" ")
        elif tag in VOID:
            block += tag == "hr"
        else:
            if tag in BLOCK:
                place = last("p")
                if place and place > max(map(last, PARAGRAPH_ENDS)):
                    close(place)
                block += 1
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                place = max(map(last, ends.split()))
                if place and place > max(map(last, stops)):
                    close(place)
            if tag in ("td", "th"):
                text(" ")
            top = stack[-1]
            name, starts, off, off_named = _named(tag, m[3])
            off = off or tag == "header" and not top.main
            structural, token, likes = tag in STRUCTURAL, top.token, top.likes
            if structural:
                nth = likes[name] = likes.get(name, -1) + 1 if tag in BOXES else 0  # paragraphs and items come in any number
                token, likes = xxhash.xxh64_intdigest(f"{top.token:x}>{name}@{nth}") | 1, {}
                page.tokens.append((token, True))
            main, sure, named, inside, box = top.main, top.sure or off, max(top.named, off_named), top.inside, top.box
            if region and token == region and structural:
                sure, named, inside = False, 0, True  # what stands around the main slot says nothing about it
                page.found = 2 if starts else 1
            if starts and not sure and (not main or named == DOUBTED):
                # what stands around a main part says how far it is one; within it names count anew
                main, named = (SURE if not named or tag == "main" and named == DOUBTED else named), 0
                page.has_main |= main == SURE
            if tag in BOXES:
                page.boxes.append((token, box, starts))
                box = len(page.boxes) - 1
            where.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(_Open(tag, token, main, sure, top.link or tag == "a", named, box, inside, likes))
        m = OPENS.search(source, at)
    text(source[at:])
    return page


def nested_template(page: Page, classes: list[list[int]]) -> set[int]:
    """The tokens of the classes that lie on this page, nested; classes come largest support first."""
    where: dict[int, list[int]] = {}
    for i, (t, _) in enumerate(page.tokens):
        where.setdefault(t, []).append(i)
    laid: list[list[int]] = []
    for c in classes:
        spots = [where.get(t, ()) for t in c]
        if any(len(s) != 1 for s in spots):
            continue
        mine = sorted(s[0] for s in spots)
        if all(_within(mine, other) or _within(other, mine) for other in laid):
            laid.append(mine)
    return {page.tokens[i][0] for spots in laid for i in spots}


def _within(a: list[int], b: list[int]) -> bool:
    """Whether all of a lies within one gap of b (before, after, or between two neighbours)."""
    return sum(x < a[0] for x in b) == sum(x < a[-1] for x in b)


def _slots(runs: list[Run], template: set[int], kinds: set[int], links: bool) -> str:
    """The text of the slots in main parts of these kinds (0: outside of any); with links also blocks that are mostly links."""
    blocks: dict[int, list[Run]] = {}
    for r in runs:
        if not r.aside and r.main in kinds and r.token not in template:
            blocks.setdefault(r.block, []).append(r)
    out = []
    for parts in blocks.values():
        whole = " ".join("".join(html.unescape(r.text) for r in parts).split())
        if whole and (links or 2 * sum(len(r.text.strip()) for r in parts if r.link) <= len(whole)):
            out.append(whole)
    return "\n".join(out)


def main_text(page: Page, template: set[int]) -> str:
    """The slots of the main slot's box; without one sure main parts, or else what stands outside of any. Doubted main parts count where they
    hold more than that, named ones where nothing else is left. Main parts without any slot keep their template text."""
    runs, kinds, links = page.runs, {SURE} if page.has_main else {0}, page.has_main
    if page.found:
        runs, kinds, links = [r for r in runs if r.inside], {0, SURE}, page.found == 2
    out = _slots(runs, template, kinds, links)
    kept = {r.main for r in runs}
    if not out and (page.has_main or page.found):
        out = _slots(runs, set(), kinds, links)
    if DOUBTED in kept and len(_slots(runs, template, {DOUBTED}, True)) > len(out):
        out = _slots(runs, template, {SURE, DOUBTED}, True)
    if not out and NAMED in kept:
        out = _slots(runs, template, {NAMED}, True) or _slots(runs, set(), {NAMED}, True)
    return out


def main_box(members: list[tuple[int, int, int, bool]]) -> int:
    """The token of the main slot's box, or 0. members(token, box around it, characters on all pages, is it a main part) of the template: boxes,
    whose characters are those of all text in them, and text runs, which don't count as they are no slots."""
    boxes = {t: [around, chars, main] for t, around, chars, main in members if t & 1}
    for t, around, chars, _ in members:
        while not t & 1 and around in boxes:
            boxes[around][1] -= chars
            around = boxes[around][0]
    within: dict[int, list[int]] = {}
    for t, (around, _, _) in boxes.items():
        within.setdefault(around if around in boxes else 0, []).append(t)
    chain, here, size = [], 0, sum(boxes[t][1] for t in within.get(0, ()))
    while size > 0:
        here = max(within.get(here, ()), key=lambda t: (boxes[t][1], t), default=0)
        if not here or 2 * boxes[here][1] < size:
            break
        chain.append(here)
        size = boxes[here][1]
    return next((t for t in chain if boxes[t][2]), chain[-1] if chain else 0)


def _host(url: str | None) -> int:
    return xxhash.xxh64_intdigest(host_and_path(url)[0].encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _measured(page: Page) -> dict[int, tuple[int, int, bool]]:
    """(box around it, characters, is it a main part) of each text run and box; text that stands aside counts nothing."""
    held, out = [0] * len(page.boxes), {}
    for r in page.runs:
        chars = 0 if r.aside or not r.token else len(r.text)
        held[r.box] += chars
        if r.token:
            out[r.token] = page.boxes[r.box][0], chars, False
    for k in range(len(page.boxes) - 1, 0, -1):  # a box comes after the one around it
        token, around, main = page.boxes[k]
        held[around] += held[k]
        out[token] = page.boxes[around][0], held[k], main
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to (host, d1, d2, once, more, box, chars, main): a digest of the token sequence, the tokens that the page holds once, and
    those it holds more often; for the first what _measured says (nothing: 0)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    for b in batches:
        rows = {}
        for url, source in zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True):
            page = read_page(source or "")
            tokens = [t for t, _ in page.tokens]
            digest = xxhash.xxh3_128_intdigest(b"".join(t.to_bytes(8, "little") for t in tokens))
            key = _signed(_host(url)), _signed(digest >> 64), _signed(digest & MASK)
            if key not in rows:
                n, told = Counter(tokens), _measured(page)
                once = [t for t in n if n[t] == 1]
                said = [told.get(t, (0, 0, False)) for t in once]
                rows[key] = [_signed(t) for t in once], [_signed(t) for t in n if n[t] > 1], [_signed(x[0]) for x in said], [x[1] for x in said], [x[2] for x in said]
        if rows:
            columns = zip(*((*key, *held) for key, held in rows.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "d1", "d2", "once", "more", "box", "chars", "main"])


COUNTED = "host long, token long, element boolean, pages long, total long, xored long, summed long, box long, chars long, main boolean"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different pages to COUNTED rows, summed up within each batch; token 0 stands for the page itself."""
    names = [c.split()[0] for c in COUNTED.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in COUNTED.split(", ")]
    for b in batches:
        held: dict[tuple[int, int], list] = {}
        for host, d1, d2, once, more, box, chars, main in zip(*(b[c].to_pylist() for c in ("host", "d1", "d2", "once", "more", "box", "chars", "main")), strict=True):
            h = xxhash.xxh64_intdigest((d1 & MASK).to_bytes(8, "little") + (d2 & MASK).to_bytes(8, "little"))
            for n, told in ((1, [(0, 0, 0, False), *zip(once, box, chars, main, strict=True)]), (2, [(t, 0, 0, False) for t in more])):
                for token, around, c, m in told:
                    row = held.setdefault((host, token), [bool(token & 1), 0, 0, 0, 0, around, 0, m])
                    row[1] += 1
                    row[2] += n
                    row[3] ^= h
                    row[4] += h & 0xFFFFFFFF
                    row[6] += c
        if held:
            rows = [(host, token, e, p, t, _signed(x), s, *rest) for (host, token), (e, p, t, x, s, *rest) in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts' (host, classes, members) to (host, classes, region)."""
    for b in batches:
        region = [_signed(main_box([(m["token"] & MASK, m["box"] & MASK, m["chars"], m["main"]) for m in members])) for members in b["members"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["host"], b["classes"], pa.array(region, pa.int64())], ["host", "classes", "region"])


def templates(pages: DataFrame) -> DataFrame:
    """pages(url, html) to (host, classes, region): for each host with a template its classes of tokens, largest support first, and the
    main slot's box (0: none)."""
    ship(pages.sparkSession)
    read = pages.select("url", "html").mapInArrow(_tokens, "host long, d1 long, d2 long, once array<long>, more array<long>, box array<long>, chars array<long>, main array<boolean>")
    different = read.groupBy("host", "d1", "d2").agg(*(F.first(c).alias(c) for c in ("once", "more", "box", "chars", "main")))
    parts = different.mapInArrow(_counted, COUNTED)
    tokens = parts.groupBy("host", "token").agg(F.first("element").alias("element"), F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("xored").alias("xored"), F.sum("summed").alias("summed"), F.max("box").alias("box"), F.sum("chars").alias("chars"), F.max("main").alias("main"))
    tokens = materialize(tokens.where((F.col("pages") >= MIN_PAGES) & (F.col("pages") == F.col("total"))), "template-tokens")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    common = tokens.where("token <> 0").join(hosts, "host").where(F.col("pages") >= MIN_SHARE * F.col("all_pages"))
    member = F.when(F.col("box") != 0, F.struct("token", "box", "chars", "main"))
    classes = common.groupBy("host", "pages", "xored", "summed").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.max("element").alias("element"), F.collect_list(member).alias("members"))
    classes = classes.where((F.size("tokens") > 1) & F.col("element"))
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("pages"), "tokens")))
    told = classes.groupBy("host").agg(F.transform(ranked, lambda x: x["tokens"]).alias("classes"), F.flatten(F.collect_list("members")).alias("members"))
    out = materialize(told.mapInArrow(_chosen, "host long, classes array<array<long>>, region long"), "templates")
    drop(tokens)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to (page_id, url, text, n_chars)."""
    found = templates(pages)

    def hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("page_id", "url", "html")), pa.array([_signed(_host(u)) for u in b["url"].to_pylist()], pa.int64())], ["page_id", "url", "html", "host"])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, classes, region in zip(*(b[c].to_pylist() for c in ("html", "classes", "region")), strict=True):
                page = read_page(source or "", (region or 0) & MASK)
                out.append(main_text(page, nested_template(page, [[t & MASK for t in c] for c in classes or ()])))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html").mapInArrow(hosted, "page_id long, url string, html string, host long")
    return rows.join(found, "host", "left").select("page_id", "url", "html", "classes", "region").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
