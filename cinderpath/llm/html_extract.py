"""HTML extraction with a site style tree: branches that a host repeats carry little and are removed."""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, tune

#: A branch needs so many different pages of its host to be judged; below this importance it goes,
#: unless it holds over this share of its page's main text. GAMMA weighs content against presentation.
MIN_PAGES, LEAST_IMPORTANCE, LARGE_SHARE, GAMMA = 5, 0.3, 0.25, 0.9

# Element names of the HTML standard, by what they do to text, and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math canvas object select option datalist audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog head menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu masthead footer foot sidebar side widget widgets ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing comment comments discussion reply replies respond disqus related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager toolbar search copyright legal alert disclaimer teaser teasers form".split()
)
#: Parts in which an article element is a part of them, not the page's own article.
STRICT_NAMES = frozenset("comment comments discussion reply replies respond disqus related recommended recommendations sidebar teaser teasers widget".split())
#: Names that say little when another word follows them, as in form-factor or menu-item: within an article they must come last.
VAGUE_NAMES = frozenset("form menu side foot search alert notice notices legal reply replies social login overlay pager promo share copyright".split())
CONTENT_NAMES = frozenset("content article post entry story articlebody postbody maincontent".split())
NOT_A_PART = frozenset("has with no without is".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![\w-])""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: End tags that a start tag implies.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}


class Block(NamedTuple):
    text: str
    node: int  # a hash of the elements' names and classes from the root to the block
    zone: int  # 3 in an article, 2 in main, 1 in an element named as content, 0 elsewhere
    linked: int
    noise: bool  # markup itself calls it something else than main text


class _Frame(NamedTuple):
    tag: str
    node: int
    noise: int  # 2 stays so in an article within it, 1 doesn't
    header: bool
    zone: int


def _names(value: str) -> list[list[str]]:
    return [[p.lower() for p in _NAME.findall(word)] for word in value.split()]


def _open(tag: str, attributes: str, above: _Frame) -> _Frame:
    noise, zone, header, classes, named = above.noise, above.zone, above.header, "", []
    if attributes.strip():
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                named += _names(value)
                if key == "class":
                    classes = ".".join(sorted(re.sub(r"\d+", "", value.lower()).split()))
            elif key == "role":
                noise = max(noise, 1 if value.lower() in NOISE_ROLES else 0)
                zone = max(zone, 2 if value.lower() == "main" else 0)
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                noise = 2
    if tag in ("article", "main"):
        noise, zone = (2 if noise == 2 else 0), max(zone, 3 if tag == "article" else 2)
    elif tag in NOISE_TAGS:
        noise = max(noise, 1 if tag in ("form", "head") else 2)
    elif tag == "header":
        header = True
    if tag not in ("html", "body", "main"):
        for parts in named:
            if not parts or NOT_A_PART & set(parts):
                continue
            if parts[-1] in NOISE_NAMES or parts[0] in NOISE_NAMES and not (zone >= 2 and parts[0] in VAGUE_NAMES):
                noise = max(noise, 2 if STRICT_NAMES & {parts[0], parts[-1]} else 1)
            elif parts[-1] == "header" or parts[0] == "header":
                header = True
            elif "".join(parts) in CONTENT_NAMES or parts[-1] in ("content", "body") and parts[0] in CONTENT_NAMES | {"main"}:
                zone = max(zone, 1)
    return _Frame(tag, xxhash.xxh64_intdigest(f"{tag}.{classes}", above.node), noise, header, zone)


class _Stack:
    """Open elements, with the places of each name's, of block elements and of walls (those and table cells); all steps take
    constant time but for what they remove."""

    def __init__(self):
        self.frames = [_Frame("", 0, 0, False, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.walls = [0], [0]

    def push(self, frame: _Frame) -> None:
        at = len(self.frames)
        self.frames.append(frame)
        self.places.setdefault(frame.tag, []).append(at)
        if frame.tag in BLOCK:
            self.blocks.append(at)
        if frame.tag in BLOCK or frame.tag in ("td", "th"):
            self.walls.append(at)

    def cut(self, at: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.frames) > at:
            self.places[self.frames.pop().tag].pop()
        for places in (self.blocks, self.walls):
            while places[-1] >= at:
                places.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str) -> list[Block]:
    """All text blocks of a page, in page order; linear in its length."""
    stack = _Stack()
    blocks: list[Block] = []
    words: list[str] = []
    linked = links = at = 0
    heading = False

    def flush() -> None:
        nonlocal linked, heading
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                inner, owner = stack.frames[-1], stack.frames[stack.blocks[-1]]
                blocks.append(Block(text, owner.node, inner.zone, linked, bool(inner.noise) or inner.header and not heading))
        linked, heading = 0, False

    def text(s: str) -> None:
        nonlocal linked
        if "&" in s:
            s = _html.unescape(s)
        words.append(s)
        if links:
            linked += len(s)

    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), (m[1] if m[2] else m[4])
        if not closing:
            if tag in RAW:
                if not (m[3] or m[6] or "").rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else len(page)
                words.append(" ")
                continue
            if tag == "br" or tag in ("td", "th"):
                words.append(" ")
            if tag in BLOCK:
                flush()
                if stack.frames[stack.walls[-1]].tag == "p":  # a block ends an open paragraph
                    stack.cut(stack.walls[-1])
            if tag in _CLOSES:
                gone, walls = _CLOSES[tag]
                k = stack.last(*gone.split())
                if k > stack.last(*walls):
                    stack.cut(k)
            if tag in VOID:
                continue
            if tag == "a":
                links += 1
            stack.push(_open(tag, m[3] if m[2] else m[6] or "", stack.frames[-1]))
            if tag in BLOCK:
                heading = tag in HEADING
        else:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                heading = heading or tag in HEADING
                flush()
            k = stack.last(tag)
            if k and (tag in BLOCK or k > stack.blocks[-1]):  # else a stray end tag
                stack.cut(k)
    if at < len(page):
        text(page[at:])
    flush()
    return blocks


def main_part(blocks: list[Block]) -> list[Block]:
    """Of a page's blocks those that its markup lets be main text; the style tree may still remove some."""
    blocks = [b for b in blocks if not b.noise]
    best = max((b.zone for b in blocks), default=0)
    return [b for b in blocks if b.zone >= min(best, 2)]


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _signed(x: int) -> int:
    return x - (1 << 63)


def _features(batches):
    for batch in batches:
        out = {"host": [], "node": [], "feature": [], "shape": [], "page": []}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole = _signed(xxhash.xxh64_intdigest(page or ""))
            nodes: dict[int, list[Block]] = {}
            for b in parse(page or ""):
                nodes.setdefault(b.node, []).append(b)
            for node, own in nodes.items():
                for feature in {xxhash.xxh64_intdigest(b.text) for b in own}:
                    out["host"].append(host)
                    out["node"].append(_signed(node))
                    out["feature"].append(_signed(feature))
                    out["shape"].append(len(own))
                    out["page"].append(whole)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("host", pa.string()), ("node", pa.int64()), ("feature", pa.int64()), ("shape", pa.int32()), ("page", pa.int64())]))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance of each element node that the different pages of a host share.

    Content: the exponent of the entropy of the node's texts over their number, repeats included: 1 where each text is on
    one page, and 1/c where each is on c of them, however many pages and texts the host has.
    Presentation: the entropy of the node's shapes, to the base of its pages.
    """
    rows = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_features, "host string, node long, feature long, shape int, page long")
    rows = save(rows.distinct())
    size = save(rows.groupBy("host", "node").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= MIN_PAGES))
    spread = rows.groupBy("host", "node", "feature").count()
    content = spread.groupBy("host", "node").agg(F.sum(F.col("count") * F.log("count")).alias("logs"), F.sum("count").alias("texts"))
    shapes = rows.select("host", "node", "shape", "page").distinct().groupBy("host", "node", "shape").count()
    shape = shapes.groupBy("host", "node").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log("count")).alias("nlog"))
    base = F.log("pages")
    presentation = F.when(F.col("n") > 0, (F.log("n") - F.col("nlog") / F.col("n")) / base)
    importance = GAMMA * F.exp(-F.col("logs") / F.col("texts")) + (1 - GAMMA) * presentation
    return size.join(content, ["host", "node"]).join(shape, ["host", "node"]).select("host", "node", "pages", importance.alias("importance"))


def _texts(batches):
    for batch in batches:
        texts, counts, by_tree, by_markup = [], [], [], []
        for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            blocks = parse(page or "")
            kept = main_part(blocks)
            gone = set(low or ())
            by_tree.append(sum(_signed(b.node) in gone for b in blocks))
            by_markup.append(len(blocks) - len(kept))
            if gone and kept:
                total = sum(len(b.text) for b in kept)
                share: dict[int, int] = {}
                for b in kept:
                    share[b.node] = share.get(b.node, 0) + len(b.text)
                kept = [b for b in kept if not (_signed(b.node) in gone and share[b.node] <= LARGE_SHARE * total)]
            texts.append("\n\n".join(b.text for b in kept))
            counts.append(len(texts[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (counts, by_tree, by_markup))],
            ["page_id", "url", "text", "n_chars", "tree_blocks", "markup_blocks"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text, blocks joined by two line ends; tree_blocks and
    markup_blocks, how many blocks the style tree finds unimportant and how many the page's own markup rules out.

    All blocks of a host's different pages, whatever they are called, are merged into a style tree, and branches with low
    importance are removed, unless they hold over LARGE_SHARE of what is left of their page. The tree can't tell a
    reader comment, a form or an advert that is different on each page from the article; for those, markup is a prior:
    elements that it calls navigation, header, footer, sidebar, notice, advert, form or comment have no importance, and
    an article (or else main, or an element named as content) is where the text is looked for. The tree's verdicts, some
    hashes a host, meet the pages in a join that Spark broadcasts only while they are small.

    A null or empty page has an empty text; a null url counts as a host of its own name, "". Repeated pages
    count once in the tree and each in the result. Other columns are ignored.
    """
    tune(pages.sparkSession)
    low = style_tree(pages).where(F.col("importance") < LEAST_IMPORTANCE)
    low = save(low.groupBy("host").agg(F.collect_set("node").alias("low")))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    return rows.join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(_texts, "page_id long, url string, text string, n_chars long, tree_blocks long, markup_blocks long")
