"""Main text of web pages with a site style tree.

Pages of one host are merged into a tree of style nodes: a node is the path of elements (tag and
class or id) above a block of text. For each node the tree holds how its content (all that a page
says under it) and its presentation (the number of blocks) vary over the host's pages. Their
entropies, as shares of what a fixed number of different pages would have, give the node's
importance: a branch that says the same on every page has importance near 0, an article's
paragraphs 1, however many pages there are. Few pages say little: entropies are averaged with those of
PRIOR_PAGES pages that all differ. Branches of low importance are removed from each page. Branches that HTML itself declares not to be content (navigation, forms, scripts, ...,
or classes and ids that name such parts) are removed at once, since statistics cannot tell, say, readers'
comments from an article: both differ from page to page. Without ``by_name`` the tree alone decides on all that is
visible. If <article> and <main> elements hold a fair share of a page's text, only text within one is content. A class,
id or role names a part if one of its tokens ends in the part's word, fittings such as "list" or
"box" aside, with no "no", "with", "has" or the like in the token. An element that is removed by
name gives back the <main> or single <article> in it if the page has no other one with text (beside
an <article>, the page's other text stays too), and all of them if the page has no other text at all.

Pages count once in a node's statistics if their main text is the same: the nodes that are longer
than it, and not short beside the page's longest. A node without such others counts once for each
content. A host of copies, under one title or many, thus keeps its articles; so does a page whose
longest node is not the article (it then keeps that node, too).

Defined results
---------------
* null or empty html, and html without content, gives an empty text with 0 characters;
* a null or hostless url: such pages share the empty host;
* <br> and all white space (no-break spaces too) inside a block become one space;
* unclosed elements end where HTML ends them, at the latest with the page; a stray end tag is ignored;
* repeated rows and ids are judged row by row; an empty table gives an empty result;
* input columns named like a result column are replaced; other columns may have any names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .common import materialize, table

#: Entropies are shares of what so many pages that all differ have.
FULL_PAGES = 8
#: So many pages that all differ are added to what a host shows of a node.
PRIOR_PAGES = 2
#: Text beside <article> and <main> elements goes if they hold at least this share of the page's.
INSIDE_SHARE = 0.2
#: Nodes that have at least this share of the longest one's text are a page's main text.
MAIN_SHARE = 0.25
#: Nodes below this importance are removed.
MIN_IMPORTANCE = 0.2
#: Weight of content against presentation in a node's importance.
CONTENT_WEIGHT = 0.9
#: Up to so many low nodes are broadcast (some 20 MB).
BROADCAST_NODES = 100_000

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that do not end the line of text they stand in.
IN_LINE = INLINE | frozenset("button canvas iframe noscript object script select style svg template".split())
NOT_CONTENT = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select input textarea menu dialog title datalist".split())
#: What a reader does not see as text, of these.
UNSEEN = frozenset("head script style noscript template iframe object svg canvas select input textarea title datalist".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Words in classes, ids and roles that name parts other than the article.
PARTS = frozenset(
    "ad ads adbox adbanner adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer "
    "gdpr header masthead menu menubar nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget widgets contentinfo complementary search replies responses respond reactions modal overlay alert skip".split()
)
#: Of these, words that an article may use of its own sections.
OWN_WORDS = frozenset("alert banner consent notice notices promo reactions related replies respond responses search share sharing skip widget widgets".split())
#: Words that may follow a part's word in a token that names the part.
FITTINGS = frozenset(
    "area author bar block body bottom box btn button buttons card cards col column container content entry feed form group header heading holder icon icons inner item items left "
    "link links list main media meta module next outer panel post posts prev previous rail results right row section slot stories text title to top unit wrap wrapper zone".split()
)
#: Words that make a token say something of the layout instead.
LAYOUT = frozenset("no not with has have without hide hidden".split())
#: Parts that may head an article from inside.
HEADS = frozenset(("header", "banner", "masthead"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")


#: Patterns of end tags, kept where functions travel without this module.
_CLOSE: dict[str, re.Pattern] = {}


def _close(tag: str) -> re.Pattern:
    if tag not in _CLOSE:
        _CLOSE[tag] = re.compile(f"</{tag}", re.I | re.A)
    return _CLOSE[tag]


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _part_words(value: str) -> set[str]:
    """The parts that the tokens of a class, id or role name."""
    found = set()
    for token in value.split():
        names = _WORD.findall(_CAMEL.sub(" ", token).lower())
        if LAYOUT.isdisjoint(names):
            while len(names) > 1 and names[-1] in FITTINGS and names[-1] not in PARTS:
                names.pop()
            if names and names[-1] in PARTS:
                found.add(names[-1])
    return found


def _signature(tag: str, attributes: str) -> tuple[str, bool, set[str], bool]:
    """A style node's name; whether its class, id or role names a part that is not content; what class and id name; whether it is hidden."""
    if not attributes or attributes.isspace():
        return tag, False, set(), False
    names, part, hits, hidden = [], False, set(), False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name in ("class", "id", "role"):
            hit = _part_words(value)
            part |= bool(hit)
            if name != "role":
                hits |= hit
                names.append(re.sub(r"\d+", "0", value.lower()))
    return (f"{tag}.{' '.join(names)}" if names else tag), part, hits, hidden


def blocks(page: str | None, by_name: bool = True) -> list[tuple[str, str]]:
    """``(path, text)`` of the page's blocks that may be content, in page order."""
    if not page:
        return []
    if not by_name:
        return [(p, t) for p, t, _ in _blocks(page, False, False)[0]]
    out, lost = _blocks(page, False)
    beside = False
    if lost and not any(x[2] for x in out) and (not out or "main" in lost or len(lost) == 1):
        # the page's article is in an element that goes by its name
        beside = bool(out) and "main" not in lost
        out, _ = _blocks(page, True)
    inside = sum(len(t) for _, t, i in out if i)
    if inside and not beside and inside >= INSIDE_SHARE * sum(len(t) for _, t, _ in out):
        out = [x for x in out if x[2]]
    return [(p, t) for p, t, _ in out]


def _blocks(page: str, rescue: bool, by_name: bool = True) -> tuple[list[tuple[str, str, bool]], list[str]]:
    """``(path, text, inside an article or main element)`` of the blocks; the outermost such elements within others that go by name.

    With ``rescue`` those elements stay.
    """
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, str, int]] = []  # tag, path, not content: by name 1, by tag 2
    text: list[str] = []
    lost: list[str] = []
    at, end, inside = 0, len(page), 0

    def flush() -> None:
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said:
                path = next((p for t, p, _ in reversed(stack) if t not in IN_LINE), "")
                out.append((path, said, inside > 0))

    def pop() -> None:
        nonlocal inside
        tag = stack[-1][0]
        if tag not in IN_LINE:
            flush()
        inside -= tag in ("article", "main")
        stack.pop()

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][2]):
            text.append(page[at:stop])
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                text.append(" ")
                continue
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is None:
                continue
            if tag in INLINE and any(t not in INLINE for t, _, _ in stack[depth + 1 :]):
                continue  # formatting that is closed in another block
            while len(stack) > depth:
                pop()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] not in INLINE), None)
            if depth is not None and stack[depth][0] == "p":
                while len(stack) > depth:
                    pop()
            # formatting left open by the paragraphs before does not go on
            while stack and stack[-1][0] in INLINE:
                stack.pop()
        if tag == "body":
            while stack and stack[-1][0] != "html":
                pop()
        if tag in SAME_CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SAME_CLOSES[tag]:
                    break
                if stack[k][0] == tag or (tag in ("td", "th", "dt", "dd") and stack[k][0] in ("td", "th", "dt", "dd")):
                    while len(stack) > k:
                        pop()
                    break
        if tag not in IN_LINE:
            flush()
        sign, part, hits, hidden = _signature(tag, attributes)
        above = stack[-1] if stack else ("", "", 0)
        heads = tag == "header" or ((part or hidden) and inside and hits <= (HEADS if hidden else HEADS | OWN_WORDS) and (hits or hidden))
        named = (part and not heads) or (heads and not inside)
        gone = max(above[2], 2 if tag in NOT_CONTENT or (hidden and not heads) else 1 if named else 0) if by_name else max(above[2], 2 * (tag in UNSEEN or hidden))
        if tag in ("html", "body"):
            gone = 0
        if tag in ("article", "main") and above[2] == 1 and gone == 1 and not part:
            if not inside:
                lost.append(tag)
            if rescue:
                gone = 0
        inside += tag in ("article", "main")
        if attributes.endswith("/") and tag in ("svg",):
            continue
        stack.append((tag, f"{above[1]}/{sign}", gone))
        if tag in RAW:
            close = _close(tag).search(page, at)
            at = close.start() if close else end
    while stack:
        pop()
    flush()
    return out, lost


def style_nodes(found: list[tuple[str, str]]) -> list[tuple[int, int, int, int]]:
    """For each node of a page's blocks: its first block's number, and its content, main text and number of different blocks.

    The main text is of the longer nodes with MAIN_SHARE of the longest one's text; without any, the node's own content.
    """
    import xxhash

    under: dict[str, tuple[int, dict[str, None]]] = {}
    for k, (path, said) in enumerate(found):
        under.setdefault(path, (k, {}))[1][said] = None
    digest = lambda x: xxhash.xxh3_64_intdigest("\0".join(x).encode("utf-8", "surrogatepass")) - 2**63
    nodes = sorted((-sum(map(len, said)), path, k, digest(sorted(said)), len(said)) for path, (k, said) in under.items())
    out, main = [], []
    for length, path, k, content, n in nodes:
        out.append((k, content, digest(main) if main else content, n))
        if length <= MAIN_SHARE * nodes[0][0]:
            main += (path, str(content))
    return out


_NODE = [("at", "integer"), ("content", "long"), ("main", "long"), ("blocks", "integer")]


def parsed(pages: DataFrame, html_col: str = "html", url_col: str = "url", by_name: bool = True) -> DataFrame:
    """``row`` (the other columns of ``pages``), ``host``, ``paths`` and ``texts`` (of the blocks that may be content) and ``nodes``."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", 1), F.lit("")))
    # whole rows are carried in one column, so that their own columns may have any names
    named = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host.alias("host"), F.col(html_col).alias("html"))
    strings = pa.list_(pa.string())
    nodes = pa.list_(pa.struct([(n, {"integer": pa.int32(), "long": pa.int64()}[k]) for n, k in _NODE]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(page.as_py(), by_name) for page in b.column(2)]
            paths, texts = (pa.array([[x[k] for x in f] for f in found], strings) for k in (0, 1))
            style = pa.array([style_nodes(f) for f in found], nodes)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], paths, texts, style], names=["row", "host", "paths", "texts", "nodes"])

    schema = StructType([named.schema["row"]]).add("host", "string").add("paths", ArrayType(StringType())).add("texts", ArrayType(StringType()))
    style_type = StructType()
    for n, k in _NODE:
        style_type.add(n, k)
    return named.mapInArrow(run, schema.add("nodes", ArrayType(style_type)))


def low_nodes(found: DataFrame) -> DataFrame:
    """``(host, path)`` of the style nodes to remove, from the result of :func:`parsed`."""
    each = found.select("host", "paths", F.explode("nodes").alias("n"))
    pairs = each.select("host", F.get("paths", F.col("n.at")).alias("path"), "n.content", "n.main", "n.blocks")
    # pages of the same main text fall together here
    seen = materialize(pairs.distinct(), "html-nodes")
    node = ["host", "path"]

    def entropy(value: str) -> DataFrame:
        counted = seen.groupBy(*node, value).agg(F.count("*").alias("c"))
        total = F.sum("c")
        share = F.least(F.lit(1.0), (F.log(total) - F.sum(F.col("c") * F.log("c")) / total) / math.log(FULL_PAGES))
        return counted.groupBy(*node).agg(((total * share + PRIOR_PAGES) / (total + PRIOR_PAGES)).alias(value))

    nodes = entropy("content").join(entropy("blocks"), node)
    # the prior is of pages that differ in content; how many blocks they have it does not say
    importance = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.least("content", "blocks")
    return nodes.filter(importance < MIN_IMPORTANCE).select(*node)


def extracted(pages: DataFrame, html_col: str = "html", url_col: str = "url", broadcast_nodes: int = BROADCAST_NODES, by_name: bool = True) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; the html is left out."""
    found = materialize(parsed(pages, html_col, url_col, by_name), "html-blocks")
    low = materialize(low_nodes(found), "html-low")
    if low.count() <= broadcast_nodes:
        by_host = low.groupBy("host").agg(F.collect_set("path").alias("low"))
        work = found.join(F.broadcast(by_host), "host", "left")
    else:
        # too many to broadcast: each page gets the low nodes among its own
        keyed = found.withColumns({"k1": F.xxhash64("host", "paths", "texts"), "k2": F.xxhash64(F.lit(1), "host", "paths", "texts")})
        own = keyed.select("k1", "k2", "host", F.explode("paths").alias("path")).distinct().join(low, ["host", "path"])
        work = keyed.join(own.groupBy("k1", "k2").agg(F.collect_set("path").alias("low")), ["k1", "k2"], "left")
    pairs = F.arrays_zip(F.col("paths").alias("p"), F.col("texts").alias("t"))
    kept = F.filter(pairs, lambda b: ~F.coalesce(F.array_contains("low", b["p"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["t"]), "\n")
    return work.select("row.*", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
