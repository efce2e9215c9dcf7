"""Main text of web pages by tag-path ratios.

A task parses pages into text nodes, each with its path of tags from the root. Everything after that is relational:
text length and punctuation are aggregated per path, smoothed over neighbouring paths, fused to a score and cut at a
threshold. The nodes of the paths above it, and what stands next to them in the same part of the page, become blocks of
text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.common import ROW_KEY, with_row_key

# Fixed values of HTML: elements without content, with raw content, and those that stand as blocks.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: A start tag of one of these ends an open element of the set beside it, up to the nearest container.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
#: Elements that divide a page into parts.
_PARTS = frozenset("body article main section div center header footer nav aside form".split())
_CONTAINERS = frozenset("ul ol dl table select article section div body main aside nav header footer form".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
# Parts of a page that are not its article, by element and by words of class, id and role.
_ASIDE_TAGS = frozenset("nav header footer aside form button select menu dialog fieldset label".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pagination popup promo promotion recommended related reply replies respond "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
_MARKED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def _element(tag: str, attrs: str, in_article: bool) -> tuple[str, bool]:
    """Name of an element in a path (with its first class, if it is a block), and whether it is page furniture.

    The header of an article is part of it.
    """
    name, aside = tag, tag in _ASIDE_TAGS and not (tag == "header" and in_article)
    for key, value in _MARKED.findall(attrs) if attrs.strip() else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            aside = True
        elif tag not in ("html", "body"):
            aside = aside or bool(_ASIDE_WORDS.intersection(re.split(r"[^a-z]+", value)) - ({"header"} if in_article else set()))
        if key == "class" and value.split() and tag in _BLOCK:
            name = f"{tag}.{value.split()[0]}"
    return name, aside


def _holder(stack: list[tuple[str, bool, str]]) -> str:
    """Path of the part of the page that holds a node: its article or main part, or else the nearest division."""
    parts = [name for tag, _, name in stack if tag in _PARTS]
    for i, (tag, _, _) in enumerate([x for x in stack if x[0] in _PARTS]):
        if tag in ("article", "main"):
            return "/".join(parts[: i + 1])
    return "/".join(parts)


def text_nodes(html: str) -> list[tuple[str, str, bool, bool, int, str]]:
    """The text nodes of a page in order: path, block container's path, furniture and link flags, block number, text.

    White space alone and line breaks have no path; they only separate what stands around them. The link flag says that
    all the text of the node's block stands in links.
    """
    found = _nodes(html)
    spoken = {block for path, _, _, linked, block, _ in found if path and not linked}
    return [(path, holder, marked, block not in spoken, block, text) for path, holder, marked, _, block, text in found]


def _nodes(html: str) -> list[tuple[str, str, bool, bool, int, str]]:
    stack: list[tuple[str, bool, str]] = []  # tag, furniture here or above, name in paths
    nodes, block, at = [], 0, 0
    lowered = None
    while at < len(html):
        match = _TOKEN.match(html, at)
        at = match.end()
        if (text := match["text"]) is not None or (text := match["cdata"]) is not None:
            marked = bool(stack) and stack[-1][1]
            text = text if match["cdata"] is not None else unescape(text)
            if text.isspace():
                nodes.append(("", "", marked, False, block, " "))
            else:
                path = "/".join(name for _, _, name in stack) or "-"
                nodes.append((path, _holder(stack), marked, any(tag == "a" for tag, _, _ in stack), block, text))
        elif (tag := match["open"]) is not None:
            tag, attrs = tag.lower(), match["attrs"] or ""
            if tag in _RAW and not attrs.rstrip().endswith("/"):
                lowered = html.lower() if lowered is None else lowered
                end = lowered.find(f"</{tag}", at)
                # Lower-casing keeps lengths but for a few letters; then search without it.
                if len(lowered) != len(html):
                    found = re.compile(f"</{tag}", re.I).search(html, at)
                    end = found.start() if found else -1
                at = len(html) if end < 0 else end
                if end >= 0:
                    close = html.find(">", at)
                    at = len(html) if close < 0 else close + 1
                continue
            if tag == "br":
                nodes.append(("", "", bool(stack) and stack[-1][1], False, block, " "))
                continue
            if tag in _BLOCK:
                block += 1
                # A block ends an open paragraph with the inline elements in it.
                tags = [t for t, _, _ in stack]
                if "p" in tags and not set(tags[len(tags) - tags[::-1].index("p") :]) - _INLINE:
                    del stack[len(tags) - 1 - tags[::-1].index("p") :]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _ENDS.get(tag, ()):
                        del stack[k:]
                        break
                    if stack[k][0] in _CONTAINERS:
                        break
            if tag not in _VOID and not attrs.rstrip().endswith("/"):
                name, aside = _element(tag, attrs, any(t in ("article", "main") for t, _, _ in stack))
                stack.append((tag, aside or bool(stack) and stack[-1][1], name))
        elif (tag := match["close"]) is not None:
            tag = tag.lower()
            block += tag in _BLOCK
            tags = [t for t, _, _ in stack]
            if tag in tags:
                del stack[len(tags) - 1 - tags[::-1].index(tag) :]
    return nodes


def _parse(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ROW_KEY]))
        pages = batch.column("_html")
        for start in range(0, batch.num_rows, 64):
            found = [
                (*keys[i], place, *node)
                for i in range(start, min(start + 64, batch.num_rows))
                for place, node in enumerate(text_nodes(pages[i].as_py() or ""))
            ]
            columns = list(zip(*found)) if found else [[]] * 9
            kinds = (
                pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()
            )
            names = (*ROW_KEY, "_place", "_path", "_holder", "_marked", "_linked", "_block", "_text")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


#: Parts of a page that are not one part of its text.
_WHOLE_PAGE = ("", "body")
# A closing mark counts as much as so many characters; a path of links alone is a list from so many of them on.
_MARK_CHARS, _LINKS = 100, 3


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.15
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` and the row key.

    Furniture goes first: menus, headers (but an article's own), footers, side bars, notices, adverts, forms and comments,
    known by element, class, id and role. Of what is left, each path has a text ratio, its characters per text node, and
    a punctuation ratio, its closing marks per node. Both are smoothed over the paths before and after in order of first
    appearance (weights 1, 2, 1) and fused to ``text ratio + 100 * punctuation ratio``. A path's score is the lesser of
    its own and its smoothed value, so neither a lone long line nor the neighbour of an article stands out. Content paths
    are those that reach ``threshold`` times the page's mean, which is weighted by characters.

    Besides their nodes, a page keeps what stands beside them, so that headings, short paragraphs and lists of an article
    are not lost: all nodes of a part of the page (article, main part or nearest division) that has a content path, and
    of the divisions inside it, but for the page as a whole, those between its first and last content node. Paths of
    three or more blocks of links alone are kept only as content paths.

    A block is the text between two borders of block elements: references decoded, white space joined to single spaces,
    trimmed; blocks follow in page order, two line feeds apart. A null or empty page, or one without content, gives an
    empty text. Pages are rows, so repeated ids and repeated rows stay apart; an empty table gives no rows; of other
    columns the names do not matter. A page's nodes meet in one task, since its text is one value; pages are dealt
    once, and all windows below share that dealing.
    """
    keyed = with_row_key(pages)
    key = list(ROW_KEY)
    nodes = (
        keyed.select(*key, F.col(f"`{html_col}`").cast("string").alias("_html"))
        .mapInArrow(
            _parse,
            ", ".join(f"{c} long" for c in key)
            + ", _place int, _path string, _holder string, _marked boolean, _linked boolean, _block int, _text string",
        )
        .where(~F.col("_marked"))
        .drop("_marked")
        .repartition(*key)
    )
    said = F.col("_path") != ""
    chars = F.length(F.trim(F.regexp_replace("_text", r"(?U)\s+", " ")))
    marks = F.length(F.regexp_replace("_text", r"[^.,;:!?…。，、！？]+", ""))
    nodes = nodes.withColumn("_chars", F.when(said, chars))
    by_path = Window.partitionBy(*key, "_path")
    whole = by_path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    measured = nodes.select(
        "*", (F.sum("_chars").over(whole) / F.count("*").over(whole)).alias("_length"),
        (F.sum(marks).over(whole) / F.count("*").over(whole)).alias("_stops"),
        F.min("_place").over(whole).alias("_from"), F.max("_place").over(whole).alias("_until"),
        (F.min("_linked").over(whole) & (F.count("*").over(whole) >= _LINKS)).alias("_list"),
    )
    # In this order a path's first node follows the path before it, and its last node precedes the path after it.
    paths = Window.partitionBy(*key).orderBy(~said, "_from", "_place")

    def neighbour(name: str, edge: str, shifted):
        at_edge = F.when((F.col("_place") == F.col(edge)) & said, shifted(F.when(said, F.col(name))).over(paths))
        return at_edge.alias(f"{name}{edge}")

    edges = measured.select(
        "*", *[neighbour(n, edge, f) for n in ("_length", "_stops") for edge, f in (("_from", F.lag), ("_until", F.lead))]
    )

    def smooth(name: str):
        before, after = F.max(f"{name}_from").over(whole), F.max(f"{name}_until").over(whole)
        own = F.col(name)
        return (F.coalesce(before, own) + 2 * own + F.coalesce(after, own)) / 4

    def fused(length, stops):
        return length + _MARK_CHARS * stops

    scored = edges.select(
        *key, "_place", "_path", "_holder", "_block", "_text", "_chars", "_list",
        F.when(said, fused(F.col("_length"), F.col("_stops"))).alias("_own"),
        F.when(said, fused(smooth("_length"), smooth("_stops"))).alias("_smooth"),
    )
    page = Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_holder = Window.partitionBy(*key, "_holder").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.sum(F.col("_own") * F.col("_chars")).over(page) / F.nullif(F.sum("_chars").over(page), F.lit(0))
    content = F.coalesce(F.least("_own", "_smooth") >= threshold * F.col("_mean"), F.lit(False))
    judged = scored.withColumn("_mean", mean).withColumn("_content", content)
    # First and last content node of the part that holds a node; null where it has none.
    held = judged.select(
        "*", *[f(F.when(F.col("_content"), F.col("_place"))).over(by_holder).alias(n) for n, f in (("_first", F.min), ("_last", F.max))]
    )
    part = F.struct(F.concat("_holder", F.lit("/")).alias("inside"), "_first", "_last")
    is_part = F.col("_first").isNotNull() & ~F.col("_holder").isin(*_WHOLE_PAGE)
    around = held.withColumn("_parts", F.collect_set(F.when(is_part, part)).over(page))
    within = F.exists(
        "_parts",
        lambda x: F.startswith(F.col("_holder"), x["inside"]) & F.col("_place").between(x["_first"], x["_last"]),
    )
    beside = (F.col("_first").isNotNull() | within) & ~F.col("_list")
    kept = around.where(~said | F.col("_content") | beside)
    gathered = kept.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("_place", "_block", "_text"))).alias("_nodes")
    )
    # A mark that HTML forbids in texts separates blocks.
    border = F.lit("\0")

    def piece(node, i):
        last = F.get(F.col("_nodes"), F.greatest(i - 1, F.lit(0)))["_block"]
        return F.concat(F.when(node["_block"] != last, border).otherwise(""), F.replace(node["_text"], border, F.lit("")))

    joined = F.array_join(F.transform("_nodes", piece), "")
    tidy = F.transform(F.split(joined, "\0"), lambda b: F.trim(F.regexp_replace(b, r"(?U)\s+", " ")))
    texts = gathered.select(*key, F.array_join(F.filter(tidy, lambda b: b != ""), "\n\n").alias("_text"))
    own = keyed.select(*key, F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    text = F.coalesce("_text", F.lit(""))
    return own.join(texts, key, "left").select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), *key
    )
