"""Main text of web pages by site style trees.

All distinct pages of a host are merged into one tree whose nodes are the paths of
tag, class and id from the root. Two counts describe a node over the pages that hold
it: the presentation styles (sequences of its children) and the texts in it. Their
entropies give its importance: layouts that never vary and texts that recur on
most pages are unimportant, texts of their own are important. The pages of all
hosts make one more tree, for layouts that a host shows too seldom.

A page then drops its branches of low importance, inside its article and outside.
What markup says of a branch only lowers its importance: boilerplate names of
classes and ids, and lying outside a declared article. Which text is the article is not
left to the markup alone: if the unnamed text beside a declared article weighs more than
what is in it, by length and importance, the declared one is a teaser, and lying
outside says nothing. A branch that no tree knows stays. Elements that are no text of an article by the meaning of their tag
(scripts, styles, forms, navigation, footers) and hidden ones go without a tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.llm.common import materialise

#: Branches under this importance go.
KEEP_IMPORTANCE = 0.3
#: A node is judged where it is on so many of a tree's distinct pages and on this share of them; at most
#: (nodes of a page) / MIN_SHARE nodes of a tree are, however many pages it has.
MIN_PAGES, MIN_SHARE = 5, 0.01
#: How much of a node's importance passes on to its texts for each presentation style.
GAMMA = 0.9
#: Importance left to a branch with a boilerplate name, and to one outside the page's article.
NAMED, OUTSIDE = 0.32, 0.3
#: A text on this share of a host's pages, and on so many pages at least, is boilerplate wherever it stands.
COMMON_SHARE, COMMON_PAGES = 0.7, 20
#: Part of an article's unnamed text that the tree may take; beyond, pages are near copies of each other and all of it stays.
MOST_TAKEN = 0.5
REMEMBERED_PATHS = 100_000
#: Tree of all hosts.
EVERYWHERE = "*"

# Elements by role in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "template", "iframe", "svg", "xmp", "noembed"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "ms", "msqrt", "mstyle", "msub", "msup", "mtext", "q", "s",
    "samp", "semantics", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "button", "select", "menu", "dialog", "head", "object", "audio", "video", "canvas"}
MAIN_TAGS = {"article", "main"}
CLOSES_ITSELF = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words that name boilerplate, and words that may stand beside them in one name.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments",
    "respond", "disqus", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "banner", "notice", "alert",
    "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "search", "skip", "copyright",
    "disclaimer", "header",
}
BESIDE = {
    "area", "bar", "block", "bottom", "box", "btn", "buttons", "container", "content", "form", "inner", "left", "list", "links", "main",
    "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_END_OF_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[^a-z]+")


@dataclass
class Open:
    """An open element: its path, whether its tag or a hidden one above drops it, what its names leave of its importance."""

    tag: str
    path: int
    hard: str
    left: float
    main: bool
    block: int
    children: list


@dataclass
class Block:
    """A run of text: its path, its parent's, and its parts (path, importance left, raw text); named inline elements are parts."""

    path: int
    parent: int
    main: bool
    parts: list = field(default_factory=list)

    def text(self, keep=lambda path, left: True) -> str:
        """Text of the parts that stay."""
        return " ".join(html.unescape("".join(raw if keep(path, left) else " " for path, left, raw in self.parts)).split())


_paths: dict[tuple[int, str], int] = {}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _path(parent: int, style: str) -> int:
    got = _paths.get((parent, style))
    if got is None:
        if len(_paths) > REMEMBERED_PATHS:
            _paths.clear()
        got = _paths[(parent, style)] = _signed(xxhash.xxh64_intdigest(style.encode("utf-8", "replace"), parent & 0xFFFFFFFFFFFFFFFF))
    return got


def _value(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "replace")))


@lru_cache(20_000)
def importance_left(label: str) -> float:
    """What the class names and ids of a node leave of its importance.

    A name counts if it consists of boilerplate words and words beside them alone
    (``cookie-notice``, ``sidebar-left``; not ``no-ads``, ``comments-open``,
    ``related-work``), and as much as its share of the node's names.
    """
    names = [set(_PARTS.split(n)) - {""} for n in label.split()]
    named = sum(1 for n in names if not n.isdisjoint(NAMES) and n <= NAMES | BESIDE)
    return (named * NAMED + (len(names) - named)) / len(names) if names else 1.0


def parse(page: str) -> tuple[list[Block], dict[int, str]]:
    """Text blocks in page order, and the presentation style of each node (its children's styles).

    One pass whose steps do not depend on the depth of open elements: the places of
    open tags are kept by name, and an element is opened and closed once.
    """
    stack = [Open("", 0, "", 1.0, False, 0, [])]
    open_at: dict[str, list[int]] = {}
    blocks: list[Block] = []
    styles: dict[int, str] = {}
    parts: list[tuple[int, float, str]] = []

    def text(raw: str) -> None:
        top = stack[-1]
        if not top.hard:
            parts.append((top.path, top.left, raw))

    def flush() -> None:
        if parts:
            if any(not raw.isspace() for _, _, raw in parts):
                at = stack[stack[-1].block]
                above = stack[stack[-1].block - 1] if stack[-1].block else at
                blocks.append(Block(at.path, stack[above.block].path, at.main, parts.copy()))
            parts.clear()

    def pop() -> None:
        gone = stack.pop()
        open_at[gone.tag].pop()
        if gone.tag not in INLINE:
            seen = " ".join(dict.fromkeys(gone.children))
            styles[gone.path] = f"{styles[gone.path]}|{seen}" if gone.path in styles and styles[gone.path] != seen else seen

    def close(index: int) -> None:
        if stack[-1].block >= index:
            flush()
        while len(stack) > index:
            pop()

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    at, n, end_of_tags = 0, len(page), page.rfind(">")
    while at < n:
        found = _TOKEN.search(page, at) if at <= end_of_tags or page.startswith(("<!", "<?"), at) else None
        if found is None:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if open_at.get(tag):
                close(open_at[tag][-1])
            elif tag not in INLINE:
                flush()
            continue
        attributes = found[3]
        if tag in RAW:
            end = _END_OF_RAW[tag].search(page, at)
            at = n if end is None else end.end()
            continue
        if tag == "br" or tag == "wbr":
            text(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            if stack[stack[-1].block].tag == "p":  # a block ends an open paragraph
                close(stack[-1].block)
            if tag in CLOSES_ITSELF:
                own = last(CLOSES_ITSELF[tag])
                if own > last(SCOPES[tag]):
                    close(own)
        if tag in VOID:
            continue
        above = stack[-1]
        style, left, hard, main, named = tag, above.left, above.hard, above.main, False
        if attributes and not attributes.isspace() and attributes != "/":
            given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            label = " ".join(filter(None, (given.get("class", ""), given.get("id", "")))).lower()
            if label and tag not in ("html", "body"):
                style = f"{tag}.{label}"
                own_left = importance_left(label)
                named, left = own_left < 1, min(left, own_left)
            if "hidden" in given or _HIDDEN.search(given.get("style", "")) or (tag not in MAIN_TAGS and given.get("role", "").lower() in ROLES):
                hard = hard or "hidden"
        if tag in BOILERPLATE_TAGS or (tag == "header" and not main):
            hard = hard or tag
        elif tag == "form":
            hard = hard or "form"
        elif tag in MAIN_TAGS:
            # An article within a form is no part of it, and names of what is around an article say nothing of it.
            main, left, hard = True, 1.0, "" if hard == "form" else hard
        path = above.path if inline and not named else _path(above.path, style)
        if not inline:
            stack[above.block].children.append(style)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, path, hard, left, main, above.block if inline else len(stack), []))
        if inline and named:
            styles.setdefault(path, "")
    flush()
    while len(stack) > 1:
        pop()
    styles[0] = " ".join(dict.fromkeys(stack[0].children))  # the node that all pages show
    return blocks, styles


#: What a page knows of the trees: importance by path, and the texts that are boilerplate on its host.
Tree = tuple[dict, frozenset]
NO_TREE: Tree = ({}, frozenset())


def extract(page: str | None, tree: Tree = NO_TREE) -> str:
    """Blocks that stay, joined by blank lines."""
    known, common = tree
    blocks, _ = parse(page or "")
    inside = any(b.main for b in blocks)

    whole = [b.text() for b in blocks]
    mass = {True: 0.0, False: 0.0}
    for b, t in zip(blocks, whole):
        if b.main or (b.path in known and all(left == 1.0 for _, left, _ in b.parts) and _value(t) not in common):
            mass[b.main] += len(t) * known.get(b.path, 1.0)
    position = OUTSIDE if mass[True] >= mass[False] else 1.0

    def keeps(b: Block):
        outside = position if inside and not b.main else 1.0
        return lambda path, left: path not in known or known[path] * left * outside >= KEEP_IMPORTANCE

    plain = [t if all(left == 1.0 for _, left, _ in b.parts) else b.text(lambda _, left: left == 1.0) for b, t in zip(blocks, whole)]
    kept = []
    for b, t in zip(blocks, whole):
        stays = keeps(b)
        live = [stays(path, left) for path, left, _ in b.parts] if t and _value(t) not in common else [False]
        kept.append(t if all(live) else b.text(stays) if any(live) else "")
    own = [i for i, b in enumerate(blocks) if b.main == inside]
    if (inside or not any(kept)) and sum(len(kept[i]) for i in own) < (1 - MOST_TAKEN) * sum(len(plain[i]) for i in own):
        for i in own:
            kept[i] = plain[i]
    return "\n\n".join(t for t in (kept if any(kept) else whole) if t)  # no tree empties a page


def host_of(url: F.Column) -> F.Column:
    """Lower-case host without port; null and hostless urls share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][-+.A-Za-z0-9]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def node_counts(pages: DataFrame) -> DataFrame:
    """(tree, path, parent, kind, value, c): distinct pages of a host, and of all hosts, that show a style (kind 0) or a text (1) at a node.

    Copies of a page say nothing of what varies between pages, so a page counts by
    the hash of its html. The pages themselves do not move, only hashes do.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set = set()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = page.as_py()
                blocks, styles = parse(page)
                copy = _value(page)
                rows.update((host, p, p, 0, _value(s), copy) for p, s in styles.items())
                for b in blocks:
                    rows.add((host, b.path, b.parent, 1, _value(b.text()), copy))
                    rows.update((host, path, b.path, 1, _value(raw), copy) for path, _, raw in b.parts if path != b.path)
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64()]
            names = ["tree", "path", "parent", "kind", "value", "copy"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("html is not null")
    seen = rows.mapInArrow(nodes, "tree string, path long, parent long, kind byte, value long, copy long").distinct()
    hosts = materialise(seen.groupBy("tree", "path", "parent", "kind", "value").agg(F.count("*").alias("c")), "html-counts")
    every = hosts.groupBy("path", "parent", "kind", "value").agg(F.sum("c").alias("c"))
    return hosts.unionByName(every.select(F.lit(EVERYWHERE).alias("tree"), "path", "parent", "kind", "value", "c"))


def node_importance(counts: DataFrame) -> DataFrame:
    """(tree, path, importance) of the text nodes on MIN_PAGES pages of their tree and MIN_SHARE of them.

    Presentation: 1 if a single page holds the parent, else the entropy of its
    styles to the base of its pages. Content: 1 less the mean, over the node's
    texts, of log(pages with the text) to the base of the node's pages.
    """
    c = F.col("c").cast("double")
    shown = F.col("kind") == 0
    nodes = materialise(
        counts.groupBy("tree", "path", "parent").agg(
            F.sum(F.when(shown, c)).alias("shown"),
            F.sum(F.when(shown, c * F.ln(c))).alias("shown_log"),
            F.count(F.when(shown, 1)).alias("styles"),
            F.sum(F.when(~shown, F.ln(c))).alias("text_log"),
            F.count(F.when(~shown, 1)).alias("texts"),
        ),
        "html-nodes",
    )
    base = F.ln("shown")
    layout = nodes.where("styles > 0").groupBy("tree", "path").agg(
        F.max(F.when(F.col("shown") > 1, (base - F.col("shown_log") / F.col("shown")) / base).otherwise(F.lit(1.0))).alias("layout"),
        F.max("styles").alias("styles"),
        F.max("shown").alias("m"),
    )
    size = layout.where("path = 0").select("tree", F.col("m").alias("pages"))
    texts = nodes.where("texts > 0").groupBy("tree", "path", "parent").agg(F.sum("text_log").alias("text_log"), F.sum("texts").alias("texts"))
    own = layout.select("tree", "path", "m").join(size, "tree").where(f"m >= {MIN_PAGES} and m >= {MIN_SHARE} * pages")
    above = layout.select("tree", F.col("path").alias("parent"), "layout", "styles")
    content = 1 - F.col("text_log") / F.col("texts") / F.ln("m")
    share = F.pow(F.lit(GAMMA), F.coalesce("styles", F.lit(1)))
    joined = texts.join(own, ["tree", "path"]).join(above, ["tree", "parent"], "left")
    return joined.groupBy("tree", "path").agg(F.max((1 - share) * F.coalesce("layout", F.lit(0.0)) + share * content).alias("importance"))


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, paths, importances, common): what each host's pages need to know, a row a host; the tree of all hosts has the host ``*``.

    The lists are bounded by MIN_SHARE and COMMON_SHARE times the nodes of a page.
    """
    counts = node_counts(pages)
    nodes = node_importance(counts).groupBy("tree").agg(F.collect_list(F.struct("path", "importance")).alias("nodes"))
    shown = counts.where("kind = 0 and path = 0").groupBy("tree").agg(F.sum("c").alias("pages"))
    often = counts.where(f"kind = 1 and c >= {COMMON_PAGES} and tree <> '{EVERYWHERE}'").groupBy("tree", "value").agg(F.max("c").alias("c"))
    common = often.join(shown, "tree").where(f"c >= {COMMON_SHARE} * pages").groupBy("tree").agg(F.collect_list("value").alias("common"))
    return nodes.join(common, "tree", "full").select(
        F.col("tree").alias("host"), F.col("nodes.path").alias("paths"), F.col("nodes.importance").alias("importances"), "common"
    )


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of each row of (page_id, url, html).

    Returns page_id, url, text and n_chars. Null and empty pages give an empty text;
    pages without a usable url share one style tree; repeated rows are extracted
    each and count once in the tree, as do other copies of a page; pages are read
    whole, in time that grows with their length however they nest; an empty table
    gives an empty result; null ids are carried along; other columns are ignored.
    """
    trees = materialise(style_trees(pages), "html-trees")
    every = trees.where(F.col("host") == EVERYWHERE).select("paths", "importances").head()
    shared = dict(zip(every.paths or (), every.importances or ())) if every else {}  # bounded, see MIN_SHARE
    of_all = pages.sparkSession.sparkContext.broadcast(shared)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    known = trees.where(F.col("host") != EVERYWHERE).withColumnRenamed("host", "thost")
    joined = rows.join(known, F.col("host") == F.col("thost"), "left").drop("host", "thost")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, paths, importances, common in zip(*(batch.column(i) for i in range(2, 6))):
                own = dict(zip(paths.as_py() or (), importances.as_py() or ()))
                out.append(extract(page.as_py(), (of_all.value | own, frozenset(common.as_py() or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    found = joined.mapInArrow(texts, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
