"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut into text blocks at block-level tags.  A block is described by its words and link
density, those of its two neighbours, where it stands (in an article, in a part such as a menu,
neither) and whether the page marks an article at all.  A decision tree, trained by Spark on the
blocks of the labelled pages below, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FEATURES = ("words_before", "words", "words_after", "density_before", "density", "density_after", "place", "marked")

#: Hand-labelled pages, the small table that the tree learns from.  ``{n}`` stands for n words, and a
#: block that is main text begins with ``§``.
LABELLED = [
    # pages that mark their article: all of it is text, short blocks and lists of links too
    "<nav><a>{1}</a><a>{1}</a></nav><article><h1>§{8}</h1><p>§{60}</p><p>§{3}</p><p>§{55}</p></article><footer>{9}</footer>",
    "<div class=ad>{7}</div><article><h1>§{4}</h1><p>§{120}</p></article><footer>{12} <a>{1}</a></footer>",
    "<nav><ul><li><a>{1}</a><li><a>{2}</a></ul></nav><main><h2>§{6}</h2><ul><li>§<a>{9}</a></li><li>§<a>{7}</a></li></ul><p>§{30} <a>{20}</a></p></main><aside><p>{45}</p></aside>",
    "<header><h1><a>{3}</a></h1></header><article><p>§{1}</p><p>§{2}</p><p>§{1}</p></article><div class=comments><p>{40}</p><p>{70}</p></div>",
    "<article><h1>§{12}</h1><p>§{90}</p><form><p>{11}</p></form><p>§{45}</p><aside>{30}</aside><blockquote>§{14}</blockquote></article><p>{60}</p>",
    "<p>{25}</p><div>{20}</div><article><div>§{250}</div><div>§{5} <a>{5}</a></div></article><div>{110}</div><div>{8}</div><div>{2} <a>{1}</a></div>",
    "<div class=cookie>{35}</div><article><p>§<a>{2}</a></p><p>§{33}</p><p>§{61} <a>{1}</a></p></article><div><a>{3}</a></div><div>{30}</div>",
    "<div>{3}</div><article><p>§{8}</p><p>§{80}</p><section id=comments><p>{150}</p><p>{6}</p></section></article><section class=related><p>{50}</p></section>",
    # pages that mark none: long blocks with few links, and short ones among them
    "<div><a>{1}</a></div><div><a>{2}</a></div><p>§{60}</p><p>§{50}</p><p>§{45}</p><div><a>{2}</a></div><div><a>{1}</a></div>",
    "<div><a>{2}</a></div><h1>§{9}</h1><p>§{80}</p><h2>§{4}</h2><p>§{45}</p><p>§{6}</p><p>§{70}</p><div>{3} <a>{4}</a></div><div><a>{2}</a></div>",
    "<p>§{200} <a>{20}</a></p>",
    "<p>§{25}</p>",
    "<div><a>{3}</a></div><p>§{30}</p><p>§{18} <a>{4}</a></p><p>§{25}</p><div>{5}</div><div><a>{1}</a></div>",
    "<div>{1} <a>{1}</a></div><div><a>{20}</a></div><div><a>{2}</a></div><p>§{70}</p><p>§{3}</p><p>§{40}</p><div><a>{3}</a></div><div>{4}</div>",
    "<div class=sidebar><p>{40}</p><p>{60}</p></div><p>§{35}</p><p>§{4} <a>{1}</a></p><p>§{28}</p><div class=footer>{11} <a>{1}</a></div>",
    "<div><a>{6}</a></div><div><a>{6}</a></div><div>{6} <a>{30}</a></div><p>§{15}</p><p>§{30}</p><div><a>{5}</a></div><div>{2}</div>",
    "<div>{4}</div><div>{5}</div><div>{4} <a>{4}</a></div><p>§{9}</p><p>§{22} <a>{2}</a></p><p>§{30}</p><form>{20}</form><div>{3}</div><div><a>{2}</a></div>",
    "<div><a>{2}</a></div><div>{5}</div><div><a>{3}</a></div><div>{3} <a>{3}</a></div>",
    "<div>{6}</div><div>{6}</div><div>{5}</div><div><a>{2}</a></div>",
    "<table><tr><td><a>{1}</a></td><td><a>{2}</a></td></tr></table><p>§{48}</p><ul><li>§{7}</li><li>§{9}</li><li>§{6}</li></ul><p>§{52}</p><div><a>{7}</a></div><div><a>{8}</a></div><div class=newsletter>{25}</div>",
]

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose whole content is no text of the page; those that are raw text run to their end tag or the page's end.
RAW, SKIPPED = "script|style|title|textarea|noscript|iframe", "template|svg|math|object|canvas|select|button"
BOILER = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
ARTICLE = frozenset(("article", "main"))
#: Elements that are followed until they close; others need no stack.
HELD = BOILER | ARTICLE | frozenset(("header", "div", "section", "ul", "ol", "table", "p", "li", "span", "td", "figure", "dl"))
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe subscription social share sharing related recommended comment comments disqus respond replies footer copyright popup modal widget login signup masthead".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())

ATTRIBUTES = r"(?:[^>\"'/]+|/(?!>)|\"[^\"]*\"|'[^']*')*+"
#: Comments; skipped elements, whole (closed in themselves or without an end tag they hold nothing);
#: options up to the next tag, as their end tags may be left out; all other tags.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|(?=<body\b)|\Z)|<(?P<skip>{SKIPPED})\b{ATTRIBUTES}>.*?</(?P=skip)\s*>|<option\b[^>]*>[^<]*"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>",
    re.I | re.S,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def part_of(name: str, rest: str, inside: int) -> int:
    """Where an element puts what it holds: 1 article, -1 a part that is none, ``inside`` if it changes nothing."""
    words, role = set(), ""
    for kind, *values in NAMES.findall(rest) if "=" in rest else ():
        value = next(filter(None, values), "").lower()
        if kind.lower() == "role":
            role = value
        else:
            words |= {*re.split(r"[^a-z0-9]+", value)}
    if inside < 0:
        return inside
    if name in ARTICLE or role in ("main", "article"):
        return -1 if words & COMMENTS else 1
    if name in BOILER or role in ROLES or words & PARTS or (not inside and (name == "header" or "header" in words)):
        return -1
    return inside


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """Text blocks in page order: text, words, link density, place."""
    found, parts, linked = [], [], []
    held: list[tuple[str, int]] = []
    place, links, at = 0, 0, 0

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if links:
                linked.append(plain)

    def flush() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                share = min(1.0, len(" ".join(linked).split()) / len(words)) if linked else 0.0
                found.append((" ".join(words), len(words), share, place))
            parts.clear()
            linked.clear()

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:  # a form's fields end a block as little as a comment does
            continue
        closing = m["close"] or m["close2"]
        if name in BLOCKS:
            flush()
            links = 0
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        if name not in HELD:
            continue
        if closing:
            for i in range(len(held) - 1, -1, -1):
                if held[i][0] == name:
                    place = held[i][1]
                    del held[i:]
                    break
        elif name not in ("p", "li", "td") or "=" in (m["rest"] or ""):
            if (m["rest"] or "").endswith("/"):
                continue
            held.append((name, place))
            place = part_of(name, m["rest"] or "", place)
    text(page[at:])
    flush()
    return found


def features(found: list[tuple[str, int, float, int]]) -> list[tuple]:
    marked = int(any(x[3] > 0 for x in found))
    edge = ("", 0, 0.0, 0)
    around = [edge, *found, edge]
    return [(a[1], b[1], c[1], a[2], b[2], c[2], b[3], marked) for a, b, c in zip(around, around[1:], around[2:], strict=False)]


def labelled_blocks(pages: list[str] = LABELLED) -> list[tuple]:
    """The features of every block of labelled pages, then 1.0 for main text."""
    out = []
    for page in pages:
        found = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        out += [(*map(float, row), float(block[0].startswith("§"))) for block, row in zip(found, features(found), strict=True)]
    return out


def grown(spark: SparkSession, pages: list[str] = LABELLED, depth: int = 8) -> tuple | float:
    """The tree that Spark learns from labelled pages, as nested (feature, threshold, low, high)."""
    rows = spark.createDataFrame(labelled_blocks(pages), [*FEATURES, "label"]).coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(rows)

    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        return node.split().featureIndex(), node.split().threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._java_obj.rootNode())


def is_text(tree: tuple | float, row: tuple) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree > 0


def main_text(page: str | None, tree: tuple | float) -> str:
    found = blocks(page or "")
    return "\n\n".join(x[0] for x, row in zip(found, features(found), strict=True) if is_text(tree, row))


def extracted(pages: DataFrame, *, column: str = "html", into: str = "text", tree: tuple | float | None = None) -> DataFrame:
    """Adds ``into``, the main text of ``column``; empty for null, empty and text-free pages.

    A column of that name is replaced, be it ``column`` itself; all others are kept.
    """
    tree = grown(pages.sparkSession) if tree is None else tree

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([main_text(x.as_py(), tree) for x in batch.column(batch.schema.get_field_index(column))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, into])

    rows = pages if into == column else pages.drop(into)
    kept = [c for c in pages.columns if c != into]
    return rows.mapInArrow(extract, StructType([*pages.select(*kept).schema.fields, StructField(into, StringType())]))


def op8_html(spark, sf_dir: str) -> DataFrame:
    """Every page's main text, empty for null and empty pages and those without any.

    Pages that repeat keep a row each, null keys and addresses stay null; an empty table gives no rows.
    """
    found = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
