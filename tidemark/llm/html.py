"""HTML extraction by site style trees.

Each page is parsed once into blocks of text, each with its node of the host's style tree
(the chain of tags and classes above it). Merging a host's pages gives, for each node, how its
contents and its presentations (inner tags) spread over pages; the importance of a node is
the weighted mean of both normalised entropies: near 0 where pages repeat one another, 1 where
each page has its own. Pages with the same article (or, without one, the same blocks) count once, and a node that fewer than ``shown``
different pages have counts as important. Every block is put to this vote: its node's importance, shifted
by a prior for what its tags say, must reach ``least``.

Priors (PRIOR): inside an article or main element a node needs little importance; a branch whose class
or id says that it is noise, or that lies beside an article, is lost unless it holds about half or more of its
host's text, which no advert or menu does; other branches stand for themselves. A block whose text its node has
in more than ``repeated`` of the host's different pages (``shown`` at least) goes, too. What its element
says to be no text of the page (menus, headers, footers, sidebars, forms, scripts, styles, hidden parts), and a branch whose class or id
is that of reader comments, isn't parsed: no vote could tell comments, as different from page to page as articles, from the text.

Defined results: null or empty html gives an empty text; null url gives the empty host, whose
pages form one site; repeated rows get a result each; text cut off inside a tag ends there; ids of any
type come back as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, done

# Element names and class words with a meaning of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meta picture q ruby rp rt s samp small source span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head title nav menu footer aside form button select option input dialog iframe object embed applet canvas svg audio video map template noscript script style".split())
CONTENT = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar comment comments commentlist disqus respond notice notices cookie cookies consent gdpr alert popup modal overlay "
    "newsletter subscribe signup related recommended share sharing social widget widgets toolbar pagination pager skip login search copyright disclaimer".split()
)
#: A class or id, among those that white space separates, of a branch of reader comments: the contract takes them out however much they hold.
COMMENTS = re.compile(r"(?:^|\s)(?:(?:user|reader|post|article|disqus|fb)[-_]?)?(?:comments?|respond|disqus)(?:[-_]?(?:\d+|list|section|area|thread|body|content|text|item|wrap|wrapper|container|box|block|form|respond))*(?=\s|$)")
#: Raw text elements, comments, declarations, and tags whose quoted values may hold ">".
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>\"']+|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
DROP, KEEP, VOTE, HINT, BESIDE = range(5)
#: What a kind of branch adds to its importance. HINT and BESIDE also get their branch's share of the host's text.
PRIOR = {KEEP: 0.2, VOTE: 0.0, HINT: -1.2, BESIDE: -1.2}


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _kind(tag: str, attributes: str, inside: bool) -> tuple[int, str]:
    """What a tag says of its branch, and its class names for the style tree. inside: within an article."""
    if tag in DROPPED or tag == "header" and not inside:
        return DROP, ""
    style = ""
    if attributes:
        a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attributes)}
        style = a.get("class", "").lower()
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return DROP, style
        role = a.get("role", "").lower()
        if role in ROLES:
            return DROP, style
        if tag not in ("html", "body") and any(COMMENTS.search(x) for x in (style, a.get("id", "").lower())):
            return DROP, style
        if tag not in ("html", "body") and not NOISE.isdisjoint(WORDS.findall(f"{style} {a.get('id', '').lower()}")):
            return HINT, style
        if role in ("main", "article"):
            return KEEP, style
    return (KEEP if tag in CONTENT else VOTE), style


def blocks(html: str) -> list[tuple[int, int, int, int, str]]:
    """The blocks of a page in order: kind, node, branch (the node where a HINT begins; else the own), presentation, text."""
    out: list[tuple[int, int, int, int, str]] = []
    stack: list[tuple[str, int, int, int]] = [("", VOTE, 0, 0)]  # tag, kind, node, branch
    held: list[str] = []
    shape: list[str] = []

    def flush() -> None:
        if held:
            _, kind, node, branch = stack[-1]
            text = " ".join(unescape("".join(held)).split()) if kind != DROP else ""
            if text:
                out.append((kind, node, branch or node, _hash(*shape), text))
            held.clear()
        shape.clear()

    def enter(tag: str, kind: int, style: str) -> None:
        _, above, node, branch = stack[-1]
        kind = next(k for k in (DROP, HINT, KEEP, VOTE) if k in (kind, above))
        node = _hash(node, tag, style, kind)
        stack.append((tag, kind, node, branch or (node if kind == HINT else 0)))

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        raw, close, tag, attributes = m[1], m[2] or m[5], m[3] or m[6], m[4] or m[7] or ""
        if raw or not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE:
            shape.append(tag)
            if tag in VOID:
                continue
            if close:
                known = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag or stack[i][0] not in INLINE), 0)
                if known and stack[known][0] == tag:
                    if stack[-1][1] != stack[known - 1][1]:
                        flush()
                    del stack[known:]
                continue
            kind, style = _kind(tag, attributes, stack[-1][1] == KEEP)
            if kind in (DROP, HINT) and stack[-1][1] not in (DROP, kind):
                flush()
                enter(tag, kind, style)
            else:
                stack.append((tag, *stack[-1][1:]))
            continue
        flush()
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        open_p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] not in INLINE), 0)
        if stack[open_p][0] == "p" or stack[open_p][0] == tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            del stack[open_p:]
        enter(tag, *_kind(tag, attributes, stack[-1][1] == KEEP))
    if at < len(html):
        held.append(html[at:])
    flush()
    if any(b[0] == KEEP for b in out):
        out = [(BESIDE, _hash(n, "beside"), _hash(n, "beside"), *b) if k == VOTE else (k, n, r, *b) for k, n, r, *b in out]
    return out


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, uid (unique), host, body (the hash of its article, or of all blocks), and of every block kind, node, branch, content, shape and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for b in batches:
            uids, bodies, columns = [], [], [[] for _ in range(6)]
            for html in b.column("html").to_pylist():
                found = blocks(html)
                each = [(kind, node, branch, _hash(text), shape, text) for kind, node, branch, shape, text in found]
                for k, column in enumerate(columns):
                    column.append([x[k] for x in each])
                uids.append(n)
                bodies.append(_hash(*((x[1], x[3]) for x in [y for y in each if y[0] == KEEP] or each)))
                n += 1
            made = [pa.array(c, pa.list_(kind)) for c, kind in zip(columns, (pa.int32(), *[pa.int64()] * 4, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host")), pa.array(uids, pa.int64()), pa.array(bodies, pa.int64()), *made], names)

    names = ["page_id", "url", "host", "uid", "body", "kind", "node", "branch", "content", "shape", "text"]
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, host string, uid long, body long, kind array<int>, node array<long>, branch array<long>, content array<long>, shape array<long>, text array<string>"
    )


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, node, kind, branch, content, shape, size, n: how many different pages of the host show this block; the text's size in code points."""
    block = F.arrays_zip("kind", "node", "branch", "content", "shape", F.transform("text", lambda t: F.length(t)).alias("size"))
    rows = parsed.select("host", "body", F.explode(block).alias("b")).select("host", "body", "b.*")
    return rows.distinct().groupBy("host", "node", "kind", "branch", "content", "shape", "size").agg(F.count("*").alias("n"))


def importance(tree: DataFrame, content_weight: float = 0.9) -> DataFrame:
    """host, node, kind, branch, shown (its blocks) and importance of every node."""
    each = tree.select("host", "node", "kind", "branch", "n", F.explode(F.array(F.struct(F.lit(True).alias("c"), F.col("content").alias("v")), F.struct(F.lit(False).alias("c"), F.col("shape").alias("v")))).alias("f"))
    counts = each.groupBy("host", "node", "kind", "branch", "f.c", "f.v").agg(F.sum("n").alias("n"))
    n, total = F.col("n").cast("double"), F.sum("n").cast("double")
    spread = F.when(F.count("*") == F.sum("n"), F.lit(1.0)).otherwise((F.log(total) * total - F.sum(n * F.log(n))) / total / F.log(total))
    kinds = counts.groupBy("host", "node", "kind", "branch", "c").agg(F.sum("n").alias("shown"), spread.alias("entropy"))
    weight = F.when(F.col("c"), F.lit(content_weight)).otherwise(F.lit(1 - content_weight))
    return kinds.groupBy("host", "node", "kind", "branch").agg(F.max("shown").alias("shown"), F.sum(weight * F.col("entropy")).alias("importance"))


def verdicts(tree: DataFrame, least: float, shown: int) -> DataFrame:
    """host, node, score of every node: its importance, its kind's prior, and of doubtful branches their share of the host's text."""
    size = F.sum(F.col("size") * F.col("n"))
    of_host = tree.groupBy("host").agg(size.alias("all"))
    share = tree.where(F.col("kind").isin(HINT, BESIDE)).groupBy("host", "branch").agg(size.alias("own")).join(of_host, "host").select("host", "branch", (F.col("own") / F.col("all")).alias("share"))
    prior = F.element_at(F.create_map(*[F.lit(x) for kv in PRIOR.items() for x in kv]), F.col("kind"))
    nodes = importance(tree).join(share, ["host", "branch"], "left")
    value = F.when(F.col("shown") >= shown, F.col("importance")).otherwise(F.lit(1.0)) + prior + F.coalesce("share", F.lit(0.0))
    return nodes.select("host", "node", value.alias("score"))


def extract(pages: DataFrame, least: float = 0.3, shown: int = 4, repeated: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = cut(parse(pages))
    tree = cut(style_tree(parsed))
    low = verdicts(tree, least, shown).where(F.col("score") < least).select("host", "node")
    bodies = parsed.groupBy("host").agg(F.count_distinct("body").alias("pages"))
    often = tree.groupBy("host", "node", "content").agg(F.sum("n").alias("n")).where(F.col("n") >= shown).join(bodies, "host").where(F.col("n") > F.col("pages") * F.lit(repeated)).select("host", "node", "content")
    lost = cut(tree.join(low, ["host", "node"]).select("host", "node", "content").unionByName(often).distinct())
    done(tree)
    # written first, so that where few blocks go the texts need no shuffle
    held = parsed.select("uid", "host", F.explode(F.arrays_zip("node", "content")).alias("b")).select("uid", "host", "b.node", "b.content")
    gone = cut(held.join(lost, ["host", "node", "content"]).groupBy("uid").agg(F.collect_set(F.struct("node", "content")).alias("gone")))
    rest = F.filter(F.arrays_zip("node", "content", "text"), lambda b: F.col("gone").isNull() | ~F.array_contains(F.col("gone"), F.struct(b["node"].alias("node"), b["content"].alias("content"))))
    out = parsed.join(gone, "uid", "left").select("page_id", "url", F.array_join(F.transform(rest, lambda b: b["text"]), "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
