"""Main text of web pages with a site style tree (Yi, Liu and Li 2003).

The DOMs of a host's pages are merged: a tree node is a path of elements with their classes. Two entropies rate a node
over the ``m`` pages that have it: of its presentation (which child sequences pages use) and of its content (over how many
pages each of its texts is spread). A text found on all pages has entropy 1 and importance 0, one found on a single page
importance 1. Pages with the same longest text are copies and count as one page. Little evidence moves a rating towards 1.

Branches of low importance are cut from each page. What the tree cannot tell, on hosts of few pages or with ever new
texts, is told by what elements declare themselves to be: boilerplate by tag, class or role, main content by article and
main. Declared main content is cut only where the tree is sure, and never by half or more. Spark aggregates the statistics
by (host, path), so a host of any size is summed before it meets in one row; no page is grouped with others.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.llm.common import materialize, table, text_slices

#: Branches rated lower are cut: outside declared main content, and inside it.
LOW_OUTSIDE, LOW_INSIDE = 0.93, 0.2
#: A node on ``m`` pages moves from importance 1 to what its texts say by (m - 1) / (m + DOUBT).
DOUBT = 8
#: How far varied presentation makes up for repeated content.
PRESENTATION_WEIGHT = 0.1
#: On a page without a free article, an element with this share of the text is no boilerplate, whatever its name.
MOST_TEXT = 2 / 3
#: So many low nodes (16 bytes each) are broadcast; more are joined by page.
BROADCAST_NODES = 1_000_000
#: Tags up to this length are remembered with their attributes; longer ones are read each time.
REMEMBERED = 4096

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[<>\"']")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style textarea noscript template title iframe svg select button".split()}
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var big".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_DROP_TAGS = frozenset("head nav footer aside form menu dialog object canvas audio video map datalist".split())
_DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert disclaimer sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies discussion disqus respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search popup modal overlay widget toolbar pagination pager skip".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_WORD = re.compile("[a-z]+")


def _attributes(raw: str) -> tuple[str, int, int]:
    return _remembered(raw) if len(raw) <= REMEMBERED else _remembered.__wrapped__(raw)


@lru_cache(4096)
def _remembered(raw: str) -> tuple[str, int, int]:
    """An element's label in paths, whether it is boilerplate (1 by name, 2 by role), and main content (1 article, 2 main)."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").lower()
    words = set(_WORD.findall(names))
    hard = role in _DROP_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    drop = 2 if hard else int(bool(words & _DROP_WORDS))
    main = 2 if role == "main" or "articlebody" in found.get("itemprop", "").lower() else int(role == "article")
    label = ".".join(sorted(found.get("class", "").lower().split()))
    if found.get("id") and not any(c.isdigit() for c in found["id"]):  # numbered ids differ from page to page
        label += "#" + found["id"].lower()
    return label, drop, main


class Block:
    __slots__ = ("path", "text", "drop", "main")

    def __init__(self, path: str, text: str, drop: bool, main: int):
        self.path, self.text, self.drop, self.main = path, text, drop, main


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of all markup in order; comments, declarations and hidden elements have no name.

    Linear in the page: where quotes in a tag do not close, the tag ends at the next ``>``, and so does every tag up to
    where the search for the quote ended.
    """
    at, last, unsure = page.find("<"), page.rfind(">"), -1
    while 0 <= at <= last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, "", False, ""
        elif not (m := _NAME.match(page, at + 1)):
            end = at + 1
            if page[end : end + 1] == "/":  # an end tag without a name is no text
                end = page.find(">", at) + 1
                yield at, end, "", False, ""
        else:
            p, stop = m.end(), -1
            while at >= unsure and (q := _STOP.search(page, p)):
                if q[0] == ">":
                    stop = q.start()
                    break
                p = page.find(q[0], q.end()) + 1 if q[0] != "<" else 0
                if not p:
                    unsure = q.end() if q[0] == "<" else len(page)
                    break
            if stop < 0:
                stop = page.find(">", m.end())
                if stop < 0:
                    return
            name, end = m[0].lower(), stop + 1
            raw = page[m.end() : stop]
            if page[stop - 1] == "/" and not raw.endswith("/"):
                raw += "/"
            if name in _RAW:
                closed = _RAW[name].search(page, end)
                end = closed.end() if closed else len(page)
                yield at, end, "", False, ""
            else:
                yield at, end, name.lstrip("/"), name[0] == "/", raw
        at = page.find("<", end)


def parse(page: str, declared: bool = True) -> tuple[list[Block], dict[str, list[str]]]:
    """Text blocks in page order, and each path's child labels (a block element's presentation).

    Without ``declared``, no block is boilerplate or main content by what its elements are called.
    """
    stack: list[tuple[str, str, bool, int, int, int]] = []  # tag, path, drop, main, innermost of named, outermost of articles
    named: list[list] = []  # elements with a boilerplate name: the next one around, characters, whether main content is in it
    articles: list[list] = []  # articles outside main: the innermost of named, characters
    spots: list[tuple[int, int]] = []  # each block's innermost of named and its article
    blocks: list[Block] = []
    styles: dict[str, list[str]] = {}
    parts: list[str] = []
    hidden: list[str] = []  # open inline elements that are boilerplate

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, path, drop, main, name, article = stack[-1] if stack else ("", "", False, 0, -1, -1)
                blocks.append(Block(path, text, drop, main))
                spots.append((name, article))

    at = 0
    for start, end, tag, closing, raw in tags(page):
        if start > at and not hidden:
            parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag in _INLINE:
            if closing:
                if hidden and hidden[-1] == tag:
                    hidden.pop()
            elif raw and not raw.endswith("/") and declared and (hidden or _attributes(raw)[1]):
                hidden.append(tag)
            continue
        flush()
        hidden.clear()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in _VOID:
            continue
        if stack and stack[-1][0] == "p" and tag in _CLOSES_P or stack and stack[-1][0] == tag and tag in ("li", "option", "tr", "dt", "dd", "td", "th"):
            stack.pop()
        label, drop, main = _attributes(raw) if raw.strip() else ("", 0, 0)
        _, path, in_drop, in_main, name, article = stack[-1] if stack else ("", "", False, 0, -1, -1)
        if tag in ("html", "body"):
            drop = main = 0
            label = ""
        main = 2 if tag == "main" else max(main, int(tag == "article"))
        if not declared:
            drop = main = 0
        by_name = drop == 1
        drop = drop == 2 or declared and (tag in _DROP_TAGS or (tag == "header" and not in_main)) or tag == "head"
        styles.setdefault(path, []).append(tag + label)
        own = f"{path}/{tag}.{label}" if label else f"{path}/{tag}"
        if not raw.rstrip().endswith("/"):
            drop = in_drop or drop
            if by_name:
                named.append([name, 0, False])
                name = len(named) - 1
            if main and not in_main and not drop:
                if main == 1:
                    articles.append([name, 0])
                    article = len(articles) - 1
                for k in _around(named, name) if main == 2 else ():
                    named[k][2] = True
            stack.append((tag, own, drop, 0 if drop else max(in_main, main), name, article))
    if at < len(page) and not hidden:
        cut = re.search("<[a-zA-Z/!]", page[at:])  # a tag that the page's end cuts off
        parts.append(page[at : at + cut.start()] if cut else page[at:])
    flush()
    if named:
        _drop_named(blocks, spots, named, articles)
    return blocks, styles


def _around(named: list[list], k: int) -> Iterator[int]:
    """A named element and those around it."""
    while k >= 0:
        yield k
        k = named[k][0]


def _drop_named(blocks: list[Block], spots: list[tuple[int, int]], named: list[list], articles: list[list]) -> None:
    """Names drop what holds neither a main element, nor an article larger than all unnamed text, nor most of the page's text.

    The last counts only where no article or main element stands outside all names: next to a short article, a large
    element with such a name is still an advertisement.
    """
    total = plain = 0
    free = any(b.main and not b.drop and name < 0 for b, (name, _) in zip(blocks, spots, strict=True))
    for b, (name, article) in zip(blocks, spots, strict=True):
        if not b.drop:
            total += len(b.text)
            plain += len(b.text) * (name < 0)
            if article >= 0:
                articles[article][1] += len(b.text)
            for k in _around(named, name):
                named[k][1] += len(b.text)
    largest = max(articles, key=lambda a: a[1], default=[-1, 0])
    for k in _around(named, largest[0]) if largest[1] > plain else ():
        named[k][2] = True
    for b, (name, _) in zip(blocks, spots, strict=True):
        b.drop = b.drop or any(not named[k][2] and (free or named[k][1] <= MOST_TEXT * total) for k in _around(named, name))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def node_id(host: str, path: str) -> int:
    x = xxhash.xxh3_64_intdigest(f"{host}\x00{path}".encode())
    return x - 2**64 if x >= 2**63 else x


def main_text(page: str, importance: Callable[[str], float], declared: bool = True) -> str:
    """The page's text without branches of low importance and declared boilerplate.

    Of what the tree leaves, blocks inside an article or main element are taken if there are any, else all; articles with
    less text than what is left outside them are teasers, and then all blocks are taken. Where the tree would take half
    of the declared main content or more, the page is one of many near copies, and that content stays as it is.
    """
    blocks = [b for b in parse(page, declared)[0] if not b.drop]
    rated = [importance(b.path) for b in blocks]
    size = sum(len(b.text) for b in blocks if b.main)
    sure = sum(len(b.text) for b, i in zip(blocks, rated, strict=True) if b.main and i < LOW_INSIDE)
    outside = sum(len(b.text) for b, i in zip(blocks, rated, strict=True) if not b.main and i >= LOW_OUTSIDE)
    teasers = outside > size and not any(b.main == 2 for b in blocks)
    least = 0 if 2 * sure >= size and not teasers else LOW_INSIDE
    left = [b for b, i in zip(blocks, rated, strict=True) if i >= (least if b.main else LOW_OUTSIDE)]
    return " ".join(b.text for b in left if b.main or teasers or not size)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, kind, value, page): kind 0 the page has the node, 1 presentation, 2 text; a page is named by its longest text."""
    for batch in batches:
        urls = batch.column("url").to_pylist()
        for low, high, pages in text_slices(batch, "html"):
            rows: set[tuple[int, int, int, int]] = set()
            for url, page in zip(urls[low:high], pages, strict=True):
                host = host_of(url)
                blocks, styles = parse(page)
                own = _hash(max((b.text for b in blocks), key=len, default=""))
                for b in blocks:
                    node = node_id(host, b.path)
                    rows.add((node, 2, _hash(b.text), own))
                    rows.add((node, 0, 0, own))
                for path, children in styles.items():
                    node = node_id(host, path)
                    rows.add((node, 1, _hash("|".join(c for i, c in enumerate(children) if not i or children[i - 1] != c)), own))
                    rows.add((node, 0, 0, own))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["node", "kind", "value", "page"])


def node_importance(pages: DataFrame) -> DataFrame:
    """(node, pages, presentation, content, importance) of every node of every host's style tree."""
    rows = pages.select("url", "html").mapInArrow(_statistics, "node long, kind int, value long, page long").distinct()
    values = rows.groupBy("node", "kind", "value").agg(F.count("*").cast("double").alias("n"))
    node = values.groupBy("node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.avg(F.when(F.col("kind") == 2, F.log("n"))).alias("text_h"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("styled"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("styled_log"),
    )
    scale = F.log(F.greatest("pages", F.lit(2.0)))
    one = F.col("pages") <= 1
    content = F.when(F.col("text_h").isNull(), None).when(one, 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("text_h") / scale))
    shown = F.when(F.col("styled").isNull(), None).when(one, 1.0).otherwise(F.least(F.lit(1.0), (F.log("styled") - F.col("styled_log") / F.col("styled")) / scale))
    rated = F.col("content") + (1 - F.col("content")) * PRESENTATION_WEIGHT * F.coalesce("presentation", F.lit(0.0))  # null without text of its own
    told = 1 - (1 - rated) * (F.col("pages") - 1) / (F.col("pages") + DOUBT)
    return node.select("node", "pages", shown.alias("presentation"), content.alias("content")).withColumn("importance", told)


def _extract(batches: Iterator[pa.RecordBatch], low: dict[int, float] | None, declared: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls = batch.column("url").to_pylist()
        for first, end, pages in text_slices(batch, "html"):
            part, out = batch.slice(first, end - first), []
            given = part.column("low").to_pylist() if low is None else [None] * len(pages)
            for url, page, own in zip(urls[first:end], pages, given, strict=True):
                host, cut = host_of(url), low if low is not None else dict(own or ())
                out.append(main_text(page, lambda path, host=host, cut=cut: cut.get(node_id(host, path), 1.0), declared))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ks, urls = batch.column("k").to_pylist(), batch.column("url").to_pylist()
        for low, high, pages in text_slices(batch, "html"):
            keys, nodes = [], []
            for k, url, page in zip(ks[low:high], urls[low:high], pages, strict=True):
                own = {node_id(host_of(url), b.path) for b in parse(page)[0]}
                keys += [k] * len(own)
                nodes += own
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], names=["k", "node"])


def extract_text(pages: DataFrame, broadcast_nodes: int = BROADCAST_NODES, declared: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html; other columns are ignored).

    A null html is empty and gives an empty text; a null or odd url belongs to the host without a name; repeated rows
    are extracted each; an empty table gives no rows. Without ``declared`` the style tree alone decides.
    """
    out = "page_id long, url string, text string, n_chars long"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    low = materialize(node_importance(rows).where(F.col("importance") < LOW_OUTSIDE).select("node", "importance"), "low-nodes")
    if low.count() <= broadcast_nodes:
        shared = pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in low.collect()})
        return rows.mapInArrow(lambda b: _extract(b, shared.value, declared), out)
    keyed = rows.withColumn("k", F.xxhash64("url", "html"))
    cut = keyed.select("k", "url", "html").mapInArrow(_page_nodes, "k long, node long").distinct().join(low, "node").groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("node", "importance"))).alias("low"))
    return keyed.join(cut, "k", "left").select("page_id", "url", "html", "low").mapInArrow(lambda b: _extract(b, None, declared), out)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
