"""Main text of web pages with a site style tree.

The pages of a host share a tree of styles: elements by tag and class on the same path. Over all pages
of a host, an element's importance is the entropy of its presentations (sequences of child tags) and of
its content (texts), relative to their greatest value. Branches whose importance stays low on enough
pages are the site's own furniture and are left out, and so are texts that many pages have at one path. Tags
and classes that name furniture are a prior: such elements need a high importance to stay.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed, written

#: Fixed values of HTML: elements without content, with raw text, and those that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body html article section div main".split())
#: Elements that hold no text of the page.
DROP_TAGS = frozenset("head script style template noscript iframe object svg math canvas button select textarea audio video map".split())
#: Elements and words of a class, id or role that mostly hold no main text.
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus reply replies share sharing social related recommended newsletter "
    "subscribe signup login search widget pagination pager toolbar skip copyright complementary contentinfo".split()
)

#: Up to so many hashes of paths and of common texts of all hosts (8 bytes each) are broadcast to the pages; more are joined by shuffle.
BROADCAST_VERDICTS = 2_000_000
#: A tag without angle brackets inside; others are read by TAG_START and TagEnds.
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
TAG_START = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
SPLIT_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class TagEnds:
    """Where the tags of a source end: the first ``>`` outside quotes. A quote from which no end is in reach is tried once only."""

    def __init__(self, source: str):
        self.source, self.dead, self.last = source, set(), source.rfind(">")

    @cached_property
    def special(self) -> list[int]:
        return [m.start() for m in QUOTE_OR_END.finditer(self.source)]

    def after(self, at: int) -> int:
        tried, i = [], bisect_left(self.special, at)
        while i < len(self.special) and self.special[i] not in self.dead:
            place = self.special[i]
            if self.source[place] == ">":
                return place
            tried.append(place)
            other = self.source.find(self.source[place], place + 1)
            if other < 0:
                break
            i = bisect_left(self.special, other + 1)
        self.dead.update(tried)
        return -1


def next_token(source: str, at: int, ends: TagEnds) -> tuple[int, int, str | None, bool, str, str] | None:
    """(start, end, text of a CDATA section or None, closing, tag, attributes) of the next markup from ``at``; no tag is an empty one."""
    while (start := source.find("<", at)) >= 0:
        if m := PLAIN_TAG.match(source, start):
            return start, m.end(), None, bool(m[1]), m[2].lower(), m[3]
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if source.startswith(opening, start):
                stop = source.find(closing, start + len(opening))
                inside = source[start + len(opening) : stop if stop >= 0 else len(source)]
                return start, stop + 3 if stop >= 0 else len(source), inside if opening == "<![CDATA[" else None, False, "", ""
        if source.startswith(("<!", "<?"), start):
            if start < ends.last:
                return start, source.find(">", start) + 1, None, False, "", ""
        elif (m := TAG_START.match(source, start)) and (stop := ends.after(m.end())) >= 0:
            return start, stop + 1, None, bool(m[1]), m[2].lower(), source[m.end() : stop]
        at = start + 1
    return None


@lru_cache(1 << 16)
def _below(path: str, style: str) -> str:
    """The path of an element with this style below that path, of one length however deep it is."""
    return hashlib.blake2b(f"{path}/{style}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class Element:
    __slots__ = ("tag", "style", "drop", "kids", "path", "parent", "in_article", "named", "holds", "furniture_above", "block")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        self.tag, self.parent, self.kids = tag, parent, []
        self.style = tag + ("." + ".".join(sorted(named["class"].lower().split())) if named.get("class") else "")
        words = {w.lower() for v in named.values() for w in SPLIT_NAME.split(v)}
        inside = parent is not None and parent.in_article
        self.drop = (parent is not None and parent.drop) or tag in DROP_TAGS
        self.named = tag in FURNITURE_TAGS or (tag == "header" and not inside) or bool(words & DROP_WORDS and tag not in ("html", "body"))
        self.in_article = inside or tag in ("article", "main")
        self.holds = tag in ("article", "main")  # is or has an article or main element
        if self.holds:
            above = parent
            while above is not None and not above.holds:
                above.holds, above = True, above.parent
        self.path = _below(parent.path if parent else "", self.style)
        self.furniture_above = None
        self.block = self if parent is None or tag not in INLINE else parent.block  # the innermost that is not within a line

    def furniture(self) -> bool:
        """Whether a name speaks against the element or one around it; articles and what is around them are not judged by name."""
        line, e = [], self
        while e is not None and e.furniture_above is None:
            line.append(e)
            e = e.parent
        found = e is not None and e.furniture_above
        for e in reversed(line):
            found = e.furniture_above = found or (e.named and not e.holds)
        return bool(found)


def read_page(source: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """Blocks of text with the element they stand in, in page order, and all elements."""
    root = Element("#page", "", None)
    stack, elements, blocks, run = [root], [root], [], []
    at, n, ends = 0, len(source), TagEnds(source)
    open_ = Counter()  # elements of each tag in the stack

    def cut(i: int):
        for e in stack[i:]:
            open_[e.tag] -= 1
        del stack[i:]

    def innermost(tags) -> int:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in tags)

    def flush():
        if run:
            text = SPACE.sub(" ", "".join(x for _, x in run)).strip()
            if text:
                blocks.append((next((e for e, x in run if x.strip()), run[0][0]).block, text))
            run.clear()

    def add_text(text: str):
        if text:
            run.append((stack[-1], html.unescape(text)))

    while at < n:
        token = next_token(source, at, ends)
        if token is None:
            add_text(source[at:])
            break
        start, after, section, closing, tag, attributes = token
        add_text(source[at:start])
        at = after
        if not tag:
            add_text(section or "")
            continue
        if closing:
            if tag not in INLINE:
                flush()
            if open_[tag]:
                cut(innermost({tag}))
            continue
        if tag == "br":
            run.append((stack[-1], " "))
        if tag not in INLINE:
            flush()
        if tag in ENDS_P and open_["p"]:
            cut(innermost({"p"}))
        if tag in SELF_ENDING and any(open_[t] for t in SELF_ENDING[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SELF_ENDING[tag]:
                    cut(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        element = Element(tag, attributes, stack[-1])
        stack[-1].kids.append(tag)
        elements.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            inside = source[at : close.start() if close else n]
            at = close.end() if close else n
            if not element.drop and tag == "textarea":
                run.append((element, html.unescape(inside)))
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
            open_[tag] += 1
    flush()
    return blocks, elements


def _key(host: str, path: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{host}\n{path}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_BLOCKS = (
    "row_id long, page_id string, url string, page long, "
    "blocks array<struct<key:long,value:long,above:long,furniture:boolean,article:boolean,text:string>>, shapes array<struct<key:long,value:long>>"
)


def page_blocks(rows: DataFrame) -> DataFrame:
    """Each page of the rows (row_id, page_id, url, html) read once.

    ``blocks`` are its texts in page order, with hashes of the styled path, of the text and of the path above; ``shapes`` are the
    sequences of child tags of the elements above; ``page`` is a hash of host and source.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, page_id, url, source in zip(pdf["row_id"], pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                host = _host_of(url)
                key = lru_cache(None)(lambda path, host=host: _key(host, path))
                blocks, holders = [], {}
                for e, text in read_page(source or "")[0]:
                    if not e.drop:
                        above = key(e.parent.path) if e.parent is not None else None
                        blocks.append({"key": key(e.path), "value": _key("", text), "above": above, "furniture": e.furniture(), "article": e.in_article, "text": text})
                        if e.parent is not None:
                            holders[id(e.parent)] = e.parent
                shapes = [{"key": key(e.path), "value": _key("", " ".join(e.kids))} for e in holders.values()]
                out.append((row, page_id, url, _key(host, source or ""), blocks, shapes))
            yield pd.DataFrame(out, columns=["row_id", "page_id", "url", "page", "blocks", "shapes"])

    # The id crosses pandas as text, which keeps nulls and all digits.
    return rows.select("row_id", F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(read, _BLOCKS)


def style_tree(read: DataFrame, least_pages: int, least_importance: float, gamma: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(key, n, importance) of each styled path of each host, and (key, value) of the texts common at a path.

    Importance is (1 - gamma) times the relative entropy of the texts of the path and gamma times that of
    the presentations of the element above. Texts common at the path (see :func:`main_text`) do not enter it, so that they
    take no other text along; ``n`` counts the rest. Equal pages of a host count once. ``read`` is a table of
    :func:`page_blocks`. Counts are summed per task before the shuffle, so neither a host nor a path is ever gathered in one place.
    """
    once = read.groupBy("page").agg(F.min("row_id").alias("row_id")).select("row_id")
    entry = lambda kind, key, value, above: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), above.alias("above"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    inner = F.filter("blocks", lambda x: x["above"].isNotNull())
    entries = F.concat(
        F.transform(inner, lambda x: entry(0, x["key"], x["value"], x["above"])),
        F.transform("shapes", lambda x: entry(1, x["key"], x["value"], none)),
        F.transform(F.array_distinct(F.transform(inner, lambda x: x["key"])), lambda x: entry(2, x, zero, none)),
    )
    seen = read.select("row_id", F.explode(entries).alias("x")).select("row_id", "x.*").join(once, "row_id", "left_semi")
    per_page = seen.groupBy("row_id", "kind", "key", "value").agg(F.count(F.lit(1)).alias("c"), F.max("above").alias("above"))
    counted = written(per_page.groupBy("key", "kind", "value").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("pages"), F.max("above").alias("above")), "style-tree")
    c = F.col("c").cast("double")
    of = counted.where("kind = 2").select("key", F.col("pages").alias("of"))
    common = (
        counted.where("kind = 0 AND pages > 1").select("key", "value", "pages").join(of.where(F.col("of") >= least_pages), "key")
        .where(1 - F.log(F.col("pages")) / F.log(F.col("of")) < least_importance).select("key", "value")
    )
    rest = counted.where("kind = 0").join(common, ["key", "value"], "left_anti").select("key", "kind", "c", "above").unionByName(counted.where("kind = 1").select("key", "kind", "c", "above"))
    shape = rest.groupBy("key", "kind").agg(F.sum("c").alias("n"), F.sum(c * F.log(c)).alias("x"), F.max("above").alias("above"))
    n = F.col("n").cast("double")
    entropy = F.when(F.col("n") > 1, (F.log(n) - F.col("x") / n) / F.log(n)).otherwise(1.0)
    shape = shape.select("key", "kind", "n", "above", entropy.alias("entropy"))
    content = shape.where("kind = 0")
    presentation = shape.where("kind = 1").select(F.col("key").alias("above"), F.col("entropy").alias("shape"))
    paths = content.join(presentation, "above", "left").select("key", "n", ((1 - gamma) * F.col("entropy") + gamma * F.coalesce("shape", F.lit(0.0))).alias("importance"))
    return paths, common


def main_text(pages: DataFrame, least_pages: int = 10, least_importance: float = 0.5, named_importance: float = 0.75, stored: bool = False) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Blocks inside the page's article or main element, or in the whole page without one, in page order. Where the host's
    style tree has at least ``least_pages`` texts of a path, it decides: the path goes with an importance below
    ``least_importance``, or below ``named_importance`` if a name calls it furniture. With fewer texts the name alone
    decides. A text that ``pages`` of at least ``least_pages`` pages with its path have there goes where
    1 - log(pages) / log(all) is below ``least_importance``. Null and empty html give the empty text; pages without a
    host share one tree; repeated rows each get a row. Pages of any length, depth and state of their markup are read
    whole in about linear time. For a ``stored`` table just as ``spark.read`` gives it rows are numbered by file and place, else
    in a written copy.
    """
    rows = keyed(pages.select("page_id", "url", "html"), "page-rows", "row_id", stored)
    read = written(page_blocks(rows), "page-blocks")
    paths, common = style_tree(read, least_pages, least_importance)
    known = F.col("n") >= least_pages
    low = paths.where(known & (F.col("importance") < least_importance)).select("key", F.lit(0).alias("kind"))
    sure = paths.where(known & (F.col("importance") >= named_importance)).select("key", F.lit(1).alias("kind"))
    sides = [low.select("key"), sure.select("key"), common.select(F.col("key").bitwiseXOR(F.col("value")).alias("key"))]
    sides = written(reduce(DataFrame.unionByName, [x.select(F.lit(kind).alias("kind"), "key") for kind, x in enumerate(sides)]), "page-verdicts")

    def texts(blocks, low, sure, common) -> str:
        kept = [
            b for b in blocks
            if b["key"] not in low and (b["key"] in sure or not b["furniture"]) and b["key"] ^ b["value"] not in common
        ]
        if any(b["article"] for b in kept):
            kept = [b for b in kept if b["article"]]
        return "\n\n".join(b["text"] for b in kept)

    wanted = F.transform("blocks", lambda x: x.dropFields("above"))
    if sides.count() <= BROADCAST_VERDICTS:
        return _chosen(read.select("page_id", "url", wanted.alias("blocks")), texts, _sets(sides))
    keys = read.select("row_id", F.explode(F.array_distinct(F.transform("blocks", lambda x: x["key"]))).alias("key"))
    pairs = read.select("row_id", F.explode(F.array_distinct(F.transform("blocks", lambda x: x["key"].bitwiseXOR(x["value"])))).alias("key"))
    marks = keys.join(sides.where("kind < 2"), "key").unionByName(pairs.join(sides.where("kind = 2"), "key"))
    of_kind = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("key")))
    found = marks.groupBy("row_id").agg(of_kind(0).alias("low"), of_kind(1).alias("sure"), of_kind(2).alias("common"))
    joined = read.select("row_id", "page_id", "url", wanted.alias("blocks")).join(found, "row_id", "left").drop("row_id")
    return _chosen(joined, texts)


def _sets(sides: DataFrame):
    """The three sets of hashes (kind, key), sent to every executor."""
    table = sides.toArrow()  # no more than BROADCAST_VERDICTS
    kind, key = (table.column(c).to_numpy() for c in ("kind", "key"))
    return sides.sparkSession.sparkContext.broadcast([np.sort(key[kind == k]) for k in range(3)])


def _chosen(pages: DataFrame, texts, sets=None) -> DataFrame:
    """(page_id, url, text, n_chars) by texts(blocks, low, sure, common); the sets stand in the row, or in ``sets`` for all rows."""

    def held(hashes: np.ndarray, known: np.ndarray) -> set:
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        return set(hashes[known[at] == hashes].tolist()) if len(known) else set()

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if sets is None:
                marks = ([set(x) if x is not None else set() for x in row] for row in zip(pdf["low"], pdf["sure"], pdf["common"], strict=True))
            else:
                low, sure, common = sets.value
                keys = np.array([b["key"] for blocks in pdf["blocks"] for b in blocks], np.int64)
                values = np.array([b["value"] for blocks in pdf["blocks"] for b in blocks], np.int64)
                marks = repeat([held(keys, low), held(keys, sure), held(keys ^ values, common)])
            out = [texts(blocks, *x) for blocks, x in zip(pdf["blocks"], marks, strict=False)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out, "n_chars": [len(t) for t in out]})

    out = pages.mapInPandas(choose, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), stored=True)
