"""Main text of web pages by a site style tree.

Each page is parsed into its tree of elements. The trees of a host's pages are merged: an element node of the site tree
is an element below one parent node (paragraphs, items, headings and rows of one parent are one node; other elements are
told apart by tag, class and their number among their like). Its style nodes are the sequences of children seen at it,
its content nodes the texts that stand at it. Importance, of a node on n different pages of a host:

- presentation: entropy, to base n, of the node's styles over its pages;
- content: a text on c of the n pages has importance 1 - log_n(c); a node's own text the mean over its occurrences;
- composite: (1 - DECAY^l) * presentation + DECAY^l * (mean of the children's composite importance and of its own
  text's, weighted by the pages they stand on), with l children on average.

A node of low composite importance goes with its branch, a content node of low importance alone. Elements that by their
kind present no article (navigation, headers, footers, asides, forms, and the like by class or id) are a prior: their
importance is 0 on any number of pages. Where a page marks its article or main element, that element has importance 1
with the plain paragraphs and lists below it, and only what is under it competes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Nodes and contents on fewer different pages of a host are kept; below this importance they are removed.
MIN_PAGES, MIN_IMPORTANCE = 3, 0.25
#: Weight of one more child in the composite importance.
DECAY = 0.9
#: Elements nested deeper are read as part of the element at this depth, as browsers bound their trees.
MAX_DEPTH = 400
#: Removed nodes and contents of all hosts together, and of one host, up to which their lists are broadcast.
MAX_BROADCAST, MAX_HOST = 1_000_000, 5_000

#: Elements without content, with raw content, that stand in a line, and that a new one closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object select canvas video audio".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that repeat below one parent and are one node there, and the plain ones that an article is made of.
REPEATED = set("p li dt dd tr td th h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption option".split())
PLAIN = REPEATED | set("ul ol dl table thead tbody tfoot caption".split())
#: Elements, roles, and words of class or id names that hold no article; the other words that such names are made of.
OUTSIDE = set("nav header footer aside form head button menu dialog".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
OUTSIDE_WORDS = set(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations comments comment commentlist respond disqus replies reply pagination pager copyright disclaimer toolbar topbar bottombar header".split()
)
OTHER_WORDS = set("site page main top bottom left right primary secondary global list bar box wrapper wrap container area block section posts post articles buttons button links link slot item items form form-inline thread count the of by my js is has no fixed sticky small large inner outer row col content 1 2 3 4".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
#: What the tree may do at a node: nothing, drop single contents, or also drop the branch.
KEEP, CONTENTS, BRANCH = 0, 1, 2


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by exact lower-case name, the first of each; values are consumed, so nothing in them is read as a name."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), "".join(values))
    return out


def _outside_name(name: str) -> bool:
    """Is a class or id name made of words for what is no article, and of nothing else?"""
    words = [w.lower() for w in _WORDS.findall(name)]
    return not OUTSIDE_WORDS.isdisjoint(words) and all(w in OUTSIDE_WORDS or w in OTHER_WORDS for w in words)


def _outside(tag: str, attributes: dict[str, str]) -> bool:
    if tag in OUTSIDE:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in OUTSIDE_ROLES:
        return True
    names = (attributes.get("class", "") + " " + attributes.get("id", "")).split()
    return any(map(_outside_name, names))


class _Element:
    __slots__ = ("tag", "node", "outside", "inside", "plain", "kids", "like")

    def __init__(self, tag: str, node: int, outside: bool, inside: bool, plain: bool):
        self.tag, self.node, self.outside, self.inside, self.plain = tag, node, outside, inside, plain
        self.kids: list[str] = []
        self.like: Counter = Counter()


def _number(text: str) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """nodes: [id, parent's place, judge, sequences of children]; blocks: (node's place, text, outside, inside), in order.

    Tag soup is read as browsers do, roughly: unclosed paragraphs and list items end where the next begins, stray end tags
    are ignored. Linear in the page.
    """

    def __init__(self, html: str, prior: bool = True):
        self.prior = prior
        self.nodes: list[list] = [[_number(""), -1, CONTENTS, set()]]
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.place = {self.nodes[0][0]: 0}
        self.stack = [_Element("", 0, False, False, False)]
        self.open: Counter = Counter()
        self.deeper: Counter = Counter()  # open elements beyond MAX_DEPTH
        self.text: list[str] = []
        self._parse(html)
        self._flush()
        self._pop(1)
        self._leave(self.stack[0])

    def _flush(self) -> None:
        if self.text:
            joined = _SPACE.sub(" ", entities.unescape("".join(self.text))).strip()
            self.text.clear()
            if joined:
                top = self.stack[-1]
                self.blocks.append((top.node, joined, top.outside, top.inside))
                for e in reversed(self.stack):
                    if e.tag not in INLINE:
                        if not e.kids or e.kids[-1] != "#":
                            e.kids.append("#")
                        break

    def _leave(self, e: _Element) -> None:
        if e.tag not in INLINE:
            self.nodes[e.node][3].add(_number("\n".join(e.kids)))

    def _pop(self, k: int) -> None:
        for e in self.stack[k:]:
            self.open[e.tag] -= 1
            self._leave(e)
        del self.stack[k:]

    def _close(self, tags: set[str], until: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                self._flush()
                self._pop(k)
                return
            if self.stack[k].tag in until:
                return

    def _end(self, tag: str) -> None:
        if self.deeper[tag]:
            self.deeper[tag] -= 1
            self._flush() if tag not in INLINE else None
            return
        if not self.open[tag]:
            if tag not in INLINE:
                self._flush()
            return
        k = next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == tag)
        plain = all(e.tag in INLINE for e in self.stack[k:])
        if not plain or self.stack[k].outside != self.stack[k - 1].outside:
            self._flush()
        if tag not in INLINE or plain:
            self._pop(k)

    def _begin(self, tag: str, raw: str) -> None:
        if tag in ENDS_P:
            self._close({"p"}, {"div", "td", "li", "section", "article", "blockquote", "body", "main"})
        if tag in CLOSES:
            self._close(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        if tag == "br":
            self.text.append(" ")
        elif tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if len(self.stack) > MAX_DEPTH:
            self.deeper[tag] += 1
            return
        found = attributes_of(raw) if raw.strip() else {}
        mine, top = self.prior and _outside(tag, found), self.stack[-1]
        if mine and not top.outside:
            self._flush()
        self.open[tag] += 1
        if tag in INLINE:
            self.stack.append(_Element(tag, top.node, top.outside or mine, top.inside and not mine, top.plain))
            return
        holder = next(e for e in reversed(self.stack) if e.tag not in INLINE)
        article = tag in ("article", "main") or found.get("role", "").lower() == "main"
        sign = " ".join([tag + "!" * article, *sorted(found.get("class", "").lower().split())])
        if not holder.kids or holder.kids[-1] != sign:
            holder.kids.append(sign)
        if tag not in REPEATED:
            holder.like[sign] += 1
            sign += f" {holder.like[sign]}"
        inside = self.prior and (top.inside or article) and not mine
        plain = inside and (article or top.plain and tag in PLAIN)
        node = _number(f"{self.nodes[holder.node][0]} {sign}")
        if node not in self.place:
            self.place[node] = len(self.nodes)
            judge = KEEP if plain else CONTENTS if tag in ("html", "body") else BRANCH
            self.nodes.append([node, holder.node, judge, set()])
        self.stack.append(_Element(tag, self.place[node], top.outside or mine, inside, plain))

    def _parse(self, html: str) -> None:
        at, last = 0, html.rfind(">")
        while True:
            m = _TOKEN.search(html, at, last + 1) if at <= last else None
            self.text.append(html[at : m.start() if m else len(html)])
            if not m:
                return
            at = m.end()
            if m.group(1):
                self._end(m.group(1).lower())
            elif m.group(2):
                tag = m.group(2).lower()
                if tag not in RAW:
                    self._begin(tag, m.group(3))
                elif not m.group(3).rstrip().endswith("/") or tag not in ("svg", "math"):
                    end = _ENDS[tag].search(html, at)
                    at = end.end() if end else len(html)

    def competing(self) -> tuple[list[tuple[int, str]], int]:
        """(node's place, text) of the blocks that the prior leaves, and how many it removes."""
        left = [b for b in self.blocks if not b[2]]
        if any(b[3] for b in left):
            left = [b for b in left if b[3]]
        return [b[:2] for b in left], len(self.blocks) - len(left)

    def chain(self, place: int) -> list[int]:
        """The ids of a node and those above it, from the root."""
        out = []
        while place >= 0:
            out.append(self.nodes[place][0])
            place = self.nodes[place][1]
        return out[::-1]


NODE = "struct<node:long,parent:long,judge:int,style:long,texts:int>"
PARSED = f"page_id long, url string, mark long, prior int, blocks array<struct<node:long,key:long,text:string>>, nodes array<{NODE}>, chains array<array<long>>"


def page_trees(pages: DataFrame, with_prior: bool = True) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, host, mark (hash of the html), prior (blocks that the prior removed), blocks
    that compete, the page's nodes above them, and the chains of nodes that a task sees for the first time."""
    number, whole = pa.int64(), pa.int32()
    block = pa.list_(pa.struct([("node", number), ("key", number), ("text", pa.string())]))
    node = pa.list_(pa.struct([("node", number), ("parent", number), ("judge", whole), ("style", number), ("texts", whole)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in (b.slice(lo, 200) for b in batches for lo in range(0, b.num_rows, 200)):
            rows = []
            for text in batch.column(2).to_pylist():
                page = Page(text or "", with_prior)
                found, prior = page.competing()
                used, own = set(), {p for p, _ in found}
                for p in own:
                    while p >= 0 and p not in used:
                        used.add(p)
                        p = page.nodes[p][1]
                kept = [(page.nodes[p], p in own, p) for p in sorted(used)]
                chains = [page.chain(p) for n, _, p in kept if n[0] not in known]
                known.update(n[0] for n, _, _ in kept)
                if len(known) > 100_000:
                    known.clear()
                nodes = [{"node": n[0], "parent": page.nodes[n[1]][0] if n[1] >= 0 else None, "judge": n[2], "style": _number(str(sorted(n[3]))), "texts": int(t)} for n, t, _ in kept]
                blocks = [{"node": page.nodes[p][0], "key": _number(f"{page.nodes[p][0]} {t}"), "text": t} for p, t in found]
                rows.append((_number(text or ""), prior, blocks, nodes, chains))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (number, whole, block, node, pa.list_(pa.list_(number))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "mark", "prior", "blocks", "nodes", "chains"])

    found = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, PARSED)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return found.withColumn("host", host).withColumn("row", F.monotonically_increasing_id())


def site_tree(trees: DataFrame, decay: float = DECAY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merged trees of all hosts: nodes (host, node, judge, pages, presentation, content, importance), contents
    (host, node, key, c) on at least two pages, and chains (host, node, up, place), one row per node and node above it or
    itself. Equal pages of a host count once. Everything is counted before it travels, so no host is a group of its own."""
    once = trees.select("host", "mark", "nodes", F.array_distinct(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["key"].alias("key")))).alias("keys")).dropDuplicates(["host", "mark"])
    styles = once.select("host", F.explode("nodes").alias("n")).select("host", "n.*").groupBy("host", "node", "parent", "judge", "style").agg(F.count("*").alias("s"), F.sum("texts").alias("t"))
    nodes = styles.groupBy("host", "node", "parent").agg(F.max("judge").alias("judge"), F.sum("s").alias("pages"), F.sum("t").alias("with_text"), F.sum(F.col("s") * F.log2("s")).alias("bits"))
    flat = F.log2("pages") - F.col("bits") / F.col("pages")
    nodes = nodes.withColumn("presentation", F.when(F.col("pages") > 1, flat / F.log2("pages")).otherwise(1.0))
    counts = once.select("host", F.explode("keys").alias("k")).groupBy("host", "k.node", "k.key").agg(F.count("*").alias("c"))
    own = counts.groupBy("host", "node").agg(F.sum("c").alias("shown"), F.sum(F.col("c") * F.log2("c")).alias("logs"))
    nodes = nodes.join(own, ["host", "node"], "left")
    text = F.when(F.col("pages") > 1, 1 - F.col("logs") / F.col("shown") / F.log2("pages")).otherwise(1.0)
    nodes = materialize(nodes.select("host", "node", "parent", "judge", "pages", "with_text", "presentation", F.coalesce(text, F.lit(0.0)).alias("content")))
    kids = nodes.where("parent IS NOT NULL").groupBy("host", F.col("parent").alias("node")).agg(F.sum("pages").alias("kids"))
    full = nodes.join(kids, ["host", "node"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)) + F.col("with_text"))
    weight = F.pow(F.lit(decay), F.col("kids") / F.col("pages"))
    full = full.withColumn("alone", (1 - weight) * F.col("presentation") + weight * F.col("with_text") / F.col("kids") * F.col("content"))
    above = full.select("host", F.col("node").alias("parent"), (weight / F.col("kids")).alias("per_page"))
    share = F.coalesce(F.ln(F.col("pages") * F.col("per_page")), F.lit(0.0))
    full = materialize(full.join(above, ["host", "parent"], "left").select("host", "node", "judge", "pages", "presentation", "content", "alone", share.alias("share")))
    chain = trees.select(F.explode("chains").alias("chain")).groupBy(F.element_at("chain", -1).alias("node")).agg(F.first("chain").alias("chain"))
    chains = full.select("host", "node", "alone").join(chain, "node").select("host", "node", "alone", F.posexplode("chain").alias("place", "up"))
    chains = chains.join(full.select("host", F.col("node").alias("up"), "share"), ["host", "up"])
    # what a node adds to one above it: its own part times the shares on the way down
    below = F.sum("share").over(Window.partitionBy("host", "node").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1))
    chains = materialize(chains.select("host", "node", "up", "place", (F.col("alone") * F.exp(F.coalesce(below, F.lit(0.0)))).alias("part")))
    importance = chains.groupBy("host", F.col("up").alias("node")).agg(F.sum("part").alias("importance"))
    return full.join(importance, ["host", "node"]).select("host", "node", "judge", "pages", "presentation", "content", "importance"), counts.where("c > 1"), chains.select("host", "node", "up", "place")


def removed_keys(trees: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, key): nodes in branches of low importance, and single contents of low importance."""
    nodes, contents, chains = site_tree(trees)
    nodes = materialize(nodes)
    low = nodes.where((F.col("judge") == BRANCH) & (F.col("pages") >= min_pages) & (F.col("importance") < min_importance))
    branches = chains.join(low.select("host", F.col("node").alias("up")), ["host", "up"], "left_semi").select("host", F.col("node").alias("key"))
    judged = nodes.where(F.col("judge") >= CONTENTS).select("host", "node", "pages")
    met = contents.where(F.col("c") >= min_pages).join(judged, ["host", "node"])
    single = met.where(1 - F.log2("c") / F.log2("pages") < min_importance).select("host", "key")
    return branches.unionByName(single).distinct()


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE, max_broadcast: int = MAX_BROADCAST, with_prior: bool = True) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars, and the numbers of blocks that the prior and the tree
    removed; rows one to one.

    Null and empty html give an empty text; a null url is a host of its own (the empty one); repeated pages count once
    in their host's tree and are answered each; an empty table gives no rows. Text at any depth is kept. Without the prior
    (lists of names and marked articles) the tree alone decides, which tells how much of the work it does.
    """
    trees = materialize(page_trees(pages, with_prior))
    removed = materialize(removed_keys(trees, min_pages, min_importance))
    total, most = removed.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if total <= max_broadcast and most <= MAX_HOST:
        # lists of a checked size go to the pages
        lists = removed.groupBy("host").agg(F.collect_set("key").alias("removed"))
        joined = trees.join(F.broadcast(lists), "host", "left")
        gone = lambda b: F.array_contains("removed", b["node"]) | F.array_contains("removed", b["key"])
        kept = F.when(F.col("removed").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~gone(b)))
    else:
        # beyond it, keys without texts meet the list, and each page gets the places it loses
        at = trees.select("row", "host", F.posexplode("blocks").alias("place", "b"))
        keys = at.select("row", "host", "place", F.explode(F.array("b.node", "b.key")).alias("key"))
        lost = keys.join(removed.hint("merge"), ["host", "key"], "left_semi").groupBy("row").agg(F.collect_set("place").alias("lost"))
        joined = trees.join(lost, "row", "left")
        kept = F.when(F.col("lost").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b, i: ~F.array_contains("lost", i)))
    done = joined.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"), F.col("prior").alias("removed_by_prior"), (F.size("blocks") - F.size(kept)).alias("removed_by_tree"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "removed_by_prior", "removed_by_tree")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
