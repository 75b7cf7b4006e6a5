"""HTML extraction with removal of site templates.

A page is read tag by tag. Subtrees are hashed by tag and text, inside the article only those of containers (``PROSE`` stays there). Spark counts in how many
different pages of its host each subtree occurs, and those in at least ``MANY`` are the host's template. Pages whose texts are equal before templates go are
copies of each other and count once, so what recurs only in copies stays. Near copies of a page differ in some block, so their shared paragraphs recur as a template's do: running prose
(paragraphs and headings, and other blocks of ``RUNNING`` words or more outside of lists and tables) goes only if it is at most half of the page's, while menus and lists go whatever their
share. Where templates would take all prose of a page, lists counted, and little else, it stays too.

Templates of proven number are broadcast as 64-bit ids and pages are read again where they lie; more meet the pages by shuffles, in which subtrees and
pages with ``HOT`` rows or more are broadcast or salted, so a frequent host, menu or copy is spread over tasks.

The text is that of the article (the longest ``article``, else ``main``, else the body), without elements that are never
content, containers with a whole class, id or role that names a menu, notice, advert and the like, and template subtrees. A container that is so
named stays if it holds the page's title or nearly all of the text. A dropped element inside a sentence doesn't split it.
White space inside a block becomes one space; blocks are joined by one newline.

Defined results: a null or empty page has an empty text; a null URL, or one without a host, belongs to the host ""; unclosed elements end with their parent; repeated rows
are extracted alike and count as one page of their host; an empty table gives an empty result; columns named text or n_chars are replaced.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.plans import checkpoints

#: Different pages of a host that a template subtree is in, and rows of a subtree or page that don't meet in one task.
MANY, HOT = 5, 1000
#: Templates that are broadcast (eight bytes each), and the part of a text that counts as nearly all of it.
BROADCAST_TEMPLATES, NEARLY_ALL = 1_000_000, 0.9
#: Words that make a block running prose whatever its element.
RUNNING = 12

# What HTML elements are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("nav footer aside form head button select option datalist input dialog menu object canvas audio video label script style textarea title noscript template iframe svg math noframes".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus replies reply respond related recommended recommendations widget toolbar pagination pager skip complementary contentinfo search".split())
PLACES = frozenset("site main global top bottom left right primary secondary".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption legend summary".split())
PARAGRAPHS = tuple("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CELLS = tuple("li dt dd td th option".split())
CONTAINERS = BLOCK - frozenset("h1 h2 h3 h4 h5 h6 hr html body article main".split())
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]++|<", re.S)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def _names_boilerplate(name: str) -> bool:
    """Whether a whole name is one of ``NAMES``, or is put together of those and places only (cookie-banner, site-header)."""
    parts = set(name.replace("_", "-").split("-"))
    return name in NAMES or (not parts.isdisjoint(NAMES) and parts <= NAMES | PLACES)


def _names(attributes: str) -> list[str]:
    return [name for m in _NAMED.finditer(attributes) for name in m[1].strip("\"'").lower().split()]


def _never_content(tag: str, attributes: str, inside: bool) -> bool:
    """Elements that are out by their tag, and articles that are comments."""
    if tag == "article":
        return any(name in ("comment", "comments") or name.startswith("comment-") for name in _names(attributes))
    return tag in DROP or (tag == "header" and not inside)


class Page:
    """One reading of a page: blocks of text, and the elements that span them.

    ``blocks`` has (text, dropped, prose, running prose); ``roots`` has (tag, first block, end block) of articles and mains by number, in the order of their starts; ``named`` has (first
    block, end block, whether a title is in it, number of the root around it) of containers with a name of boilerplate; ``subtrees`` has (hash, first block, end block) of block elements
    outside of roots, and of containers inside.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, bool, bool]] = []
        self.roots: dict[int, tuple[str, int, int]] = {}
        self.named: list[tuple[int, int, bool, int]] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self._text: list[str] = []
        self._aside: list[list[str]] = []  # sentences around open inline elements that are dropped
        self._open: list[list] = []  # tag, first block, drops, root, named, titles before
        self._within = [0]  # numbers of the open roots; 0 is the page
        self._count: dict[str, int] = {}
        self._drops = self._inside = self._prose = self._titles = self._numbered = 0
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m[2] is None:
                if m[0][:2] not in ("<!", "<?"):
                    self._text.append(m[0])
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW and not m[3].endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, m.end())
                at = found.end() if found else len(html)
            else:
                self._start(tag, m[3])
        while self._open:
            self._close()
        self._flush()

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._text)).split())
        self._text = []
        if text:
            within = lambda tags: any(map(self._count.get, tags))
            running = not within(CELLS) and (within(PARAGRAPHS) or text.count(" ") + 1 >= RUNNING)
            self.blocks.append((text, self._drops > 0, self._prose > 0, running))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._flush()
            if "p" in self._count and self._count["p"]:
                self._end_to("p", BLOCK - {"p", "li"})
            for other in IMPLIED_END.get(tag, ()):
                if self._count.get(other):
                    self._end_to(other, frozenset(("ul", "ol", "dl", "table", "select")))
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            return
        drops = _never_content(tag, attributes, self._inside > 0)
        if drops and tag not in BLOCK:
            self._aside.append(self._text)
            self._text = []
        named = bool(attributes) and not drops and tag in CONTAINERS and any(map(_names_boilerplate, _names(attributes)))
        root = tag in ("article", "main") and not drops and not self._drops
        self._open.append([tag, len(self.blocks), drops, root, named, self._titles])
        self._count[tag] = self._count.get(tag, 0) + 1
        self._drops += drops
        self._inside += root
        if root:
            self._within.append(self._numbered + 1)
            self._numbered += 1
        self._prose += tag in PROSE
        self._titles += tag == "h1" and not self._drops

    def _end_to(self, tag: str, fences: frozenset) -> None:
        """Ends the nearest open element of that tag, unless a fence stands before it."""
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                while len(self._open) > k:
                    self._close()
                return
            if self._open[k][0] in fences:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if self._count.get(tag):
            while self._open[-1][0] != tag:
                self._close()
            self._close()

    def _close(self) -> None:
        tag, first, drops, root, named, titles = self._open.pop()
        if tag in BLOCK or drops:
            self._flush()
        self._count[tag] -= 1
        self._drops -= drops
        self._inside -= root
        self._prose -= tag in PROSE
        if drops and tag not in BLOCK:
            self._text = [*self._aside.pop(), " "]
        if named:
            self.named.append((first, len(self.blocks), self._titles > titles, self._within[-1]))
        if root:
            self.roots[self._within.pop()] = (tag, first, len(self.blocks))
        elif tag in BLOCK and not (self._inside and tag in PROSE) and tag not in ("html", "body") and first < len(self.blocks):
            words = "\n".join([tag, *(block[0] for block in self.blocks[first:])])
            self.subtrees.append((xxhash.xxh64_intdigest(words.encode("utf-8", "replace")), first, len(self.blocks)))

    def ids(self, host: str) -> list[int]:
        """Of the subtrees on a host, as signed longs, in their order."""
        salt = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
        return [xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=salt) - (1 << 63) for h, _, _ in self.subtrees]

    def text(self, template: frozenset[int] | set[int] = frozenset(), host: str = "") -> str:
        keep = [not block[1] for block in self.blocks]
        size = lambda a, b: sum(len(self.blocks[k][0]) for k in range(a, b) if keep[k])
        if template:
            self._without(keep, [(a, b) for h, (_, a, b) in zip(self.ids(host), self.subtrees, strict=True) if h in template])
        scopes = {0: ("", 0, len(keep)), **self.roots}
        whole = {k: size(a, b) for k, (_, a, b) in scopes.items()}
        named = [(a, b, k) for a, b, title, k in self.named if not title and size(a, b) < NEARLY_ALL * whole[k]]
        roots = [r for k, r in self.roots.items() if not any(a <= r[1] and r[2] <= b and k > own for a, b, own in named)]
        for a, b, _ in named:
            keep[a:b] = [False] * (b - a)
        for tag in ("article", "main"):
            found = [r for r in roots if r[0] == tag]
            if found:
                _, a, b = max(found, key=lambda r: (size(r[1], r[2]), -r[1]))
                return "\n".join(self.blocks[k][0] for k in range(a, b) if keep[k])
        return "\n".join(block[0] for block, k in zip(self.blocks, keep, strict=True) if k)

    def _without(self, keep: list[bool], spans: list[tuple[int, int]]) -> None:
        """Drops template subtrees, but not more than half of a page's running prose, and not all its prose if that is more than half of what would be dropped."""
        gone = {k for a, b in spans for k in range(a, b) if keep[k]}
        length = lambda ks: sum(len(self.blocks[k][0]) for k in ks)
        running = {k for k, block in enumerate(self.blocks) if keep[k] and block[3]}
        if 2 * length(gone & running) > length(running):
            gone -= running
        prose = {k for k in gone if self.blocks[k][2]}
        if 2 * length(prose) > length(gone) and not any(keep[k] and self.blocks[k][2] for k in range(len(keep)) if k not in gone):
            gone -= prose
        for k in gone:
            keep[k] = False


def own_host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def page_subtrees(keyed: DataFrame) -> DataFrame:
    """Rows (key, content, subtrees) of pages (key, host, html): a hash of the text before templates go, and the distinct ids of the subtrees."""

    def read(batches):
        for b in batches:
            contents, ids = [], []
            for html, of in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True):
                page = Page(html or "")
                contents.append(xxhash.xxh64_intdigest(page.text().encode("utf-8", "replace")) - (1 << 63))
                ids.append(list(set(page.ids(of))))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(contents, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["key", "content", "subtrees"])

    return keyed.mapInArrow(read, "key long, content long, subtrees array<long>")


def tally_of(seen: DataFrame) -> DataFrame:
    """Rows (subtree, pages, n): the different pages and the rows that have a subtree."""
    each = seen.select("content", F.explode("subtrees").alias("subtree")).groupBy("subtree", "content").agg(F.count("*").alias("n"))
    return each.groupBy("subtree").agg(F.count("*").alias("pages"), F.sum("n").alias("n"))


def templates_of_pages(seen: DataFrame, tally: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """(key, template) of the pages that have template subtrees; and (key, copies) of the pages with ``HOT`` rows or more."""
    subtrees = seen.select("key", F.explode("subtrees").alias("subtree"))
    hot = tally.where(F.col("n") >= HOT).select("subtree", (F.col("pages") >= many).alias("often"))
    met = subtrees.join(hot, "subtree", "left")
    cold = met.where(F.col("often").isNull()).join(tally.where((F.col("n") < HOT) & (F.col("pages") >= many)).select("subtree"), "subtree", "left_semi")
    found = met.where("often").select("key", "subtree").unionByName(cold.select("key", "subtree"))
    copies = seen.groupBy("key").agg(F.count("*").alias("copies")).where(F.col("copies") >= HOT)
    return found.groupBy("key").agg(F.collect_set("subtree").alias("template")), copies


def extract(pages: DataFrame, many: int = MANY) -> DataFrame:
    """The rows of pages (url, html, ...) with text and n_chars in place of html."""
    pages = pages.select(*(c for c in pages.columns if c not in ("text", "n_chars", "__key", "__host", "__row", "__salt", "__salts")))
    key = F.xxhash64(own_host(), "html")
    seen = checkpoints.cut(page_subtrees(pages.select(key.alias("key"), own_host().alias("host"), "html")))
    tally = checkpoints.cut(tally_of(seen).where((F.col("pages") >= many) | (F.col("n") >= HOT)))
    often = tally.where(F.col("pages") >= many).select("subtree")
    rest = [c for c in pages.columns if c != "html"]
    schema = pages.select(*rest).schema.add("text", "string").add("n_chars", "long")

    def out(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    if often.count() <= BROADCAST_TEMPLATES:
        known = pages.sparkSession.sparkContext.broadcast(np.array([r.subtree for r in often.collect()], dtype=np.int64).tobytes())

        def run(batches):
            template = set(np.frombuffer(known.value, dtype=np.int64).tolist())
            for b in batches:
                yield out(b, [Page(html or "").text(template, of) for html, of in zip(b.column("html").to_pylist(), b.column("__host").to_pylist(), strict=True)])

        return pages.select(*rest, "html", own_host().alias("__host")).mapInArrow(run, schema)

    known, copies = templates_of_pages(seen, tally, many)
    salts = checkpoints.cut(copies.select(F.col("key").alias("__key"), (F.floor(F.col("copies") / HOT) + 1).alias("__salts")))
    known = known.withColumnRenamed("key", "__key").join(salts, "__key", "left")
    known = known.select("__key", "template", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)).alias("__salt"))
    salted = pages.withColumns({"__key": key, "__host": own_host(), "__row": F.monotonically_increasing_id()}).join(salts, "__key", "left")
    salted = salted.withColumn("__salt", F.pmod("__row", F.coalesce("__salts", F.lit(1)))).drop("__row", "__salts")
    joined = salted.join(known, ["__key", "__salt"], "left")

    def run_joined(batches):
        for b in batches:
            yield out(b, [Page(html or "").text(set(template or ()), of) for html, template, of in zip(*(b.column(c).to_pylist() for c in ("html", "template", "__host")), strict=True)])

    return joined.select(*rest, "html", "template", "__host").mapInArrow(run_joined, schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
