"""Main text of HTML pages by site style trees.

The pages of a host are merged into one tree: elements at the same place, with the same tag and
the same class names, are one node. Its presentation importance is the entropy of the child
sequences that it shows over its pages, in units of the logarithm of their number; its content
importance is one minus the mean normalised entropy of its texts over the pages (a text that
all pages share tells nothing, one of its own tells all). Both make the composite importance, the
more the content counts the fewer presentations the node has. A branch of low importance that
enough pages have is removed from each of them.

What the markup itself says is a prior: an element that is declared as navigation, footer, advert and
the like is removed on one page as on a thousand; what lies in an article or main element goes where
its importance is next to nothing (see DECLARED). Entropy decides on all else. A removal that rests on
few pages, or on little against a declaration, must leave a page most of its text: so articles that a
host repeats stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, written

#: Weight of the markup's word (0 noise, 1 content, 1/2 none) against the style tree's, and the importance to stay.
PRIOR_WEIGHT, STAY = 0.6, 0.5
#: Decay of presentation's share, as in the composite importance of site style trees; pages that make a node count.
GAMMA, PAGES = 0.9, 5
#: Importance below which declared content goes; pages from which a node is judged with care: such removals take at most this share of a text.
DECLARED, FEW, CARE = 0.1, 2, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
NOISE_TAGS = frozenset(
    "head nav footer aside form menu dialog button select script style noscript template iframe svg canvas object audio video math map datalist textarea".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs footer sidebar rail widget comment comments disqus respond replies "
    "social share sharing related recommended newsletter subscribe subscription signup login pagination pager toolbar masthead skip hidden".split()
)
#: After these, a word of a class name or id says what the element has or hasn't, not what it is.
MODIFIERS = frozenset("no not non has have with without".split())
#: An element that is noise by a class name or id only isn't where it holds more than this share of a page's text; the second
#: holds where other text is declared as content.
MOST, MOST_BESIDE_CONTENT = 0.5, 0.9
#: A site's own header is noise, an article's is part of it; so with these words.
HEADER_WORDS = frozenset("header head topbar".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
#: Elements that end an open one of the same kind, and where the search for it stops.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",))}
CLOSES |= {"td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")

NOISE, CONTENT, NONE = 0, 1, 2
#: A header's class names: noise outside an article only. NAMED: noise by class names or id.
HEADER, NAMED = 3, 4
#: What a page tells of a node: that it has it, its child sequence, a text of its own.
HAS, STYLE, TEXT = 0, 1, 2


def _hash(s: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(s, seed & 0xFFFFFFFFFFFFFFFF)


def _told(tag: str, attributes: str) -> tuple[int, str]:
    """(what the markup says of an element, the class names that are part of its place)."""
    if not attributes or not TELLING.search(attributes):
        return (NOISE if tag in NOISE_TAGS else CONTENT if tag in ("article", "main") else NONE), ""
    got = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    classes = " ".join(sorted(re.sub(r"\d+", "", got.get("class", "")).split()))
    tokens = set()
    for name in f"{got.get('class', '')} {got.get('id', '')}".split():
        for word in map(str.lower, WORDS.findall(name)):
            if word in MODIFIERS:
                break
            tokens.add(word)
    role = got.get("role", "").lower()
    if tag in ("html", "body"):
        return NONE, ""
    if (
        tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in got
        or got.get("aria-hidden", "").lower() == "true" or HIDDEN.search(got.get("style", ""))
    ):
        return NOISE, classes
    if tag in ("article", "main") or role in ("main", "article") or got.get("itemprop", "").lower() == "articlebody":
        return CONTENT, classes
    if tokens & NOISE_WORDS:
        return NAMED, classes
    if tokens & HEADER_WORDS:
        return HEADER, classes
    return NONE, classes


class Page:
    """A parsed page. runs: (number of its block, node, prior, text) of each stretch of text, in page order, white space made
    single. nodes: for each element its node and its child sequence."""

    def __init__(self, html: str | None, spared: frozenset[int] = frozenset()):
        """spared: numbers of the NAMED elements whose names are ignored."""
        self.runs: list[tuple[int, int, int, str]] = []
        self.nodes: list[tuple[int, int]] = []
        self._buffer: list[str] = []
        self._block = 0
        # of each open element: tag, node, what holds there, hash of its child sequence, last child
        self._open: list[list] = [["", 0, NONE, 0, None]]
        self._spared, self._within = spared, []  # of each NAMED element the number of the one around it
        self._parse(html or "")
        self._break()
        while len(self._open) > 1:
            self._pop()
        if not spared and (most := self._largest()):
            self.__init__(html, most)

    def _largest(self) -> frozenset[int]:
        """Numbers of the NAMED elements that hold most of the page's text."""
        sizes, inside = Counter(), Counter()
        for _, _, prior, text in self.runs:
            if prior != NOISE and text != " ":
                sizes[min(prior, NAMED)] += len(text)
                if prior >= NAMED:
                    inside[prior - NAMED] += len(text)
        for k in range(len(self._within) - 1, -1, -1):
            if self._within[k] >= 0:
                inside[self._within[k]] += inside[k]
        least = (MOST_BESIDE_CONTENT if sizes[CONTENT] else MOST) * sum(sizes.values())
        return frozenset(k for k, n in inside.items() if n > least)

    def _flush(self) -> None:
        if self._buffer:
            text = SPACE.sub(" ", "".join(self._buffer))
            self._buffer = []
            if text:
                top = self._open[-1]
                self.runs.append((self._block, top[1], top[2], text))

    def _break(self) -> None:
        self._flush()
        self._block += 1

    def _pop(self) -> None:
        closed = self._open.pop()
        if closed[1] != self._open[-1][1]:
            self.nodes.append((closed[1], closed[3]))

    def _end(self, tag: str, limit: tuple[str, ...] = ()) -> bool:
        """Closes the innermost open element of that tag, and what is open inside, unless one of limit is nearer."""
        for k in range(len(self._open) - 1, 0, -1):
            name = self._open[k][0]
            if name == tag:
                if any(x[1] != self._open[k - 1][1] for x in self._open[k:]):
                    self._flush()
                if tag not in INLINE:
                    self._break()
                while len(self._open) > k:
                    self._pop()
                return True
            if name in limit or (tag in INLINE and name not in INLINE):
                return False
        return False

    def _start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag == "br":
            self._buffer.append(" ")
            return
        block = tag not in INLINE
        if block:
            if tag in CLOSES_P:
                self._end("p", ("table", "button", "object"))
            if tag in CLOSES:
                for other in CLOSES[tag][0]:
                    self._end(other, CLOSES[tag][1])
            if tag not in ("img", "input", "wbr", "embed", "object", "button", "select", "svg", "audio", "video", "canvas", "map", "script"):
                self._break()
        above = self._open[-1]
        told, classes = _told(tag, attributes)
        holds = above[2]
        if told == NOISE:
            holds = NOISE
        elif told == CONTENT and holds == NONE:
            holds = CONTENT
        elif told == NAMED:
            self._within.append(holds - NAMED if holds >= NAMED else -1)
            if holds != NOISE and len(self._within) - 1 not in self._spared:
                holds = NAMED + len(self._within) - 1
        elif (told == HEADER or tag == "header") and holds == NONE:
            holds = NOISE
        node = _hash(f"{tag}.{classes}", above[1]) if block or classes or told != NONE else above[1]
        if node != above[1] and node != above[4]:  # a child repeated is one
            above[3], above[4] = _hash(tag, above[3]) ^ (node & 0xFFFFFFFF), node
        if tag in VOID or closed:
            return
        if node != above[1]:
            self._flush()
        self._open.append([tag, node, holds, 0, None])

    def _parse(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                begin = size
            m = None
            while begin < size and not (m := TAG.match(html, begin)):
                begin = html.find("<", begin + 1)
                if begin < 0:
                    begin = size
            if begin > at:
                text = html[at:begin]
                self._buffer.append(unescape(text) if "&" in text else text)
            if m is None:
                return
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if not self._end(tag) and tag == "p":
                    self._break()
                continue
            self._start(tag, m[3], m[3].endswith("/") and tag not in RAW and tag in VOID)
            if tag in RAW:  # no markup inside
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else size

    def kept(self) -> list[tuple[int, int, int, str]]:
        """Runs that aren't noise by markup; where the page declares its content, only those in it."""
        wanted = CONTENT if any(r[2] == CONTENT and r[3] != " " for r in self.runs) else NONE
        return [r for r in self.runs if r[2] == wanted]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 1):
        counts: Counter = Counter()
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page, host = Page(html), host_of(url)
            texts: dict[int, list[str]] = {}
            for _, node, _, text in page.runs:
                if text != " ":
                    texts.setdefault(node, []).append(text)
            seen = {(node, HAS, 0) for node, _ in page.nodes} | {(node, STYLE, style) for node, style in page.nodes}
            seen |= {(node, HAS, 0) for node in texts} | {(node, TEXT, _hash(t)) for node, ts in texts.items() for t in ts}
            counts.update((host, *x) for x in seen)
        rows = list(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([_long(r[1]) for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array([_long(r[3]) for r in rows], pa.int64()),
                pa.array([counts[r] for r in rows], pa.int64()),
            ],
            ["host", "node", "kind", "feature", "n"],
        )


def style_tree(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> host, node, pages, presentation, content, importance: the merged trees' nodes.

    A page counts once for each of its features. Nodes of one page have importance 1. Pages without a host form one tree.
    """
    features = pages.select("url", "html").mapInArrow(_features, "host string, node long, kind int, feature long, n long")
    counted = features.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    n = F.col("n")
    nodes = counted.groupBy("host", "node").agg(
        of(HAS, n).alias("pages"), of(STYLE, n).alias("styled"), of(STYLE, n * F.log(n)).alias("style_log"), of(STYLE, F.lit(1)).alias("styles"),
        of(TEXT, F.lit(1)).alias("texts"), of(TEXT, F.log(n)).alias("text_log"),
    )
    m = F.log(F.col("pages"))
    presentation = F.coalesce((F.log("styled") - F.col("style_log") / F.col("styled")) / m, F.lit(0.0))
    content = F.coalesce(1 - F.col("text_log") / F.col("texts") / m, F.lit(0.0))
    share = F.pow(F.lit(GAMMA), F.coalesce("styles", F.lit(1)))
    one = F.col("pages") <= 1
    return nodes.select(
        "host", "node", "pages",
        F.when(one, 1.0).otherwise(presentation).alias("presentation"),
        F.when(one, 1.0).otherwise(content).alias("content"),
        F.when(one, 1.0).otherwise((1 - share) * presentation + share * content).alias("importance"),
    )


_RUNS = "array<struct<block:int,node:long,content:boolean,text:string>>"


def _runs(column: int, url: int, names: list[str]):
    kind = pa.list_(pa.struct([("block", pa.int32()), ("node", pa.int64()), ("content", pa.bool_()), ("text", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, column):
            hosts = pa.array([host_of(u) for u in batch.column(url).to_pylist()], pa.string())
            runs = [
                [{"block": f, "node": _long(n), "content": p == CONTENT, "text": t} for f, n, p, t in Page(html).kept()]
                for html in batch.column(column).to_pylist()
            ]
            others = [c for i, c in enumerate(batch.columns) if i != column]
            yield pa.RecordBatch.from_arrays([*others, hosts, pa.array(runs, kind)], [*names, "sst_host", "sst_runs"])

    return parse


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text: the main text of each page, an empty string if it has none.

    Blocks in page order are joined by one space; white space within a block is one space. A null html is empty; a null
    url has no host. Every row is returned, repeated ones too, and gets the same text.
    """
    pages = pages.select("page_id", "url", "html")
    low = (F.col("importance") < (STAY - PRIOR_WEIGHT / 2) / (1 - PRIOR_WEIGHT)) & (F.col("pages") >= FEW)
    of = lambda which: F.collect_list(F.when(which, F.col("node")))
    removed = style_tree(pages).where(low).groupBy("host").agg(
        of(F.col("pages") >= PAGES).alias("sst_removed"), of(F.col("pages") < PAGES).alias("sst_few"), of(F.col("importance") < DECLARED).alias("sst_least")
    )
    removed = written(removed, "removed").withColumnRenamed("host", "sst_host")  # its size is known: Spark chooses the join
    parsed = pages.mapInArrow(_runs(2, 1, ["page_id", "url"]), f"page_id long, url string, sst_host string, sst_runs {_RUNS}")
    joined = parsed.join(removed, "sst_host", "left")
    sure = F.expr("filter(sst_runs, r -> r.content OR sst_removed IS NULL OR NOT array_contains(sst_removed, r.node))")
    careful = F.expr("filter(sure, r -> sst_removed IS NULL OR NOT array_contains(IF(r.content, sst_least, sst_few), r.node))")
    length = "aggregate({}, 0L, (n, r) -> n + char_length(trim(r.text)))"
    stay = F.expr(f"IF(size(careful) = size(sure) OR {length.format('careful')} < {1 - CARE} * {length.format('sure')}, sure, careful)")
    glued = F.expr("array_join(transform(stay, (r, i) -> concat(IF(i > 0 AND r.block <> stay[i - 1].block, ' ', ''), r.text)), '')")
    text = F.trim(F.regexp_replace(glued, " +", " "))
    return joined.withColumn("sure", sure).withColumn("careful", careful).withColumn("stay", stay).select("page_id", "url", text.alias("text"))


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op1_extract": op1_extract}
ORACLE: dict[str, str] = {}
