"""Operator 8: main text of web pages by consensus host paths.

A page is read into blocks of text, each under a chain of containers whose names are generalised (tag and sorted
classes, digits as #). Every container outside boilerplate gets the text of the blocks under it: in full for a block's
own container, half for the next one out. The page's best paths are votes; Spark sums the votes of each host, and every
page is read again with its host's winning paths: the blocks under containers of the first that the page has, or else
of the page's own best one. If a container that wins as well holds it and a further winning path, the text lies in
several of its parts, and the outer one is read. A path inside an article or main element means that element.

Boilerplate: nav, header, footer, aside, form and similar elements; hidden ones (attributes hidden, aria-hidden="true",
style display:none); those whose role says so; those with a class, or a container's id, made of words for such parts
(comments, cookie-notice, ad-box; not content-with-sidebar). Headings and sections bear slugs as ids, so that a
section's id counts for comments only within the main text. A header within the main text keeps its headings. Lists of
nothing but links (three or more) at the beginning or end of a container that is no article or main are menus; all
other lists stay.

Defined results: null or empty html, and pages without main text, give the empty string and 0 characters. A null or odd
url has the empty host. Repeated rows are kept. Equal votes rank by path. Host tables of at most ``small`` rows are
broadcast; larger ones are joined by host and salt, so that a host with a third of the pages is spread over tasks.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import bounded_batches, materialize, slices, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SPACE = re.compile(r"\s+")
HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")
#: Elements that begin and end blocks and stand in a path.
BLOCKS = frozenset("html head body article main section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog menu center".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select button canvas audio video".split())
SPLITS = frozenset(["hr"])
GAPS = frozenset(["br", "wbr"])
BOILER = frozenset("head nav header footer aside form fieldset dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
#: Text containers that lend their text to the one around them, not to themselves.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption blockquote pre figcaption ul ol dl".split())
#: Elements whose id may name a part of the page.
NAMED_BY_ID = frozenset("div section aside ul ol dl table figure details center".split())
#: What a start tag of the first kind closes.
CLOSES = {"p": ("p",), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th")}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
HEADER_WORDS = frozenset("header masthead byline meta".split())
#: Words that name boilerplate in classes and ids, and words that only say where or in what form.
BOILER_WORDS = (
    COMMENTS
    | HEADER_WORDS
    | frozenset(
        """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr notice notices
        alert alerts popup modal overlay newsletter subscribe signup login discussion sidebar side rail widget widgets related recommend recommended recommendations share
        sharing social follow nav navigation navbar menu breadcrumb breadcrumbs pagination pager tags toc footer foot topbar toolbar skip search copyright legal disclaimer""".split()
    )
)
PLACE_WORDS = frozenset(
    """box container wrapper wrap block area section list bar panel inner outer unit slot top bottom left right site page global post article entry form link links
    item items text primary secondary main col column module region row group holder thread top header reader user users js""".split()
)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@lru_cache(100_000)
def part_named(value: str) -> frozenset[str]:
    """The boilerplate words of a class list or id, of tokens made of these and words of place only."""
    found: set[str] = set()
    for token in value.split():
        words = {w.lower() for w in PARTS.findall(token)}
        bad = words & BOILER_WORDS
        if bad and words <= BOILER_WORDS | PLACE_WORDS:
            found |= bad
    return frozenset(found)


@dataclass
class Page:
    """Containers, parents first. bad: 1 for headers within the main text, 2 for other boilerplate; path: numbers of
    generalised paths, which ``step`` has by (path outside, label)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    bad: list[int] = field(default_factory=lambda: [0])
    main: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    step: dict[tuple[int, str], int] = field(default_factory=dict)
    #: (text, container, characters in links, is a heading)
    blocks: list[tuple[str, int, int, bool]] = field(default_factory=list)

    def names(self) -> dict[int, tuple[int, str]]:
        return {n: key for key, n in self.step.items()}

    def find(self, path: str) -> int:
        """The number of a path written out, -1 if the page has none such."""
        at = 0
        for label in path.split("/"):
            at = self.step.get((at, label), -1)
            if at < 0:
                return -1
        return at


def attributes_of(source: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of equals; "" for those without a value."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def badness(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    """What an element's tag and attributes make of it: 0, 1 (a header within the main text) or 2."""
    if tag in BOILER and tag != "header":
        return 2
    if attributes.get("hidden", "until-found").lower() != "until-found" or attributes.get("aria-hidden", "").strip().lower() == "true" or NO_DISPLAY.search(attributes.get("style", "")):
        return 2
    words: frozenset[str] = frozenset(["header"]) if tag == "header" else frozenset()
    if tag not in ("body", "html", *MAIN):
        if attributes.get("role", "").strip().lower() in ROLES:
            return 2
        if tag not in HEADINGS:
            words |= part_named(attributes.get("class", ""))
        if tag in NAMED_BY_ID:
            own = part_named(attributes.get("id", ""))
            words |= own & COMMENTS if in_main and tag == "section" else own
    return 0 if not words else 1 if in_main and words <= HEADER_WORDS else 2


def read_page(source: str) -> Page:
    page = Page()
    parent, tags, bad, main, paths, step, blocks = page.parent, page.tag, page.bad, page.main, page.path, page.step, page.blocks
    node, parts, linked, in_link, at = 0, [], 0, False, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append((text, node, linked, tags[node] in HEADINGS))
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    size = len(source)
    open_tags: dict[str, list[int]] = defaultdict(list)
    while at < size:
        m = TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):  # an end tag
            if name == "a":
                in_link = False
            elif name in BLOCKS and open_tags[name]:
                end_block()
                up = open_tags[name][-1]
                while node != up:
                    open_tags[tags[node]].pop()
                    node = parent[node]
                open_tags[name].pop()
                node = parent[up]
            continue
        if name == "a":
            in_link = True
        elif name in GAPS:
            parts.append(" ")
        elif name in SPLITS:
            end_block()
        elif name in RAW:
            if not m.group(3).endswith("/"):
                close = re.compile(f"</{name}\\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else size
            parts.append(" ")
        elif name in BLOCKS:
            end_block()
            in_link = False
            closing = CLOSES.get(name, ("p",))
            while tags[node] in closing:
                open_tags[tags[node]].pop()
                node = parent[node]
            attributes = attributes_of(m.group(3)) if m.group(3) else {}
            label = name
            if attributes.get("class"):
                label += "." + ".".join(sorted(re.sub(r"\d+", "#", attributes["class"]).replace("/", "|").split()))
            parent.append(node)
            tags.append(name)
            bad.append(max(bad[node], badness(name, attributes, main[node] > 0)))
            paths.append(step.setdefault((paths[node], label), len(step) + 1))
            main.append(len(tags) - 1 if name in MAIN and not bad[-1] else main[node])
            node = len(tags) - 1
            open_tags[name].append(node)
    end_block()
    return page


def best_paths(page: Page, most: int = 3) -> list[tuple[str, float]]:
    """The page's votes: its best paths and their shares. Containers of one path count together."""
    by: dict[int, float] = defaultdict(float)
    for text, node, linked, heading in page.blocks:
        if page.bad[node] or heading:
            continue
        worth = max(0, len(text) - 2 * linked)
        up, share = node, 1.0
        while up > 0 and page.tag[up] in LEAVES:
            up = page.parent[up]
        while up >= 0 and share > 0.1:
            by[page.path[page.main[up] or up]] += worth * share
            up, share = page.parent[up], share / 2
    highest = sorted(set(by.values()), reverse=True)[:most]
    names = page.names()

    def spelled(path: int) -> str:
        labels = []
        while path:
            path, label = names[path]
            labels.append(label)
        return "/".join(reversed(labels))

    top = sorted(((s, spelled(p)) for p, s in by.items() if s > 0 and s >= highest[-1]), key=lambda x: (-x[0], x[1]))[:most]
    total = sum(s for s, _ in top)
    return [(p, s / total) for s, p in top]


def main_text(page: Page, paths: list[str]) -> str:
    """Blocks under the first of the paths that the page has, or under one of them around it and another."""
    held: dict[int, list[int]] = defaultdict(list)
    for node, path in enumerate(page.path):
        if not page.bad[node]:
            held[path].append(node)
    present = [(p, page.find(p) if p else 0) for p in paths]
    present = [(p, n) for p, n in present if n >= 0 and n in held]
    if not present:
        return ""
    under = lambda x, y: not y or x.startswith(y + "/")
    path, number = present[0]
    outer = [(q, n) for q, n in present[1:] if path != q and under(path, q) and any(under(x, q) and x != path and not under(x, path) and x != q for x, _ in present)]
    if outer and page.tag[held[number][0]] not in MAIN:
        number = max(outer, key=lambda x: len(x[0]))[1]  # the nearest one
    chosen = set(held[number])
    inside = [0 in chosen]
    for node in range(1, len(page.tag)):
        inside.append(node in chosen or inside[page.parent[node]])
    found = [(text, node, linked) for text, node, linked, heading in page.blocks if inside[node] and (not page.bad[node] or (heading and page.bad[node] == 1))]
    if page.tag[held[number][0]] in MAIN:
        return "\n\n".join(text for text, _, _ in found)
    # menus: lists of links only, before and after all other text
    lists: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    owner = []
    for text, node, linked in found:
        while node > 0 and page.tag[node] not in ("ul", "ol") and page.tag[node] in LEAVES:
            node = page.parent[node]
        owner.append(node if page.tag[node] in ("ul", "ol") else -1)
        if owner[-1] >= 0:
            for i, x in enumerate((len(text), linked, 1)):
                lists[owner[-1]][i] += x
    menus = {k for k, (n, linked, items) in lists.items() if items >= 3 and linked >= 0.95 * n}
    kept = [i for i, k in enumerate(owner) if k not in menus]
    return "\n\n".join(text for text, _, _ in found[kept[0] : kept[-1] + 1]) if kept else ""


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m.group(1).lower() if m else ""


def extract_pages(pages: DataFrame, small: int = 50_000, salts: int = 32, most: int = 3) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    slim = pages.selectExpr("cast(page_id as long) page_id", "url", "html")

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, str], int] = defaultdict(int)
        for batch in slices(batches, "html"):
            for name, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, share in best_paths(read_page(source or ""), most):
                    votes[name, path] += round(share * 1_000_000)
            if len(votes) > 100_000:
                yield out(votes)
                votes.clear()
        yield out(votes)

    def out(votes: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])

    summed = bounded_batches(slim.select(host.alias("host"), "html")).mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # each task keeps a host's best before the shuffle, so that a host with endless paths fills no task
    order = Window.partitionBy("host").orderBy(F.col("votes").desc(), "path")
    best = summed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    winners = materialize(best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths")))

    keyed = slim.withColumn("host", host)
    if winners.count() <= small:
        joined = keyed.join(F.broadcast(winners), "host", "left")
    else:
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                page = read_page(source or "")
                text = main_text(page, paths or [])
                texts.append(text or main_text(page, [p for p, _ in best_paths(page, most)]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "paths").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op8_pages_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
