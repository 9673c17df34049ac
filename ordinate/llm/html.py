"""Main-text extraction with consensus paths per host.

Pages of one host share a template, so they can vote on where the article
stands.  The first pass reads each page, scores its containers by the text of
the paragraphs in them (less what stands in links), and gives each container a
generalised path: tag names with their classes, digits taken out.  Spark sums
the scores for each (host, path); the best path of a host wins, and hands over to
the containers around it while one holds clearly more text (a tenth more), as an
article split into several boxes needs; article and main elements stay.  The second
pass extracts every page again from the containers on its host's winning path;
a page that lacks the path uses its own best container.

Scale: votes are summed per task before they move.  The winners are one short
row for each host; they are handed to the executors whole if their checked
size allows (``broadcast_bytes``), else joined by host, each in ``splits`` parts.
Pages are read twice and never gathered.  A page takes time in proportion to its
length, whatever its markup.

Blocks are what block-level tags delimit; character references are decoded,
white space inside a block (a line break ``<br>`` included) becomes one space.

Edge cases: null or empty html gives the empty text; text without any tag is
one block; a null or unparsable URL counts as one nameless host; unclosed and
stray tags are tolerated; pages that tie between paths take the one that sorts
first; repeated rows vote each and are extracted each; extra columns pass
through, those named like an output column are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, checkpointed, map_arrow, renamed, without

#: What a "<" may begin: a comment, a declaration, or a tag.
_TOKEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: Elements whose content is no text of the page, up to their end tag.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe svg object textarea title annotation".split()}
_QUOTE_OR_END = re.compile("[>\"']")
#: Elements nested deeper than this stand where the last one within it does.
DEPTH = 200
_CLASS = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Tags whose content is never article text.
_DROPPED = frozenset("nav aside form button select footer menu dialog head input label fieldset".split())
#: Tags that end a block where they open and close.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LISTS = frozenset("ul ol dl menu dir".split())
_CONTAINERS = frozenset("article main section div td body center".split())
#: Those that compete for the article; a cell is part of its table.
_SCORED = _CONTAINERS - {"td"}
#: How much more text a container has to hold to take over from one inside it.
CLEARLY = 1.1
#: Opening one of these closes an open paragraph.
_ENDS_P = _BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary"}
#: Opening the first closes the second, if it is the innermost of its kind.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in a class, id or role that mark what is not the article.
_JUNK = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs crumb pager pagination topbar toolbar sidebar side aside rail footer foot colophon contentinfo complementary search searchbox "
    "comment comments commentlist reply replies respond discussion disqus feedback share sharing social follow newsletter subscribe subscription signup login related recommended recommendations widget masthead skip hidden".split()
)

#: Those of them that an id says of a part of the page; the others may as well be what a section is about.
_PART_IDS = frozenset("ad ads adsense comment comments commentlist respond disqus sidebar navbar menubar breadcrumb breadcrumbs crumb pager pagination topbar toolbar footer colophon masthead".split())
#: Elements that no class, id or role condemns.
_SPARED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Names of two words mark the same if they say where such a part stands, or what kind of box it is.
_PLACES, _PLACED = frozenset("site main primary global top bottom".split()), frozenset("nav navbar navigation menu menubar footer breadcrumb breadcrumbs topbar toolbar banner".split())
_BOXED = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comment comments cookie footer nav newsletter promo related search share sidebar skip social sponsored subscribe widget".split())
_BOXES = frozenset("area articles bar block box button buttons container form icons items link links list posts section slot thread unit wrap wrapper".split())

#: So do parts of a page with a word for their place or for whose they are, as in "left-sidebar" or "reader-comments".
_WHOSE = frozenset("site page main primary secondary global top bottom left right user users reader readers visitor post article blog mobile desktop sticky fixed".split())
_PARTS = frozenset("nav navbar navigation menu menubar sidebar footer breadcrumb breadcrumbs topbar toolbar comments ad ads advert advertisement notice notices".split())
#: Beginnings and ends of longer words that mark the same.
_JUNK_START = ("advert", "adsby", "adslot", "cookie", "breadcrumb", "sidebar", "newsletter", "sponsor", "popup", "paginat")
_JUNK_END = ("nav", "menu", "banner", "sidebar", "footer", "comments", "cookies")


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _is_junk(name: str) -> bool:
    """Whether a whole name marks what is not the article: "sidebar" and "cookie-notice" do, "has-sidebar" does not."""
    words = _words(name)
    if len(words) == 2 and (words[0] in _PLACES and words[1] in _PLACED or words[0] in _BOXED and words[1] in _BOXES or words[0] in _WHOSE and words[1] in _PARTS):
        return True
    return bool(words) and all(w in _JUNK or w.startswith(_JUNK_START) or w.endswith(_JUNK_END) for w in words)


def _condemned(tag: str, names: list[str], ids: list[str], inside: bool) -> bool:
    if tag in _SPARED or tag == "form":
        return False
    if inside or tag == "section" or "section" in names:
        return any(map(_is_junk, names)) or any(i.lower() in _PART_IDS for i in ids)
    return any(map(_is_junk, names)) or any(map(_is_junk, ids))


class Node:
    """An element: its tag, its path of block tags, what holds for the text in it, and the element around it."""

    __slots__ = ("tag", "path", "junk", "main", "form", "outer", "listed", "scored", "worth", "share", "within")

    def __init__(self, tag: str, path: str, junk: bool, main: bool, form: int, outer: Node | None):
        self.tag, self.path, self.junk, self.main, self.form, self.outer = tag, path, junk, main, form, outer
        self.listed = tag in _LISTS or outer is not None and outer.listed
        self.scored = tag in _SCORED or outer is None
        self.worth = self.share = 0.0
        self.within = False


def tokens(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """The text before each tag, its name (None: no tag), whether it is an end tag, and its attributes; in linear time.

    A quote that is never closed is an ordinary character; if a tag has no end
    because of its quotes, it and all later ones end at the next ">".
    """
    at, lax, open_quotes = 0, False, {'"': True, "'": True}

    def end_of_tag(start: int) -> int:
        nonlocal lax
        pos = start
        while not lax:
            m = _QUOTE_OR_END.search(page, pos)
            if m is None:
                lax = True
            elif m[0] == ">":
                return m.start()
            else:
                close = page.find(m[0], m.end()) if open_quotes[m[0]] else -1
                open_quotes[m[0]] = close >= 0
                pos = close + 1 if close >= 0 else m.end()
        return page.find(">", start)

    begin = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if m[1]:
            stop = page.find("-->", m.end())
            yield page[begin : m.start()], None, False, ""
            begin = at = len(page) if stop < 0 else stop + 3
            continue
        stop = page.find(">", m.end()) if m[2] else end_of_tag(m.end())
        if stop < 0:
            break  # no tag ends any more
        tag = (m[4] or "").lower()
        yield page[begin : m.start()], tag or None, bool(m[3]), page[m.end() : stop]
        begin = at = stop + 1
        if tag in _RAW and not m[3]:
            last = _RAW[tag].search(page, at)
            begin = at = len(page) if last is None else last.end()
    yield page[begin:], None, False, ""


def _names(raw: str) -> tuple[list[str], list[str], str, bool]:
    """Whole names of class and role; those of id; the generalised label; whether the element is hidden."""
    names, ids, label, hidden = [], [], "", False
    for m in _CLASS.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("hidden", "aria-hidden"):
            hidden |= key == "hidden" or value.lower() == "true"
        elif key == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        else:
            (ids if key == "id" else names).extend(value.split())
            if key == "class":
                label = "." + ".".join(sorted(set(_words(value))))
    return names, ids, label, hidden


def blocks_of(page: str) -> tuple[list[tuple[str, Node, float]], list[Node]]:
    """The page's blocks of text, each with the element around it and its share of link text; and all elements, outer ones first."""
    out: list[tuple[str, Node, float]] = []
    root = Node("", "", False, False, 0, None)
    stack, nodes = [root], [root]
    paths: dict[tuple[str, str], str] = {}
    deeper: Counter = Counter()
    parts: list[str] = []
    state = {"link": 0, "all": 0, "open": 0, "forms": 0}

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = stack[-1]
                while node.tag not in _BLOCK and node.outer is not None:
                    node = node.outer  # an inline element may be open that was never in the block
                out.append((text, node, min(1.0, state["link"] / max(1, state["all"]))))
        state["link"] = state["all"] = 0

    def say(text: str) -> None:
        # What stands in a junk element never comes back, be it a block or inline; only forms are judged later.
        if text and not stack[-1].junk:
            parts.append(text)
            n = len(text.strip())
            state["all"] += n
            state["link"] += n * (state["open"] > 0)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            state["open"] -= stack.pop().tag == "a"

    for before, tag, ends, raw in tokens(page):
        say(before)
        if tag is None or tag in _RAW:
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in _BLOCK:
            flush()
        if ends:
            if deeper[tag]:
                deeper[tag] -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
                if tag not in _BLOCK and stack[depth].tag in _BLOCK:
                    break  # a stray inline end tag
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P or tag in _CLOSES:
            closes = _CLOSES.get(tag, ()) + (("p",) if tag in _ENDS_P else ())
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closes:
                    pop_to(depth)
                    break
                if stack[depth].tag in _CONTAINERS or stack[depth].tag in ("ul", "ol", "dl", "table") and "p" not in closes:
                    break
        if tag in _BLOCK and stack[-1].tag == "head":
            pop_to(len(stack) - 1)  # its end tag may be left out
        top = stack[-1]
        names, ids, label, hidden = _names(raw) if len(raw) > 3 else ([], [], "", False)
        inside = top.main
        heads = tag == "header" or tag not in _SPARED and any(n.lower() in ("header", "banner") for n in names + ids)
        junk = top.junk or hidden and tag not in ("html", "body") or tag in _DROPPED and tag != "form" or _condemned(tag, names, ids, inside) or heads and not inside
        main = inside or not junk and (tag in ("article", "main") or tag in _CONTAINERS and any("main" in _words(n) for n in names + ids) or any(n.lower() == "articlebody" for n in names + ids))
        state["forms"] += tag == "form"
        form = top.form or state["forms"] * (tag == "form")
        if raw.rstrip().endswith("/") and tag not in _BLOCK:
            continue
        if len(stack) > DEPTH:
            deeper[tag] += 1
            continue
        path = paths.setdefault((top.path, tag + label), f"{top.path}/{tag}{label}") if tag in _BLOCK else top.path
        node = Node(tag, path, junk, main, form, top)
        stack.append(node)
        nodes.append(node)
        state["open"] += tag == "a"
    flush()
    # A form goes, unless it holds most of the page's text.
    held = Counter()
    for text, node, _ in out:
        if not node.junk:
            held[node.form] += len(text)
    whole = sum(held.values())
    for node in nodes:
        if node.form and 2 * held[node.form] <= whole:
            node.junk = True
    return out, nodes


def scored(page: str) -> tuple[list[tuple[str, Node, float]], list[Node], dict[str, float], dict[str, float]]:
    """The page's blocks and elements, the scores of its container paths, and the text that each path holds."""
    blocks, nodes = blocks_of(page)
    scores: Counter = Counter()
    holds: Counter = Counter()
    for text, node, linked in blocks:
        if not node.junk and linked <= 0.5:
            node.worth += len(text) * (1 - linked)
            node.share = node.worth
    for node in reversed(nodes):
        if node.worth and node.scored:
            # An article or main element speaks for all of its text; other containers pass on half.
            scores[node.path] += 3.0 * node.worth if node.tag in ("article", "main") else node.share
            holds[node.path] += node.worth
            node.share *= 0.5
        if node.outer is not None:
            node.outer.worth += node.worth
            node.outer.share += node.share
    return blocks, nodes, scores, holds


def climbed(path: str, holds: dict[str, float]) -> str:
    """From a path outwards, to a container around it as long as one holds clearly more text."""
    if path.rpartition("/")[2].partition(".")[0] in ("article", "main"):
        return path
    for outer in sorted((p for p in holds if path.startswith(p + "/")), key=len, reverse=True):
        if holds[outer] >= CLEARLY * holds[path]:
            path = outer
    return path


def best_path(scores: dict[str, float], holds: dict[str, float]) -> str | None:
    return climbed(min(scores, key=lambda p: (-scores[p], p)), holds) if scores else None


def extract(page: str | None, winner: str | None) -> tuple[str, str | None]:
    """The text of the page under the winning path (or its own best), and the path used."""
    if not page:
        return "", None
    blocks, nodes, scores, holds = scored(page)
    path = winner if winner is not None and winner in scores else best_path(scores, holds)
    if path is None:
        return "", None
    for node in nodes:
        node.within = node.scored and node.path == path or node.outer is not None and node.outer.within
    kept, title = [], []
    whole = path.rpartition("/")[2].partition(".")[0] in ("body", "html", "")
    # Outside an article element, a list of bare links is a menu if it comes before any text, or in the page as a whole if no heading leads to it.
    follows = False
    for text, node, linked in blocks:
        if node.junk:
            continue
        if node.within:
            menu = linked >= 0.9 and node.listed
            if node.main or not menu or follows:
                kept.append(text)
            if not menu:
                follows = not whole or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif not kept and node.tag in ("h1", "h2") and linked < 0.9:
            # A heading that stands right above the container, in the element around it, is its title.
            holder = node
            while not holder.scored:
                holder = holder.outer
            if path.rpartition("/")[0] == holder.path and holder.path.rpartition("/")[2] not in ("body", "html", ""):
                title.append(text)
    return "\n".join(title + kept), path


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.").removeprefix("m.")
    except ValueError:
        return ""


def host_votes(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes, holds, pages): of every container path of a host the summed scores and shares of the text."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[float]] = {}  # score, share of the text, pages

        def flush() -> pa.RecordBatch:
            keys = list(held)
            arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *[pa.array([held[k][i] for k in keys], pa.float64()) for i in (0, 1)], pa.array([int(held[k][2]) for k in keys], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["host", "path", "votes", "holds", "pages"])

        for batch in batches:
            for u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    host, (_, _, scores, holds) = host_of(u), scored(page)
                    whole, text = sum(scores.values()), holds.get("", 0.0)
                    for path, score in scores.items():
                        entry = held.setdefault((host, path), [0.0, 0.0, 0])
                        entry[0] += score / whole if whole else 0.0
                        entry[1] += holds[path] / text if text else 0.0
                        entry[2] += 1
            if len(held) > 50_000:
                yield flush()
        if held:
            yield flush()

    slim = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    raw = map_arrow(slim, vote, "host string, path string, votes double, holds double, pages bigint")
    return raw.groupBy("host", "path").agg(F.round(F.sum("votes"), 9).alias("votes"), F.round(F.sum("holds"), 9).alias("holds"), F.sum("pages").alias("pages"))


def winners(votes: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes, ties to the first in order, or the container around it that holds clearly more."""
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "path", "holds")).alias("w")).select("host", "w.path", "w.holds")
    outer = votes.select("host", F.col("path").alias("outer"), F.col("holds").alias("more"))
    # As many rows for each host as its winner has containers around it.
    around = best.join(outer, "host").where(F.col("path").startswith(F.concat("outer", F.lit("/"))))
    steps = around.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.length("outer")).alias("less"), F.col("outer").alias("path"), F.col("more").alias("holds")))).alias("steps"))
    climb = lambda at, step: F.when(step["holds"] >= CLEARLY * at["holds"], F.struct(step["path"].alias("path"), step["holds"].alias("holds"))).otherwise(at)
    top = F.aggregate(F.col("steps"), F.struct("path", "holds"), climb)["path"]
    stays = F.col("steps").isNull() | F.regexp_extract("path", r"([^/.]*)[^/]*$", 1).isin("article", "main")
    return best.join(steps, "host", "left").select("host", F.when(stays, F.col("path")).otherwise(top).alias("path"))


def extract_main_text(pages: DataFrame, *, url: str = "url", html: str = "html", broadcast_bytes: int = 8 << 20, splits: int = 64) -> DataFrame:
    """pages with text, n_chars and path (the container path used)."""
    best = checkpointed(winners(checkpointed(host_votes(pages, url=url, html=html))))
    size = best.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0)).alias("b")).first()["b"]
    fields = [("text", "string"), ("n_chars", "bigint"), ("path", "string")]
    pages = without(pages, [n for n, _ in fields])
    names = pages.columns
    pages, of = renamed(pages)
    url, html = of(url), of(html)
    if size <= broadcast_bytes:
        known = {r["host"]: r["path"] for r in best.collect()}
        out = arrow_columns(pages, fields, lambda: lambda batch: _texts(batch, html, [known.get(host_of(u)) for u in batch.column(url).to_pylist()]))
        return out.toDF(*names, *[n for n, _ in fields])

    def hosts():
        return lambda batch: [pa.array([host_of(u) for u in batch.column(url).to_pylist()], pa.string())]

    # A host may have a large part of all pages: they go to as many splits, to each of which its path goes.
    named = arrow_columns(pages, [("_host", "string")], hosts).withColumn("_split", F.pmod(F.xxhash64(F.col(f"`{html}`")), F.lit(splits)))
    paths = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(splits - 1).cast("bigint"))).alias("_split"))
    joined = named.join(paths, ["_host", "_split"], "left").drop("_host", "_split")
    out = arrow_columns(joined, fields, lambda: lambda batch: _texts(batch, html, batch.column("_path").to_pylist())).drop("_path")
    return out.toDF(*names, *[n for n, _ in fields])


def _texts(batch: pa.RecordBatch, html: str, paths: list[str | None]) -> list[pa.Array]:
    found = [extract(page, path) for page, path in zip(batch.column(html).to_pylist(), paths, strict=True)]
    return [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())]

