"""Main text of web pages by templates deduced from occurrence vectors.

A token is a block element in its place or a whole text block in its place. The place is the path of
elements around it, containers with their position among siblings of one name, so that a second
and a third div are two. Its occurrence vector says how often it occurs on each page of a host. Tokens of the same
vector form an equivalence class: what a template writes together. Classes that are frequent,
hold an element and whose elements lie inside those of one other class are valid; nested by their
paths they make the host's template. Text that stands in the same elements on a clear majority of the
host's pages, and on more than are copies of one page, is part of the template and no content; pages
without text do not count, and pages of another layout may lack it. What remains are slots. Slots that hold mostly links, or text that comes
again and again, are navigation and notices; of the others the deepest element around nearly all
of the text holds the article. On top, what markup says of itself counts: menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts and styles by element, role and class name; on a host whose slots
are all marked so, the marks say nothing and the template decides alone. Article or main elements
are the place of the article if they hold nearly all text of the slots, or, without a template, most
of the page's; slots are left out inside them as elsewhere.

Vectors are compared by two hashes over (page, count) that Spark aggregates before the shuffle;
neither a host's pages nor its tokens are gathered. Templates are one small row a host, joined to
the pages by host, which Spark broadcasts only while their measured size is small.

A NULL or empty html has an empty text. Pages without a host share none and use their own markup
alone, as do hosts of fewer than MIN_PAGES pages. Repeated pages give equal rows. An empty table
gives an empty one; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.batches import bounded
from gaugeworks.session import checkpointed

MIN_PAGES = 4  # pages a host needs for a template
CONSTANT_SHARE = 0.6  # share of a host's pages with text that hold a constant text
SLOT_SHARE = 0.1  # share of a host's pages that make a place a slot of the template
LINK_SHARE = 0.5
FRESH_SHARE = 0.25  # a slot with fewer different texts repeats itself
ARTICLE_SHARE = 0.8  # share of the text that the article's element holds
MARKED_SHARE = 0.5  # share of a page's text that article or main elements hold, where no template tells

# fixed values: elements by what HTML says of them
_BLOCKS = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr "
    "center dialog menu search hgroup".split()
)
_CONTAINERS = set(
    "article main section div ul ol dl table header footer nav aside form fieldset center dialog menu search hgroup".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe svg math object canvas audio video textarea title select".split())
_NOT_CONTENT = set("nav footer aside form fieldset button label dialog menu search head datalist".split())
_CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}
_HINTS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead banner ad ads adv advert "
    "adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login social share sharing related recommended comment comments reply "
    "replies respond disqus pagination pager toolbar widget search hidden copyright legal skip".split()
)
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_COPY = "\0"  # place of a page's whole text; no path of elements
_KEPT_WHOLE = set("html body article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attributes>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_POSITION = re.compile(r"\[\d+\]")
_PARTS = re.compile(r"[^a-z]+")


@dataclass
class Block:
    """One block of text: where it is, what it says, and how much of it is links."""

    path: str
    text: str
    links: int
    inside: bool  # of an article or main element
    out: bool  # markup says that it is no article text


@dataclass
class Page:
    """The text blocks of a page and how often each place occurs."""

    blocks: list[Block] = field(default_factory=list)
    places: Counter = field(default_factory=Counter)


def is_boilerplate(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element says of itself that it is no article text."""
    if tag in _NOT_CONTENT or (tag == "header" and not inside):
        return True
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    if tag in _KEPT_WHOLE:
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [p for p in _PARTS.split(name) if p]
        if parts and not {"with", "has", "no"} & {*parts} and (parts[0] in _HINTS or parts[-1] in _HINTS):
            return True
    return False


def parse(html: str | None) -> Page:
    """Blocks and places of a page; elements left open end with what surrounds them."""
    page = Page()
    stack: list[tuple[str, str, bool, Counter]] = []  # element, path, whether it is left out, children by name
    top: Counter = Counter()
    held: list[str] = []
    links = [0, 0]  # open links, characters in links of the held text
    source, at = html or "", 0

    def path() -> str:
        return stack[-1][1] if stack else ""

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            where = path()
            page.blocks.append(Block(where, text, min(links[1], len(text)), is_marked(where), bool(stack and stack[-1][2])))
        held.clear()
        links[1] = 0

    def close(tags: set[str], until: set[str]) -> None:
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in tags:
                flush()
                del stack[n:]
                return
            if stack[n][0] in until:
                return

    while at < len(source):
        found = _TOKEN.match(source, at)
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            if source[found.start()] != "<" or found.end() - found.start() == 1:
                held.append(found[0])
                if links[0]:
                    links[1] += len(found[0])
            continue
        if found["end"]:
            if tag == "a":
                links[0] = 0
            elif any(s[0] == tag for s in stack):
                close({tag}, set())
            elif tag in _BLOCKS:
                flush()
            continue
        if tag in _RAW:
            if not found["attributes"].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else (len(source) if tag in ("script", "style") else at)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        if tag == "a":
            links[0] = 1
        out, inside = bool(stack and stack[-1][2]), is_marked(path())
        attributes = {}
        if found["attributes"].strip(" /\n\t"):
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(found["attributes"])}
        own = is_boilerplate(tag, attributes, inside)
        if tag in _BLOCKS:
            flush()
            close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "main", "blockquote"})
            if tag in _CLOSES:
                close(_CLOSES[tag], {"table", "ul", "ol", "dl"} if tag in ("li", "dt", "dd") else {"table"})
            if len(stack) > 500:  # deeper nesting says nothing more of the place
                continue
            name = (attributes.get("class", "").split() or [""])[0]
            kind = re.sub(r"[\d/\[\]]+", "", name)[:40]
            step = f"/{tag}" + (f".{kind}" if kind else "")
            where = path() + step
            if tag in _CONTAINERS:
                siblings = stack[-1][3] if stack else top
                siblings[step] += 1
                if siblings[step] > 1:
                    where += f"[{siblings[step]}]"
            page.places[where] += 1
            stack.append((tag, where, out or own, Counter()))
        elif own:
            flush()
            where = f"{path()}/{tag}"
            stack.append((tag, where, True, Counter()))
    flush()
    return page


def host_of(url: str | None) -> str | None:
    found = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#\s]+)", url or "", re.I)
    return found[1].lower() if found else None


def text_token(path: str, text: str) -> int:
    """Hash of a text in its elements, wherever among their siblings these are."""
    return xxhash.xxh3_64_intdigest(f"{_POSITION.sub('', path)}\n{text}".encode()) - (1 << 63)


def tokens(pages: DataFrame) -> DataFrame:
    """Tokens of each page with a host and text: (host, page, path, token, n, chars, links, out, first).

    ``token`` is NULL for an element, else the hash of a text block, or at _COPY that of all blocks.
    ``first`` is 1 for one of a page's rows of a token, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(*(c.to_pylist() for c in batch.columns)):
                host = host_of(url)
                if host is None:
                    continue
                page = parse(html)
                if not page.blocks:
                    continue
                number = xxhash.xxh3_64_intdigest(f"{url}\n{html}".encode()) - (1 << 63)
                rows.append((host, number, "", None, 1, 0, 0, False, 1))
                whole = "\n".join(f"{b.path} {b.text}" for b in page.blocks)
                rows.append((host, number, _COPY, text_token(_COPY, whole), 1, 0, 0, False, 1))
                rows += [(host, number, path, None, n, 0, 0, False, 1) for path, n in page.places.items()]
                texts = Counter((b.path, text_token(b.path, b.text), len(b.text), b.links, b.out) for b in page.blocks)
                new = {t for _, t, *_ in texts}
                rows += [(host, number, p, t, n, c, k, o, _first(new, t)) for (p, t, c, k, o), n in texts.items()]
            kinds = (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["host", "page", "path", "token", "n", "chars", "links", "out", "first"],
            )

    schema = "host string, page long, path string, token long, n long, chars long, links long, out boolean, first long"
    return pages.select("url", "html").mapInArrow(run, schema)


def _first(new: set[int], token: int) -> int:
    """1 if the token is still among the new ones, which it leaves."""
    found = token in new
    new.discard(token)
    return int(found)


def equivalence_classes(found: DataFrame) -> DataFrame:
    """One row a token of a host: its vector (v1, v2), pages and occurrences."""
    cell = F.struct("page", "n")
    return found.groupBy("host", "path", "token").agg(
        F.bit_xor(F.xxhash64(F.lit(1), cell)).alias("v1"),
        F.bit_xor(F.xxhash64(F.lit(2), cell)).alias("v2"),
        F.count("*").alias("pages"),
        F.sum("n").alias("total"),
        F.max("chars").alias("chars"),
        F.max("links").alias("links"),
        F.bool_and("out").alias("out"),
        F.sum("first").alias("own_pages"),
    )


def is_marked(path: str) -> bool:
    """Whether a place is inside an article or main element."""
    return "/article" in path or "/main" in path


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


def nest(elements: dict[str, tuple]) -> dict[tuple, str]:
    """Valid classes of a host, each with the path under which its elements lie.

    ``elements`` gives each frequent element's vector. A class is valid if the elements around
    its topmost ones all belong to one other class, or to none, the page itself.
    """
    classes: dict[tuple, list[str]] = {}
    for path, vector in elements.items():
        classes.setdefault(vector, []).append(path)
    valid: dict[tuple, str] = {}
    for vector, paths in classes.items():
        tops = [p for p in paths if elements.get(_parent(p)) != vector]
        around = {elements.get(_parent(p)) for p in tops}
        if len(around) == 1:
            valid[vector] = _parent(min(tops, key=len))
    return valid


def templates(pages: DataFrame) -> DataFrame:
    """The template of each host of MIN_PAGES pages: (host, constants, skipped, article, marked, nested).

    ``constants`` are the tokens of its own text, ``skipped`` the slots that are no content,
    ``article`` the path of the element that holds the article (empty if none does), ``marked``
    whether article or main elements hold it (NULL if no slot is content), ``marks`` whether some slot is
    content that no markup speaks against, ``nested`` the valid classes as "path of the class: its place".
    """
    all_tokens = checkpointed(equivalence_classes(tokens(pages)), "html-classes")
    hosts = all_tokens.where("path = '' AND token IS NULL").select("host", F.col("pages").alias("of_host"))
    large = hosts.where(F.col("of_host") >= MIN_PAGES)
    copies = all_tokens.where(F.col("path") == _COPY).groupBy("host").agg(F.max("pages").alias("copies"))
    known = all_tokens.where(F.col("path") != _COPY).join(large.join(copies, "host"), "host")
    text = F.col("token").isNotNull()
    element = known.where(~text & (F.col("path") != "") & (F.col("pages") >= SLOT_SHARE * F.col("of_host")))
    common = (F.col("pages") >= CONSTANT_SHARE * F.col("of_host")) & (F.col("pages") > F.col("copies"))
    # wherever its elements stand among their siblings; a token tells other elements apart
    wide = known.where(text).groupBy("host", "of_host", "copies", "token").agg(F.sum("own_pages").alias("pages"))
    constant = wide.where(common)
    slots = (
        known.where(text)
        .groupBy("host", "of_host", "path")
        .agg(
            F.count("*").alias("texts"),
            F.sum("total").alias("total"),
            F.sum(F.col("chars") * F.col("total")).alias("chars"),
            F.sum(F.col("links") * F.col("total")).alias("links"),
            F.sum(F.when(F.col("out"), F.col("chars") * F.col("total")).otherwise(0)).alias("out"),
        )
        .where(F.col("total") >= SLOT_SHARE * F.col("of_host"))
    )
    kinds = {"element": element, "constant": constant, "slot": slots}
    fields = {
        "element": ["path", "v1", "v2"],
        "constant": ["token"],
        "slot": ["path", "total", "texts", "chars", "links", "out"],
    }
    parts = [found.select("host", F.lit(kind).alias("kind"), *fields[kind]) for kind, found in kinds.items()]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)

    def deduce(table: pa.Table) -> pa.Table:
        # frequent tokens of one host; their number follows the size of its pages, not their count
        found = table.to_pylist()
        elements = {r["path"]: (r["v1"], r["v2"]) for r in found if r["kind"] == "element"}
        valid = nest(elements)
        constants = sorted(r["token"] for r in found if r["kind"] == "constant")
        slots_ = [r for r in found if r["kind"] == "slot"]
        skipped = sorted(
            r["path"]
            for r in slots_
            if r["links"] > LINK_SHARE * r["chars"] or r["texts"] < FRESH_SHARE * r["total"]
        )
        fresh = [r for r in slots_ if r["path"] not in skipped]
        marks = any(2 * r["out"] <= r["chars"] for r in fresh) or not fresh
        content = {r["path"]: r["chars"] for r in fresh if not marks or 2 * r["out"] <= r["chars"]}
        article = deepest(content)
        inside = sum(n for p, n in content.items() if is_marked(p))
        marked = inside >= ARTICLE_SHARE * sum(content.values()) if content else None
        nested = sorted(f"{min(p for p, v in elements.items() if v == vector)}: {place}" for vector, place in valid.items())
        return pa.table(
            {
                "host": pa.array([found[0]["host"]]),
                "constants": pa.array([constants], pa.list_(pa.int64())),
                "skipped": pa.array([skipped], pa.list_(pa.string())),
                "article": pa.array([article]),
                "marked": pa.array([marked], pa.bool_()),
                "marks": pa.array([marks]),
                "nested": pa.array([nested], pa.list_(pa.string())),
            }
        )

    schema = "host string, constants array<long>, skipped array<string>, article string, marked boolean, marks boolean, nested array<string>"
    return rows.groupBy("host").applyInArrow(deduce, schema)


def deepest(content: dict[str, int]) -> str:
    """The deepest element around ARTICLE_SHARE of the text of ``content`` (characters by path)."""
    around: Counter = Counter()
    for path, chars in content.items():
        for outer in _prefixes(_parent(path)):
            around[outer] += chars
    enough = [path for path, chars in around.items() if chars and chars >= ARTICLE_SHARE * sum(content.values())]
    return max(enough, key=lambda path: (path.count("/"), path), default="")


def _prefixes(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(2, len(parts) + 1)]


def main_text(html: str | None, template: dict | None) -> str:
    """The article of a page, one line a block."""
    template = template or {"constants": [], "skipped": [], "article": "", "marked": None, "marks": True}
    blocks = [b for b in parse(html).blocks if not (b.out and template["marks"])]
    own = [b for b in blocks if b.links <= LINK_SHARE * len(b.text)]
    marked, place = template["marked"], template["article"]
    if marked is None:
        marked = sum(len(b.text) for b in own if b.inside) >= MARKED_SHARE * sum(len(b.text) for b in own)
    here = [b for b in own if b.inside] if marked else []
    if not here and place:
        here = [b for b in own if b.path == place or b.path.startswith(place + "/")]
    here = here or own
    skipped = set(template["skipped"])
    # where all slots repeat themselves the pages do, and say nothing of their parts
    slots = [b for b in here if b.path not in skipped] or here
    constants = set(template["constants"])
    kept = [b for b in slots if text_token(b.path, b.text) not in constants] if constants else slots
    return "\n".join(b.text for b in (kept or slots))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    marked = bounded(pages).select(F.col("page_id"), "url", "html")
    known = checkpointed(templates(marked).drop("nested"), "html-templates")

    fields = ["constants", "skipped", "article", "marked", "marks"]

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host = pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, host], ["page_id", "url", "html", "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_host = zip(*(batch.column(n).to_pylist() for n in fields))
            texts = [
                main_text(html, None if row[0] is None else dict(zip(fields, row)))
                for html, row in zip(batch.column("html").to_pylist(), of_host)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    with_host = marked.mapInArrow(hosts, f"page_id {kind}, url string, html string, host string")
    joined = with_host.join(known, "host", "left").select("page_id", "url", "html", *fields)
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
