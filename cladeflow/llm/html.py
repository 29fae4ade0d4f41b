"""Main text of web pages by template deduction from equivalence classes of tokens (operator 11)."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

SUPPORT, SIZE = 0.2, 2  # a class is on at least this share of a host's pages, and has at least so many tokens
FIXED, HOST_PAGES = 0.9, 10  # a text on this share of the pages of a host of at least so many is its template's, not an article's
AGREE = 0.95  # share of a class's pages that must have its tokens in one order, and its occurrences in one slot
LINKED = 0.5  # share of link text beyond which a slot outside articles is a menu
SMALL = 64 << 20  # bytes of templates up to which they are broadcast

# Elements and words of names by which pages say what a part is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
OUT = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg math object canvas audio video dialog menu title noembed noframes".split())
PARTS = frozenset("html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ALWAYS_OUT = frozenset("comment comments disqus replies respond commentlist".split())
NAMED_OUT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert warning announcement form newsletter subscribe signup login search share sharing social related recommended recommendations widget popup modal overlay pagination pager toolbar skip hidden copyright disclaimer teaser trending complementary contentinfo".split())
NAMED_HEADER = frozenset("header topbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^<>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD, _DIGITS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"\d+")


class Element:
    """An open element: its place among a page's elements as a code, and what its names and those around it say."""

    __slots__ = ("article", "header", "heading", "inline", "link", "main", "named", "out", "role", "tag")

    def __init__(self, tag: str, parent: Element | None, role: int, names: frozenset, hidden: bool):
        self.tag, self.role, self.inline = tag, role, tag in INLINE
        up = parent or _TOP
        region = tag in ("article", "main")
        self.article, self.main = up.article or tag == "article", up.main or tag == "main"
        header = tag == "header" or bool(names & NAMED_HEADER)
        self.heading, self.link = up.heading or tag in HEADINGS, up.link or tag == "a"
        self.header = up.header or (header and up.article)  # of an article's own header only headings count
        whole = tag in PARTS
        self.out = up.out or hidden or tag in OUT or (not whole and bool(names & ALWAYS_OUT))
        self.named = (up.named and not region) or (not whole and bool(names & NAMED_OUT)) or (header and not up.article)


class _Top:
    article = main = heading = link = header = out = named = False


_TOP = _Top()


@lru_cache(maxsize=100_000)
def _code(role: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=7, key=role.to_bytes(8, "little")).digest(), "little")


@lru_cache(maxsize=20_000)
def _names(attributes: str) -> tuple[str, frozenset, bool]:
    """What of an element's attributes tells its place (names without numbers), the words of its names, and whether it is hidden."""
    found: dict = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    label = "|".join(_DIGITS.sub("0", found.get(k, "")) for k in ("id", "class", "role"))
    words = frozenset(w.lower() for k in ("id", "class", "role") for w in _WORD.findall(found.get(k, "")))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return label, words, hidden


_NAMELESS = ("||", frozenset(), False)


def events(page: str) -> Iterator[tuple]:
    """Tokens of a page in order: ("tag", code, parent) for starts and ends of elements, ("text", code, parent, text, element, share of link text) for blocks.

    A block is the text between the ends of elements that aren't inline, with white space joined. Codes say where in
    the tree of elements a token stands; a text's code also holds the text.
    """
    stack: list[Element] = []
    parts: list[str] = []
    linked, holder, at, n = 0, None, 0, len(page)

    def block():
        nonlocal parts, linked, holder
        text = "".join(parts)
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        found = None
        if text and holder is not None:
            found = ("text", _text_code(holder.role, text), holder.role, text, holder, min(1.0, linked / len(text)))
        parts, linked, holder = [], 0, None
        return found

    def words(raw: str):
        nonlocal linked, holder
        if raw:
            parts.append(raw)
            if not raw.isspace():
                k = len(stack) - 1
                if stack and stack[k].link:
                    linked += len(raw)
                while k > 0 and stack[k].inline:
                    k -= 1
                if holder is None:
                    holder = stack[k] if stack else Element("body", None, 0, frozenset(), False)

    def drop(k: int) -> Iterator[tuple]:
        """Close the elements from the k-th on."""
        if k >= len(stack):
            return
        if parts and (k < len(stack) - 1 or not stack[k].inline) and any(not e.inline for e in stack[k:]) and (b := block()):
            yield b
        while len(stack) > k:
            role = stack.pop().role
            yield ("tag", _code(role, "/"), role)

    def last(tags) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in tags), None)

    search, paragraphs, in_head = _TOKEN.search, 0, False
    while at < n:
        m = search(page, at)
        if m is None:
            words(page[at:])
            break
        begin, end = m.span()
        if begin > at:
            words(page[at:begin])
        at = end
        tag = m[2] or m[5]
        if tag is None:
            if page.startswith("<![CDATA[", begin):
                words(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if stack and stack[-1].tag == tag:
                k = len(stack) - 1
            else:
                k = last((tag,))
            if k is not None:
                yield from drop(k)
            elif tag in ("p", "br") and (b := block()):
                yield b
            continue
        if tag in VOID:
            if tag != "wbr" and tag != "img":
                parts.append(" ")
            continue
        inline = tag in INLINE
        if in_head and (tag == "body" or not (inline or tag in OUT or tag == "html")):
            in_head = False
            if (k := last(("head",))) is not None:
                yield from drop(k)
        if not inline:
            if tag in CLOSES_P and paragraphs:
                k = last(("p", "button", "td", "th", "caption", "object"))
                if k is not None and stack[k].tag == "p":
                    yield from drop(k)
            if tag in CLOSED_BY:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in SCOPES[tag]:
                        break
                    if stack[i].tag in CLOSED_BY[tag]:
                        yield from drop(i)
            if parts and (b := block()):
                yield b
        attributes = m[3] or m[6] or ""
        label, names, hidden = _names(attributes) if attributes else _NAMELESS
        up = stack[-1] if stack else None
        above = up.role if up else 0
        element = Element(tag, up, _code(above, f"{tag} {label}"), names, hidden)
        yield ("tag", element.role, above)
        if tag in RAW:
            ended = _ends(tag).search(page, at)
            at = ended.end() if ended else n
            yield ("tag", _code(element.role, "/"), element.role)
        elif not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
            stack.append(element)
            paragraphs += tag == "p"  # how many there were; none needs no look
            in_head = in_head or tag == "head"
    yield from drop(0)
    if b := block():
        yield b


@lru_cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I)


def _text_code(role: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7, key=role.to_bytes(8, "little")).digest(), "little") | 1 << 62


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def occurrences(batches) -> Iterator[pa.RecordBatch]:
    """(host, code, parent, pages, times, v1, v2, v3): for each token of a host's pages, sums that tell its vector of occurrences; code 0 is a page itself."""
    for b in batches:
        rows: dict = {}
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            host, page = host_of(url), page or ""
            key = hashlib.blake2b(f"{url}\n{page}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            marks: dict = {}
            for (code, parent), times in [((0, 0), 1), *Counter(e[1:3] for e in events(page)).items()]:
                mark = marks.get(times)
                if mark is None:  # 96 bits of what tells this many on this page; sums of 32 bits each can't overflow
                    mark = marks[times] = np.frombuffer(hashlib.blake2b(times.to_bytes(8, "little"), digest_size=12, key=key).digest(), "<u4").astype(np.int64).tolist()
                row = rows.get((host, code, parent))
                if row is None:
                    rows[host, code, parent] = [1, times, *mark]
                else:
                    row[0] += 1
                    row[1] += times
                    row[2] += mark[0]
                    row[3] += mark[1]
                    row[4] += mark[2]
        if rows:
            hosts, codes, parents = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(codes, pa.int64()), pa.array(parents, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*rows.values(), strict=True))], ["host", "code", "parent", "pages", "times", "v1", "v2", "v3"])


def classes_of(vectors: DataFrame) -> DataFrame:
    """(host, code, parent, class, once, share, host_pages): tokens with the same vector of occurrences, where they are often."""
    whole = vectors.filter("code = 0").select("host", F.col("pages").alias("host_pages"))
    often = vectors.filter("code != 0 and pages > 1").join(whole, "host").withColumn("share", F.col("pages") / F.col("host_pages")).filter(F.col("share") >= SUPPORT)
    named = often.withColumn("class", F.xxhash64("pages", "times", "v1", "v2", "v3"))
    return named.select("host", "code", "parent", "class", (F.col("times") == F.col("pages")).alias("once"), "share", "host_pages")


def parted(tokens: list[dict]) -> list[dict]:
    """A host's tokens with the classes of which there are enough, and their sizes. Repeated elements of one vector that don't stand in each other are classes of their own."""
    of = {t["code"]: t for t in tokens}

    def top(t: dict) -> int:
        while not t["once"] and (up := of.get(t["parent"])) is not None and up["class"] == t["class"]:
            t = up
        return 0 if t["once"] else t["code"]

    named = [t | {"class": _code(top(t), str(t["class"]))} for t in tokens]
    size = Counter(t["class"] for t in named)
    return [t | {"size": size[t["class"]]} for t in named if size[t["class"]] >= SIZE]


class Template:
    """What is known of a host: its tokens' classes, and of slots whether they are menus."""

    TOKEN, SLOT = np.dtype([("code", "<i8"), ("class", "<i8"), ("size", "<i4"), ("fixed", "?")]), np.dtype([("slot", "<i8"), ("menu", "?")])

    def __init__(self, raw: bytes | None):
        tokens, slots = np.zeros(0, self.TOKEN), np.zeros(0, self.SLOT)
        if raw:
            raw = B.expand(raw)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            tokens, slots = np.frombuffer(raw, self.TOKEN, n, 8), np.frombuffer(raw, self.SLOT, -1, 8 + n * self.TOKEN.itemsize)
        self.tokens = {c: (k, s, f) for c, k, s, f in tokens.tolist()}
        self.menus = {s for s, menu in slots.tolist() if menu}

    @classmethod
    def packed(cls, tokens: list, slots: list) -> bytes:
        return B.squeeze(np.array([len(tokens)], "<i8").tobytes() + np.array(tokens, cls.TOKEN).tobytes() + np.array(slots, cls.SLOT).tobytes())


class Walk:
    """One page read along a template: which classes are open, at which of their tokens, and so the slot of each block."""

    def __init__(self, template: Template):
        self.template = template
        self.open: list[list[int]] = []  # class, tokens seen of this occurrence
        self.orders: dict[int, list[int]] = {}
        self.inside: Counter = Counter()

    def slot(self) -> int:
        return slot_code(*self.open[-1]) if self.open else 0

    def step(self, code: int) -> None:
        known = self.template.tokens.get(code)
        if known is None:
            return
        name, size, _ = known
        self.orders.setdefault(name, []).append(code)
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == name), None)
        if at is None:
            self.inside[name, self.slot()] += 1
            self.open.append([name, 0])
            at = len(self.open) - 1
        self.open[at][1] += 1
        if self.open[at][1] == size:
            del self.open[at]

    def order(self, name: int) -> int:
        """A code for the order of a class's tokens, if all its occurrences on this page have the same."""
        codes = self.orders[name]
        size = self.template.tokens[codes[0]][1]
        first = codes[:size]
        return _code(0, repr(first)) if len(set(first)) == size and codes == first * (len(codes) // size) else -1


@lru_cache(maxsize=100_000)
def slot_code(name: int, at: int) -> int:
    return _code(at, str(name))


def checked(pages: list[tuple[str, str | None]], known: Callable[[str], Template]) -> Iterator[tuple]:
    """(host, kind, a, b, n, m): of a class how many pages have its tokens in an order (kind 0), and its occurrences in a slot (1); of a slot its letters, and those of links (2)."""
    sums: Counter = Counter()
    links: Counter = Counter()
    for host, page in pages:
        walk = Walk(known(host))
        for e in events(page or ""):
            if e[0] == "text":
                sums[host, 2, walk.slot(), 0] += len(e[3])
                links[host, 2, walk.slot(), 0] += int(e[5] * len(e[3]))
            walk.step(e[1])
        for name in walk.orders:
            sums[host, 0, name, walk.order(name)] += 1
        for (name, slot), times in walk.inside.items():
            sums[host, 1, name, slot] += times
    for key, n in sums.items():
        yield (*key, n, links[key])


def main_text(page: str | None, template: Template) -> str:
    """The page's article: blocks in its own slots, without what its template or its elements' names set apart."""
    walk, found = Walk(template), []
    for e in events(page or ""):
        if e[0] == "text":
            element, menu = e[4], walk.slot() in template.menus
            known = template.tokens.get(e[1])
            if not element.out and not element.named and (element.heading or not element.header):
                found.append((e[3], element, menu, known is not None, bool(known and known[2])))
        walk.step(e[1])
    for where in ("article", "main"):
        inside = [x for x in found if getattr(x[1], where)]
        if inside:
            return " ".join(x[0] for x in [x for x in inside if not x[4]] or inside)
    data = [x for x in found if not x[2] and not x[3]]
    return " ".join(x[0] for x in data or [x for x in found if not x[2]] or found)


def _told(pages: DataFrame, templates: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(batches, known) over pages, where known(host) is the host's template; broadcast while they are small, else joined by host."""
    size = templates.agg(F.sum(F.octet_length("told")).alias("n")).head()["n"] or 0
    if size <= SMALL:
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["told"]) for r in templates.collect()})
        return pages.mapInArrow(lambda batches: run(batches, lru_cache(maxsize=1000)(lambda host: Template(held.value.get(host)))), schema)

    def named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in b.column(0).to_pylist()], pa.string())], [*b.schema.names, "host"])

    def joined(batches):
        for b in batches:
            told = dict(zip((host_of(u) for u in b.column(0).to_pylist()), range(b.num_rows), strict=True))
            known = lru_cache(maxsize=None)(lambda host: Template(b.column(b.num_columns - 1)[told[host]].as_py()))  # noqa: B023
            yield from run(iter([pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1])]), known)

    with_host = pages.mapInArrow(named, T.StructType([*pages.schema.fields, T.StructField("host", T.StringType())]))
    return with_host.join(templates, "host", "left").select(*pages.columns, "told").mapInArrow(joined, schema)  # an adaptive plan splits a host of very many pages


def deduced(pages: DataFrame) -> DataFrame:
    """(host, told): the template of each host, from rows (url_, html_).

    Tokens (starts and ends of elements, and blocks of text, each with its place in the tree) that have the same vector of occurrences over the
    host's pages form a class; where they repeat on a page, one for each element that isn't inside another of the class. A class stays if its tokens come in one order and all its occurrences lie in one slot of the class around them.
    """
    vectors = pages.select("url_", "html_").mapInArrow(occurrences, "host string, code long, parent long, pages long, times long, v1 long, v2 long, v3 long").groupBy("host", "code", "parent").agg(*(F.sum(c).alias(c) for c in ("pages", "times", "v1", "v2", "v3")))
    B.shared_checkpoints(pages.sparkSession)
    classes = classes_of(vectors.filter("code = 0 or pages > 1").checkpoint()).checkpoint()

    def pack(valid: bool):
        def run(batches):
            for b in batches:
                out = []
                for row in b.to_pylist():
                    good = {c["a"] for c in row.get("good") or []}
                    tokens = [(t["code"], t["class"], t["size"], t["code"] >> 62 == 1 and t["share"] >= FIXED and t["host_pages"] >= HOST_PAGES) for t in parted(row["tokens"] or []) if not valid or t["class"] in good]
                    slots = [(s["a"], s["m"] > LINKED * s["n"]) for s in row.get("slots") or []]
                    out.append(Template.packed(tokens, slots))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["host", "told"])

        return run

    tokens = classes.groupBy("host").agg(F.collect_list(F.struct("code", "parent", "class", "once", "share", "host_pages")).alias("tokens"))

    def check(batches, known):
        for b in batches:
            rows = list(checked([(host_of(u), p) for u, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], known))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "kind", "a", "b", "n", "m"])

    first = tokens.mapInArrow(pack(False), "host string, told binary")
    seen = _told(pages.select("url_", "html_"), first, check, "host string, kind int, a long, b long, n long, m long")
    seen = seen.groupBy("host", "kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).checkpoint()
    agreed = seen.filter("kind < 2").groupBy("host", "kind", "a").agg((F.max(F.when(F.col("b") != -1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    good = agreed.groupBy("host", "a").agg(F.min("share").alias("share")).filter(F.col("share") >= AGREE).groupBy("host").agg(F.collect_list(F.struct("a")).alias("good"))
    slots = seen.filter("kind = 2").groupBy("host").agg(F.collect_list(F.struct("a", "n", "m")).alias("slots"))
    return tokens.join(good, "host", "left").join(slots, "host", "left").mapInArrow(pack(True), "host string, told binary").checkpoint()


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page: its article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and comments.

    Each host's pages give a template of nested classes of tokens (see `deduced`); what is not template fills slots. A page's text is what
    stands in the slots of its article or main element, or where it has neither in all slots but those that are mostly links. Elements whose
    tag or names (class, id, role) say that they are something else are left out, as are texts that nearly all pages of a host of
    HOST_PAGES or more have, unless a page has nothing else. Character references are decoded, white space joined, blocks joined by a space.

    A null or empty page has an empty text; null, unreadable and relative addresses make one host; on a host of one page there is no template, and tags and
    names decide; repeated rows stay; an empty table gives no rows; other columns may have any names.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(f"`{url_col}`").cast("string").alias("url_"), F.col(f"`{html_col}`").cast("string").alias("html_"), F.col(f"`{id_col}`").alias("id_"))

    def extract(batches, known):
        for b in batches:
            texts = [main_text(p, known(host_of(u))) for u, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return _told(rows, deduced(rows), extract, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")


def op11_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# For pages whose articles are marked as such, as those of the given table are: what the deduced template leaves is the article element's text.
SQL = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM b"""
