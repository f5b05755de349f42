"""Main text of web pages by equivalence-class template deduction over the pages of a host.

Tokens of a page are its block elements and its text blocks, each told apart by its path.  A token's occurrence vector
over the host's pages is kept as a sum of hashed pages, which merges in any order; tokens with equal sums form an
equivalence class.  Classes that are large and frequent enough are valid: their tokens are the template, in which a
text block stands in its element, so both are of one class.  Classes of elements nest by their paths; an element that
only some pages have, as that of one layout of several, is a class inside another's.  What varies between the template's
tokens are its slots.  Of a page, the slots in the lowest container that holds all its varying text are returned.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, joined_by_key, written

#: Tokens that a valid class has, and different pages (rows of equal content count once) that it is on, at least.
SIZE, SUPPORT = 3, 5
#: Occurrence vectors' sums are taken modulo this, so that they can be added up in a long over many batches.
VECTOR = 1 << 40

# Element names of HTML by role.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option output p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas object".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|template|svg|xmp"
OUT = set("head title nav footer aside form button select textarea dialog menu noscript iframe template svg object audio video canvas option optgroup fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("html body div main article section center table tbody tr td".split())
CLOSED_BY_BLOCK = {"p"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of class and id names that mark what isn't the article.
OUT_NAMES = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip".split()
)

_TAG = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
_NAME = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """(path component, whether the element is outside any article) of an opening tag."""
    out, label = name in OUT, name
    if "class" in attributes or "id" in attributes or "CLASS" in attributes or "ID" in attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAME.finditer(attributes)}
        if found.get("class"):
            label += "." + ".".join(sorted(re.sub(r"\d+", "#", found["class"]).split())[:4]).replace("/", "_")
        elif found.get("id"):
            label += "#" + re.sub(r"\d+", "#", found["id"]).replace("/", "_")
        if name not in ("html", "body", "main", "article"):
            out = out or any(w.lower() in OUT_NAMES for v in found.values() for w in _WORDS.findall(v))
    return label, out


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(path, text, characters inside links) of every text block, in page order; paths are joined by ``/`` and an
    element outside any article begins with ``!``.  Unclosed elements end where HTML says or with their parent."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []  # (name, path)
    piece: list[str] = []
    links = link = 0
    page = page or ""

    def end_block():
        nonlocal links
        if piece:
            text = "".join(piece)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((stack[-1][1] if stack else "", text, min(links, len(text))))
            piece.clear()
        links = 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            t = page[at : m.start()]
            piece.append(t)
            links += len(t) if link else 0
        at = m.end()
        name = m[3]
        if not name:
            if m[1] and m[1].lower() in BLOCKS:
                end_block()
            continue
        name = name.lower()
        if name == "a":
            link = 0 if m[2] else 1
        if name not in BLOCKS:
            if name == "br":
                piece.append(" ")
            continue
        end_block()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] in CLOSED_BY_BLOCK:
            stack.pop()
        if name in SAME_CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SAME_CLOSES[name]:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select", "div"):
                    break
        if name in VOID or m[4].endswith("/"):
            continue
        label, outside = _label(name, m[4])
        if name == "header" and not any(n == "article" for n, _ in stack):
            outside = True
        path = (stack[-1][1] + "/" if stack else "") + ("!" if outside else "") + label
        stack.append((name, path))
    piece.append(page[at:])
    end_block()
    return out


def _hash(*parts: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "replace")) - 2**63


def _tokens(pages: DataFrame) -> DataFrame:
    """Per batch, host and token: the token of its element (text only), how often it is there, on how many pages, its
    occurrence vector's sum, and up to SUPPORT hashes of contents it is on.

    Copies of a page weigh all tokens on it alike, so they leave equal vectors equal.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found: dict[tuple, list] = {}
                for url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    host, bs = host_of(url), blocks(page)
                    sign = _hash(page or "")
                    count: Counter = Counter()
                    for path, text, _ in bs:
                        if path:
                            count[_hash(path, text), _hash(path)] += 1
                    for path in {p for path, _, _ in bs if path for p in _ancestors(path)}:
                        count[_hash(path), None] = 1
                    for t, n in count.items():
                        x = found.setdefault((host, *t), [0, 0, 0, set()])
                        x[0] += n
                        x[1] += 1
                        x[2] = (x[2] + sign * n) % VECTOR
                        if len(x[3]) < SUPPORT:
                            x[3].add(sign)
                cols = list(zip(*((*k, *v[:3], list(v[3])) for k, v in found.items()), strict=True)) or [[]] * 7
                kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["host", "token", "element", "n", "pages", "vector", "contents"])

    return pages.mapInArrow(run, "host string, token long, element long, n long, pages long, vector long, contents array<long>")


def _ancestors(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[: i + 1]) for i in range(len(parts))]


def deduced_templates(tokens: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host: its rows, whether it has pages enough for a template, and the hashes of the template's text blocks."""
    merged = tokens.groupBy("host", "token", "element").agg(F.sum("n").alias("n"), F.sum("pages").alias("on"), F.pmod(F.sum("vector"), F.lit(VECTOR)).alias("vector"), F.array_distinct(F.flatten(F.collect_list("contents"))).alias("contents"))
    once = written(merged.filter((F.col("n") == F.col("on")) & (F.size("contents") >= SUPPORT)).select("host", "token", "element", "vector"), "once")
    classes = once.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= SIZE).select("host", "vector")
    around = once.filter("element is null").select("host", F.col("token").alias("element"), "vector").join(classes, ["host", "vector"])
    fixed = once.filter("element is not null").join(around, ["host", "element", "vector"])
    return hosts.join(fixed.groupBy("host").agg(F.collect_list("token").alias("fixed")), "host", "left")


def main_text(page: str | None, template: bool, fixed=()) -> str:
    """The text of a page's slots: without its template, those in the lowest container that holds all text that isn't
    links; a page of a host without template is taken from its article, main or body.  Text of the template stays where
    nothing else would."""
    inside = [b for b in blocks(page) if not _outside(b[0])]
    if not template:
        for name in ("article", "main"):
            own = [b for b in inside if any(re.match(rf"{name}\b", c) for c in b[0].split("/"))]
            if own:
                return "\n".join(b[1] for b in own)
        return "\n".join(b[1] for b in inside)
    own = [b for b in inside if _hash(b[0], b[1]) not in fixed] or inside
    slot = _container([b[0] for b in own if len(b[1]) > b[2]])
    return "\n".join(b[1] for b in own if not slot or b[0] == slot or b[0].startswith(slot + "/"))


def _container(paths: list[str]) -> str:
    """The lowest container around all ``paths``; empty if there is none."""
    if not paths:
        return ""
    low, high = min(parts := [p.split("/") for p in paths]), max(parts)
    k = 0
    while k < min(len(low), len(high)) and low[k] == high[k]:
        k += 1
    while k and re.match(r"[a-z0-9]*", low[k - 1])[0] not in CONTAINERS:
        k -= 1
    return "/".join(low[:k])


def _outside(path: str) -> bool:
    """Whether a block is outside any article; headings of an article's own header stay."""
    return "!" in path


def extract(pages: DataFrame, page: str = "html", url: str = "url", ident: str = "page_id") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    A null page has no text; pages without a host form one host of their own; a host with under SUPPORT different pages
    has no template, so its pages are taken from their article, main or body element.  Rows of equal content count once
    in the template, and each is returned; columns other than the three named are ignored.
    """
    rows = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    contents = rows.groupBy("host", F.xxhash64(F.coalesce("html", F.lit("")))).agg(F.count(F.lit(1)).alias("copies"))
    hosts = written(contents.groupBy("host").agg(F.sum("copies").alias("host_pages"), (F.count(F.lit(1)) >= SUPPORT).alias("template")), "hosts")
    tokens = written(_tokens(rows.select("url", "html")), "tokens")
    templates = written(deduced_templates(tokens, hosts), "templates")
    dropped(tokens)
    total = hosts.agg(F.coalesce(F.sum("host_pages"), F.lit(0))).first()[0]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                known: dict[str, frozenset] = {}
                texts = []
                for host, html_, template, fixed in zip(*(part.column(c).to_pylist() for c in ("host", "html", "template", "fixed")), strict=True):
                    if host not in known:
                        known[host] = frozenset(fixed or ())
                    texts.append(main_text(html_, template, known[host]))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    joined = joined_by_key(rows, templates, ["host"], "host_pages", total)
    return joined.mapInArrow(run, "id long, url string, text string, n_chars long")
