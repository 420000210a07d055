"""Main text of web pages by page structure and nearest-URL differencing.

A page is read into blocks of text, in page order.  Each block stands in a region: inside
the article (``<article>`` or ``<main>``, where the page has one), inside boilerplate that
the markup names (menus, footers, asides, forms, comments, adverts by element, class, id
or role), or in neither.  Within each host pages are ordered by URL path; each is paired
with the nearer of its two neighbours, the one whose path shares the longer prefix.  The
two pages' blocks are aligned by their longest common subsequence: templates repeat, text
does not.

Every page is paired and aligned, and each of its blocks is judged by its region and by the
alignment.  Named boilerplate is deleted.  A block in neither region is deleted if the neighbour
has it too, and stays if it is the page's own, whether the page marks an article or not.  Blocks
of an article stay, as copies and quoted passages belong to its text, but for a container that
part of its class or id names boilerplate (``newsletter-signup-2``): it is deleted if the
neighbour's article has all its blocks.  Where the neighbours say nothing (there is none, it is a
copy, or it shares no block outside articles with a page that marks one) markup decides alone.

Only block hashes are sorted and compared.  Pages are read twice, once for the hashes and once
for the texts, which are shuffled once, packed, to meet what the alignment says of them.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written
from tessera.operators.order import dense_index

ROWS = 256  # pages handled at once in a task
NAMED, OPEN, ARTICLE, DOUBT = range(4)  # regions: named boilerplate, neither, article; from DOUBT on a number for each container in doubt
COPY = 90  # a neighbour with more than so many hundredths of a page's text is a copy of it, and says nothing about templates

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>
    |<(?P<raw>script|style|noscript|template|svg|math|textarea|select|iframe|object|canvas|audio|video|title)\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S | re.I | re.X)
_ATTR = re.compile(r"""(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
                   "tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav footer aside form menu button dialog head".split())
_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|nav\w*|menus?|breadcrumbs?|sidebar|"
                    r"footer|comments?|disqus|respond|replies|share|sharing|social|newsletter|subscribe|popup|modal|related|recommend\w*|widget)"
                    r"(?:$|[\s_-])", re.I)
#: inside an article a class or id names boilerplate only if all its parts are such words or these
_PARTS = frozenset("area bar block body box buttons column container content entry form group icons inline inner item items left links list "
                   "main outer panel post posts reader right row section slot text thread top bottom unit user wrap wrapper".split())
_PARENTS = frozenset("article main section div body html td li".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_PAGE_PARTS = frozenset("article main body html".split())


def _boilerplate(name: str, attrs: str, in_article: bool) -> bool:
    if name in _DROP or (name == "header" and not in_article):
        return True
    if name in _PAGE_PARTS or not attrs:
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and any(_NAMED.search(v) and (not in_article or _all_named(v)) for v in value.split()):
            return True
    return False


def _doubtful(attrs: str) -> bool:
    """Whether a class or id names boilerplate in part, as ``newsletter-signup-2`` or ``comments-on-war`` does."""
    return any(_NAMED.search(v) for key, value in _ATTR.findall(attrs) if key.lower() in ("class", "id") for v in value.strip("\"'").split())


def _all_named(value: str) -> bool:
    """Whether ``comment-list`` names boilerplate and nothing else, as ``comments-on-war`` or ``share-price`` does not."""
    parts = [x.rstrip("0123456789") for x in re.split(r"[_-]+", value.lower())]
    return all(not x or x in _PARTS or _NAMED.search(x) for x in parts)


def blocks(page: str | None) -> tuple[list[str], list[bool]]:
    """Blocks of a page outside named boilerplate, and whether each is in an article."""
    kept = [(x, r >= ARTICLE) for x, r in zip(*regions(page), strict=True) if r != NAMED]
    return [x for x, _ in kept], [i for _, i in kept]


def regions(page: str | None) -> tuple[list[str], list[int]]:
    """All blocks of a page, and the region of each: text with character references decoded, white space as
    single blanks, trimmed, none empty."""
    out: list[str] = []
    where: list[int] = []
    text: list[str] = []
    article = skip = 0  # open article elements; open elements of the skipped one's name
    doubt = doubts = 0  # open containers up to the one in doubt; how many were in doubt so far
    skipped = ""
    parents: list[str] = []  # open containers around the skipped element, and how many of each are open inside it
    within: Counter[str] = Counter()
    at = 0
    page = page or ""

    def flush():
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            out.append(line)
            where.append(NAMED if skip else OPEN if not article else DOUBT + doubts - 1 if doubt else ARTICLE)
        text.clear()

    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if skip and (name in _BLOCK or name == skipped):
                flush()
            if skip and name == skipped:
                skip -= 1
            elif skip and (within[name] > 0 or name not in parents):
                within[name] -= within[name] > 0
            elif name in _BLOCK or skip:  # an element that was never closed ends with the one around it
                flush()
                skip = 0
                article -= name in ("article", "main") and article > 0
            if not skip and name in parents:
                while parents.pop() != name:
                    pass
                doubt = doubt if len(parents) >= doubt else 0
            continue
        if skip:
            if name in _BLOCK:
                flush()
            elif name == "br":
                text.append(" ")
            if name in ("article", "main") and skipped not in ("article", "main") and not article:
                skip = 0  # a boilerplate element that was never closed ends where the article begins
            else:
                skip += name == skipped and not m["attrs"].endswith("/")
                within[name] += name in _PARENTS and name != skipped
                continue
        if name in _BLOCK:
            flush()
        if name not in _VOID and not m["attrs"].endswith("/") and _boilerplate(name, m["attrs"], article > 0):
            flush()
            skip, skipped = 1, name
            within.clear()
            continue
        if name in _PARENTS:
            parents.append(name)
            if article and not doubt and name not in _PAGE_PARTS and _doubtful(m["attrs"]):
                doubt, doubts = len(parents), doubts + 1
        if name in ("article", "main"):
            article += 1
        elif name == "br":
            text.append(" ")
    text.append(page[at:])
    flush()
    return out, where


def place(url: str | None) -> tuple[str, str]:
    """(host, path): the host without ``www.``, lowered; the path without query, fragment and last slash."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "", ""
    return host, re.sub(r"/+", "/", parts.path).rstrip("/")


def _hash(lines: list[str]) -> list[int]:
    return pd.util.hash_array(np.array(lines, dtype=object), categorize=False).view(np.int64).tolist() if lines else []


def shared(a: list[int], b: list[int]) -> list[bool]:
    """Which elements of ``a`` lie on a longest common subsequence of ``a`` and ``b`` (the earliest in ``a``)."""
    if not a or not b or not set(a) & set(b):
        return [False] * len(a)
    both = set(b)
    keep = [i for i, x in enumerate(a) if x in both]
    x, y = np.array([a[i] for i in keep]), np.array([v for v in b if v in set(a)])
    step = max(1, math.isqrt(len(x)))  # of the table of all suffixes every step-th row is held, and made again from there

    def above(row: np.ndarray, v: int) -> np.ndarray:
        out = np.zeros_like(row)
        out[:-1] = np.maximum.accumulate(np.where(y == v, row[1:] + 1, row[:-1])[::-1])[::-1]
        return out
    held, row = {}, np.zeros(len(y) + 1, np.int32)
    for i in range(len(x), -1, -1):
        row = above(row, x[i]) if i < len(x) else row
        if i % step == 0 or i == len(x):
            held[i] = row
    on, j = [False] * len(a), 0
    for start in range(0, len(x), step):
        end = min(start + step, len(x))
        rows = [held[end]]
        for i in range(end - 1, start - 1, -1):
            rows.append(above(rows[-1], x[i]))
        for i in range(start, end):
            here, below = rows[end - i], rows[end - i - 1]
            if here[j] == below[j]:
                continue
            hit = j + int(np.flatnonzero((y[j:] == x[i]) & (below[j + 1:] + 1 == here[j]))[0])
            on[keep[i]] = True
            j = hit + 1
    return on


_APART = {NAMED: 0x2545F4914F6CDD1D, OPEN: 0, ARTICLE: 0x5851F42D4C957F2F}  # blocks of different regions are different


def _outlines(batches):
    """(key, page_id, host, path, hashes, sizes, regions) of (key, page_id, url, html): all blocks of a page."""
    for key, page_id, url, page in _rows(batches):
        lines, where = regions(page)
        hashes = [h ^ _APART[min(r, ARTICLE)] for h, r in zip(_hash(lines), where, strict=True)]
        yield key, page_id, *place(url), hashes, [len(x) for x in lines], where


def _lines(batches):
    """(key, page_id, url, packed) of (key, page_id, url, html): the blocks outside named boilerplate, with a sign each, ``+`` in an article."""
    for key, page_id, url, page in _rows(batches):
        yield key, page_id, url, zlib.compress("\n".join("-+"[i] + x for x, i in zip(*blocks(page), strict=True)).encode(), 1)


def _texts(batches):
    """(page_id, url, text, n_shared) of (page_id, url, packed, stays, n_shared); what was not aligned is left to markup."""
    for page_id, url, packed, stays, n_shared in _rows(batches):
        lines = zlib.decompress(packed).decode().split("\n") if packed else []
        lines = [x for x in lines if x]
        if stays is None:
            stays = _marked([x[0] == "+" for x in lines])
        yield page_id, url, "\n".join(x[1:] for x, s in zip(lines, stays, strict=True) if s), n_shared or 0


def _rows(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, ROWS).columns), strict=True)


def _by_page(read, fields):
    def run(batches):
        rows = read(batches)
        while some := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some, strict=True), fields, strict=True)], [n for n, _ in fields])
    return run


_OUTLINE = [("key", pa.string()), ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int32())), ("regions", pa.list_(pa.int32()))]
_PACKED = [("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("packed", pa.binary())]
_TEXT = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64())]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _marked(inside: list[bool]) -> list[bool]:
    """What markup says alone: the article, or all where none is marked."""
    return inside if any(inside) else [True] * len(inside)


def judged(hashes: list[int], sizes: list[int], where: list[int], sides: list[list[int]]) -> tuple[list[bool], int]:
    """Which blocks of a page stay, of those outside named boilerplate, and how many of them the nearer neighbour has too.
    ``sides`` are the hashes of the neighbours' blocks, the nearer page first."""
    page = [(h, n, r) for h, n, r in zip(hashes, sizes, where, strict=True) if r != NAMED]
    outside = {h for h, r in zip(hashes, where, strict=True) if r < ARTICLE}
    inside = [r >= ARTICLE for _, _, r in page]
    stays, n_shared = _marked(inside), None
    for other in sides:
        on = shared([h for h, _, _ in page], other)
        n_shared = sum(on) if n_shared is None else n_shared
        if 100 * sum(n for (_, n, _), s in zip(page, on, strict=True) if s) > COPY * sum(n for _, n, _ in page):
            continue
        apart = any(inside) and outside.isdisjoint(other)  # not of one template, so that being its own says nothing of a block
        own = {r for (_, _, r), s in zip(page, on, strict=True) if r >= DOUBT and not s}
        stays = [r == ARTICLE or (r in own if r >= DOUBT else not s and not apart) for (_, _, r), s in zip(page, on, strict=True)]
        break
    return stays, n_shared or 0


def _aligned(frames):
    """(key, stays, n_shared) of every page, see ``judged``."""
    for f in frames:
        out = []
        for key, path, hashes, sizes, where, p1, h1, p2, h2 in f.itertuples(index=False):
            sides = sorted(((_prefix(path, p), -k, list(h)) for k, (p, h) in enumerate(((p1, h1), (p2, h2))) if p is not None), reverse=True)
            out.append((key, *judged(list(hashes), list(sizes), list(where), [h for _, _, h in sides])))
        yield pd.DataFrame(out, columns=["key", "stays", "n_shared"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every page row; ``n_shared`` counts the blocks, outside named boilerplate, that
    the page's neighbour has too.

    A null or empty page has the empty text; a null or malformed URL has the host "" and pages of that
    host are not paired; rows equal in id, URL and page are one page, and each has its text; a page whose nearer neighbour
    is a copy (see ``COPY``) is judged by the other one, and by markup alone if that is a copy as well (``n_shared`` is always of the
    nearer one); null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    prepare(spark)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.select(F.md5(F.to_json(F.struct("page_id", "url", "html"))).alias("key"), "page_id", "url", "html")
    outline = pages.mapInArrow(_by_page(_outlines, _OUTLINE), "key string, page_id bigint, host string, path string, hashes array<bigint>, "
                               "sizes array<int>, regions array<int>")
    # nearest neighbours by one sort over (host, path)
    order = written(dense_index(written(outline.where("host <> ''")).dropDuplicates(["key"]), ["host", "path", "page_id", "key"], out="at"))
    side = lambda step, n: order.select((F.col("at") + step).alias("at"), F.col("host").alias(f"host{n}"), F.col("path").alias(f"p{n}"),
                                        F.col("hashes").alias(f"h{n}"))
    near = (order.join(side(1, 1), "at", "left").join(side(-1, 2), "at", "left")
            .select("key", "path", "hashes", "sizes", "regions",
                    *[F.when(F.col(f"host{n}") == F.col("host"), F.col(f"{c}{n}")).alias(f"{c}{n}") for n in (1, 2) for c in "ph"]))
    aligned = near.mapInPandas(_aligned, "key string, stays array<boolean>, n_shared bigint")
    packed = pages.mapInArrow(_by_page(_lines, _PACKED), "key string, page_id bigint, url string, packed binary")
    return (packed.join(aligned, "key", "left").select("page_id", "url", "packed", "stays", "n_shared")
            .mapInArrow(_by_page(_texts, _TEXT), "page_id bigint, url string, text string, n_shared bigint")
            .select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_shared"))
