"""HTML extraction by nearest-URL page differencing.

A page is cut into lines, one for each run of text between block-level tags, each with the place it stands in: inside an article
container, inside boilerplate that says so itself (navigation, footer, form, advert, comments ..), or neither. Pages are then sorted
by host and URL path, each is paired with the neighbour whose path shares the longest beginning, and the two pages' lines are
aligned by longest common subsequence. Lines that both have are the host's template and go, wherever they stand; body paragraphs inside
an article container alone are kept, since two articles may share a passage. Copies of a page are passed over: the neighbours
are the nearest pages of the host before and after it that differ from it, in whatever task they are.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_of, table, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|textarea|select|object|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE = frozenset("nav footer aside form dialog button head menu fieldset".split())
_ARTICLE = frozenset("article main".split())
_NAMED = re.compile(
    r"""(?:class|id|role|aria-label)\s*=\s*["']?[^"'>]*?(?<![a-z])(?<!has-)(?<!with-)(?<!no-)(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"""
    r"""signup|login|share|sharing|social|follow|sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?|toolbar|topbar|masthead|site-header|page-header|footer|site-footer|"""
    r"""comments?|comment-\w+|replies|reply|disqus|respond|related|recommended|read-more|trending|popular|pagination|pager|skip-link|copyright|complementary|contentinfo|search)(?![a-z])""",
    re.I,
)
#: Headers count as boilerplate outside an article only; inside, they hold its title.
_HEADER = re.compile(r"""(?:class|id|role)\s*=\s*["']?[^"'>]*?(?<![a-z])(?:header|banner)(?![a-z])""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")
#: Where a line stands.
INSIDE, OUTSIDE, BOILERPLATE = 0, 1, 2
#: A line is a body paragraph if it ends as a sentence does, or has so many characters.
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u2019\u201d\u00bb)\]]*$")
BODY = 40


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """(place, text) of each non-empty line in page order. Text in boilerplate elements is a line as well, so that pages can be
    aligned, but never kept. An article container ends boilerplate that was left open before it."""
    page = page or ""
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    skip, depth, inside = "", 0, 0  # the boilerplate element that is open, how often its name is open in it, article containers open

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((BOILERPLATE if skip else INSIDE if inside else OUTSIDE, text))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, closing, rest = name.lower(), bool(m[2]), m[4]
        if name in _INLINE and not (rest and not closing and (_HIDDEN.search(rest) or _NAMED.search(rest))) and name != skip:
            continue
        flush()
        if name in _VOID:
            continue
        if closing:
            if skip:
                if name == skip:
                    depth -= 1
                    if not depth:
                        skip = ""
                elif name in _ARTICLE and inside and name not in ("aside",):
                    skip, depth = "", 0
            if name in _ARTICLE and not skip:
                inside = max(0, inside - 1)
            continue
        if name in ("html", "body"):
            skip, depth = "", 0
            continue
        named = bool(rest) and name != "main" and (_NAMED.search(rest) is not None or _HIDDEN.search(rest) is not None)
        if name in _ARTICLE and not named:
            if skip and not inside:
                skip, depth = "", 0
            if not skip:
                inside += 1
        elif skip:
            if name == skip and not rest.endswith("/"):
                depth += 1
        elif name in _BOILERPLATE or named or (not inside and (name == "header" or (rest and _HEADER.search(rest)))):
            if not rest.endswith("/"):
                skip, depth = name, 1
    if at < len(page):
        tail = page[at:]
        cut = tail.rfind("<")
        buffer.append(tail if cut < 0 or ">" in tail[cut:] else tail[:cut])  # a tag that the page's end cuts short
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b (Hunt and Szymanski: a longest rising run of matching positions)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[int, list[int]] = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            elif j < ends[k]:
                ends[k], nodes[k] = j, node
    middle = []
    node = nodes[-1] if nodes else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def main_text(places: list[int], lines: list[str], own: list[int], others: list[list[int]]) -> str:
    """The lines kept, joined by spaces. others: the line hashes of the neighbours, nearest first. Lines that the nearest neighbour has as
    well go, but for body paragraphs in an article container. If it accounts for everything, the next one is asked; if that does so
    too, nothing is deleted for being shared. A page without neighbours keeps its container's lines, or all if it has none."""
    free = [i for i, p in enumerate(places) if p != BOILERPLATE]
    for other in others:
        shared = set(common_lines(own, other))
        left = [i for i in free if i not in shared or (places[i] == INSIDE and (len(lines[i]) >= BODY or _SENTENCE.search(lines[i])))]
        if left:
            return " ".join(lines[i] for i in left)
    if not others and INSIDE in places:
        free = [i for i in free if places[i] == INSIDE]
    return " ".join(lines[i] for i in free)


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[i] != b[i]), n)
    return k


_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:(?:www|m|mobile|amp)\.)?([^/?#:]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def _line_hashes(texts: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]


def _digest(places: list[int], hashes: list[int]) -> bytes:
    return hashlib.md5(bytes(places) + np.array(hashes, np.uint64).tobytes()).digest()


def _rank(host: str, path: str, page_id: int | None, digest: bytes) -> tuple:
    """Orders pages as Spark does."""
    return host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0, digest


def _borders(own: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """(first rank, (before, after)) of each range of the pages in order: before is the last earlier page that differs from the range's
    first one, after the next page that differs from its last one, each as (host, path, line hashes) or None."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = []
            for page in b.column(4):
                got = page_lines(page.as_py())
                digests.append(_digest([g[0] for g in got], _line_hashes([g[1] for g in got])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(digests, pa.binary())], names=["page_id", "host", "path", "digest"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails = [], []  # first pages of the first two runs of copies, last pages of the last two
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if tails and (tails[-1][1], tails[-1][3]) == (row[1], row[3]):
                    tails[-1] = row
                    continue
                tails = [*tails[-1:], row]
                if len(heads) < 2:
                    heads.append(row)
        rows = [(TaskContext.get().partitionId(), i, *r) for i, r in [*enumerate(heads), *enumerate(tails, 4 - len(tails))]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["p", "i", "page_id", "host", "path", "digest"])

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary())
    order = ("host", "path", "page_id", "digest")
    known = written(own.mapInArrow(keys, "page_id long, host string, path string, digest binary"), "page-keys")
    found = known.repartitionByRange(parts_of(own.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(ends, "p int, i int, page_id long, host string, path string, digest binary").collect()
    ranges: dict[int, dict[int, tuple]] = defaultdict(dict)
    for p, i, page_id, host, path, digest in found:
        ranges[p][i] = (page_id, host, path, bytes(digest))
    ranges = [ranges[p] for p in sorted(ranges)]
    content = lambda row: (row[1], row[3])

    def walk(row: tuple, ahead: list[dict[int, tuple]], near: int, far: int) -> tuple | None:
        for r in ahead:
            if content(r[near]) != content(row):
                return r[near]
            if far in r:
                return r[far]
        return None

    around = [(walk(r[0], ranges[:k][::-1], 3, 2), walk(r[3], ranges[k + 1 :], 0, 1)) for k, r in enumerate(ranges)]
    wanted = {x[3] for pair in around for x in pair if x}

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page in b.column(4):
                got = page_lines(page.as_py())
                own = _line_hashes([g[1] for g in got])
                digest = _digest([g[0] for g in got], own)
                if digest in wanted:
                    yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([np.array(own, np.uint64).tobytes()], pa.binary())], names=["digest", "hashes"])

    ids = {x[0] for pair in around for x in pair if x}
    some = own.where(F.col("page_id").isin([i for i in ids if i is not None]) | (F.col("page_id").isNull() if None in ids else F.lit(False)))
    held = {bytes(d): np.frombuffer(h, np.uint64).tolist() for d, h in some.mapInArrow(hashes, "digest binary, hashes binary").distinct().collect()} if wanted else {}
    return [_rank(r[0][1], r[0][2], r[0][0], r[0][3]) for r in ranges], [tuple(x and (x[1], x[2], held[x[3]]) for x in pair) for pair in around]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    Null or empty html gives the empty text. A null or odd url has an empty host and path and sorts first. Repeated rows each give a
    row. Pages are dealt out in ranges of (host, path, page_id), so a host of any size is spread over tasks. Each page is compared with
    the nearest pages of its host before and after it that differ from it; where those lie in other ranges, they are sent along, so
    the ranges don't change any text. The html itself is not shuffled, only its lines.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "host", "path", "places", "lines", "p", "digest"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                places, texts, ranges, digests = [], [], [], []
                for page_id, host, path, page in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                    got = page_lines(page)
                    places.append(bytes(g[0] for g in got))
                    texts.append([g[1] for g in got])
                    digests.append(_digest(places[-1], _line_hashes(texts[-1])))
                    ranges.append(max(0, bisect_right(firsts, _rank(host, path, page_id, digests[-1])) - 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(places, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(ranges, pa.int32()), pa.array(digests, pa.binary())], names=names)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple]:
            """(before, pages (page_id, url, path), host, places, lines, line hashes, after) of each run of copies."""
            key = before = run = None
            for b in batches:
                for page_id, url, host, path, places, texts, p, digest in zip(*(c for c in b.columns)):
                    page, now = (page_id.as_py(), url.as_py(), path.as_py()), (p.as_py(), host.as_py(), digest.as_py())
                    if now == key:
                        run[0].append(page)
                        continue
                    texts = texts.as_py()
                    new = ([page], now[1], list(places.as_py()), texts, _line_hashes(texts))
                    if run:
                        yield before, *run, (new[1], page[2], new[4]) if now[0] == key[0] else around[key[0]][1]
                    before = (run[1], run[0][-1][2], run[4]) if run and now[0] == key[0] else around[now[0]][0]
                    key, run = now, new
            if run:
                yield before, *run, around[key[0]][1]

        done: list[tuple] = []
        for before, own, host, places, texts, hashes, after in runs():
            known: dict[tuple, str] = {}
            for page_id, url, path in own:
                near = [(x, i) for i, x in enumerate((before, after)) if x and x[0] == host and host]
                near.sort(key=lambda x: -_alike(x[0][1], path))
                which = tuple(i for _, i in near)
                if which not in known:
                    known[which] = main_text(places, texts, hashes, [x[2] for x, _ in near])
                done.append((page_id, url, known[which], len(known[which])))
                if len(done) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=fields)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=fields)

    fields, kinds = ["page_id", "url", "text", "n_chars"], (pa.int64(), pa.string(), pa.string(), pa.int64())
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lower(F.regexp_extract(url, _HOST, 1)).alias("host"), F.regexp_extract(url, _PATH, 1).alias("path"), F.col("html").cast("string").alias("html"))
    firsts, around = _borders(own)
    cut = own.mapInArrow(lines, "page_id long, url string, host string, path string, places binary, lines array<string>, p int, digest binary")
    dealt = cut.repartitionById(parts_of(pages.sparkSession), F.col("p")).sortWithinPartitions("p", "host", "path", "page_id", "digest")
    return dealt.mapInArrow(differ, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
