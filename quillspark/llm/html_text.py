"""Main text of web pages: page structure first, then a suffix array over the pages of a host.

Scripts, styles, comments and elements whose tag, role, class or id names a menu, header, footer, sidebar, notice,
advert, form or reader comments go. Where a page marks its article (article, main), the rest of its blocks is doubtful
and is kept only as evidence; where it doesn't, all its blocks are doubtful. The doubtful blocks' token streams of a
host's pages are concatenated; a suffix array finds substrings that occur on two pages or more. On a page without a marked
article, runs of `min_run` tokens or more inside a block that occur inside a block of another page, and blocks that stand
on another page as a whole, are boilerplate; the rest stays. Words and shorter runs that only occur elsewhere too count
for nothing.

Every page is parsed once. Pages with a marked article are done then; only unmarked pages are shuffled, with the doubtful
blocks of their hosts' other pages as evidence. Such a host's pages are dealt to chunks of at most about `chunk` pages and
`chunk_chars` characters, so a task never holds a whole large host. The chunks of a host exchange 64-bit hashes of their distinct windows of `min_run` words and of their distinct blocks: every run of
`min_run` words or more is a union of such windows, so what repeats between chunks is found as what repeats inside one.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import broadcast_if_small, materialize, task
from quillspark.llm.suffixes import covered, suffix_array

# Element names, and the words that mark what is no main text.
RAW = "script|style|noscript|template|textarea|svg|iframe|title|select|math|object|canvas|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav footer aside form button menu dialog head select fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar aside rail footer header masthead topbar cookie cookies consent gdpr notice banner alert newsletter subscribe "
    "subscription popup modal overlay share sharing social related recommended comment comments disqus respond reply replies widget widgets "
    "toolbar pagination pager skip login signup search searchbox form copyright".split()
)
HOLDERS = frozenset("content main article body page wrapper container with has no without post entry story".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset("p li dt dd td th tr option".split())


def unwanted(name: str, attributes: str) -> bool:
    """Whether an element's tag, role, class or id, or its being hidden, says that it is no main text."""
    if name in NEVER:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id"):
            for word in value.split():
                if word in MARKS:
                    return True
                pieces = [p for p in re.split(r"[-_]+", word) if p]
                if name not in ("article", "main") and pieces and (pieces[0] in MARKS or pieces[-1] in MARKS) and not HOLDERS.intersection(pieces):
                    return True
    return False


def blocks_of(html: str | None) -> list[tuple[str, bool]]:
    """(text, in a marked article) of each block that isn't unwanted, in page order."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that matter: name, and 1 unwanted, 2 article, 3 its header, 4 its heading, 0 other
    count = [0] * 5
    at, html = 0, html or ""

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, count[2] > 0))
            parts.clear()

    def close(to: int):
        while len(stack) > to:
            count[stack.pop()[1]] -= 1

    def take(text: str):
        if not count[1] and (not count[3] or count[4]):
            parts.append(text)

    for m in TOKEN.finditer(html):
        if m.start() > at:
            take(html[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        attributes = m[4] if m[3] else m[7]
        if name in BLOCKS:
            flush()
            while stack and stack[-1][0] in CLOSED_BY_BLOCK and name not in ("td", "th"):
                close(len(stack) - 1)
        elif name == "br":
            take(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if unwanted(name, attributes) or name == "header" and not count[2]:
            kind = 1
        elif name in ("article", "main"):
            kind = 2
        elif name == "header":
            kind = 3
        elif name in HEADINGS and count[3]:
            kind = 4
        elif name in BLOCKS and name not in CLOSED_BY_BLOCK:
            kind = 0
        else:
            continue
        stack.append((name, kind))
        count[kind] += 1
    if at < len(html):
        take(html[at:])
    flush()
    return out


FIRST = pa.schema([("host", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("weight", pa.int64())])


def first_rows(batches):
    """(host, page_id, url, html) to FIRST: text is null where no article is marked; weight counts the doubtful blocks' characters."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            texts, weights = [], []
            for page in part.column(3).to_pylist():
                blocks = blocks_of(page)
                inside = [t for t, article in blocks if article]
                texts.append("\n".join(inside) if inside else None)
                weights.append(sum(len(t) for t, article in blocks if not article))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.string()), pa.array(weights, pa.int64())], schema=FIRST)


PARSED = pa.schema([("host", pa.string()), ("chunk", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("need", pa.bool_()), ("doubtful", pa.list_(pa.string()))])


def parse_rows(batches):
    """(host, chunk, page_id, url, html) to PARSED; a page needs its text from its doubtful blocks where no article is marked."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            need, doubtful = [], []
            for page in part.column(4).to_pylist():
                blocks = blocks_of(page)
                need.append(not any(article for _, article in blocks))
                doubtful.append([t for t, article in blocks if not article])
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(need, pa.bool_()), pa.array(doubtful, PARSED.field("doubtful").type)], schema=PARSED)


def repeated_on_pages(tokens: np.ndarray, page: np.ndarray, end: np.ndarray, host: np.ndarray) -> np.ndarray:
    """For each position the longest prefix of its suffix that occurs on another page of its host too."""
    sa, lcp = suffix_array(tokens, host, end)
    n = len(sa)
    length = np.zeros(n, np.int64)
    pages = page[sa]
    for way in (1, -1):
        order = np.arange(n)[::way]
        step = lcp if way == 1 else np.r_[lcp[1:], 0]
        # The nearest suffix of another page on this side; across suffixes of the page itself the common prefix is the least between.
        other = np.zeros(n, np.int64)
        previous = -1
        same = np.zeros(n, bool)
        same[order[1:]] = pages[order[1:]] == pages[order[:-1]]
        other[~same] = step[~same]
        for r in order[1:][same[order[1:]] & (step[order[1:]] > 0)]:
            previous = r - way
            other[r] = min(step[r], other[previous])
        length[sa] = np.maximum(length[sa], other)
    return length


def window_hashes(words: list[str], size: int) -> np.ndarray:
    """A 64-bit hash of each window of `size` words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    each = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[codes]
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(out)]
    return out


def block_hash(block: str) -> int:
    return xxhash.xxh64_intdigest(block, seed=1)


HASHES = pa.schema([("host", pa.string()), ("chunk", pa.int32()), ("hash", pa.int64()), ("need", pa.bool_())])


def hash_rows(batches, min_run: int):
    """(host, chunk, page_id, url, html) to HASHES: the distinct windows and blocks of each page's doubtful blocks."""
    for parsed in parse_rows(batches):
        for host, chunk, _, _, need, blocks in zip(*(c.to_pylist() for c in parsed.columns), strict=True):
            hashes = np.unique(np.concatenate([np.array([block_hash(b) for b in blocks], np.uint64), *(window_hashes(b.split(), min_run) for b in blocks)]))
            n = len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([chunk] * n, pa.int32()), pa.array(hashes.view(np.int64)), pa.array([need] * n)], schema=HASHES)


def unique_text(pages: list[list[str]], hosts: list[int], need: list[bool], min_run: int, known: dict[int, list[int]] | None = None) -> list[str | None]:
    """The text of each page that needs it, without what its host's other pages repeat. known: hashes of what stands in other chunks."""
    words = [[b.split() for b in blocks] for blocks in pages]
    flat = [w for blocks in words for block in blocks for w in block]
    if not flat:
        return ["" if x else None for x in need]
    sizes = np.array([sum(map(len, blocks)) for blocks in words], np.int64)
    page = np.repeat(np.arange(len(pages)), sizes)
    block = np.array([len(b) for blocks in words for b in blocks], np.int64)  # a run lies within a block
    length = repeated_on_pages(pd.factorize(np.array(flat, dtype=object))[0], page, np.repeat(np.cumsum(block), block), np.repeat(np.array(hosts), sizes))
    others = {host: np.array(hashes, np.int64).view(np.uint64) for host, hashes in (known or {}).items()}
    at = 0
    for host, blocks, wanted in zip(hosts, words, need, strict=True):
        for own in blocks:
            if wanted and host in others and len(own) >= min_run:
                found = np.flatnonzero(np.isin(window_hashes(own, min_run), others[host])) + at
                length[found] = np.maximum(length[found], min_run)
            at += len(own)
    long_run = covered(length, min_run)
    elsewhere = {host: set(hashes.tolist()) for host, hashes in others.items()}
    first_page: dict[tuple[int, str], int] = {}  # of each block of a host; -1 once it stands on two pages
    for number, (host, blocks) in enumerate(zip(hosts, words, strict=True)):
        for block in map(" ".join, blocks):
            if first_page.setdefault((host, block), number) != number:
                first_page[host, block] = -1
    out: list[str | None] = []
    at = 0
    for host, blocks, wanted in zip(hosts, words, need, strict=True):
        kept = []
        for block in blocks:
            n = len(block)
            text = " ".join(block)
            if wanted and first_page[host, text] >= 0 and not (host in elsewhere and block_hash(text) in elsewhere[host]):
                kept.append(" ".join(w for w, gone in zip(block, long_run[at : at + n], strict=True) if not gone))
            at += n
        out.append("\n".join(filter(None, kept)) if wanted else None)
    return out


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def clean_rows(batches, min_run: int):
    """PARSED and a hash, sorted by (host, chunk), to TEXTS of the pages that need one; rows with a hash are no page, but say what other chunks hold. Groups are solved together, up to 200,000 tokens at a time."""
    rows: list[tuple] = []
    known: dict[tuple, list[int]] = {}
    held = 0

    def made():
        groups: dict[tuple, int] = {}
        numbers = [groups.setdefault((r[0], r[1]), len(groups)) for r in rows]
        there = {groups[k]: hashes for k, hashes in known.items() if k in groups}
        texts = unique_text([r[5] or [] for r in rows], numbers, [r[4] for r in rows], min_run, there)
        columns = list(zip(*((r[2], r[3], t) for r, t in zip(rows, texts, strict=True) if r[4]), strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TEXTS, strict=True)], schema=TEXTS)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and held > 200_000 and (row[0], row[1]) != (rows[-1][0], rows[-1][1]):
                yield made()
                rows, held = [], 0
                known = {k: v for k, v in known.items() if k == (row[0], row[1])}
            if row[6] is not None:
                known.setdefault((row[0], row[1]), []).append(row[6])
                continue
            rows.append(row)
            held += sum(b.count(" ") + 1 for b in row[5] or [])
    if rows:
        yield made()


def shared_hashes(dealt: DataFrame, min_run: int) -> DataFrame:
    """(host, chunk, hash): what a chunk with unmarked pages shares with another chunk of its host. No row holds more than a chunk number per chunk."""
    hashes = dealt.select("host", "chunk", "page_id", "url", "html").mapInArrow(task("html_text:hash_rows", min_run), "host string, chunk int, hash long, need boolean")
    met = hashes.groupBy("host", "hash").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"), F.collect_set(F.when(F.col("need"), F.col("chunk"))).alias("chunks"))
    return met.where("first <> last").select("host", F.explode("chunks").alias("chunk"), "hash")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = 2048, chunk_chars: int = 4_000_000, min_run: int = 12) -> DataFrame:
    """page_id, url, text. Blocks in page order, white space inside a block as one space, joined by a newline.

    A null or empty page has the empty text; a null URL has the empty host. Null ids and repeated rows are returned as
    they are (a repeated page without a marked article counts as another page). An empty table gives no row. Other
    columns are ignored, whatever their names.
    """
    url = F.col(url_col).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")))
    source = pages.select(host.alias("host"), F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = materialize(source.mapInArrow(task("html_text:first_rows"), "host string, page_id long, url string, text string, weight long"), "parsed")
    marked = parsed.where("text is not null").select("page_id", "url", "text")
    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("weight") / chunk_chars)).cast("int")
    # Hosts with a page that has doubtful blocks only; an unmarked page without any block is empty as it is.
    hosts = materialize(parsed.groupBy("host").agg(chunks.alias("chunks"), F.max(F.when(F.col("text").isNull(), F.col("weight"))).alias("open")).where("open > 0").select("host", "chunks"), "hosts")
    n_hosts = hosts.count()
    if not n_hosts:
        return marked.unionByName(parsed.where("text is null").select("page_id", "url", F.lit("").alias("text")))
    blank = parsed.where("text is null").join(broadcast_if_small(hosts, n_hosts), "host", "left_anti").select("page_id", "url", F.lit("").alias("text"))
    dealt = source.join(broadcast_if_small(hosts, n_hosts), "host").select("host", F.pmod(F.xxhash64("page_id", "url"), F.col("chunks")).cast("int").alias("chunk"), "page_id", "url", "html", "chunks")
    rows = dealt.drop("chunks").mapInArrow(task("html_text:parse_rows"), "host string, chunk int, page_id long, url string, need boolean, doubtful array<string>").withColumn("hash", F.lit(None).cast("long"))
    large = dealt.where("chunks > 1")
    if not hosts.where("chunks > 1").isEmpty():
        rows = rows.unionByName(shared_hashes(large, min_run), allowMissingColumns=True)
    grouped = rows.repartition("host", "chunk").sortWithinPartitions("host", "chunk", F.col("hash").isNull())
    solved = grouped.mapInArrow(task("html_text:clean_rows", min_run), "page_id long, url string, text string")
    return marked.unionByName(blank).unionByName(solved)
