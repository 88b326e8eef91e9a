"""Main text of web pages: structure first, then suffix arrays over the pages of a host.

A page is read as a stream of tags and text. Elements that are never article
text (menus, page headers, footers, side bars, notices, adverts, forms,
scripts, styles, reader comments) are passed over, by their names, roles and
classes; inside an article, a class word such as ``related`` needs links,
controls or comments inside as a second sign; classes of ``html``, ``body``, ``main``, of an article and of what
holds one tell how the page looks and pass nothing over. What is left are
blocks. Blocks inside the best mark that has text (``article``, ``main`` or the
role ``main``, else a class or id such as ``content``) are kept whole: authors
quote, and licence lines or stock phrases recur on many pages.

All other blocks, beside a marked article or on a page without one, are decided
by host. The pages of a host are dealt to buckets of bounded size. In a bucket
the words of these blocks are laid one after another and their suffixes sorted;
neighbours with a common prefix of ``least`` words form intervals, and of each
interval the smallest and the largest page are kept. Intervals of all buckets
of a host meet by their first words, so a repeat that lies in two buckets is
found as well. Words under a substring of ``least`` words, or under a whole
shorter block, that is found on two distinct pages of the host are boilerplate;
the runs between them are kept, in their place among the blocks kept whole.

A null page, or one without text, has an empty text. A null url counts as a
host of its own. Repeated rows are the same page, so they do not count as
distinct pages. Pages of any length are read whole. Columns other than the
three named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textbatch as T
from .repetition import common, suffix_array, union

#: Words of a repeat at least.
LEAST = 8
#: Pages of a bucket on the average.
BUCKET_PAGES = 256

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|textarea|title|iframe|head(?!er)|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<(?![a-zA-Z/!?]))",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE = frozenset("nav footer aside form button select menu dialog fieldset".split())
#: Elements with parts that are no text; nested ones count, and ``/>`` ends one.
DRAWN = frozenset("svg math canvas object audio video template".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of classes and ids that mark what is not article text.
SIDE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer comment comments commentlist reply "
    "replies respond disqus discussion share sharing social related recommended newsletter subscribe signup login toolbar pagination pager skip".split()
)
#: Those of them that also tell how a page around an article is laid out.
LAYOUT_WORDS = frozenset("banner nav navbar navigation menu sidebar aside footer toolbar".split())
#: Those of them that may as well name a part of an article; there, links, controls or comments inside must speak for them too.
TOPIC_WORDS = frozenset("discussion related recommended social promotion menu navigation login skip".split())
#: Words that make a class tell a state: ``no-sidebar``, ``comments-open``.
STATE_WORDS = frozenset("no not has have with without open closed".split())
#: Words of classes and ids that mark an article where no element does.
MAIN_WORDS = frozenset("article articlebody content post entry story main".split())
PLACE = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")


def named(attributes: str):
    """Names and lower-case values of attributes."""
    for name, *values in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        yield name.lower(), "".join(values).lower()


def marks_side(tag: str, attributes: str, in_article: bool, holds: bool = False, leans=lambda: True) -> bool:
    """Whether an element is not article text. A header inside an article holds its title.

    ``holds`` tells that a marked article lies inside. Classes of the page, of a
    marked article, and words of layout about one, say nothing about the text.
    ``leans()`` tells whether what is inside looks like no text either.
    """
    if tag in SIDE or tag in DRAWN or tag == "header" and not in_article:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    pairs = list(named(attributes))
    # An article in an article is a reader's comment where its class says so.
    trusted = tag in ("html", "body", "main") or tag == "article" and not in_article or ("role", "main") in pairs
    around = holds or any(name == "id" and set(re.findall(r"[a-z0-9]+", value) or [""]) <= MAIN_WORDS for name, value in pairs)
    for name, value in pairs:
        if name == "role" and (value in SIDE_ROLES):
            return True
        if name in ("class", "id") and not trusted:
            parts = [set(re.split(r"[^a-z0-9]+", part)) for part in value.split()]
            found = set().union(*[words for words in parts if not words & STATE_WORDS])
            words = found & (SIDE_WORDS - LAYOUT_WORDS if around else SIDE_WORDS)
            if words and (not in_article or words - TOPIC_WORDS or leans()):
                return True
            if not around and (not in_article and "header" in found or "side" in found and "bar" in found):
                return True
        if name == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def marks_article(tag: str, attributes: str) -> int:
    """2 for elements and roles that mark an article, 1 for classes and ids that do, else 0."""
    if tag in ("article", "main"):
        return 2
    level = 0
    for name, value in named(attributes):
        if name == "role" and value == "main":
            return 2
        if name in ("class", "id") and set(re.split(r"[^a-z0-9]+", value)) & MAIN_WORDS:
            level = 1
    return level


def read_tree(page: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[int, str | None]]]:
    """Elements (tag, attributes, number of the parent, own mark), and texts with the element each is in; None ends a block."""
    elements: list[tuple[str, str, int, int]] = [("", "", -1, 0)]
    texts: list[tuple[int, str | None]] = []
    stack: list[tuple[str, int]] = []
    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        if m is None:
            # A tag that is cut off at the end of the page, or one with an open quote.
            stop = page.find(">", at)
            at = len(page) if stop < 0 else stop + 1
            continue
        at = m.end()
        text, tag, raw = m["text"], m["tag"], m["raw"]
        if text is not None:
            texts.append((stack[-1][1] if stack else 0, text))
        elif raw is not None:
            close = re.compile(rf"</{raw}\s*>", re.I).search(page, at)
            body = re.compile(r"<body\b", re.I).search(page, at) if raw.lower() == "head" else None
            if body and (close is None or body.start() < close.start()):
                at = body.start()
            else:
                at = close.end() if close else len(page)
        elif tag is not None:
            tag = tag.lower()
            if tag == "br":
                texts.append((-1, " "))
            if tag in BLOCKS:
                texts.append((stack[-1][1] if stack else 0, None))
            if m["close"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag not in VOID and not m["attributes"].endswith("/"):
                if tag in BLOCKS and stack:
                    # A paragraph ends where a block begins; a list item where the next one does.
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p" or stack[i][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                            del stack[i:]
                            break
                        if stack[i][0] in BLOCKS:
                            break
                elements.append((tag, m["attributes"], stack[-1][1] if stack else 0, marks_article(tag, m["attributes"])))
                stack.append((tag, len(elements) - 1))
    texts.append((stack[-1][1] if stack else 0, None))
    return elements, texts


def leaning(elements: list[tuple[str, str, int, int]], texts: list[tuple[int, str | None]]) -> list[bool]:
    """Of every element, whether links hold half of its characters, or controls or readers' comments are inside."""
    size, linked = [0] * len(elements), [0] * len(elements)
    for element, text in texts:
        if text is not None and element >= 0:
            size[element] += len(text.strip())
    held = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        tag, attributes, parent, _ = elements[i]
        if tag == "a":
            linked[i] = size[i]
        comments = any(k in ("class", "id") and set(re.split(r"[^a-z0-9]+", v)) & {"comment", "comments"} for k, v in named(attributes))
        held[i] |= tag in ("form", "button", "select", "fieldset") or comments
        size[parent] += size[i]
        linked[parent] += linked[i]
        held[parent] |= held[i]
    return [inside or 2 * links >= every for inside, links, every in zip(held, linked, size)]


def page_blocks(page: str | None) -> list[tuple[str, int]]:
    """Blocks that are not passed over, in the page's order, each with the mark of the article it is in."""
    elements, texts = read_tree(page or "")
    holds = [False] * len(elements)
    for _, _, parent, mark in elements:
        while mark == 2 and parent >= 0 and not holds[parent]:
            holds[parent] = True
            parent = elements[parent][2]
    passing, article = [False] * len(elements), [0] * len(elements)
    leans: list[bool] = []
    for i, (tag, attributes, parent, mark) in enumerate(elements[1:], 1):

        def leans_here(i=i) -> bool:
            if not leans:
                leans.extend(leaning(elements, texts))
            return leans[i]

        passing[i] = passing[parent] or marks_side(tag, attributes, article[parent] > 0, holds[i], leans_here)
        article[i] = 0 if passing[i] else max(article[parent], mark)
    blocks: list[tuple[str, int]] = []
    buffer: list[str] = []
    for element, text in texts:
        if text is not None:
            if element < 0 or not passing[element]:
                buffer.append(text)
        elif buffer:
            joined = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if joined:
                blocks.append((joined, article[element]))
    return blocks


def read_page(page: str | None) -> tuple[list[str], list[str], bool]:
    """Blocks inside the best marked articles, the blocks of a page without any, and whether an article is marked."""
    blocks = page_blocks(page)
    best = max((mark for _, mark in blocks), default=0)
    found = [text for text, mark in blocks if mark == best]
    return (found if best else []), ([] if best else found), best > 0


def parsed(pages: DataFrame, id_column="page_id", url_column="url", html_column="html") -> DataFrame:
    """page_id, url, u (one number for equal rows), host, and the text of pages whose blocks are all kept whole.

    Other pages have ``blocks``, and ``whole`` for those that are kept whole.
    """
    fields = {
        "page_id": pa.int64(), "url": pa.string(), "u": pa.int64(), "host": pa.string(), "text": pa.string(),
        "blocks": pa.list_(pa.string()), "whole": pa.list_(pa.bool_()),
    }

    def read(found):
        for batch in found:
            hosts, texts, lists, flags = [], [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2)):
                place = PLACE.match(url or "")
                hosts.append(place[1].lower() if place else "")
                blocks = page_blocks(page.as_py())
                best = max((mark for _, mark in blocks), default=0)
                whole = [best > 0 and mark == best for _, mark in blocks]
                texts.append("\n".join(text for text, _ in blocks) if all(whole) else None)
                lists.append(None if all(whole) else [text for text, _ in blocks])
                flags.append(None if all(whole) else whole)
            columns = [batch.column(0), batch.column(1), batch.column(3), hosts, texts, lists, flags]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, fields.values())], list(fields))

    named = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return named.withColumn("u", F.xxhash64("page_id", "url", "html")).mapInArrow(
        read, "page_id long, url string, u long, host string, text string, blocks array<string>, whole array<boolean>"
    )


def streams(rows: pd.DataFrame):
    """Word hashes of the open blocks of a bucket, the block and the page of each, the words, and the place of each block on its page."""
    texts, block_page, places = [], [], []
    for page, (blocks, whole) in enumerate(zip(rows["blocks"], rows["whole"])):
        for i in np.flatnonzero(~np.asarray(whole, bool)).tolist():
            texts.append(blocks[i])
            block_page.append(page)
            places.append(i)
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    data = np.frombuffer(raw, np.uint8)
    starts, ends, block = T.words(data, offsets)
    return T.hashes(data, starts, ends), block, np.array(block_page, np.int64)[block], (data, starts, ends), places


def keys(values: np.ndarray, block: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Substrings of ``least`` words, or whole shorter blocks: hash, first word, number of words."""
    found, at = T.grams(values, block, least)
    size = np.full(len(at), least)
    counts = np.bincount(block) if len(block) else np.zeros(0, np.int64)
    for few in range(1, least):
        short = np.flatnonzero((counts == few)[block]) if len(counts) else np.zeros(0, np.int64)
        if len(short):
            whole, place = T.grams(values[short], block[short], few)
            found, at, size = np.concatenate([found, whole]), np.concatenate([at, short[place]]), np.concatenate([size, np.full(len(place), few)])
    return found, at, size


def intervals(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """Intervals of a bucket's suffix array: the hash of their first words, smallest and largest page."""
    values, block, page, _, _ = streams(rows)
    found, at, size = keys(values, block, least)
    if not len(at):
        return pd.DataFrame({"host": [], "bucket": [], "key": [], "low": [], "high": []})
    # A page's words end with a mark of its own, so no common prefix runs on into the next block.
    mark = T.mix(np.arange(int(block[-1]) + 1).astype(T.U64) + T.U64(1 << 40))
    last = np.append(block[1:] != block[:-1], True)
    place = np.arange(len(values)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    stream = np.empty(len(values) + int(last.sum()), T.U64)
    stream[place] = values
    stream[place[last] + 1] = mark[block[last]]
    order = suffix_array(stream, np.zeros(len(stream), np.int64))
    power, inverse = T._tables(len(stream) + 1)
    sums = np.zeros(len(stream) + 1, T.U64)
    np.cumsum(stream * power[: len(stream)], out=sums[1:])
    key_at = np.full(len(stream), -1)
    key_at[place[at]] = np.arange(len(at))
    suffixes = order[key_at[order] >= 0]
    which = key_at[suffixes]
    a, b = suffixes[:-1], suffixes[1:]
    shared = common(sums, inverse, a, b, len(stream) - np.maximum(a, b))
    need = np.maximum(size[which[:-1]], size[which[1:]])
    new = np.append(True, (shared < need) | (size[which[:-1]] != size[which[1:]]))
    number = np.cumsum(new) - 1
    u = rows["u"].to_numpy()[page[at[which]]]
    low = np.full(number[-1] + 1, np.iinfo(np.int64).max)
    high = np.full(number[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, number, u)
    np.maximum.at(high, number, u)
    return pd.DataFrame(
        {"host": rows["host"].iloc[0], "bucket": rows["bucket"].iloc[0], "key": found[which[new]].astype(np.int64), "low": low, "high": high}
    )


def unique_runs(rows: pd.DataFrame, repeated: pd.DataFrame, least: int) -> pd.DataFrame:
    """What repeats leave of the open blocks of a bucket's pages, among the blocks kept whole."""
    if not len(rows):
        return pd.DataFrame({"u": [], "text": []})
    values, block, page, (data, starts, ends), places = streams(rows)
    found, at, size = keys(values, block, least)
    again = np.isin(found.astype(np.int64), repeated["key"].to_numpy(np.int64))
    keep = ~union(at[again], size[again], len(values)) if len(values) else np.zeros(0, bool)
    raw = data.tobytes()
    lines: dict[int, dict[int, list[str]]] = {}
    for at_page, (blocks, whole) in enumerate(zip(rows["blocks"], rows["whole"])):
        lines[at_page] = {i: [blocks[i]] for i in np.flatnonzero(np.asarray(whole, bool)).tolist()}
    for i in np.flatnonzero(keep).tolist():
        lines[int(page[i])].setdefault(places[int(block[i])], []).append(raw[starts[i] : ends[i]].decode())
    texts = ["\n".join(" ".join(ws) for _, ws in sorted(lines[p].items())) for p in range(len(rows))]
    return pd.DataFrame({"u": rows["u"].to_numpy(), "text": texts})


def host_runs(open_pages: DataFrame, least: int) -> DataFrame:
    """u and text of pages with text outside marked articles; ``open_pages`` has u, host, blocks and whole."""
    pages = open_pages.dropDuplicates(["u"])
    sizes = pages.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / BUCKET_PAGES).alias("buckets"))
    bucketed = materialize(
        pages.join(sizes, "host").select("u", "host", F.pmod(F.xxhash64("u"), F.col("buckets")).cast("long").alias("bucket"), "blocks", "whole")
    )
    found = materialize(
        bucketed.groupBy("host", "bucket").applyInPandas(lambda rows: intervals(rows, least), "host string, bucket long, key long, low long, high long")
    )
    repeated = found.groupBy("host", "key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "key")
    here = found.select("host", "bucket", "key").join(repeated, ["host", "key"]).select("host", "bucket", "key")
    return bucketed.groupBy("host", "bucket").cogroup(here.groupBy("host", "bucket")).applyInPandas(
        lambda rows, keys_: unique_runs(rows, keys_, least), "u long, text string"
    )


def main_texts(pages: DataFrame, least: int = LEAST, id_column="page_id", url_column="url", html_column="html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    read = materialize(parsed(pages, id_column, url_column, html_column), compression="zstd")
    open_pages = read.where(F.col("blocks").isNotNull())
    text: Column = F.coalesce("text", F.lit(""))
    if not open_pages.isEmpty():
        runs = materialize(host_runs(open_pages.select("u", "host", "blocks", "whole"), least)).withColumnRenamed("text", "run")
        read = read.join(runs, "u", "left")
        text = F.coalesce("text", "run", F.lit(""))
    return read.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
