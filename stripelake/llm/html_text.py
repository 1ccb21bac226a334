"""Main text of web pages: blocks by markup, and nearest-URL page differencing.

A page is read into blocks in order.  Markup says of a block that it is furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments), text of the page's article, or nothing.  Then every page meets its neighbours: pages of one
host are ordered by URL path, each is aligned with its nearest pages by longest common subsequence of blocks, and shared
blocks are deleted.  A block that markup leaves open goes if one neighbour shares it.  A block of the article goes only if three of
the four neighbours share it and have other articles, so lines that a few articles have in common stay.  Copies
say nothing about templates: pages of a host with equal blocks are one page, at the first of their paths.  What is shared with
a neighbour that is almost a copy may be text of both or a large template, so it goes only if a second neighbour shares it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches
from .scratch import Table

#: Element names, roles, and words of class and id.
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr".split())
DROPPED = frozenset("nav footer aside form menu dialog button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu sidebar footer cookie cookies consent gdpr "
    "newsletter subscribe subscription signup share sharing social related recommended breadcrumb breadcrumbs comment comments disqus popup modal overlay pagination pager login teaser teasers".split()
)
OUTER_HINTS = frozenset("header masthead banner notice notices alert topbar toolbar".split())
#: Words that say where or what kind of box a hint names.
PLACES = frozenset("area bar block body bottom box buttons col column container content form global group icons inner item items left links list main outer page posts primary right section site slot top unit wrap wrapper".split())
PARAGRAPH_ENDS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl table section article main blockquote pre figure header footer nav aside form hr address fieldset details menu".split())

_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)\s*(/?)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>=]*)\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPACES = re.compile(r"\s*")
#: The share of a page's blocks from which a neighbour counts as almost its copy, and of its article's from which it tells nothing about that.
COPY = 0.8
SAME_ARTICLE = 0.5
#: A line of the article is template if so many of the four nearest pages, with other articles, share it.
ARTICLE_VOTES = 3
#: What markup says of a block: text of the page's article, furniture, or nothing.
OPEN, ARTICLE, FURNITURE = 0, 1, 2
#: Pages with shared blocks, up to this number, are broadcast to the second reading; more are joined by a shuffle.
BROADCAST_PAGES = 100_000


def _attributes(page: str, at: int, unclosed: set[str]) -> tuple[dict[str, str], int]:
    """The attributes of a tag, from the end of its name, and the position after it; -1 where the page ends within.

    A quote that never closes is a character; ``unclosed`` remembers such quotes, so that the page is searched for each once.
    """
    out: dict[str, str] = {}
    n = len(page)
    while at < n:
        m = _ATTR_NAME.match(page, at)
        name, at = m[1].lower(), m.end()
        if at < n and page[at] == ">":
            if name:
                out.setdefault(name, "")
            return out, at + 1
        if at < n and page[at] == "=":
            at = _SPACES.match(page, at + 1).end()
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') and quote not in unclosed else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                if quote in ("'", '"'):
                    unclosed.add(quote)
                m = _UNQUOTED.match(page, at)
                value, at = m[0], m.end()
            out.setdefault(name, value)
        elif name:
            out.setdefault(name, "")
    return out, -1


def _named(value: str, hints: frozenset[str]) -> bool:
    """Whether a class or id names a hint: alone, or with words that only tell its place (ad-slot, not ad-free)."""
    for token in value.lower().split():
        words = token.replace("_", "-").split("-")
        if any(w in hints for w in words) and all(w in hints or w in PLACES for w in words):
            return True
    return False


def _kind(name: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """(furniture, main) of an element by its name and attributes; inside: within a main element."""
    main = name in ("article", "main")
    if name in DROPPED or name == "header" and not inside:
        return True, False
    if attrs:
        if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or "display:none" in "".join(attrs.get("style", "").lower().split()):
            return True, False
        role = attrs.get("role", "").strip().lower()
        if role in ROLES:
            return True, False
        main |= role in ("main", "article")
        if name not in ("body", "html"):
            for value in (attrs.get("class", ""), attrs.get("id", "")):
                if value and (_named(value, HINTS) or not inside and not main and _named(value, OUTER_HINTS | HINTS)):
                    return True, False
    return False, main


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, OPEN, ARTICLE or FURNITURE) of every block in order.

    The page's article is the outermost main element with the most text (ties: the first).  Scripts, styles and the like are no blocks.
    One pass, each tag read once; an element that the page never closes holds what follows.
    """
    page = page or ""
    out: list[tuple[str, bool, int]] = []  # text, furniture, number of the main element or 0
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, furniture, main element; the last two hold for all within
    count: dict[str, int] = {}
    parked: list[tuple[int, list[str]]] = []  # places of inline furniture in the stack, and the text before it in its block
    unclosed: set[str] = set()
    mains = 0
    at, n = 0, len(page)

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, bool(stack) and stack[-1][1], stack[-1][2] if stack else 0))

    def leave(i):
        flush()
        for name, _, _ in stack[i:]:
            count[name] -= 1
        del stack[i:]

    def close(i):
        while parked and parked[-1][0] >= i:
            inner, text = parked.pop()
            leave(inner)
            held.extend(text)
        if i < len(stack):
            leave(i)

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            held.append(page[at:])
            break
        if begin > at:
            held.append(page[at:begin])
        m = _PLAIN_TAG.match(page, begin)
        attrs: dict[str, str] = {}
        if m:
            ends, name, single, at = m[1], m[2].lower(), bool(m[3]), m.end()
        else:
            m = _TAG_NAME.match(page, begin)
            if not m:
                if page.startswith("<!--", begin):
                    stop = page.find("-->", begin + 4)
                    at = n if stop < 0 else stop + 3
                elif page[begin + 1 : begin + 2] in ("!", "?", "/"):
                    stop = page.find(">", begin)
                    at = n if stop < 0 else stop + 1
                else:
                    held.append("<")
                    at = begin + 1
                continue
            ends, name = m[1], m[2].lower()
            attrs, at = _attributes(page, m.end(), unclosed)
            if at < 0:  # the page ends within a tag
                break
            single = page[at - 2] == "/"
        if ends:
            if not count.get(name):
                if name not in INLINE:
                    flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n
            if name != "title":
                held.append(" ")
            continue
        if name in VOID:
            if name == "br":
                held.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in PARAGRAPH_ENDS and count.get("p"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        above = stack[-1][1] if stack else False
        if name in INLINE:  # an inline element matters only where it is furniture itself
            if not above and not (attrs and _kind(name, attrs, bool(stack) and stack[-1][2] > 0)[0]):
                continue
            if not above:  # the text around it goes on after it
                parked.append((len(stack), held.copy()))
                held.clear()
        else:
            flush()
        if name == "body":
            keep = [s for s in stack if s[0] == "html"]  # also after a head that was never closed
            close(0)
            for s in keep:
                stack.append(s)
                count[s[0]] += 1
        above, inside = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        own, main = (True, False) if above else _kind(name, attrs, inside > 0)
        if single and name not in INLINE:
            continue
        if main and not inside:
            mains += 1
            inside = mains
        stack.append((name, own, inside))
        count[name] = count.get(name, 0) + 1
    close(0)
    flush()
    size = [0] * (mains + 1)
    for text, furniture, main in out:
        if not furniture:
            size[main] += len(text)
    article = max(range(1, mains + 1), key=lambda i: size[i], default=0)
    return [(text, FURNITURE if furniture else ARTICLE if main and main == article else OPEN) for text, furniture, main in out]


def main_blocks(found: list[tuple[str, int]], shared: set[int]) -> list[str]:
    """The page's main text, given its blocks and the positions that differencing deletes.

    An article that has most of the text which is no furniture stands for the page; else open blocks are text too.
    """
    size = [0, 0, 0]
    for text, kind in found:
        size[kind] += len(text)
    fits = (ARTICLE,) if size[ARTICLE] and size[ARTICLE] >= size[OPEN] else (OPEN, ARTICLE)
    mine = [i for i, (_, kind) in enumerate(found) if kind in fits]
    return [found[i][0] for i in mine if i not in shared] or [found[i][0] for i in mine]


def place(url: str | None) -> tuple[str, str] | None:
    """(host, path) of a URL; None without a host."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return None
    return (host, u.path.rstrip("/") or "/") if host else None


def common(a: list[int], b: list[int]) -> set[int]:
    """Positions of a in a longest common subsequence with b (Hunt and Szymanski)."""
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (id_col, url_col, text).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds in
    page order.  A null or empty page, or one without main text, gives the empty text.  A page without a host in its URL
    has no neighbours; a page whose every block is shared with neighbours keeps them.  Repeated rows are one page and get
    equal results.  Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = dict(rows.dtypes)["id"]
    rows = rows.withColumn("key", F.xxhash64("id", "url", "html"))

    def survey(batch: pa.RecordBatch) -> dict:
        """What pairing needs: the place, and of every block its hash and what markup says."""
        kinds, marks, host, path = [], [], [], []
        for page, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist()):
            found = blocks(page)
            kinds.append(bytes(k for _, k in found))
            marks.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _ in found])
            at = place(url)
            host.append(at and at[0])
            path.append(at and at[1])
        return {"key": batch.column("key"), "kinds": kinds, "marks": marks, "host": host, "path": path}

    found = Table(map_batches(rows.select("key", "url", "html"), "html", survey, "key long, kinds binary, marks array<long>, host string, path string"), "blocks").df
    parsed = found.where("host is not null").withColumn("page", F.xxhash64("host", "marks", "kinds"))

    # Ranks in order of host and path, without gathering a host: range partitions, counted.
    light = parsed.groupBy("host", "page").agg(F.min("path").alias("path")).select("host", "path", "page")
    light = light.repartitionByRange("host", "path", "page").sortWithinPartitions("host", "path", "page")

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(at, at + batch.num_rows), pa.int64())], names=[*batch.schema.names, "part", "nth"])
            at += batch.num_rows

    numbered = Table(light.mapInArrow(number, "host string, path string, page long, part int, nth long"), "ranks").df
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    base, total = {}, 0
    for part in sorted(sizes):
        base[part] = total
        total += sizes[part]
    offsets = pages.sparkSession.createDataFrame(sorted(base.items()), "part int, base long")
    ranked = numbered.join(F.broadcast(offsets), "part").select("host", "page", (F.col("base") + F.col("nth")).alias("rank"))
    want = ranked.select("host", "page", F.explode(F.array(*[F.col("rank") + d for d in (-2, -1, 1, 2)])).alias("rank"))
    pairs = want.join(ranked.select("host", "rank", F.col("page").alias("near")), ["host", "rank"]).select("page", "near")
    marks = parsed.select("page", "marks", "kinds").dropDuplicates(["page"])
    joined = pairs.join(marks.select(F.col("page").alias("near"), F.col("marks").alias("theirs")), "near").join(marks.withColumnRenamed("marks", "own"), "page")

    def align(batches):
        """Positions of a page that a neighbour shares, but for furniture, and whether they tell of a template by themselves (``other``)."""
        for batch in batches:
            page, pos, other, inner = [], [], [], []
            for key, own, theirs, kinds in zip(*(batch.column(c).to_pylist() for c in ("page", "own", "theirs", "kinds"))):
                shared = sorted(common(own, theirs))
                copy = len(shared) >= len(own) * COPY
                mine = [i for i in shared if kinds[i] != FURNITURE]
                same = sum(kinds[i] == ARTICLE for i in mine) >= kinds.count(bytes([ARTICLE])) * SAME_ARTICLE
                for i in mine:
                    if kinds[i] == OPEN or not same:
                        page.append(key)
                        pos.append(i)
                        other.append(not copy)
                        inner.append(kinds[i] == ARTICLE)
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(pos, pa.int32()), pa.array(other, pa.bool_()), pa.array(inner, pa.bool_())], names=["page", "pos", "other", "inner"])

    aligned = joined.select("page", "own", "theirs", "kinds").mapInArrow(align, "page long, pos int, other boolean, inner boolean")
    template = aligned.groupBy("page", "pos", "inner").agg(F.bool_or("other").alias("other"), F.count("*").alias("m")).where(F.when(F.col("inner"), F.col("m") >= ARTICLE_VOTES).otherwise(F.col("other") | (F.col("m") > 1)))
    gone = Table(template.groupBy("page").agg(F.collect_list("pos").alias("shared")), "template").df
    few = gone.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
    drop = Table(parsed.select("key", "page").distinct().join(F.broadcast(gone) if few else gone, "page").select("key", "shared"), "shared").df
    few = drop.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
    out = rows.join(F.broadcast(drop) if few else drop, "key", "left").select("id", "url", "html", "shared")

    def extract(batch: pa.RecordBatch) -> dict:
        text = ["\n".join(main_blocks(blocks(page), set(shared or ()))) for page, shared in zip(batch.column("html").to_pylist(), batch.column("shared").to_pylist())]
        return {"id": batch.column("id"), "url": batch.column("url"), "text": text}

    return map_batches(out, "html", extract, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
