"""HTML main-text extraction with a host suffix array.

A page is cut into blocks of text of four kinds: plain; MAIN, inside an article or main element; FURNITURE, inside elements that mark
menus, headers, footers, sidebars, notices, adverts, forms or comments; DOUBTFUL, inside an article but under a mark that may as well
name a part of its text.
 1. What repeats goes first, marked or not: a run of at least MIN_REPEAT tokens that stands on several pages of a host, outside
    MAIN blocks, is boilerplate. A run over several blocks takes whole blocks only.
 2. The marks decide on what is left: unique FURNITURE goes, unique DOUBTFUL and plain text stays.
 3. MAIN text stays even where other pages repeat it, and so isn't looked for; a run doesn't reach over it.

Runs are found over all pages of a host, however many. Pages are taken in groups as they are read. The streams of a group's
pages are concatenated and their suffixes sorted by prefix doubling to MIN_REPEAT tokens, a host having an alphabet of its own.
Each distinct prefix is sent once a group, as a 64-bit hash of host and tokens with the least and greatest id of the pages that
hold it; prefixes of several pages, in one group or different ones, come back to the groups. How pages fall into groups, by
GROUP_PAGES, GROUP_CHARS and the input's partitions, changes the work but no result.

Defined cases: null or empty html gives an empty text; a null url has an empty host; rows of one page_id are one page, so copies of
a row don't repeat each other, and rows with a null id are one page as well; unclosed elements end with their parent, an unclosed comment
or script with the page; a tag cut off by the end of the page goes; quotes that never close are plain characters; character references
beyond Unicode give U+FFFD; parsing takes time in proportion to the page, broken markup included; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import small_batches, spread
from keystrata.llm.text_hash import give_back, run_hashes

MIN_REPEAT = 8
GROUP_PAGES, GROUP_CHARS = 256, 4 << 20
PLAIN, MAIN, FURNITURE, DOUBTFUL = range(4)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag's end, or the start of a quoted value.
STOP = re.compile(r">|=\s*([\"'])")
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
LONG_REFERENCE = re.compile(r"&#(?:0*([1-9][0-9]{7,})|[xX]0*([1-9a-fA-F][0-9a-fA-F]{6,})|(0{8,}[0-9]{0,7}));?")
#: Elements whose text is no part of the page's.
RAW = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)[^>]*>?|\Z", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "dl", "dt", "dd", "figure", "figcaption", "hr", "address", "details", "summary", "nav", "header", "footer", "aside", "form", "fieldset", "body", "html", "center", "hgroup"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose content is never text of the page: it goes without being compared.
HIDDEN = {"head", "button", "select", "svg", "object", "canvas", "audio", "video"}
#: Elements that mark furniture.
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Whole words in class or id that mark furniture wherever they stand.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "masthead", "topbar",
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login",
    "comment", "comments", "respond", "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "toolbar",
}
#: Words that mark furniture outside an article and leave it in doubt inside one.
DOUBTS = {
    "banner", "menu", "aside", "footer", "notice", "notification", "alert", "overlay", "subscription", "widget", "widgets", "search", "form", "copyright", "legal",
    "disclaimer", "skip",
}
#: An id of rows without one.
NO_ID = -0x5D1F3A7C9B24E680


#: g can't be null, so that no reader filters it below the exchange.
GROUP = T.StructType([T.StructField("g", T.LongType(), False), T.StructField("data", T.BinaryType()), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("pages", T.ArrayType(T.LongType()))])


class _Element:
    __slots__ = ("head", "kind", "main", "name")

    def __init__(self, name: str, kind: int | None, main: bool, head: bool):
        self.name, self.kind, self.main, self.head = name, kind, main, head


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): _unescape(v.strip("\"'")) for k, v in ATTR.findall(text)}


def _unescape(s: str) -> str:
    if "&" not in s:
        return s
    if "&#" in s:  # html.unescape refuses numbers of thousands of digits
        s = LONG_REFERENCE.sub(lambda m: "�" if m[3] is None else f"&#{int(m[3])};", s)
    return html.unescape(s)


def _open(name: str, attrs: str, parent: _Element) -> _Element:
    """kind: None for hidden content, else that of the text; what is hidden or furniture stays so inside."""
    kind, main, head = parent.kind, parent.main, parent.head
    if name in HIDDEN:
        kind = None
    main |= name in ("article", "main")
    if name in FURNITURE_TAGS and kind is not None:
        kind = FURNITURE
    marked_header = name == "header"
    if attrs and not attrs.isspace():
        a = _attributes(attrs)
        words = set(re.split(r"[^a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
        role = a.get("role", "").lower()
        if name not in ("html", "body", "article", "main"):
            if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
                kind = None
            elif kind in (PLAIN, DOUBTFUL):
                if words & MARKS or role in ROLES:
                    kind = FURNITURE
                elif words & DOUBTS:
                    kind = DOUBTFUL if main else FURNITURE
            marked_header |= "header" in words
        elif name == "article" and kind is not None and words & {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo", "related"}:
            kind = FURNITURE
        main |= role in ("main", "article") or a.get("itemprop", "") == "articleBody"
    # A header's own content goes, but an article keeps the headings that stand in its header.
    return _Element(name, kind, main, head or marked_header)


class _Tags:
    """Ends of tags in one page, in time linear in the page: quotes count until one scan for a tag's end has failed."""

    def __init__(self, page: str):
        self.page, self.careful, self.gone = page, True, set()

    def find(self, what: str, at: int) -> int:
        """page.find, asked for no more once it is known to stand nowhere behind."""
        got = -1 if what in self.gone else self.page.find(what, at)
        if got < 0:
            self.gone.add(what)
        return got

    def end(self, at: int) -> int:
        """Index of the ">" that ends the tag whose name ends at `at`; -1 if none does."""
        pos = at
        while self.careful:
            m = STOP.search(self.page, pos)
            if m is None:
                self.careful = False
            elif m[1] is None:
                return m.start()
            else:
                close = self.find(m[1], m.end())
                if close < 0:
                    self.careful = False
                pos = close + 1
        return self.find(">", at)


def all_blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of every block of a page, hidden content left out."""
    out: list[tuple[str, int]] = []
    stack = [_Element("", PLAIN, False, False)]
    last_block = [0]  # places of block elements in the stack
    where: dict[str, list[int]] = {}  # places of elements by name
    text: list[list[str]] = [[], [], [], []]
    heading = 0

    def flush() -> None:
        for kind, parts in enumerate(text):
            if parts:
                words = " ".join("".join(parts).split())
                parts.clear()
                if words:
                    out.append((words, kind))

    def say(s: str) -> None:
        top = stack[-1]
        kind = top.kind
        if kind is None:
            return
        if kind != FURNITURE and top.head and not (heading and top.main):
            kind = FURNITURE
        elif kind == PLAIN and top.main:
            kind = MAIN
        text[kind].append(_unescape(s))

    def close(to: int) -> None:
        nonlocal heading
        while len(stack) > to:
            e = stack.pop()
            where[e.name].pop()
            heading -= e.name in HEADINGS
            if last_block[-1] == len(stack):
                last_block.pop()

    tags, at, n = _Tags(page), 0, len(page)
    while (lt := tags.find("<", at)) >= 0:
        if lt > at:
            say(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after == "!":
            if page.startswith("<!--", lt):
                k = tags.find("-->", lt + 2)
                at = n if k < 0 else k + 3
                continue
            if page.startswith("<![CDATA[", lt) and (k := tags.find("]]>", lt + 9)) >= 0:
                say(page[lt + 9 : k])
                at = k + 3
                continue
        if after in ("!", "?"):
            k = tags.find(">", lt)
            at = n if k < 0 else k + 1
            continue
        ends = after == "/"
        m = NAME.match(page, lt + 1 + ends)
        if m is None:
            if ends and lt + 2 < n:
                k = tags.find(">", lt)
                at = n if k < 0 else k + 1
            else:
                say("<")
                at = lt + 1
            continue
        end = tags.end(m.end())
        if end < 0:
            at = n  # cut off by the end of the page
            break
        name, attrs, at = m[0].lower(), page[m.end() : end], end + 1
        if ends:
            if name in BLOCK:
                flush()
            own = where.get(name)
            # a stray end of an inline element doesn't end a block
            if own and (name in BLOCK or own[-1] > last_block[-1]):
                close(own[-1])
            continue
        if name in RAW:
            at = RAW[name].search(page, at).end()
            continue
        if name in BLOCK:
            flush()
            own = {"p"} if name not in ("li", "td", "th", "tr", "dt", "dd") else {"p", name} | ({"td", "th"} if name in ("td", "th", "tr") else set()) | ({"dt", "dd"} if name in ("dt", "dd") else set())
            if stack[last_block[-1]].name in own:  # what this element ends without an end tag
                close(last_block[-1])
        elif name == "br":
            say(" ")
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        heading += name in HEADINGS
        where.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            last_block.append(len(stack))
        stack.append(_open(name, attrs, stack[-1]))
    if at < n:
        say(page[at:])
    flush()
    return out


def blocks_of(page: str) -> list[tuple[str, bool]]:
    """(text, stands in an article or main element) of every block that isn't marked as furniture."""
    return [(x, kind != PLAIN) for x, kind in all_blocks(page) if kind != FURNITURE]


def _prefix_ranks(tokens: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the concatenated pages, as far as suffixes have `least` tokens in their page: starts in the order of their
    first `least` tokens, the number of each one's prefix among the distinct ones, and the least and greatest page of each prefix.

    Prefix doubling: after each round, rank orders the suffixes by their first `size` tokens."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    size = 1
    while size < least:
        step = min(size, least - size)  # the last round overlaps, so that size ends at least exactly
        after = np.zeros(n, np.uint64)
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * np.uint64(n + 2) + after, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        size += step
    whole = np.zeros(n, bool)
    if n >= least:
        whole[: n - least + 1] = page[: n - least + 1] == page[least - 1 :]  # runs end with their page
    at = np.flatnonzero(whole)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none
    order = at[np.lexsort((page[at], rank[at]))]
    group = np.concatenate([[0], np.cumsum(rank[order][1:] != rank[order][:-1])])
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(first[1:], len(order)) - 1
    return order, group, page[order[first]], page[order[last]]


def repeated(tokens: np.ndarray, page: np.ndarray, least: int = MIN_REPEAT) -> np.ndarray:
    """Starts of the runs of `least` tokens that another page has too."""
    order, group, low, high = _prefix_ranks(tokens, page, least)
    return order[(low != high)[group]] if len(order) else order


def covered(starts: np.ndarray, n: int, least: int = MIN_REPEAT) -> np.ndarray:
    """Which of n tokens stand in a run that begins at one of starts."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + least, -1)
    return np.cumsum(cover[:n]) > 0


class _Stream:
    """The tokens of several pages outside MAIN blocks, one behind the other; page text between MAIN blocks is a stretch."""

    def __init__(self, pages: list[list[tuple[str, int]]], ids: list, hosts: list[str]):
        words: dict[tuple[str, str], int] = {}
        number = {k: i for i, k in enumerate(dict.fromkeys(ids))}  # copies of a row are one page
        self.ids, self.hosts = list(number), hosts
        token, page, stretch, block = [], [], [], []
        self.stretches: list[tuple[int, list[str]]] = []  # (page's place, its blocks)
        b = 0
        for i, blocks in enumerate(pages):
            fresh = True
            for x, kind in blocks:
                if kind == MAIN:
                    fresh = True
                    b += 1
                    continue
                if fresh:
                    self.stretches.append((i, []))
                    fresh = False
                self.stretches[-1][1].append(x)
                t = [words.setdefault((hosts[i], w), len(words)) for w in x.split(" ")]
                token += t
                page += [number[ids[i]]] * len(t)
                stretch += [len(self.stretches)] * len(t)
                block += [b] * len(t)
                b += 1
        self.token, self.page, self.stretch, self.block = (np.array(v, np.int64) for v in (token, page, stretch, block))

    def __len__(self) -> int:
        return len(self.token)

    def runs(self) -> np.ndarray:
        """The hash of host and run for each token that a run starts at, 0 for the others."""
        out, at = np.zeros(len(self), np.uint64), 0
        seeds: dict[str, np.uint64] = {}
        for i, blocks in self.stretches:
            host = self.hosts[i]
            if host not in seeds:
                seeds[host] = np.uint64(int.from_bytes(blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
            text = " ".join(blocks)
            h = run_hashes(text.encode("utf-8", "surrogatepass"), MIN_REPEAT, seeds[host])
            out[at : at + len(h)] = h
            at += text.count(" ") + 1
        return out

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, page id) of the distinct runs, with the least and the greatest number of a page that holds each."""
        # A stretch is part of one page; runs don't reach from one to the next.
        order, group, _, _ = _prefix_ranks(self.token, self.stretch, MIN_REPEAT)
        if not len(order):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.lexsort((self.page[order], group))
        order, group = order[at], group[at]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        last = np.append(first[1:], len(order)) - 1
        low, high = order[first], order[last]
        h = self.runs().view(np.int64)
        both = np.concatenate([low, high[self.page[low] != self.page[high]]])
        ids = np.array([NO_ID if k is None else k for k in self.ids], np.int64)
        return h[both], ids[self.page[both]]

    def starts(self, common_runs: np.ndarray) -> np.ndarray:
        """Starts of the runs whose hashes are among common_runs."""
        if not len(common_runs):
            return np.empty(0, np.int64)
        return np.flatnonzero(np.isin(self.runs().view(np.int64), common_runs) & self._whole())

    def _whole(self) -> np.ndarray:
        whole = np.zeros(len(self), bool)
        if len(self) >= MIN_REPEAT:
            whole[: len(self) - MIN_REPEAT + 1] = self.stretch[: len(self) - MIN_REPEAT + 1] == self.stretch[MIN_REPEAT - 1 :]
        return whole

    def own_repeats(self) -> np.ndarray:
        """Starts of the runs that several of the stream's pages hold."""
        h, ids = self.prefixes()
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        return self.starts(np.unique(h[1:][(h[1:] == h[:-1]) & (ids[1:] != ids[:-1])]))


def main_texts(pages: list[list[tuple[str, int]]], ids: list, hosts: list[str] | None = None, common_runs: np.ndarray | None = None) -> list[tuple[str, int]]:
    """(main text, tokens in repeated runs) of each of some pages. common_runs: hashes of the repeated runs, by default those that
    several of these pages hold, all of one host unless hosts are given."""
    s = _Stream(pages, ids, hosts or [""] * len(pages))
    starts = s.own_repeats() if common_runs is None else s.starts(common_runs)
    mask = covered(starts, len(s))
    inside = covered(starts[s.block[starts] == s.block[starts + MIN_REPEAT - 1]], len(s)) if len(starts) else mask
    out, at = [], 0
    for blocks in pages:
        kept, common = [], 0
        for block, kind in blocks:
            if kind == MAIN:
                kept.append(block)
                continue
            w = block.split(" ")
            hit, own = mask[at : at + len(w)], inside[at : at + len(w)]
            at += len(w)
            common += int(hit.sum())
            if kind == FURNITURE:
                continue
            if not hit.any():
                kept.append(block)
            elif not hit.all():  # a run over several blocks takes whole blocks only
                kept.append(" ".join(x for x, h in zip(w, own, strict=True) if not h))
        out.append(("\n\n".join(kept), common))
    return out


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", partitions: int | None = None) -> DataFrame:
    """(key, url, text, n_chars, n_repeated) of every page; n_repeated: its tokens in repeated runs. partitions: of the way back to the groups."""
    small_batches(df.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    d = spread(df.select(F.col(key).cast("long").cast("string").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"), host.alias("host")))

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a group: its pages' blocks, and its runs with their pages' ids."""
        held: list[tuple] = []
        chars = 0
        pack = zstandard.ZstdCompressor(level=3)

        def done() -> pd.DataFrame:
            data = pack.compress(json.dumps(held).encode())
            g = int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)
            runs, pages = _Stream([x[3] for x in held], [x[0] for x in held], [x[2] for x in held]).prefixes()
            held.clear()
            return pd.DataFrame({"g": [g], "data": [data], "runs": [runs], "pages": [pages]})

        for b in batches:
            for k, u, x, h in zip(b["page_id"], b["url"], b["html"], b["host"], strict=True):
                held.append((None if pd.isna(k) else int(k), u, h, all_blocks(x or "")))
                chars += len(x or "")
                if len(held) >= GROUP_PAGES or chars >= GROUP_CHARS:
                    yield done()
                    chars = 0
        if held:
            yield done()
        give_back()

    # One exchange by group serves the way out and the joining back, and one exchange by run the search for repeated ones and the way
    # back. Their readers use all columns, else they would be pruned and the exchanges differ. A group has two rows a run at most.
    groups = d.mapInPandas(grouped, GROUP).repartition("g")
    sent = groups.select("g", F.explode_outer(F.when(F.octet_length("data") > 0, F.arrays_zip("runs", "pages"))).alias("x")).select("g", F.col("x.runs").alias("run"), F.col("x.pages").alias("p")).where("run is not null").repartition("run")
    several = sent.groupBy("run").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo != hi").select("run")
    back = sent.join(several, "run").groupBy("g").agg(F.collect_set("run").alias("common"))
    if partitions:
        back = back.repartition(partitions, "g")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for data, runs in zip(b["data"], b["common"], strict=True):
                held = json.loads(unpack.decompress(data))
                common = np.empty(0, np.int64) if runs is None else np.asarray(runs, np.int64)
                texts = main_texts([x[3] for x in held], [x[0] for x in held], [x[2] for x in held], common)
                yield pd.DataFrame({"page_id": pd.array([x[0] for x in held], "Int64"), "url": [x[1] for x in held], "text": [t for t, _ in texts], "n_chars": [len(t) for t, _ in texts], "n_repeated": [c for _, c in texts]})
        give_back()

    out = groups.join(back, "g", "left").select("data", "runs", "pages", "common").mapInPandas(finish, "page_id long, url string, text string, n_chars long, n_repeated long")
    return out.withColumnRenamed("page_id", key).withColumnRenamed("url", url) if (key, url) != ("page_id", "url") else out
