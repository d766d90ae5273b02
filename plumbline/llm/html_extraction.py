"""Main text of web pages: markup first, then a suffix array over each host.

Where the markup says what is what, it decides: text in an article (or else in
a main element, or in a container whose name says content) is the page's text,
an article being no more than a card where main or such a container holds more,
and menus, headers, footers, sidebars, notices, adverts, forms, comments and
the like are not. Repetition must not overrule it: articles of a host may
share a passage, and an advert may be seen once.

Pages without such a container keep the blocks that markup does not rule out,
less what their host repeats. Token streams of a host's pages are put together
(in chunks of :data:`CHUNK_PAGES` pages, so that a host with a third of all
pages is many tasks), a suffix array brings equal stretches side by side, and
a run of :data:`RUN` tokens or a whole shorter block that another page has too
is boilerplate. Chunks of one host exchange the hashes of their runs, so that a
stretch counts wherever in the host it is repeated. The runs left over are the
text. A page of which nothing is left is a copy of others and keeps its blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _kernels as K
from plumbline.llm._tables import written

#: Tokens of a repeated run, and pages of a host put together in one task.
RUN, CHUNK_PAGES = 6, 512

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {x: re.compile(rf"</{x}\b[^>]*(?:>|\Z)", re.I) for x in ("script", "style", "title", "textarea", "xmp", "noembed", "noframes")}
_WORD = re.compile(r"[a-z]+|[0-9]+")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = set("head script style title noscript template iframe svg math object embed canvas audio video map datalist select option optgroup button textarea input fieldset form nav footer aside dialog menu menuitem".split())
#: Elements that a start tag of the same group closes.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "main", "div", "section"}
#: Words in class, id and role that name what is not the article.
_AWAY = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr "
    "notice notices notification alert alerts disclaimer popup modal overlay lightbox interstitial newsletter subscribe subscription signup login signin register paywall "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars rail widget widgets footer foot colophon masthead topbar toolbar header "
    "comment comments commentlist disqus reply replies respond discussion guestbook share sharing sharebar social follow related recommended recommendations "
    "pagination pager search searchbox form toc skip copyright legal hidden invisible offscreen complementary contentinfo dialog".split()
)
_READERS = set("comment comments commentlist disqus reply replies respond discussion guestbook".split())
#: Of them, those whose articles are teasers of other pages.
_TEASERS = set("related recommended recommendations promo promos promotion promoted sponsor sponsored sponsors".split())
#: Of them, those that an article's own heading may bear.
_HEADING = {"header", "masthead", "banner"}
_CONTENT = set("article articlebody content contents main mainbody post posting entry story storybody body bodytext text".split())
_ROLES_AWAY = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

ARTICLE, MAIN, NAMED, PLAIN, TEASER, CARD, AWAY = 6, 5, 4, 3, 2, 1, 0


@dataclass
class _Open:
    name: str
    away: bool
    firm: bool  # no article inside can make up for it
    level: int
    teasers: bool = False  # inside a container that names other pages
    teaser: bool = False  # inside an article or main of such a container


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}


def _words(*values: str) -> set[str]:
    out: set[str] = set()
    for v in values:
        out |= set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()))
    return out


def _opened(name: str, attributes: str, parent: _Open) -> _Open:
    now = _marked(name, attributes, parent)
    now.teasers |= parent.teasers
    now.teaser = parent.teasers and (parent.teaser or name in ("article", "main")) and not now.firm
    return now


def _marked(name: str, attributes: str, parent: _Open) -> _Open:
    level, away, firm = parent.level, parent.away, parent.firm
    if name in _NEVER:
        return _Open(name, True, firm or name != "form", level)
    if name == "header" and level < MAIN:
        away = True
    if name in ("article", "main") and not parent.teasers:
        if away and not firm:
            away = False
        level = max(level, ARTICLE if name == "article" else MAIN)
    if "=" in attributes or "hidden" in attributes:
        a = _names(attributes)
        role = a.get("role", "").lower()
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
            return _Open(name, True, True, level)
        if role in _ROLES_AWAY and not (level >= MAIN and role == "banner"):
            return _Open(name, True, True, level)
        if role in ("main", "article"):
            level = max(level, ARTICLE if role == "article" else MAIN)
        if "articlebody" in a.get("itemprop", "").lower():
            level = max(level, ARTICLE)
        if name not in ("html", "body", "main") and ("class" in a or "id" in a):
            w = _words(a.get("class", ""), a.get("id", ""))
            against, good = w & _AWAY, w & _CONTENT
            if level >= NAMED or good or name == "article":
                against -= _HEADING
            if name == "article":
                against &= _READERS
            if against:
                away = True
                firm = firm or bool(against & _READERS)
            elif good and name in ("div", "section", "td", "article"):
                level = max(level, NAMED)
            return _Open(name, away, firm, level, bool(against & _TEASERS))
    return _Open(name, away, firm, level)


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(level, text) of the page's blocks in order; white space is one space."""
    stack = [_Open("", False, False, PLAIN)]
    opened: Counter[str] = Counter()  # names on the stack, so that an end tag without a start is no search
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    state, teasers = PLAIN, 0

    def close_from(k: int) -> None:
        for x in stack[k:]:
            opened[x.name] -= 1
        del stack[k:]

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((state, text))
        parts.clear()

    def say(text: str) -> None:
        nonlocal state
        if not text:
            return
        top = stack[-1]
        now = top.level if not top.away else TEASER if top.teaser else AWAY
        if now != state:
            close_block()
            state = now
        parts.append(text)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                say(page[m.start() + 9 : m.end()].removesuffix("]]>"))
            continue
        closing = (m[1] or m[4]) == "/"
        if name not in _INLINE:
            parts.append(" ")
            close_block()
        if closing:
            if opened[name]:
                close_from(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        attributes = m[3] or m[6] or ""
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in _VOID:
            continue
        if name not in _INLINE and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close_from(k)
                    break
                if stack[k].name not in _INLINE:
                    break
        if (group := _SIBLINGS.get(name)) and any(opened[x] for x in group):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in group:
                    close_from(k)
                    break
                if stack[k].name in _SCOPE:
                    break
        if not attributes.endswith("/") or name in ("div", "p", "span", "article", "section"):
            outer = stack[-1]
            stack.append(_opened(name, attributes, outer))
            opened[name] += 1
            teasers += stack[-1].teaser and not outer.teaser
    close_block()
    # Several articles in such containers are cards of a list.
    return [(CARD if level == TEASER and teasers > 1 else level, t) for level, t in out]


def decided(blocks: list[tuple[int, str]]) -> str | None:
    """The text that the markup decides on, None if it does not. An article
    stands back where main or a named container holds more text outside it,
    and teasers count only where the page has nothing else, or a single one
    holds more than all text outside containers."""
    top = max((level for level, _ in blocks), default=AWAY)
    if top == PLAIN:
        if sum(len(t) if x == TEASER else -len(t) for x, t in blocks if x in (TEASER, PLAIN)) <= 0:
            return None
        top = TEASER
    if top == ARTICLE:
        held = {level: sum(len(t) for x, t in blocks if x == level) for level in (NAMED, MAIN, ARTICLE)}
        top = max(held, key=lambda level: (held[level], level))
    return " ".join(t for level, t in blocks if level == top) if top > AWAY else ""


# ------------------------------------------------------ repeats within a host


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Places of all suffixes in their order, by prefix doubling."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < n:
        second = np.full(n, -1)
        second[:-step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


def repeated_windows(streams: list[np.ndarray], pages: list[int], run: int) -> list[np.ndarray]:
    """For each block's token stream, which of its windows of ``run`` tokens
    (or the one of a shorter block) another page has as well."""
    flags = [np.zeros(max(1, len(s) - run + 1), bool) for s in streams]
    size = [len(s) for s in streams]
    if sum(size) == 0:
        return flags
    # Each block ends in its own sign, so that no stretch runs over an end.
    _, ids = np.unique(np.concatenate(streams), return_inverse=True)
    text, page, block, place, at = [], [], [], [], 0
    for k, n in enumerate(size):
        text.append(np.append(ids[at : at + n], len(ids) + k))
        at += n
        page.append(np.full(n + 1, pages[k]))
        block.append(np.full(n + 1, k))
        place.append(np.arange(n + 1))
    text, page, block, place = map(np.concatenate, (text, page, block, place))
    order = suffix_array(text)
    ends = np.concatenate([text, np.arange(run) - run])  # past the end nothing is equal
    low, high = order[:-1], order[1:]
    alike = np.ones(len(low), bool)
    for i in range(run):
        alike &= ends[low + i] == ends[high + i]
    # Neighbours alike in their first ``run`` tokens form a stretch of the array.
    group = np.concatenate([[0], np.cumsum(~alike)])
    first = pd.Series(page[order]).groupby(group)
    shared = (first.transform("min") != first.transform("max")).to_numpy()
    for s in order[shared]:
        flags[block[s]][place[s]] = True
    # Blocks shorter than a run are compared as wholes.
    whole: dict[bytes, list[int]] = {}
    for k, n in enumerate(size):
        if 0 < n < run:
            whole.setdefault(streams[k].tobytes(), []).append(k)
    for own in whole.values():
        if len({pages[k] for k in own}) > 1:
            for k in own:
                flags[k][0] = True
    return flags


def unique_runs(words: list[str], windows: np.ndarray, run: int) -> str:
    """The words that no repeated window covers."""
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) < run:
        return "" if windows[0] else " ".join(words)
    np.add.at(covered, np.flatnonzero(windows), 1)
    np.add.at(covered, np.flatnonzero(windows) + run, -1)
    return " ".join(w for w, c in zip(words, np.cumsum(covered)[:-1]) if not c)


def _streams(block: list[str]) -> tuple[list[list[str]], list[np.ndarray]]:
    words = [b.split(" ") for b in block]
    flat = [w.encode() for ws in words for w in ws]
    raw = np.frombuffer(b"".join(flat), np.uint8)
    ends = np.cumsum([len(w) for w in flat])
    h = K.span_hashes(raw, ends - [len(w) for w in flat], ends).view(np.int64)
    cut = np.cumsum([len(ws) for ws in words])
    return words, np.split(h, cut[:-1])


def extract(pages: DataFrame, run: int = RUN, chunk_pages: int = CHUNK_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each row of ``pages``.

    Defined cases: null or empty html gives an empty text; a page without url
    has the host ""; repeated rows are one page to its host, and each is
    returned; a page cut off in a tag loses that tag; other columns are not read.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks_of(h) if h else [] for h in batch["html"]]
            texts = [decided(b) for b in found]
            plain = [None if t is not None else [x for level, x in b if level == PLAIN] for b, t in zip(found, texts)]
            yield batch[["id", "url", "page"]].assign(text=texts, plain=plain)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("id", "url", "html"))
    parsed = written(rows.mapInPandas(parse, "id long, url string, page long, text string, plain array<string>"), "parsed-pages")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    open_pages = parsed.filter("text is null").withColumn("host", F.regexp_replace(host, r"^www\.", ""))
    streams = open_pages.select("host", "page", "plain").dropDuplicates(["host", "page"])
    chunks = streams.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / chunk_pages).alias("chunks"))
    dealt = streams.join(chunks, "host").withColumn("chunk", F.pmod(F.xxhash64("page"), F.col("chunks")))

    def within_chunk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tokens, owner = [], []
        for k, block in enumerate(group["plain"]):
            own = _streams(list(block))[1]
            tokens += own
            owner += [k] * len(own)
        flags = repeated_windows(tokens, owner, run)
        hashes: list[list[int]] = [[] for _ in range(len(group))]
        for k, s, f in zip(owner, tokens, flags):
            windows = K.shingles(s.view(np.uint64), run).view(np.int64)
            hashes[k] += windows[f].tolist()
        return pd.DataFrame({"host": key[0], "page": group["page"], "repeated": [sorted(set(h)) for h in hashes]})

    def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for host, page, chunk, block in zip(batch["host"], batch["page"], batch["chunk"], batch["plain"]):
                own = [K.shingles(s.view(np.uint64), run).view(np.int64) for s in _streams(list(block))[1]]
                yield pd.DataFrame({"host": host, "page": page, "chunk": chunk, "window": np.unique(np.concatenate(own))})

    inside = dealt.groupBy("host", "chunk").applyInPandas(within_chunk, "host string, page long, repeated array<long>")
    # Hosts of several chunks: windows that two chunks have.
    spread = dealt.filter("chunks > 1").mapInPandas(windows_of, "host string, page long, chunk long, window long")
    common = spread.groupBy("host", "window").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).filter("low <> high").select("host", "window")
    across = spread.join(common, ["host", "window"]).groupBy("host", "page").agg(F.collect_set("window").alias("across"))
    repeats = inside.join(across, ["host", "page"], "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for block, near, far in zip(batch["plain"], batch["repeated"], batch["across"]):
                known = np.array(sorted({*(near if near is not None else ()), *(far if far is not None else ())}), np.int64)
                left = []
                for words, s in zip(*_streams(list(block))):
                    flag = np.isin(K.shingles(s.view(np.uint64), run).view(np.int64), known)
                    left.append(unique_runs(words, flag, run))
                texts.append(" ".join(x for x in left if x) or " ".join(block))
            yield batch[["id", "url"]].assign(text=texts)

    settled = parsed.filter("text is not null").select("id", "url", "text")
    rest = open_pages.join(repeats, ["host", "page"]).select("id", "url", "plain", "repeated", "across").mapInPandas(finish, "id long, url string, text string")
    return settled.unionByName(rest).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
