"""Main-text extraction by equivalence-class template deduction.

Pages of a host come from a template. Every distinct page of a host (copies count once) is cut into tokens: structural
tags by their container path, and text blocks at their place, inside the article as well. Tokens of a host with the same
occurrence vector over its pages (compared by two 31-bit sums, so vectors are never gathered) form an equivalence class.
A class with enough support, of two or more tokens, is valid if it is ordered and nested. Ordered: its tokens come in
the order of one reference page; a token out of place on more than `slack` of the pages leaves the class. Nested: two
classes don't cross, which is to say that one lies before, behind or within a gap of the other; of two that cross on more
than `slack` of the pages the one with less support is dropped. Both are decided on the first occurrences of the tokens
in a page; the gap may differ between pages. The valid classes are the host's template: its texts are boilerplate, what
lies between them are slots. Extraction keeps the slots of the article, or, in a page without one, all slots outside
menus, forms and the like.

Mark-up supports the template: where it would take more than half of an article's text, the page is one of many near
copies rather than a template filled in, and the article stays whole.

Edge cases: null and empty html give an empty text; null urls share one host; hosts with fewer than three distinct pages have no
template, only mark-up decides; unclosed tags end with their container, a tag that its quotes leave open ends at its first
`>`, and a `<` behind which none comes is text; very long and very deep pages take time and memory in proportion to their
length; repeated rows are extracted each; an empty table gives an empty result; an input column named text is replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, map_texts, persist_shared, texts_of, without

#: How a tag starts, and what may end it or hide its end.
OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
CLOSES = re.compile("[>\"']")
#: A tag whose quotes leave it open for longer than this ends at its first `>`.
LONGEST_TAG = 1 << 16
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|type|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Fixed values of HTML: elements whose content is not mark-up, elements without content, and block elements.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "html body article main section div nav header footer aside form table ul ol dl menu figure fieldset dialog details noscript template button select svg math canvas object audio video head".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ARTICLE = frozenset(("article", "main"))
#: What never holds main text.
SKIPPED = frozenset("head nav aside form footer dialog noscript template button select svg math canvas object audio video menu".split())
UNWANTED = re.compile(
    r"(?:^|[-_\s])(?:ad\d*|ads\w*|advert\w*|alert|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumb\w*|sidebar|side-bar|widget\w*|related|recommend\w*|share|sharing|social|footer|masthead|site-header|page-header|topbar|"
    r"comment|comments|commentlist|disqus|respond|replies|reader-comments|skip-link|toolbar|pagination|pager|search)(?:$|[-_\s])",
    re.I,
)
#: Outside an article the head of the page, named as a whole word.
PAGE_HEAD = re.compile(r"(?:^|\s)(?:header|head|top-?bar|top-?nav)(?:$|\s)", re.I)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote address hr li".split())


def hashed(*parts: int | str) -> int:
    """A 63-bit name."""
    raw = b"\0".join(p.to_bytes(8, "little") if isinstance(p, int) else p.encode(errors="replace") for p in parts)
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 1


class Page:
    """Text blocks of a page: (container path, text, in an article, unwanted), and its tokens in page order.

    A path is the hash of the path above and the container's own name, so deep pages cost no more than flat ones; every
    step of reading goes on in the page, so time grows with its length.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.order: list[tuple[int, str | None]] = [(0, None)]  # container path, text of a block
        self._stack: list[tuple[str, int, bool, bool]] = []  # name, path, in article, unwanted
        self._open_names: Counter = Counter()
        self._held: list[str] = []
        self._gone: set[str] = set()  # quotes that don't occur any more
        self._read(html)

    def _top(self):
        return self._stack[-1] if self._stack else ("", 0, False, False)

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._held)).split())
        self._held.clear()
        if text:
            _, path, article, bad = self._top()
            self.blocks.append((path, text, article, bad))
            self.order.append((path, text))

    def _open(self, name: str, attrs: str) -> None:
        _, path, article, bad = self._top()
        label, hidden = "", False
        if attrs.strip():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attrs)}
            label = f"{found.get('id', '')} {found.get('class', '')}".strip()
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES
        # a header inside the article is the article's own
        own = name in SKIPPED or hidden or (name == "header" and not article)
        if label and name not in ("html", "body"):
            own = own or bool(UNWANTED.search(label)) or (not article and bool(PAGE_HEAD.search(label)))
        path = hashed(path, f"{name}.{label}" if label else name)
        self.order.append((path, None))
        self._stack.append((name, path, article or name in ARTICLE, bad or own))
        self._open_names[name] += 1

    def _close(self, name: str) -> None:
        while self._open_names[name]:
            top = self._stack.pop()[0]
            self._open_names[top] -= 1
            if top == name:
                return

    def _next_tag(self, html: str, at: int):
        """(start, end, closing, name, attributes) of the next tag, comment or declaration from `at` on, whose name is empty
        for the last two; None where none ends any more."""
        m = OPENS.search(html, at)
        if m is None:
            return None
        start, i = m.start(), m.end()
        if html.startswith("<!--", start):
            end = html.find("-->", i)
            return start, len(html) if end < 0 else end + 3, "", "", ""
        first = html.find(">", i)
        if first < 0:
            return None
        end = first
        if m[2]:
            while (c := CLOSES.search(html, i, start + LONGEST_TAG)) is not None and c[0] != ">":
                close = -1 if c[0] in self._gone else html.find(c[0], c.end())
                if close < 0:
                    self._gone.add(c[0])
                i = c.end() if close < 0 else close + 1
            end = c.start() if c is not None else first
        return start, end + 1, m[1] or "", (m[2] or "").lower(), html[m.end() : end] if m[2] else ""

    def _read(self, html: str) -> None:
        at = 0
        while (tag := self._next_tag(html, at)) is not None:
            start, end, closing, name, attrs = tag
            if start > at:
                self._held.append(html[at:start])
            at = end
            if not name or name in INLINE:
                continue
            self._flush()
            if closing:
                if name in CONTAINERS:
                    self._close(name)
            elif name in RAW:
                done = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = done.end() if done else len(html)
            elif name in CONTAINERS and not attrs.rstrip().endswith("/"):
                self._open(name, attrs)
        self._held.append(html[at:])
        self._flush()


def token(path: int, text: str | None = None) -> int:
    """The name of a structural token or of a text block at its place."""
    return path if text is None else hashed(path, text)


def page_tokens(page: Page) -> list[int]:
    return [token(*x) for x in page.order]


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def distinct_contents(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """host, page and tokens (in page order) of each distinct html of a host: copies count once, whatever their number."""
    rows = pages.select(host_of(url).alias("host"), F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("page"), F.col(html).alias("html"))
    schema = T._parse_datatype_string("host string, page bigint, tokens binary")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        new: dict[tuple, bytes] = {}
        for host, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, "html"), strict=True):
            if (host, key) not in new:
                new[host, key] = np.array(page_tokens(Page(raw.decode() if raw else "")), dtype="<i8").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in new], pa.string()), pa.array([k for _, k in new], pa.int64()), pa.array(list(new.values()), pa.binary())], names=schema.names
        )

    found = map_texts(rows, "html", schema, work).groupBy("host", "page").agg(F.first("tokens").alias("tokens"))
    return persist_shared(found, "contents")


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers, mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def occurrence_vectors(contents: DataFrame) -> DataFrame:
    """host, token, a and b (the sums of its vector), pages, and at: the place in the reference page of the vector."""
    schema = T._parse_datatype_string("host string, token bigint, a bigint, b bigint, n bigint, at bigint")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.unique(np.frombuffer(raw, dtype="<i8"), return_index=True, return_counts=True) for raw in texts_of(batch, "tokens")]
        sizes = np.array([len(x[0]) for x in parts])
        tokens, place, count = (np.concatenate([x[i] for x in parts]) for i in range(3))
        key = np.repeat(mixed(batch.column(1).to_numpy().view(np.uint64)), sizes)
        h = mixed(key + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # tokens of one vector lie on the same pages, so the least key is that of the same page for all of them
        at = (key >> np.uint64(25) << np.uint64(24)).astype(np.int64) | np.minimum(place, (1 << 24) - 1)
        hosts = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        cols = (tokens, (h & np.uint64(0x7FFFFFFF)).astype(np.int64), (h >> np.uint64(33)).astype(np.int64), np.ones(len(h), dtype=np.int64), at)
        return pa.RecordBatch.from_arrays([hosts, *map(pa.array, cols)], names=schema.names)

    found = map_texts(contents, "tokens", schema, work, 1 << 20)
    return found.groupBy("host", "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("pages"), F.min("at").alias("at"))


def out_of_order(ranks: list[int]) -> list[int]:
    """The places outside a longest increasing run of different ranks."""
    ends: list[int] = []  # the rank that ends the best run of each length
    at: list[int] = []  # its place
    before: list[int] = []
    for i, r in enumerate(ranks):
        k = bisect_left(ends, r)
        before.append(at[k - 1] if k else -1)
        ends[k : k + 1] = [r]
        at[k : k + 1] = [i]
    kept, i = set(), at[-1] if at else -1
    while i >= 0:
        kept.add(i)
        i = before[i]
    return [i for i in range(len(ranks)) if i not in kept]


def class_faults(tokens: list[int], member: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """What speaks against a host's classes on one page: (token, token) for a token out of order, (class, class) for two
    that cross. member: the class, named by its first token, and the rank of each token."""
    seen = [(t, *member[t]) for t in dict.fromkeys(tokens) if t in member]
    by: dict[int, list[tuple[int, int]]] = {}
    for t, c, rank in seen:
        by.setdefault(c, []).append((t, rank))
    moved = set()
    for own in by.values():
        if any(x[1] > y[1] for x, y in zip(own, own[1:], strict=False)):
            moved.update(own[i][0] for i in out_of_order([rank for _, rank in own]))
    order = [c for t, c, _ in seen if t not in moved]
    last = {c: i for i, c in enumerate(order)}
    crossed, open_ = set(), []
    for i, c in enumerate(order):
        open_ = [x for x in open_ if last[x] >= i]
        if c not in open_:
            open_.append(c)
        elif open_[-1] != c:
            crossed.update((min(c, x), max(c, x)) for x in open_[open_.index(c) + 1 :])
    return [(t, t) for t in moved] + sorted(crossed)


def valid_tokens(classes: list[tuple[int, list[int]]], faults: dict[tuple[int, int], int], least_tokens: int, slack: float) -> list[int]:
    """The tokens of the ordered and nested ones of a host's classes (pages, tokens in order)."""
    crossings: dict[int, list[tuple[int, int]]] = {}
    for (x, y), n in faults.items():
        if x != y:
            crossings.setdefault(x, []).append((y, n))
            crossings.setdefault(y, []).append((x, n))
    out: list[int] = []
    taken: dict[int, int] = {}
    for pages, tokens in sorted(classes, key=lambda c: (-c[0], -len(c[1]), c[1][0])):
        own = [t for t in tokens if faults.get((t, t), 0) <= slack * pages]
        if len(own) >= least_tokens and not any(n > slack * min(pages, taken[y]) for y, n in crossings.get(tokens[0], ()) if y in taken):
            taken[tokens[0]] = pages
            out += own
    return out


def beside_host(rows: DataFrame, host, known: DataFrame, size: int) -> DataFrame:
    """rows with the columns of `known` for their host: by broadcast where these have at most BROADCAST_TOKENS
    tokens, else by a join on the host that can be split where one host is large."""
    side = F.broadcast(known) if size <= BROADCAST_TOKENS else known
    return rows.join(side, host == F.col("_host"), "left").drop("_host")


def deduce_templates(pages: DataFrame, *, url: str = "url", html: str = "html", support: float = 0.5, least_pages: int = 3, least_tokens: int = 2, slack: float = 0.1) -> DataFrame:
    """host, template: the tokens of the valid equivalence classes of each host, over its distinct contents."""
    contents = distinct_contents(pages, url=url, html=html)
    vectors = occurrence_vectors(contents).where(F.col("pages") >= least_pages)
    hosts = contents.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("_pages"))
    frequent = vectors.join(hosts, F.col("host") == F.col("_host")).where(F.col("pages") >= support * F.col("_pages"))
    # a host has few frequent tokens: at most 1/support times the tokens of its mean page
    member = F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens")
    classes = frequent.groupBy("host", "a", "b", "pages").agg(member).where(F.size("tokens") >= least_tokens)
    classes = persist_shared(classes.groupBy("host").agg(F.collect_list(F.struct("pages", "tokens")).alias("classes")), "classes")
    size = classes.agg(F.sum(F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["tokens"])))).first()[0] or 0
    joined = beside_host(contents.select("host", "tokens"), F.col("host"), classes.select(F.col("host").alias("_host"), F.col("classes").alias("_classes")), size)
    schema = T._parse_datatype_string("host string, x bigint, y bigint, n bigint")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        members: dict[str, dict[int, tuple[int, int]]] = {}
        found: Counter = Counter()
        for i, (host, raw) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch, "tokens"), strict=True)):
            if host not in members:
                held = batch.column(2)[i].as_py() or ()
                members[host] = {t: (c["tokens"][0], rank) for c in held for rank, t in enumerate(c["tokens"])}
            if members[host]:
                found.update((host, *f) for f in class_faults(np.frombuffer(raw, dtype="<i8").tolist(), members[host]))
        rows = [(*k, n) for k, n in found.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string() if j == 0 else pa.int64()) for j in range(4)], names=schema.names)

    faults = map_texts(joined, "tokens", schema, check, 1 << 20).groupBy("host", "x", "y").agg(F.sum("n").alias("n"))
    faults = faults.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("x", "y", "n")).alias("faults"))

    def resolve(batches):
        for batch in batches:
            templates = []
            for held, against in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                known = {(f["x"], f["y"]): f["n"] for f in against or ()}
                templates.append(valid_tokens([(c["pages"], c["tokens"]) for c in held], known, least_tokens, slack))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(templates, pa.list_(pa.int64()))], names=["host", "template"])

    both = classes.join(faults, F.col("host") == F.col("_host"), "left").select("host", "classes", "faults")
    return both.mapInArrow(resolve, "host string, template array<bigint>")


def main_text(page: Page, template: set[int]) -> str:
    """The slots of the article, or of the whole body where no article holds text."""
    marked = [(path, text) for path, text, article, bad in page.blocks if article and not bad]
    kept = [text for path, text in marked if token(path, text) not in template] if template else [text for _, text in marked]
    if 2 * sum(map(len, kept)) < sum(len(text) for _, text in marked):
        kept = [text for _, text in marked]
    if not kept:
        kept = [text for path, text, _, bad in page.blocks if not bad and token(path, text) not in template]
    return " ".join(kept)


BROADCAST_TOKENS = 1 << 20


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", **options) -> DataFrame:
    """pages with text, the main text."""
    pages = without(pages, "text", "_host", "_template")
    templates = persist_shared(deduce_templates(pages, url=url, html=html, **options), "templates").select(F.col("host").alias("_host"), F.col("template").alias("_template"))
    size = templates.agg(F.sum(F.size("_template"))).first()[0] or 0
    joined = beside_host(pages, host_of(url), templates, size)
    schema, width = extended(pages.schema, ("text", "string")), len(pages.columns)
    names = schema.names

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = batch.column(width).to_pylist()
        out = [main_text(Page(raw.decode() if raw else ""), set(t or ())) for raw, t in zip(texts_of(batch, html), known, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, pa.string())], names=names)

    return map_texts(joined, html, schema, work)
