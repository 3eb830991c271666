"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts; its nesting makes it a tree. Pages of one host are aligned one after
another with the host's wrapper: children that both have are matched and aligned in turn, a child that one of them
lacks becomes optional, neighbours of one shape become a repeated group, and text becomes a slot. A slot
knows how many words, link words and pages it stands for and whether its text is the same on all pages, so
the wrapper tells the article's slots from the template's.

What a node is follows from its tag, from the names in its attributes and from its share of the host's words. A name that
speaks of a menu, a sidebar or the like drops a node unless the node also has a name of an article's or holds most of the words.

Each task folds its own pages into wrappers, one for each host; their sum is independent of how many
pages a host has. Wrappers of a host meet in two steps, first by host and salt, so a host with a third of all
pages is no single task. Pages aren't shuffled while all wrappers together are small (counted); beyond that they join by host.

A null or empty page has an empty text; null and unreadable urls are one host. Repeated pages and urls are pages of their own, a long
page is one row. An empty table gives no rows. The text takes the place of a column of its name; other columns come along.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, without

SALTS = 16
HOSTS_HELD = 2000  # wrappers that a task holds before it hands them on
SMALL_BYTES = 32 << 20  # of wrappers that are sent to every task
DEPTH = 200  # levels of a page's tree; the text of deeper elements belongs to the last of them
WIDE = 40  # children beyond which an alternating list becomes one repeated group of optional parts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NO_TEXT = frozenset("head script style noscript template iframe object svg math canvas audio video select option textarea button".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

DROP_TAGS = frozenset("nav footer aside form menu dialog".split()) | NO_TEXT
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu sidebar sidebars"
    " rail footer foot masthead topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup"
    " login search social share sharing related recommended recommendations comment comments discussion disqus reply replies respond responses widget toolbar pagination pager".split()
)
HEADER_WORDS = frozenset(["header", "head"])
#: First parts of names that say how something is laid out, not what it is.
LAYOUT_WORDS = frozenset("has with without no not is hide hides show shows".split())
#: Shares of the host's unlinked words from which a node with two kinds of names, or with one of a menu's or the like, is kept.
SHARE_OF_BOTH, SHARE_OF_DROPPED = 0.3, 0.6
MAIN_WORDS = frozenset("article articlebody content post entry story main body".split())

#: A quote that isn't closed within 4096 characters is none, so a page costs time in proportion to its length.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,4096}\"|'[^']{0,4096}')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*")


class Node:
    """An element of a page, or what a wrapper knows of such elements."""

    __slots__ = ("label", "kids", "words", "linked", "pages", "same", "optional", "repeated", "flag", "texts")

    def __init__(self, label: str, words: int = 0, linked: int = 0, pages: int = 1, same: int | None = None):
        self.label, self.words, self.linked, self.pages, self.same = label, words, linked, pages, same
        self.kids: list[Node] = []
        self.optional = self.repeated = False
        self.flag = ""
        self.texts: list = []  # pieces of own text and children, in page order (pages only)

    def pack(self) -> list:
        return [self.label, self.words, self.linked, self.pages, self.same, int(self.optional), int(self.repeated), self.flag, [k.pack() for k in self.kids]]

    @staticmethod
    def unpack(x: list) -> Node:
        n = Node(*x[:5])
        n.optional, n.repeated, n.flag = bool(x[5]), bool(x[6]), x[7]
        n.kids = [Node.unpack(k) for k in x[8]]
        return n

    def tag(self) -> str:
        return self.label.partition("|")[0]

    def total(self) -> tuple[int, int]:
        w, a = self.words, self.linked
        for k in self.kids:
            x, y = k.total()
            w, a = w + x, a + y
        return w, a


def _label(tag: str, attrs: str) -> str:
    """Tag and the names in class, id, role and itemprop, without digits: they often number elements."""
    if not attrs or "=" not in attrs:
        return tag
    found = [f"{m[1].lower()}={re.sub(r'[0-9]+', '', m[2] or m[3] or m[4] or '')}" for m in _ATTR.finditer(attrs)]
    return "|".join([tag, *sorted(found)])


def parse(page: str | None) -> Node:
    """The tree of a page: block elements with their own text; inline tags only mark links."""
    root = Node("#page")
    # Elements below DEPTH are on the stack with their tag, but say what they have to the last node above, or to none.
    stack, tags, links, at, text = [root], ["#page"], 0, 0, page or ""

    def say(raw: str) -> None:
        if not raw:
            return
        top = stack[-1]
        top.texts.append(html.unescape(raw) if "&" in raw else raw)
        n = len(raw.split())
        top.words += n
        top.linked += n * (links > 0)

    def pop_to(k: int) -> None:
        if k > DEPTH:
            stack[k - 1].texts.append(" ")
        del stack[k:], tags[k:]

    last = text.rfind(">")
    for m in iter(lambda: _TOKEN.search(text, at) if at <= last else None, None):
        say(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if tags[k] == tag:
                    pop_to(k)
                    break
            else:
                if tag == "p":
                    say(" ")
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in INLINE:
            links += tag == "a" and not attrs.rstrip().endswith("/")
            continue
        if tag in VOID:
            if tag == "hr":
                stack[-1].texts.append(" ")
            continue
        if tag in CLOSES_P and tags[-1] == "p":
            pop_to(len(stack) - 1)
        if tag in SAME_CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                own = tags[k]
                if own in LIST_ENDS.get(tag, ()):
                    break
                if own in SAME_CLOSES[tag]:
                    pop_to(k)
                    break
        if tag == "body":
            links = 0
            pop_to(1)
        elif len(stack) > 1 and tags[-1] == "head" and tag not in ("title", "meta", "style", "script", "link", "base", "noscript", "template"):
            pop_to(len(stack) - 1)
        node = Node(_label(tag, attrs))
        if len(stack) < DEPTH:
            stack[-1].kids.append(node)
            stack[-1].texts.append(node)
        elif not dropped(node.label, True):
            stack[-1].texts.append(" ")
            node = stack[-1]
        if not attrs.endswith("/") or tag not in ("path", "circle", "rect"):
            stack.append(node)
            tags.append(tag)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            if tag not in ("script", "style"):
                say(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text)
            pop_to(len(stack) - 1)
    say(text[at:])
    return root


def _alike(a: Node, b: Node) -> bool:
    """Whether two neighbours of one label are turns of one repeated group."""
    x, y = {k.label for k in a.kids}, {k.label for k in b.kids}
    return 2 * len(x & y) >= len(x | y)


def merge(a: Node, b: Node) -> Node:
    """a, generalised so that it covers b as well."""
    a.words, a.linked, a.pages = a.words + b.words, a.linked + b.linked, a.pages + b.pages
    a.same = a.same if a.same == b.same else None
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.kids = _align(a.kids, b.kids)
    return a


def turn(a: Node, b: Node) -> Node:
    """a as a repeated group that covers b, its next turn on the same page."""
    pages = a.pages
    merge(a, b)
    a.pages, a.repeated, a.same = pages, True, None
    return a


def fold(node: Node, page: bool = True) -> Node:
    """The wrapper of one page: own texts become slots, neighbours of one shape a repeated group."""
    out = Node(node.label, node.words, node.linked, 1, hash_text("".join(t if isinstance(t, str) else "\0" for t in node.texts)) if node.words else None)
    for kid in node.kids:
        k = fold(kid)
        if out.kids and out.kids[-1].label == k.label and _alike(out.kids[-1], k):
            turn(out.kids[-1], k)
        else:
            out.kids.append(k)
    if len(out.kids) > WIDE:
        out.kids = _grouped(out.kids)
    return out


def _grouped(kids: list[Node]) -> list[Node]:
    """A long alternating list as the turns of one group of optional parts, in order of first place."""
    by: dict[str, Node] = {}
    for k in kids:
        if k.label in by:
            turn(by[k.label], k)
        else:
            by[k.label] = k
            k.optional = True
    return list(by.values())


def pairs(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """The heaviest matching of two lists of children that keeps their order."""
    n, m = len(a), len(b)
    if n == m and all(x.label == y.label for x, y in zip(a, b, strict=True)):
        return [(k, k) for k in range(n)]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    own = [{k.label for k in x.kids} for x in a], [{k.label for k in y.kids} for y in b]

    def weight(i: int, j: int) -> float:
        x, y = own[0][i], own[1][j]
        return 1 + (len(x & y) / len(x | y) if x or y else 1.0)

    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if a[i].label == b[j].label:
                best[i][j] = max(best[i][j], best[i + 1][j + 1] + weight(i, j))
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i].label == b[j].label and best[i][j] == best[i + 1][j + 1] + weight(i, j):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _align(a: list[Node], b: list[Node]) -> list[Node]:
    out: list[Node] = []
    i = j = 0
    for x, y in [*pairs(a, b), (len(a), len(b))]:
        for lone in (*a[i:x], *b[j:y]):
            lone.optional = True
            if out and out[-1].label == lone.label and _alike(out[-1], lone) and (out[-1].repeated or lone.repeated):
                turn(out[-1], lone)
            else:
                out.append(lone)
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return _grouped(out) if len(out) > 2 * WIDE else out


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(" ".join(text.split()))


def verdict(label: str, inside: bool) -> str:
    """What a label says: `x` a menu, header, footer, sidebar, notice, advert, form or reader comments by its tag or role; `d` the same
    by its names; `b` a name of that kind and one of an article's; or nothing."""
    tag, *names = label.split("|")
    if tag in DROP_TAGS or (tag == "header" and not inside):
        return "x"
    body, bad, good = tag in ("article", "main", "body", "html"), False, False
    for x in names:
        name, _, value = x.partition("=")
        if name == "role":
            if value.lower() in DROP_ROLES:
                return "x"
            continue
        for token in value.split():
            words = [w.lower() for w in _PARTS.findall(token)]
            if not words or words[0] in LAYOUT_WORDS:
                continue
            hit = DROP_WORDS & {*words} if not body else {*words} & {"comment", "comments", "ad", "ads", "related", "reply", "sponsored"}
            if hit or (not inside and not body and HEADER_WORDS & {*words}):
                bad = True
            elif MAIN_WORDS & {*words}:
                good = True
    return ("b" if good else "d") if bad else ""


def dropped(label: str, inside: bool) -> bool:
    """Whether a label names a menu, header, footer, sidebar, notice, advert, form or reader comments."""
    return verdict(label, inside) in ("x", "d")


def _is_main(label: str) -> int:
    tag, *names = label.split("|")
    if tag == "article" or any(x == "itemprop=articleBody" for x in names):
        return 3
    if tag == "main" or "role=main" in names:
        return 2
    return int(any({w.lower() for w in _PARTS.findall(x.partition("=")[2])} & MAIN_WORDS for x in names if x[:5] != "role=" and tag not in ("html", "body")))


def decide(wrapper: Node) -> Node:
    """Flags the wrapper's nodes: `m` the article, `x` what is never text, `t` text of the template."""
    found: list[tuple[int, int, Node]] = []
    unlinked: dict[int, int] = {}

    def count(n: Node) -> int:
        sure = n.label != "#page" and verdict(n.label, False) == "x"
        unlinked[id(n)] = 0 if sure else max(0, n.words - n.linked) + sum(map(count, n.kids))
        return unlinked[id(n)]

    every = count(wrapper)

    def mark(n: Node, inside: bool) -> int:
        said, share = verdict(n.label, inside) if n.label != "#page" else "", unlinked.get(id(n), 0) / max(1, every)
        held = {"b": SHARE_OF_BOTH, "d": SHARE_OF_DROPPED}.get(said, 2.0)
        if said and (share < held or n.repeated or "comment" in n.label.lower()):
            n.flag = "x"
            return 0
        level = _is_main(n.label)
        w = max(0, n.words - n.linked) + sum(mark(k, inside or level > 1) for k in n.kids)
        if level and w:
            found.append((level, w, n))
        return w

    total = mark(wrapper, False)
    main = None
    if found:
        good = [x for x in found if 4 * x[1] >= total] or found
        top = max(x[0] for x in good)
        most = max(x[1] for x in good if x[0] == top)
        main = next(x[2] for x in good if x[0] == top and x[1] == most)
    if main is None:
        main = wrapper
        while True:
            sizes = [(sum(_plain(k)), k) for k in main.kids if k.flag != "x"]
            best = max(sizes, key=lambda s: s[0], default=(0, None))
            if best[1] is None or best[0] < 0.8 * sum(_plain(main)) or best[1].tag() in ("p", "h1", "li"):
                break
            main = best[1]
        for k in list(_below(main)):
            w, a = k.total()
            if not k.flag and k is not main and w and a > 0.7 * w and k.tag() not in ("p", "li", "h1", "h2", "h3"):
                k.flag = "x"
    main.flag = "m"
    slots = [k for k in _below(main) if k.words and not k.flag]
    fixed = [k for k in slots if k.same is not None and k.pages >= 3 and not k.repeated and k.pages == main.pages]
    if fixed and 5 * sum(k.words for k in fixed) < sum(k.words for k in slots):
        for k in fixed:
            k.flag = "t"
    return wrapper


def _plain(n: Node) -> tuple[int, ...]:
    return (max(0, n.words - n.linked), *(sum(_plain(k)) for k in n.kids if k.flag != "x"))


def _below(n: Node):
    yield n
    for k in n.kids:
        if k.flag != "x":
            yield from _below(k)


def extract(page: Node, wrapper: Node | None) -> str:
    """The text of the article's slots of a page, aligned with its host's wrapper."""
    out: list[str] = []

    def walk(n: Node, w: Node | None, inside: bool) -> None:
        if (w.flag == "x") if w is not None else (n.label != "#page" and dropped(n.label, inside)):
            return
        inside = inside or (w is not None and w.flag == "m")
        match = _matched(w.kids, n.kids) if w is not None else {}
        run: list[str] = []
        own = inside and not (w is not None and w.flag == "t")
        for t in n.texts:
            if isinstance(t, str):
                run.append(t)
            else:
                if own:
                    out.append("".join(run))
                run = []
                walk(t, match.get(id(t)), inside)
        if own:
            out.append("".join(run))

    walk(page, wrapper, False)
    return " ".join(" ".join(out).split())


def _matched(wrapper: list[Node], kids: list[Node]) -> dict[int, Node]:
    """Wrapper node of each child, by turns of repeated groups."""
    runs: list[list[Node]] = []
    for k in kids:
        if runs and runs[-1][0].label == k.label and _alike(runs[-1][0], k):
            runs[-1].append(k)
        else:
            runs.append([k])
    heads = [r[0] for r in runs]
    by_label: dict[str, Node] = {}
    for w in wrapper:
        by_label.setdefault(w.label, w)
    got = {j: wrapper[i] for i, j in pairs(wrapper, heads)} if len(heads) * len(wrapper) <= 40_000 else {}
    return {id(k): w for j, r in enumerate(runs) if (w := got.get(j) or by_label.get(r[0].label)) is not None for k in r}


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper) of all pages: wrappers as JSON, their flags set."""
    schema = "host string, salt int, wrapper string"

    def start(batches):
        held: dict[str, Node] = {}
        turns = 0

        def give():
            nonlocal turns
            turns += 1
            names = list(held)
            rows = [json.dumps(held.pop(x).pack()) for x in names]
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([hash_text(r) % SALTS for r in rows], pa.int32()), pa.array(rows)], ["host", "salt", "wrapper"])

        for batch in batches:
            for host, text in zip(batch.column(0), batch.column(1), strict=True):
                w, host = fold(parse(text.as_py())), host.as_py()
                held[host] = merge(held[host], w) if host in held else w
                if len(held) > HOSTS_HELD:
                    yield give()
        if held:
            yield give()

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for x in batch.column("wrapper"):
                w = Node.unpack(json.loads(x.as_py()))
                out = w if out is None else merge(out, w)
        names = ["host", "salt", "wrapper"]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([0], pa.int32()), pa.array([json.dumps(out.pack())])], names)

    def final(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in join(key, batches):
            w = decide(Node.unpack(json.loads(b.column(2)[0].as_py())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([json.dumps(w.pack())])], b.schema.names)

    parts = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("html")).mapInArrow(start, schema)
    some = parts.groupBy("host", "salt").applyInArrow(join, schema)
    return some.groupBy("host").applyInArrow(final, schema).select("host", "wrapper")


def extract_text(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each; a null page has an empty text, a null url belongs to the host ''."""
    from pyspark.sql.types import StructType

    pages = without(pages, [text] if text not in (url, page) else [])
    made = cut(wrappers(pages, url, page))
    small = made.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0] <= SMALL_BYTES
    rows = pages.withColumn("__host", host_of(F.col(url)))
    if small:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in made.collect()})
    else:  # a host's pages are split by Spark's handling of skewed joins
        sent = None
        rows = rows.join(made.select(F.col("host").alias("__h"), "wrapper"), F.col("__host") == F.col("__h"), "left").drop("__h")
    at, n = pages.columns.index(page), len(pages.columns)
    schema = StructType([*pages.schema.fields]).add(text, "string")

    def run(batches):
        known: dict[str, Node | None] = {}
        for batch in batches:
            out = []
            for k, (x, host) in enumerate(zip(batch.column(at), batch.column(n), strict=True)):
                host = host.as_py()
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    w = sent.value.get(host) if sent else batch.column(n + 1)[k].as_py()
                    known[host] = None if w is None else Node.unpack(json.loads(w))
                out.append(extract(parse(x.as_py()), known[host]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    got = extract_text(pages)
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
