"""Main text of web pages by union-free wrappers inferred for each host.

A page is read into a token stream of container tags (with their classes) and text slots. Runs of equal
sub-streams fold into repeated groups. The streams of a host are aligned one after another with the wrapper so
far: where they differ, what one side lacks becomes an optional group, adjoining equal groups become repeated
ones, and differing strings become text slots. Equal streams count once, so the first shuffle carries a row for each
distinct stream of a host and partition. A host's streams are folded in a tree: about ``FAN`` of them, or of the
wrappers of the level below, in a task's group, with as many levels as the largest host needs.

A wrapper's slots are its leaves. Each page is matched against its host's wrapper, block by block from the left: on
within the innermost repeated group, or that group again, or further on. Statistics of each slot over all pages of the
host decide which belong to the article: slots below article or main elements; without such, all but those of the
template, whose string is the same on all pages that have it, these being half of the host's at least and not copies
of one page. Where less than a tenth of a host's text varies, its pages are copies and have no template. Menus, headers, footers, sidebars, notices, adverts, forms and comments are left
out by element or class name wherever they stand, but for the header of an article, which holds its headline. Class names that tell of a state ("no-sidebar",
"comments-open") don't count. A page's text is that of its blocks in article slots.

Wrappers (compressed) are small, but there is one for each host: the joins leave broadcasting to the planner's size
check, and split a host that holds a third of the pages.

Defined results: null or empty html gives an empty text; a page without a host (null or odd url) belongs to the host
''; repeated rows are extracted alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, pieces, shared_dir, table, written

FAN = 64
COPIES = 0.1  # the share of a host's text that varies at least, unless its pages are copies
#: Alignments of more cells are split, so that memory follows this.
CELLS = 4_000_000
# HTML's elements by role.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = frozenset("li dt dd tr td th option p".split())
OUT_TAGS = frozenset("nav header footer aside form button select menu dialog".split())
OUT_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion footer header menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies share sharing sidebar sidenav signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
MAIN = frozenset(("article", "main"))
IN_HEAD = frozenset("base link meta".split()) | RAW
# Words of class names that tell of a state: "no-sidebar", "has-menu"; "comments-open", "sidebar-left".
NOT_FIRST = frozenset("no not non without with has hide hidden is".split())
NOT_LAST = frozenset("open opened closed on off left right enabled disabled fixed sticky active true false none".split())

# Quotes open a value after an equals sign only; elsewhere they are part of a name.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


def words_of_names(value: str):
    """The words of class names, without those that tell of a state."""
    for name in value.lower().split():
        found = _NAME.findall(name)
        if len(found) < 2 or found[0] not in NOT_FIRST and found[-1] not in NOT_LAST:
            yield from found


def events(page: str):
    """('open', tag, names) / ('close', tag, None) of containers and ('text', string, None); inline tags are dropped, br is a blank."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], None
            return
        if m.start() > at:
            yield "text", page[at : m.start()], None
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in INLINE:
            if tag == "br":
                yield "text", " ", None
            continue
        if m[1]:
            yield "close", tag, None
            continue
        names = tuple(sorted({n for a in _ATTRIBUTE.finditer(m[3]) for n in words_of_names(a[2] or a[3] or a[4] or "")})) if m[3] else ()
        yield "open", tag, names
        if tag in VOID or m[3].endswith("/"):
            yield "close", tag, None


def blocks(page: str):
    """(path, string) of each block of text. A path is the tuple of open containers as 'tag' or 'tag.name.name'."""
    stack: list[tuple[str, str]] = []
    parts: list[str] = []

    def flush():
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        return [(tuple(k for _, k in stack), text)] if text else []

    head = False  # ends with its tag, or with anything that can't stand in it
    for kind, what, names in events(page):
        if kind == "text":
            head = head and not what.strip()
            if not head:
                parts.append(what)
            continue
        if what == "head":
            head = kind == "open"
            continue
        head = head and what in IN_HEAD
        yield from flush()
        if kind == "open":
            if what in CLOSES_P and any(t == "p" for t, _ in stack):
                while stack.pop()[0] != "p":
                    pass
            if what in CLOSES_SELF and stack and stack[-1][0] == what:
                stack.pop()
            stack.append((what, ".".join((what, *names))))
        elif any(t == what for t, _ in stack):
            while stack.pop()[0] != what:
                pass
    yield from flush()


# Wrappers: lists of nodes. A node is a string (path of a text slot) or ["+", [nodes]] / ["?", [nodes]].


def fold(nodes: list) -> list:
    """Runs of equal neighbours, of up to four nodes each, become repeated groups, until there are none."""
    changed = True
    while changed:
        changed = False
        for size in range(1, 5):
            out, i = [], 0
            while i < len(nodes):
                unit, n = nodes[i : i + size], 1
                while len(unit) == size and nodes[i + n * size : i + (n + 1) * size] == unit:
                    n += 1
                inner = unit[0] if size == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else None
                if n > 1:
                    out.append(inner or ["+", unit])
                    i += n * size
                    changed = True
                elif out and isinstance(out[-1], list) and out[-1][0] == "+" and out[-1][1] == unit and len(unit) == size:
                    i += size
                    changed = True
                else:
                    out.append(nodes[i])
                    i += 1
            nodes = out
    return nodes


def _core(node):
    """What two nodes must share to be aligned: repeated and optional groups match what they hold."""
    while isinstance(node, list):
        node = node[1][0] if len(node[1]) == 1 else json.dumps(node[1])
    return node


def _suffixes(a: np.ndarray, b: np.ndarray):
    """Lengths of the longest common subsequences of a[i:] and b[j:], a row for each i from the last on."""
    row = np.zeros(len(b) + 1, np.int32)
    yield row
    for x in a[::-1]:
        row = np.append(np.maximum.accumulate(np.maximum(row[:-1], row[1:] + (b == x))[::-1])[::-1], np.int32(0))
        yield row


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The places of a longest common subsequence."""
    if len(a) > 1 and len(a) * len(b) > CELLS:
        mid = len(a) // 2
        for right in _suffixes(a[mid:], b):
            pass
        for left in _suffixes(a[:mid][::-1], b[::-1]):
            pass
        cut = int(np.argmax(left[::-1] + right))
        return _common(a[:mid], b[:cut]) + [(i + mid, j + cut) for i, j in _common(a[mid:], b[cut:])]
    best, out, i, j = list(_suffixes(a, b))[::-1], [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(wrapper: list, stream: list) -> list:
    """The union-free wrapper of both: common nodes by the longest common subsequence, the others optional."""
    if wrapper == stream:
        return wrapper
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(_core(x), len(ids)) for x in nodes], np.int64) for nodes in (wrapper, stream))
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    pairs = [(k, k) for k in range(lead)] + [(i + lead, j + lead) for i, j in _common(a[lead:], b[lead:])]
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        out += map(_optional, wrapper[i:x] + stream[j:y])
        if x < len(a):
            out.append(_join(wrapper[x], stream[y]))
        i, j = x + 1, y + 1
    return _merged(out)


def _optional(node):
    return node if isinstance(node, list) and node[0] == "?" else ["?", [node]]


def _join(x, y):
    marks = {k for n in (x, y) for k in _marks(n)}
    core = x
    while isinstance(core, list) and len(core[1]) == 1:
        core = core[1][0]
    core = core[1] if isinstance(core, list) else [core]
    node = ["+", core] if "+" in marks else core[0] if len(core) == 1 else ["+", core]
    return ["?", [node]] if "?" in marks else node


def _marks(node):
    while isinstance(node, list):
        yield node[0]
        if len(node[1]) != 1:
            return
        node = node[1][0]


def _merged(nodes: list) -> list:
    """Neighbours with one core become a repeated group."""
    out: list = []
    for n in nodes:
        if out and _core(out[-1]) == _core(n):
            both = _join(out[-1], n)
            opt = isinstance(both, list) and both[0] == "?"
            inner = both[1][0] if opt else both
            inner = inner if isinstance(inner, list) and inner[0] == "+" else ["+", [inner]]
            out[-1] = ["?", [inner]] if opt else inner
        else:
            out.append(n)
    return out


def stream(page: str) -> list:
    """The folded token stream of a page."""
    return fold(["/".join(path) for path, _ in blocks(page)])


class Slots:
    """The leaves of a wrapper, and the one that each block of a page fills."""

    def __init__(self, wrapper: list) -> None:
        self.paths: list[str] = []
        self.groups: list[list[list[int]]] = []  # of each leaf the repeated groups around it, innermost first
        self._add(wrapper, [])
        self.at: dict[str, list[int]] = {}
        for k, p in enumerate(self.paths):
            self.at.setdefault(p, []).append(k)

    def _add(self, nodes: list, around: list) -> None:
        for node in nodes:
            if isinstance(node, str):
                self.paths.append(node)
                self.groups.append(around)
            elif node[0] == "+":
                begin = len(self.paths)
                span: list[int] = [begin, begin]
                self._add(node[1], [span, *around])
                span[1] = len(self.paths) - 1
            else:
                self._add(node[1], around)

    def match(self, paths: list[str]) -> list[int]:
        """The slot of each block; -1 for a path that the wrapper doesn't have."""
        out, now = [], -1
        for p in paths:
            places = self.at.get(p)
            if not places:
                out.append(-1)
                continue
            k = bisect_right(places, now)
            ahead = places[k] if k < len(places) else None
            to = None
            for begin, end in self.groups[now] if now >= 0 else ():
                if ahead is not None and ahead <= end:
                    to = ahead
                elif (i := bisect_left(places, begin)) < k:
                    to = places[i]
                if to is not None:
                    break
            now = to if to is not None else ahead if ahead is not None else places[k - 1]
            out.append(now)
        return out


@lru_cache(8)
def _slots(wrapper: bytes) -> Slots:
    return Slots(json.loads(zlib.decompress(wrapper)))


def excluded(path: tuple[str, ...] | list[str]) -> bool:
    inside = False  # of an article
    for part in path:
        tag, *names = part.split(".")
        if tag in OUT_TAGS and not (tag == "header" and inside) or tag not in ("html", "body", "main", "article") and any((n in OUT_NAMES or n in OUT_ROLES) and not (inside and n == tag == "header") for n in names) or tag == "article" and "comment" in names:
            return True
        inside |= tag in MAIN
    return False


def article_slots(slots: dict[int, tuple[str, bool]]) -> list[int]:
    """The slots that hold the article; slots: slot -> (path, of the template)."""
    open_ = {k: x for k, x in slots.items() if not excluded(x[0].split("/"))}
    main = [k for k, x in open_.items() if MAIN & {t.split(".")[0] for t in x[0].split("/")}]
    return sorted(main or (k for k, x in open_.items() if not x[1]))


def _read(batches):
    """Rows of (host, stream)."""
    for batch in pieces(batches, "html"):
        nodes = [json.dumps(stream(page), separators=(",", ":")) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(nodes, pa.string())], names=["host", "wrapper"])


_FILLED = pa.schema([("host", pa.string()), ("slot", pa.int32()), ("path", pa.string())] + [(n, pa.int64()) for n in ("pages", "low", "high", "page_low", "page_high", "chars")])
FILLED = "host string, slot int, path string, pages long, low long, high long, page_low long, page_high long, chars long"


def _fill(batches):
    """Rows of (host, slot): pages that have it, least and greatest hash of its text and of those pages, its characters; slot -1 stands for the page."""
    for batch in pieces(batches, "html"):
        found: dict[tuple[str, int], tuple] = {}
        for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
            slots, rows = _slots(wrapper), [("/".join(path), path, text) for path, text in blocks(page)]
            of: dict[int, tuple[str, list[str]]] = {-1: ("", [])}
            whole = zlib.crc32("\n".join(text for _, path, text in rows if not excluded(path)).encode())
            for k, (key, _, text) in zip(slots.match([key for key, _, _ in rows]), rows, strict=True):
                of.setdefault(k, (key, []))[1].append(text)
            for k, (key, parts) in of.items():
                h = zlib.crc32("\n".join(parts).encode())
                _, n, low, high, least, most, chars = found.get((host, k), (key, 0, h, h, whole, whole, 0))
                found[host, k] = (key, n + 1, min(low, h), max(high, h), min(least, whole), max(most, whole), chars + sum(map(len, parts)))
        rows = [(*k, *x) for k, x in found.items()]
        yield batch_of(_FILLED, dict(zip(_FILLED.names, zip(*rows, strict=True), strict=True)))


def _fold(frame: pd.DataFrame) -> str:
    out = None
    for w in sorted(frame["wrapper"], key=lambda w: (len(w), w)):
        out = json.loads(w) if out is None else align(out, json.loads(w))
    return json.dumps(out, separators=(",", ":"))


def _fold_part(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "wrapper": [_fold(frame)]})


def _fold_host(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "wrapper": [zlib.compress(_fold(frame).encode())]})


def _decide(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    total = int(frame["pages"][frame["slot"] == -1].sum())
    rows = [r for r in frame.itertuples() if r.slot >= 0]
    fixed = {r.slot for r in rows if r.low == r.high and r.page_low < r.page_high and 2 * r.pages >= total}
    chars = [(r.slot in fixed, r.chars) for r in rows if not excluded(r.path.split("/"))]
    if sum(n for x, n in chars if not x) < COPIES * sum(n for _, n in chars):
        fixed = set()
    return pd.DataFrame({"host": [key[0]], "article": [article_slots({int(r.slot): (r.path, r.slot in fixed) for r in rows})]})


def hosted(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (compressed JSON), article (the wrapper's slots that hold the article), from all pages."""
    folder = shared_dir(pages.sparkSession)
    parts = written(hosted(pages).select("host", "html").mapInArrow(_read, "host string, wrapper string").distinct(), f"{folder}/streams")
    most, level = parts.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, 0
    while most > FAN:
        # Groups of about FAN in the largest host; the hash differs by level, so that those of a group part again.
        most, level = -(-most // FAN), level + 1
        parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper", F.lit(level)), F.lit(most)).alias("part")).applyInPandas(_fold_part, "host string, wrapper string")
    whole = written(parts.groupBy("host").applyInPandas(_fold_host, "host string, wrapper binary"), f"{folder}/whole")
    filled = hosted(pages).join(whole, "host").select("host", "html", "wrapper").mapInArrow(_fill, FILLED)
    # A host's slots are bounded by its wrapper: one row for each.
    told = filled.groupBy("host", "slot").agg(F.min("path").alias("path"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), *[F.min(c).alias(c) for c in ("low", "page_low")], *[F.max(c).alias(c) for c in ("high", "page_high")])
    return whole.join(told.groupBy("host").applyInPandas(_decide, "host string, article array<int>"), "host")


TEXT = "page_id long, url string, text string, n_chars long"
_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(page: str, slots: Slots, article) -> str:
    """The blocks in the article slots of the host's wrapper; of a page that fills none of these, those that it would have as a host of its own."""
    article, rows = frozenset(article or ()), [("/".join(path), text) for path, text in blocks(page)]
    at = slots.match([key for key, _ in rows])
    if not article.intersection(at):
        at, article = range(len(rows)), frozenset(article_slots({k: (key, False) for k, (key, _) in enumerate(rows)}))
    return "\n".join(text for k, (_, text) in zip(at, rows, strict=True) if k in article)


def _extract(batches):
    for batch in pieces(batches, "html"):
        texts = [main_text(h, _slots(w), a) for h, w, a in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "article")), strict=True)]
        yield batch_of(_TEXT, {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = written(wrappers(pages), f"{shared_dir(pages.sparkSession)}/wrappers")
    both = hosted(pages).join(found, "host")
    return both.select("page_id", "url", "html", "wrapper", "article").mapInArrow(_extract, TEXT)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
