"""HTML extraction by nearest-URL page differencing.

A page is read once into text lines, one for each block, each marked as content (inside an article or main element, or else one named as the container), loose, or furniture
(menus, headers, footers, sidebars, forms, adverts, notices, comments: by element, role, class or id). An article or main element below a form or a box that is
furniture by its name only is content again (in such a box an article counts only on pages without other content).

Pages of one host with equal lines are one page, at the first of their paths. The pages of a host are put in order of their paths; each is
paired with the neighbour whose path is nearest (NEAR on either side are looked at; a neighbour that shares nearly all lines is a copy, which says nothing, and
the next nearest follows). All lines of both pages are aligned by longest common subsequence, and the lines that they share are to be deleted. Marks have
a say twice: a shared line that is marked as content stays (copies of an article on one host would otherwise delete each other), and
furniture goes though no neighbour shares it. ``n_shared``, ``n_vetoed`` and ``n_furniture`` count what was decided how.

Defined results: a null page is empty; an empty page has empty text. Pages without a URL, or without a host, are of host "". Unclosed
and misnested elements end where their ancestors end. Rows never merge: repeated pages give repeated rows. Pages are numbered in order and
dealt to blocks of equal size with their neighbours, so no host is gathered in one task, and texts don't depend on the number of
partitions. Columns of other names are not read, so they can't clash.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ._util import dropped, short, staged

#: Elements by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style template textarea iframe select title head noembed noframes".split())
#: What a browser shows in place of something else: text inside content, furniture elsewhere.
INSTEAD = frozenset("noscript svg object canvas audio video".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar advertisement".split())
#: Words of a class or id that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot sidebar "
    "aside widget related recommended recommendations share sharing social cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "disqus respond reply replies commentlist form search pagination pager toolbar skip copyright legal disclaimer tags tagcloud adsbygoogle".split()
)
#: Class or id names of an article's container, and first words of names such as "entry-header", which is the head of the article, not of the page.
CONTAINERS = frozenset("article article-body article-content articlebody content content-body entry-content main main-content maincontent post post-body post-content story-body".split())
OWN = frozenset("article entry post story content".split())
_IMPLIED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|$)", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
#: Words that make furniture of a mark beside them, inside content: "share-buttons", but not "social-impact".
WIDGETS = frozenset("area bar block box button buttons container count icon icons inner item items link links list outer panel section title widget widgets wrap wrapper".split())
#: Elements that no class or id makes furniture.
ROOTS = frozenset("html body main article".split())
#: What a line is. REOPENED: an article inside a box that is furniture by its name only. FORM and BOX are noise in which content may begin again.
#: Lines of forms are FORMED, and loose where a page has nothing else.
FORMED, CONTENT, NAMED, REOPENED, LOOSE, NOISE, FORM, BOX = 5, 4, 3, 2, 1, 0, -1, -2
#: Share of common lines from which two pages are copies of each other.
COPIES = 0.9
#: Neighbours that are looked at on either side, and pages of a block.
NEAR, BLOCK = 4, 256
_HEAD_ENDS = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.IGNORECASE)
_RAW_ENDS = {name: _HEAD_ENDS if name == "head" else re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}


def _marked(attributes: str, inside: bool) -> int | None:
    """NOISE or BOX if attributes make an element furniture (BOX by its name only). Inside content a name of several words counts only if all of them are marks or parts of widgets, so an article's section "related-work" stays."""
    found = None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return NOISE
        if name == "role" and value in ROLES:
            return NOISE
        if name in ("class", "id"):
            for one in value.split():
                words = _WORD.findall(one)
                if len(words) > 1 and words[0] in OWN and words[-1] == "header":
                    continue
                if one in MARKS or words and (words[0] in MARKS or words[-1] in MARKS) and not (inside and (len(words) > 2 or any(w not in MARKS and w not in WIDGETS and w not in OWN for w in words))):
                    found = BOX
    return found


def _named(attributes: str) -> bool:
    """Whether a class, id or role says that an element holds the article."""
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or "").strip("\"'").lower()
        if m[1].lower() in ("class", "id") and not CONTAINERS.isdisjoint(value.split()) or m[1].lower() == "role" and value in ("main", "article"):
            return True
    return False


class _Open:
    """The open elements. Counts by name make it cheap to know that an end tag has no element to end, so reading is linear in the page."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []  # element, what is around it
        self.blocks: list[int] = []  # places of the blocks
        self.held: dict[str, int] = {}  # open blocks by name
        self.inline: list[dict[str, int]] = [{}]  # other elements by name, since each block

    def push(self, name: str, around: int) -> None:
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
            self.held[name] = self.held.get(name, 0) + 1
            self.inline.append({})
        else:
            self.inline[-1][name] = self.inline[-1].get(name, 0) + 1
        self.stack.append((name, around))

    def cut(self, to: int) -> int:
        """Ends all elements from a place on; what is around the first of them."""
        around = self.stack[to][1]
        while len(self.stack) > to:
            name, _ = self.stack.pop()
            if name in BLOCKS:
                self.blocks.pop()
                self.held[name] -= 1
                self.inline.pop()
            else:
                self.inline[-1][name] -= 1
        return around

    def place(self, name: str) -> int:
        """Where the element is that an end tag ends, -1 if nowhere: a block anywhere, another element since the last block."""
        if not (self.held if name in BLOCKS else self.inline[-1]).get(name):
            return -1
        i = len(self.stack) - 1
        while self.stack[i][0] != name:
            i -= 1
        return i

    def paragraph(self) -> int:
        """Where an open p is, if no block has begun in it."""
        return self.blocks[-1] if self.blocks and self.stack[self.blocks[-1]][0] == "p" else -1


def lines(html: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in page order, white space folded, with what they are."""
    out: list[tuple[str, int]] = []
    if not html:
        return out
    open_ = _Open()
    stack = open_.stack
    unended: set[str] = set()
    buffer: list[str] = []
    state = LOOSE

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            if text:
                out.append((text, FORMED if state == FORM else max(state, NOISE)))
            buffer.clear()

    def close(to: int) -> None:
        nonlocal state
        flush()
        state = open_.cut(to)

    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            buffer.append(html[at:])
            break
        if start > at:
            buffer.append(html[at:start])
        m = _TOKEN.match(html, start)
        if not m:  # a lone <
            buffer.append("<")
            at = start + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if m[1]:
            depth = open_.place(name)
            if depth >= 0 and (block or stack[depth][1] != state):
                close(depth)
            elif depth >= 0:
                open_.cut(depth)
            elif block:
                flush()
            continue
        if name in RAW and not m[3].endswith("/"):
            stop = None if name in unended else _RAW_ENDS[name].search(html, at)
            if stop:
                at = stop.end()
            elif name in ("script", "style", "template"):
                at = n
            else:  # and no later one ends either
                unended.add(name)
            continue
        if name in ("br", "wbr"):
            buffer.append(" " if name == "br" else "")
            continue
        if block:
            flush()
            while stack and name in _IMPLIED.get(stack[-1][0], ()) and stack[-1][0] not in ("article", "main", "body"):
                close(len(stack) - 1)
            if name == "p" and (depth := open_.paragraph()) >= 0:
                close(depth)
        if name in VOID or m[3].endswith("/") and not block:
            continue
        inside = state
        if state != NOISE:
            mark = None if name in ROOTS else _marked(m[3], state >= REOPENED)
            if name in FURNITURE and not (name == "header" and state >= REOPENED) or name in INSTEAD and state < REOPENED or mark == NOISE:
                inside = FORM if name == "form" and state == LOOSE and mark != NOISE else state if name == "form" and state < NOISE and mark != NOISE else NOISE
            elif mark == BOX:
                inside = BOX
            elif name == "main" or name == "article" and state != BOX or 'itemprop="articleBody"' in m[3] and state > NOISE:
                inside = CONTENT if state != REOPENED else REOPENED
            elif name == "article":
                inside = REOPENED
            elif state in (LOOSE, FORM) and block and name != "body" and _named(m[3]):
                inside = NAMED
        if inside != state and not block:
            flush()
        open_.push(name, state)
        state = inside
    flush()
    return out


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence of lines. What both begin and end with is set aside first; the rest is aligned with bit-parallel rows, so memory is a bit per pair of lines."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = {*range(lo), *range(len(a) - hi, len(a))}
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(x) & set(y)
    places = [i for i, t in enumerate(x) if t in both]
    x, y = [x[i] for i in places], [t for t in y if t in both]
    if not x:
        return out
    here: dict = {}
    for i, t in enumerate(x):
        here[t] = here.get(t, 0) | 1 << i
    every = (1 << len(x)) - 1
    row, rows = every, []
    for t in y:  # Hyyro's recurrence: zero bits mark where the LCS of the prefixes grows
        match = row & here[t]
        row = ((row + match) | (row - match)) & every
        rows.append(row)
    i = len(x) - 1
    for j in range(len(y) - 1, -1, -1):
        while i >= 0 and rows[j] >> i & 1:
            i -= 1
        if i < 0:
            break
        if j == 0 or rows[j - 1] >> i & 1:  # this row made the growth at i
            out.add(lo + places[i])
            i -= 1
    return out


def _candidates(states: list[int]) -> list[int]:
    """Places of the lines that marks leave: those of the best mark that the page has. Furniture is none; lines of forms are loose where there are no others."""
    best = max((s for s in states if s not in (NOISE, FORMED)), default=FORMED if FORMED in states else NOISE)
    return [i for i, s in enumerate(states) if s == best and best != NOISE]


def _kept(states: list[int], shared: set[int]) -> list[int]:
    """Places of the lines that stay: shared ones go, unless they are marked as content."""
    left = _candidates(states)
    marked = bool(left) and REOPENED <= states[left[0]] < FORMED
    return left if marked else [i for i in left if i not in shared]


def _shared(a: list, states: list[int], b: list) -> set[int] | None:
    """Places of the lines that a page shares with its pair; None if they are copies of each other."""
    gone, left = common(a, b), _candidates(states)
    return None if sum(i in gone for i in left) >= COPIES * max(len(left), 1) else gone


def difference(page: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> list[str]:
    """What is left of a page beside one other page."""
    states = [s for _, s in page]
    gone = _shared([t for t, _ in page], states, [t for t, _ in other]) if other is not None else None
    return [page[i][0] for i in _kept(states, gone or set())]


def _likeness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def page_key(host: str, hashes: bytes, marks: bytes) -> bytes:
    """What tells the pages of all hosts apart, but not the copies on one host."""
    return xxh3_128_digest(host.encode("utf-8", "surrogatepass") + b"\n" + hashes + marks)


def _read(batches):
    """(id, url, host, path, html) -> lines as hashes, marks, and the texts of what is not furniture."""
    packer = zstandard.ZstdCompressor(level=6)
    for b in short(batches):
        hashes, marks, texts, keys = [], [], [], []
        for host, h in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = lines(h)
            own = np.array([xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in page], np.uint64).tobytes()
            states = bytes(s for _, s in page)
            hashes.append(own)
            marks.append(states)
            keys.append(page_key(host, own, states))
            texts.append(packer.compress("\n".join(t for t, s in page if s != NOISE).encode("utf-8", "surrogatepass")))  # no line holds a line break
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "url", "host", "path")] + [pa.array(c, pa.binary()) for c in (keys, hashes, marks, texts)], names=["id", "url", "host", "path", "key", "hashes", "marks", "texts"])


_READ = "id long, url string, host string, path string, key binary, hashes binary, marks binary, texts binary"


def _counted(batches):
    """Numbers the rows of a partition."""
    n = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows))], names=[*b.schema.names, "i"])
        n += b.num_rows


_SHARED = pa.schema([("key", pa.binary()), ("shared", pa.binary())])


def _paired(key, table):
    """A block of pages and their neighbours -> for each page of the block a bit for each line that its pair shares."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("rank", "host", "path", "key", "hashes", "marks")), strict=True))
    block, out = key[0].as_py(), []
    lists = [np.frombuffer(r[4], np.uint64).tolist() for r in rows]
    for i, (rank, host, path, name, _, marks) in enumerate(rows):
        if rank // BLOCK != block:
            continue
        beside = [j for j in range(max(0, i - NEAR), min(len(rows), i + NEAR + 1)) if j != i and rows[j][1] == host]
        beside.sort(key=lambda j: (-_likeness(rows[j][2], path), abs(j - i), j))
        gone = next((g for j in beside if (g := _shared(lists[i], list(marks), lists[j])) is not None), set())
        bits = np.zeros(len(lists[i]), bool)
        bits[list(gone)] = True
        out.append((name, np.packbits(bits).tobytes()))
    return pa.Table.from_pydict({n: [r[c] for r in out] for c, n in enumerate(_SHARED.names)}, schema=_SHARED)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int32()), ("n_shared", pa.int32()), ("n_vetoed", pa.int32()), ("n_furniture", pa.int32())])


def _written_out(batches):
    """Marks, shared lines and texts -> the text that is left, and how many lines there were, a pair shared, marks kept though shared, marks deleted though not shared."""
    unpacker = zstandard.ZstdDecompressor()
    for b in short(batches):
        text, counts = [], []
        for marks, bits, blob in zip(*(b.column(c).to_pylist() for c in ("marks", "shared", "texts")), strict=True):
            states = list(marks)
            gone = set(np.flatnonzero(np.unpackbits(np.frombuffer(bits or b"", np.uint8))).tolist())
            left = _kept(states, gone)
            place = np.cumsum([s != NOISE for s in states]) - 1
            parts = unpacker.decompress(blob).decode("utf-8", "surrogatepass").split("\n") if left else []
            text.append("\n".join(parts[place[i]] for i in left))
            vetoed = sum(i in gone for i in left)
            counts.append((len(states), len(gone), vetoed, len(states) - len(left) - (len(gone) - vetoed)))
        made = [pa.array(c, pa.int32()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int32())] * 4
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string()), *made], schema=_TEXT)


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared, n_vetoed, n_furniture) of every page. Each page is read once; what is put in order are hashes of lines, one row for each distinct page of a host."""
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[?#].*$", "")
    rows = pages.select(
        F.col(key).cast("long").alias("id"),
        F.col(url).cast("string").alias("url"),
        F.lower(F.regexp_extract(bare, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(bare, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", ""), "/+$", "").alias("path"),
        F.col(html).alias("html"),
    )
    read = staged(rows.mapInArrow(_read, _READ), "lines")
    distinct = read.groupBy("key").agg(F.first("host").alias("host"), F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("marks").alias("marks"))
    order = ["host", "path", "key"]
    kinds = "host string, path string, key binary, hashes binary, marks binary, part int"
    sorted_ = distinct.select(*order, "hashes", "marks").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    numbered = staged(sorted_.mapInArrow(_counted, kinds + ", i long"), "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # one row a partition
    ranked = numbered.join(F.broadcast(base), "part").withColumn("rank", F.col("base") + F.col("i")).drop("part", "base", "i")
    blocks = F.array_distinct(F.array(*(F.floor((F.col("rank") + d) / BLOCK) for d in (-NEAR, 0, NEAR))))
    shared = staged(ranked.withColumn("block", F.explode(blocks)).groupBy("block").applyInArrow(_paired, "key binary, shared binary"), "shared")
    dropped(numbered)
    both = read.select("id", "url", "key", "marks", "texts").join(shared, "key", "left")
    got = both.mapInArrow(_written_out, "page_id long, url string, text string, n_lines int, n_shared int, n_vetoed int, n_furniture int")
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_vetoed", "n_furniture")
