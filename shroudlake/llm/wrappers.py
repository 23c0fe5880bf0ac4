"""Main-text extraction by union-free regular expressions inferred for each host.

A page is a stream of tokens: block tags, and text. A host's wrapper is a union-free expression over
such tokens: a list of tags, text slots, optional groups and repeated groups. It is inferred by
aligning streams one after another: adjacent equal groups of a stream fold into a repeated group;
then the stream is aligned with the wrapper by longest common subsequence, slots meet slots, and what one side
lacks becomes an optional group. Wrappers merge like streams, so each task infers one for each of its hosts
and the tasks' wrappers are merged per host, in two rounds; every page takes part. Optional groups that fewer than RARE of a
host's distinct pages have leave a merged wrapper, so its length is bounded; nothing that is decided below rests on them.

A slot knows which texts all its pages have in common (by a hash of the whole text), on how many distinct pages it is,
and how much of its text there is, and how much of it inside links. To extract a page, its stream is aligned with its host's wrapper, so each of
its texts meets a slot, and the slots decide:
- a text that its slot has on all pages, STEADY distinct ones and a share of SHARE of the host's at least, is the
  template's: menus, notices, legal lines; not so headings, nor texts in article or main elements, nor where a page would lose most of its text;
- a slot whose text is mostly links is a menu, outside article and main elements;
- an element that bears a class, id or role of MARKS is furniture, unless half of the host's varying text is inside it; html, body,
  article and main never are; elements of FURNITURE always are;
- where a share of MAIN_SHARE of the host's varying text is in article or main elements, only that counts, on the pages that have such text.

Pages of a host with equal html are one: each of c copies counts 1 / c.

Defined cases: null or empty html gives an empty text; a null URL counts as host ''; repeated rows
each get their text; rows with a null page_id are extracted too; an empty table gives an empty result;
other columns are ignored; very long pages are read whole; up to TABLE cells
they align by a table of the length of the folded stream times the wrapper's, beyond it between items that both have once. A quotation mark that is never closed is a character of its tag.
"""

from __future__ import annotations

import bisect
import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, sized, small_batches

#: Elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select object canvas button".split())
#: Of these what may stand within a line of text, which goes on after it.
WITHIN = frozenset("script style template svg select object canvas button".split())
INLINE = frozenset("math mi mn mo mrow msup msub msubsup mfrac msqrt mroot mtext mspace mover munder munderover mstyle semantics annotation a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
FURNITURE = frozenset("nav header footer aside form script style textarea title head noscript template iframe svg math select object canvas button dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())
MAIN = frozenset(("article", "main"))
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|notice|cookie\w*|consent|popup|modal|comments?|reply|replies|respond|"
    r"share|sharing|social|related|newsletter|subscribe|signup|login|search|widget|toolbar|copyright|complementary|contentinfo|navigation|alert|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
TALK = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond)(?:$|[\s_-])", re.IGNORECASE)
UNMARKED = frozenset(("html", "body", "article", "main"))
STEADY, SHARE, RARE, LINKS, MAIN_SHARE, MOST, NEARLY, LOSS = 3, 0.5, 0.005, 0.6, 0.3, 0.5, 0.95, 0.8
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
SPACE = re.compile(r"\s+")
HEADING = re.compile(r"/h[1-6]$")


#: Cells of an alignment's table at most; longer sequences are aligned between items that each has once, or else by walking, looking so far ahead.
TABLE, REACH = 4_000_000, 200

Block = tuple[str, str, int]


def mark_of(name: str, attributes: str) -> str:
    if name in UNMARKED or not attributes:
        return ""
    values = " ".join(a[2] or a[3] or a[4] or "" for a in ATTR.finditer(attributes)).replace("/", " ")
    for flag, words in (("^", TALK), ("~", MARKS)):
        found = words.search(values)
        if found:
            return flag + found[0].strip(" _-\t\n\r").lower()
    return ""


def flag_of(path: str) -> str:
    """How the last element of a path is marked."""
    return next((c for c in path[path.rfind("/") :] if c in "!~^"), "")


def tokenise(page: str) -> list[Block]:
    """(path, text, characters of it inside links) blocks and (path, '', 0) tags in page order.

    The path names the open block elements: those of furniture with '!', marked ones with '~' and the mark, marked as readers' talk with '^' and the mark.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    path = ""
    text: list[str] = []
    linked: list[str] = []
    at, n, in_link = 0, len(page), False

    def flat(parts: list[str]) -> str:
        return SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()

    def flush() -> None:
        t = flat(text) if text else ""
        if t:
            out.append((path, t, len(flat(linked)) if linked else 0))
        text.clear()
        linked.clear()

    def add(part: str) -> None:
        text.append(part)
        if in_link:
            linked.append(part)

    def push(name: str, label: str) -> None:
        nonlocal path
        stack.append((name, path))
        path = f"{path}/{label}"
        out.append((path, "", 0))

    def pop_to(name: str) -> None:
        nonlocal path
        while stack:
            top, before = stack.pop()
            path = before
            if top == name:
                return

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(htmllib.escape(m[0][9:-3]))
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE or name in VOID:
                if name == "br":
                    flush()
                in_link = in_link and name != "a"
                continue
            flush()
            if any(s[0] == name for s in stack):
                pop_to(name)
            continue
        if name in INLINE:
            in_link = in_link or (name == "a" and "href" in m[3].lower())
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name not in WITHIN:
            flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if m[3].endswith("/") else n)
            continue
        open_names = [s[0] for s in stack]
        if name in CLOSES_P and "p" in open_names:
            pop_to("p")
        elif name in CLOSED_BY_SAME and open_names and open_names[-1] == name:
            pop_to(name)
        push(name, name + ("!" if name in FURNITURE else mark_of(name, m[3])))
    flush()
    return out


def whole_hash(text: str) -> str:
    """Stands for a slot's whole text."""
    return xxhash.xxh3_64_hexdigest(text)


def stream(blocks: list[Block], pages: float = 1) -> list:
    """The page as wrapper items, repeated groups folded: ['t', path] tags and ['s', path, {hash of a text all pages have: its length}, pages, characters, of them in links, block numbers] slots."""
    items = [["s", p, {whole_hash(t): len(t)}, pages, len(t) * pages, links * pages, [i]] if t else ["t", p] for i, (p, t, links) in enumerate(blocks)]
    return fold(items)


def shape(x: list) -> tuple:
    """What must agree for two items to meet."""
    return (x[0], x[1]) if x[0] in "ts" else (x[0], tuple(map(shape, strip(x[1]))))


def strip(group: list) -> list:
    return [x for x in group if x[0] != "?"]


def fold(items: list, widest: int = 6) -> list:
    """Adjacent groups of equal shape become one repeated group."""
    for width in range(1, widest + 1):
        out, i = [], 0
        shapes = [shape(x) for x in items]
        while i < len(items):
            unit, j = shapes[i : i + width], i + width
            while len(unit) == width and shapes[j : j + width] == unit:
                j += width
            if j > i + width:
                group = items[i : i + width]
                for k in range(i + width, j, width):
                    group = [meet(a, b, False) for a, b in zip(group, items[k : k + width])]
                out.append(["+", group])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def meet(a: list, b: list, pages: bool = True) -> list:
    """One item for two of equal shape: of two pages, or (pages false) of two repeats of a group within one."""
    if a[0] == "t":
        return a
    if a[0] == "s":
        if pages:
            small, large = sorted((a[2], b[2]), key=len)
            return ["s", a[1], {h: n for h, n in small.items() if h in large}, a[3] + b[3], a[4] + b[4], a[5] + b[5], []]
        return ["s", a[1], a[2] | b[2], max(a[3], b[3]), a[4] + b[4], a[5] + b[5], a[6] + b[6]]
    return [a[0], align(a[1], b[1]) if pages else [meet(x, y, False) for x, y in zip(a[1], b[1])]]


def anchored(w: list, s: list) -> list[tuple[int, int]]:
    """common() of sequences too long for a table: the longest run of items that are once in each, in one order, and what agrees between them; without such items, the places met by walking both at once."""
    once = lambda x: {k for k, n in Counter(x).items() if n == 1}
    both = once(w) & once(s)
    at = {x: j for j, x in enumerate(s) if x in both}
    tails, back, order = [], {}, [(i, at[x]) for i, x in enumerate(w) if x in both]
    for i, j in order:
        k = bisect.bisect_left(tails, j, key=lambda t: t[1])
        back[i, j] = tails[k - 1] if k else None
        tails[k:k + 1] = [(i, j)]
    chain, x = [], tails[-1] if tails else None
    while x:
        chain.append(x)
        x = back[x]
    if not chain:
        out, j = [], 0
        later: dict = {}
        for q, x in enumerate(s):
            later.setdefault(x, []).append(q)
        for i, x in enumerate(w):
            spots = later.get(x, ())
            k = bisect.bisect_left(spots, j)
            if k < len(spots) and spots[k] - j <= REACH:
                out.append((i, spots[k]))
                j = spots[k] + 1
        return out
    out, i, j = [], 0, 0
    for x, y in [*reversed(chain), (len(w), len(s))]:
        out += [(i + a, j + b) for a, b in common(w[i:x], s[j:y])]
        if x < len(w):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def common(sw: list, ss: list) -> list[tuple[int, int]]:
    """The places at which two sequences agree, by longest common subsequence; equal ends are taken first."""
    n, m, head = len(sw), len(ss), 0
    while head < min(n, m) and sw[head] == ss[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and sw[n - 1 - tail] == ss[m - 1 - tail]:
        tail += 1
    pairs = [(k, k) for k in range(head)]
    w, s = sw[head : n - tail], ss[head : m - tail]
    if len(w) * len(s) > TABLE:
        pairs += [(head + i, head + j) for i, j in anchored(w, s)]
    elif w and s:
        best = [[0] * (len(s) + 1) for _ in range(len(w) + 1)]
        for i in reversed(range(len(w))):
            row, nxt, x = best[i], best[i + 1], w[i]
            for j in reversed(range(len(s))):
                row[j] = nxt[j + 1] + 1 if x == s[j] else max(nxt[j], row[j + 1])
        i = j = 0
        while i < len(w) and j < len(s):
            if w[i] == s[j]:
                pairs.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs + [(n - k, m - k) for k in range(tail, 0, -1)]


def align(w: list, s: list) -> list:
    """The wrapper that accepts what either accepts: common items meet, the others become optional groups."""
    out, i, j = [], 0, 0
    for x, y in [*common([key(x) for x in w], [key(x) for x in s]), (len(w), len(s))]:
        out += [z if z[0] == "?" else ["?", [z]] for z in (*w[i:x], *s[j:y])]
        if x < len(w):
            out.append(meet_any(w[x], s[y]))
        i, j = x + 1, y + 1
    return out


def inner(x: list) -> list:
    while x[0] in "?+":
        x = x[1][0]
    return x


def key(x: list) -> tuple:
    """Items with the same first tag or slot meet, also inside an optional or repeated group."""
    first = inner(x)
    return (first[0], first[1])


def meet_any(a: list, b: list) -> list:
    """Two items that start alike; a single item and a repeated or optional group of it give the group."""
    if a[0] == b[0]:
        return meet(a, b) if a[0] in "ts" else [a[0], align(a[1], b[1])]
    if "?" in (a[0], b[0]):
        x, y = (a, b) if a[0] == "?" else (b, a)
        return ["?", align(x[1], [y])]
    x, y = (a, b) if a[0] == "+" else (b, a)
    return ["+", align(x[1], [y])]


def slots(w: list) -> Iterator[list]:
    for x in w:
        if x[0] == "s":
            yield x
        elif x[0] in "?+":
            yield from slots(x[1])


def match(w: list, s: list, found: dict[int, list]) -> None:
    """Aligns a page's stream with a wrapper: found gets the wrapper's slot of each of the page's blocks that meet one."""
    for x, y in common([key(x) for x in w], [key(x) for x in s]):
        a, b = w[x], s[y]
        if a[0] in "ts" and b[0] in "ts":
            if b[0] == "s":
                found.update(dict.fromkeys(b[6], a))
        else:
            match(a[1] if a[0] in "?+" else [a], b[1] if b[0] in "?+" and (a[0] != "?" or b[0] == "?") else [b], found)


def pruned(w: list, least: float) -> list:
    """The wrapper without optional groups whose slots are on fewer pages; whole while that is less than one page."""
    if least < 1:
        return w
    out = []
    for x in w:
        if x[0] == "?" and max((z[3] for z in slots(x[1])), default=0) < least:
            continue
        out.append([x[0], pruned(x[1], least)] if x[0] in "?+" else x)
    return out


def prefixes(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[: k + 1]) for k in range(1, len(parts))]


def in_main(path: str) -> bool:
    return any(p in MAIN for p in path.split("/"))


def furniture(path: str, exempt: frozenset[str] | set[str] = frozenset()) -> bool:
    """An element of furniture is on the path, or a marked one that is not exempt; a header inside the article belongs to the article."""
    inside = False
    for p in prefixes(path):
        name, flag = p.rsplit("/", 1)[1], flag_of(p)
        if flag == "!" and not (inside and name == "header!") or flag and flag in "~^" and p not in exempt:
            return True
        inside |= name in MAIN
    return False


class Rules:
    """What a host's wrapper decides: which slots are steady or menus, which marked elements are none, and whether only article and main elements count."""

    def __init__(self, wrapper: list, pages: float) -> None:
        self.wrapper, self.least = wrapper, max(STEADY, SHARE * pages) - 1e-6  # the counts are sums of fractions
        varying: dict[str, float] = {}
        for x in slots(wrapper):
            template = sum(x[2].values()) * x[3] if x[3] >= self.least else 0
            varying[x[1]] = varying.get(x[1], 0) + max(0.0, x[4] - x[5] - template)
        total = sum(v for p, v in varying.items() if not any(flag_of(e) == "!" for e in prefixes(p))) or 1.0
        inside: dict[str, float] = {}
        for p, v in varying.items():
            for e in prefixes(p):
                if flag_of(e) in ("~", "^"):
                    inside[e] = inside.get(e, 0) + v
        self.exempt = {e for e, v in inside.items() if v >= (MOST if flag_of(e) == "~" else NEARLY) * total}
        main = sum(v for p, v in varying.items() if in_main(p) and not furniture(p, self.exempt))
        self.main = main >= MAIN_SHARE * sum(v for p, v in varying.items() if not furniture(p, self.exempt)) and main > 0

    def text(self, blocks: list[Block]) -> str:
        met: dict[int, list] = {}
        match(self.wrapper, stream(blocks), met)
        own = [i for i, (p, t, _) in enumerate(blocks) if t and not furniture(p, self.exempt)]
        if not own:  # marks alone never empty a page: what is marked, but for readers' talk and lists of links, is all there is
            marked = {e for p, t, _ in blocks for e in prefixes(p) if flag_of(e) == "~"}
            own = [i for i, (p, t, links) in enumerate(blocks) if t and links < LINKS * len(t) and not furniture(p, self.exempt | marked)]
        if self.main and any(in_main(blocks[i][0]) for i in own):
            own = [i for i in own if in_main(blocks[i][0])]
        else:
            menu = lambda x: x[4] > 0 and x[5] >= LINKS * x[4]
            own = [i for i in own if in_main(blocks[i][0]) or i not in met or not menu(met[i])]
            steady = {i for i in own if i in met and met[i][3] >= self.least and whole_hash(blocks[i][1]) in met[i][2] and not in_main(blocks[i][0]) and not HEADING.search(blocks[i][0])}
            size = lambda some: sum(len(blocks[i][1]) for i in some)
            if size(steady) <= LOSS * size(own):
                own = [i for i in own if i not in steady]
        return "\n".join(blocks[i][1] for i in own)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


def merge(items: list[list], pages: float) -> list:
    """Streams or wrappers aligned one after another, in a fixed order."""
    out = items[0]
    for x in items[1:]:
        out = align(out, x)
    return pruned(out, RARE * pages)


def bare(w: list) -> list:
    """The wrapper without a page's block numbers."""
    return [[*x[:6], []] if x[0] == "s" else [x[0], bare(x[1])] if x[0] in "?+" else x for x in w]


#: Partial wrappers of a host are merged in so many lots, then these.
LOTS = 32
#: Bytes of wrappers that are broadcast at most.
SENT = 32 << 20


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON, distinct pages): each task's wrappers, merged by host."""
    small_batches(pages.sparkSession, 500)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list] = {}
        n: dict[str, float] = {}
        for batch in batches:
            for host, page, copies in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                s = bare(stream(tokenise(page or ""), 1 / copies))
                n[host] = n.get(host, 0) + 1 / copies
                got[host] = pruned(align(got[host], s), RARE * n[host]) if host in got else s
        if got:
            yield pa.record_batch([pa.array(list(got)), pa.array([json.dumps(w) for w in got.values()]), pa.array([n[h] for h in got])], ["host", "wrapper", "pages"])

    def whole(t: pa.Table) -> pa.Table:
        parts, n = sorted(t.column("wrapper").to_pylist()), sum(sorted(t.column("pages").to_pylist()))
        row = {"host": t.column("host").slice(0, 1).to_pylist(), "wrapper": [json.dumps(merge([json.loads(x) for x in parts], n))], "pages": [n]}
        return pa.table(row, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.float64())]))

    made = "host string, wrapper string, pages double"
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    same = [F.xxhash64("host", "html").alias("h"), F.xxhash64("html", "host").alias("g")]
    # only pages that have copies are looked up; written, so that the size is known and the html is not exchanged for a small table
    copies = sized(rows.select(*same).groupBy("h", "g").agg(F.count("*").alias("copies")).where("copies > 1"), "wrappers-copies")
    counted = rows.select("host", "html", *same).join(copies, ["h", "g"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    lots = counted.mapInArrow(part, made).groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(LOTS))).applyInArrow(whole, made)
    return lots.groupBy("host").applyInArrow(whole, made)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    wrappers = durable(infer(pages), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    # beyond the bound pages are exchanged by host, and Spark splits hot hosts
    wrappers = F.broadcast(wrappers) if size <= SENT else wrappers
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(wrappers, "host", "left").select("page_id", "url", "html", "host", "wrapper", "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Rules] = {}
        for batch in batches:
            text = []
            for page, host, w, n in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)]):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = Rules(json.loads(w or "[]"), n or 0)
                text.append(known[host].text(tokenise(page or "")))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
