"""Main text of web pages: markup, and differences between pages with near urls.

A page is read as lines, one for each block.  Lines in menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like are told by tags,
roles and words in classes or ids.  Where markup says nothing, differences do:
pages of one host are put in the order of their paths, each is paired with its
neighbours, the pair's lines are aligned by longest common subsequence, and
lines that both have are boilerplate.

Articles repeat each other's passages, so a shared line of running text inside
an article stays; outside of it, or in an element that holds no running text,
a shared line goes.  Pages that have nearly all lines in common are copies of
each other and say nothing.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_sizes, slices, texts, tidy, whole_groups
from spanloom.llm.sharding import number_rows
from spanloom.llm.urls import host_and_path
from spanloom.operators.components import durable

#: Elements whose text is none of the page's, and those that are read up to their own end tag.
APART = frozenset("aside button canvas datalist dialog fieldset footer form head iframe label menu nav noscript object option select svg template video audio".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line, and those that hold running text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
#: Words of a class or id, and roles, that tell what is no main text.
TELLING = frozenset("ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
BEGINNINGS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor")
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: What an end tag does not reach across, and the elements that a like one ends.
_HOLDS = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())
_IN_HEAD = RAW | {"noscript", "template"}
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_WORDS = re.compile(r"[a-z0-9]+")


def _apart(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element's text is none of the page's main text: 2 for sure, 1 going by the words of its class or id, else 0."""
    if name in APART or (name == "header" and not in_article):
        return 2
    if not attributes or attributes.isspace():
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return 2
        if key == "role" and value.strip() in ROLES:
            return 2
        if key in ("class", "id") and name not in ("html", "body", "main"):
            words = {w for w in _WORDS.findall(value) if w in TELLING or w.startswith(BEGINNINGS) or (w == "header" and not in_article and name not in RUNNING)}
            if words and (name != "article" or any(w.startswith(("comment", "repl", "related", "sponsor", "promo")) for w in words)):
                found = 1
    return found


def page_lines(page: str) -> tuple[list[tuple[str, int, bool]], int]:
    """Lines of a page that markup does not set apart: (text, level, running), and the page's level.

    ``level`` is 2 inside an article, 1 inside main, else 0; a page's main text
    has the highest level that any element has.  ``running`` is false for lines
    outside an article or not in an element of running text.
    """
    lines: list[tuple[str, int, bool]] = []
    #: Open elements: name, how surely it is set apart, level, innermost block.
    stack: list[tuple[str, int, int, str]] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    apart = level = most = at = 0

    def end_line() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                lines.append((text, level, level > 0 and stack[-1][3] in RUNNING))

    def drop_to(k: int) -> None:
        nonlocal apart, level
        apart -= sum(x[1] > 0 for x in stack[k:])
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]
        level = stack[-1][2] if stack else 0

    while (m := _TOKEN.search(page, at)) is not None:
        if not apart and m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                end_line()
            continue
        if m[1]:
            if not opened[name]:
                continue
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name or (stack[k][0] in _HOLDS and name not in BLOCK)), -1)
            if k >= 0 and stack[k][0] == name:
                if name in BLOCK:
                    end_line()
                drop_to(k)
            continue
        if stack and stack[-1][0] == "head" and name not in _IN_HEAD:
            drop_to(len(stack) - 1)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
            continue
        if name in BLOCK:
            end_line()
            ends = ("p", *_ENDS.get(name, ()))
            k = len(stack) - 1
            while k >= 0 and any(opened[x] for x in ends):
                if stack[k][0] in ends:
                    drop_to(k)
                elif stack[k][0] in _HOLDS:
                    break
                k -= 1
        if m[3].endswith("/") and name not in BLOCK:
            continue
        away = _apart(name, m[3], level == 2)
        if apart and not away and name in ("article", "main") and most == 0 and all(x[1] < 2 for x in stack):
            # a class that speaks of the layout ("with-sidebar") around the first article
            stack[:] = [(x[0], 0, *x[2:]) for x in stack]
            apart = 0
        own = 0 if apart or away else 2 if name == "article" else 1 if name == "main" or re.search(r"role\s*=\s*[\"']?main\b", m[3]) else 0
        level, most = max(level, own), max(most, own)
        stack.append((name, away, level, name if name in BLOCK else stack[-1][3] if stack else ""))
        opened[name] += 1
        apart += away > 0
    if not apart and at < len(page):
        pieces.append(page[at:])
    end_line()
    return lines, most


def common_lines(a: Sequence[int], b: Sequence[int], room: int = 1 << 25) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, by bit-parallel rows.

    Lines that only one side has are left out first.  At most ``room`` bytes of
    rows are kept; the others are made again from the row kept before them.
    """
    both = set(a) & set(b)
    one, two = ([k for k, x in enumerate(side) if x in both] for side in (a, b))
    if not one or not two:
        return []
    where: dict[int, int] = {}
    for k, i in enumerate(one):
        where[a[i]] = where.get(a[i], 0) | 1 << k
    full = (1 << len(one)) - 1

    def rows(row: int, begin: int, end: int) -> list[int]:
        out = []
        for j in two[begin:end]:
            met = row & where[b[j]]
            row = ((row + met) | (row - met)) & full
            out.append(row)
        return out

    size = len(one) // 8 + 40
    step = len(two) if len(two) * size <= room else max(1, int(len(two) ** 0.5))
    kept, row = [], full
    for k in range(0, len(two), step):
        kept.append(row)
        if k + step < len(two):
            row = rows(row, k, k + step)[-1]
    found, block = [], -1
    part: list[int] = []

    def grows(j: int, i: int) -> bool:
        """Whether the i-th line adds to the subsequence with the first j + 1 of the other side."""
        nonlocal block, part
        if j // step != block:
            block = j // step
            part = rows(kept[block], block * step, (block + 1) * step)
        return not part[j - block * step] >> i & 1

    j, i = len(two), len(one)
    while j and i:
        if not grows(j - 1, i - 1):
            i -= 1
            continue
        j -= 1
        if not (j and grows(j - 1, i - 1)):
            i -= 1
            found.append((one[i], two[j]))
    return found[::-1]


def _number(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _key(host: str, numbers: list[int], loose: list[bool]) -> bytes:
    return hashlib.blake2b(repr((host, numbers, loose)).encode(), digest_size=16).digest()


_KINDS = {
    # every page whose text depends on other pages may be compared with every other page of its host
    "compared": ("key binary, host string, path string, numbers array<long>, loose array<boolean>", [pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]),
    "settled": ("page_id long, url string, text string", [pa.int64(), pa.string(), pa.string()]),
    "open": ("page_id long, url string, key binary, lines array<string>, places array<int>", [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]),
}


def _read(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages' lines for comparison, texts of pages that need none, or lines and their places of the others."""
    names = [part.split(" ")[0] for part in _KINDS[kind][0].split(", ")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, byte_sizes(whole.column(4)), 8 << 20):
                out = []
                for page_id, url, host, path, page in zip(*(batch.column(k).to_pylist() for k in range(4)), texts(batch.column(4)), strict=True):
                    lines, level = page_lines(page.decode("utf-8", "replace"))
                    loose = [not running for _, _, running in lines]
                    open_ = any(x and of == level for x, (_, of, _) in zip(loose, lines, strict=True))
                    if kind == "settled":
                        if not open_:
                            out.append((page_id, url, "\n".join(t for t, of, _ in lines if of == level)))
                        continue
                    if kind == "open" and not open_:
                        continue
                    numbers = [_number(t) for t, _, _ in lines]
                    key = _key(host, numbers, loose)
                    if kind == "compared":
                        out.append((key, host, path, numbers, loose))
                    else:
                        used = [k for k, (_, of, _) in enumerate(lines) if of == level]
                        out.append((page_id, url, key, [lines[k][0] for k in used], [k if loose[k] else -1 for k in used]))
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS[kind][1], strict=True)], names)

    return run


def _difference(copies: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted ``block, row_number, home, key, host, numbers, loose``: the places of each page's loose lines that a neighbour has too."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "block", 1024):
            rows = table.to_pylist()
            shared: list[set[int]] = [set() for _ in rows]
            for k, (x, y) in enumerate(pairwise(rows)):
                if x["block"] != y["block"] or x["row_number"] + 1 != y["row_number"] or x["host"] != y["host"]:
                    continue
                met = common_lines(x["numbers"], y["numbers"])
                if len(met) >= copies * max(len(x["numbers"]), len(y["numbers"])):
                    continue
                for i, j in met:
                    shared[k].add(i)
                    shared[k + 1].add(j)
            gone = [(x["key"], sorted(i for i in s if x["loose"][i])) for x, s in zip(rows, shared, strict=True) if x["home"]]
            gone = [g for g in gone if g[1]]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in gone], pa.binary()), pa.array([g[1] for g in gone], pa.list_(pa.int32()))], ["key", "gone"])

    return run


def boilerplate(compared: DataFrame, copies: float = 0.8, block: int = 1024) -> DataFrame:
    """``key, gone``: for pages ``key, host, path, numbers, loose``, the places of loose lines that a page next to it by path has too.

    Pages of a host with the same lines are one; the rest are numbered by host
    and path, and go to tasks in blocks of ``block`` rows, with the row before
    and after, so neither a large host nor a task's end parts neighbours.
    """
    once = durable(compared.groupBy("key").agg(F.min(F.struct("host", "path")).alias("at"), F.first("numbers").alias("numbers"), F.first("loose").alias("loose")))
    numbered, _ = number_rows(once.select("at.host", "at.path", "key"), ["host", "path", "key"])
    at, home = F.col("row_number"), F.expr(f"row_number div {int(block)}")
    blocks = numbered.select("host", "key", "row_number", home.alias("own"), F.explode(F.array_distinct(F.transform(F.array(at - 1, at, at + 1), lambda r: F.floor(r / block).cast("long")))).alias("block"))
    rows = blocks.join(once.select("key", "numbers", "loose"), "key")
    dealt = rows.select("block", "row_number", (F.col("own") == F.col("block")).alias("home"), "key", "host", "numbers", "loose")
    return dealt.repartition("block").sortWithinPartitions("block", "row_number").mapInArrow(_difference(copies), "key binary, gone array<int>")


def main_text(pages: DataFrame, copies: float = 0.8) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages`` (``page_id, url, html``; further columns are not read).

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed.  A null or empty page has an empty
    text; a null url belongs to the host without a name.  Pairs of pages that
    share ``copies`` of the longer one's lines or more remove nothing.
    Repeated rows give the same text; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    read = {kind: rows.mapInArrow(_read(kind), schema) for kind, (schema, _) in _KINDS.items()}
    kept = F.filter(F.arrays_zip("lines", "places"), lambda x: (x["places"] < 0) | ~F.array_contains(F.col("gone"), x["places"]))
    opened = read["open"].join(boilerplate(read["compared"], copies).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))), "key", "left")
    opened = opened.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    return read["settled"].unionByName(opened.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["lines"]), "\n").alias("text")))
