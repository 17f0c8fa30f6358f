"""The HTML block table - one struct per element of a page.

The only Python on the extraction path: an Arrow UDF that reads each page once with the
standard-library ``html.parser`` into an array of element structs (start order, end order, depth, tag,
classes, a few attributes, text range) with what the one pass knows besides: the selector rules
(:mod:`selectors`) that the element meets (``rules``), those met by it or anything around it
(``under``), and the number of the nearest item element around it (``item``, 0 for none).  So "is it
dropped", "is it the container" and "which result item is it in" are one number per element, at any
depth.  The rules' use on top is Spark higher-order functions over that array (:mod:`domlanes`), per
row in the JVM with no shuffle.

Text is stored once per page: ``nodes`` holds the page's text nodes
(stripped, empty ones skipped; script / style bodies and comments are not
text; entities decoded) and each element only the range ``[n0, n1)`` of the
nodes below it.  The usual "get text, stripped" of an element is those nodes
joined without a separator (:func:`el_text`), or by newlines as a stand-in
for rendered inner text (:func:`el_lines`) - computed in Spark only for the
elements a rule looks at, so nested wrappers never copy the page's text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from pressroom.operators.selectors import RuleSet

BLOCK = StructType([
    StructField("ord", IntegerType()),
    StructField("tag", StringType()),
    StructField("cls", ArrayType(StringType())),
    StructField("end", IntegerType()),       # order after its last descendant: [ord, end) is the subtree
    StructField("depth", IntegerType()),
    StructField("href", StringType()),
    StructField("prop", StringType()),
    StructField("content", StringType()),
    StructField("itemprop", StringType()),
    StructField("n0", IntegerType()),
    StructField("n1", IntegerType()),
    StructField("rules", LongType()),        # rules that the element meets, a bit each
    StructField("under", LongType()),        # rules met by it or an element around it
    StructField("item", IntegerType()),      # number of the nearest item element around it, from 1; 0: none
])
BLOCKS = ArrayType(BLOCK)
PAGE = StructType([StructField("nodes", ArrayType(StringType())), StructField("els", BLOCKS),
                   StructField("failed", BooleanType())])

# Elements that never hold content, so never stay open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))

#: Bytes of pages that are parsed at once: the elements of so many are what a worker holds, whatever the session's batches hold.
PIECE = 1 << 20

FIELDS = ("ord", "tag", "cls", "end", "depth", "href", "prop", "content", "itemprop", "n0", "n1", "rules", "under", "item")


class _Tokens(HTMLParser):
    """Elements as tuples in FIELDS order (n1 filled when the element closes)."""

    def __init__(self, rules: RuleSet | None = None, item: int = 0):
        super().__init__(convert_charrefs=True)
        self.rules, self.item, self.items = rules, item, 0
        self.carried: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)]   # of open elements: own bits, bits so far, rules so far, item
        self.els: list[list] = []
        self.stack: list[int] = []
        self.texts: list[str] = []
        self.chunks: list[str] = []      # one text node may come in several calls (a bare "<" splits them)
        self.raw = 0

    def _flush(self):
        if self.chunks:
            t = "".join(self.chunks).strip()
            if t:
                self.texts.append(t)
            self.chunks = []

    def _open(self, tag, attrs, void):
        self._flush()
        a = dict(attrs)
        i = len(self.els)
        n = len(self.texts)
        classes = (a.get("class") or "").split()
        parent, above, under, item = self.carried[-1]
        own = rules = 0
        if self.rules is not None:
            own, rules = self.rules.step(tag, classes, a, parent, above)
        self.els.append([i, tag, classes, i + 1 if void else None, len(self.stack),
                         a.get("href"), a.get("property"), a.get("content"), a.get("itemprop"),
                         n, n if void else None, rules, under | rules, item])
        if rules & self.item:
            self.items += 1
            item = self.items
        if not void:
            self.stack.append(i)
            self.carried.append((own, above | own, under | rules, item))
            if tag in RAW:
                self.raw += 1

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        self._flush()
        st = self.stack
        for depth in range(len(st) - 1, -1, -1):
            if self.els[st[depth]][1] == tag:
                n = len(self.texts)
                while len(st) > depth:
                    e = self.els[st.pop()]
                    self.carried.pop()
                    e[3], e[10] = len(self.els), n
                    if e[1] in RAW:
                        self.raw -= 1
                return

    def handle_data(self, data):
        if not self.raw:
            self.chunks.append(data)

    def handle_comment(self, data):
        self._flush()

    def finish(self) -> tuple[list[str], list[list]]:
        self._flush()
        n = len(self.texts)
        for e in self.els:
            if e[10] is None:
                e[3], e[10] = len(self.els), n
        return self.texts, self.els


def parse_page(html: str | None, rules: RuleSet | None = None, item: int = 0) -> tuple[list[str], list[list], bool]:
    """(text nodes, element tuples, whether the tokenizer gave up on the page).  A page it gave
    up on holds what was read so far; no lane takes it for an extracted page."""
    if not html:
        return [], [], False
    p = _Tokens(rules, item)
    try:
        p.feed(html)
        p.close()
        failed = False
    except (AssertionError, ValueError, IndexError):      # what html.parser raises on malformed markup
        failed = True
    return *p.finish(), failed


def parse_blocks(html: str | None) -> list[dict]:
    """Elements as dicts with their text filled in (tests and small inspections)."""
    nodes, els, _ = parse_page(html)
    out = []
    for e in els:
        d = dict(zip(FIELDS, e))
        d["anc"] = [a[0] for a in els[: e[0]] if e[0] < a[3]]
        d["text"] = "".join(nodes[d["n0"]:d["n1"]])
        d["lines"] = "\n".join(nodes[d["n0"]:d["n1"]])
        out.append(d)
    return out


def _list(offsets, values):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def pages_to_arrow(htmls, rules: RuleSet | None = None, item: int = 0) -> pa.StructArray:
    """Parse a batch of pages into the PAGE struct, column by column."""
    n_off, n_val = [0], []
    e_off = [0]
    cols: list[list] = [[] for _ in FIELDS]
    cls_off, cls_val, failed = [0], [], []
    for h in htmls:
        texts, els, bad = parse_page(h, rules, item)
        failed.append(bad)
        n_val.extend(texts)
        n_off.append(len(n_val))
        for e in els:
            for j in (0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
                cols[j].append(e[j])
            cls_val.extend(e[2])
            cls_off.append(len(cls_val))
        e_off.append(len(cols[0]))
    i32, s = pa.int32(), pa.string()
    children = [
        pa.array(cols[0], i32), pa.array(cols[1], s), _list(cls_off, pa.array(cls_val, s)),
        pa.array(cols[3], i32), pa.array(cols[4], i32), pa.array(cols[5], s), pa.array(cols[6], s),
        pa.array(cols[7], s), pa.array(cols[8], s), pa.array(cols[9], i32), pa.array(cols[10], i32),
        pa.array(cols[11], pa.int64()), pa.array(cols[12], pa.int64()), pa.array(cols[13], i32),
    ]
    els = pa.StructArray.from_arrays(children, names=list(FIELDS))
    return pa.StructArray.from_arrays([_list(n_off, pa.array(n_val, s)), _list(e_off, els),
                                       pa.array(failed, pa.bool_())], names=["nodes", "els", "failed"])


def pieces(htmls: pa.Array, max_bytes: int = PIECE) -> Iterator[pa.Array]:
    """A batch of pages cut so that a piece has few bytes (a longer page is a piece of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(htmls), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(htmls):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + max_bytes, "right")))
        yield htmls.slice(i, j - i)
        i = j


def parse_pieces(batches: Iterator[pa.Array], rules: RuleSet | None = None, item: int = 0) -> Iterator[pa.Array]:
    """The PAGE structs of batches of pages, a piece at a time."""
    for b in batches:
        for part in pieces(b):
            yield pages_to_arrow(part.to_pylist(), rules, item)


def html_page(html, rules: RuleSet | None = None, item: tuple[str, str] | None = None) -> Column:
    """struct<nodes: array<string>, els: array<BLOCK>, failed: boolean> of a page.  With ``rules`` elements carry the
    rules they meet; ``item`` names the (outlet, role) whose elements are numbered as items.  Pages are parsed
    and handed on in pieces of some bytes, not a whole batch at a time."""
    bit = rules.bit(*item) if rules is not None and item else 0

    def parse(cols):
        return parse_pieces(cols, rules, bit)

    parse.__annotations__ = {"cols": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(parse, PAGE)(F.col(html) if isinstance(html, str) else html)


def inside(x: Column, container: Column) -> Column:
    """Whether element ``x`` lies below ``container``."""
    return (x["ord"] > container["ord"]) & (x["ord"] < container["end"])


def el_text(nodes: Column, x: Column) -> Column:
    """Text of element ``x``: its text nodes joined without a separator."""
    return F.array_join(F.slice(nodes, x["n0"] + 1, x["n1"] - x["n0"]), "")


def el_lines(nodes: Column, x: Column) -> Column:
    """Text of element ``x`` with one text node per line."""
    return F.array_join(F.slice(nodes, x["n0"] + 1, x["n1"] - x["n0"]), "\n")
