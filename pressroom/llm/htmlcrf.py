"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text and inline markup between block-level tags.  A block is
described by its ancestors' tags and class words and by its text (length, share of linked text,
punctuation, place in the page).  The chain labels every block as article or not: emissions from
these features, transitions between neighbours, trained by gradient steps on labelled pages
(forward-backward) and decoded by Viterbi.  Scripts, styles, templates and the head hold no blocks;
a head without an end tag ends at the first text or tag that cannot stand in it.

The labelled pages are made from the layouts below: each layout places article parts and page
furniture under varying tags and class names, and part of them without any telling name, so that the
field also learns from the text's own shape.

Defined results: null or empty html gives an empty text; a page without article blocks the same;
unclosed tags end with their parent; a ``<`` that begins no tag is text; repeated rows get a row
each; null ids and urls are carried through; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pressroom.llm.common import read, slices

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?/][^>]*>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "template", "noscript", "svg", "title", "textarea", "iframe", "object")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var wbr".split())
_IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_BARE_END = re.compile(r"""=\s*[^\s"'][^\s]*$""")       # an unquoted value takes a slash after it
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag ends an open one of these, within the nearest holder
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre "
                    "section table ul".split())
_HOLDERS = frozenset("ul ol dl table article section div body main aside nav header footer form blockquote td th".split())


@dataclass
class Block:
    text: str
    linked: int         # characters inside links
    path: tuple         # (tag, class words) of the ancestors, outermost first


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    link = linked = at = 0
    head = False

    def flush():
        nonlocal linked, parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not head:
                out.append(Block(text, linked, tuple(x for x in stack if x[0] not in _INLINE)))
            parts = []
        linked = 0

    def leave_head():
        nonlocal head
        flush()
        head = False
        for i, x in enumerate(stack):
            if x[0] == "head":
                del stack[i:]
                break

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            if head and not page[at:end].isspace():
                leave_head()
            parts.append(page[at:end])
            if link:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = 0
            if tag == "head":
                flush()
                head = False
            if tag in _INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i]
                        break
                    if stack[i][0] not in _INLINE:
                        break
                continue
            if any(x[0] == tag for x in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            elif tag in ("p", "br"):
                flush()
            continue
        if head and tag not in _IN_HEAD:
            leave_head()
        if tag in _RAW:
            if tag == "svg" and m[3].endswith("/") and not _BARE_END.search(_QUOTED.sub('""', m[3])):
                continue
            if tag != "noscript" or head:
                close = _RAW[tag].search(page, at)
                at = close.end() if close else at if tag == "noscript" else n
            continue
        if tag in _INLINE:
            if tag == "a":
                link = 1
            if tag not in _VOID:
                stack.append((tag, ()))
            continue
        flush()
        if tag == "head":
            head = True
        ends = _ENDS.get(tag, ())
        if ends or tag in _ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t in ends or (t == "p" and tag in _ENDS_P):
                    del stack[i:]
                    link = 0
                    break
                if t in _HOLDERS:
                    break
        if tag not in _VOID and not m[3].rstrip().endswith("/"):
            names = []
            if m[3]:
                for x in _NAMES.findall(m[3]):
                    names += _PART.findall("".join(x).lower())
            stack.append((tag, tuple(names)))
    flush()
    return out


def features(bs: list[Block]) -> list[list[str]]:
    rows = []
    n = len(bs)
    for i, b in enumerate(bs):
        f = ["bias"]
        tags = [t for t, _ in b.path]
        f += {"in:" + t for t in tags if t not in ("html", "body", "div", "section", "p")}
        f.append("tag:" + (tags[-1] if tags else ""))
        if len(tags) > 1:
            f.append("up:" + tags[-2] + ">" + tags[-1])
        f += {"name:" + w for _, ws in b.path for w in ws}
        size = len(b.text)
        f.append("size:" + str(min(size, 1023).bit_length()))
        share = b.linked / max(size, 1)
        f.append("link:" + ("none" if not b.linked else "some" if share < 0.4 else "most"))
        if b.text[-1] in ".!?:;\"'»”…":
            f.append("stop" if size > 40 else "short stop")
        else:
            f.append("no stop" if size > 40 else "short no stop")
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        f.append("place:" + str(4 * i // n))
        rows.append(f)
    return rows


class Chain:
    """Two labels; weights of (feature, label) and of (label, label)."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.w = np.zeros((len(names), 2))
        self.t = np.zeros((2, 2))

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        get, w = self.index.get, self.w
        out = np.empty((len(rows), 2))
        for i, f in enumerate(rows):
            out[i] = w[[k for k in map(get, f) if k is not None]].sum(axis=0)
        return out

    def decode(self, e: np.ndarray) -> list[int]:
        """Viterbi: the labels of the best path."""
        (t00, t01), (t10, t11) = self.t.tolist()
        e = e.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            p, q = a + t00 >= b + t10, a + t01 >= b + t11
            a, b, c = (a + t00 if p else b + t10) + x, (a + t01 if q else b + t11) + y, (0 if p else 1, 0 if q else 1)
            back.append(c)
        out = [0 if a >= b else 1]
        for c in reversed(back):
            out.append(c[out[-1]])
        return out[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.1, ridge: float = 1e-3, seed: int = 2) -> None:
        order = random.Random(seed)
        pages = [([[self.index[f] for f in r] for r in rows], np.array(y)) for rows, y in pages]
        gw, gt = np.full_like(self.w, 1e-8), np.full_like(self.t, 1e-8)      # squares so far
        for _ in range(epochs):
            order.shuffle(pages)
            for rows, y in pages:
                e = np.array([self.w[r].sum(axis=0) for r in rows])
                n = len(e)
                al, be = np.empty((n, 2)), np.zeros((n, 2))
                al[0] = e[0]
                for i in range(1, n):
                    al[i] = e[i] + np.logaddexp(al[i - 1, 0] + self.t[0], al[i - 1, 1] + self.t[1])
                for i in range(n - 2, -1, -1):
                    s = self.t + (e[i + 1] + be[i + 1])
                    be[i] = np.logaddexp(s[:, 0], s[:, 1])
                z = np.logaddexp(*al[-1])
                p = np.exp(al + be - z)
                d = np.eye(2)[y] - p
                pair = np.zeros((2, 2))
                np.add.at(pair, (y[:-1], y[1:]), 1)
                if n > 1:
                    pair -= np.exp(al[:-1, :, None] + self.t[None] + (e[1:] + be[1:])[:, None, :] - z).sum(axis=0)
                g = np.zeros_like(self.w)
                for r, x in zip(rows, d):
                    g[r] += x
                g -= ridge * self.w
                gw += g * g
                gt += pair * pair
                self.w += rate * g / np.sqrt(gw)
                self.t += rate * pair / np.sqrt(gt)


# ---- labelled pages -------------------------------------------------------------------------------

#: Names under which pages commonly hold furniture and articles.
_FURNITURE = {
    "menu": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs tabs", "header": "header masthead banner topbar branding site-header",
    "footer": "footer site-footer bottom colophon legal copyright", "sidebar": "sidebar aside widget related recommended trending more-stories rail",
    "notice": "cookie consent notice alert gdpr banner popup modal overlay", "advert": "ad ads advert advertisement sponsor sponsored promo adsbygoogle banner-ad",
    "form": "newsletter subscribe signup search login form", "comments": "comments comment-list comment reply discussion respond disqus",
    "share": "share social tags meta byline pagination pager"}
_ARTICLE = "article content post entry main story body text article-body post-content entry-content"


def labelled_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """A made page and its blocks' texts with their labels."""
    g = random.Random(seed)
    rows: list[tuple[str, int]] = []
    anonymous = g.random() < 0.25          # no telling tags and names
    word = lambda: "".join(g.choice("abcdefghiklmnoprstuvwäéñ") for _ in range(g.randint(2, 9)))

    def words(a, b):
        return " ".join(word() for _ in range(g.randint(a, b)))

    def sentence():
        return words(3, 16).capitalize() + g.choice("....!?")

    def block(tag, text, label, inner=None, attrs=""):
        rows.append((text, label))
        return f"<{tag}{attrs}>{inner or html.escape(text)}" + ("" if tag in ("p", "li") and g.random() < 0.1 else f"</{tag}>")

    def links(tag, a, b, lo=1, hi=3):
        out = []
        for _ in range(g.randint(a, b)):
            t = words(lo, hi)
            out.append(block(tag, t, 0, f'<a href="/{word()}">{t}</a>'))
        return "".join(out)

    def wrap(tag, kind, body):
        if anonymous:
            return f"<div>{body}</div>"
        name = g.choice(_FURNITURE[kind].split())
        use = g.random()
        if tag and use < 0.5:
            return f"<{tag}>{body}</{tag}>"
        if tag and use < 0.75:
            return f'<{tag} class="{name}">{body}</{tag}>'
        return f'<div {g.choice(["class", "id"])}="{name}">{body}</div>'

    def some(p):
        return g.random() < p

    def menu():
        return wrap("nav", "menu", "<ul>" + links("li", 3, 8, 1, 2) + "</ul>")

    def header():
        return wrap("header", "header", block(g.choice(["div", "h1", "p"]), words(1, 4), 0) + (block("p", words(3, 8), 0) if some(0.4) else ""))

    def advert():
        return wrap(None, "advert", block("p", " ".join(sentence() for _ in range(g.randint(1, 4))), 0)) if some(0.4) else (
            lambda t: (rows.append((t, 0)), f'<div class="{g.choice(_FURNITURE["advert"].split())}">{t}</div>')[1])(
            " ".join(sentence() for _ in range(g.randint(1, 4))))

    def sidebar():
        return wrap("aside", "sidebar", block("h3", words(1, 3), 0) + "<ul>" + links("li", 2, 6, 3, 8) + "</ul>" + (block("p", sentence(), 0) if some(0.4) else ""))

    def notice():
        return wrap(None, "notice", block("p", sentence() + " " + sentence(), 0) + f"<button>{(lambda t: (rows.append((t, 0)), t)[1])(words(1, 2))}</button>")

    def form():
        t = words(2, 6)
        rows.append((t, 0))
        return f'<form action="/{word()}">{wrap(None, "form", t + "<input name=q>")}</form>'

    def share():
        return wrap(None, "share", block("p", words(2, 5), 0) if some(0.5) else "<ul>" + links("li", 2, 5, 1, 1) + "</ul>")

    def footer():
        t = g.choice(["© ", "&copy; ", "Copyright "]) + words(2, 4) + g.choice([" · ", " &middot; ", ". "]) + " ".join(sentence() for _ in range(g.randint(0, 3)))
        body = "<ul>" + links("li", 1, 5) + "</ul>" if some(0.4) else ""
        text = " ".join(html.unescape(t).split())
        return wrap("footer", "footer", body + (block("p", text, 0, t) if some(0.5) else (rows.append((text, 0)), t)[1])) if not anonymous else (
            f"<div>{body}" + block("p", text, 0, t) + "</div>")

    def comments():
        body = block("h3", words(1, 3), 0)
        for _ in range(g.randint(1, 4)):
            who = words(1, 2)
            body += (block("div", who, 0) + block("p", " ".join(sentence() for _ in range(g.randint(1, 4))), 0))
        return f'<{(t := g.choice(["section", "div"]))} class="{g.choice(_FURNITURE["comments"].split())}">{body}</{t}>'

    def article():
        head = words(3, 10).capitalize() + g.choice(["", "."])
        body = block("h1", head, 1)
        if some(0.3):
            body += share()
        for k in range(g.randint(1, 12)):
            r = g.random()
            if r < 0.75 or not k:
                t = " ".join(sentence() for _ in range(1 if some(0.15) else g.randint(1, 7)))
                if some(0.15):
                    t = words(1, 6).capitalize() + g.choice(["", ".", "***", " |", "%%%", ","])
                inner = html.escape(t)
                if some(0.2):
                    cut = inner.split(" ")
                    i = g.randrange(len(cut))
                    cut[i] = g.choice(['<a href="/x">%s</a>', "<b>%s</b>", "<em>%s</em>"]) % cut[i]
                    inner = " ".join(cut)
                if some(0.15):
                    inner = "<b>" + inner + "<br>"
                body += block("p", t, 1, inner)
            elif r < 0.82:
                body += block(g.choice(["h2", "h3"]), words(2, 7).capitalize(), 1)
            elif r < 0.9:
                body += "<ul>" + "".join(block("li", words(3, 14).capitalize() + g.choice([".", ""]), 1) for _ in range(g.randint(2, 5))) + "</ul>"
            elif r < 0.95:
                body += "<blockquote>" + block("p", sentence(), 1) + "</blockquote>"
            else:
                body += advert()
        if some(0.2):
            body += share()
        if anonymous:
            return f"<div>{body}</div>"
        use = g.random()
        if use < 0.5:
            return f"<article>{body}</article>"
        if use < 0.65:
            return f"<main><article>{body}</article></main>"
        return f'<{(t := g.choice(["div", "main", "section"]))} class="{g.choice(_ARTICLE.split())}">{body}</{t}>'

    page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"
    before = [f for f, p in ((header, 0.5), (notice, 0.3), (menu, 0.85), (form, 0.2), (advert, 0.5), (sidebar, 0.2)) if some(p)]
    after = [f for f, p in ((share, 0.2), (advert, 0.2), (comments, 0.4), (sidebar, 0.4), (form, 0.3), (menu, 0.1), (footer, 0.9), (notice, 0.1)) if some(p)]
    for f in [*before, article, *after]:
        page += f()
    return page + "</body></html>", rows


def train(pages: int = 400) -> Chain:
    data = []
    for seed in range(pages):
        page, rows = labelled_page(seed)
        bs = blocks(page)
        if [b.text for b in bs] != [" ".join(t.split()) for t, _ in rows]:
            raise ValueError(f"labelled page {seed}: blocks differ from labels")
        data.append((features(bs), [k for _, k in rows]))
    count: dict[str, int] = {}
    for rows, _ in data:
        for r in rows:
            for f in r:
                count[f] = count.get(f, 0) + 1
    chain = Chain(sorted(f for f in count))
    chain.train(data)
    return chain


def main_text(page: str | None, chain: Chain) -> str:
    bs = blocks(page or "")
    if not bs:
        return ""
    keep = chain.decode(chain.emissions(features(bs)))
    return " ".join(b.text for b, k in zip(bs, keep) if k)


def extract(pages: DataFrame, chain: Chain, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of the html."""
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, html_col):
            texts = [main_text(p, chain) for p in b.column(b.schema.get_field_index(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(texts, pa.string())],
                                             names=[*keep, "text"])

    return pages.select(*keep, html_col).mapInArrow(run, schema + "text string")


def q_op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"), train())
    return out.withColumn("n_chars", F.length("text").cast("long"))
