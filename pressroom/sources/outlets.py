"""The outlet dimension (S14) and outlet selection (F8).

An outlet is data: one row of ``outlets`` plus the extraction lane its key
names.  The table is tiny (one row per outlet) and is always broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.schemas import OUTLETS

# The registered outlets, in registry order.
# key, name, domain, status, search kind, minimum text length, lane
OUTLET_ROWS = [
    ("conjur", "Conjur", "conjur.com.br", "working", "google_news", 300, "meta"),
    ("migalhas", "Migalhas", "migalhas.com.br", "working", "native", 300, "meta"),
    ("estadao", "Estadao", "estadao.com.br", "working", "rss", 200, "paragraph"),
    ("globo", "O Globo", "oglobo.globo.com", "working", "sitemap", 300, "globo"),
    ("folha", "Folha de S.Paulo", "folha.uol.com.br", "working", "native", 300, "folha"),
    ("piaui", "piaui", "piaui.folha.uol.com.br", "rss_only", "sitemap", 200, "piaui"),
]
GENERIC_MIN_CHARS = 200

# How each outlet is searched, one row for each captured kind of body that it reads, in order.
# outlet, kind of body, item (how a body gives items), pattern, sections, base, domain, keywords (field that
# must hold query tokens: '' none, url one, title two or all), exclude, per_page (items of a feed for each page
# asked for), flags (paged: pages 1..n only; distinct: first seen per URL; stop: at a page that adds
# nothing; years: only bodies that the index names for the last n years; wrapped: links are resolved;
# labelled: items keep title and date).
SEARCH_ROWS = [
    ("conjur", "rss", "rss", "", "", "", "conjur.com.br", "", "", 25, "wrapped labelled"),
    ("migalhas", "results", "link", "", "/quentes/ /depeso/", "https://www.migalhas.com.br", "migalhas.com.br", "", "", 0,
     "paged distinct stop labelled"),
    ("estadao", "rss", "rss_strict", "", "", "", "", "title", "/pulsa/ /web-stories/ /nutricao/", 0, "distinct"),
    ("estadao", "topic", "href", r'href="(https://www\.estadao\.com\.br/(?:politica|brasil|economia)/[^"]+)"', "", "", "", "url", "", 0,
     "distinct"),
    ("globo", "sitemap", "loc", r"<loc>(https://oglobo\.globo\.com/[^<]+)</loc>", "", "", "", "url", "", 0, "distinct years"),
    ("folha", "results", "result", "", "", "", "folha.uol.com.br", "", "", 0, "paged stop labelled"),
    ("piaui", "sitemap", "loc", r"<loc>[\t\n\x0B\f\r ]*(https?://[^<]+)[\t\n\x0B\f\r ]*</loc>", "", "", "", "url", "", 0, ""),
]
SEARCH = ("outlet string, kind string, item string, pattern string, sections string, base string, domain string, keywords string, "
          "exclude string, per_page int, flags string")

# URL-slug keywords the sitemap outlet scans for when none are given.
DEFAULT_URL_KEYWORDS = [
    "filhotismo", "nepotismo", "parente", "parentesco",
    "impedimento", "suspeicao",
    "venda-sentenca", "venda-decisao",
    "corrupcao-tribunal", "corrupcao-judiciario",
    "operacao-faroeste", "operacao-naufragio", "sisamnes",
    "banco-master",
]


def outlet_rows(rows=OUTLET_ROWS) -> list[tuple]:
    return [(k, i + 1, n, d, s, q, m, lane) for i, (k, n, d, s, q, m, lane) in enumerate(rows)]


def outlets_df(spark: SparkSession, rows=OUTLET_ROWS) -> DataFrame:
    """The dimension: key, ord, name, domain, status, search, min_chars, lane."""
    return spark.createDataFrame(outlet_rows(rows), OUTLETS)


def search_rules_df(spark: SparkSession, rows=SEARCH_ROWS) -> DataFrame:
    """The search rules as a table; ``src`` is a row's place among those of its outlet."""
    seen: dict[str, int] = {}
    out = []
    for r in rows:
        seen[r[0]] = seen.get(r[0], 0) + 1
        out.append((*r, seen[r[0]]))
    return spark.createDataFrame(out, SEARCH + ", src int")


def list_status(outlets: DataFrame) -> DataFrame:
    """name, status, search in registry order."""
    return outlets.orderBy("ord").select("name", "status", "search")


def parse_selection(requested) -> F.Column:
    """'a, B,,c' -> ['a','b','c'] (names stripped and lower-cased)."""
    from pressroom.functions.text import py_strip

    parts = F.split(requested if isinstance(requested, F.Column) else F.lit(requested), ",")
    return F.filter(F.transform(parts, lambda p: F.lower(py_strip(p))), lambda p: p != "")


def select_outlets(outlets: DataFrame, requested: str | None = None) -> DataFrame:
    """F8: requested keys (or all), unknown and disabled dropped, in registry order.

    The reference walks the requested list, so a key named twice is run twice
    and the request order is kept; ``sel_ord`` is that position.
    """
    live = outlets.where(F.col("status") != "disabled")
    if requested is None:
        return live.withColumn("sel_ord", F.col("ord"))
    spark = outlets.sparkSession
    req = (spark.range(1)
           .select(F.posexplode(parse_selection(requested)).alias("sel_ord", "key"))
           .withColumn("sel_ord", F.col("sel_ord") + 1))
    return F.broadcast(live).join(req, "key").select(*live.columns, "sel_ord")
