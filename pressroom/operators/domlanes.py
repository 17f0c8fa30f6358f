"""DOM lanes (X10-X13, F11, F12, S8, S9) as higher-order functions over the block array.

Which elements an outlet drops, which one is its title, date or body, and what a result item is, are
rows of a rule table (:mod:`selectors`), matched in the one parse of a page.  Here an element's rules are
bits: dropped is "a drop rule is met by it or around it", a body is the first element that meets
the body rule.  All of it is evaluated per page inside the JVM on the array built by
:mod:`htmlblocks`, so a page never leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.functions import text as T
from pressroom.operators.htmlblocks import el_lines, el_text, html_page, inside
from pressroom.operators.selectors import RuleSet

# Per-outlet DOM rules (outlet, role, preference, selector).
RULES = [
    ("folha", "drop", 0, "script, style, nav, footer, header, .c-news__sidebar, .c-related, .c-newsletter, "
                         ".c-paywall, .c-most-read, .c-ad, .c-tags"),
    ("folha", "title", 0, "h1"),
    ("folha", "date", 0, "time"),
    ("folha", "subtitle", 0, "h2.c-news__subtitle, .c-news__subtitle"),
    ("folha", "author", 0, ".c-news__author, .c-signature__author"),
    ("folha", "body", 0, "div.c-news__body, div.c-news__content, article"),
    ("folha", "item", 0, "li.c-headline"),
    ("folha", "item_link", 0, "a[href*='folha.uol.com.br']"),
    ("folha", "item_date", 0, "time, .c-headline__dateline"),
    ("globo", "drop", 0, "script, style, nav, footer, header, aside, .paywall, .newsletter, .related, "
                         ".comments, .social-share, .ad, .tags, .breadcrumb"),
    ("globo", "meta_title", 0, "meta[property='og:title']"),
    ("globo", "meta_text", 0, "meta[property='og:description']"),
    ("globo", "meta_date", 0, "meta[property='article:published_time']"),
    ("globo", "title", 0, "h1"),
    ("globo", "body", 0, "div.article__content-container"),
    ("globo", "body", 1, "div[itemprop='articleBody']"),
    ("globo", "body", 2, "article"),
    ("globo", "body", 3, "div.content"),
    ("piaui", "title", 0, "h1"),
    ("piaui", "body", 0, ".post-content"),
    ("piaui", "body", 1, ".entry-content"),
    ("piaui", "body", 2, "article"),
    ("piaui", "body", 3, ".content-text"),
    ("piaui", "page", 0, "body"),
]
DEFAULT_RULES = RuleSet(RULES)

# Per-outlet skip strings.
FOLHA_SKIP = ["Carregando", "FolhaJus", "Dicas do Editor", "benefício do assinante",
              "assine ou faça login", "ASSINE A FOLHA", "Copiar link", "Salvar para ler",
              "Recurso exclusivo", "Receba no seu email", "A newsletter sobre"]
FOLHA_PHOTO_PREFIX = "https://fotografia.folha"
GLOBO_SKIP = ["carregando", "assine", "assinante", "copiar link", "salvar para ler", "recurso exclusivo",
              "newsletter", "receba no seu email", "leia mais", "continue lendo"]

RESULT_DOMAIN = "folha.uol.com.br"
BODY_TAGS = ("p", "h2", "h3", "h4")
HEADING_TAGS = ("h2", "h3", "h4")


def first(blocks: Column, pred) -> Column:
    """First block (document order) satisfying ``pred``; null when none."""
    return F.try_element_at(F.filter(blocks, pred), F.lit(1))


def alive(blocks: Column, rules: RuleSet, outlet: str) -> Column:
    """blocks that no drop rule meets, neither at them nor around them."""
    return F.filter(blocks, lambda x: ~rules.within(x, outlet, "drop"))


def body_parts(blocks: Column, nodes: Column, container: Column, keep) -> Column:
    """p / h2-h4 descendants of ``container`` passing ``keep``; headings padded by newlines."""
    sel = F.filter(blocks, lambda x: x["tag"].isin(*BODY_TAGS) & inside(x, container))
    texts = F.transform(sel, lambda x: F.struct(x["tag"].alias("tag"), el_text(nodes, x).alias("t")))
    kept = F.filter(texts, lambda y: keep(y["t"]))
    return F.transform(kept, lambda y: F.when(y["tag"].isin(*HEADING_TAGS),
                                              F.concat(F.lit("\n"), y["t"], F.lit("\n"))).otherwise(y["t"]))


def _join(parts: Column) -> Column:
    return T.py_strip(F.array_join(parts, "\n\n"))


def folha_keep(t: Column) -> Column:
    """F11, case-sensitive skip strings and the photo-link prefix."""
    return (F.length(t) >= 10) & ~T.contains_any(t, FOLHA_SKIP) & ~t.startswith(FOLHA_PHOTO_PREFIX)


def globo_keep(t: Column) -> Column:
    """F11, case-insensitive skip strings."""
    return (F.length(t) >= 10) & ~T.contains_any(F.lower(t), GLOBO_SKIP)


def _staged(d: DataFrame, cond: Column, stages: list[tuple[str, Column]]) -> DataFrame:
    """Materialise each stage as a column (only where ``cond``), so later
    stages read it instead of re-evaluating it per element."""
    for name, expr in stages:
        d = d.withColumn(name, F.when(cond, expr))
    return d


def folha_lane(d: DataFrame, cond: Column, rules: RuleSet, b: str = "_b", html: str = "html", n: str = "_n") -> DataFrame:
    """X11 (+ X10 fallback): title, subtitle, author, date, '', body blocks."""
    c = F.col
    tx = lambda x: F.when(x.isNotNull(), el_text(c(n), x))
    one = lambda role: first(c("_f_live"), lambda x: rules.meets(x, "folha", role))
    d = _staged(d, cond, [
        ("_f_live", alive(c(b), rules, "folha")),
        ("_f_body", one("body")),
        ("_f_title", F.coalesce(tx(one("title")), F.lit(""))),
        ("_f_date", tx(one("date"))),
    ])
    head = F.array_compact(F.array(
        F.when(c("_f_title") != "", c("_f_title")), tx(one("subtitle")), tx(one("author")), c("_f_date"), F.lit("")))
    parts = F.when(c("_f_body").isNotNull(), body_parts(c("_f_live"), c(n), c("_f_body"), folha_keep)) \
        .otherwise(F.array(T.html_to_text(c(html))))
    d = _staged(d, cond, [("_f_text", _join(F.concat(head, parts))),
                          ("_f_day", T.pt_dotted_month(F.coalesce(c("_f_date"), F.lit(""))))])
    return _outputs(d, cond, "_f", c("_f_title"), c("_f_day"), c("_f_text"), T.second_chunk(c("_f_text")))


def globo_lane(d: DataFrame, cond: Column, rules: RuleSet, b: str = "_b", html: str = "html", n: str = "_n") -> DataFrame:
    """X12 (+ X10 fallback): og:title or h1, description, date, '', body from
    the first container present in preference order."""
    c = F.col
    tx = lambda x: F.when(x.isNotNull(), el_text(c(n), x))
    one = lambda blocks, role, k=None: first(blocks, lambda x: rules.meets(x, "globo", role, k))
    title = T.first_nonempty(F.coalesce(one(c(b), "meta_title")["content"], F.lit("")),
                             F.coalesce(tx(one(c(b), "title")), F.lit("")))
    date = T.first_nonempty(F.substring(F.coalesce(one(c(b), "meta_date")["content"], F.lit("")), 1, 10),
                            F.substring(F.regexp_extract(c(html), T.DATE_JSON_LD, 1), 1, 10))
    d = _staged(d, cond, [
        ("_g_title", title), ("_g_date", date),
        ("_g_live", alive(c(b), rules, "globo")),
        ("_g_body", F.coalesce(*[one(c("_g_live"), "body", k) for k in rules.ords("globo", "body")])),
    ])
    desc = T.py_strip(F.coalesce(one(c("_g_live"), "meta_text")["content"], F.lit("")))
    head = F.array_compact(F.array(F.when(c("_g_title") != "", c("_g_title")), F.when(F.length(desc) > 30, desc),
                                   F.when(c("_g_date") != "", c("_g_date")), F.lit("")))
    parts = F.when(c("_g_body").isNotNull(), body_parts(c("_g_live"), c(n), c("_g_body"), globo_keep)) \
        .otherwise(F.array(T.html_to_text(c(html))))
    d = _staged(d, cond, [("_g_text", _join(F.concat(head, parts)))])
    return _outputs(d, cond, "_g", c("_g_title"), c("_g_date"), c("_g_text"), T.second_chunk(c("_g_text")))


def piaui_lane(d: DataFrame, cond: Column, rules: RuleSet, b: str = "_b", html: str = "html", n: str = "_n") -> DataFrame:
    """First container with > 200 chars, else the last one found, else the page body."""
    c = F.col
    ln = lambda x: F.when(x.isNotNull(), el_lines(c(n), x))
    one = lambda role, k=None: first(c(b), lambda x: rules.meets(x, "piaui", role, k))
    title = T.py_strip(F.coalesce(ln(one("title")), F.lit("")))
    found = F.array_compact(F.array(*[T.py_strip(ln(one("body", k))) for k in rules.ords("piaui", "body")]))
    d = _staged(d, cond, [("_p_title", title), ("_p_found", found)])
    body = F.coalesce(F.try_element_at(F.filter(c("_p_found"), lambda t: F.length(t) > 200), F.lit(1)),
                      F.try_element_at(c("_p_found"), F.lit(-1)), F.lit(""))
    d = _staged(d, cond, [("_p_body", body)])
    d = _staged(d, cond, [("_p_body", F.when(c("_p_body") == "", F.coalesce(ln(one("page")), F.lit(""))).otherwise(c("_p_body")))])
    text = F.when(c("_p_title") != "", T.py_strip(F.concat(c("_p_title"), F.lit("\n\n"), c("_p_body")))) \
        .otherwise(c("_p_body"))
    return _outputs(d, cond, "_p", c("_p_title"), F.lit(""), text, F.substring(c("_p_body"), 1, 300))


def _outputs(d: DataFrame, cond: Column, prefix: str, title, date, text, summary) -> DataFrame:
    """The lane's four output columns ``{prefix}.title`` ... (null on other lanes)."""
    for name, e in (("title", title), ("date", date), ("text", text), ("summary", summary)):
        d = d.withColumn(f"{prefix}.{name}", F.when(cond, e))
    return d


LANE_FUNCS = {"folha": (folha_lane, "_f"), "globo": (globo_lane, "_g"), "piaui": (piaui_lane, "_p")}


def dom_dispatch(df: DataFrame, lane: str = "lane", html: str = "html", min_chars: str = "min_chars",
                 parsed: str | None = None, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """X18 for DOM lanes: the block array is built once per page, then the lane's rules.

    ``parsed`` names a column already holding :func:`html_page` of the page with the same ``rules``
    (so one parse serves several lanes of the same page).
    """
    cols = [c for c in df.columns if c != parsed]
    d = df if parsed else df.withColumn("_pg", html_page(F.col(html), rules))
    pg = F.col(parsed or "_pg")
    d = d.withColumn("_b", pg["els"]).withColumn("_n", pg["nodes"]).withColumn("_failed", pg["failed"]).drop(parsed or "_pg")
    lane_c = F.col(lane)
    for name, (fn, _) in LANE_FUNCS.items():
        d = fn(d, lane_c == name, rules, "_b", html, "_n")
    pick = {k: F.coalesce(*[F.col(f"`{p}.{k}`") for _, p in LANE_FUNCS.values()])
            for k in ("title", "date", "text", "summary")}
    d = d.select(*cols, "_failed", *[v.alias(k) for k, v in pick.items()])
    t = F.col("text")
    ok = ~F.col("_failed") & (t != "") & (F.length(t) >= F.col(min_chars)) & (F.col(html) != "")
    return d.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_failed")


def dom_each(df: DataFrame, lanes: str = "_lanes", html: str = "html", parsed: str = "_pg", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """X18 for pages that several DOM lanes ask for: the page's row meets all its lanes, so neither the page nor its
    parse (column ``parsed``: :func:`html_page` with the same ``rules``) is repeated for each.

    ``lanes`` holds structs with ``lane`` and ``min_chars``; a row comes out for each of them.  If they have a
    ``first`` (a value in whose order the page's lanes are asked), only the first lane that is ``ok`` brings its
    text and summary; the others' are null, as no one reads them.
    """
    cols = [c for c in df.columns if c not in (lanes, html, parsed)]
    pg = F.col(parsed)
    d = df.withColumn("_b", pg["els"]).withColumn("_n", pg["nodes"]).withColumn("_failed", pg["failed"]).drop(parsed)
    for name, (fn, _) in LANE_FUNCS.items():
        d = fn(d, F.array_contains(F.col(lanes)["lane"], name), rules, "_b", html, "_n")
    keys = ("title", "date", "text", "summary")
    had = [F.col(f"`{p}.{k}`") for _, p in LANE_FUNCS.values() for k in keys]
    d = d.select(*cols, lanes, (~F.col("_failed") & (F.col(html) != "")).alias("_page"), *had)

    def of(lane: Column, k: str) -> Column:
        return F.coalesce(*[F.when(lane == name, F.col(f"`{p}.{k}`")) for name, (_, p) in LANE_FUNCS.items()])

    def ok(x: Column) -> Column:
        return F.coalesce(F.col("_page") & (of(x["lane"], "text") != "") & (F.length(of(x["lane"], "text")) >= x["min_chars"]), F.lit(False))

    ranked = "first" in df.schema[lanes].dataType.elementType.names
    best = F.array_min(F.transform(F.filter(lanes, ok), lambda x: x["first"])) if ranked else F.lit(True)
    x = F.col("_x")
    # the lanes' columns are made before the rows multiply, and are read by plain columns only
    d = d.withColumn("_best", best).select(*cols, "_page", "_best", *had, F.explode(lanes).alias("_x"))
    d = d.select(*cols, x["lane"].alias("lane"), x["min_chars"].alias("min_chars"), *[of(x["lane"], k).alias(k) for k in keys],
                 ok(x).alias("ok"), *([(x["first"] <= F.col("_best")).alias("_read")] if ranked else []))
    if ranked:
        for k in ("text", "summary"):
            d = d.withColumn(k, F.when(F.col("ok") & F.col("_read"), F.col(k)))
        d = d.drop("_read")
    return d


def links(pages: DataFrame, html: str = "html", rules: RuleSet = DEFAULT_RULES, item: tuple[str, str] = ("folha", "item")) -> DataFrame:
    """The link table of captured pages, one parse each: every ``<a href>`` in document order with its
    decoded href, its text and the number of the result item around it (0: none)."""
    keep = [c for c in pages.columns if c != html]
    d = pages.select(*keep, html_page(F.col(html), rules, item).alias("_pg"))
    d = d.select(*keep, F.col("_pg.nodes").alias("_n"), F.filter("_pg.els", lambda x: (x["tag"] == "a") & x["href"].isNotNull()).alias("_a"))
    d = d.select(*keep, F.posexplode(F.transform("_a", lambda x: F.struct(
        x["href"].alias("href"), el_text(F.col("_n"), x).alias("title"), x["item"].alias("item"), x["ord"].alias("ord")))).alias("a_pos", "_x"))
    return d.select(*keep, (F.col("a_pos") + 1).cast("long").alias("a_pos"), "_x.*")


def result_items(pages: DataFrame, html: str = "html", rules: RuleSet = DEFAULT_RULES, outlet: str = "folha",
                 domain: str = RESULT_DOMAIN) -> DataFrame:
    """Result-list items -> (item_pos, url, title, date).

    The parse gives every element the number of the item around it, so a page costs its length,
    whatever number of items it has.  Links and dates are combined per item by a grouped aggregate: href / title
    are the last non-empty ones among the item's links to the domain (document order), the date
    the first date element.
    """
    keep = [c for c in pages.columns if c != html]
    d = pages.select(*keep, html_page(F.col(html), rules, (outlet, "item")).alias("_pg"))
    d = d.select(*keep, F.col("_pg.els").alias("_b"), F.col("_pg.nodes").alias("_n"))
    is_link, is_date = (lambda x, r=r: rules.meets(x, outlet, r) for r in ("item_link", "item_date"))
    cand = F.filter("_b", lambda x: (x["item"] > 0) & (is_link(x) | is_date(x)))
    e = d.select(*keep, F.explode(F.transform(cand, lambda x: F.struct(
        x["item"].alias("item_pos"), x["ord"].alias("ord"), is_link(x).alias("is_link"), is_date(x).alias("is_date"),
        x["href"].alias("href"), el_text(F.col("_n"), x).alias("text")))).alias("x")).select(*keep, "x.*")
    g = e.groupBy(*keep, "item_pos").agg(
        F.max_by(F.when(F.col("is_link") & (F.col("href") != ""), F.col("href")),
                 F.when(F.col("is_link") & (F.col("href") != ""), F.col("ord"))).alias("href"),
        F.max_by(F.when(F.col("is_link") & (F.col("text") != ""), F.col("text")),
                 F.when(F.col("is_link") & (F.col("text") != ""), F.col("ord"))).alias("title"),
        F.min_by(F.when(F.col("is_date"), F.col("text")), F.when(F.col("is_date"), F.col("ord"))).alias("date_str"))
    g = g.where(F.col("href").isNotNull() & F.col("title").isNotNull() & F.col("href").contains(domain))
    return g.select(*keep, F.col("item_pos").cast("long").alias("item_pos"),
                    T.url_drop_query(F.col("href")).alias("url"), F.col("title"),
                    T.pt_dotted_month(F.coalesce(F.col("date_str"), F.lit(""))).alias("date"))
