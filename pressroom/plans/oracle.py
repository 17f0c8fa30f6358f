"""DuckDB statements of the catalog queries (the correctness oracle)."""

from __future__ import annotations

from pressroom.plans import sqltext as S
from pressroom.plans.catalog import FEED_MARK


def regex_lanes_sql(src: str) -> str:
    """Lane columns for rows of ``src`` (url, lane, min_chars, html) in SQL."""
    ps = S.paragraphs("html")
    return f"""
    e1 AS (SELECT *, CASE WHEN lane = 'paragraph' THEN {ps} END AS ps FROM {src}),
    e2 AS (SELECT *, {S.body_slice('ps')} AS body FROM e1),
    e3 AS (SELECT *, CASE WHEN lane = 'paragraph' THEN array_to_string(body, chr(10) || chr(10))
                          WHEN lane IN ('meta', 'generic') THEN {S.html_to_text('html')} END AS text FROM e2),
    lanes AS (SELECT url, lane, min_chars, html, text,
        CASE WHEN lane = 'meta' THEN {S.first_nonempty(S.meta_property('html', 'og:title'), S.title_tag('html', (' - ', ' | ')))}
             WHEN lane = 'paragraph' THEN {S.first_nonempty(S.meta_property('html', 'og:title'), S.title_tag('html', (' - ',)))}
             ELSE '' END AS title,
        CASE WHEN lane = 'meta' THEN {S.page_date('html', True)}
             WHEN lane = 'paragraph' THEN {S.page_date('html', False)} ELSE '' END AS date,
        CASE WHEN lane = 'meta' THEN {S.lines_summary('text')}
             WHEN lane = 'paragraph' THEN substring(array_to_string(list_slice(body, 1, 2), ' '), 1, 300)
             WHEN lane = 'generic' THEN substring(text, 1, 300) END AS summary,
        coalesce(CASE WHEN lane = 'paragraph' THEN len(ps) >= 3 AND length(text) >= min_chars
             WHEN lane IN ('meta', 'generic') THEN length(text) >= min_chars ELSE false END, false)
             AND html <> '' AS ok
      FROM e3)"""


COLLECT_STUBS = f"""
    stubs AS (
      SELECT 'conjur' AS outlet_key, 1 AS sel_ord, 'Conjur' AS outlet_name, 'meta' AS lane, 300 AS min_chars,
             1 AS page_no, page_id AS stub_ord, url, 'stub ' || page_id AS title, '' AS date
        FROM pages WHERE starts_with(url, 'https://')
      UNION ALL
      SELECT 'migalhas', 2, 'Migalhas', 'meta', 300, 1, page_id, url, 'stub ' || page_id, ''
        FROM pages WHERE contains(url, '/en/')
      UNION ALL
      SELECT 'estadao', 3, 'Estadao', 'paragraph', 200, 1, page_id, url, 'stub ' || page_id, '' FROM pages),
    store AS (SELECT page_id + 1 AS row_num, url FROM pages WHERE contains(url, '{FEED_MARK}')),
    known AS (SELECT DISTINCT url AS kurl FROM store WHERE url <> ''),
    s AS (SELECT stubs.*, kurl IS NOT NULL AS in_store FROM stubs LEFT JOIN known ON stubs.url = known.kurl),
    keys AS (SELECT DISTINCT s.url, lane, min_chars, coalesce(p.html, '') AS html
               FROM s LEFT JOIN pages p ON s.url = p.url WHERE NOT in_store),"""

COLLECT_CORE = COLLECT_STUBS + regex_lanes_sql("keys") + """,
    c AS (SELECT s.*, coalesce(l.ok, false) AND NOT s.in_store AS ok,
                 """ + S.first_nonempty("l.title", "s.title") + """ AS a_title,
                 """ + S.first_nonempty("l.date", "s.date") + """ AS a_date,
                 l.summary, l.text
            FROM s LEFT JOIN lanes l ON s.url = l.url AND s.lane = l.lane AND s.min_chars = l.min_chars),
    w AS (SELECT url, sel_ord AS w_sel, page_no AS w_page, stub_ord AS w_stub FROM (
            SELECT *, row_number() OVER (PARTITION BY url ORDER BY sel_ord, page_no, stub_ord) AS rn
              FROM c WHERE ok) WHERE rn = 1),
    cw AS (SELECT c.*, c.ok AND w.w_sel = c.sel_ord AND w.w_page = c.page_no AND w.w_stub = c.stub_ord AS is_winner,
                  NOT c.in_store AND (w.w_sel IS NULL OR w.w_sel >= c.sel_ord) AS is_new
             FROM c LEFT JOIN w ON c.url = w.url),
    base AS (SELECT coalesce(max(row_num), 0) + 1 AS b FROM store)"""


def collect_flagship() -> str:
    return "WITH " + COLLECT_CORE + """
    SELECT (SELECT b FROM base) + row_number() OVER (ORDER BY sel_ord, page_no, stub_ord) - 1 AS row_num,
           a_date AS date, outlet_name AS outlet, a_title AS title, url, '' AS theme,
           coalesce(summary, '') AS summary, 'no' AS paywalled, nullif(text, '') AS text
      FROM cw WHERE is_winner"""


def commit_recovery() -> str:
    return (f"SELECT 'article' AS kind, url AS name, row_num AS a, coalesce(length(text), 0) AS b, 0::BIGINT AS c FROM ({collect_flagship()})"
            f" UNION ALL SELECT 'outlet', outlet, hits, new, added FROM ({collect_counts()}) WHERE outlet <> '__total__'"
            " UNION ALL SELECT 'run', 'run', 1, 0, 0")


THEME_TABLE = """
    words AS (SELECT DISTINCT p_brand AS theme, unnest(string_split(lower(p_name), ' ')) AS w FROM part),
    kw AS (SELECT DISTINCT theme, CAST(substr(theme, 7, 2) AS INT) AS theme_ord, unnest([w, left(w, 3)]) AS keyword FROM words WHERE w <> ''),
    one AS (SELECT DISTINCT keyword FROM kw),
    low AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents),
    hit AS (SELECT DISTINCT doc_id, keyword FROM low, one WHERE contains(t, keyword)),
    score AS (SELECT doc_id, theme, theme_ord, count(*) AS n FROM hit JOIN kw USING (keyword) GROUP BY ALL)"""


def theme_table() -> str:
    return f"WITH {THEME_TABLE} SELECT doc_id, theme, theme_ord, n FROM score"


def theme_table_guess() -> str:
    return (f"WITH {THEME_TABLE}, best AS (SELECT doc_id, theme FROM score"
            " QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, theme_ord, theme) = 1)"
            " SELECT d.doc_id, coalesce(best.theme, '') AS theme FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best USING (doc_id)")


def para_extract() -> str:
    return ("WITH src AS (SELECT page_id, url, 'paragraph' AS lane, 200 AS min_chars, coalesce(html, '') AS html FROM pages),"
            + regex_lanes_sql("src").replace("SELECT url, lane", "SELECT page_id, url, lane")
            + " SELECT page_id, title, date, text, summary, ok FROM lanes")


def html_text() -> str:
    return f"SELECT page_id, {S.html_to_text('html')} AS text FROM pages"


def generic_lane() -> str:
    return ("WITH src AS (SELECT page_id, url, 'generic' AS lane, 200 AS min_chars, coalesce(html, '') AS html FROM pages),"
            + regex_lanes_sql("src").replace("SELECT url, lane", "SELECT page_id, url, lane")
            + f" SELECT page_id, url, {S.url_host('url', False)} AS outlet, title, date, summary,"
              " CAST(length(text) AS BIGINT) AS n_chars FROM lanes WHERE ok")


def title_tag() -> str:
    return (f"SELECT page_id, {S.title_tag('html', (' - ', ' | '))} AS title_a, "
            f"{S.title_tag('html', (' - ',))} AS title_b FROM pages")


def url_clean() -> str:
    path = "regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1)"
    return (f"SELECT page_id, {S.url_fetch_clean(chr(39) + ' ' + chr(39) + ' || url || ' + chr(39) + '/ ' + chr(39))} AS fetch_url, "
            f"split_part(url, '?', 1) AS no_query, "
            f"CASE WHEN starts_with({path}, '/') THEN 'https://www.migalhas.com.br' || {path} ELSE {path} END AS absolute, "
            f"{S.url_store_clean(chr(39) + ' ' + chr(34) + chr(39) + ' || url || ' + chr(39) + chr(34) + ' ' + chr(39))} AS store_url "
            f"FROM pages")


# ------------------------------------------------------------------ routing and lanes

def _route_sql(url: str, mode: str) -> str:
    from pressroom.plans.catalog import TEST_REGISTRY

    host = S.url_host(url)
    if mode == "first":
        arms = [f"WHEN contains({host}, {S.q(d)}) THEN {S.q(k)}" for k, d, _ in TEST_REGISTRY]
    else:
        ranked = sorted(enumerate(TEST_REGISTRY), key=lambda x: (-len(x[1][1]), x[0]))
        arms = [f"WHEN {host} = {S.q(d)} OR ends_with({host}, {S.q('.' + d)}) THEN {S.q(k)}"
                for _, (k, d, _) in ranked]
    return "(CASE " + " ".join(arms) + " END)"


def route_host() -> str:
    return (f"SELECT page_id, {S.url_host('url')} AS host, {_route_sql('url', 'first')} AS outlet_first, "
            f"{_route_sql('url', 'longest')} AS outlet_longest FROM pages")


def route_table() -> str:
    host = "lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
    return f"""
    WITH h AS (SELECT page_id, {host} AS host FROM pages),
    dom AS (SELECT DISTINCT unnest([host, regexp_extract(host, '([^.]*[.])?[^.]*$'), 'x.' || host]) AS domain FROM h),
    reg AS (SELECT 'k:' || domain AS key, domain, CASE WHEN length(domain) % 2 = 0 THEN -length(domain) ELSE length(domain) END AS ord FROM dom WHERE domain <> ''),
    one AS (SELECT DISTINCT host FROM h WHERE host <> ''),
    f AS (SELECT host, key FROM one JOIN reg ON contains(host, domain) QUALIFY row_number() OVER (PARTITION BY host ORDER BY ord, key) = 1),
    l AS (SELECT host, key FROM one JOIN reg ON host = domain OR ends_with(host, '.' || domain)
          QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(domain) DESC, ord, key) = 1)
    SELECT h.page_id, f.key AS first_key, l.key AS longest_key FROM h LEFT JOIN f ON f.host = h.host LEFT JOIN l ON l.host = h.host"""


def lane_dispatch() -> str:
    from pressroom.plans.catalog import TEST_REGISTRY

    lane_case = "(CASE " + " ".join(f"WHEN r = {S.q(k)} THEN {S.q(ln)}" for k, _, ln in TEST_REGISTRY) + " END)"
    return ("WITH r0 AS (SELECT page_id, url, coalesce(html, '') AS html, " + _route_sql("url", "first") + " AS r FROM pages),"
            " src AS (SELECT page_id, url, html, coalesce(" + lane_case + ", 'generic') AS lane FROM r0),"
            " src2 AS (SELECT page_id, url, lane, CASE WHEN lane = 'meta' THEN 300 ELSE 200 END AS min_chars, html FROM src),"
            + regex_lanes_sql("src2").replace("SELECT url, lane", "SELECT page_id, url, lane")
            + " SELECT page_id, lane, title, date, summary, ok, CAST(length(text) AS BIGINT) AS n_chars FROM lanes")


# ------------------------------------------------------------------ feeds and sitemaps

DOC_FEEDS = """
    f AS (SELECT doc_id, '<rss><channel>' || array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
        '<item><title>' || CASE WHEN contains(line, ',') THEN '<![CDATA[ ' || line || ' ]]>'
                                ELSE line END || '</title>'
        || CASE WHEN length(line) >= 40 THEN '<link>https://www.' || source || '.example.com/' || lang || '/'
                || CAST(doc_id AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR) || '</link>' ELSE '' END
        || '<pubDate>' || CASE WHEN contains(line, '?') THEN 'not a date'
              ELSE strftime(DATE '2024-01-01' + CAST(doc_id + i - 1 AS INTEGER), '%a, %d %b %Y') || ' 23:30:00 -0300' END
        || '</pubDate>'
        || CASE WHEN contains(line, '.') THEN '<source url="https://x.example">' || source || '</source>' ELSE '' END
        || '</item>'), '') || '</channel></rss>' AS xml FROM documents)"""

ITEM = S.q(r"(?s)<item>(.*?)</item>")


def _items(limit: str | None) -> str:
    lst = f"regexp_extract_all(xml, {ITEM}, 1)"
    if limit:
        lst = f"list_slice({lst}, 1, {limit})"
    return (f" it AS (SELECT doc_id, unnest(l) AS item, CAST(generate_subscripts(l, 1) AS BIGINT) AS item_pos "
            f"FROM (SELECT doc_id, {lst} AS l FROM f)),"
            f" fl AS (SELECT doc_id, item_pos, {S.clean(S.tag_text('item', 'title'))} AS title, "
            f"{S.tag_text('item', 'link')} AS url, {S.rfc822_day(S.tag_text('item', 'pubDate'))} AS date, "
            f"{S.first_nonempty(S.source_text('item'), S.q('site.example'))} AS source FROM it)")


def rss_items() -> str:
    return "WITH " + DOC_FEEDS + "," + _items("25") + " SELECT doc_id, item_pos, title, url, date, source FROM fl WHERE url <> ''"


def feed_top_n() -> str:
    return ("WITH " + DOC_FEEDS + "," + _items("50") + " SELECT doc_id, count(*) AS kept, max(item_pos) AS last_pos "
            "FROM fl WHERE url <> '' GROUP BY doc_id")


def rss_strict() -> str:
    from pressroom.functions.text import lit_regex  # noqa: F401
    from pressroom.plans.catalog import STRICT_QUERY
    from pressroom.sources.feeds import STRICT_LINK_RX, STRICT_TITLE_RX

    kws = S.query_tokens(S.q(STRICT_QUERY))
    need = f"greatest(1, least(2, len({kws})))"
    return ("WITH " + DOC_FEEDS + ","
            f" it AS (SELECT doc_id, unnest(l) AS item, CAST(generate_subscripts(l, 1) AS BIGINT) AS item_pos "
            f"FROM (SELECT doc_id, regexp_extract_all(xml, {ITEM}, 1) AS l FROM f)),"
            f" st AS (SELECT doc_id, item_pos, regexp_extract(item, {S.q(STRICT_TITLE_RX)}, 1) AS title, "
            f"regexp_extract(item, {S.q(STRICT_LINK_RX)}, 1) AS url, regexp_matches(item, {S.q(STRICT_TITLE_RX)}) AS has_t FROM it)"
            f" SELECT doc_id, item_pos, title, url FROM st WHERE has_t AND url <> '' "
            f"AND NOT (contains(url, '/de/') OR contains(url, '/es/')) "
            f"AND {S.keyword_hits('lower(title)', kws)} >= {need}")


def sitemap_years() -> str:
    from pressroom.sources.feeds import SITEMAP_INDEX_RX

    d = "strftime(o_orderdate, '%Y/%m/%d')"

    def loc(host, n):
        return f"'<sitemap><loc>https://{host}/sitemap/oglobo/' || {d} || '_' || CAST({n} AS VARCHAR) || '.xml</loc></sitemap>'"

    xml = (f"'<sitemapindex>' || {loc('oglobo.globo.com', 'o_custkey')} || {loc('other.example.com', 'o_orderkey')} "
           f"|| {loc('oglobo.globo.com', 'o_orderkey')} || '</sitemapindex>'")
    full = SITEMAP_INDEX_RX.replace("<loc>(", "^(").replace(")</loc>", ")$")
    return (f"WITH x AS (SELECT o_orderkey, regexp_extract_all({xml}, {S.q(SITEMAP_INDEX_RX)}, 1) AS l FROM orders),"
            f" u AS (SELECT o_orderkey, unnest(l) AS loc, CAST(generate_subscripts(l, 1) AS BIGINT) AS loc_pos FROM x)"
            f" SELECT o_orderkey, loc_pos, loc, CAST(regexp_extract(loc, {S.q(full)}, 2) AS INTEGER) AS year FROM u"
            f" WHERE CAST(regexp_extract(loc, {S.q(full)}, 2) AS INTEGER) BETWEEN 1996 AND 1999")


def sitemap_urls() -> str:
    from pressroom.plans.catalog import SITEMAP_KEYWORDS
    from pressroom.sources.feeds import SITEMAP_ANY_RX, SITEMAP_HOST_RX

    path = "regexp_extract(url, '^[A-Za-z]+://[^/]+(/[^?#]*)', 1)"
    xml = (f"'<urlset><url><loc>  ' || url || ' </loc></url><url><loc>https://oglobo.globo.com' || {path} "
           f"|| '</loc></url><url><loc>ftp://x.example/a</loc></url></urlset>'")
    kws = S.kw_list(SITEMAP_KEYWORDS)
    parts = []
    for kind, rx in (("host", SITEMAP_HOST_RX), ("any", SITEMAP_ANY_RX)):
        parts.append(
            f"SELECT page_id, '{kind}' AS kind, loc_pos, url FROM (SELECT page_id, unnest(l) AS url, "
            f"CAST(generate_subscripts(l, 1) AS BIGINT) AS loc_pos FROM (SELECT page_id, "
            f"regexp_extract_all({xml}, {S.q(rx)}, 1) AS l FROM pages)) WHERE {S.any_keyword('lower(url)', kws)}")
    return " UNION ALL ".join(parts)


def topic_links() -> str:
    from pressroom.plans.catalog import TOPIC_QUERY
    from pressroom.sources.feeds import TOPIC_RX

    lang = "regexp_extract(url, '/(en|fr|es|de)/', 1)"
    sec = (f"(CASE WHEN {lang} = 'en' THEN 'politica' WHEN {lang} = 'fr' THEN 'brasil' "
           f"WHEN {lang} = 'es' THEN 'economia' ELSE 'esportes' END)")
    num = "regexp_extract(url, '/([0-9]+)', 1)"
    link = f"'<a href=\"https://www.estadao.com.br/' || {sec} || '/' || {S.url_host('url')} || '/' || {num} || '/\">x</a>'"
    short = f"'<a href=\"https://www.estadao.com.br/' || {sec} || '/' || {num} || '\">y</a>'"
    all_ = f"regexp_extract_all({link} || {short} || {link}, {S.q(TOPIC_RX)}, 1)"
    dist = f"list_filter({all_}, lambda x, i: list_position({all_}, x) = i)"
    kws = S.query_tokens(S.q(TOPIC_QUERY))
    return (f"SELECT page_id, link_pos, url FROM (SELECT page_id, unnest(l) AS url, "
            f"CAST(generate_subscripts(l, 1) AS BIGINT) AS link_pos FROM (SELECT page_id, {dist} AS l FROM pages)) "
            f"WHERE {S.slash_count('url')} >= 5 AND {S.any_keyword('lower(url)', kws)}")


def url_list() -> str:
    from pressroom.plans.catalog import LITERAL_URLS

    content = ("concat_ws(chr(10), url, '# seen ' || url, '', '  # ' || CAST(page_id AS VARCHAR), "
               "'  ' || url || '/  ')")
    inline = " UNION ALL ".join(
        f"SELECT CAST(-1 AS BIGINT) AS page_id, CAST({i + 1} AS BIGINT) AS line_no, {S.q(u)} AS line"
        for i, u in enumerate(LITERAL_URLS))
    return (f"WITH l AS (SELECT page_id, unnest(x) AS line, CAST(generate_subscripts(x, 1) AS BIGINT) AS line_no "
            f"FROM (SELECT page_id, string_split({content}, chr(10)) AS x FROM pages)),"
            f" k AS (SELECT page_id, line_no, line FROM l WHERE {S.strip('line')} <> '' AND NOT starts_with(line, '#')"
            f" UNION ALL {inline})"
            f" SELECT page_id, line_no, {S.url_fetch_clean(S.strip('line'))} AS url FROM k")


def html_blocks() -> str:
    """The elements by a stack of open tags carried over the tokens of a page, one token a step."""
    void = ", ".join(f"'{t}'" for t in "area base br col embed hr img input link meta param source track wbr".split())
    token = r"(?s)<!--.*?-->|<![^>]*>|<(?:script|style)[^>]*>.*?</(?:script|style)>|</?[a-zA-Z][^>]*>|[^<]+|<"
    last = "len(stack) + 1 - list_position(list_reverse(list_transform(stack, lambda x: x.tag)), k.tag)"
    # an entity of the test pages stands for one character
    return f"""
    WITH RECURSIVE t AS (SELECT page_id, unnest(x) AS tok, CAST(generate_subscripts(x, 1) AS BIGINT) AS i
      FROM (SELECT page_id, regexp_extract_all(html, {S.q(token)}) AS x FROM pages)),
    k AS MATERIALIZED (SELECT page_id, i, lower(regexp_extract(tok, '^</?([a-zA-Z][^ \t\n/>]*)', 1)) AS tag,
      CASE WHEN starts_with(tok, '<!') THEN 'skip' WHEN starts_with(tok, '</') THEN 'close'
           WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 'open' ELSE 'text' END AS kind,
      length({S.strip("regexp_replace(tok, '&(amp|quot|copy|middot|lt|gt);?', 'x', 'g')")}) AS n FROM t),
    g AS (SELECT page_id, 0::BIGINT AS i, CAST([] AS STRUCT(tag VARCHAR, ord BIGINT)[]) AS stack, 0::BIGINT AS els,
                 '' AS kind, '' AS tag, 0::BIGINT AS depth, 0::BIGINT AS n FROM pages
      UNION ALL
      SELECT g.page_id, k.i,
        CASE WHEN k.kind = 'open' AND k.tag NOT IN ({void}, 'script', 'style') THEN list_append(stack, {{'tag': k.tag, 'ord': els}})
             WHEN k.kind = 'close' AND list_contains(list_transform(stack, lambda x: x.tag), k.tag) THEN stack[:{last} - 1] ELSE stack END,
        els + (k.kind = 'open')::BIGINT, k.kind, k.tag, len(stack)::BIGINT, k.n
      FROM g JOIN k ON k.page_id = g.page_id AND k.i = g.i + 1),
    text AS (SELECT page_id, unnest(list_transform(stack, lambda x: x.ord)) AS ord, n FROM g WHERE kind = 'text' AND n > 0),
    size AS (SELECT page_id, ord, sum(n) AS n FROM text GROUP BY ALL)
    SELECT e.page_id, e.els - 1 AS ord, e.tag, e.depth, CAST(coalesce(size.n, 0) AS BIGINT) AS n_chars
      FROM g e LEFT JOIN size ON size.page_id = e.page_id AND size.ord = e.els - 1 WHERE e.kind = 'open'"""


def anchor_list() -> str:
    # independent of the parse: the test pages quote every href twice and nest no anchors
    ax = S.q(r'(?s)<a[\t\n\f\r ][^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    return f"""WITH p2 AS (SELECT {S.url_host('url')} AS search,
                     coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT), page_id) AS page_no, html FROM pages),
      a AS (SELECT search, page_no, unnest(regexp_extract_all(html, {ax}, 1)) AS href,
                   unnest(regexp_extract_all(html, {ax}, 2)) AS t,
                   CAST(generate_subscripts(regexp_extract_all(html, {ax}, 1), 1) AS BIGINT) AS a_pos FROM p2),
      l AS (SELECT search, page_no, a_pos,
                   CASE WHEN starts_with(href, '/') THEN 'https://www.migalhas.com.br' || href ELSE href END AS url,
                   {S.strip(S.rx_replace('t', '<[^>]+>', ''))} AS title
              FROM a WHERE contains(href, '/t') OR contains(href, '/a') OR contains(href, '/e')),
      l2 AS (SELECT * FROM l WHERE contains(url, 'migalhas.com.br')),
      fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search, url ORDER BY page_no, a_pos) AS rn FROM l2)
              WHERE rn = 1),
      allp AS (SELECT DISTINCT search, page_no FROM p2),
      ne AS (SELECT DISTINCT search, page_no FROM fs),
      stop AS (SELECT allp.search, min(allp.page_no) AS st FROM allp LEFT JOIN ne
                 ON allp.search = ne.search AND allp.page_no = ne.page_no WHERE ne.search IS NULL GROUP BY allp.search)
    SELECT fs.search, fs.page_no, fs.a_pos, fs.url, fs.title FROM fs LEFT JOIN stop ON fs.search = stop.search
     WHERE stop.st IS NULL OR fs.page_no < stop.st"""


# ------------------------------------------------------------------ keywords and filters

def query_tokens() -> str:
    from pressroom.plans.catalog import TOKEN_SUFFIX

    qt = f"(p_name || {S.q(TOKEN_SUFFIX)} || p_name)"
    return (f"SELECT p_partkey, array_to_string({S.query_tokens(qt, False)}, '|') AS tokens_all, "
            f"array_to_string({S.query_tokens(qt, True)}, '|') AS tokens FROM part")


def kw_any() -> str:
    from pressroom.plans.catalog import URL_KEYWORDS
    from pressroom.sources.outlets import DEFAULT_URL_KEYWORDS

    return (f"SELECT page_id, {S.any_keyword('lower(url)', S.kw_list(URL_KEYWORDS))} AS hit, "
            f"{S.any_keyword('lower(url)', S.kw_list(DEFAULT_URL_KEYWORDS))} AS hit_default FROM pages")


def kw_min_match() -> str:
    from pressroom.plans.catalog import MIN_MATCH_QUERY

    kws = S.query_tokens(S.q(MIN_MATCH_QUERY))
    title = "lower(text)"
    return (f"SELECT doc_id, CAST({S.keyword_hits(title, kws)} AS BIGINT) AS n_hits, "
            f"{S.keyword_hits(title, kws)} >= greatest(1, least(2, len({kws}))) AS keep FROM documents")


def path_exclude() -> str:
    return "SELECT page_id, url FROM pages WHERE NOT (contains(url, '/de/') OR contains(url, '?page='))"


DOC_ARTICLES = """
    a AS (SELECT doc_id + 1 AS row_num,
                 CASE WHEN source = 'src0' THEN '' ELSE 'https://' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR) END AS url,
                 CASE WHEN lang = 'de' THEN 'yes' ELSE 'no' END AS paywalled, split_part(text, chr(10), 1) AS title, text
            FROM documents),
    t AS (SELECT doc_id + 1 AS row_num, text FROM documents WHERE n_chars > 2000)"""


def missing_texts() -> str:
    return ("WITH " + DOC_ARTICLES + " SELECT row_num, url FROM a WHERE NOT EXISTS "
            "(SELECT 1 FROM t WHERE t.row_num = a.row_num AND t.text <> '') AND paywalled <> 'yes'")


def block_junk() -> str:
    from pressroom.operators.domlanes import FOLHA_PHOTO_PREFIX, FOLHA_SKIP, GLOBO_SKIP

    folha = " OR ".join(f"contains(text, {S.q(s)})" for s in FOLHA_SKIP)
    globo = " OR ".join(f"contains(lower(text), {S.q(s)})" for s in GLOBO_SKIP)
    return (f"WITH b AS (SELECT page_id, unnest(l) AS raw, CAST(generate_subscripts(l, 1) AS BIGINT) AS pos "
            f"FROM (SELECT page_id, regexp_extract_all(html, {S.q(r'(?s)<p[^>]*>(.+?)</p>')}, 1) AS l FROM pages)),"
            f" c AS (SELECT page_id, pos, {S.strip(S.rx_replace('raw', '<[^>]+>', ''))} AS text FROM b)"
            f" SELECT page_id, pos, CAST(length(text) AS BIGINT) AS n_chars,"
            f" length(text) >= 10 AND NOT ({folha}) AND NOT starts_with(text, {S.q(FOLHA_PHOTO_PREFIX)}) AS keep_folha,"
            f" length(text) >= 10 AND NOT ({globo}) AS keep_globo FROM c")


def dry_run() -> str:
    return ("WITH " + COLLECT_STUBS.rsplit("keys AS", 1)[0].rstrip().rstrip(",") + ","
            f" ts AS (SELECT stubs.outlet_key, stubs.url, {S.title_tag('p.html', ())} AS title,"
            " CASE WHEN contains(stubs.url, '#top') THEN '2024-03-01' ELSE '' END AS date"
            " FROM stubs JOIN pages p ON stubs.url = p.url)"
            " SELECT outlet_key, url, CASE WHEN date <> '' THEN date ELSE '?' END AS date,"
            " substring(coalesce(title, ''), 1, 80) AS title FROM ts"
            " WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.kurl = ts.url)")


def novelty() -> str:
    return (f"SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages s "
            f"WHERE contains(s.url, '{FEED_MARK}') AND s.url <> '' AND s.url = p.url)")


def back_fill() -> str:
    x_title = (f"CASE WHEN contains(url, 'cheap-pills') OR contains(url, 'spam-farm') THEN '' "
               f"ELSE {S.title_tag('html', (' - ', ' | '))} END")
    s_title = S.strip("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
    s_date = "CASE WHEN contains(url, '#top') THEN '2024-03-01' ELSE '' END"
    return (f"SELECT page_id, {S.first_nonempty(x_title, s_title)} AS title, "
            f"{S.first_nonempty(S.page_date('html', True), s_date)} AS date FROM pages")


def redirects() -> str:
    w = "'https://news.google.com/rss/articles/' || CAST(page_id AS VARCHAR)"
    return f"""
    WITH RECURSIVE st AS (SELECT page_id, 'wrapped' AS kind, {w} AS url FROM pages
      UNION ALL SELECT page_id, 'plain', url FROM pages WHERE starts_with(url, 'http://')),
    h AS (SELECT page_id, url, contains(url, '/fr/') AS ring, unnest(range(CASE WHEN contains(url, '/fr/') THEN 3 ELSE 1 + page_id % 9 END)) AS j
      FROM pages WHERE contains(url, '/en/') OR contains(url, '/fr/')),
    n AS (SELECT *, {w} || CASE WHEN j = 0 THEN '' ELSE '/' || j END AS f FROM h),
    r AS (SELECT f, CASE WHEN ring THEN {w} || CASE WHEN j = 2 THEN '' ELSE '/' || (j + 1) END
                         WHEN j = page_id % 9 THEN url ELSE {w} || '/' || (j + 1) END AS t FROM n),
    go AS (SELECT url AS start, url AS cur, 0 AS hops FROM st WHERE contains(url, 'news.google.com')
      UNION ALL SELECT start, t, hops + 1 FROM go JOIN r ON r.f = go.cur WHERE hops < 30),
    fin AS (SELECT start, cur FROM go WHERE hops < 30 AND cur NOT IN (SELECT f FROM r))
    SELECT page_id, kind, coalesce(fin.cur, st.url) AS url FROM st LEFT JOIN fin ON st.url = fin.start"""


def _registry_case(url: str, what: str) -> str:
    from pressroom.plans.repair import DEFAULT_LANES

    host = S.url_host(url)
    idx = {"key": 0, "lane": 2, "min": 3}[what]
    arms = " ".join(f"WHEN contains({host}, {S.q(d)}) THEN {S.q(r[idx]) if isinstance(r[idx], str) else r[idx]}"
                    for r in DEFAULT_LANES for d in [r[1]])
    dflt = {"key": "NULL", "lane": "'generic'", "min": "200"}[what]
    return f"(CASE {arms} ELSE {dflt} END)"


def repair_status() -> str:
    html = ("'<html><head><title>' || a.title || '</title></head><body><article><p>' || "
            "replace(a.text, chr(10), '</p><p>') || '</p></article></body></html>'")
    return ("WITH " + DOC_ARTICLES + ","
            " have AS (SELECT DISTINCT row_num FROM t WHERE coalesce(text, '') <> ''),"
            " a2 AS (SELECT a.row_num, a.url, a.paywalled, have.row_num IS NOT NULL AS has_text FROM a LEFT JOIN have"
            " ON a.row_num = have.row_num),"
            f" pg AS (SELECT a.url, {html} AS html FROM a WHERE a.url <> ''),"
            " td AS (SELECT *, paywalled <> 'yes' AND NOT has_text AND url <> '' AS todo FROM a2),"
            f" keys AS (SELECT DISTINCT td.url, {_registry_case('td.url', 'lane')} AS lane,"
            f" {_registry_case('td.url', 'min')} AS min_chars, coalesce(pg.html, '') AS html"
            " FROM td LEFT JOIN pg ON td.url = pg.url WHERE todo),"
            + regex_lanes_sql("keys") + ","
            " st AS (SELECT CASE WHEN td.paywalled = 'yes' THEN 'skipped' WHEN td.has_text THEN 'skipped'"
            " WHEN coalesce(td.url, '') = '' THEN 'failed'"
            " WHEN coalesce(CASE WHEN l.ok THEN l.text END, '') <> '' THEN 'fetched' ELSE 'failed' END AS status"
            " FROM td LEFT JOIN lanes l ON td.todo AND td.url = l.url)"
            " SELECT status, count(*) AS n FROM st GROUP BY status")


def _theme_hits():
    from pressroom.functions.themes import DEFAULT_THEMES

    return [(th, S.keyword_hits("lower(text)", S.kw_list(kws))) for th, kws in DEFAULT_THEMES.items()]


def theme_counts() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {S.q(th)} AS theme, CAST({h} AS BIGINT) AS n FROM documents"
                              for th, h in _theme_hits())


def theme_guess() -> str:
    hs = _theme_hits()
    cols = ", ".join(f"{h} AS n{i}" for i, (_, h) in enumerate(hs))
    mx = "greatest(" + ", ".join(f"n{i}" for i in range(len(hs))) + ")"
    arms = " ".join(f"WHEN n{i} = {mx} THEN {S.q(th)}" for i, (th, _) in enumerate(hs))
    return f"SELECT doc_id, CASE WHEN {mx} = 0 THEN '' {arms} END AS theme FROM (SELECT doc_id, {cols} FROM documents)"


# ------------------------------------------------------------------ audit and numbering

def _py_repr(x: str) -> str:
    esc = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (f"(CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END)")


def audit_render() -> str:
    return f"""WITH ev AS (SELECT *, strftime(ts, '%Y-%m-%d') AS run_id FROM events),
      res AS (SELECT run_id, event_type AS outlet, 1 AS pages, count(*) AS hits,
                     count(*) FILTER (WHERE value >= 10) AS new, count(*) FILTER (WHERE value >= 30) AS added,
                     CASE WHEN event_type = 'error' THEN 'search failed: ' || CAST(count(*) AS VARCHAR) || ' errors'
                          ELSE '' END AS note
                FROM ev GROUP BY run_id, event_type),
      ln AS (SELECT run_id, string_agg(line, chr(10) ORDER BY outlet) AS body, sum(added) AS total FROM (
               SELECT *, '- **' || outlet || '**: ' || hits || ' hits, ' || new || ' new, ' || added
                         || ' added (pages: ' || pages || ')' || CASE WHEN note <> '' THEN ' — ' || note ELSE '' END AS line
                 FROM res) GROUP BY run_id),
      runs AS (SELECT run_id, min(ts) AS ts FROM ev GROUP BY run_id),
      r2 AS (SELECT run_id, ts, CASE WHEN dayofweek(ts) = 0 THEN 'o''clock ' ELSE '' END || 'events ' || run_id AS query,
                    CASE WHEN day(ts) % 2 = 0 THEN 'ctx ' || run_id ELSE '' END AS ctx FROM runs)
    SELECT r2.run_id, '## ' || strftime(ts, '%Y-%m-%d %H:%M') || ' — query: ' || {_py_repr('query')} || chr(10)
           || CASE WHEN ctx <> '' THEN '- _context: ' || ctx || '_' || chr(10) ELSE '' END
           || coalesce(body || chr(10), '') || '- **total added: ' || CAST(coalesce(total, 0) AS BIGINT) || '**'
           || chr(10) || chr(10) AS block
      FROM r2 LEFT JOIN ln ON r2.run_id = ln.run_id"""


def row_numbers() -> str:
    return ("WITH st AS (SELECT doc_id + 1 AS row_num FROM documents WHERE lang = 'en'),"
            " b AS (SELECT coalesce(max(row_num), 0) + 1 AS b FROM st)"
            " SELECT doc_id, (SELECT b FROM b) + row_number() OVER (ORDER BY source, doc_id) - 1 AS row_num"
            " FROM documents WHERE lang <> 'en'")


def first_seen() -> str:
    base = COLLECT_STUBS.split("store AS", 1)[0].rstrip().rstrip(",")
    return ("WITH " + base + ","
            " s2 AS (SELECT outlet_key, page_no, stub_ord, url, title FROM stubs UNION ALL"
            " SELECT outlet_key, 2, stub_ord, split_part(url, '#', 1), title FROM stubs WHERE outlet_key = 'estadao')"
            " SELECT outlet_key, url, CAST(page_no AS BIGINT) AS page_no, stub_ord, title FROM ("
            " SELECT *, row_number() OVER (PARTITION BY outlet_key, url ORDER BY page_no, stub_ord) AS rn FROM s2)"
            " WHERE rn = 1")


def winner() -> str:
    return "WITH " + COLLECT_CORE + " SELECT outlet_key, url, stub_ord, in_store, ok, is_new, is_winner FROM cw"


def known_growth() -> str:
    return "WITH " + COLLECT_CORE + " SELECT kurl AS url FROM known UNION SELECT url FROM cw WHERE is_winner"


def collect_counts() -> str:
    return ("WITH " + COLLECT_CORE + ","
            " sel AS (SELECT * FROM (VALUES ('conjur', 1, 'Conjur'), ('migalhas', 2, 'Migalhas'),"
            " ('estadao', 3, 'Estadao')) t(outlet_key, sel_ord, outlet)),"
            " cnt AS (SELECT outlet_key, count(*) AS hits, count(*) FILTER (WHERE is_new) AS new,"
            " count(*) FILTER (WHERE is_winner) AS added FROM cw GROUP BY outlet_key),"
            " res AS (SELECT 'run' AS run_id, outlet, coalesce(hits, 0) AS hits, coalesce(new, 0) AS new,"
            " coalesce(added, 0) AS added FROM sel LEFT JOIN cnt ON sel.outlet_key = cnt.outlet_key)"
            " SELECT run_id, coalesce(outlet, '__total__') AS outlet, CAST(sum(hits) AS BIGINT) AS hits,"
            " CAST(sum(new) AS BIGINT) AS new, CAST(sum(added) AS BIGINT) AS added"
            " FROM res GROUP BY ROLLUP (run_id, outlet) HAVING run_id IS NOT NULL")


def page_stop() -> str:
    from pressroom.plans.catalog import PAGE_STOP_MAX

    return f"""WITH ev AS (SELECT event_type AS search, dayofyear(ts) AS page_no, event_id, value FROM events
                     WHERE dayofyear(ts) BETWEEN 1 AND {PAGE_STOP_MAX}),
      items AS (SELECT search, page_no, event_id FROM ev WHERE value >= 49),
      allp AS (SELECT DISTINCT search, page_no FROM ev),
      ne AS (SELECT DISTINCT search, page_no FROM items),
      stop AS (SELECT allp.search, min(allp.page_no) AS st FROM allp LEFT JOIN ne
                 ON allp.search = ne.search AND allp.page_no = ne.page_no WHERE ne.search IS NULL GROUP BY allp.search)
    SELECT i.search, CAST(i.page_no AS BIGINT) AS page_no, i.event_id,
           CAST(CASE WHEN i.page_no > 1 THEN (i.page_no - 1) * 25 + 1 END AS BIGINT) AS offset
      FROM items i LEFT JOIN stop ON i.search = stop.search WHERE stop.st IS NULL OR i.page_no < stop.st"""


# ------------------------------------------------------------------ meta, dates, summaries

def meta_title() -> str:
    h1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
    head = (f"(CASE WHEN starts_with(url, 'https') THEN '<meta property=\"og:title\" content=\"' || {h1} || '\">' "
            f"ELSE '' END || html)")
    return (f"SELECT page_id, {S.first_nonempty(S.meta_property(head, 'og:title'), S.title_tag(head, (' - ', ' | ')))} AS t_meta, "
            f"{S.first_nonempty(S.meta_property(head, 'og:title'), S.strip(S.rx_replace(h1, '<[^>]+>', '')))} AS t_h1 "
            f"FROM pages")


def page_date() -> str:
    d = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"
    html = (f"(CASE WHEN o_orderstatus = 'F' THEN '<meta property=\"article:published_time\" content=\"' || {d} || '-03:00\">' "
            f"WHEN o_orderstatus = 'O' THEN '<script>{{\"datePublished\" : \"' || {d} || '\"}}</script>' "
            f"ELSE '<time class=\"x\" datetime=\"' || {d} || '\">' END)")
    return (f"SELECT o_orderkey, {S.page_date(html, True)} AS d_meta, {S.page_date(html, False)} AS d_para "
            f"FROM orders")


def pt_date() -> str:
    from pressroom.functions.text import PT_DOTTED, PT_MONTHS

    months = "[" + ", ".join(S.q(m) for m in PT_MONTHS) + "]"
    txt = (f"('Publicado em ' || CAST(day(o_orderdate) AS VARCHAR) || '.' || CASE WHEN starts_with(o_orderpriority, '1') "
           f"THEN 'xyz' ELSE {months}[month(o_orderdate)] END || '.' || CAST(year(o_orderdate) AS VARCHAR) || ' às 10h')")
    g = lambda i: f"regexp_extract(txt, {S.q(PT_DOTTED)}, {i})"
    return (f"SELECT o_orderkey, {S.pt_dotted_month('txt')} AS month, CASE WHEN {g(1)} <> '' THEN {g(3)} || '-' || "
            f"printf('%02d', CAST({g(1)} AS INTEGER)) ELSE '' END AS day_form FROM (SELECT o_orderkey, {txt} AS txt FROM orders)")


def summary_lines() -> str:
    return (f"SELECT doc_id, {S.lines_summary('text')} AS s_lines, {S.second_chunk('text')} AS s_chunk, "
            f"substring(text, 1, 300) AS s_first FROM documents")


def text_names() -> str:
    return ("SELECT doc_id, printf('%03d', doc_id + 1) || '.txt' AS name, "
            "printf('%03d', doc_id * 7 + 1) || '.txt' AS name_wide FROM documents")


def stub_pages() -> str:
    return ("WITH st AS (SELECT url FROM pages UNION ALL SELECT url || 'x' FROM pages WHERE contains(url, '#top'))"
            " SELECT st.url, p.html IS NOT NULL AS fetched, CAST(coalesce(length(p.html), 0) AS BIGINT) AS n_chars"
            " FROM st LEFT JOIN pages p ON st.url = p.url")


def outlet_select() -> str:
    from pressroom.plans.catalog import SELECT_REQUEST, TEST_REGISTRY

    dim = ", ".join(f"({S.q(k)}, {S.q(k.upper())}, {S.q('disabled' if k == 't_look' else 'working')}, 'native')"
                    for k, d, _ in TEST_REGISTRY)
    toks = (f"list_filter(list_transform(string_split({S.q(SELECT_REQUEST)}, ','), lambda p: lower({S.strip('p')})),"
            f" lambda p: p <> '')")
    return (f"WITH dim AS (SELECT * FROM (VALUES {dim}) t(key, name, status, search)),"
            f" req AS (SELECT unnest(l) AS key, CAST(generate_subscripts(l, 1) AS BIGINT) AS sel_ord FROM (SELECT {toks} AS l)),"
            f" cnt AS (SELECT {_route_sql('url', 'first')} AS key, count(*) AS n_pages FROM pages GROUP BY 1)"
            f" SELECT dim.key, req.sel_ord, dim.name, dim.status, dim.search, CAST(coalesce(cnt.n_pages, 0) AS BIGINT) AS n_pages"
            f" FROM dim JOIN req ON dim.key = req.key LEFT JOIN cnt ON dim.key = cnt.key WHERE dim.status <> 'disabled'")


# ------------------------------------------------------------------ stories CSV and streaming ingest

def articles_scan() -> str:
    raw_url = "' \"https://' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR) || '\" '"
    pw = "CASE WHEN lang = 'de' THEN ' YES ' WHEN lang = 'fr' THEN '' ELSE 'no' END"
    return (f"SELECT row_number() OVER (ORDER BY doc_id) AS row_num,"
            f" CASE WHEN lang = 'en' THEN '2024-03' ELSE strftime(DATE '2024-01-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d') END AS date,"
            f" source AS outlet, split_part(text, chr(10), 1) AS title,"
            f" {S.url_store_clean(raw_url)} AS url, '' AS theme,"
            f" text || ' \"q\", x' AS summary, {S.paywalled_norm(pw)} AS paywalled FROM documents")


def articles_roundtrip() -> str:
    return ("SELECT row_number() OVER (ORDER BY doc_id) AS row_num, lang AS outlet,"
            " CASE WHEN lang = 'en' THEN '' ELSE source END AS title,"
            " 'https://d.example/' || CAST(doc_id AS VARCHAR) AS url, text AS summary FROM documents")


def incremental_ingest() -> str:
    conds = ["contains(url, '/en/')", "contains(url, '/fr/')", "contains(url, '/es/')",
             "NOT (contains(url, '/en/') OR contains(url, '/fr/') OR contains(url, '/es/'))",
             "contains(url, '/en/')", "starts_with(url, 'https://')"]
    dl = " UNION ALL ".join(f"SELECT {i} AS d, page_id, url, html FROM pages WHERE {c}" for i, c in enumerate(conds))
    return (f"WITH dl AS ({dl}),"
            " f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY d, page_id) AS rn FROM dl)"
            " WHERE rn = 1)"
            f" SELECT row_number() OVER (ORDER BY d, page_id) AS row_num, page_id, url, {S.title_tag('html')} AS title"
            " FROM f")


def fetch_run() -> str:
    from pressroom.plans.catalog import LITERAL_URLS, TEST_REGISTRY

    content = "concat_ws(chr(10), url, '# seen ' || url, '', '  ' || url || '/  ')"
    inline = " UNION ALL ".join(
        f"SELECT 0 AS src_ord, CAST(-1 AS BIGINT) AS page_id, CAST({i + 1} AS BIGINT) AS line_no, {S.q(u)} AS line"
        for i, u in enumerate(LITERAL_URLS))
    route = _route_sql("url", "first")
    lane = "(CASE " + " ".join(f"WHEN r = {S.q(k)} THEN {S.q(ln)}" for k, _, ln in TEST_REGISTRY) + " ELSE 'generic' END)"
    name = "(CASE " + " ".join(f"WHEN r = {S.q(k)} THEN {S.q(k.upper())}" for k, _, _ in TEST_REGISTRY) + " END)"
    return f"""WITH l AS (SELECT page_id, unnest(x) AS line, CAST(generate_subscripts(x, 1) AS BIGINT) AS line_no
                   FROM (SELECT page_id, string_split({content}, chr(10)) AS x FROM pages)),
      k AS (SELECT 1 AS src_ord, page_id, line_no, line FROM l WHERE {S.strip('line')} <> '' AND NOT starts_with(line, '#')
            UNION ALL {inline}),
      u0 AS (SELECT src_ord, page_id, line_no, {S.url_fetch_clean(S.strip('line'))} AS url FROM k),
      u1 AS (SELECT * FROM u0 WHERE url <> '' AND NOT EXISTS (SELECT 1 FROM pages s WHERE contains(s.url, '{FEED_MARK}')
               AND s.url <> '' AND s.url = u0.url)),
      u2 AS (SELECT *, {route} AS r FROM u1),
      u3 AS (SELECT *, {lane} AS lane, CASE WHEN {lane} = 'meta' THEN 300 ELSE 200 END AS min_chars FROM u2),
      keys AS (SELECT DISTINCT u3.url, lane, min_chars, coalesce(p.html, '') AS html FROM u3 LEFT JOIN pages p ON u3.url = p.url),
      {regex_lanes_sql('keys').strip()},
      d AS (SELECT u3.*, l.title, l.date, l.summary, l.text FROM u3 JOIN lanes l
              ON u3.url = l.url AND u3.lane = l.lane AND u3.min_chars = l.min_chars WHERE l.ok),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src_ord, page_id, line_no) AS rn FROM d)
            WHERE rn = 1),
      base AS (SELECT coalesce(max(page_id + 1), 0) + 1 AS b FROM pages WHERE contains(url, '{FEED_MARK}'))
    SELECT (SELECT b FROM base) + row_number() OVER (ORDER BY src_ord, page_id, line_no) - 1 AS row_num,
           date, coalesce({name}, {S.url_host('url', False)}) AS outlet, title, url, summary,
           CAST(length(text) AS BIGINT) AS n_chars FROM f"""


def result_list() -> str:
    """Items of the built result lists: a line longer than 20 characters is a
    linked headline (its stripped text the title), shorter lines only link
    elsewhere; the dateline gives March 2024; pages stop at the first page
    of a search without items."""
    return f"""WITH l AS (SELECT source AS search, doc_id + 1 AS page_no, unnest(x) AS line,
                          CAST(generate_subscripts(x, 1) AS BIGINT) AS item_pos
                     FROM (SELECT source, doc_id, string_split(text, chr(10)) AS x FROM documents)),
      items AS (SELECT search, page_no, item_pos,
                       'https://www1.folha.uol.com.br/poder/2024/' || CAST(page_no - 1 AS VARCHAR) || '-'
                       || CAST(item_pos - 1 AS VARCHAR) || '.shtml' AS url,
                       {S.strip('line')} AS title, '2024-03' AS date
                  FROM l WHERE length(line) > 20 AND {S.strip('line')} <> ''),
      allp AS (SELECT DISTINCT source AS search, doc_id + 1 AS page_no FROM documents),
      ne AS (SELECT DISTINCT search, page_no FROM items),
      stop AS (SELECT allp.search, min(allp.page_no) AS st FROM allp LEFT JOIN ne
                 ON allp.search = ne.search AND allp.page_no = ne.page_no WHERE ne.search IS NULL GROUP BY allp.search)
    SELECT i.search, i.page_no, i.item_pos, i.url, i.title, i.date
      FROM items i LEFT JOIN stop ON i.search = stop.search WHERE stop.st IS NULL OR i.page_no < stop.st"""


def _doc_article_html() -> str:
    """The article HTML built from documents, as the catalog builds it, plus the
    unescaped non-blank lines ``ol`` for the expected values."""
    from pressroom.functions.text import PT_MONTHS

    months = "[" + ", ".join(S.q(m) for m in PT_MONTHS) + "]"
    nonblank = f"list_filter(string_split(text, chr(10)), lambda x: length({S.strip('x')}) > 0)"
    paras = ("array_to_string(list_transform(list_slice(el, 2, len(el)), lambda x, i: CASE WHEN (i - 1) % 7 = 3 "
             "THEN '<h3>' || x || '</h3>' ELSE '<p>' || x || '</p>' END), '')")
    return f"""
    d0 AS (SELECT doc_id, lang, source, {nonblank} AS ol FROM documents),
    d1 AS (SELECT *, list_transform(ol, lambda x: replace(x, '&', '&amp;')) AS el,
                  DATE '2024-01-01' + CAST(doc_id AS INTEGER) AS day FROM d0),
    d2 AS (SELECT *, coalesce(el[1], '') AS first, coalesce(el[2], '') AS second,
                  CAST(day(day) AS VARCHAR) || '.' || {months}[month(day)] || '.' || CAST(year(day) AS VARCHAR) AS pt
             FROM d1),
    dh AS (SELECT doc_id, lang, source, ol, pt,
        '<html><head><title>' || first || ' - Jornal</title><meta property="og:description" content="'
        || replace(second, '"', '') || '"><meta property="article:published_time" content="'
        || strftime(day, '%Y-%m-%d') || 'T08:00:00-03:00"><script>var t="<p>x</p>";</script></head><body>'
        || '<header><h1>Menu do jornal</h1></header><nav><a href="/a">Assine</a></nav>'
        || CASE WHEN lang = 'de' THEN '<main>' ELSE '<article>' END || '<h1>' || first || '</h1>'
        || CASE WHEN lang = 'es' THEN '' ELSE '<h2 class="c-news__subtitle">' || second || '</h2>' END
        || '<p class="c-news__author">Por ' || source || '</p><time>' || pt || '</time>'
        || CASE WHEN lang = 'en' THEN '<div class="c-news__body article__content-container post-content">'
                WHEN lang = 'fr' THEN '<div itemprop="articleBody" class="entry-content">'
                WHEN lang = 'es' THEN '<div class="content-text">' ELSE '<section>' END
        || {paras} || '<div class="c-ad ad"><p>Publicidade longa o bastante</p></div>'
        || '<p>Carregando comentarios do leitor</p></div>'
        || CASE WHEN lang = 'de' THEN '</main>' ELSE '</article>' END
        || '<footer><p>Rodape com texto longo</p></footer></body></html>' AS html
      FROM d2)"""


def folha_text() -> str:
    """Folha's DOM rules on the built article HTML: header / nav / ad / footer
    removed, <article> is the body container (the first selector match in
    document order), short and skip-string blocks dropped; no container
    (de) -> readable text of the whole page."""
    from pressroom.operators.domlanes import FOLHA_PHOTO_PREFIX, FOLHA_SKIP

    skip = " OR ".join(f"contains(t, {S.q(x)})" for x in FOLHA_SKIP)
    keep = f"(length(t) >= 10 AND NOT ({skip}) AND NOT starts_with(t, {S.q(FOLHA_PHOTO_PREFIX)}))"
    stripped = f"list_transform(list_slice(ol, 2, len(ol)), lambda x: {S.strip('x')})"
    parts = (f"list_filter(list_transform({stripped}, lambda t, i: CASE WHEN NOT {keep} THEN NULL "
             f"WHEN (i - 1) % 7 = 3 THEN chr(10) || t || chr(10) ELSE t END), lambda y: y IS NOT NULL)")
    sub_t = S.strip("coalesce(ol[2], '')")
    sub_part = (f"CASE WHEN lang <> 'es' AND (SELECT {keep} FROM (SELECT {sub_t} AS t)) "
                f"THEN [chr(10) || {sub_t} || chr(10)] ELSE []::VARCHAR[] END")
    title = S.strip("coalesce(ol[1], '')")
    head = (f"list_filter([CASE WHEN {title} <> '' THEN {title} END, "
            f"CASE WHEN lang <> 'es' THEN {sub_t} END, 'Por ' || source, pt, ''], lambda y: y IS NOT NULL)")
    body = (f"CASE WHEN lang = 'de' THEN [{S.html_to_text('html')}] "
            f"ELSE list_concat({sub_part}, {parts}) END")
    return ("WITH " + _doc_article_html() + ","
            f" ft AS (SELECT doc_id, {title} AS title, pt, html, "
            f"{S.strip(f'array_to_string(list_concat({head}, {body}), chr(10) || chr(10))')} AS text FROM dh)"
            f" SELECT doc_id, title, {S.pt_dotted_month('pt')} AS date, {S.second_chunk('text')} AS summary,"
            f" coalesce(text <> '' AND length(text) >= 300 AND html <> '', false) AS ok,"
            f" CAST(length(text) AS BIGINT) AS n_chars FROM ft")


def _para_texts(keep: str, lower: bool = False) -> str:
    """Kept <p>/<h3> texts built from lines 2.. (every 7th from the 4th is a heading)."""
    stripped = f"list_transform(list_slice(ol, 2, len(ol)), lambda x: {S.strip('x')})"
    return (f"list_filter(list_transform({stripped}, lambda t, i: CASE WHEN NOT {keep} THEN NULL "
            f"WHEN (i - 1) % 7 = 3 THEN chr(10) || t || chr(10) ELSE t END), lambda y: y IS NOT NULL)")


def globo_text() -> str:
    """Globo's DOM rules on the built article HTML: og:title absent -> the first
    <h1> (the site header's, taken before removal); container by preference
    (content div, articleBody div, article); skip strings case-insensitive."""
    from pressroom.operators.domlanes import GLOBO_SKIP

    skip = " OR ".join(f"contains(lower(t), {S.q(x)})" for x in GLOBO_SKIP)
    keep = f"(length(t) >= 10 AND NOT ({skip}))"
    desc = S.strip("replace(coalesce(ol[2], ''), '\"', '')")
    head = (f"list_filter(['Menu do jornal', CASE WHEN length({desc}) > 30 THEN {desc} END, "
            f"strftime(DATE '2024-01-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d'), ''], lambda y: y IS NOT NULL)")
    body = f"CASE WHEN lang = 'de' THEN [{S.html_to_text('html')}] ELSE {_para_texts(keep)} END"
    return ("WITH " + _doc_article_html() + ","
            f" gt AS (SELECT doc_id, html, strftime(DATE '2024-01-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d') AS date, "
            f"{S.strip(f'array_to_string(list_concat({head}, {body}), chr(10) || chr(10))')} AS text FROM dh)"
            f" SELECT doc_id, 'Menu do jornal' AS title, date, {S.second_chunk('text')} AS summary,"
            f" coalesce(text <> '' AND length(text) >= 300 AND html <> '', false) AS ok,"
            f" CAST(length(text) AS BIGINT) AS n_chars FROM gt")


def piaui_text() -> str:
    """Piaui's container cascade on the built article HTML: the first of
    .post-content / .entry-content / article / .content-text with more than
    200 characters, else the last one found, else the page body; the title is
    the first <h1> (the site header's)."""
    nodes_div = ("list_concat(list_transform(list_slice(ol, 2, len(ol)), lambda x: " + S.strip("x") + "), "
                 "['Publicidade longa o bastante', 'Carregando comentarios do leitor'])")
    art_head = (f"list_filter([{S.strip(chr(39) * 2 + ' || coalesce(ol[1], ' + chr(39) * 2 + ')')}, "
                f"CASE WHEN lang <> 'es' THEN {S.strip('coalesce(ol[2], ' + chr(39) * 2 + ')')} END, "
                f"'Por ' || source, pt], lambda y: y IS NOT NULL AND y <> '')")
    div_lines = f"array_to_string(list_filter({nodes_div}, lambda y: y <> ''), chr(10))"
    art_lines = f"array_to_string(list_filter(list_concat({art_head}, {nodes_div}), lambda y: y <> ''), chr(10))"
    body_lines = (f"array_to_string(list_filter(list_concat(['Menu do jornal', 'Assine'], {art_head}, {nodes_div}, "
                  f"['Rodape com texto longo']), lambda y: y <> ''), chr(10))")
    found = (f"(CASE WHEN lang IN ('en', 'fr') THEN [{div_lines}, {art_lines}] "
             f"WHEN lang = 'es' THEN [{art_lines}, {div_lines}] ELSE []::VARCHAR[] END)")
    body = (f"coalesce(list_filter(found, lambda t: length(t) > 200)[1], found[-1], '')")
    return ("WITH " + _doc_article_html() + ","
            f" pf AS (SELECT doc_id, lang, html, {found} AS found, {body_lines} AS page FROM dh),"
            f" pb AS (SELECT doc_id, html, CASE WHEN {body} = '' THEN page ELSE {body} END AS body FROM pf),"
            f" pt2 AS (SELECT doc_id, html, body, {S.strip(chr(39) + 'Menu do jornal' + chr(39) + ' || chr(10) || chr(10) || body')} AS text FROM pb)"
            f" SELECT doc_id, 'Menu do jornal' AS title, '' AS date, substring(body, 1, 300) AS summary,"
            f" coalesce(text <> '' AND length(text) >= 200 AND html <> '', false) AS ok,"
            f" CAST(length(text) AS BIGINT) AS n_chars FROM pt2")


def collect_dom() -> str:
    """collect over the three DOM lanes: folha sees the documents whose number
    has an even count of digits, globo and piaui see all; per URL the first
    successful extraction in outlet order is stored, numbered in that order."""
    return f"""WITH f AS ({folha_text()}), g AS ({globo_text()}), p AS ({piaui_text()}),
      docs AS (SELECT doc_id, 'https://www.' || source || '.example.com/a/' || CAST(doc_id AS VARCHAR) AS url
                 FROM documents),
      st AS (SELECT 1 AS sel_ord, 'Folha de S.Paulo' AS outlet, d.doc_id, d.url, f.title, f.date, f.summary, f.ok,
                    f.n_chars FROM docs d JOIN f ON d.doc_id = f.doc_id
              WHERE length(CAST(d.doc_id AS VARCHAR)) % 2 = 0
             UNION ALL
             SELECT 2, 'O Globo', d.doc_id, d.url, g.title, g.date, g.summary, g.ok, g.n_chars
               FROM docs d JOIN g ON d.doc_id = g.doc_id
             UNION ALL
             SELECT 3, 'piaui', d.doc_id, d.url, p.title, p.date, p.summary, p.ok, p.n_chars
               FROM docs d JOIN p ON d.doc_id = p.doc_id),
      w AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY sel_ord, doc_id) AS rn FROM st WHERE ok)
    SELECT row_number() OVER (ORDER BY sel_ord, doc_id) AS row_num, date, outlet, title, url, '' AS theme,
           coalesce(summary, '') AS summary, 'no' AS paywalled, n_chars
      FROM w WHERE rn = 1"""


# What the captured bodies hold, said directly: one row for each stub a search must find.
FOUND = {
    "conjur": """SELECT 1 AS page_no, 'rss' || doc_id AS feed, 1::BIGINT AS stub_ord, 'https://www.conjur.com.br/' || doc_id AS url, 'C ' || doc_id AS title, '2024-03-05' AS date FROM d
      UNION ALL SELECT 1, 'rss' || doc_id, 2, 'https://www.conjur.com.br/w/' || doc_id, 'W', '' FROM d WHERE lang = 'en'""",
    "migalhas": """SELECT page_no, feed, stub_ord, url, title, '' AS date FROM (
        SELECT 1 + doc_id % 5 AS page_no, 'm' || doc_id AS feed, 1::BIGINT AS stub_ord, 'https://www.migalhas.com.br/quentes/?n=' || (doc_id % 50) || '&x' AS url, 'Q' AS title FROM d
        UNION ALL SELECT 1 + doc_id % 5, 'm' || doc_id, 2, 'https://www.migalhas.com.br/depeso/' || doc_id, 'D' || doc_id FROM d)
      WHERE page_no <= 3 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_no, feed, stub_ord) = 1""",
    "estadao": """SELECT 1 AS page_no, 'e' || doc_id AS feed, 1::BIGINT AS stub_ord, 'https://www.estadao.com.br/' || lang || '/' || doc_id AS url, '' AS title, '' AS date FROM d WHERE lang = 'en'
      UNION ALL SELECT 2, 't' || doc_id, 1, 'https://www.estadao.com.br/politica/' || lang || '/tribunal-' || doc_id || '/', '', '' FROM d""",
    "globo": """SELECT 1 AS page_no, 'https://oglobo.globo.com/sitemap/oglobo/' || (2000 + doc_id % 27) || '/01/02_' || doc_id || '.xml' AS feed, 1::BIGINT AS stub_ord,
        'https://oglobo.globo.com/' || lang || '/tribunal-' || (doc_id % 100) AS url, '' AS title, '' AS date FROM d
      WHERE doc_id % 27 >= 24 QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed) = 1""",
    "folha": """SELECT 1 + doc_id % 5 AS page_no, 'f' || doc_id AS feed, 1::BIGINT AS stub_ord, 'https://www1.folha.uol.com.br/' || doc_id || '.shtml' AS url,
        'Manchete & ' || doc_id AS title, '2024-03' AS date FROM d WHERE lang <> 'de' AND doc_id % 5 < 3""",
    "piaui": """SELECT 1 AS page_no, 'p' || doc_id AS feed, 1::BIGINT AS stub_ord, 'https://piaui.folha.uol.com.br/' || lang || '-TRIBUNAL-' || doc_id || ' ' AS url,
        '' AS title, '' AS date FROM d""",
}
DOCS = "d AS (SELECT doc_id, lang FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL)"


def discover(key: str):
    def sql() -> str:
        return f"WITH {DOCS} SELECT '{key}' AS outlet_key, CAST(page_no AS INT) AS page_no, feed, stub_ord, url, title, date FROM ({FOUND[key]})"

    return sql


def collect_from_feeds() -> str:
    names = {"conjur": "Conjur", "migalhas": "Migalhas", "estadao": "Estadao", "globo": "O Globo", "folha": "Folha de S.Paulo", "piaui": "piaui"}
    found = " UNION ALL ".join(f"SELECT '{names[k]}' AS outlet, url FROM ({q})" for k, q in FOUND.items())
    known = "(SELECT 'https://www.conjur.com.br/' || doc_id FROM documents WHERE doc_id IS NOT NULL AND lang = 'es')"
    got = "(SELECT 'https://www.conjur.com.br/' || doc_id FROM documents WHERE doc_id IS NOT NULL AND lang = 'fr')"
    return (f"WITH {DOCS} SELECT outlet, count(*) AS hits, count(*) FILTER (url NOT IN {known}) AS new, count(*) FILTER (url IN {got}) AS added"
            f" FROM ({found}) GROUP BY outlet")
