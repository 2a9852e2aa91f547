"""Queries of scalar functions over texts, URLs and pages (H, K6, K7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import html as H
from corpusloom.functions import moderation, smalltalk
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import ingest, moderate, search, synopsis

from .registry import query
from .retrieval import BODIES, CODES, CONTENT, ORDINAL_WORDS, TOKENS

_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _folded(sql: str, rules, flags: str) -> str:
    for pattern, to in rules:
        sql = f"regexp_replace({sql}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', '{flags}')"
    return sql


@query("h1_tokens", f"SELECT doc_id, len({TOKENS.format(c='text')}) AS n, md5(array_to_string({TOKENS.format(c='text')}, ' ')) AS digest FROM documents")
def h1(v):
    t = T.tokens(F.col("text"))
    return v("documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


_ASKED = "SELECT item_id, 'the univ vc and dde admision proces ' || text AS q FROM benchmark"
_NORMALISED = f"WITH a AS ({_ASKED}) SELECT item_id, " + _STRIP.format(c=f"regexp_replace({_folded(_folded('q', T.TYPOS, 'gi'), T.ACRONYMS, 'gi')}, '\\s+', ' ', 'g')") + " AS q FROM a"


@query("h2_query_normalised_whole", _NORMALISED)
@query("h2_query_normalised", _NORMALISED)
def h2(v):
    return v("benchmark").select("item_id", T.normalise_query(F.concat(F.lit("the univ vc and dde admision proces "), "text")).alias("q"))


@query("h3_scan_corrected", "SELECT item_id, " + _STRIP.format(c=f"regexp_replace(regexp_replace({_folded(chr(39) + 'Trureday tne Commitzee __ sersion of Umiversity. Monday ' + chr(39) + ' || text', T.SCAN_ERRORS, 'gi')}, '_+', ' ', 'g'), '[ \t]+', ' ', 'g')") + " AS t FROM benchmark")
def h3(v):
    return v("benchmark").select("item_id", T.correct_scan(F.concat(F.lit("Trureday tne Commitzee __ sersion of Umiversity. Monday "), "text")).alias("t"))


@query("h4_answer_cleaned")
def h4(v):
    t = F.concat(F.lit("as stated in, "), "text", F.lit(" [1] the rule the rule the rule in [notes.pdf](x) ."))
    return v("benchmark").select("item_id", T.clean_answer(t).alias("t"))


_FENCED = """WITH r AS (SELECT session_id, turn, '[Document: ' || sender || ' | Page: ' || turn || ' | Section: N/A]' || chr(10) || regexp_replace(content || ' [sanitized_tag]', '^\\s+|\\s+$', '', 'g') AS c FROM v_messages)
SELECT session_id, '<context>' || chr(10) || string_agg(c, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) || chr(10) || '</context>' AS context FROM r GROUP BY session_id"""


@query("h5_fenced_context_whole", _FENCED)
@query("h5_fenced_context", _FENCED)
def h5(v):
    c = T.fenced(F.col("sender"), F.col("turn").cast("string"), F.lit("N/A"), F.concat("content", F.lit(" <system x>")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("c")))), lambda r: r["c"])
    return v("v_messages").groupBy("session_id").agg(F.concat(F.lit("<context>\n"), F.array_join(parts, "\n\n---\n\n"), F.lit("\n</context>")).alias("context"))


@query("h6_evasion_folded")
def h6(v):
    return v("documents").select("doc_id", F.md5(T.evasion_folded(F.col("text")).cast("binary")).alias("folded"), F.md5(T.evasion_squashed(F.col("text")).cast("binary")).alias("squashed"))


@query("h7_slug", r"SELECT document_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_.-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM v_documents")
def h7(v):
    return v("v_documents").select("document_id", T.slug(F.col("title")).alias("slug"))


_P = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
#: A normalised URL in SQL, from the URL {u} and the column ks, the query keys that stay.
NORM = f"""CASE WHEN lower(regexp_extract({{u}}, {_P}, 1)) IN ('http', 'https') AND regexp_extract({{u}}, {_P}, 2) <> '' THEN lower(regexp_extract({{u}}, {_P}, 1)) || '://' || regexp_replace(lower(regexp_extract({{u}}, {_P}, 2)), ':(80|443)$', '') || regexp_extract({{u}}, {_P}, 3) ||
CASE WHEN len(ks) > 0 THEN '?' || array_to_string(ks, '&') ELSE '' END END"""
KS = f"list_filter(string_split(substring(regexp_extract({{u}}, {_P}, 4), 2), '&'), lambda kv: kv <> '' AND NOT regexp_matches(lower(regexp_extract(kv, '^([^=]*)', 1)), '^({U.TRACKING})$'))"


@query("h8_url_normalised", f"WITH a AS (SELECT page_id, replace(url, 'example', 'Example') || CASE WHEN page_id % 2 = 0 THEN '' ELSE '#x' END AS u FROM pages), b AS (SELECT *, {KS.format(u='u')} AS ks FROM a) SELECT page_id, {NORM.format(u='u')} AS url FROM b")
def h8(v):
    u = F.concat(F.replace("url", F.lit("example"), F.lit("Example")), F.when(F.col("page_id") % 2 == 0, "").otherwise("#x"))
    return v("pages").select("page_id", U.normalise(u).alias("url"))


@query("h9_keys", "SELECT page_id, sha256(url) AS url_hash, sha256('all' || '|' || 'all' || '|' || lower(url)) AS cache_key FROM pages")
def h9(v):
    return v("pages").select("page_id", U.url_hash(F.col("url")).alias("url_hash"), T.sha256(F.concat_ws("|", F.lit("all"), F.lit("all"), F.lower("url"))).alias("cache_key"))


@query("h10_root_domain", f"WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, {_P}, 2)), '.') AS p FROM pages) SELECT page_id, array_to_string(p[-2:], '.') AS root FROM h")
def h10(v):
    return v("pages").select("page_id", U.root_domain(F.col("url")).alias("root"))


@query("h11_content_hash", r"SELECT page_id, sha256(regexp_replace(regexp_replace(html, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS hash FROM pages")
def h11(v):
    return v("pages").select("page_id", T.sha256(T.noise_stripped(F.concat("html", F.lit(" Visitor Counter: 1234")))).alias("hash"))


@query("h12_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def h12(v):
    return v("documents").select("doc_id", T.sha256(F.col("text")).alias("hash"))


@query("h13_path_tags", "SELECT document_id, 'lib' AS department, department AS semester, course AS course FROM v_documents")
def h13(v):
    return v("v_documents").select("document_id", *ingest.path_tags(F.col("source_path")))


_ORDS = "list_sort(list_distinct(" + ORDINAL_WORDS.format(c="lower(q)") + r" || regexp_extract_all(lower(q), '\b(?:sem(?:ester)?|meeting|session)\s*([1-9]|10)\b', 1)))"


@query("h14_ordinals", f"SELECT message_id, array_to_string({_ORDS}, ' ') AS ordinals, {BODIES.format(c='lower(q)')}[1] AS body, 10 - len({_ORDS}) AS conflicts FROM v_questions")
def h14(v):
    """Ordinals of each message, its named body, and how many ordinals conflict with those it names."""
    found = T.ordinals(F.col("q"))
    return v("v_questions").select("message_id", F.array_join(F.array_sort(found), " ").alias("ordinals"), T.entity(F.col("q")).alias("body"), (10 - F.size(found)).cast("long").alias("conflicts"))


@query("h15_codes", "SELECT message_id, array_to_string(" + CODES.replace("text", "q") + ", ' ') AS codes FROM v_questions")
def h15(v):
    return v("v_questions").select("message_id", F.array_join(T.codes(F.col("q")), " ").alias("codes"))


@query("h16_latest_year", r"SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text || ' ' || (1960 + doc_id % 90), '\b(20[1-3][0-9]|19[7-9][0-9])\b'), lambda x: x::INT)), 0) AS year FROM documents")
def h16(v):
    return v("documents").select("doc_id", T.latest_year(F.concat_ws(" ", "text", (F.col("doc_id") % 90 + 1960).cast("string"))).alias("year"))


@query("h17_words", r"SELECT doc_id, greatest(1, len(regexp_extract_all(text, '\S+'))) AS tokens FROM documents WHERE text <> ''")
def h17(v):
    return v("documents").where("text <> ''").select("doc_id", T.words_estimate(F.col("text")).alias("tokens"))


@query("h18_previews", "SELECT doc_id, CASE WHEN length(text) > 140 THEN substring(text, 1, 140) || '...' ELSE text END AS p140, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) ELSE text END AS p80 FROM documents")
def h18(v):
    return v("documents").select("doc_id", T.preview(F.col("text"), 140).alias("p140"), T.preview(F.col("text"), 80, "").alias("p80"))


@query("h21_confidence", "SELECT audit_id, round(1 / (1 + pow(2.71828, -latency_ms / 1000)), 6) AS confidence, round(greatest(0, least(1, coalesce(confidence, 0))), 6) AS clamped FROM v_audit")
def h21(v):
    return v("v_audit").select("audit_id", F.round(1 / (1 + F.pow(F.lit(2.71828), -F.col("latency_ms") / 1000)), 6).alias("confidence"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))), 6).alias("clamped"))


#: Words that mark a language; the operator takes any table of this form.
MARKERS = {"en": ["the", "of", "that"], "de": ["der", "und", "ist"], "fr": ["les", "dans", "une"], "es": ["los", "con", "por"]}


_MARKED = "WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents) SELECT doc_id, " + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in ms)}))) AS n_{k}" for k, ms in MARKERS.items()) + " FROM w"


@query("h22_language_markers_whole", _MARKED)
@query("h22_language_markers", _MARKED)
def h22(v):
    d = v("documents").select("doc_id", F.split(F.lower("text"), r"[^\p{L}]+").alias("w"))

    def n(words):
        return F.size(F.filter("w", lambda x: x.isin(words))).cast("long")

    return d.select("doc_id", *(n(ms).alias(f"n_{k}") for k, ms in MARKERS.items()))


@query("h23_overview_intent", "SELECT message_id, " + " OR ".join(f"regexp_matches(q, '{p}')" for p in T.OVERVIEW) + " AS overview FROM v_questions")
def h23(v):
    return v("v_questions").select("message_id", T.is_overview(F.col("q")).alias("overview"))


@query("h24_small_talk", "SELECT message_id, CASE WHEN s = '' THEN 'greeting' " + " ".join(f"WHEN regexp_matches(s, '{smalltalk.whole(p)}') THEN '{k}'" for k, p in smalltalk.SMALL_TALK.items()) + " END AS intent FROM (SELECT message_id, " + _STRIP.format(c="q") + " AS s FROM v_greeted)")
def h24(v):
    return v("v_greeted").select("message_id", smalltalk.small_talk(F.col("q")).alias("intent"))


@query("h25_institutional", f"SELECT message_id, regexp_matches(lower(q), '{smalltalk.TERMS}') OR regexp_matches(q, '{smalltalk.CODE}') AS institutional FROM v_questions")
def h25(v):
    return v("v_questions").select("message_id", smalltalk.institutional(F.col("q")).alias("institutional"))


_PARTS = "regexp_extract(s, '" + T.TWO_PARTS + "', {n})"
_HALF = _PARTS.format(n=1) + " || ' for ' || " + _STRIP.format(c=_PARTS)


@query("h26_decomposed", f"WITH a AS (SELECT message_id, q, {_STRIP.format(c='q')} AS s, {_folded('q', T.EXPANSIONS, 'gi')} AS e FROM v_questions) SELECT message_id, unnest(CASE WHEN regexp_matches(s, '{T.TWO_PARTS}') THEN [{_HALF.format(n=2)}, {_HALF.format(n=3)}] WHEN e <> q THEN [e] ELSE [] END) AS q FROM a")
def h26(v):
    return v("v_questions").select("message_id", F.explode(T.decomposed(F.col("q"))).alias("q"))


@query("h27_keyword_ratio", "WITH m AS (SELECT message_id, " + CONTENT.format(c="content") + """ AS w, lower(lag(content) OVER (PARTITION BY session_id ORDER BY turn)) AS b FROM v_messages)
SELECT message_id, round(len(list_filter(w, lambda x: contains(coalesce(b, ''), x)))::DOUBLE / greatest(1, len(w)), 6) AS ratio FROM m""")
def h27(v):
    """Share of each message's content words that stand in the message before it."""
    before = F.lower(F.lag("content").over(W.partitionBy("session_id").orderBy("turn")))
    m = v("v_messages").select("message_id", search.content_words(F.col("content")).alias("w"), before.alias("b"))
    return m.select("message_id", F.round(F.size(F.filter("w", lambda x: F.contains(F.coalesce("b", F.lit("")), x))) / F.greatest(F.lit(1), F.size("w")), 6).alias("ratio"))


_TEXT = "regexp_extract({c}, '(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>', 1)"


@query("h28_html_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def h28(v):
    return v("pages").select("page_id", H.title(F.col("html")).alias("title"))


def _sql_text(c: str = "html") -> str:
    main = _TEXT.format(c=c)
    s = f"CASE WHEN {main} <> '' THEN {main} ELSE {c} END"
    for tag in ("script", "style", "nav", "header", "footer", "noscript"):
        s = f"regexp_replace({s}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for e, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{e}', '{c}')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


@query("h28_html_text", f"SELECT page_id, {_sql_text()} AS text FROM pages")
def h28b(v):
    return v("pages").select("page_id", H.text(F.col("html")).alias("text"))


_ALL = "regexp_extract_all(html, '{p}', 1)"
_HREFS = " || ".join(_ALL.format(p=p.replace("'", "''")) for p in H.LINKS)
_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def link_ctes(pages: str) -> str:
    """Common table expressions up to lk (page_id, link, kind), the links of pages (page_id, url, html)."""
    skip = " OR ".join(f"regexp_matches(link, '{p}')" for p in U.SKIP)
    return rf"""l AS (SELECT page_id, url, unnest(list_distinct({_HREFS})) AS href FROM {pages}), f AS (SELECT * FROM l WHERE NOT regexp_matches(href, '{H.NOT_FOLLOWED}')),
a AS (SELECT page_id, CASE WHEN regexp_matches(href, '^{_SCHEME}:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^({_SCHEME}:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^({_SCHEME}://[^/?#]*)', 1) || href ELSE regexp_replace(regexp_extract(url, '^({_SCHEME}://[^?#]*)', 1), '[^/]*$', '') || href END AS u FROM f),
b AS (SELECT *, {KS.format(u='u')} AS ks FROM a), nl AS (SELECT DISTINCT page_id, {NORM.format(u='u')} AS link FROM b),
k AS (SELECT *, CASE WHEN regexp_matches(lower(regexp_extract(link, {_P}, 3)), '\.(?:{U.DOCUMENT})$') OR regexp_matches(lower(regexp_extract(link, {_P}, 4)), '(?:\.|type=|format=)(?:{U.DOCUMENT})') THEN 'document' ELSE 'page' END AS kind FROM nl WHERE link IS NOT NULL),
lk AS (SELECT * FROM k WHERE kind = 'document' OR NOT ({skip}))"""


@query("h29_links", f"WITH {link_ctes('pages')} SELECT page_id, link, kind FROM lk")
def h29(v):
    return H.links(v("pages"))


_BANNERS = """html || '<img class="banner" src="/b' || CAST(page_id AS STRING) || '.png"><img src="/logo-banner.png"><IMG alt="Notice board" src="n.jpg">'"""


@query("h30_banners", f"""WITH h AS (SELECT page_id, {_BANNERS} AS html FROM pages), t AS (SELECT page_id, unnest(ts) AS tag, unnest(range(len(ts))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<img\\b[^>]*>') AS ts FROM h)),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS rank FROM t WHERE regexp_matches(tag, '(?i){H.BANNER}') AND NOT regexp_matches(tag, '(?i)logo|icon'))
SELECT page_id, regexp_extract(tag, '(?i)\\bsrc\\s*=\\s*"([^"]*)', 1) AS src, rank FROM r WHERE rank < 5""")
def h30(v):
    return H.banners(v("pages").select("page_id", F.expr(_BANNERS).alias("html")))


_TABLE = (
    "html || '<table id=\"fees\"><tr><th>a|b</th><th>n</th></tr><tr class=\"dxgvFilterRow\"><td>filter</td></tr><tr><td>x <b>y</b><!-- z --> <a href=\"/f/' || CAST(page_id AS STRING) || '.pdf\">list</a></td><td>' || CAST(page_id AS STRING)"
    " || '<table><tr><td>in &amp; in</td></tr><tr><td><a href=\"javascript:go()\">no</a><a href=\"g.html\">g</a></td></tr></table> after</td></tr></table></table><table class=\"radmenu\"><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    "<table><tr><td>Sun</td><td>Mon Tue Wed Thu Fri Sat</td></tr><tr><td>1</td></tr></table><table><tr><td>alone</td></tr></table>'"
)
_VALUE = """regexp_extract(token, '(?i)\\b{n}\\s*=\\s*["'']([^"'']*)["'']', 1)"""
_ATTRS = "lower(" + _VALUE.format(n="id") + " || ' ' || " + _VALUE.format(n="class") + ")"
_HREF = _VALUE.format(n="href")
_ABS = """CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || h ELSE regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*)', 1), '[^/]*$', '') || h END"""


def _entities(c: str) -> str:
    for entity, to in H.ENTITIES:
        c = "replace({}, '{}', '{}')".format(c, entity.replace("'", "''"), to.replace("'", "''"))
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("h31_tables", f"""WITH k0 AS (SELECT page_id, url, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT page_id, url, regexp_extract_all({_TABLE}, '{H.TOKEN}') AS ts FROM pages)),
k1 AS (SELECT *, lower(regexp_extract(token, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM k0),
k2 AS (SELECT *, sum(CASE tag WHEN 'table' THEN 1 WHEN '/table' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS s FROM k1),
k3 AS (SELECT *, s - min(least(s, 0)) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM k2),
k4 AS (SELECT *, max(CASE WHEN tag = 'table' THEN pos END) OVER (PARTITION BY page_id, depth ORDER BY pos) AS tb FROM k3 WHERE depth > 0 AND tag <> '/table'),
k5 AS (SELECT *, count(*) FILTER (tag = 'tr') OVER w AS rw, count(*) FILTER (tag IN ('td', 'th')) OVER w AS cl, first_value(CASE WHEN tag = 'table' THEN {_ATTRS} END IGNORE NULLS) OVER w AS kind FROM k4 WINDOW w AS (PARTITION BY page_id, tb ORDER BY pos)),
k6 AS (SELECT *, CASE WHEN tag = 'a' THEN trim({_HREF}) END AS h FROM k5 WHERE NOT regexp_matches(kind, '{H.NO_DATA}') AND rw > 0),
c AS (SELECT page_id, tb, rw, cl, {_entities("coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (NOT starts_with(token, '<')), '')")} AS v, list({_ABS} ORDER BY pos) FILTER (cl > 0 AND h <> '' AND NOT regexp_matches(h, '(?i)^javascript:')) AS ls, max(CASE WHEN tag = 'tr' THEN {_ATTRS} END) AS orow, bool_or(tag IN ('td', 'th')) AS is_cell FROM k6 GROUP BY ALL),
r AS (SELECT page_id, tb, rw, list(v ORDER BY cl) FILTER (is_cell) AS cells, list_distinct(flatten(list(coalesce(ls, []) ORDER BY cl) FILTER (is_cell))) AS links, coalesce(max(orow), '') AS orow FROM c GROUP BY ALL),
f AS (SELECT *, count(*) OVER (PARTITION BY page_id, tb) AS n, bool_or(contains(lower(array_to_string(cells, ' ')), '{H.WEEK}')) OVER (PARTITION BY page_id, tb) AS week FROM r)
SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY tb) - 1 AS table_no, rw - 1 AS row_no, array_to_string(cells, ' ; ') AS cells, coalesce(array_to_string(list_sort(links), ' '), '') AS links FROM f WHERE n >= 2 AND NOT week AND NOT regexp_matches(orow, '{H.FILTER_ROW}') AND array_to_string(cells, '') <> ''""")
def h31(v):
    """Rows of all data tables, with the links of each row; to each page tables are added, one of them within a cell of another."""
    t = H.tables(v("pages").select("page_id", "url", F.expr(_TABLE).alias("html")))
    return t.select("page_id", "table_no", "row_no", F.array_join("cells", " ; ").alias("cells"), F.array_join(F.array_sort("links"), " ").alias("links"))


@query("h32_portal_links", r"""WITH l AS (SELECT page_id, m, i FROM (SELECT page_id, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]*href="[^"]*"[^>]*>[^<]*</a>') AS ms FROM pages))),
x AS (SELECT page_id, i, regexp_extract(m, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(m, '>([^<]*)</a>', 1)) AS label FROM l), d AS (SELECT page_id, href, min(i) AS i, arg_min(label, i) AS label FROM x WHERE regexp_matches(href, '(?i)en|de') AND length(label) >= 3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM d) SELECT page_id, href, label FROM r WHERE k <= 25""")
def h32(v):
    """The first 25 distinct links of a page whose target has a keyword and whose label has three characters or more."""
    tag = v("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))).alias("i", "m"))
    x = tag.select("page_id", "i", F.regexp_extract("m", 'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_extract("m", ">([^<]*)</a>", 1)).alias("label"))
    d = x.where(F.col("href").rlike("(?i)en|de") & (F.length("label") >= 3)).groupBy("page_id", "href").agg(F.min(F.struct("i", "label")).alias("f"))
    return d.withColumn("k", F.row_number().over(W.partitionBy("page_id").orderBy("f.i"))).where("k <= 25").select("page_id", "href", F.col("f.label").alias("label"))


@query("h33_due_jobs", "SELECT event_id, ts + INTERVAL 90 MINUTE AS next_run, ts + INTERVAL 90 MINUTE <= TIMESTAMP '2024-01-15 00:00:00' AS due, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAY AS old FROM events")
def h33(v):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    due = F.col("ts") + F.expr("interval 90 minutes")
    return v("events").select("event_id", due.alias("next_run"), (due <= now).alias("due"), (F.col("ts") < now - F.expr("interval 7 days")).alias("old"))


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format(c='x')}), lambda x: x <> '' AND NOT regexp_matches(x, '{T.LETTERHEAD}'))"


@query("h34_lead_lines", f"SELECT doc_id, array_to_string(({_LINES})[1:3], ' ') AS summary FROM v_minutes")
def h34(v):
    return v("v_minutes").select("doc_id", T.lead_lines(F.col("text")).alias("summary"))


@query("h34_meetings", f"""WITH j AS (SELECT doc_id, array_to_string({_LINES}, ' ') AS j FROM v_minutes), h AS (SELECT doc_id, regexp_extract(j, '{T.CONVENED}', 1) AS m, {_STRIP.format(c="regexp_replace(" + _STRIP.format(c=f"regexp_extract(j, '{T.CONVENED}', 2)") + r", '(?is)\s+(?:constitution|annexure|item|to\s+consider).*$', '')")} AS h FROM j WHERE regexp_matches(j, '{T.CONVENED}'))
SELECT doc_id, {_STRIP.format(c='m')} AS meeting, CASE WHEN ends_with(h, '.') THEN h ELSE h || '.' END AS held FROM h""")
def h34_meetings(v):
    m = v("v_minutes").select("doc_id", T.convened(F.col("text")).alias("m"))
    return m.where("m is not null").select("doc_id", "m.meeting", "m.held")


_BELOW = f"(SELECT doc_id, ls[list_position(list_transform(ls, lambda x: regexp_matches(x, '{T.PRESENT}')), true) + 1:] AS below FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format(c='x')}), lambda x: x <> '') AS ls FROM v_minutes))"


@query("h34_attendees", f"SELECT doc_id, array_to_string(list_transform(below[:least(10, coalesce(nullif(list_position(list_transform(below, lambda x: regexp_matches(x, '{T.ENTRY}') OR regexp_matches(x, '{T.HONORIFIC}')), false), 0) - 1, len(below)))], lambda x: regexp_replace(x, '{T.ENTRY}', '')), ', ') AS names FROM {_BELOW}")
def h34_attendees(v):
    """Who was present."""
    return v("v_minutes").select("doc_id", F.array_join(T.attendees(F.col("text")), ", ").alias("names"))


SYNOPSIS = r"""WITH n AS (SELECT session_id, any_value(department) AS department, count(*) AS chunks FROM v_messages GROUP BY session_id),
u0 AS (SELECT session_id, turn, '**' || upper(regexp_extract(content, '{unit}', 1)) || '**: ' || substring(regexp_replace(regexp_extract(content, '{unit}', 2), '^\s+|\s+$', '', 'g'), 1, 70) AS x FROM v_messages WHERE regexp_matches(content, '{unit}')),
u AS (SELECT session_id, string_agg('- ' || x, chr(10) ORDER BY t) AS units FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t) AS k FROM (SELECT session_id, x, min(turn) AS t FROM u0 GROUP BY ALL)) WHERE k <= 6 GROUP BY session_id),
f0 AS (SELECT session_id, turn, unnest(fs) AS x, unnest(range(len(fs))) AS i FROM (SELECT session_id, turn, regexp_extract_all(content, '{formula}', 1) AS fs FROM v_messages)),
f AS (SELECT session_id, string_agg('- `' || x || '`', chr(10) ORDER BY t) AS formulas FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t) AS k FROM (SELECT session_id, x, min((turn, i)) AS t FROM f0 WHERE length(x) > 3 GROUP BY ALL)) WHERE k <= 6 GROUP BY session_id),
s0 AS (SELECT session_id, turn, unnest(ss[1:2]) AS x, unnest(range(len(ss[1:2]))) AS i FROM (SELECT session_id, turn, list_filter(list_transform(string_split(content, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 35) AS ss FROM v_messages)),
s AS (SELECT session_id, string_agg('- *"' || substring(x, 1, 140) || '"*', chr(10) ORDER BY t) AS concepts FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t) AS k FROM (SELECT session_id, x, min((turn, i)) AS t FROM s0 WHERE regexp_matches(lower(x), '{words}') GROUP BY ALL)) WHERE k <= 4 GROUP BY session_id),
y AS (SELECT n.session_id, 'Material of ' || department || ', course all, titled ' || n.session_id || ', in ' || chunks || ' parts.' AS l0, coalesce(units, '- No units named.') AS units, coalesce(chr(10) || '## Formulas' || chr(10) || formulas, '') AS formulas, coalesce(concepts, '- No concepts defined.') AS concepts FROM n LEFT JOIN u USING (session_id) LEFT JOIN f USING (session_id) LEFT JOIN s USING (session_id))
SELECT session_id AS document_id, l0, '# ' || session_id || chr(10) || l0 || chr(10) || '## Units' || chr(10) || units || formulas || chr(10) || '## Concepts' || chr(10) || concepts AS l1 FROM y""".replace("{unit}", synopsis.UNIT).replace("{words}", synopsis.CONCEPT).replace("{formula}", synopsis.FORMULA.replace("'", "''"))


@query("h35_synopsis", f"SELECT *, len(regexp_extract_all(l0, '\\S+')) AS l0_tokens, len(regexp_extract_all(l1, '\\S+')) AS l1_tokens FROM ({SYNOPSIS})")
def h35(v):
    """Short and long synopsis of each session, whose messages stand for the chunks of a document."""
    m = v("v_messages")
    chunks = m.select(F.col("session_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("content").alias("text"))
    docs = m.groupBy(F.col("session_id").alias("document_id")).agg(F.max("department").alias("department")).select("document_id", F.col("document_id").alias("title"), "department", F.lit("all").alias("course"))
    return synopsis.synopses(docs, chunks)


@query("e9_first_matches", r"WITH m AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ing')) AS d, regexp_extract_all(text, '[A-Z][a-z]+ing') AS a FROM documents), x AS (SELECT doc_id, unnest(d) AS w, a FROM m), r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(a, w)) AS k FROM x) SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS found FROM r WHERE k <= 6 GROUP BY doc_id")
def e9(v):
    found = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ing"), F.lit(0))), 1, 6)
    return v("documents").select("doc_id", F.array_join(found, " ").alias("found")).where("found <> ''")


@query("k6_moderation")
def k6(v):
    """Category of each message and of the same text as feedback; the tests hold it against plain Python, as SQL lacks NFKD."""
    q = F.col("q")
    return v("v_questions").select("message_id", moderation.tag(q)["category"].alias("category"), moderation.tag(q, feedback=True)["category"].alias("as_feedback"))


@query("k6_moderation_rules")
def k6_rules(v):
    """The same by a table of rules, which tasks make into an automaton."""
    return moderate.tagged(v("v_questions"), moderate.rule_table(v.spark), "message_id", "q")


@query("k6_moderation_documents")
def k6_documents(v):
    """Whole documents by category, and how many of each are labelled at all and labelled toxic."""
    found = moderate.tagged(v("documents"), moderate.rule_table(v.spark), "doc_id").join(v("labels").select("doc_id", "toxic"), "doc_id", "left")
    return found.groupBy("category").agg(F.count("*").alias("documents"), F.count("toxic").alias("labelled"), F.sum("toxic").alias("toxic"))


_RULE = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN {{t{i}}}" for i, (_, p) in enumerate(T.INJECTION)) + " END"


@query("k7_injection", "SELECT message_id, " + _RULE.format(**{f"t{i}": f"'{n}'" for i, (n, _) in enumerate(T.INJECTION)}) + " AS rule, " + _RULE.format(**{f"t{i}": f"regexp_extract(q, '{p}', 0)" for i, (_, p) in enumerate(T.INJECTION)}) + " AS snippet FROM v_questions")
def k7(v):
    r = T.injection_rule(F.col("q"))
    return v("v_questions").select("message_id", r["rule"].alias("rule"), r["snippet"].alias("snippet"))
