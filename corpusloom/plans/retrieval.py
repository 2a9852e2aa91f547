"""Queries of retrieval: BM25, vectors, fusion, reranking, gate, evaluation (C14-C18, D4, B10-B12, E12-E13, F, K)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import chunks, feeds, ingest, search
from corpusloom.sources.scratch import materialise, new_path

from .analytics import PREVIOUS, file_changes_sql
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = """flatten(list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+(?:[.-][a-z0-9]+)*'), lambda w: CASE WHEN regexp_matches(w, '[.-]') THEN [w, regexp_replace(w, '[.-]', '', 'g')] ELSE [w] END))"""
TOKENS = "list_filter(" + _TOK + ", lambda w: length(w) > 1)"
#: BM25 of the queries {asked} (query_id, query) over {docs} (chunk_id, title, text), up to the queries' tokens.
_TERMS = f"""WITH ch AS (SELECT chunk_id, {TOKENS.format(c="title || ' ' || text")} AS t FROM {{docs}}),
po AS (SELECT chunk_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS token FROM ch) GROUP BY chunk_id, token),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ch),
df AS (SELECT token, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po, st GROUP BY token, n),
iw AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q0 AS (SELECT query_id, query, {TOKENS.format(c="query")} AS t FROM {{asked}}),
q1 AS (SELECT query_id, query, t, list_filter(t, lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w)) AS c FROM q0),
"""
_PLAIN_DOCS, _PLAIN_ASKED = "(SELECT document_id AS chunk_id, title, text FROM v_documents)", "(SELECT item_id AS query_id, text AS query FROM benchmark)"
_SCORE = "sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))"
_BM25 = (
    _TERMS.format(docs=_PLAIN_DOCS, asked=_PLAIN_ASKED)
    + f"""qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(CASE WHEN len(c) > 0 THEN c ELSE t END) AS token FROM q1) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round({_SCORE}, 6) AS score FROM qt JOIN po USING (token) JOIN iw USING (token), st GROUP BY ALL HAVING {_SCORE} > 0),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM sc)
"""
)


def texts(v):
    return v("v_documents").select(F.col("document_id").alias("chunk_id"), F.concat_ws(" ", "title", "text").alias("text"))


@query("d4_term_statistics", _BM25 + "SELECT token, df, round(idf, 6) AS idf FROM iw")
def d4(v):
    c = texts(v)
    return search.idf(search.term_documents(c), c.count()).select("token", "df", F.round("idf", 6).alias("idf"))


@query("bm25_search", _BM25 + "SELECT query_id, chunk_id, score, rank FROM bm WHERE rank < 20")
def bm25(v):
    return search.bm25(v("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), texts(v))


_SYNONYMS = "CASE w " + " ".join(f"WHEN '{w}' THEN '{x}'" for w, n in T.ORDINALS.items() for x, m in T.ORDINALS.items() if n == m and w != x) + " END"
_NUMBER = "CASE w " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in T.ORDINALS.items()) + " END"
ORDINAL_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all({c}, '\\b[a-z0-9]+\\b'), lambda w: " + _NUMBER + "), lambda x: x IS NOT NULL))"
BODIES = "list_filter([" + ", ".join(f"'{e}'" for e in T.ENTITIES) + "], lambda e: contains({c}, e))"
CODES = "list_transform(list_filter(regexp_extract_all(text, '\\b[A-Za-z0-9_-]{4,20}\\b'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]')), lambda w: lower(regexp_replace(w, '[\\s_-]', '', 'g')))"
#: All ordinals of a question in lower case.
ORDS = "list_distinct(" + ORDINAL_WORDS + " || regexp_extract_all({c}, '\\b(?:sem(?:ester)?|meeting|session)\\s*([1-9]|10)\\b', 1))"
#: The boosts for every pair of query and document, with none left out beforehand.
_BOOSTED = (
    _TERMS.format(docs="{docs}", asked="{asked}")
    + rf"""q2 AS (SELECT query_id, query, c, CASE WHEN len(c) > 0 THEN c ELSE t END AS t FROM q1 WHERE len(t) > 0),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(t || list_distinct(list_filter(list_transform(t, lambda w: {_SYNONYMS}), lambda x: x IS NOT NULL AND NOT list_contains(t, x)))) AS token FROM q2) GROUP BY ALL),
tk AS (SELECT query_id, chunk_id, {_SCORE} AS score FROM qt JOIN po USING (token) JOIN iw USING (token), st GROUP BY ALL),
qf AS (SELECT query_id, list_distinct(c) AS terms, len(c) AS n, {CODES.replace("text", "query").replace("{4,20}", "{{4,20}}")} AS codes, {ORDS.format(c="lower(query)")} AS ords, {BODIES.format(c="lower(query)")}[1] AS body, regexp_matches(lower(query), '{search.RESULTS}') AS results FROM q2),
d0 AS (SELECT chunk_id, lower(title) AS title, course, lower(coalesce(text, '')) AS text FROM {{docs}}),
df0 AS (SELECT *, lower(regexp_replace(title || ' ' || course || ' ' || substring(text, 1, 1200), '[\s_-]', '', 'g')) AS head, {ORDINAL_WORDS.format(c="title")} AS t_ords, {ORDINAL_WORDS.format(c="substring(text, 1, 400)")} AS h_ords, {BODIES.format(c="title")} AS t_bodies, {BODIES.format(c="substring(text, 1, 400)")} AS h_bodies FROM d0),
bo AS (SELECT query_id, chunk_id, CASE WHEN n >= 2 AND len(list_filter(terms, lambda x: contains(text, x) OR contains(title, x))) = len(terms) THEN 35 ELSE 0 END + CASE WHEN regexp_matches(title, '{search.GAZETTE}') AND NOT results THEN -25 ELSE 0 END + 15 * len(list_filter(codes, lambda x: contains(head, x)))
+ CASE WHEN len(ords) = 0 THEN 0 WHEN list_has_any(t_ords, ords) THEN 10 WHEN len(t_ords) > 0 THEN -20 WHEN list_has_any(h_ords, ords) THEN 3 ELSE 0 END + CASE WHEN body IS NULL THEN 0 WHEN list_contains(t_bodies, body) THEN 8 WHEN len(t_bodies) > 0 THEN -20 WHEN list_contains(h_bodies, body) THEN 2 ELSE 0 END AS boost FROM qf, df0),
sc AS (SELECT query_id, chunk_id, round(coalesce(score, 0) + boost, 6) AS score FROM bo LEFT JOIN tk USING (query_id, chunk_id) WHERE coalesce(score, 0) + boost > 0),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM sc)
"""
)
_FOUND = _BOOSTED.format(docs="v_titled", asked="v_asked")


@query("bm25_search_boosted", _FOUND + "SELECT query_id, chunk_id, score, rank FROM bm WHERE rank < 20")
def bm25_boosted(v):
    return search.bm25_boosted(v("v_asked"), v("v_titled"))


@query("k3_search_in_scope", _FOUND.replace("FROM bo LEFT JOIN tk USING (query_id, chunk_id) WHERE", "FROM bo LEFT JOIN tk USING (query_id, chunk_id) JOIN v_titled USING (chunk_id) WHERE v_titled.course = 'en' AND") + "SELECT query_id, chunk_id, score, rank FROM bm WHERE rank < 20")
def k3_in_scope(v):
    """Statistics over all documents, hits in one course."""
    return search.bm25_boosted(v("v_asked"), v("v_titled"), scope=F.col("course") == "en")


_HEX = "0123456789abcdef"


def hashed_vectors(name: str, source: str) -> str:
    """A common table expression ``name`` (id, v) with the hashed vectors of source (id, text), not scaled to unit length: buckets are
    the digests modulo 384, from their last 7 bits and their digit sum modulo 3."""
    low = f"(16 * (strpos('{_HEX}', h[-2]) - 1) + strpos('{_HEX}', h[-1]) - 1) % 128"
    three = "(length(translate(h, '0369cf258be', '')) + 2 * length(translate(h, '0369cf147ad', ''))) % 3"
    bucket = f"({low}) + 128 * ((2 * ({three} + 3 - ({low}) % 3)) % 3)"
    return f"""{name}_w AS (SELECT id, CASE WHEN s = '' THEN [] ELSE regexp_split_to_array(s, '\\s+') END AS ws FROM (SELECT id, regexp_replace(lower(coalesce(text, '')), '^\\s+|\\s+$', '', 'g') AS s FROM ({source}))),
{name}_h AS (SELECT id, md5(unnest(ws)) AS h, 1.5 AS w FROM {name}_w UNION ALL SELECT id, sha256(unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1]))), 2.0 FROM {name}_w WHERE len(ws) > 1),
{name}_b AS (SELECT id, b, sum(CASE WHEN b % 2 = 0 THEN w ELSE -w END)::DOUBLE AS x FROM (SELECT id, {bucket} AS b, w FROM {name}_h) GROUP BY id, b),
{name} AS (SELECT w.id, list(coalesce(x, 0) ORDER BY g.b) AS v FROM {name}_w w CROSS JOIN (SELECT unnest(range(384)) AS b) g LEFT JOIN {name}_b n ON n.id = w.id AND n.b = g.b GROUP BY w.id)"""


def _vectors(v):
    e = v("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "label")
    return q, e.select("vec_id", F.col("embedding").alias("vec"), "label")


_VEC = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, x.vec_id, q.label AS ql, x.label AS xl, round(list_cosine_similarity(q.v, x.v), 6) AS score FROM e q, e x WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
"""


@query("c14_vector_top_k", _VEC + "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s) SELECT query_id, vec_id, score, rank FROM t WHERE rank < 10")
def c14(v):
    q, e = _vectors(v)
    return search.vector_top_k(q, e, 10)


@query("c14_vector_top_k_in_scope", _VEC + "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s WHERE ql = xl AND score >= 0.2) SELECT query_id, vec_id, score, rank FROM t WHERE rank < 10")
def c14b(v):
    q, e = _vectors(v)
    return search.vector_top_k(q, e, 10, 0.2, "label")


@query("c14_vector_approximate")
def c14c(v):
    q, e = _vectors(v)
    return search.coded_top_k(q, e, 10)


def _lists(v, k: int = 20):
    """The k nearest vectors, and the first k of the same label by id; the members of a label are numbered once."""
    q, e = _vectors(v)
    dense = search.vector_top_k(q, e, k).withColumnRenamed("vec_id", "chunk_id")
    first = feeds.top_k(e.select("label", "vec_id"), ["label"], [F.col("vec_id")], k)
    sparse = first.join(q.select("query_id", "label"), "label").select("query_id", F.col("vec_id").alias("chunk_id"), F.lit(1.0).alias("score"), "rank")
    return dense, sparse


_LISTED = _VEC + """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS r FROM s) WHERE r < {k}),
sp AS (SELECT * FROM (SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY x.vec_id) - 1 AS r FROM e q JOIN e x ON q.label = x.label WHERE q.vec_id % 20 = 0) WHERE r < {k}),
u AS (SELECT coalesce(d.query_id, sp.query_id) AS query_id, coalesce(d.vec_id, sp.vec_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (61 + d.r), 0) + coalesce(1.0::DOUBLE / (61 + sp.r), 0), 9) AS rrf, d.score AS dense_score FROM d FULL JOIN sp ON d.query_id = sp.query_id AND d.vec_id = sp.vec_id),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) - 1 AS rank FROM u) WHERE rank < {n})
"""
_FUSED = _LISTED.format(k=20, n=50)


@query("c16_rank_fusion", _FUSED + "SELECT query_id, chunk_id, rrf, rank FROM f")
def c16(v):
    return search.fuse(*_lists(v)).select("query_id", "chunk_id", "rrf", "rank")


@query("b10_dense_floor", _FUSED + "SELECT query_id, vec_id AS chunk_id FROM d WHERE score >= 0.2")
def b10(v):
    return _lists(v)[0].where("score >= 0.2").select("query_id", "chunk_id")


@query("b11_relevance_floor", _LISTED.format(k=80, n=200) + ", k AS (SELECT *, CASE WHEN query_id % 40 = 0 THEN rank < 10 ELSE coalesce(dense_score >= 0.2, false) OR rrf > 0.01 END AS ok FROM f) SELECT query_id, chunk_id FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS anyok FROM k) WHERE ok OR (NOT anyok AND rank < 5)")
def b11(v):
    """Long lists, so that their ends fall below the floors; half of the queries come with scores of a reranker."""
    hits = search.fuse(*_lists(v, 80), keep=200)
    hits = hits.withColumn("rerank_score", F.when(F.col("query_id") % 40 == 0, F.when(F.col("rank") < 10, -2.0).otherwise(-2.1)))
    return search.relevance_floor(hits, 5).select("query_id", "chunk_id")


#: Rank and scores of reranked hits: query words of three letters or more, ordinals and bodies of the title.
_SHOWN = """{h}w AS (SELECT *, lower(title) AS lt, list_filter(list_distinct(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+')), lambda x: length(x) > 2) AS ws FROM {h}),
{h}s AS (SELECT *, {ords} AS qo, {t_ords} AS tord, {q_body}[1] AS qb, {t_bodies} AS tb FROM {h}w),
{h}r AS (SELECT * EXCLUDE (rank), round({base} + 0.2 * len(list_filter(ws, lambda x: contains(lower(text), x) OR contains(lt, x))) + CASE WHEN len(qo) = 0 THEN 0 WHEN list_has_any(qo, tord) THEN 5 WHEN len(tord) > 0 THEN -10 ELSE 0 END + CASE WHEN qb IS NULL THEN 0 WHEN contains(lt, qb) THEN 3 WHEN len(tb) > 0 THEN -10 ELSE 0 END, 6) AS rerank_score FROM {h}s),
{h}k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) - 1 AS rank FROM {h}r)
"""


def _shown(h: str, base: str) -> str:
    return _SHOWN.format(h=h, base=base, ords=ORDS.format(c="lower(query)"), t_ords=ORDINAL_WORDS.format(c="lt"), q_body=BODIES.format(c="lower(query)"), t_bodies=BODIES.format(c="lt"))


_HITS = _FOUND.rstrip() + """, h AS (SELECT bm.query_id, bm.chunk_id, bm.score, bm.rank, q.query, d.title, d.text, d.department FROM bm JOIN v_asked q USING (query_id) JOIN v_titled d USING (chunk_id) WHERE bm.rank < 20),
""" + _shown("h", "score")


def hits(v):
    found = search.bm25_boosted(v("v_asked"), v("v_titled")).join(v("v_asked"), "query_id")
    return found.join(v("v_titled").select("chunk_id", "title", "text", "department"), "chunk_id")


def reranked(v):
    return search.rerank(hits(v), 20, base="score")


@query("k2_lexical_rerank", _HITS + "SELECT query_id, chunk_id, rerank_score, rank FROM hk WHERE rank < 20")
def k2(v):
    return reranked(v).select("query_id", "chunk_id", "rerank_score", "rank")


@query("f3_cut_offs", _HITS + "SELECT query_id, chunk_id, rank FROM hk WHERE rank < 5")
def f3(v):
    return reranked(v).where("rank < 5").select("query_id", "chunk_id", "rank")


@query("e13_winner", _HITS + "SELECT query_id, chunk_id, first_value(department) OVER (PARTITION BY query_id ORDER BY rank) AS winner FROM hk")
def e13(v):
    return reranked(v).select("query_id", "chunk_id", F.first("department").over(W.partitionBy("query_id").orderBy("rank")).alias("winner"))


_COHESIVE = ", c0 AS (SELECT *, NOT ((len(qo) > 0 AND len(list_filter(tord, lambda x: NOT list_contains(qo, x))) > 0) OR (qb IS NOT NULL AND len(list_filter(tb, lambda x: x <> qb)) > 0)) AS ok FROM {k}), c1 AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS anyok FROM c0), co AS (SELECT * FROM c1 WHERE ok OR NOT anyok) "


@query("b12_cohesion", _HITS + _COHESIVE.format(k="hk") + "SELECT query_id, chunk_id FROM co")
def b12(v):
    return search.cohesive(reranked(v)).select("query_id", "chunk_id")


@query("e12_promotion", _HITS + "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY (department <> winner), rank) - 1 AS promoted FROM (SELECT *, first_value(department) OVER (PARTITION BY query_id ORDER BY rank) AS winner FROM hk)")
def e12(v):
    r = reranked(v).withColumn("winner", F.first("department").over(W.partitionBy("query_id").orderBy("rank")))
    return feeds.numbered(r, ["query_id"], [F.col("department") != F.col("winner"), F.col("rank")], "promoted").select("query_id", "chunk_id", "promoted")


_YEAR = "coalesce(list_max(list_transform(regexp_extract_all(title || ' ' || substring(text, 1, 300), '\\b(20[1-3][0-9]|19[7-9][0-9])\\b'), lambda x: x::INT)), 0)"


@query("f4_recency", _HITS + f", y AS (SELECT *, {_YEAR} AS year FROM hk) SELECT query_id, chunk_id, year, row_number() OVER (PARTITION BY query_id ORDER BY year DESC, rerank_score DESC, chunk_id) - 1 AS rank FROM y")
def f4(v):
    return search.by_year(reranked(v).drop("rank"), "title", "text", "rerank_score").select("query_id", "chunk_id", "year", "rank")


_GATE_WORDS = ", ".join(f"'{w}'" for w in dict.fromkeys(search.GATE_STOP + search.GATE_STOP_HINDI))
CONTENT = "list_filter(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$')) || regexp_extract_all(lower({c}), '[\\x{{0900}}-\\x{{097F}}]{{2,}}')), lambda x: NOT list_contains([" + _GATE_WORDS + "], x))"
#: The gate over hits {k} (query_id, rank, rerank_score, score, title, text).
_GATE = """, g2 AS (SELECT query_id, lower(query) AS q, """ + CONTENT.format(c="query").replace("{", "{{").replace("}", "}}") + """ AS gw FROM v_asked),
fo AS (SELECT query_id, count(DISTINCT w) AS found FROM (SELECT query_id, t, unnest(gw) AS w FROM g2 JOIN (SELECT query_id, lower(text || ' ' || title) AS t FROM {k} WHERE rank < 3) USING (query_id)) WHERE contains(t, w) GROUP BY query_id),
be AS (SELECT query_id, max(rerank_score) AS r, max(score) AS d FROM {k} GROUP BY query_id),
g3 AS (SELECT query_id, q, len(gw) AS n, r, d, r IS NULL OR regexp_matches(q, '""" + "|".join(T.OUT_OF_DOMAIN) + """') AS outside, round(coalesce(found, 0)::DOUBLE / greatest(1, len(gw)), 6) AS keyword_ratio FROM g2 LEFT JOIN be USING (query_id) LEFT JOIN fo USING (query_id)),
g4 AS (SELECT *, round(CASE WHEN outside THEN 0 ELSE 1 / (1 + pow(2.71828, -r)) END, 6) AS confidence FROM g3),
gt AS (SELECT query_id, confidence, keyword_ratio, CASE WHEN outside OR (r < -2.5 AND keyword_ratio < 0.25) OR (coalesce(d, 0) < 0.22 AND keyword_ratio < 0.2) THEN 'INCORRECT' WHEN regexp_matches(q, ' versus | vs | and | both |compare') AND n >= 4 AND confidence < 0.65 THEN 'AMBIGUOUS' ELSE 'CORRECT' END AS decision FROM g4)
"""
#: Hits of one list, fused by themselves, so that scores are those that the gate's thresholds are made for.
_FUSED_HITS = _FOUND.rstrip() + """, h AS (SELECT bm.query_id, bm.chunk_id, bm.rank, round(1.0::DOUBLE / (61 + bm.rank), 9) AS rrf, bm.score, q.query, d.title, d.text, d.department FROM bm JOIN v_asked q USING (query_id) JOIN v_titled d USING (chunk_id) WHERE bm.rank < 20),
""" + _shown("h", "rrf")


@query("k5_gate", _FUSED_HITS + _GATE.format(k="hk") + "SELECT * FROM gt")
def k5(v):
    h = hits(v).withColumns({"rrf": F.round(1.0 / (61 + F.col("rank")), 9), "dense_score": F.lit(None).cast("double"), "bm25_score": F.col("score")})
    return search.gate(search.rerank(h, 20), v("v_asked"))


@query("k15_evaluation", _FUSED_HITS + _GATE.format(k="hk") + """, tx AS (SELECT item_id AS query_id, text AS passage FROM benchmark), rl AS (SELECT query_id, rank, contains(text, passage)::INT AS good FROM hk JOIN tx USING (query_id)),
pl AS (SELECT query_id, max(good) AS planted FROM rl GROUP BY 1), c AS (SELECT query_id, coalesce(planted, 0) AS planted, decision, (SELECT max(good) FROM rl WHERE rl.query_id = gt.query_id AND rank < 5) AS hit, (SELECT avg(good) FROM rl WHERE rl.query_id = gt.query_id AND rank < 5) AS share FROM gt LEFT JOIN pl USING (query_id))
SELECT count(*) AS cases, count(*) FILTER (planted = 1) AS planted, round(avg(hit) FILTER (planted = 1), 6) AS hit_rate, round(avg(share) FILTER (planted = 1), 6) AS precision, round(avg((decision = 'INCORRECT')::INT) FILTER (planted = 0), 6) AS abstention FROM c""")
def k15(v):
    """Over the benchmark: hits and precision among the first five for passages that a hit holds, and how often the gate abstains for
    the others."""
    h = hits(v).withColumns({"rrf": F.round(1.0 / (61 + F.col("rank")), 9), "dense_score": F.lit(None).cast("double"), "bm25_score": F.col("score")})
    r = materialise(search.rerank(h, 20))
    graded = search.gate(r, v("v_asked"))
    good = r.join(v("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")), "query_id").select("query_id", "rank", F.contains(F.col("text"), F.col("passage")).cast("int").alias("good"))
    top = F.when(F.col("rank") < 5, F.col("good"))
    by = good.groupBy("query_id").agg(F.max("good").alias("planted"), F.max(top).alias("hit"), F.avg(top).alias("share"))
    c = graded.join(by, "query_id", "left").withColumn("planted", F.coalesce("planted", F.lit(0)))
    there, gone = F.col("planted") == 1, F.col("planted") == 0
    return c.agg(F.count("*").alias("cases"), F.count_if(there).alias("planted"), F.round(F.avg(F.when(there, F.col("hit"))), 6).alias("hit_rate"), F.round(F.avg(F.when(there, F.col("share"))), 6).alias("precision"), F.round(F.avg(F.when(gone, (F.col("decision") == "INCORRECT").cast("int"))), 6).alias("abstention"))


def _packed(parts: str, between: str) -> str:
    """SQL of a list's parts packed to about 1,500 characters."""
    return f"list_reduce(list_transform({parts}, lambda p: [p]), lambda a, x: CASE WHEN length(a[-1]) > 0 AND length(a[-1]) + length(x[1]) > {chunks.SIZE} THEN a || x WHEN length(a[-1]) = 0 THEN a[:-2] || x ELSE a[:-2] || [a[-1] || {between} || x[1]] END)"


def chunked(c: str) -> str:
    """SQL of the list of chunks of a text."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    lines = f"flatten(list_transform(string_split(para, chr(10)), lambda line: CASE WHEN length(line) <= {chunks.SIZE} THEN [line] ELSE list_transform(range(0, length(line), {chunks.SIZE - chunks.OVERLAP}), lambda i: substring(line, i + 1, {chunks.SIZE})) END))"
    paras = f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '\\n{{2,}}'), lambda z: {strip('z')}), lambda z: z <> '')"
    blocks = f"flatten(list_transform({paras}, lambda para: CASE WHEN length(para) <= {chunks.SIZE} THEN [para] ELSE {_packed(lines, 'chr(10)')} END))"
    whole = f"CASE WHEN len({paras}) = 0 THEN [] ELSE {_packed(blocks, 'chr(10) || chr(10)')} END"
    return f"list_filter(list_transform({whole}, lambda z: {strip('z')}), lambda z: z <> '')"


@query("k1_chunks", f"WITH c AS (SELECT document_id, {chunked('text')} AS cs FROM v_documents), x AS (SELECT document_id, unnest(cs) AS text, unnest(range(len(cs))) AS chunk_index FROM c) SELECT document_id, chunk_index, text, sha256(text) AS content_hash FROM x")
def k1(v):
    return chunks.chunk(v("v_documents"))


@query("c18_first_chunk", """WITH h AS (SELECT conv_id // 4 AS query_id, conv_id AS document_id, turn AS chunk_index, row_number() OVER (PARTITION BY conv_id // 4 ORDER BY length(text) DESC, conv_id, turn) - 1 AS rank FROM conversations),
t AS (SELECT * FROM h WHERE rank < 4), b AS (SELECT query_id, document_id FROM t WHERE rank = 0), m AS (SELECT *, document_id = (SELECT document_id FROM b WHERE b.query_id = t.query_id) AND chunk_index = 0 AS page FROM t),
x AS (SELECT query_id, document_id, chunk_index, CASE WHEN page AND query_id % 2 = 0 THEN -1 ELSE rank END AS r FROM m UNION ALL SELECT query_id, document_id, 0, -1 FROM b WHERE query_id NOT IN (SELECT query_id FROM m WHERE page))
SELECT query_id, document_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS rank FROM x""")
def c18(v):
    """Hits with the first chunk of the best hit's document: messages stand for the chunks of their conversation, and half of the
    queries ask for a date."""
    c = v("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text")
    q = c.withColumns({"query_id": F.floor(F.col("document_id") / 4), "query": F.when(F.floor(F.col("document_id") / 4) % 2 == 0, "when was it").otherwise("who is it"), "rerank_score": F.length("text").cast("double")})
    found = feeds.top_k(q, ["query_id"], [F.col("rerank_score").desc(), F.col("document_id"), F.col("chunk_index")], 4)
    return search.first_pages(found, c).select("query_id", "document_id", "chunk_index", "rank")


_LOWER_SQL = "regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _normalised(c: str) -> str:
    for pattern, to in (*T.TYPOS, *T.ACRONYMS):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'gi')"
    return _LOWER_SQL.format(c=c)


def _chain_sql(asked: str, chunks: str) -> str:
    """SQL of one round of hybrid search over chunks for asked (query_id, query), up to its table fin and the gate gt."""
    return (
        _BOOSTED.format(docs=chunks, asked=f"(SELECT query_id, {_normalised('query')} AS query FROM {asked})").rstrip()
        + ", "
        + hashed_vectors("dv", f"SELECT chunk_id AS id, text FROM {chunks}")
        + ", "
        + hashed_vectors("qv", f"SELECT query_id AS id, query AS text FROM {asked}")
        + f""",
cs AS (SELECT q.id AS query_id, d.id AS chunk_id, round(coalesce(list_cosine_similarity(q.v, d.v), 0), 6) AS score FROM qv q, dv d),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS r FROM cs WHERE score >= 0.2) WHERE r < 20),
dg AS (SELECT de.*, regexp_matches(lower(title), 'gazette|result') OR contains(lower(substring(text, 1, 150)), 'roll no') AS gz, regexp_matches(lower(query), '{search.ASKS_RESULTS}') AS seek FROM de JOIN {chunks} USING (chunk_id) JOIN {asked} USING (query_id)),
df2 AS (SELECT * FROM (SELECT *, sum((gz AND NOT seek)::INT) OVER (PARTITION BY query_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS seen FROM dg) WHERE NOT (gz AND NOT seek) OR seen <= 2),
dn AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS r FROM df2), sp AS (SELECT query_id, chunk_id, score, rank AS r FROM bm WHERE rank < 20),
u AS (SELECT coalesce(dn.query_id, sp.query_id) AS query_id, coalesce(dn.chunk_id, sp.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (61 + dn.r), 0) + coalesce(1.0::DOUBLE / (61 + sp.r), 0), 9) AS rrf, dn.score AS dense_score, sp.score AS bm25_score FROM dn FULL JOIN sp ON dn.query_id = sp.query_id AND dn.chunk_id = sp.chunk_id),
h AS (SELECT u.*, 0 AS rank, coalesce(dense_score, bm25_score) AS score, q.query, d.document_id, d.chunk_index, d.title, d.text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) - 1 AS fr FROM u) u JOIN {asked} q USING (query_id) JOIN {chunks} d USING (chunk_id) WHERE fr < 50),
"""
        + _shown("h", "rrf")
        + """, k20 AS (SELECT *, rerank_score >= -2.0 AS pass, bool_or(rerank_score >= -2.0) OVER (PARTITION BY query_id) AS anypass FROM hk WHERE rank < 20), fl AS (SELECT * EXCLUDE (pass, anypass) FROM k20 WHERE pass OR (NOT anypass AND rank < 5))"""
        + _COHESIVE.format(k="fl")
        + f""", c2 AS (SELECT query_id, chunk_id, document_id, chunk_index, title, text, query, qo, qb, rrf, dense_score, bm25_score, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM co),
tp AS (SELECT query_id, document_id AS td, rerank_score AS ts, query, qo, qb FROM c2 WHERE rank = 0),
pg AS (SELECT c2.*, document_id = td AND chunk_index = 0 AS page FROM c2 JOIN tp USING (query_id)),
pa AS (SELECT * EXCLUDE (page) REPLACE (CASE WHEN page AND regexp_matches(lower(query), '{search.ASKS_DATE}') THEN -1 ELSE rank END AS rank) FROM pg
  UNION ALL BY NAME SELECT query_id, k.chunk_id, td AS document_id, 0 AS chunk_index, k.title, k.text, tp.query, qo, qb, ts + 1 AS rerank_score, -1 AS rank FROM tp JOIN {chunks} k ON k.document_id = td AND k.chunk_index = 0 WHERE query_id NOT IN (SELECT query_id FROM pg WHERE page)),
p2 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank) FROM pa),
tq AS (SELECT *, (len(qo) > 0 OR qb IS NOT NULL) AND NOT (regexp_matches(lower(query), '{search.ASKS_BOTH}') OR len(qo) > 1) AS one, regexp_matches(lower(query), '{search.ASKS_NEWS}') AS news, {_YEAR} AS year, first_value(document_id) OVER (PARTITION BY query_id ORDER BY rank) AS td FROM p2),
fc AS (SELECT * FROM tq WHERE NOT one OR document_id = td),
fr AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN news AND NOT one THEN year END DESC NULLS LAST, CASE WHEN news AND NOT one THEN rerank_score END DESC NULLS LAST, rank, chunk_id) - 1 AS rank FROM fc),
fin AS (SELECT * FROM fr WHERE rank < 5)"""
        + _GATE.format(k="fin").replace("v_asked", asked)
        + " SELECT query_id, query, rank, chunk_id, rerank_score, rrf, dense_score, bm25_score, decision FROM fin JOIN gt USING (query_id) WHERE decision <> 'INCORRECT'"
    )


_TWO = "regexp_extract(s, '" + T.TWO_PARTS + "', {n})"


def _sub_queries() -> str:
    """SQL of the first two parts (from 1) of a question query, stripped as s."""
    long = "query"
    for pattern, to in T.EXPANSIONS:
        long = f"regexp_replace({long}, '{pattern}', '{to}', 'gi')"
    half = lambda n: f"{_TWO.format(n=1)} || ' for ' || regexp_replace({_TWO.format(n=n)}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN regexp_matches(s, '{T.TWO_PARTS}') THEN [{half(2)}, {half(3)}] WHEN {long} <> query THEN [{long}] ELSE [] END"


_HYBRID = f"""WITH kc AS MATERIALIZED (SELECT document_id * 10000 + i AS chunk_id, document_id, i AS chunk_index, title, course, text FROM (SELECT document_id, title, course, unnest(range(len(cs))) AS i, unnest(cs) AS text FROM (SELECT document_id, title, course, {chunked('text')} AS cs FROM v_lectures))),
f1 AS MATERIALIZED ({_chain_sql("v_subjects", "kc")}),
sb AS MATERIALIZED (SELECT parent, i AS part, parent || '#' || i AS query_id, qs[i + 1] AS query FROM (SELECT query_id AS parent, {_sub_queries()} AS qs FROM (SELECT DISTINCT query_id, query, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS s FROM f1 WHERE decision = 'AMBIGUOUS')), (SELECT unnest([0, 1]) AS i) WHERE i < len(qs)),
f2 AS MATERIALIZED ({_chain_sql("sb", "kc")}),
al AS (SELECT query_id, -1 AS part, * EXCLUDE (query_id, query) FROM f1 UNION ALL BY NAME SELECT sb.parent AS query_id, sb.part, f2.* EXCLUDE (query_id, query, decision), p.decision FROM f2 JOIN sb USING (query_id) JOIN (SELECT DISTINCT query_id AS parent, decision FROM f1) p USING (parent)),
nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part, rank) AS seen FROM al) WHERE seen = 1)
SELECT * FROM (SELECT query_id, part, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) - 1 AS rank, chunk_id, rerank_score, rrf, dense_score, bm25_score, decision FROM nw) WHERE rank < 5"""


@query("k4_hybrid", _HYBRID)
def k4(v):
    """The whole chain for questions about one or two subjects over chunks of titled documents, with hashed vectors for the dense side."""
    d = v("v_lectures")
    c = materialise(chunks.chunk(d).drop("content_hash").join(d.drop("text"), "document_id").withColumn("chunk_id", F.col("document_id") * 10000 + F.col("chunk_index")))
    vectors = materialise(c.select(F.col("chunk_id").alias("vec_id"), V.embed("text").alias("vec")))
    return search.hybrid(v("v_subjects"), c, vectors, V.embed).select("query_id", "part", "rank", "chunk_id", "rerank_score", "rrf", "dense_score", "bm25_score", "decision")


@query("j1_embeddings", "WITH " + hashed_vectors("bv", "SELECT item_id AS id, text FROM benchmark") + ", x AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM bv), y AS (SELECT id, n, unnest(v) AS x, unnest(range(384)) AS bucket FROM x) SELECT id AS item_id, bucket, round(x / n, 6) AS value FROM y WHERE x <> 0")
def j1(v):
    """The buckets of each passage's hashed vector that are not zero."""
    e = v("benchmark").select("item_id", F.posexplode(V.embed("text")).alias("bucket", "value"))
    return e.where("value <> 0").select("item_id", "bucket", F.round("value", 6).alias("value"))


@F.pandas_udf(DoubleType())
def _overlap(query: pd.Series, text: pd.Series) -> pd.Series:
    """A scorer in place of the lexical one: the share of the query's words in the text."""
    words = query.str.lower().str.split().map(set)
    return pd.Series([len(a & set(t.lower().split())) / max(1, len(a)) for a, t in zip(words, text, strict=True)], dtype=float)


@query("j2_other_reranker", _FOUND + r"""SELECT query_id, chunk_id, round(share, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(share, 6) DESC, chunk_id) - 1 AS rank FROM (SELECT query_id, chunk_id, len(list_filter(qw, lambda x: list_contains(tw, x)))::DOUBLE / greatest(1, len(qw)) AS share FROM (SELECT query_id, chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(q.query), '\s+'), lambda x: x <> '')) AS qw, list_distinct(regexp_split_to_array(lower(d.text), '\s+')) AS tw FROM bm JOIN v_asked q USING (query_id) JOIN v_titled d USING (chunk_id) WHERE rank < 20))""")
def j2(v):
    """Hits reranked by another function than the lexical one."""
    return search.rerank(hits(v), 20, score=_overlap(F.col("query"), F.col("text"))).select("query_id", "chunk_id", "rerank_score", "rank")


@query("h19_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim, round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h19(v):
    e = v("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("g4_word_sets", "SELECT item_id, array_to_string(list_sort(" + CONTENT.format(c="text") + "), ' ') AS words FROM benchmark")
def g4(v):
    return v("benchmark").select("item_id", F.array_join(F.array_sort(search.content_words(F.col("text"))), " ").alias("words"))


def ingest_sql(previous: str, before: str) -> str:
    """SQL of an ingest run over v_scan_now: c (path, status), own (chunks of each taken file), st (those stored), ch (all chunks then).

    previous: the manifest (path, oh, om, status); before: the files (path, mtime, content) whose chunks are held."""
    cut = lambda files: f"SELECT path, mtime, i, sha256(t) AS content_hash FROM (SELECT path, mtime, unnest(range(len(cs))) AS i, unnest(cs) AS t FROM (SELECT path, mtime, {chunked('content')} AS cs FROM ({files})))"
    own = lambda source: f"SELECT path, mtime, content_hash, min(i) AS chunk_index FROM {source} GROUP BY ALL"
    first = lambda source: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY mtime, path) AS k FROM {source}) WHERE k = 1"
    return (
        file_changes_sql(previous).rstrip()
        + f""",
b0 AS ({cut(before)}), b1 AS ({own("b0")}), held AS ({first("b1")}),
tk AS (SELECT path FROM c WHERE status IN ('new_file', 'modified', 'retry_failed')),
o0 AS ({cut("SELECT path, mtime, content FROM v_scan_now WHERE path IN (SELECT path FROM tk)")}), own AS ({own("o0")}),
st AS (SELECT * FROM ({first("own")}) WHERE content_hash NOT IN (SELECT content_hash FROM held WHERE path NOT IN (SELECT path FROM tk))),
ch AS (SELECT path, chunk_index, content_hash FROM held WHERE path NOT IN (SELECT path FROM tk) UNION ALL SELECT path, chunk_index, content_hash FROM st)
"""
    )


_RUN = "WITH " + ingest_sql(PREVIOUS, "SELECT path, mtime, content FROM v_manifest_prev WHERE status = 'done'")


def _library(v) -> ingest.Library:
    """A library that holds the manifest before and the chunks of its finished files."""
    library, before = ingest.Library(v.spark, new_path(v.spark, "loom-library"), 16), v("v_manifest_prev")
    library.manifest.replace(before.select("path"), before.select("path", T.sha256(F.col("content")).alias("hash"), F.col("mtime").cast("long").alias("mtime"), "status"))
    done = before.where("status = 'done'").select("path", "content", "mtime")
    library.chunks.replace(done.select("path"), ingest.taken_chunks(done, library.chunks.read().select("path", "content_hash"))[0], within=True)
    return library


@query("k11_ingest_run", _RUN + "SELECT c.path, c.status, split_part(c.path, '/', 1) AS department, split_part(c.path, '/', 2) AS semester, split_part(c.path, '/', 3) AS course, coalesce(o.n, 0) AS chunks, coalesce(s.n, 0) AS stored FROM c LEFT JOIN (SELECT path, count(*) AS n FROM own GROUP BY path) o USING (path) LEFT JOIN (SELECT path, count(*) AS n FROM st GROUP BY path) s USING (path)")
def k11(v):
    """One row for each file of a run over all files: what happened, its tags, its chunks, and those that were new."""
    return _library(v).ingest(v("v_scan_now").withColumn("mtime", F.col("mtime").cast("long")), whole=True)


@query("k11_library", _RUN + "SELECT path, chunk_index, content_hash FROM ch")
def k11_library(v):
    """What the library holds after that run, also if it is run twice."""
    library, scan = _library(v), v("v_scan_now").withColumn("mtime", F.col("mtime").cast("long"))
    for _ in range(2):
        library.ingest(scan, ("run", 0), whole=True)
    return library.chunks.read().select("path", "chunk_index", "content_hash")
