"""Queries of joins, graph and tree (C, D14, G2, K8-K14)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.functions import vectors as V
from corpusloom.operators import changes, chunks, feeds, graph, lookups, reports, search
from corpusloom.operators.ranges import running
from corpusloom.sources.scratch import materialise, new_path
from corpusloom.sources.snapshots import SnapshotTable

from .registry import query
from .retrieval import chunked, hashed_vectors
from .texts import KS, NORM, SYNOPSIS, link_ctes


@query("c1_inner_join", "SELECT m.message_id, d.department, d.course FROM v_messages m JOIN v_documents d ON d.document_id = m.message_id // 100")
def c1(v):
    m = v("v_messages").select("message_id", F.floor(F.col("message_id") / 100).alias("document_id"))
    return m.join(v("v_documents").select("document_id", "department", "course"), "document_id").select("message_id", "department", "course")


@query("c2_counts_with_zeros", "SELECT d.document_id, count(m.message_id) AS n FROM v_documents d LEFT JOIN v_messages m ON m.message_id // 100 = d.document_id GROUP BY 1")
def c2(v):
    m = v("v_messages").select(F.floor(F.col("message_id") / 100).alias("document_id"), "message_id")
    return v("v_documents").select("document_id").join(m, "document_id", "left").groupBy("document_id").agg(F.count("message_id").alias("n"))


@query("c3_new_content", "SELECT path FROM v_scan_now WHERE sha256(content) NOT IN (SELECT sha256(content) FROM v_manifest_prev)")
def c3(v):
    known = v("v_manifest_prev").select(T.sha256(F.col("content")).alias("hash"))
    return changes.unindexed(v("v_scan_now").select("path", T.sha256(F.col("content")).alias("hash")), known, "hash").select("path")


@query("c4_cascade_delete", """WITH g AS (SELECT document_id FROM v_documents WHERE department = 'src3') SELECT 'documents' AS table_name, count(*) FILTER (document_id IN (SELECT * FROM g)) AS removed, count(*) FILTER (document_id NOT IN (SELECT * FROM g)) AS kept FROM v_documents
UNION ALL SELECT 'vectors', count(*) FILTER (vec_id IN (SELECT * FROM g)), count(*) FILTER (vec_id NOT IN (SELECT * FROM g)) FROM embeddings""")
def c4(v):
    ids = feeds.in_scope(v("v_documents"), department="src3").select("document_id")
    return changes.cascade_delete(ids, {"documents": (v("v_documents"), "document_id"), "vectors": (v("embeddings"), "vec_id")}, "document_id")[1]


@query("c5_purge", "SELECT document_id FROM v_documents WHERE NOT (department = 'src1' OR document_id IN (SELECT page_id FROM pages WHERE page_id % 5 = 0) OR source_path LIKE 'http%' OR contains(source_path, '/fr/'))")
def c5(v):
    d = v("v_documents").select("document_id", "department", "source_path")
    pages = v("pages").where("page_id % 5 = 0").select(F.col("page_id").alias("document_id"))
    gone = changes.any_branch("document_id", d.where("department = 'src1'"), d.join(pages, "document_id", "left_semi"), d.where(F.col("source_path").startswith("http")), d.where(F.contains("source_path", F.lit("/fr/"))))
    return changes.unindexed(d.select("document_id"), gone, "document_id")


_NOISE = r"regexp_replace(regexp_replace(regexp_replace({c}, '(?:Online Users|Total Visitors?|Visitor Counter|Page Hits?|Hit Count)\s*:\s*\**\d+\**', '', 'gi'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("c8_crawl_delta", f"""WITH p AS (SELECT sha256(url) AS k, sha256({_NOISE.format(c='body')}) AS oh, etag AS oe, last_changed_s AS ol FROM v_crawl_prev), n AS (SELECT *, sha256(url) AS k, sha256({_NOISE.format(c='body')}) AS h FROM v_crawl_now),
x AS (SELECT n.*, oe, ol, CASE WHEN http_status = 304 THEN '304_not_modified' WHEN oh IS NULL THEN 'new_resource' WHEN h = oh THEN 'content_hash_unchanged' ELSE 'content_modified' END AS status FROM n LEFT JOIN p USING (k))
SELECT url, status, coalesce(etag, oe) AS etag, CASE WHEN status IN ('new_resource', 'content_modified') THEN checked_s ELSE ol END AS last_changed_s FROM x""")
def c8(v):
    return changes.crawl_delta(v("v_crawl_prev"), v("v_crawl_now"), U.url_hash(F.col("url")))


@query("c9_conditional_headers", "SELECT n.url, p.etag, p.last_changed_s FROM v_crawl_now n LEFT JOIN v_crawl_prev p USING (url)")
def c9(v):
    return v("v_crawl_now").select("url").join(v("v_crawl_prev").select("url", "etag", "last_changed_s"), "url", "left")


@query("c10_integrity", "SELECT m.path, CASE WHEN s.content IS NULL THEN 'missing' WHEN sha256(s.content) = sha256(m.content) THEN 'indexed' ELSE 'changed' END AS state FROM v_manifest_prev m LEFT JOIN v_scan_now s USING (path)")
def c10(v):
    return changes.integrity(v("v_manifest_prev"), v("v_scan_now"))


_BAD = "(feedback = 'down' OR confidence < 0.75 OR crag_decision = 'INCORRECT')"
_HARVEST = f"""WITH w AS (SELECT *, last_value(CASE WHEN sender = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_s, turn ROWS UNBOUNDED PRECEDING) AS question FROM v_messages), h AS (SELECT * FROM w WHERE sender = 'assistant' AND coalesce({_BAD}, false) AND question IS NOT NULL)
"""


def harvest(v):
    """Bad answers, each with the question it was given to."""
    bad = (F.col("feedback") == "down") | (F.col("confidence") < reports.LOW_CONFIDENCE) | (F.col("crag_decision") == "INCORRECT")
    asked = F.when(F.col("sender") == "user", F.col("content"))
    found = lookups.last_before(v("v_messages"), ["session_id"], [F.col("created_s"), F.col("turn")], asked, (F.col("sender") == "assistant") & F.coalesce(bad, F.lit(False)), "question")
    return found.where("question is not null")


@query("c11_as_of_questions", _HARVEST + "SELECT message_id, question FROM h")
def c11(v):
    return harvest(v).select("message_id", "question")


@query("k13_failure_harvest", _HARVEST + """, x AS (SELECT count(*) AS n, count(*) FILTER (regexp_matches(lower(question), 'exam|datesheet|schedule')) AS n_exam, count(*) FILTER (regexp_matches(lower(question), 'admission|apply|form|eligibility')) AS n_admission, count(*) FILTER (regexp_matches(lower(question), 'fee|hostel|scholarship')) AS n_fees, bool_or(coalesce(feedback = 'down', false)) AS bad FROM h)
SELECT n, n_exam, n_admission, n_fees, CASE WHEN n_exam > 0 THEN 'exam' WHEN n_admission > 0 THEN 'admission' WHEN n_fees > 0 THEN 'fees' WHEN bad THEN 'direct_answer' ELSE 'precision' END AS topic FROM x""")
def k13(v):
    return reports.topic_of(harvest(v), "question", F.coalesce(F.col("feedback") == "down", F.lit(False)))


@query("c12_prefix_join", "SELECT f.path, count(d.source_path) AS n FROM v_folders f LEFT JOIN v_documents d ON d.source_path = f.path OR d.source_path LIKE f.path || '/%' GROUP BY 1")
def c12(v):
    return lookups.by_prefix(v("v_folders"), v("v_documents"), "source_path")


@query("c13_first_rule", r"""WITH r AS (SELECT *, '^' || replace(replace(regexp_replace(pattern, '([.+^$(){}|\[\]\\])', '\\\1', 'g'), '*', '.*'), '?', '.') || '$' AS rx FROM v_url_rules),
b AS (SELECT p.url, max(rule_id) AS rule_id FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN r ON regexp_matches(p.url, r.rx) OR starts_with(p.url, r.pattern) GROUP BY 1)
SELECT b.url, coalesce(r.action, 'allow') AS action, b.rule_id::BIGINT AS rule_id FROM b LEFT JOIN v_url_rules r USING (rule_id)""")
def c13(v):
    return lookups.first_rule(v("pages"), v("v_url_rules"))


@query("c15_parity", "SELECT 'documents' AS table_name, (SELECT count(*) FROM documents) AS source_rows, (SELECT count(*) FROM documents WHERE doc_id % 50 <> 0) AS target_rows, false AS same, false AS all_same UNION ALL SELECT 'pages', (SELECT count(*) FROM pages), (SELECT count(*) FROM pages), true, false")
def c15(v):
    d, p = v("documents"), v("pages")
    return changes.parity({"documents": d, "pages": p}, {"documents": d.where("doc_id % 50 <> 0"), "pages": p})


#: Every tenth vector is asked again, five ids later: the given ones have no near repeats.
_ASKED_AGAIN = "SELECT a.vec_id, coalesce(b.label, a.label) AS label, coalesce(b.embedding, a.embedding) AS embedding FROM {e} a LEFT JOIN {e} b ON a.vec_id % 10 = 5 AND b.vec_id = a.vec_id - 5"


def _near_repeats(v, span):
    """The most similar vector of the same label within ``span`` ids before, if similar enough; ids stand for seconds."""
    e = v.spark.sql(_ASKED_AGAIN, e=v("embeddings")).select("vec_id", "label", V.unit(F.col("embedding")).alias("x"))
    a = e.withColumn("slot", F.explode(F.array(F.floor(F.col("vec_id") / span), F.floor(F.col("vec_id") / span) - 1)))
    b = e.select(F.col("vec_id").alias("earlier"), "label", F.col("x").alias("y"), F.floor(F.col("vec_id") / span).alias("slot"))
    near = a.join(b, ["label", "slot"]).where((F.col("earlier") < F.col("vec_id")) & (F.col("vec_id") - F.col("earlier") <= span))
    s = near.select("vec_id", "earlier", F.round(V.dot(F.col("x"), F.col("y")), 6).alias("sim")).where("sim >= 0.94")
    best = s.groupBy("vec_id").agg(F.max(F.struct("sim", (-F.col("earlier")).alias("e"))).alias("b"))
    return best.select("vec_id", (-F.col("b.e")).alias("earlier"), F.col("b.sim").alias("sim"))


_NEAR = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM (" + _ASKED_AGAIN.replace("{e}", "embeddings") + """)), s AS (SELECT a.vec_id, b.vec_id AS earlier, round(list_cosine_similarity(a.x, b.x), 6) AS sim FROM e a JOIN e b ON a.label = b.label AND b.vec_id < a.vec_id AND a.vec_id - b.vec_id <= 3600)
SELECT vec_id, arg_max(earlier, (sim, -earlier)) AS earlier, max(sim) AS sim FROM s WHERE sim >= 0.94 GROUP BY vec_id"""


@query("c17_near_repeats_hour", _NEAR)
@query("c17_near_repeats", _NEAR)
def c17(v):
    return _near_repeats(v, 3600)


@query("c19_valid_edges", "SELECT src, dst FROM v_links WHERE src <> dst AND src IN (SELECT page_id FROM pages WHERE page_id % 7 <> 0) AND dst IN (SELECT page_id FROM pages WHERE page_id % 7 <> 0)")
def c19(v):
    return graph.valid_edges(v("v_links"), v("pages").where("page_id % 7 <> 0").select(F.col("page_id").alias("id")))


@query("c20_one_hop", """WITH s AS (SELECT page_id AS id, CAST(page_id % 10 AS DOUBLE) / 10 AS score FROM pages WHERE page_id % 20 = 0), b AS (SELECT src, dst FROM v_links UNION ALL SELECT dst, src FROM v_links)
SELECT dst AS id, round(max(score * 0.8 * 0.85), 2) AS activation FROM b JOIN s ON s.id = b.src GROUP BY dst""")
def c20(v):
    seeds = v("pages").where("page_id % 20 = 0").select(F.col("page_id").alias("id"), ((F.col("page_id") % 10) / 10).alias("score"))
    return graph.neighbours(seeds, v("v_links").withColumn("weight", F.lit(0.8)))


@query("c21_department_graph", """WITH n AS (SELECT document_id AS id FROM v_documents WHERE contains(lower(department), 'src1') OR contains('src1', lower(department))) SELECT src, dst FROM v_links WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def c21(v):
    near = F.contains(F.lower("department"), F.lit("src1")) | F.contains(F.lit("src1"), F.lower("department"))
    return graph.valid_edges(v("v_links"), v("v_documents").where(near).select(F.col("document_id").alias("id")))


_TREE = """WITH t AS (SELECT DISTINCT 'tree://root/' || department AS uri, 'tree://root' AS parent_uri, 'department' AS tier, NULL::BIGINT AS document_id FROM v_documents UNION ALL SELECT DISTINCT 'tree://root/' || department || '/' || course, 'tree://root/' || department, 'course', NULL FROM v_documents UNION ALL SELECT 'tree://root/' || department || '/' || course || '/' || document_id, 'tree://root/' || department || '/' || course, 'document', document_id FROM v_documents)
"""


@query("c22_children", _TREE + "SELECT uri, tier FROM t WHERE parent_uri IN ('tree://root', 'tree://root/src3')")
def c22(v):
    return graph.tree_paths(v("v_documents")).where(F.col("parent_uri").isin("tree://root", "tree://root/src3")).select("uri", "tier")


@query("c24_feedback", """WITH f AS (SELECT event_id, 's_' || (event_id % 100) AS session_id, CASE WHEN event_id % 3 = 0 THEN 'down' ELSE 'up' END AS feedback, ts FROM events WHERE event_type = 'click'), l AS (SELECT session_id, arg_max(feedback, (ts, event_id)) AS feedback FROM f GROUP BY 1),
a AS (SELECT session_id, arg_max(message_id, (created_s, turn)) AS message_id FROM v_messages WHERE sender = 'assistant' GROUP BY 1) SELECT a.message_id, l.feedback, CASE WHEN l.feedback = 'down' THEN -1 ELSE 1 END AS score FROM a JOIN l USING (session_id)""")
def c24(v):
    f = v("events").where("event_type = 'click'").select(F.concat(F.lit("s_"), (F.col("event_id") % 100).cast("string")).alias("session_id"), F.when(F.col("event_id") % 3 == 0, "down").otherwise("up").alias("feedback"), "ts", "event_id")
    last = f.groupBy("session_id").agg(F.max_by("feedback", F.struct("ts", "event_id")).alias("feedback"))
    answer = v("v_messages").where("sender = 'assistant'").groupBy("session_id").agg(F.max_by("message_id", F.struct("created_s", "turn")).alias("message_id"))
    return answer.join(last, "session_id").select("message_id", "feedback", F.when(F.col("feedback") == "down", -1).otherwise(1).alias("score"))


@query("c25_overview_lookup", "WITH " + hashed_vectors("dv", "SELECT document_id AS id, text FROM v_documents") + """, he AS (SELECT department, course, min(document_id) AS vec_id FROM v_documents GROUP BY ALL),
q AS (SELECT document_id AS query_id, text AS query, department, CASE WHEN document_id % 40 = 0 THEN upper(left(course, 1)) END AS asked FROM v_documents WHERE document_id % 20 = 0), nm AS (SELECT query_id, min(vec_id) AS named FROM q JOIN he USING (department) WHERE he.course ILIKE '%' || asked || '%' GROUP BY 1),
s AS (SELECT query_id, he.vec_id, q.department = he.department AS own, round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS score FROM q JOIN dv a ON a.id = query_id, he JOIN dv b ON b.id = he.vec_id),
nr AS (SELECT query_id, arg_max(vec_id, (own, score, -vec_id)) AS near FROM s WHERE score >= 0.45 GROUP BY 1)
SELECT query_id, coalesce(named, near) AS vec_id FROM q LEFT JOIN nm USING (query_id) LEFT JOIN nr USING (query_id)""")
def c25(v):
    """A course's overview, its first document, for each query: in the department that of a course whose name holds what is asked, else the
    nearest by hashed vectors in the department, else the nearest of all; none that is not near enough."""
    d = v("v_documents")
    heads = materialise(d.groupBy("department", "course").agg(F.min_by("text", "document_id").alias("l0"), F.min("document_id").alias("vec_id")).withColumn("vec", V.embed("l0")).drop("l0"))
    q = d.where("document_id % 20 = 0").select(F.col("document_id").alias("query_id"), V.embed("text").alias("qvec"), "department", F.when(F.col("document_id") % 40 == 0, F.upper(F.left("course", F.lit(1)))).alias("asked"))
    q = materialise(q)
    named = q.where("asked is not null").join(heads, "department").where(F.contains(F.lower("course"), F.lower("asked"))).groupBy("query_id").agg(F.min("vec_id").alias("named"))
    near = lambda scope, name: search.vector_top_k(q.select("query_id", "qvec", "department"), heads.select("vec_id", "vec", "department"), 1, 0.45, scope, own=True).select("query_id", F.col("vec_id").alias(name))
    x = q.select("query_id").join(named, "query_id", "left").join(near("department", "near"), "query_id", "left").join(near(None, "far"), "query_id", "left")
    return x.select("query_id", F.coalesce("named", "near", "far").alias("vec_id"))


#: Patterns of topics in the given prose; the operator takes any table of names and patterns.
CONCEPTS = {"articles": r"(?i)\b(the|der|les|los)\b", "licenses": r"(?i)\b(license|licensed|copyright)\b", "numbers": r"[0-9]{3,}", "capitals": r"\b[A-Z]{6,}\b", "mail": "@"}


@query("d14_concepts", r"""WITH c AS (SELECT document_id, unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)\b(the|der|les|los)\b') THEN 'articles' END, CASE WHEN regexp_matches(text, '(?i)\b(license|licensed|copyright)\b') THEN 'licenses' END, CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN 'numbers' END, CASE WHEN contains(text, '@') THEN 'mail' END], lambda x: x IS NOT NULL)) AS concept FROM v_documents)
SELECT concept, count(DISTINCT document_id) AS documents FROM c GROUP BY 1""")
def d14(v):
    return graph.concept_documents(v("v_documents"), {k: p for k, p in CONCEPTS.items() if k != "capitals"})


@query("g2_link_union", r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages), b AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'src="([^"]*)"', 1)) AS link FROM pages) SELECT link FROM a UNION SELECT link FROM b""")
def g2(v):
    all_of = lambda p: v("pages").select(F.explode(F.regexp_extract_all("html", F.lit(p), F.lit(1))).alias("link"))
    return all_of('<a href="([^"]*)"').union(all_of('src="([^"]*)"')).distinct()


_FITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in CONCEPTS.items()) + "], lambda x: x IS NOT NULL)"
_GRAPH = f"""WITH cp AS (SELECT document_id, department, course, unnest({_FITS}) AS concept FROM v_documents),
n AS (SELECT 'core' AS id, 'corpus' AS label, 'core' AS type UNION ALL SELECT DISTINCT 'dept-' || department, department, 'department' FROM v_documents UNION ALL SELECT DISTINCT 'course-' || department || '-' || course, course, 'course' FROM v_documents UNION ALL SELECT 'doc-' || document_id, title, 'document' FROM v_documents UNION ALL SELECT DISTINCT 'concept-' || concept, concept, 'concept' FROM cp),
e AS (SELECT DISTINCT 'core' AS src, 'dept-' || department AS dst, 1.0 AS weight FROM v_documents UNION ALL SELECT DISTINCT 'dept-' || department, 'course-' || department || '-' || course, 0.8 FROM v_documents UNION ALL SELECT 'course-' || department || '-' || course, 'doc-' || document_id, 0.6 FROM v_documents
UNION ALL SELECT DISTINCT 'course-' || department || '-' || course, 'concept-' || concept, 0.9 FROM cp UNION ALL SELECT 'doc-' || document_id, 'concept-' || concept, 0.85 FROM cp)
"""


@query("k8_graph_nodes_whole", _GRAPH + "SELECT id, type FROM n")
@query("k8_graph_nodes", _GRAPH + "SELECT id, type FROM n")
def k8n(v):
    return graph.graph_nodes(v("v_documents"), concepts=CONCEPTS).select("id", "type")


@query("k8_graph_edges_whole", _GRAPH + "SELECT src, dst, weight::DOUBLE AS weight FROM e")
@query("k8_graph_edges", _GRAPH + "SELECT src, dst, weight::DOUBLE AS weight FROM e")
def k8e(v):
    d = graph.sketched(v("v_documents"), CONCEPTS)
    return graph.graph_edges(d, graph.graph_nodes(d, concepts=CONCEPTS), CONCEPTS)


@query("k8_sample_nodes", _GRAPH + ", b AS (SELECT document_id FROM (SELECT document_id, row_number() OVER (PARTITION BY department ORDER BY document_id) > 8 AS late FROM v_documents) ORDER BY late, document_id LIMIT 45) SELECT id, type FROM n WHERE type <> 'document' OR id IN (SELECT 'doc-' || document_id FROM b)")
def k8s(v):
    """The graph with a balanced sample of documents, for display."""
    return graph.graph_nodes(v("v_documents"), 8, 45, CONCEPTS).select("id", "type")


_WORDS = "list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: length(w) > 3)"


@query("k9_activation", _GRAPH.rstrip() + ", " + hashed_vectors("nv", "SELECT id, label AS text FROM n WHERE type <> 'core'") + ", " + hashed_vectors("qv", "SELECT item_id AS id, text FROM benchmark") + f""",
sc AS (SELECT q.id AS query_id, n.id, round(coalesce(list_cosine_similarity(q.v, n.v), 0), 6) AS cos FROM qv q, nv n),
hit AS (SELECT item_id AS query_id, id, len(list_filter({_WORDS.format(c='label')}, lambda w: contains(lower(text), w))) > 0 AS named FROM benchmark, n WHERE type <> 'core'),
st AS (SELECT query_id, id, greatest(0, CASE WHEN named THEN least(1.0, cos + 0.25) ELSE cos END)::DOUBLE AS score FROM sc JOIN hit USING (query_id, id)),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM st),
sd AS (SELECT query_id, id, score FROM tp WHERE rank = 0), bo AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
al AS (SELECT query_id, dst AS id, round(score * weight * 0.85, 2) AS a FROM sd JOIN bo ON src = sd.id UNION ALL SELECT query_id, id, round(least(1.0, score + 0.1), 2) FROM sd UNION ALL SELECT query_id, id, round(score, 2) FROM tp WHERE rank < 6 AND score >= 0.48 UNION ALL SELECT query_id, 'core', 0.65 FROM sd)
SELECT query_id, id, max(a)::DOUBLE AS activation FROM al GROUP BY ALL""")
def k9(v):
    """Nodes that each benchmark query activates: the nearest node by label, its neighbours, the core, and what is near enough
    itself. A word of a label, longer than three characters, that the query holds adds 0.25 before nodes are ranked."""
    d = graph.sketched(v("v_documents"), CONCEPTS)
    nodes = materialise(graph.graph_nodes(d, concepts=CONCEPTS))
    near = materialise(search.label_top_k(v("benchmark").withColumnRenamed("item_id", "query_id"), nodes.where("type <> 'core'"), 6).withColumnRenamed("vec_id", "id"))
    seed = near.where("rank = 0").select("query_id", "id", "score")
    cents = lambda c: F.round(c * 100) / 100  # as DuckDB rounds: 0.285 is 28.499... hundredths
    edges = graph.graph_edges(d, nodes, CONCEPTS, seed.select("id").distinct())
    either = F.explode(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    both = edges.select(either.alias("e")).select("e.*")
    hop = both.join(seed, both["src"] == seed["id"]).select("query_id", F.col("dst").alias("id"), cents(F.col("score") * F.col("weight") * 0.85).alias("activation"))
    own = seed.select("query_id", "id", cents(F.least(F.lit(1.0), F.col("score") + 0.1)).alias("activation"))
    strong = near.where("score >= 0.48").select("query_id", "id", cents(F.col("score")).alias("activation"))
    core = seed.select("query_id", F.lit("core").alias("id"), F.lit(0.65).alias("activation"))
    return hop.union(own).union(strong).union(core).groupBy("query_id", "id").agg(F.max("activation").alias("activation"))


_LINKED = """SELECT p.page_id, p.url, p.html || CASE WHEN a.url IS NULL THEN '' ELSE '<a href="' || a.url || '">' || '</a>' END || CASE WHEN b.url IS NULL THEN '' ELSE '<a href="' || b.url || '"></a>' END AS html
FROM {pages} p LEFT JOIN {pages} a ON a.page_id = 2 * p.page_id + 1 LEFT JOIN {pages} b ON b.page_id = 2 * p.page_id + 2"""


@query("k10_crawl_order", "WITH RECURSIVE " + "lp AS (" + _LINKED.replace("{pages}", "pages") + f"), {link_ctes('lp')}, ua AS (SELECT page_id, url AS u, {KS.format(u='url')} AS ks FROM pages), nu AS (SELECT page_id, {NORM.format(u='u')} AS link FROM ua), ed AS (SELECT DISTINCT lk.page_id AS src, nu.page_id AS dst FROM lk JOIN nu USING (link)), " + """r(page_id, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT ed.dst, r.depth + 1 FROM r JOIN ed ON ed.src = r.page_id WHERE r.depth < 40)
SELECT page_id, min(depth) AS depth, (row_number() OVER (ORDER BY min(depth), page_id) - 1) // 5 AS batch FROM r GROUP BY page_id""")
def k10(v):
    """Pages by depth from page 0, in batches of five, over the links that their html holds; stored pages alone are visited.
    Each page gets links to two more, put into its html, as the given ones lead to no stored page."""
    pages = v.spark.sql(_LINKED, pages=v("pages"))
    at = v("pages").select(F.col("page_id").alias("dst"), U.normalise(F.col("url")).alias("link"))
    edges = materialise(H.links(pages).join(at, "link").select(F.col("page_id").alias("src"), "dst").distinct())
    seen = graph.bfs(v("pages").where("page_id = 0"), edges, 40, materialise)
    x = running(seen, [F.col("depth"), F.col("page_id")], {"i": F.lit(1).cast("long")}, materialise)
    return x.select("page_id", "depth", F.floor((F.col("i") - 1) / 5).alias("batch"))


_NODES = (
    f"""WITH kc AS MATERIALIZED (SELECT document_id, unnest(range(len(cs))) AS chunk_index, unnest(cs) AS text FROM (SELECT document_id, {chunked('text')} AS cs FROM v_documents)),
mm AS (SELECT 'tree://root/' || department || '/' || course || '/' || document_id AS session_id, department, chunk_index AS turn, kc.text AS content FROM kc JOIN v_documents USING (document_id)),
sy AS ("""
    + SYNOPSIS.replace("v_messages", "mm")
    + r"""),
t AS (SELECT 'tree://root/' || department || '/' || course || '/' || document_id AS uri, department, course, document_id, title, len(regexp_extract_all(text, '\S+')) AS tokens, coalesce(n, 0) AS chunks FROM v_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM kc GROUP BY 1) USING (document_id)),
c AS (SELECT department, course, count(*) AS documents, sum(chunks)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
dp AS (SELECT department, sum(documents)::BIGINT AS documents, sum(chunks)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens, array_to_string(list_sort(list(course))[1:8], ', ') AS courses FROM c GROUP BY department),
lc AS (SELECT department, course, string_agg('- ' || title, chr(10) ORDER BY document_id) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY department, course ORDER BY document_id) AS k FROM t) WHERE k <= 12 GROUP BY ALL),
ld AS (SELECT department, string_agg('- ' || course || ': ' || documents || ' documents', chr(10) ORDER BY course) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY course) AS k FROM c) WHERE k <= 12 GROUP BY ALL),
lr AS (SELECT string_agg('- ' || department || ': ' || documents || ' documents', chr(10) ORDER BY department) AS listed FROM (SELECT *, row_number() OVER (ORDER BY department) AS k FROM dp) WHERE k <= 12),
x AS (SELECT uri, 'document' AS tier, 1::BIGINT AS documents, chunks, tokens, title || ', a document of ' || course || ' in ' || department AS l0, coalesce(sy.l1, '# ' || uri) AS l1, t.document_id, 'tree://root/' || department || '/' || course AS parent_uri FROM t LEFT JOIN sy ON sy.document_id = uri
UNION ALL SELECT 'tree://root/' || department || '/' || course, 'course', documents, chunks, tokens, 'Course ' || course || ' in ' || department || ': ' || documents || ' documents, ' || tokens || ' words' AS l0, '# Course ' || course || ' in ' || department || chr(10) || 'Course ' || course || ' in ' || department || ': ' || documents || ' documents, ' || tokens || ' words' || chr(10) || '## Documents' || chr(10) || listed, NULL, 'tree://root/' || department FROM c JOIN lc USING (department, course)
UNION ALL SELECT 'tree://root/' || department, 'department', documents, chunks, tokens, 'Department ' || department || ': ' || documents || ' documents, ' || tokens || ' words; courses ' || courses, '# Department ' || department || chr(10) || 'Department ' || department || ': ' || documents || ' documents, ' || tokens || ' words; courses ' || courses || chr(10) || '## Courses' || chr(10) || listed, NULL, 'tree://root' FROM dp JOIN ld USING (department)
UNION ALL SELECT 'tree://root', 'root', sum(documents)::BIGINT, sum(chunks)::BIGINT, sum(tokens)::BIGINT, 'Corpus: ' || sum(documents)::BIGINT || ' documents, ' || sum(tokens)::BIGINT || ' words', '# Corpus' || chr(10) || 'Corpus: ' || sum(documents)::BIGINT || ' documents, ' || sum(tokens)::BIGINT || ' words' || chr(10) || '## Departments' || chr(10) || (SELECT listed FROM lr), NULL, 'tree:/' FROM dp),
nd AS (SELECT *, len(regexp_extract_all(l0, '\S+')) AS l0_tokens, len(regexp_extract_all(l1, '\S+')) AS l1_tokens FROM x)
"""
)


def _nodes(v):
    d = v("v_documents").withColumn("tokens", T.words_estimate(F.col("text")))
    pieces = materialise(chunks.chunk(d).select("document_id", "chunk_index", "text"))
    return graph.tiers(d.drop("text"), pieces), pieces


TIERS = "uri string, tier string, documents long, chunks long, tokens long, l0 string, l1 string, l0_tokens long, l1_tokens long"


@query("k12_tiers", _NODES + "SELECT uri, tier, documents, chunks, tokens, l0, l1, l0_tokens, l1_tokens FROM nd")
def k12(v):
    """Every node of the tree with its documents, chunks and words, its short and its long text, as a snapshot table holds it after a
    second sync in which a part of the nodes has changed."""
    table = SnapshotTable(v.spark, new_path(v.spark, "loom-tiers"), "uri", TIERS, 16)
    nodes = materialise(_nodes(v)[0].select(*table.schema.names).withColumns({"documents": F.col("documents").cast("long"), "l0_tokens": F.col("l0_tokens").cast("long"), "l1_tokens": F.col("l1_tokens").cast("long")}))
    graph.sync_tiers(table, nodes.where("tier <> 'root'").withColumn("l0", F.when(F.col("tier") == "document", F.col("l0")).otherwise(F.lit("old"))))
    graph.sync_tiers(table, nodes)
    return table.read()


@query("d5_tier_stats", _NODES + "SELECT tier, count(*) AS nodes, sum(chunks)::BIGINT AS chunks, round(avg(l0_tokens), 3) AS mean_l0, round(avg(l1_tokens), 3) AS mean_l1, round(100.0 * (1 - avg(l1_tokens) / 2500), 1) AS savings FROM nd GROUP BY tier")
def d5(v):
    """Nodes by tier, their chunks, the mean words of their texts, and what the long text saves against 2,500 words."""
    return _nodes(v)[0].groupBy("tier").agg(F.count("*").alias("nodes"), F.sum("chunks").alias("chunks"), F.round(F.avg("l0_tokens"), 3).alias("mean_l0"), F.round(F.avg("l1_tokens"), 3).alias("mean_l1"), F.round(100.0 * (1 - F.avg("l1_tokens") / 2500), 1).alias("savings"))


_ASKED = """SELECT 'tree://root/' || source || '/' || lang || CASE doc_id % 5 WHEN 0 THEN '/' || CAST(doc_id AS STRING) || '/l2' WHEN 1 THEN '/' || CAST(doc_id AS STRING) || '/l1' WHEN 2 THEN '/l2' WHEN 3 THEN '/' || CAST(doc_id AS STRING) ELSE '/' || left(CAST(doc_id AS STRING), length(CAST(doc_id AS STRING)) - 1) || '/l0' END AS asked FROM {documents}"""


@query("c23_resolve", _NODES + ", q AS (SELECT DISTINCT asked, rtrim(regexp_replace(asked, '/l[012]/?$', ''), '/') AS base, coalesce(nullif(regexp_extract(asked, '/(l[012])/?$', 1), ''), 'l1') AS tier_asked FROM (" + _ASKED.replace("{documents}", "documents") + """)),
of AS (SELECT uri, left(uri, n) AS base FROM (SELECT uri, unnest(range(length(parent_uri) + 1, length(uri) + 1)) AS n FROM nd)), b AS (SELECT q.asked, q.tier_asked, min(uri) AS uri FROM q JOIN of USING (base) GROUP BY ALL),
fl AS (SELECT document_id, string_agg('[Page ' || (chunk_index + 1) || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) AS l2 FROM kc GROUP BY 1)
SELECT asked, uri, tier_asked, CASE WHEN tier_asked = 'l0' THEN l0 WHEN tier_asked = 'l2' AND document_id IS NOT NULL THEN coalesce(l2, '') ELSE l1 END AS content FROM b JOIN nd USING (uri) LEFT JOIN fl USING (document_id)""")
def c23(v):
    """The texts of a URI for each document: its own at each tier, that of its course, or of what begins with a part of it."""
    nodes, pieces = _nodes(v)
    paths = graph.tree_paths(v("v_documents")).select("uri", "parent_uri", "document_id")
    return graph.resolve(v.spark.sql(_ASKED, documents=v("documents")), nodes.join(paths, "uri"), pieces)


#: A session's messages, with an instruction of the system before the first one in half of them.
_PAIRS = """WITH m AS (SELECT session_id, message_id, turn, sender, content FROM v_messages UNION ALL SELECT DISTINCT session_id, -1 - message_id, -1, 'system', 'Answer from the documents of ' || department || '.' FROM v_messages WHERE turn = 0 AND message_id % 200 = 0),
n AS (SELECT *, lead(sender) OVER w AS s2, lead(content) OVER w AS c2, last_value(CASE WHEN sender = 'system' THEN content END IGNORE NULLS) OVER w AS system, lag(CASE WHEN sender = 'assistant' THEN content END) OVER w AS before FROM m WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query("k14_instruction_pairs", _PAIRS.replace("lead(sender) OVER w", "lead(sender) OVER (PARTITION BY session_id ORDER BY turn)").replace("lead(content) OVER w", "lead(content) OVER (PARTITION BY session_id ORDER BY turn)").replace("lag(CASE WHEN sender = 'assistant' THEN content END) OVER w", "lag(CASE WHEN sender = 'assistant' THEN content END) OVER (PARTITION BY session_id ORDER BY turn)") + r"""SELECT message_id, coalesce(system, '') AS system, content AS instruction, CASE WHEN before IS NULL THEN '' ELSE '<context>' || chr(10) || '[Document: ' || session_id || ' | Page: ' || (turn - 1) || ' | Section: N/A]' || chr(10) || regexp_replace(before, '^\s+|\s+$', '', 'g') || chr(10) || '</context>' END AS context,
c2 AS output, ('0x' || left(md5(session_id), 7))::BIGINT % 10 = 0 AS validation FROM n WHERE sender = 'user' AND s2 = 'assistant'""")
def k14(v):
    """Pairs of a question and its answer, with the system's instruction, the answer before as fenced context, and a split by a hash
    of the session, so that a session is on one side."""
    m = v("v_messages").select("session_id", "message_id", "turn", "sender", "content", "department")
    told = m.where("turn = 0 and message_id % 200 = 0").select("session_id", (-1 - F.col("message_id")).alias("message_id"), F.lit(-1).alias("turn"), F.lit("system").alias("sender"), F.concat(F.lit("Answer from the documents of "), "department", F.lit(".")).alias("content"))
    return reports.instruction_pairs(m.drop("department").unionByName(told))
