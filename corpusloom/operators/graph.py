"""Knowledge graph, link graph and directory tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.scratch import materialise
from corpusloom.sources.snapshots import SnapshotTable

from .reports import first_distinct


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) whose ends differ and both exist in nodes (id)."""
    ids = nodes.select("id").distinct()
    e = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """id and activation of what one hop from seeds (id, score) reaches over edges (src, dst, weight), either way."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    x = both.join(seeds.select(F.col("id").alias("src"), "score"), "src")
    return x.groupBy(F.col("dst").alias("id")).agg(F.round(F.max(F.col("score") * F.col("weight") * 0.85), 2).alias("activation"))


def _fitting(concepts: dict[str, str]) -> Column:
    """Names of the concepts whose patterns fit the text."""
    return F.filter(F.array(*(F.when(T.fits(F.col("text"), p), F.lit(n)) for n, p in concepts.items())), lambda x: x.isNotNull())


def concept_documents(documents: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """Distinct documents whose text fits each concept's pattern; concepts without one are left out. One pass over the texts."""
    return documents.select("document_id", F.explode(_fitting(concepts)).alias("concept")).groupBy("concept").agg(F.countDistinct("document_id").alias("documents"))


def _node(kind: str, *names: str) -> Column:
    """Id of a node; all ids come from here, so that no edge misses its ends by spelling."""
    return F.concat_ws("-", F.lit(kind), *(T.slug(F.col(n)) for n in names))


def _doc() -> Column:
    return F.concat(F.lit("doc-"), F.col("document_id").cast("string"))


def _concept(name: Column) -> Column:
    return F.concat(F.lit("concept-"), T.slug(name))


def sketched(documents: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """documents (document_id, title, department, course, text) with the concepts whose patterns fit the text in its place, written as a
    table: a graph reads it several times, and the texts once."""
    return materialise(documents.select("document_id", "title", "department", "course", _fitting(concepts).alias("concepts")))


def document_concepts(documents: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """documents (document_id, department, course, and text or concepts) without text, a row for each concept whose pattern fits the text."""
    held = F.col("concepts") if "concepts" in documents.columns else _fitting(concepts)
    return documents.select("document_id", "department", "course", F.explode(held).alias("concept"))


def graph_nodes(documents: DataFrame, each: int | None = None, total: int | None = None, concepts: dict[str, str] | None = None) -> DataFrame:
    """Nodes of the corpus graph: the core, departments, courses, concepts that a document fits, and all documents, or a balanced
    sample of ``total``."""
    from .feeds import balanced

    sample = documents if total is None else balanced(documents, "department", ["document_id"], each, total)
    core = documents.sparkSession.createDataFrame([("core", "corpus", "core")], "id string, label string, type string")
    dep = documents.select(_node("dept", "department").alias("id"), F.col("department").alias("label"), F.lit("department").alias("type")).distinct()
    course = documents.select(_node("course", "department", "course").alias("id"), F.col("course").alias("label"), F.lit("course").alias("type")).distinct()
    doc = sample.select(_doc().alias("id"), F.col("title").alias("label"), F.lit("document").alias("type"))
    parts = [core, dep, course, doc]
    if concepts:
        parts.append(document_concepts(documents, concepts).select(_concept(F.col("concept")).alias("id"), F.col("concept").alias("label"), F.lit("concept").alias("type")).distinct())
    return reduce(DataFrame.union, parts)


def graph_edges(documents: DataFrame, nodes: DataFrame, concepts: dict[str, str] | None = None, at: DataFrame | None = None) -> DataFrame:
    """Edges core-department, department-course, course-document, course-concept and document-concept between nodes that exist. With at
    (id, each once) only those that touch one of its nodes; others are left out before any is shuffled."""
    dep, course = _node("dept", "department"), _node("course", "department", "course")
    parts = [(documents, F.lit("core"), dep, 1.0), (documents, dep, course, 0.8), (documents, course, _doc(), 0.6)]
    if concepts:
        named, concept = document_concepts(documents, concepts), _concept(F.col("concept"))
        parts += [(named, course, concept, 0.9), (named, _doc(), concept, 0.85)]
    edges = [rows.select(a.alias("src"), b.alias("dst"), F.lit(w).alias("weight")) for rows, a, b, w in parts]
    if at is not None:
        end = lambda c: at.select(F.col("id").alias(c), F.lit(True).alias(c + "_at"))
        edges = [e.join(end("src"), "src", "left").join(end("dst"), "dst", "left").where("src_at or dst_at").select(*e.columns) for e in edges]
    return valid_edges(reduce(DataFrame.union, (e.distinct() for e in edges)), nodes)


def tree_paths(documents: DataFrame) -> DataFrame:
    """uri, parent_uri, tier and document_id of all nodes of the directory tree."""
    root, dep = F.lit("tree://root"), F.concat(F.lit("tree://root/"), T.slug(F.col("department")))
    course = F.concat(dep, F.lit("/"), T.slug(F.col("course")))
    doc = F.concat(course, F.lit("/"), F.col("document_id").cast("string"))
    level = lambda uri, parent, tier, i: documents.select(uri.alias("uri"), parent.alias("parent_uri"), F.lit(tier).alias("tier"), i.alias("document_id")).distinct()
    no = F.lit(None).cast("bigint")
    return reduce(DataFrame.union, (level(dep, root, "department", no), level(course, dep, "course", no), level(doc, course, "document", F.col("document_id"))))


#: Children that the long text of a node names.
SHOWN = 12


def _listed(children: DataFrame, by: list[str], name: str, line: Column) -> DataFrame:
    """by and listed: a line for each of the first children of a node, by name. A pruned top-k; no node's children meet in one row."""
    few = children.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(name))).where(F.col("_k") <= SHOWN)
    return few.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", line.alias("line")))), lambda x: x["line"]), "\n").alias("listed"))


def tiers(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """uri, tier, documents, chunks, tokens, l0, l1 and their tokens of every node of the directory tree over documents (document_id,
    title, department, course, tokens) and chunks (document_id, chunk_index, text).

    l0 is a sentence; l1 of a document its synopsis, of a course, a department and the root l0 and its first children."""
    from .synopsis import synopses

    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    dep, course = T.slug(F.col("department")), T.slug(F.col("course"))
    size = ("documents", "chunks", "tokens")
    totals = lambda rows, *by: rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in size))
    n, w, d, c = F.col("documents"), F.col("tokens"), F.col("department"), F.col("course")
    longer = lambda head, part: said(head, "\n", F.col("l0"), "\n## ", part, "\n", F.col("listed"))
    parts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    leaf = documents.select(dep.alias("department"), course.alias("course"), "document_id", F.coalesce("title", F.lit("")).alias("title"), F.lit(1).cast("long").alias("documents"), "tokens").join(parts, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    uri = said("tree://root/", d, "/", c, "/", F.col("document_id"))
    told = synopses(leaf.select("document_id", uri.alias("title"), "department", F.lit("all").alias("course")), chunks).select("document_id", F.col("l1").alias("told"))
    leaves = leaf.withColumn("l0", said(F.col("title"), ", a document of ", c, " in ", d)).join(told, "document_id", "left").select(uri.alias("uri"), F.lit("document").alias("tier"), *size, "l0", F.coalesce("told", said("# ", uri)).alias("l1"))
    courses = totals(leaf, "department", "course")
    departments = totals(courses, "department")
    root = totals(departments)
    of_course = _listed(leaf, ["department", "course"], "document_id", said("- ", F.col("title")))
    of_department = _listed(courses, ["department"], "course", said("- ", c, ": ", n, " documents"))
    of_root = _listed(departments.withColumn("root", F.lit(0)), ["root"], "department", said("- ", d, ": ", n, " documents"))
    names = first_distinct(courses, ["department"], "course", 8).select("department", F.array_join("names", ", ").alias("courses"))
    nodes = (
        leaves,
        courses.join(of_course, ["department", "course"]).withColumn("l0", said("Course ", c, " in ", d, ": ", n, " documents, ", w, " words")).select(said("tree://root/", d, "/", c).alias("uri"), F.lit("course").alias("tier"), *size, "l0", longer(said("# Course ", c, " in ", d), "Documents").alias("l1")),
        departments.join(of_department, "department").join(names, "department").withColumn("l0", said("Department ", d, ": ", n, " documents, ", w, " words; courses ", F.col("courses"))).select(said("tree://root/", d).alias("uri"), F.lit("department").alias("tier"), *size, "l0", longer(said("# Department ", d), "Courses").alias("l1")),
        root.where("documents is not null").withColumn("root", F.lit(0)).join(of_root, "root").withColumn("l0", said("Corpus: ", n, " documents, ", w, " words")).select(F.lit("tree://root").alias("uri"), F.lit("root").alias("tier"), *size, "l0", longer(said("# Corpus"), "Departments").alias("l1")),
    )
    x = reduce(DataFrame.unionByName, nodes)
    return x.withColumns({"l0_tokens": T.words_estimate(F.col("l0")), "l1_tokens": T.words_estimate(F.col("l1"))})


def sync_tiers(table: SnapshotTable, nodes: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
    """Bring a snapshot table of tiers (key uri) up to date with nodes: new and changed nodes are written, vanished ones go, and buckets
    without any stay as they are. Returns uri and change (new, changed or gone)."""
    shape = lambda rows: rows.select("uri", F.xxhash64(*(c for c in rows.columns if c != "uri")).alias("h"))
    nodes = materialise(nodes.select(*table.schema.names))
    old, new = shape(table.read()).withColumnRenamed("h", "old"), shape(nodes).withColumnRenamed("h", "new")
    x = old.join(new, "uri", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    changes = materialise(x.select("uri", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").otherwise("changed").alias("change")))
    if not changes.isEmpty():
        table.replace(changes.select("uri"), nodes.join(changes.select("uri"), "uri", "left_semi"), batch)
    return changes


#: Between the chunks of a text in full.
BETWEEN = "\n\n---\n\n"


def resolve(asked: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked, uri, tier_asked and content for each distinct URI of asked (asked) that is found: at l0 the short text, at l1 (also without a
    tier at its end) the long one, at l2 a document's chunks in order below [Page n], and what l1 gives for other nodes.

    A node that is asked by its own URI is taken, else the first one whose URI begins so. nodes: uri, tier, document_id, parent_uri, l0, l1."""
    q = asked.select("asked").distinct().select("asked", F.rtrim(F.regexp_replace("asked", r"/l[012]/?$", ""), F.lit("/")).alias("base"), F.coalesce(F.nullif(F.regexp_extract("asked", r"/(l[012])/?$", 1), F.lit("")), F.lit("l1")).alias("tier_asked"))
    least = F.length("parent_uri")
    starts = F.transform(F.sequence(F.lit(1), F.length("uri") - least), lambda n: F.left("uri", least + n))
    offered = nodes.select("uri", F.explode(starts).alias("base")).join(q.select("base").distinct(), "base", "left_semi")
    best = offered.groupBy("base").agg(F.min("uri").alias("uri"))
    found = q.join(best, "base").join(nodes.select("uri", "document_id", "l0", "l1"), "uri")
    whole = found.where("tier_asked = 'l2' and document_id is not null").select("document_id").distinct()
    page = F.struct("chunk_index", F.concat(F.lit("[Page "), (F.col("chunk_index") + 1).cast("string"), F.lit("] "), "text").alias("t"))
    full = chunks.join(whole, "document_id", "left_semi").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["t"]), BETWEEN).alias("l2"))
    x = found.join(full, "document_id", "left")
    content = F.when(F.col("tier_asked") == "l0", F.col("l0")).when((F.col("tier_asked") == "l2") & F.col("document_id").isNotNull(), F.coalesce("l2", F.lit(""))).otherwise(F.col("l1"))
    return x.select("asked", "uri", "tier_asked", content.alias("content"))


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int, materialise) -> DataFrame:
    """page_id and least depth from seeds (page_id) over edges (src, dst), up to max_depth. materialise(df) writes and
    rereads a table, so that the plan of a depth does not hold those before it."""
    seen = materialise(seeds.select("page_id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.select(F.col("page_id").alias("src")).join(edges, "src").select(F.col("dst").alias("page_id")).distinct()
        frontier = materialise(found.join(seen, "page_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = materialise(seen.unionByName(frontier))
    return seen
