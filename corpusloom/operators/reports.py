"""Aggregations over chat, audit, security and ingest tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

LOW_CONFIDENCE = 0.75


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, d in tables.items()])


def counts_of(rows: DataFrame, column: str, values: list[str] | None = None, top: int | None = None, null: str = "unknown") -> DataFrame:
    """Count of each value; all of values with zeros if given; the largest ``top`` if given."""
    c = rows.groupBy(F.coalesce(column, F.lit(null)).alias(column)).agg(F.count("*").alias("n"))
    if values:
        c = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string").join(c, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    return c.orderBy(F.col("n").desc(), column).limit(top) if top else c


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Per cent of part in whole, to one place."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(empty))


def is_low(m: str = "confidence", d: str = "crag_decision") -> Column:
    return F.coalesce(F.col(m) < LOW_CONFIDENCE, F.lit(False)) | F.coalesce(F.col(d) == "INCORRECT", F.lit(False))


def conversation_health(messages: DataFrame) -> DataFrame:
    up, down = F.count_if(F.col("feedback") == "up"), F.count_if(F.col("feedback") == "down")
    return messages.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages"), up.alias("up"), down.alias("down"), share(up, up + down, 100.0).alias("satisfaction"), F.count_if(is_low()).alias("low_confidence"), F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"))


def session_rollup(messages: DataFrame) -> DataFrame:
    """One row per session: counts, title, flags, score, first and last time."""
    asked = F.when(F.col("sender") == "user", F.struct("created_s", "turn", "content"))
    title = F.left(F.substring_index(F.min(asked)["content"], "\n", 1), F.lit(80))
    score = F.sum(F.when(F.col("feedback") == "up", 1).when(F.col("feedback") == "down", -1).otherwise(0))
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), title.alias("title"), F.bool_or(is_low()).alias("has_low_confidence"), F.bool_or(F.coalesce(F.col("feedback") == "down", F.lit(False))).alias("has_negative_feedback"), score.alias("feedback_score"), F.min("created_s").alias("first_s"), F.max("created_s").alias("last_s"))


def latest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def gate_diagnostics(audit: DataFrame, n: int = 100) -> DataFrame:
    """Decisions, hit rate, who served, and means over the latest n rows of the audit."""
    x = latest(audit, [F.col("ts").desc(), F.col("audit_id").desc()], n)
    count = lambda c, v: F.count_if(F.col(c) == v)
    every = F.count("*")
    return x.agg(
        every.alias("n"),
        *(count("crag_decision", d).alias(d.lower()) for d in ("CORRECT", "AMBIGUOUS", "INCORRECT")),
        share(count("crag_decision", "CORRECT") + count("crag_decision", "AMBIGUOUS"), every).alias("hit_rate"),
        *(count("served_by", s).alias(f"by_{s}") for s in ("cache", "local", "hosted")),
        F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"),
        F.round(F.avg("confidence"), 3).alias("mean_confidence"),
    )


def latency_percentiles(rows: DataFrame, by: str, value: str, shares=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Values at rank floor(n * p) of each group in order, and the mean; nulls have no rank.

    Equal values are counted first; running counts go by buckets that grow with the value, whose offsets come from a
    table of bucket sums, so that a group with most of the rows is not sorted in one task."""
    v = F.col("_v")
    bucket = F.floor(F.signum(v) * F.log2(1 + F.abs(v)) * 64)
    c = rows.select(by, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(by, "_v").agg(F.count("*").alias("_c")).withColumn("_b", bucket)
    run = W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = c.groupBy(by, "_b").agg(F.sum("_c").alias("_s")).select(by, "_b", F.coalesce(F.sum("_s").over(run), F.lit(0)).alias("_o"), F.sum("_s").over(W.partitionBy(by)).alias("_n"))
    inside = F.sum("_c").over(W.partitionBy(by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    x = c.withColumn("_e", inside).join(sums, [by, "_b"]).withColumn("_e", F.col("_e") + F.col("_o"))
    rank = lambda p: F.floor(F.col("_n") * F.lit(p))
    at = lambda p: F.max(F.when((rank(p) >= F.col("_e") - F.col("_c")) & (rank(p) < F.col("_e")), v))
    mean = F.round(F.sum(v * F.col("_c")) / F.sum("_c"), 3)
    return x.groupBy(by).agg(*(at(p).alias(f"p{round(p * 100)}") for p in shares), mean.alias("mean"))


def cumulative_buckets(rows: DataFrame, by: str, value: Column, bounds: list[float]) -> DataFrame:
    """How many values are at most each bound, per group; the last bound stands for all."""
    wide = rows.groupBy(by).agg(*(F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)), F.count("*").alias("le_inf"))
    pairs = F.array(*(F.struct(F.lit(str(float(b))).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
    return wide.select(by, F.inline(pairs))


def scorecard(cases: DataFrame) -> DataFrame:
    """cases (should_abstain, hit, cited, abstained, latency_ms): rates by kind of case, 1.0 where there is none."""
    keep, none = ~F.col("should_abstain"), F.col("should_abstain")
    rate = lambda kind, ok: F.coalesce(F.avg(F.when(kind, ok.cast("double"))), F.lit(1.0))
    passed = F.when(keep, F.col("hit")).otherwise(F.col("abstained")).cast("double")
    return cases.agg(F.count("*").alias("cases"), F.round(rate(keep, F.col("hit")), 6).alias("hit_rate"), F.round(rate(keep, F.col("cited")), 6).alias("citation_precision"), F.round(rate(none, F.col("abstained")), 6).alias("abstention_accuracy"), F.round(F.avg(passed), 6).alias("pass_rate"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"))


def hierarchy(documents: DataFrame) -> DataFrame:
    """Documents and tokens by department and course, by department, and in all; level 0 to 2. courses: the first eight.

    Documents are counted by department and course first. The first eight courses of a branch are taken among the first eight of each part
    of it, and of the whole among those of its departments, so that no row ever holds all names."""
    leaf = documents.groupBy("department", "course").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    sums = leaf.rollup("department", "course").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("g"))
    sums = sums.withColumn("level", F.when(F.col("g") == 0, 2).when(F.col("g") == 1, 1).otherwise(0)).drop("g")
    named = leaf.where("course is not null").select("department", "course").distinct()
    of_department = first_distinct(named, ["department"], "course", 8)
    of_all = first_distinct(of_department.select(F.lit(0).alias("root"), F.explode("names").alias("course")), ["root"], "course", 8)
    some = of_department.select(F.lit(1).alias("of_level"), F.col("department").alias("of"), "names").union(of_all.select(F.lit(0), F.lit(None), "names"))
    x = sums.join(some, (F.col("level") == F.col("of_level")) & F.when(F.col("level") == 1, F.col("department")).eqNullSafe(F.col("of")), "left")
    own = F.when(F.col("course").isNull(), F.array().cast("array<string>")).otherwise(F.array("course"))
    return x.select("department", "course", "documents", "tokens", F.array_join(F.when(F.col("level") == 2, own).otherwise(F.coalesce("names", F.array().cast("array<string>"))), ",").alias("courses"), "level")


def first_distinct(rows: DataFrame, by: list[str], column: str, k: int) -> DataFrame:
    """by and names: the k least distinct values of a column in each group. A pruned top-k over distinct values, of which
    each task passes on k of a group, in place of a set of all values."""
    few = rows.select(*by, column).distinct().withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(column))).where(F.col("_k") <= k)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias("names"))


def security_stats(incidents: DataFrame, now: Column) -> DataFrame:
    return incidents.agg(F.count("*").alias("total"), F.count_if(F.col("ts") > now - F.expr("interval 24 hours")).alias("last_day"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), *(F.count_if(F.col("event_type") == k).alias(f"type_{k}") for k in ("error", "click")))


#: Words of each topic of failures, in order of priority.
TOPICS = {"exam": ["exam", "datesheet", "schedule"], "admission": ["admission", "apply", "form", "eligibility"], "fees": ["fee", "hostel", "scholarship"]}


def topic_of(questions: DataFrame, text: str, negative: Column) -> DataFrame:
    """The first topic found in all questions together, and how many questions name each."""
    names = {k: F.greatest(*(F.lower(F.col(text)).contains(w) for w in ws), F.lit(False)) for k, ws in TOPICS.items()}
    x = questions.agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{k}") for k, c in names.items()), F.coalesce(F.bool_or(negative), F.lit(False)).alias("_bad"))
    return x.select("n", *(f"n_{k}" for k in names), F.coalesce(*(F.when(F.col(f"n_{k}") > 0, k) for k in names), F.when(F.col("_bad"), "direct_answer"), F.lit("precision")).alias("topic"))


#: Alerts with their thresholds, and the minutes that each must hold before it fires.
HOLD = {"slow": 5, "failing": 2, "cold": 30}


def alerts(audit: DataFrame, slow_ms: float = 5000) -> DataFrame:
    """Per minute: 95th percentile of latency and error share over 5 minutes, cache share over 15, which alerts' conditions hold, and
    which have held long enough to fire: in each minute since as many ago as HOLD says.

    Rows are counted by minute, and latencies by minute and value, before they are spread over the windows that they are part of."""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    per = audit.select(minute.alias("m"), "latency_ms", (F.col("crag_decision") == "INCORRECT").cast("int").alias("bad"), (F.col("served_by") == "cache").cast("int").alias("hit"))
    spread = lambda x, n: x.withColumn("m", F.explode(F.sequence(F.col("m"), F.col("m") + n - 1)))
    by_minute = per.groupBy("m").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.count("bad").alias("judged"), F.sum("hit").alias("hit"), F.count("hit").alias("served"))
    five = spread(by_minute, 5).groupBy("m").agg(F.sum("n").alias("n"), F.round(F.sum("bad") / F.sum("judged"), 6).alias("error_share"))
    values = spread(per.where("latency_ms is not null").groupBy("m", "latency_ms").agg(F.count("*").alias("k")), 5).groupBy("m", "latency_ms").agg(F.sum("k").alias("k"))
    w = W.partitionBy("m")
    ranked = values.withColumns({"upto": F.sum("k").over(w.orderBy("latency_ms").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("k").over(w)})
    p95 = ranked.where(F.col("upto") >= F.least(F.floor(F.col("all") * 0.95) + 1, "all")).groupBy("m").agg(F.round(F.min("latency_ms"), 3).alias("p95_ms"))
    quarter = spread(by_minute, 15).groupBy("m").agg(F.round(F.sum("hit") / F.sum("served"), 6).alias("cache_share"))
    x = five.join(p95, "m", "left").join(quarter, "m")
    x = x.withColumns({"slow": F.col("p95_ms") > slow_ms, "failing": F.col("error_share") > 0.05, "cold": F.col("cache_share") < 0.2})
    for name, hold in HOLD.items():  # a condition fires in a minute that, with itself, has hold + 1 such minutes behind it
        held = spread(x.where(name).select("m"), hold + 1).groupBy("m").agg((F.count("*") == hold + 1).alias(f"{name}_fires"))
        x = x.join(held, "m", "left").withColumn(f"{name}_fires", F.coalesce(f"{name}_fires", F.lit(False)))
    return x.select(F.col("m").alias("minute"), "n", "error_share", "p95_ms", "cache_share", *HOLD, *(f"{c}_fires" for c in HOLD))


def instruction_pairs(messages: DataFrame) -> DataFrame:
    """message_id, system, instruction, context, output and validation of each user message of messages (session_id, message_id,
    turn, sender, content) that an assistant's follows. context: the assistant's message before, fenced; validation: a tenth of
    the sessions."""
    w = W.partitionBy("session_id").orderBy("turn")
    n = messages.withColumns(
        {
            "s2": F.lead("sender").over(w),
            "output": F.lead("content").over(w),
            "system": F.coalesce(F.last(F.when(F.col("sender") == "system", F.col("content")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit("")),
            "before": F.lag(F.when(F.col("sender") == "assistant", F.col("content"))).over(w),
        }
    )
    fenced = F.concat(F.lit("<context>\n"), T.fenced(F.col("session_id"), (F.col("turn") - 1).cast("string"), F.lit("N/A"), F.col("before")), F.lit("\n</context>"))
    split = F.conv(F.left(F.md5(F.col("session_id").cast("binary")), F.lit(7)), 16, 10).cast("long") % 10 == 0
    return n.where("sender = 'user' and s2 = 'assistant'").select("message_id", "system", F.col("content").alias("instruction"), F.when(F.col("before").isNull(), "").otherwise(fenced).alias("context"), "output", split.alias("validation"))
