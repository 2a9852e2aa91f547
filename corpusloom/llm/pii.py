"""Personal data spans by aggregation of weak labelers, in DataFrame operations only.

Candidates are the matches of the base patterns and of wider ones (numbers without a plus sign, spelled-out mail
addresses, IPv6, and base matches that fail their test). Six labelers vote on each: written form by regex, checksum or
structure, gazetteer (issuer prefixes, calling codes, top-level domains, address ranges), words before the span, grouping, and what
touches the span. Votes are counted by pattern of votes, a table bounded by the number of patterns; on it
expectation-maximisation estimates how reliable each labeler is for either class of a kind, and its posteriors train a logistic
span classifier over kind, votes and length, which then scores all candidates as a column expression.

Base spans always stay; the method adds candidates that the classifier accepts and that overlap no base span.
Positions are in code points, end exclusive. They come from the lengths of the gaps between matches, summed by a window.

Defined cases: null and empty texts have no spans; a null doc_id is kept; rows with the same doc_id and text get the
same result; very long texts are searched whole; of added spans that overlap the one that starts first stays, of those that
start together the shorter; an empty table gives an empty result. Only doc_id and text are read. Patterns cannot backtrack over long
runs, and ``\\G`` lets a match start only at the head of a run or where the last one ended, which finds the same matches
in linear time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import document_keys, materialise, one_row_each

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: source of a candidate: (kind, pattern, pattern that a text must hold). The first four are the base ones.
SOURCES = {
    "email": ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]"),
    "card": ("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "local_phone": ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|0[0-9]{1,3})[\x20.-]?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])", "[0-9]"),
    "spelled_email": ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}\x20?[\[({{](?:at|AT)[\])}}]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[({{](?:dot|DOT)[\])}}])\x20?[A-Za-z0-9-]{{1,63}}){{1,5}}", r"[\[({](?:at|AT)[\])}]"),
    "ip6": ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "[0-9A-Fa-f]:[0-9A-Fa-f]"),
}
_BEFORE = 30
MIN_PROBABILITY = 0.8
VOTES = ("v_regex", "v_check", "v_gazetteer", "v_context", "v_groups", "v_edges")
#: Words before a span that speak for or against it, by language.
_FOR = "e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|mastercard|credit|ip|host|server|address|telefon|handy|anruf|karte|kontakt|adresse|t[ée]l[ée]phone|appel|carte|courriel|tel[ée]fono|llam|tarjeta|correo|contacto|direcci[óo]n"
_AGAINST = "version|isbn|issn|order|invoice|token|sha|md5|hash|key|serial|id|no|nr|page|price|total|figure|section|rechnung|seite|facture|pedido"
#: Top-level domains taken as known.
_TLDS = "com|net|org|edu|gov|info|io|de|fr|es|uk|eu|at|ch|it|nl|be|pt|ca|us|mx|ar|co|me|biz"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(at, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_test(source: Column, match: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    d = _digits(match)
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(source == "email", True)
        .when(source == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(source == "card", F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
        .when(source == "phone", F.length(d).between(10, 15))
        .otherwise(False)
    )


def candidates(docs: DataFrame) -> DataFrame:
    """_r1, _r2 (a document's keys), source, kind, start, end, match, before, after and base of each candidate."""
    d = one_row_each(docs.where(F.col("text").rlike(r"[0-9@\[({]"))).select("_r1", "_r2", "text")
    for name, (_, pattern, needs) in SOURCES.items():
        has = F.col("text").rlike(needs)
        d = d.withColumn(f"m_{name}", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        d = d.withColumn(f"g_{name}", F.when(F.size(f"m_{name}") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))

    def found(name: str) -> Column:
        m, g = F.col(f"m_{name}"), F.col(f"g_{name}")
        z = F.arrays_zip(m.alias("m"), F.slice(g, 1, F.size(m)).alias("g"), F.slice(g, 2, F.size(m)).alias("n"))
        return F.transform(z, lambda x, i: F.struct(F.lit(name).alias("source"), i.alias("pos"), x["m"].alias("match"), F.length(x["g"]).cast("long").alias("gap"), F.right(x["g"], F.lit(_BEFORE)).alias("before"), F.left(x["n"], F.lit(1)).alias("after")))

    rows = d.select("_r1", "_r2", F.explode(F.concat(*map(found, SOURCES))).alias("x")).select("_r1", "_r2", "x.*")
    run = W.partitionBy("_r1", "_r2", "source").orderBy("pos")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(run.rowsBetween(W.unboundedPreceding, 0)))
    kind = F.coalesce(*(F.when(F.col("source") == s, k) for s, (k, _, _) in SOURCES.items()))
    return rows.select("_r1", "_r2", "source", kind.alias("kind"), (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", "after", base_test(F.col("source"), F.col("match")).alias("base"))


#: The usual written form of each kind, in full.
FORMS = {
    "email": rf"(?i)^[{_LOCAL}]+(?:@|\x20?[\[({{]at[\])}}]\x20?)[A-Z0-9-]+(?:\x20?(?:\.|[\[({{]dot[\])}}])\x20?[A-Z0-9-]+)*\x20?(?:\.|[\[({{]dot[\])}}])\x20?[A-Z]{{2,24}}$",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$",
    "card": r"^(?:[0-9]{4}\x20?){3}[0-9]{2,7}$|^(?:[0-9]{4}-?){3}[0-9]{2,7}$|^[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20.(-]|^\+[1-9][0-9]{9,14}$|^\(0?[0-9]{2,4}\)|^0[0-9]{1,3}[\x20.-]",
}


def votes(c: DataFrame) -> DataFrame:
    """Candidates with the labelers' votes: 1 for, -1 against, 0 abstains; and a length class. No labeler knows whether a
    candidate is a base span or which pattern found it."""
    m, d, kind = F.col("match"), _digits(F.col("match")), F.col("kind")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    first = F.regexp_extract(m, "^[0-9]+", 0)
    issuer = d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)")
    regex = vote(F.coalesce(*(F.when(kind == k, m.rlike(p)) for k, p in FORMS.items())), F.lit(True))
    octets = F.forall(F.split(m, r"\."), lambda x: F.length(x).between(1, 3) & (x.try_cast("int") <= 255))
    check = F.when(kind == "card", vote(F.length(d).between(13, 19) & luhn(d), F.lit(True))).when(kind == "ip", vote(m.rlike(":") | octets, F.lit(True))).when(kind == "phone", vote(F.length(d).between(9, 15), F.lit(True))).otherwise(vote(m.rlike(r"(?i)[a-z]"), F.lit(True)))
    gazetteer = F.when(kind == "card", vote(issuer, F.lit(True))).when(kind == "ip", vote(~first.isin("0", "127") & (F.length(first) <= 3), first.isin("0", "127"))).when(kind == "phone", vote(d.rlike("^(?:1|33|34|44|49|41|43|0[1-9])"), d.rlike("^00000"))).otherwise(vote(m.rlike(rf"(?i)[.\])}}]\x20?(?:{_TLDS})$"), F.lit(False)))
    context = vote(F.col("before").rlike(rf"(?i)(?:{_FOR})[\w]*[\s:.#=-]*$"), F.col("before").rlike(rf"(?i)\b(?:{_AGAINST})[\s:.#=\"-]*$"))
    cut = m.rlike(r"[\x20-]")  # only what is written in groups can be grouped well or badly
    groups = F.when((kind == "card") & cut, vote(m.rlike(r"^(?:[0-9]{4}\x20){3}[0-9]{2,7}$|^(?:[0-9]{4}-){3}[0-9]{2,7}$"), F.lit(True))).when(kind == "phone", vote(m.rlike(r"[\x20().-]"), m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"))).otherwise(F.lit(0))
    edges = vote(F.col("before").rlike(r"(?:^|[\s,;:(<\[])$") & F.col("after").rlike(r"^(?:$|[\s,;:.!?)>\]])"), F.col("before").rlike(r"[\w\"=/]$") | F.col("after").rlike(r"^[\w\"=/]"))
    size = F.least(F.floor(F.length(m) / 6), F.lit(5)).cast("int")
    named = zip(VOTES, (regex, check, gazetteer, context, groups, edges), strict=True)
    return c.select("*", *(v.cast("int").alias(n) for n, v in named), size.alias("size"))


#: What is believed of P(vote | class) beforehand, for votes -1, 0, 1: labelers are better than chance. It weighs half as much
#: as all candidates, so that candidates of one class alone are not split into two.
BELIEF = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the positive class for each pattern of votes (-1, 0, 1), and P(vote | class), by EM from the mean vote."""
    post = np.clip(0.5 + patterns.sum(1) / (2 * patterns.shape[1]), 0.05, 0.95)
    table = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for y, w in enumerate((counts * (1 - post), counts * post)):
            for j in range(patterns.shape[1]):
                share = np.bincount(patterns[:, j] + 1, w, 3) + 0.5 * counts.sum() * BELIEF[y]
                table[y, j] = share / share.sum()
        prior = (counts @ post + 1) / (counts.sum() + 2)
        log = [np.log(p) + sum(np.log(table[y, j][patterns[:, j] + 1]) for j in range(patterns.shape[1])) for y, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, table


def train(scored: DataFrame) -> dict[tuple[str, object], float]:
    """Weight of each feature value, and of ("", ""), the intercept. Only counts by pattern reach the driver: at most
    kinds x 3^labelers x length classes rows, whatever the input. Reliabilities are estimated for each kind by itself."""
    keys = ["kind", *VOTES, "size"]
    rows = scored.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).collect()
    if not rows:
        return {("", ""): -10.0}
    patterns, counts = np.array([[r[v] for v in VOTES] for r in rows]), np.array([r["n"] for r in rows], float)
    post, kinds = np.zeros(len(rows)), np.array([r["kind"] for r in rows])
    for kind in KINDS:
        if (mine := kinds == kind).any():
            post[mine] = reliabilities(patterns[mine], counts[mine])[0]
    values = sorted({(k, r[k]) for r in rows for k in keys}, key=str)
    number = {v: i for i, v in enumerate(values)}
    x = np.zeros((len(rows), len(values) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [number[k, r[k]] for k in keys]] = 1
    w, weight = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - post)) + 1e-3 * w
        w -= np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + 1e-3 * np.eye(len(w)), grad)
    return {v: float(w[i]) for v, i in number.items()} | {("", ""): float(w[-1])}


def probability(weights: dict[tuple[str, object], float]) -> Column:
    total = F.lit(weights[("", "")])
    for column in dict.fromkeys(k for k, _ in weights if k):
        mine = [(v, w) for (k, v), w in weights.items() if k == column]
        total += F.coalesce(*(F.when(F.col(column) == v, F.lit(w)) for v, w in mine), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def find(docs: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """_r1, _r2, kind, start, end, base, probability of each span: base ones and those that the classifier adds."""
    scored = materialise(votes(candidates(docs)), "pii-candidates")
    scored = scored.withColumn("probability", probability(train(scored)))
    rows = scored.where(F.col("base") | (F.col("probability") >= min_probability))
    doc = W.partitionBy("_r1", "_r2").orderBy("start", "end", "source")
    of = lambda test, column: F.when(test, F.col(column))
    rows = rows.withColumn("base_before", F.max(of(F.col("base"), "end")).over(doc.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("base_after", F.min(of(F.col("base"), "start")).over(doc.rowsBetween(1, W.unboundedFollowing)))
    rows = rows.withColumn("added_before", F.max(of(~F.col("base"), "end")).over(doc.rowsBetween(W.unboundedPreceding, -1)))
    clear = lambda edge, ok: F.col(edge).isNull() | ok
    free = clear("base_before", F.col("start") >= F.col("base_before")) & clear("base_after", F.col("end") <= F.col("base_after")) & clear("added_before", F.col("start") >= F.col("added_before"))
    return rows.where(F.col("base") | free).select("_r1", "_r2", "kind", "start", "end", "base", "probability")


def report(docs: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, base_spans and spans (arrays of start, rank of the kind, kind, end; sorted) of each row of docs."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))
    s = F.struct("start", rank.alias("rank"), "kind", "end")
    spans = find(docs, min_probability).groupBy("_r1", "_r2").agg(F.sort_array(F.collect_list(F.when(F.col("base"), s))).alias("base_spans"), F.sort_array(F.collect_list(s)).alias("spans"))
    one, two = document_keys()
    rows = docs.select("doc_id", one.alias("_r1"), two.alias("_r2"))
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    return rows.join(spans, ["_r1", "_r2"], "left").select("doc_id", *(F.coalesce(F.col(c), F.array()).cast(kind).alias(c) for c in ("base_spans", "spans")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
