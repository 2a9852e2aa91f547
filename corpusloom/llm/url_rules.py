"""URL filters: fixed host and path rules, and association rules mined from labelled URLs.

URLs become token sets (host labels, path parts, file extension, query keys; runs of digits count as one token). Labelled
URLs are transactions with their label as one more item; Spark's FP-growth finds frequent item sets. Rules that lead
to the block label are pruned by support (a share and a number of pages), by confidence and by how far it lies above the
share of all pages, and dropped where a shorter one is at least as sure. An inverted index from token to rule finds the
rules whose tokens a URL has all of.

A page's label is that of the document whose number ends its path: low quality or toxic means block. A page that a
fixed rule fits keeps that verdict; else it is blocked if a mined rule fits, and allowed otherwise.

Defined cases: a null url, or one without ``://``, has an empty host and path, no tokens and the verdict allow;
very long URLs are taken with all their tokens, whole; repeated rows are judged alike; of mined rules that tie in
confidence the one whose tokens come last in order is named, and the verdict is the same; empty tables or no labels give no
mined rules. Only page_id and url are read, whatever other columns there are."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (verdict, host and path): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Labelled pages with a rule's tokens and the block label, at least; standard errors above the share of all pages.
MIN_PAGES = 20
MIN_SIGMAS = 4.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, as a struct of rule and verdict; null if none fits. rules: a short list."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None))


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    u = F.coalesce(url, F.lit(""))
    h, p = host(url), F.lower(path(url))
    query = F.regexp_extract(u, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    numbered = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    found = F.concat(
        F.transform(F.split(h, r"\."), lambda x: F.concat(F.lit("host:"), numbered(x))),
        F.transform(F.split(p, "/"), lambda x: F.concat(F.lit("path:"), numbered(x))),
        F.array(F.concat(F.lit("ext:"), F.regexp_extract(p, r"\.([a-z0-9]+)$", 1))),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("key:"), F.regexp_extract(x, "^([^=]*)", 1))),
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.substring_index(x, ":", -1).isin("", "0"))))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES, min_sigmas: float = MIN_SIGMAS) -> DataFrame:
    """rule_id, antecedent (array of tokens), confidence and support of the rules that block. A rule stands on ``min_support`` of
    the labelled pages and ``min_pages`` of them at least, and its share of blocked pages is ``min_sigmas`` standard errors above
    that of all pages, so that a token of few pages, or one that says nothing, makes no rule."""
    marked = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    marked = marked.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})[^0-9/]*/?$", 1)
    seen = pages.select(number.try_cast("bigint").alias("doc_id"), tokens(F.col("url")).alias("tokens")).where("doc_id is not null")
    baskets = seen.join(marked, "doc_id").select(F.concat("tokens", F.array(F.when(F.coalesce("bad", F.lit(0)) == 1, "=block").otherwise("=allow"))).alias("items"))
    baskets = materialise(baskets, "url-baskets")
    kinds = "antecedent array<string>, confidence double, support double"
    n, bad = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", "=block"))).first()
    if not bad:
        return baskets.sparkSession.createDataFrame([], f"rule_id long, {kinds}")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_pages / n)), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", "=block") & ~F.array_contains("antecedent", "=allow"))
    share, pages_of = bad / n, F.col("support") * n / F.col("confidence")
    rules = rules.where(F.col("confidence") >= share + min_sigmas * F.sqrt(share * (1 - share) / pages_of))
    rules = materialise(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "url-rules")
    return shortest(rules).select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "confidence", "support")


def shortest(rules: DataFrame) -> DataFrame:
    """rules (antecedent, confidence, support) without those of which a shorter part is a rule that is at least as sure.

    By size: a rule looks up the sets that lack one of its tokens, each with the highest confidence of a rule within it, so
    a rule makes one row for each of its tokens and meets no other rule that only shares one."""
    sizes = sorted(r[0] for r in rules.select(F.size("antecedent")).distinct().collect())  # at most the tokens of a URL
    if len(sizes) < 2:
        return rules
    known = rules.where(F.size("antecedent") == sizes[0]).select("antecedent", "confidence", "support", F.lit(-1.0).alias("within"))
    out = known
    for size in range(sizes[0] + 1, sizes[-1] + 1):
        now = rules.where(F.size("antecedent") == size)
        part = now.select("antecedent", F.explode("antecedent").alias("token")).select("antecedent", F.array_except("antecedent", F.array("token")).alias("less"))
        best = known.select(F.col("antecedent").alias("less"), F.greatest("confidence", "within").alias("sure"))
        held = part.join(best, "less").groupBy("antecedent").agg(F.max("sure").alias("within"))
        known = materialise(now.join(held, "antecedent", "left").withColumn("within", F.coalesce("within", F.lit(-1.0))), "url-rules")
        out = out.unionByName(known)
    return materialise(out.where("within < confidence").drop("within"), "url-rules")


def fitting(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """key of each row of sets (key, tokens) that has all tokens of a rule, with the surest rule's tokens and confidence."""
    index = rules.select("rule_id", "antecedent", "confidence", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    hits = sets.select("key", F.explode("tokens").alias("token")).join(index, "token")
    whole = hits.groupBy("key", "rule_id").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("antecedent").alias("antecedent"), F.first("confidence").alias("confidence")).where("n = need")
    return whole.groupBy("key").agg(F.max(F.struct("confidence", "antecedent")).alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (tokens of the surest mined rule, if any) of each row of pages."""
    mined = mine(pages, labels, min_support, min_confidence, min_pages)
    p = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    p = p.withColumn("key", F.array_join("tokens", "\x01"))
    found = fitting(p.select("key", "tokens").distinct(), mined)
    p = p.join(materialise(found, "url-hits"), "key", "left").withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined").isNotNull(), "block"), F.lit("allow"))
    return p.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.array_join("mined.antecedent", " ").alias("mined"))
