"""HTML expressions on columns: text, title, links, images, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import urls as U

#: Words that make an image a banner.
BANNER = "banner|slider|carousel|notice|hero|poster|announcement"


#: Where a link's target stands: links, frames, objects, and calls that open one.
LINKS = [
    r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']",
    r"(?i)<(?:iframe|embed)\b[^>]*\bsrc\s*=\s*[\"']([^\"']*)[\"']",
    r"(?i)<object\b[^>]*\bdata\s*=\s*[\"']([^\"']*)[\"']",
    r"(?i)\bonclick\s*=\s*[\"'][^\"']*?(?:open|href)[^'\"(=]*[(=]\s*(?:&quot;|')?([^'\"&)]+)",
]
#: Entities that are put back.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Targets that are no page.
NOT_FOLLOWED = "(?i)^(?:mailto|tel|javascript|data|whatsapp|callto):|^#|^$"


def title(html: Column) -> Column:
    """Title, else the first heading; null without either."""
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    h = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.when(F.trim(t) != "", F.trim(t)).when(F.trim(h) != "", F.trim(h))


def text(html: Column) -> Column:
    """Visible text: main or article if there is one, without scripts, styles and page furniture, blanks collapsed."""
    main = F.regexp_extract(html, r"(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>", 1)
    body = F.when(main != "", main).otherwise(html)
    for tag in ("script", "style", "nav", "header", "footer", "noscript"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return _plain(body)


def absolute(base: Column, href: Column) -> Column:
    """href resolved against the page's URL: absolute, scheme-relative, rooted, or relative to the page's folder."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*)", 1), "[^/]*$", "")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))


def links(pages: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """page_id, link and kind (page or document) of the distinct followable links of pages (page_id, url, html)."""
    found = F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in LINKS))
    x = pages.select("page_id", "url", F.explode(F.array_distinct(found)).alias("href")).where(~F.col("href").rlike(NOT_FOLLOWED))
    x = x.select("page_id", U.normalise(absolute(F.col("url"), F.col("href"))).alias("link")).where("link is not null").distinct()
    kind = F.when(U.is_document(F.col("link")), "document").otherwise("page")
    x = x.select("page_id", "link", kind.alias("kind")).where((F.col("kind") == "document") | ~U.is_skippable(F.col("link")))
    return x.where(U.is_allowed(F.col("link"), domains)) if domains else x


def banners(pages: DataFrame, most: int = 5) -> DataFrame:
    """page_id, src and rank of the first banner images of a page; logos and icons are none."""
    x = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))).alias("pos", "tag"))
    x = x.where(F.col("tag").rlike(f"(?i){BANNER}") & ~F.col("tag").rlike("(?i)logo|icon"))
    x = x.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("pos")) - 1).where(F.col("rank") < most)
    return x.select("page_id", F.regexp_extract("tag", r"(?i)\bsrc\s*=\s*[\"']([^\"']*)", 1).alias("src"), "rank")


#: What html is cut into: comments, scripts and styles, tags, and the text between them.
TOKEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|[^<]+|<"
#: Marks of calendars, menus and editors in a table's id or class, of filter rows in a row's class, and the text of a calendar.
NO_DATA = "calendar|datepicker|dxecalendar|dxcalendar|radcalendar|rcmaintable|dxm-|radmenu|dxfreditor|_ddd_c|_ddd_l|dxgvloadingpanel|dxse"
FILTER_ROW = "dxfreditor|dxgvfilterrow"
WEEK = "sun mon tue wed thu fri sat"


def _attributes(token: Column) -> Column:
    """id and class of a tag, in lower case."""
    value = lambda name: F.regexp_extract(token, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.lower(F.concat(value("id"), F.lit(" "), value("class")))


def tables(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, cells and links (targets, resolved against url if there is one, of its cells) of the rows of data tables of pages
    (page_id, url, html): two rows or more, no calendars, menus or filter rows. Tables are numbered as they open, rows within their table.

    Html is a stream of tags and texts. Opening and closing tags of tables make a depth, which stray closing ones cannot bring below
    none, and what stands at a depth belongs to the last table that opened there: a stack, as windows. So a table within a cell is a
    table of its own and its text is not the cell's."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url")
    x = pages.select("page_id", url, F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    x = x.withColumn("tag", F.lower(F.regexp_extract("token", r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1)))
    page, so_far = W.partitionBy("page_id").orderBy("pos"), (W.unboundedPreceding, 0)
    x = x.withColumn("step", F.when(F.col("tag") == "table", 1).when(F.col("tag") == "/table", -1).otherwise(0))
    x = x.withColumn("sum", F.sum("step").over(page.rowsBetween(*so_far)))
    x = x.withColumn("depth", F.col("sum") - F.min(F.least(F.col("sum"), F.lit(0))).over(page.rowsBetween(*so_far))).where("depth > 0 and tag <> '/table'")
    x = x.withColumn("table", F.max(F.when(F.col("tag") == "table", F.col("pos"))).over(W.partitionBy("page_id", "depth").orderBy("pos").rowsBetween(*so_far)))
    within = W.partitionBy("page_id", "table").orderBy("pos").rowsBetween(*so_far)
    x = x.withColumn("row", F.count_if(F.col("tag") == "tr").over(within)).withColumn("cell", F.count_if(F.col("tag").isin("td", "th")).over(within))
    x = x.withColumn("kind", F.first(F.when(F.col("tag") == "table", _attributes(F.col("token"))), ignorenulls=True).over(W.partitionBy("page_id", "table").orderBy("pos").rowsBetween(*so_far))).where(~F.col("kind").rlike(NO_DATA) & (F.col("row") > 0))
    said = F.when(~F.startswith("token", F.lit("<")), F.col("token"))
    href = F.when(F.col("tag") == "a", F.regexp_extract("token", r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1))
    followed = F.when((href != "") & ~href.rlike("(?i)^javascript:"), absolute(F.col("url"), F.trim(href)))
    by_pos = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("pos", c.alias("v"))))), lambda y: y["v"])
    cells = x.groupBy("page_id", "table", "row", "cell").agg(F.array_join(by_pos(said), " ").alias("said"), by_pos(F.when(F.col("cell") > 0, followed)).alias("links"), F.max(F.when(F.col("tag") == "tr", _attributes(F.col("token")))).alias("of_row"), F.count_if(F.col("tag").isin("td", "th")).alias("is_cell"))
    one = F.when(F.col("is_cell") > 0, F.struct("cell", _plain(F.col("said")).alias("v"), "links"))
    rows = cells.groupBy("page_id", "table", "row").agg(F.array_sort(F.collect_list(one)).alias("all"), F.max("of_row").alias("of_row"))
    rows = rows.select("page_id", "table", "row", F.transform("all", lambda c: c["v"]).alias("cells"), F.flatten(F.transform("all", lambda c: c["links"])).alias("links"), "of_row")
    whole = W.partitionBy("page_id", "table")
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("week", F.max(F.contains(F.lower(F.array_join("cells", " ")), F.lit(WEEK))).over(whole))
    rows = rows.where((F.col("n") >= 2) & ~F.col("week") & ~F.coalesce(F.col("of_row"), F.lit("")).rlike(FILTER_ROW) & (F.array_join("cells", "") != ""))
    number = F.dense_rank().over(W.partitionBy("page_id").orderBy("table")) - 1
    return rows.select("page_id", number.alias("table_no"), (F.col("row") - 1).alias("row_no"), "cells", F.array_distinct("links").alias("links"))


def _plain(c: Column) -> Column:
    """Text with entities as characters and blanks collapsed."""
    for entity, to in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(c, r"\s+", " "))
