"""URL expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sha256

#: Query keys that only track.
TRACKING = "utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid"
#: Two-level endings below which a domain is registered.
TWO_LEVEL = ["ac.in", "edu.in", "res.in", "gov.in", "org.in", "co.in", "nic.in", "ac.uk", "edu.au", "gov.uk", "co.uk", "org.uk", "ernet.in"]
#: Endings of documents.
DOCUMENT = "pdf|docx|doc|xlsx|xls|pptx|ppt"
#: Paths and endings that a crawl skips.
SKIP = [
    r"(?i)/logout", r"(?i)/logoff", r"(?i)/login", r"(?i)/signin", r"(?i)gazette.*(?:\.txt|\.pdf|\.csv)(?:$|[?#])", r"(?i)\.(?:txt|csv|log)(?:$|[?#])",
    r"(?i)\.(?:png|jpg|jpeg|gif|svg|ico|bmp|tif|tiff|jfif|webp|psd|ai|eps|raw|cr2|nef|css|js|woff|woff2|ttf|eot|mp4|webm|avi|mp3|wav|ogg|rar|zip|7z|tar|gz|bz2|xz|iso|bin|exe|msi|dmg|apk|dat|xlsm|xltx|xltm|dotx|dotm|potx|potm)(?:$|[?#])",
]
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, n)


def host(url: Column) -> Column:
    """Host of a URL, lower-case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def normalise(url: Column) -> Column:
    """Absolute http(s) URL with lower-case scheme and host, without default port, fragment and tracking keys; else null."""
    scheme, place = F.lower(_part(url, 1)), F.regexp_replace(F.lower(_part(url, 2)), ":(?:80|443)$", "")
    kept = F.filter(F.split(F.substring(_part(url, 4), 2, 2147483647), "&"), lambda kv: (kv != "") & ~F.lower(F.regexp_extract(kv, "^([^=]*)", 1)).rlike(f"^(?:{TRACKING})$"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme.isin("http", "https") & (place != ""), F.concat(scheme, F.lit("://"), place, _part(url, 3), query))


def url_hash(url: Column) -> Column:
    return sha256(url)


def root_domain(url_or_host: Column) -> Column:
    """Registered domain of a URL or host."""
    low = F.lower(F.trim(url_or_host))
    h = F.when(low.contains("://"), host(low)).otherwise(F.regexp_extract(low, "^([^/:]*)", 1))
    h = F.regexp_replace(h, r"^\*\.", "")
    p = F.split(h, r"\.")
    two = F.array_join(F.slice(p, -2, 2), ".")
    return F.when(F.size(p) <= 2, h).when(two.isin(TWO_LEVEL), F.array_join(F.slice(p, -3, 3), ".")).otherwise(two)


def is_allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of a short list of domains, lies below one, or has its registered domain."""
    h = host(url)
    fits = F.lit(False)
    for d in domains:
        d = d.lower().removeprefix("*.")
        fits = fits | (h == d) | h.endswith("." + d) | (root_domain(url) == root_domain(F.lit(d)))
    return F.coalesce((h != "") & fits, F.lit(False))


def is_document(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(_part(low, 3).rlike(rf"\.(?:{DOCUMENT})$") | _part(low, 4).rlike(rf"(?:\.|type=|format=)(?:{DOCUMENT})"), F.lit(False))


def is_skippable(url: Column) -> Column:
    return F.coalesce(F.greatest(*(url.rlike(p) for p in SKIP)), F.lit(True))


def safety(url: Column) -> Column:
    """'ok', or why a URL is not to be fetched. Hosts are judged as written; names are not resolved."""
    h, scheme = host(url), F.lower(_part(url, 1))
    octet = lambda n: F.regexp_extract(h, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", n).try_cast("int")
    a, b = octet(1), octet(2)
    return (
        F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "scheme")
        .when(h == "", "host")
        .when(h.isin("localhost", "127.0.0.1", "[::1]", "0.0.0.0") | (a == 127), "loopback")
        .when((a == 169) & (b == 254) | (a >= 224) | (a == 0), "unroutable")
        .when((a == 10) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168), "private")
        .otherwise("ok")
    )
