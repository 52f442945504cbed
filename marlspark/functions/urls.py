"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import TRACKING_PARAMS

_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"

#: Public suffixes of two labels. Others count as one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "com.br", "co.za", "com.mx", "com.cn")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def host(url: Column) -> Column:
    """Lower-cased, without user and port."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), _PATH, 1)


def _encoded(part: Column) -> Column:
    """Form encoding after decoding: a space is `+`, `~` stands for itself."""
    plain = F.coalesce(F.try_url_decode(part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_string(url: Column, tracking: tuple[str, ...] = TRACKING_PARAMS) -> Column:
    """Parameters but for tracking ones, by key, values of a key in their order, encoded anew."""
    pairs = F.filter(F.split(F.regexp_extract(F.trim(url), _QUERY, 1), "&"), lambda p: p != "")
    entries = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("")).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(entries, lambda e: ~F.lower(e["k"]).isin(*tracking)))
    return F.array_join(F.transform(kept, lambda e: F.concat(_encoded(e["k"]), F.lit("="), _encoded(e["v"]))), "&")


def normalize_url(url: Column, tracking: tuple[str, ...] = TRACKING_PARAMS) -> Column:
    """Canonical form: lower-cased scheme and host, loopback names as one, no default port, user, fragment, tracking parameters or trailing slash. The path's case stays."""
    h = host(url)
    h = F.when(h.isin("localhost", "0.0.0.0", "[::1]", "[::]"), F.lit("127.0.0.1")).otherwise(h)
    p, s = port(url), scheme(url)
    default = ((s == "http") & (p == "80")) | ((s == "https") & (p == "443")) | (p == "")
    place = F.concat(h, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), p)))
    way = path(url)
    way = F.when(way == "/", way).otherwise(F.regexp_replace(way, "/+$", ""))
    way = F.when(way == "", F.lit("/")).otherwise(way)
    q = query_string(url, tracking)
    return F.concat(F.when(s == "", F.lit("")).otherwise(F.concat(s, F.lit("://"))), place, way, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def registrable_domain(url: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The last two labels of the host, three after a suffix of two labels; numbers and single labels as they are."""
    h = F.regexp_replace(host(url), r"\.$", "")
    two = F.substring_index(h, ".", -2)
    return F.when(h.rlike(r"^[\d.]+$"), h).when(two.isin(*suffixes), F.substring_index(h, ".", -3)).otherwise(two)


def url_lane(url: Column) -> Column:
    """`pdf` where the path says so, else `html`."""
    low = F.lower(url)
    last = F.element_at(F.split(low, "/"), -1)
    return F.when(low.endswith(".pdf") | (F.contains(low, F.lit("/pdf")) & (last == "pdf")), "pdf").otherwise("html")


def short_hash(x: Column) -> Column:
    """16 hexadecimal digits of MD5."""
    return F.substring(F.md5(x), 1, 16)
