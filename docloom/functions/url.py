"""URL columns: normal forms, ids, paths, platforms.  Native expressions except where marked as a pandas UDF."""

from __future__ import annotations

import fnmatch
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def authority(url: Column) -> Column:
    """Host with port and user part, case kept; '' where there is none."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def stripped(text: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def canonical(url: Column) -> Column:
    """The form that ids come from: stripped, lowered, web addresses without trailing slashes."""
    low = F.lower(stripped(url))
    return F.when(low.rlike("^https?://"), F.regexp_replace(low, "/+$", "")).otherwise(low)


def document_id(url: Column) -> Column:
    return F.substring(F.sha2(canonical(url), 256), 1, 12)


def url_hash(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def map_document_id(source: Column) -> Column:
    """The discovery step's own id; unlike ``document_id`` it isn't canonical."""
    return F.concat(F.lit("map_"), F.sha1(source))


def fetch_document_id(source: Column) -> Column:
    return F.substring(F.sha2(source, 256), 1, 16)


def normal_feed(url: Column) -> Column:
    """Crawl and feed form: scheme and host lowered, no trailing slash or fragment, query kept as is."""
    scheme = F.when(_part(url, 1) != "", F.concat(F.lower(_part(url, 1)), F.lit("://"))).otherwise("")
    return F.concat(scheme, F.lower(authority(url)), F.regexp_replace(path(url), "/+$", ""), _part(url, 4))


def normal_map(url: Column) -> Column:
    """Map form: host lowered, everything else kept."""
    scheme = F.when(_part(url, 1) != "", F.concat(_part(url, 1), F.lit("://"))).otherwise("")
    return F.concat(scheme, F.lower(authority(url)), path(url), _part(url, 4), _part(url, 5))


def normal_analytics(url: Column) -> Column:
    """Analytics form: host without any ``www.`` and path without trailing slash."""
    return F.concat(F.replace(authority(url), F.lit("www."), F.lit("")), F.regexp_replace(path(url), "/+$", ""))


_PLAIN = "-._~"
_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")


def normalize_strict(url: str | None) -> str | None:
    """Lower scheme and host, no default port, unreserved escapes decoded, single slashes, sorted query, no fragment."""
    if not url:
        return url
    try:
        s = urlsplit(url)
    except ValueError:
        return url
    if s.scheme.lower() not in ("http", "https"):
        return url
    host = s.netloc.lower()
    host = host.removesuffix(":80" if s.scheme.lower() == "http" else ":443")
    decoded = _ESCAPE.sub(lambda m: c if (c := chr(int(m[1], 16))).isascii() and (c.isalnum() or c in _PLAIN) else m[0], s.path)
    decoded = re.sub("/+", "/", decoded)
    if len(decoded) > 1:
        decoded = decoded.rstrip("/") or "/"
    query = urlencode(sorted(parse_qsl(s.query, keep_blank_values=True)))
    if not decoded and not query:
        decoded = "/"
    return f"{s.scheme.lower()}://{host}{decoded}" + (f"?{query}" if query else "")


@F.pandas_udf(T.StringType())
def normal_strict(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_strict)


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    """Links resolved against their page; null unless the result is a web address."""

    def one(b, x):
        try:
            got = urljoin(b or "", x or "")
        except ValueError:
            return None
        return got if got.startswith(("http://", "https://")) else None

    return pd.Series([one(b, x) for b, x in zip(base, link)])


def domain(url: Column) -> Column:
    return F.lower(authority(url))


def is_internal(url: Column, base: Column) -> Column:
    return domain(url) == domain(base)


def _segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column, base: Column) -> Column:
    """The target's path segments beyond those that it shares with the base from the start."""
    own, other = _segments(url), _segments(base)
    apart = F.filter(F.transform(F.arrays_zip(own.alias("a"), other.alias("b")), lambda x, i: F.when(~x["a"].eqNullSafe(x["b"]), i)), lambda x: x.isNotNull())
    shared = F.least(F.coalesce(F.get(apart, F.lit(0)), F.size(own)), F.size(own))
    return F.size(own) - shared


def content_path(url: Column) -> Column:
    """Where a page's text is kept: host and cleaned path with ``.md``."""
    clean = F.regexp_replace(path(url), "^/+|/+$", "")
    clean = F.regexp_replace(F.when(clean == "", "index").otherwise(clean), r"\.html?$", "")
    clean = F.regexp_replace(F.regexp_replace(clean, "[^A-Za-z0-9_/.-]", "_"), "__+", "_")
    parts = F.filter(F.transform(F.split(clean, "/"), lambda s: F.regexp_replace(s, "^_+|_+$", "")), lambda s: s != "")
    clean = F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise("index")
    return F.concat(F.when(authority(url) == "", "unknown").otherwise(authority(url)), F.lit("/"), clean, F.lit(".md"))


def id_path(doc_id: Column) -> Column:
    """Two levels of hashed folders and the id's last 100 characters, made safe for a file name."""
    h = F.md5(doc_id)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), F.right(F.translate(doc_id, "/:?", "___"), F.lit(100)), F.lit(".md"))


def glob_pattern(glob: str) -> str:
    r"""A Java regular expression for a shell glob: case-sensitive, ``*`` crosses ``/``, and the end is the very end."""
    return fnmatch.translate(glob).replace(r"\Z", r"\z")


def matches_any(column: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | column.rlike("^(?:" + glob_pattern(g) + ")")
    return found


def pattern_specificity(pattern: Column) -> Column:
    return F.length(F.translate(pattern, "*?", ""))


def platform(url: Column) -> Column:
    """The network that an address or a handle belongs to, by substrings; null where none is known."""
    low = F.lower(url)
    found = F.when(low.contains("twitter.com") | low.contains("x.com"), "twitter").when(low.contains("linkedin.com"), "linkedin")
    return found.when(low.contains("threads.net"), "threads").when(low.contains("substack.com"), "substack").when(url.startswith("@"), "twitter")


def item_url(item_id: Column, network: Column) -> Column:
    """An address for an item id; null for other networks."""
    low = F.lower(network)
    twitter = F.when(item_id.rlike(r"^\d+\z"), F.concat(F.lit("https://twitter.com/i/status/"), item_id)).otherwise(F.concat(F.lit("https://twitter.com/"), item_id))
    return F.when(low == "twitter", twitter).when(low == "linkedin", F.concat(F.lit("https://linkedin.com/posts/"), item_id)).when(low == "substack", F.concat(F.lit("https://substack.com/p/"), item_id))


#: Hosts of the network, and first path segments there that are its own pages and no user's name.
NETWORK_HOSTS = ("twitter.com", "www.twitter.com", "mobile.twitter.com", "x.com", "www.x.com", "mobile.x.com")
OWN_PAGES = ("compose", "explore", "hashtag", "home", "i", "intent", "jobs", "login", "logout", "messages", "notifications", "privacy", "search", "settings", "share", "signup", "tos")
#: What may follow the name in a profile's address.
PROFILE_TABS = ("articles", "highlights", "likes", "media", "with_replies")


def tweet_id(url: Column) -> Column:
    """The number of a post's address on the network: ``/<user>/status/<number>``; null for other addresses."""
    parts = _segments(url)
    number = F.get(parts, F.lit(2))
    post = domain(url).isin(*NETWORK_HOSTS) & (F.lower(F.get(parts, F.lit(1))) == "status") & number.rlike("^[0-9]+$")
    return F.when(post, number)


def profile_name(url: Column) -> Column:
    """The user of a profile address on the network: ``/<user>``, with a tab or not; null for other addresses and the network's own pages."""
    parts = _segments(url)
    name, tab = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    profile = domain(url).isin(*NETWORK_HOSTS) & name.rlike("^[A-Za-z0-9_]+$") & ~F.lower(name).isin(*OWN_PAGES)
    return F.when(profile & ((F.size(parts) == 1) | ((F.size(parts) == 2) & F.lower(tab).isin(*PROFILE_TABS))), name)
