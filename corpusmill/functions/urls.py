"""Scalar functions on URLs. Absolute http(s) URLs stay native; other spellings give null or the input, as each function says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import blank_to_null, let, text, trim

#: Scheme and authority of an absolute http(s) URL.
_HEAD = r"^(?i:https?)://[^/?#]+"
# Path segments that are no tags.
TAG_STOPWORDS = ("en", "www", "index", "html", "php", "cfm", "asp", "aspx", "page", "home")


def _head(url: Column) -> Column:
    """Scheme and authority; '' if not absolute."""
    return F.regexp_extract(url, _HEAD, 0)


def is_absolute(url: Column | str) -> Column:
    return F.coalesce(F.rlike(text(url), F.lit(_HEAD)), F.lit(False))


def canonical(url: Column | str) -> Column:
    """Absolute URL as a browser prints it: scheme and host in lower case, no default port, / as the empty path, . and .. segments resolved, characters that
    no URL has percent-encoded, fragment kept; null if not absolute.
    """
    return let(trim(url), _printed)


def _printed(u: Column) -> Column:
    head = F.regexp_replace(F.lower(_head(u)), r"^(?:(http://[^/]*?):(?:80)?|(https://[^/]*?):(?:443)?)\z", "$1$2")
    rest = F.regexp_replace(F.regexp_replace(u, _HEAD, ""), r"^(?!/)", "/")
    resolved = let(rest, lambda r: F.when(F.rlike(r, F.lit(r"^[^?#]*(?:/(?:\.|%2[eE])|\\)")), _without_dots(r)).otherwise(r))
    return F.concat(blank_to_null(head), let(resolved, encode_path))


def _without_dots(rest: Column) -> Column:
    """Path and what follows it, with back slashes as slashes and the segments . and .. resolved; above the root there is nothing."""
    dots = lambda x: F.regexp_replace(x, "(?i)%2e", ".")
    step = lambda seen, x: F.when(dots(x) == ".", seen).when(dots(x) == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.array_append(seen, x))

    def joined(parts: Column) -> Column:
        ends = dots(F.element_at(parts, -1)).isin(".", "..")
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        return F.concat(F.lit("/"), let(kept, lambda k: F.concat(F.array_join(k, "/"), F.when(ends & (F.size(k) > 0), "/").otherwise(""))))

    path = F.translate(F.regexp_extract(rest, r"^[^?#]*", 0), "\\", "/")
    return F.concat(let(F.slice(F.split(path, "/"), 2, 2**30), joined), F.regexp_extract(rest, r"^[^?#]*(.*)\z", 1))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def normalize_discovered(url: Column | str) -> Column:
    """Without fragment and one final slash, also of the root; null if not absolute."""
    return F.regexp_replace(without_fragment(canonical(url)), r"/\z", "")


def normalize_persisted(url: Column | str) -> Column:
    """Without fragment; one final slash goes unless the path is the root. Input that is no absolute URL stays."""
    return F.coalesce(F.regexp_replace(without_fragment(canonical(url)), r"^([a-z]+://[^/]+/(?!\?|\z).*|[a-z]+://[^/]+/)/\z", "$1"), text(url))


def host(url: Column | str) -> Column:
    """Host name in lower case without port; null if not absolute."""
    return blank_to_null(F.regexp_replace(F.lower(_head(trim(url))), r"^https?://(?:.*@)?|:\d*\z", ""))


def domain_key(url: Column | str) -> Column:
    """Host with dashes for dots; input without a scheme is taken as https."""
    u = trim(url)
    return F.translate(host(F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit("https://"), u))), ".", "-")


def index_domain(key: Column | str) -> Column:
    """Domain back from its key; dashes of the host itself are lost."""
    return F.translate(F.regexp_replace(text(key), "^www-", ""), "-", ".")


def pathname(url: Column | str) -> Column:
    """Path of an absolute URL, / where it is empty; null otherwise."""
    return F.regexp_extract(canonical(url), r"^[a-z]+://[^/]+([^?#]*)", 1)


#: Characters that stand in a URL as they are.
_URL_CHARS = r"^[\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7A\x7C\x7E]*\z"


def encode_path(path: Column) -> Column:
    """Path, and what follows it, with blanks, quotes, brackets, braces and all that is not ASCII percent-encoded."""
    encoded = F.transform(F.split(path, ""), lambda c: F.when(F.rlike(c, F.lit(_URL_CHARS)), c).when(c == " ", "%20").otherwise(F.url_encode(c)))
    return F.when(F.rlike(path, F.lit(_URL_CHARS)), path).otherwise(F.array_join(encoded, ""))


def slug(url: Column | str) -> Column:
    """File name of a page: its path without one slash on either side, dashes for slashes, other marks dropped, at most 120 characters; the query does not count."""
    inner = F.regexp_replace(pathname(url), r"^/|/\z", "")
    flat = F.regexp_replace(F.replace(inner, F.lit("/"), F.lit("-")), "[^a-zA-Z0-9_-]", "")
    return F.coalesce(blank_to_null(F.when(inner == "", F.lit("index")).otherwise(F.substring(flat, 1, 120))), F.lit("page"))


def tags(url: Column | str) -> Column:
    """Up to eight distinct lower-case path segments without extension and common words."""
    cut = F.transform(F.split(pathname(url), "/"), lambda s: trim(F.regexp_replace(s, r"(?i)\.[a-z0-9]+\z", "")))
    kept = F.filter(F.transform(cut, F.lower), lambda s: (F.length(s) > 1) & ~s.isin(*TAG_STOPWORDS))
    return F.coalesce(F.slice(F.array_distinct(kept), 1, 8), F.array().cast("array<string>"))


def page_key(url: Column | str) -> Column:
    """Session id of a page: base64 of its percent-encoded URL without padding."""
    encoded = F.url_encode(text(url))
    for mark, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(mark), F.lit(plain))
    return F.translate(F.base64(F.encode(encoded, "UTF-8")), "=\r\n", "")


def matches_patterns(url: Column | str, includes: str = "", excludes: str = "") -> Column:
    """Comma lists of substrings: one of includes, if there are any, and none of excludes."""
    u = text(url)
    split = lambda p: [x.strip() for x in p.split(",") if x.strip()]
    wanted, banned = F.lit(not split(includes)), F.lit(False)
    for p in split(includes):
        wanted = wanted | F.contains(u, F.lit(p))
    for p in split(excludes):
        banned = banned | F.contains(u, F.lit(p))
    return wanted & ~banned


def same_origin(url: Column | str, origin: Column | str) -> Column:
    """Plain prefix test, so a longer host that begins alike passes too."""
    return F.startswith(text(url), text(origin))


def is_pdf_path(value: Column | str) -> Column:
    return F.rlike(text(value), F.lit(r"(?i)\.pdf(\z|[?#])"))


def pdf_slug(url: Column | str) -> Column:
    """File name of a PDF: last path segment without extension, other characters as dashes, at most 80."""
    base = F.element_at(F.split(pathname(url), "/"), -1)
    flat = F.regexp_replace(F.regexp_replace(base, r"(?i)\.pdf\z", ""), "[^a-zA-Z0-9_-]+", "-")
    return F.coalesce(blank_to_null(F.substring(F.regexp_replace(flat, r"^-|-\z", ""), 1, 80)), F.lit("document"))


def pdf_title(url: Column | str, label: Column) -> Column:
    """Label of a PDF link if it says something, else its file name in words."""
    base = F.element_at(F.split(pathname(url), "/"), -1)
    named = trim(F.regexp_replace(F.regexp_replace(base, r"(?i)\.pdf\z", ""), "[_-]+", " "))
    told = F.when((F.length(label) > 2) & ~is_pdf_path(label), F.substring(label, 1, 120))
    return F.coalesce(told, blank_to_null(named), F.lit("PDF Document"))
