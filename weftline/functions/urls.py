"""Column functions on URLs. A URL is taken apart by one pattern, so a malformed one gives nulls, not errors."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url, k: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, k)


def scheme(url) -> Column:
    return F.lower(_part(url, 1))


def authority(url) -> Column:
    return _part(url, 2)


def host(url) -> Column:
    """Lower-cased host without user and port; '' if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""))


def path(url) -> Column:
    return _part(url, 3)


def query(url) -> Column:
    return _part(url, 4)


def domain(url) -> Column:
    """Host without a leading www. and a trailing dot; a value without a scheme is a host itself."""
    return F.regexp_replace(F.when(host(url) != "", host(url)).otherwise(F.lower(F.regexp_extract(F.trim(url), "^[^/?#:]*", 0))), r"^www\.|\.$", "")


def host_key(url) -> Column:
    """What two URLs of one site share."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path_of(url) -> Column:
    return F.when(path(url) == "", "/").otherwise(path(url))


def start_url(value) -> Column:
    """With https where no scheme is given, without fragment."""
    v = F.trim(value)
    return F.regexp_replace(F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), v).otherwise(F.concat(F.lit("https://"), v)), "#.*$", "")


def crawl_url(url) -> Column:
    """Without query and fragment; the empty path is /."""
    return F.concat(F.when(_part(url, 1) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(authority(url) != "", F.concat(F.lit("//"), authority(url))).otherwise(""), path_of(url))


def comparable_url(url) -> Column:
    """crawl_url with a lower-cased host and without one trailing slash, but for the root."""
    p = F.when(path_of(url) == "/", F.lit("/")).otherwise(F.regexp_replace(path_of(url), "/$", ""))
    return F.concat(F.when(_part(url, 1) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(authority(url) != "", F.concat(F.lit("//"), F.lower(authority(url)))).otherwise(""), p)


def comparable_page(url) -> Column:
    """As comparable_url, but the root has no slash either, and without a host it is ''."""
    u = F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), F.regexp_replace(path(url), "/$", ""))
    return F.when(F.coalesce(host(url), F.lit("")) == "", "").otherwise(u)


def related_host(a, b) -> Column:
    """Equal, or one is a subdomain of the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def is_followed(href) -> Column:
    """Not empty, a fragment, or of a scheme that leads to no page."""
    return (F.trim(href) != "") & ~F.lower(F.trim(href)).rlike("^(#|mailto:|tel:|javascript:|data:)")


def resolve_rooted(base, href) -> Column:
    """The absolute URL of an absolute, //-, /-, ?- or #-reference, all on the JVM; null for what needs the base's folder."""
    h, origin = F.trim(href), F.concat(scheme(base), F.lit("://"), authority(base))
    full = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
    )
    return F.when(is_followed(href), full)


def _settled(p) -> Column:
    """A path without . and .. segments: each .. takes away the segment before it, and one that has none goes."""
    parts = F.split(F.regexp_replace(p, "^/", ""), "/")
    last = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last & (F.size(kept) > 0), "/").otherwise(""))


def resolve(base, href) -> Column:
    """The absolute URL of any reference, on the JVM: one relative to a folder stands after the base's path up to its last slash, and dots in paths are settled."""
    h, origin = F.trim(href), F.concat(scheme(base), F.lit("://"), authority(base))
    p, rest = F.regexp_extract(h, "^[^?#]*", 0), F.regexp_extract(h, "^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(F.when(path(base) == "", "/").otherwise(path(base)), "^.*/", 0)
    rooted = resolve_rooted(base, href)
    near = F.concat(origin, _settled(F.when(h.startswith("/"), p).otherwise(F.concat(folder, p))), rest)
    dotted = h.startswith("/") & ~h.startswith("//") & p.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(is_followed(href), F.when(rooted.isNotNull() & ~dotted, rooted).otherwise(near))


# Parts of paths that don't earn keywords.
EXCLUDED_PATHS = ("/blog/", "/news/", "/privacy", "/terms", "/cookie", "/about", "/team", "/contact")


def is_excluded_page(url) -> Column:
    return F.lower(path(url)).rlike("|".join(EXCLUDED_PATHS))
