"""URL handling as column expressions; lenient where parse_url would raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME, 1))


def host(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def origin(u: Column) -> Column:
    return F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def segments(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda x: x != "")


def _remove_dots(p: Column) -> Column:
    """Resolve . and .. in a path that starts with '/'."""
    pieces = F.split(p, "/")
    parts = F.slice(pieces, F.lit(2), F.size(pieces))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda acc, x: F.when(x == ".", acc)
        .when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(x == "..", acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(p.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when((tail == "/") & ~joined.endswith("/"), F.concat(joined, tail)).otherwise(joined)


def _clean(url: Column) -> Column:
    """Dot segments out of an absolute URL, only where there are any."""
    p = path(url)
    rest = F.regexp_extract(url, r"([?#].*)$", 1)
    dotted = p.rlike(r"/\.{1,2}(/|$)")
    return F.when(dotted, F.concat(origin(url), _remove_dots(p), rest)).otherwise(url)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on page `base`."""
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    base_dir = F.when(path(base) == "", F.concat(origin(base), F.lit("/"))).otherwise(
        F.regexp_extract(page, r"^(.*/)[^/]*$", 1)
    )
    no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    return (
        F.when(ref == "", no_fragment)
        .when(ref.rlike(SCHEME), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), _clean(F.concat(origin(base), ref)))
        .when(ref.startswith("?"), F.concat(page, ref))
        .when(ref.startswith("#"), F.concat(no_fragment, ref))
        .otherwise(_clean(F.concat(base_dir, ref)))
    )


def is_internal(link_host: Column, site_host: Column) -> Column:
    """The site itself, its www twin, or any sub-domain of it."""
    base = F.replace(site_host, F.lit("www."), F.lit(""))
    return (link_host != "") & (
        (link_host == base)
        | (link_host == F.concat(F.lit("www."), base))
        | (link_host == site_host)
        | F.endswith(link_host, F.concat(F.lit("."), base))
    )


def domain_of(u: Column) -> Column:
    """Scheme dropped, cut at the first '/'."""
    return F.regexp_extract(F.regexp_replace(u, r"^https?://", ""), r"^([^/]*)", 1)


def bare_domain(d: Column) -> Column:
    return F.regexp_replace(F.lower(d), r"^www\.", "")


def normalize_path(p: Column) -> Column:
    """Id-like path segments (UUID or all digits) become {id}."""
    return F.array_join(
        F.transform(
            F.split(p, "/"),
            lambda s: F.when(
                ((F.length(s) == 36) & s.contains("-")) | s.rlike(r"^\p{N}+$"), F.lit("{id}")
            ).otherwise(s),
        ),
        "/",
    )


def storage_key(u: Column) -> Column:
    return F.left(F.md5(u), F.lit(12))
