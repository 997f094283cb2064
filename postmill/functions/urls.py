"""URL scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.dates import bind

# Query parameters that only track, by prefix.
TRACKING = ("utm_", "fbclid", "gclid", "msclkid", "_ga", "ref", "referrer", "source", "campaign")


def canonical(url: Column, keep_fragment: bool = False) -> Column:
    """Posting key: no query, no fragment (unless kept), no trailing slashes."""
    bare = F.substring_index(url, "?", 1)
    bare = bare if keep_fragment else F.substring_index(bare, "#", 1)
    return F.rtrim(bare, F.lit("/"))


def vacancy_key(url: Column) -> Column:
    """No fragment, no trailing slashes, lower case."""
    return F.lower(F.rtrim(F.substring_index(url, "#", 1), F.lit("/")))


def host(url: Column) -> Column:
    """Host and port, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def registrable(name: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(name, ".", -2)


def path(url: Column) -> Column:
    """Path with neither query nor fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def path_shape(url: Column, depth: int = 4) -> Column:
    """The first path segments."""
    return F.concat(F.lit("/"), F.array_join(F.slice(segments(url), 1, depth), "/"))


def unpaged(url: Column) -> Column:
    """Path without its /page/N part."""
    return F.regexp_replace(path(url), r"/page/\d+(?=/|$)", "")


def page_number(url: Column) -> Column:
    """Page number that a URL names, null without one."""
    by_query = F.regexp_extract(url, r"[?&](?:page|p|offset|start)=(\d+)", 1)
    by_path = F.regexp_extract(url, r"/page/(\d+)(?:/|\?|#|$)", 1)
    return F.coalesce(F.nullif(by_query, F.lit("")).try_cast("int"), F.nullif(by_path, F.lit("")).try_cast("int"))


def url_pattern(url: Column) -> Column:
    """Path in which numbers and segments of over thirty characters are ``*``."""
    part = lambda s: F.when(s.rlike(r"^\d+$") | (F.length(s) > 30), F.lit("*")).otherwise(s)
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(url), part), "/"))


def absolute(url: Column, base: Column) -> Column:
    """A link's address as seen from the page at ``base``, without fragment."""
    scheme = F.regexp_extract(base, r"^([A-Za-z]+):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)

    def seen(raw: Column) -> Column:
        return (
            F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
            .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
            .when(raw.startswith("/"), F.concat(root, raw))
            .when(raw.startswith("?"), F.concat(root, path(base), raw))
            .when(raw == "", F.substring_index(base, "#", 1))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), raw))
        )

    return bind(F.substring_index(F.trim(url), "#", 1), seen)


def resolved(url: Column, base: Column) -> Column:
    """A link's address as seen from the page at ``base``, its fragment kept."""
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(absolute(url, base), fragment)


def normalise(url: Column, base: Column) -> Column:
    """Absolute http(s) URL: lower-case host, no fragment, no tracking
    parameters, no trailing slash; empty where it is none."""
    tracks = lambda kv: F.lower(F.trim(F.substring_index(kv, "=", 1))).rlike("^(" + "|".join(TRACKING) + ")")

    def query(whole: Column) -> Column:
        kept = F.filter(F.split(F.regexp_extract(whole, r"\?(.*)$", 1), "&"), lambda kv: (kv != "") & ~tracks(kv))
        joined = bind(F.array_join(kept, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
        return F.when(whole.contains("?"), joined).otherwise(F.lit(""))

    def clean(whole: Column) -> Column:
        bare = bind(F.rtrim(path(whole), F.lit("/")), lambda p: F.when(p == "", F.lit("/")).otherwise(p))
        return F.concat(F.lower(F.regexp_extract(whole, r"^([A-Za-z]+)://", 1)), F.lit("://"), host(whole), bare, query(whole))

    normal = bind(absolute(url, base), lambda w: F.when(w.rlike(r"(?i)^https?://[^/?#]+"), clean(w)).otherwise(F.lit("")))
    return F.when(url.isNull() | (F.trim(url) == ""), F.lit("")).otherwise(normal)


def unwrap_redirect(url: Column) -> Column:
    """The target that a search redirect carries in ``uddg``, else the URL."""
    inner = F.regexp_extract(url, r"[?&]uddg=([^&#]+)", 1)
    return F.when(inner != "", F.coalesce(F.try_url_decode(inner), url)).otherwise(url)


def in_scope(url: Column, base_host: Column) -> Column:
    """Is the URL on the wanted host or a host below it?"""
    wanted = F.regexp_replace(F.lower(base_host), r"^www\.", "")
    own = F.regexp_replace(host(url), r"^www\.", "")
    return (own == wanted) | own.endswith(F.concat(F.lit("."), wanted))
