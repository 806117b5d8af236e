"""URL and path functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
# a host with a port, no scheme: its name has a dot
PORT_ONLY = r"^[^:/?#]*\.[^:/?#]*:[0-9]*$"
SITE_ROOT = r"^([^:/?#]+://[^/?#]*)"
NETLOC = r"^[^:/?#]+://([^/?#]*)"
DOTTED = r"(^|/)\.{1,2}(/|$)"


def netloc(url: Column) -> Column:
    """Host with port and user info: the key of a site."""
    return F.regexp_extract(url, NETLOC, 1)


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, SITE_ROOT, 1)


def _fold_segments(segments: Column, keep_leading_parent: bool) -> Column:
    """Resolve ``.`` and ``..`` in an array of path segments."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        can_pop = F.size(acc) > 0
        if keep_leading_parent:
            can_pop = can_pop & (F.element_at(acc, -1) != "..")
        up = F.when(can_pop, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        up = up.otherwise(F.array_append(acc, "..") if keep_leading_parent else acc)
        return F.when(seg == ".", acc).when(seg == "..", up).otherwise(F.array_append(acc, seg))

    return F.aggregate(segments, empty, step)


def remove_dots(path: Column) -> Column:
    """RFC 3986 dot-segment removal of an absolute path; untouched when there are none."""
    folded = F.array_join(_fold_segments(F.split(F.substring(path, 2, 2147483647), "/", -1), False), "/")
    ends_open = path.rlike(r"/\.{1,2}$")
    fixed = F.concat(F.lit("/"), folded, F.when(ends_open & (folded != ""), "/").otherwise(""))
    return F.when(path.rlike(DOTTED), fixed).otherwise(path)


def absolutise(href: Column, page_url: Column) -> Column:
    """Absolute form of a link, resolved against the site root of its page."""
    root = site_root(page_url)
    has_scheme = href.rlike(SCHEME) & ~href.rlike(PORT_ONLY)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return (
        F.when(has_scheme, href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(page_url, r"^([^:/?#]+:)", 1), href))
        .when(path == "", F.concat(root, href))
        .otherwise(F.concat(root, remove_dots(rooted), tail))
    )


def favicon_url(url: Column) -> Column:
    return F.concat(site_root(url), F.lit("/favicon.ico"))


def file_name(url: Column) -> Column:
    """The text after the last slash."""
    return F.substring_index(url, "/", -1)


def norm_path(path: Column) -> Column:
    """POSIX path normalisation: no empty, ``.`` or resolvable ``..`` segments."""
    lead = F.when(path.rlike(r"^//(?!/)"), "//").when(F.startswith(path, F.lit("/")), "/").otherwise("")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    relative = F.array_join(_fold_segments(segments, True), "/")
    absolute = F.array_join(_fold_segments(segments, False), "/")
    joined = F.concat(lead, F.when(lead == "", relative).otherwise(absolute))
    return F.when(joined == "", ".").otherwise(joined)


def join_path(root: str, path: Column) -> Column:
    """``path`` below ``root``; an absolute path stays as it is."""
    base = root if root.endswith("/") else root + "/"
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base), path))
