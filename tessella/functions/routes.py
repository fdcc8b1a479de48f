"""Routes and links as column functions."""

from __future__ import annotations

import posixpath
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def route_key(route: Column) -> Column:
    """Without query and fragment, one leading slash, none at the end; blank is the root."""
    path = F.regexp_replace(F.trim(F.coalesce(route, F.lit(""))), r"[?#].*$", "")
    return F.concat(F.lit("/"), F.regexp_replace(path, "^/+|/+$", ""))


def path_of(url: Column) -> Column:
    """Path and query of an address, with or without a host; the root where there is no path."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), "#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def stored_route(route: Column) -> Column:
    """Without query, fragment and slash at the end; the start stays."""
    path = F.regexp_replace(F.trim(F.coalesce(route, F.lit(""))), r"[?#].*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))


def masked_query(url: Column) -> Column:
    """The query's distinct names in order, each with the value %2A; null without a query."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda p: p.contains("=") & ~p.startswith("=")), lambda p: F.substring_index(p, "=", 1))))
    return F.when(query != "", F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("=%2A"))), "&"))


def is_local_target(route: Column) -> Column:
    return F.coalesce(route.rlike("^/(?!/)[^?#]*$"), F.lit(False))


def safe_relative(route: Column, limit: int = 500) -> Column:
    """A path on this host without its query, or null."""
    path = F.regexp_replace(F.trim(route), r"[?#].*$", "")
    return F.when(path.rlike("^/(?!/)") & ~path.contains("://") & (F.length(path) <= limit), path)


def is_allowed(route: Column, allow: tuple[str, ...] = (), block: tuple[str, ...] = ()) -> Column:
    """Blocked prefixes decide first, then allowed ones; without allowed ones all pass. Blank and the root never do."""
    starts = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: route.startswith(p)) if ps else F.lit(False)
    return F.when(route.isNull() | F.trim(route).isin("", "/"), False).when(starts(block), False).otherwise(starts(allow) if allow else F.lit(True))


def internal_link(href: Column, base: Column) -> Column:
    """The path and query that href leads to on base's host; null elsewhere, for other schemes and for bare fragments."""

    @F.pandas_udf(T.StringType())
    def resolve(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
        def one(h: str | None, b: str | None) -> str | None:
            h = (h or "").strip()
            if not h or h.startswith("#") or h.lower().startswith(("javascript:", "mailto:", "tel:")):
                return None
            try:
                home, to = urlsplit(b or ""), urlsplit(urljoin(b or "", h))
            except ValueError:
                return None
            if to.scheme not in ("", "http", "https") or (to.netloc and to.netloc.lower() != home.netloc.lower()):
                return None
            path = posixpath.normpath(to.path) if to.path else "/"
            path = "/" + path.lstrip("/")
            return f"{path}?{to.query}" if to.query else path

        return pd.Series([one(h, b) for h, b in zip(hrefs, bases, strict=True)], dtype=object)

    return resolve(href, base)


def ancestors(route: Column) -> Column:
    """The route and every route above it, root excluded: what a longest-prefix join can equal."""
    parts = F.split(F.regexp_replace(route, "^/|/$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def title_from(route: Column) -> Column:
    """The last segment, decoded and made readable; a plus sign stays."""
    last = F.element_at(F.split(F.regexp_replace(route, "/+$", ""), "/"), -1)
    return F.trim(F.translate(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last), "-_", "  "))
