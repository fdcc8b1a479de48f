"""Titles, headings and links of static HTML, by patterns on the markup. operators.dom reads whole pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import routes, text

_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>"
_LINK = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'


def plain(markup: Column) -> Column:
    """Text of a piece of markup: tags gone, the five basic entities and no-break spaces read."""
    out = F.regexp_replace(markup, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return text.squeeze(out)


def visible(html: Column) -> Column:
    return F.regexp_replace(html, _HIDDEN, " ")


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(visible(html), F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), F.lit(1)), plain)


def links(html: Column) -> Column:
    """array<struct<href, label>> in order."""
    shown = visible(html)
    hrefs, labels = F.regexp_extract_all(shown, F.lit(_LINK), F.lit(1)), F.regexp_extract_all(shown, F.lit(_LINK), F.lit(2))
    return F.zip_with(hrefs, labels, lambda h, l: F.struct(h.alias("href"), plain(l).alias("label")))  # noqa: E741


def screens(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, route, title, headings, links, text): one record a page."""
    path = F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return pages.select(
        F.col(id_col), routes.route_key(path).alias("route"), title(F.col(html)).alias("title"), headings(F.col(html)).alias("headings"), links(F.col(html)).alias("links"), plain(visible(F.col(html))).alias("text"),
    )


def structure(screen: DataFrame) -> DataFrame:
    """Links of each screen, the first of each (label, target), local ones before global ones."""
    every = screen.select("page_id", F.posexplode("links").alias("pos", "link")).select("page_id", "pos", "link.href", "link.label")
    first = F.min(F.struct("pos", "href")).alias("f")
    return every.groupBy("page_id", F.lower("label").alias("label"), routes.stored_route(F.col("href")).alias("target")).agg(first).select("page_id", "label", "target", F.col("f.pos").alias("pos"))
