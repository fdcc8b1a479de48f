"""Removal and detection of personal and business values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let, squeeze

# What counts as sensitive, in the order in which it is removed.
PATTERNS = (
    r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"(?iU)(?<![\w:])(?:[0-9a-f]{1,4}:){2,}[0-9a-f:]{1,39}(?![\w:])",
    r"(?iU)\b(?:bearer\s+)?[A-Za-z0-9_-]{32,}\b",
    r"(?iU)\b(?:token|password|passwd|secret|cookie|session)\s*[:=]\s*\S+",
    r"(?U)\b\d{3}-\d{3}-\d{9}\b",
    r"(?U)(?<!\d)\d{13}(?!\d)",
    r"(?U)(?<!\d)\d{10}(?!\d)",
    r"(?U)(?<![\w.-])\d{7,}(?![\w.-])",
    r"(?iU)(?<!\w)(?:USD\s*)?[$€£]\s*\d[\d.,]*(?!\w)",
    r"(?U)(?<![\w.])\d{1,3}(?:[.,]\d{3})*[.,]\d{2}(?![\w.])",
    r"(?iU)\b\d{1,2}\s+(?:ene|feb|mar|abr|may|jun|jul|ago|sep|sept|oct|nov|dic)(?:\.|iembre|ubre|osto|io|ayo|il|zo|ero)?\s+\d{4}\b",
    r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"(?U)(?<!\w)\+\d(?:[\s().-]*\d){7,14}(?!\w)",
    r"(?U)(?<![\w-])(?:\d[\s.-]*){7,10}(?![\w-])",
    r"(?U)\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\b",
    r"(?U)\b\d{1,2}:\d{2}(?::\d{2})?\b",
    r"(?iU)historial de inicio de sesi[oó]n.*",
)
# What changes from one look at a screen to the next.
VOLATILE = (
    r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b",
    r"(?iU)\b\d{4}-\d{2}-\d{2}\b",
    r"(?iU)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"(?iU)\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\.?)?\b",
    r"(?iU)\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"(?iU)\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b",
    r"(?iU)\b[0-9a-f]{24,}\b",
    r"(?iU)\b\d{6,}\b",
)
# Regions of a screen, and names of properties, that are never kept.
SENSITIVE_REGIONS = ("volatile", "header", "session", "user", "authentication")
FORBIDDEN_KEYS = ("password", "token", "cookie", "authorization", "username", "email", "session")


def sanitised(text: Column, limit: int = 4000) -> Column:
    """struct(clean, detections): hits go in order, each pattern sees what the ones before it left."""
    state = F.array(F.struct(squeeze(F.coalesce(text, F.lit(""))).alias("t"), F.lit(0).alias("n")))
    for pattern in PATTERNS:
        # the lambda names what the last step left, so nothing is evaluated twice; each pattern is a literal, compiled once
        state = F.transform(state, _step(pattern))
    return F.get(F.transform(state, lambda end: F.struct(F.substring(squeeze(end["t"]), 1, limit).alias("clean"), end["n"].alias("detections"))), F.lit(0))


def _step(pattern: str):
    """Hits are counted only where replacing them changed something, so texts without them are read once a pattern."""

    def one(s: Column) -> Column:
        new = F.transform(F.array(F.regexp_replace(s["t"], pattern, " ")), lambda t: F.struct(
            t.alias("t"), (s["n"] + F.when(t == s["t"], 0).otherwise(F.regexp_count(s["t"], F.lit(pattern)))).cast("int").alias("n")))
        return F.get(new, F.lit(0))

    return one


def compiled() -> list[re.Pattern]:
    """PATTERNS for Python code inside of tasks."""
    return [re.compile(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", p)) for p in PATTERNS]


#: Any of PATTERNS, each with its own flags: one expression and one scan where only whether something is there matters.
_ANY = "|".join(re.sub(r"^\(\?(i?)U\)(.*)$", r"(?\1U:\2)", p) for p in PATTERNS)


#: Every hit of PATTERNS holds one of these. Each begins with one class of letters, so a scan for it is quick; one expression of
#: all of them would not be.
_SIGNS = (
    "[@:=$€£]",
    r"(?U)\d(?:[.,/-]\d|(?:[\s.-]*\d){6}|\s+(?i:ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic))",
    r"(?U)\+\d",
    "[^ ]{32}",
    "[hH](?iU:istorial de inicio de sesi)",
)


def is_sensitive(text: Column) -> Column:
    """Whether any of PATTERNS is in the text; they are tried only where it has a sign of one."""
    signed = lambda t: reduce(lambda a, b: a | b, [t.rlike(sign) for sign in _SIGNS])
    return let(F.coalesce(text, F.lit("")), lambda t: signed(t) & t.rlike(_ANY))


def without_volatile(text: Column) -> Column:
    """What changes is masked, repeated masks are one."""
    masked = reduce(lambda t, p: F.regexp_replace(t, p, "<volatile>"), VOLATILE, text)
    return F.regexp_replace(masked, r"<volatile>(?:\s*<volatile>)+", "<volatile>")


def without_number(technical_id: Column) -> Column:
    return F.regexp_replace(technical_id, r"([_-])\d{4,}$", "$1<volatile>")


def safe_text(title: Column, fragments: Column, limit: int = 2000) -> Column:
    """struct(text, exclusions): fragments without sensitive values, each once, as many as fit; one that doesn't fit is
    skipped, not the end. The fold keeps their order."""
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("excluded"))

    def add(state: Column, raw: Column) -> Column:
        return let(sanitised(raw, limit), lambda s: added(state, raw, s))

    def added(state: Column, raw: Column, s: Column) -> Column:
        key = F.lower(s["clean"])
        joined = F.when(state["text"] == "", s["clean"]).otherwise(F.concat(state["text"], F.lit(" | "), s["clean"]))
        out = lambda text, seen, more: F.struct(text.alias("text"), seen.alias("seen"), (state["excluded"] + more).cast("int").alias("excluded"))
        return (
            F.when(squeeze(raw) == "", state)
            .when((s["detections"] > 0) | (s["clean"] == ""), out(state["text"], state["seen"], F.greatest(F.lit(1), s["detections"])))
            .when(F.array_contains(state["seen"], key), state)
            .when(F.length(joined) > limit, out(state["text"], state["seen"], F.lit(1)))
            .otherwise(out(joined, F.concat(state["seen"], F.array(key)), F.lit(0)))
        )

    every = F.transform(F.concat(F.array(title), fragments), lambda x: F.coalesce(x, F.lit("")))
    end = F.aggregate(every, empty, add)
    return F.struct(end["text"].alias("text"), end["excluded"].alias("exclusions"))


def safe_metadata(properties: Column) -> Column:
    """A map of strings without forbidden names and sensitive or long values."""
    return F.map_filter(properties, lambda k, v: ~F.lower(k).isin(*FORBIDDEN_KEYS) & (v.isNull() | ((F.length(v) <= 500) & ~is_sensitive(v))))
