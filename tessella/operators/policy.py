"""What may be done with an element of a screen: categories, scores, decisions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text

# What a policy allows, asks about and forbids unless told otherwise, by category of event.
ALLOWED = ("navigation_link", "expand_menu", "collapse_menu", "activate_tab", "open_readonly_view", "open_modal", "open_date_picker", "close_modal", "open_drawer", "close_drawer", "open_dropdown", "close_dropdown", "submit_search", "change_pagination")
REVIEW = ("expand_row", "unknown")
FORBIDDEN = ("mutative_action",)
# Regions that are the same on every screen.
GLOBAL_REGIONS = ("global_navigation", "header", "footer", "volatile")


def contains_any(label: Column, words: tuple[str, ...]) -> Column:
    """Substrings count, so a word inside another one does too."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(label), w)) if words else F.lit(False)


def is_local(region: Column) -> Column:
    """An unknown region is local."""
    return ~F.coalesce(region.isin(*GLOBAL_REGIONS), F.lit(False))


def decide(category: Column, label: Column, dangerous_words: tuple[str, ...], disabled: Column, kind: Column, dangerous: Column, allow_submit: bool = False, allowed=ALLOWED, review=REVIEW, forbidden=FORBIDDEN, default: str = "deny") -> Column:
    """struct(decision, risk, reason). The first rule that holds decides."""
    say = lambda d, r, why: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("risk"), F.lit(why).alias("reason"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(disabled), say("deny", "low", "element_disabled"))
        .when(no(dangerous) | no(contains_any(label, dangerous_words)), say("deny", "critical", "dangerous_text_or_signal_detected"))
        .when(category.isin(*forbidden), say("deny", "high", "event_category_forbidden"))
        .when((F.lower(kind) == "submit") & F.lit(not allow_submit) & (category != "submit_search"), say("deny", "high", "submit_blocked_by_forms_policy"))
        .when(category.isin(*allowed), say("allow", "low", "event_category_explicitly_allowed"))
        .when(category.isin(*review), say("review", "medium", "event_category_requires_review"))
        .otherwise(say(default, "high" if default == "deny" else "medium", "default_policy_applied"))
    )


def unavailable(main_text: Column, whole_text: Column, patterns: tuple[str, ...], least: int = 1) -> Column:
    """Whether a screen has at least `least` of the signs of an error screen: in its main text, or in its whole text where
    that is blank. Case and accents don't count, punctuation does; blank patterns are no signs."""
    plain = ("".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c)) for x in patterns)
    signs = [F.contains(text.availability_key(F.coalesce(F.nullif(F.trim(main_text), F.lit("")), whole_text, F.lit(""))), F.lit(" ".join(p.split()))).cast("int") for p in plain if p.strip()]
    return sum(signs[1:], signs[0]) >= least if signs else F.lit(False)


def reasons(**rules: Column) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
