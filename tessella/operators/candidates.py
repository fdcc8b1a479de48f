"""Elements of a screen as candidates for exploration: labels, scores, categories, keys, quotas and reports.

Items are rows (screen, seq, source, text, aria_label, title, placeholder, name, id, selector, tag, role, aria_expanded, type,
onclick, region, within_table, href, disabled). source is links, buttons or custom_interactives; seq orders a screen's items.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import policy

# What a label or selector says about an element.
CONTAINER_WORDS = ("menu de navegación", "menu de navegacion", "menú de navegación", "navigation menu")
NAVIGATION_WORDS = ("menu", "nav", "navigation", "sidebar", "drawer", "collapse", "collapsable", "accordion", "tab", "item")
LOW_VALUE_LABELS = ("admin", "administrador", "usuario", "user", "perfil", "profile", "cuenta", "account")
LOW_VALUE_AREAS = ("user", "profile", "avatar", "toolbar", "topbar", "header", "navbar-user", "account", "logout", "signout")
HIGH_VALUE_AREAS = ("vertical-navigation", "side", "sidebar", "drawer", "menu", "navigation-content", "collapsable", "accordion", "tree")
COLLAPSABLE_WORDS = ("collapse", "collapsable", "accordion", "expansion", "tree", "submenu")
SEARCH_WORDS = ("buscar", "consultar", "filtrar", "filtro", "search", "filter")
DATE_PICKER_WORDS = ("calendar", "calendario", "datepicker", "date-picker", "date_picker")
READONLY_WORDS = ("ver", "detalle", "visualizar", "view", "details")
CLOSE_WORDS = ("cerrar", "close")
PAGINATION_WORDS = ("siguiente", "anterior", "primera", "primero", "última", "ultimo", "último", "next", "previous", "prev", "paginator", "pagination")
PAGINATION_SIGNS = ("paginator", "pagination", "page-next", "page-prev")
ROW_SIGNS = ("expand row", "expandir fila", "row detail", "detalle fila")
MUTATIVE_WORDS = (
    "crear", "nuevo", "nueva", "registrar", "guardar", "editar", "modificar", "actualizar", "eliminar", "borrar", "aprobar", "anular",
    "firmar", "emitir", "enviar", "procesar", "confirmar", "pagar", "finalizar", "publicar", "activar", "desactivar", "create", "save",
    "edit", "update", "delete", "approve", "submit", "send", "pay",
)
# Patterns of a tab's and of a table row's selector.
TAB_PATTERN = r"""(?:^|[^a-z0-9])tabs?(?:[^a-z0-9]|$)|mat-tab|tab-group|tab-label|role=['"]?tab"""
TABLE_PATTERN = r"(?:^|[ >.#:\[])(?:table|tbody|thead|tfoot|tr|td|th)(?:$|[ >.#:\[])"
# Which categories and sources go first.
CATEGORY_ORDER = {
    "activate_tab": 0, "open_readonly_view": 1, "open_date_picker": 2, "open_modal": 3, "open_dropdown": 4, "submit_search": 5,
    "change_pagination": 6, "expand_menu": 7, "close_modal": 7, "navigation_link": 8,
}
SOURCE_ORDER = {"buttons": 0, "links": 1, "custom_interactives": 2}
SOURCE_QUALITY = {"links": 3, "buttons": 2, "custom_interactives": 1}


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _any(value: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is a part of value: one pattern, as many calls would make large code."""
    return value.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def _has_word(label: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(label, " "), F.array(*map(F.lit, words)))


def _mapped(value: Column, known: dict, otherwise: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), value), F.lit(otherwise))


def best_label(*columns: Column) -> Column:
    """The first of the columns that holds more than white space, squeezed; else empty."""
    return F.coalesce(*[F.nullif(text.squeeze(c), F.lit("")) for c in columns], F.lit(""))


def leaf(selector: Column) -> Column:
    """The last step of a selector, the element itself: ancestors tell nothing about it."""
    return F.trim(F.substring_index(text.squeeze(_filled(selector)), ">", -1))


def has_tab_semantics(selector: Column) -> Column:
    return text.label_key(_filled(selector)).rlike(TAB_PATTERN)


def in_table(within_table: Column, selector: Column) -> Column:
    return F.coalesce(within_table, F.lit(False)) | _filled(selector).rlike(TABLE_PATTERN)


def is_collapsable(tag: Column, selector: Column, expanded: Column) -> Column:
    return expanded.isNotNull() | _any(F.lower(F.concat_ws(" ", _filled(tag), leaf(selector))), COLLAPSABLE_WORDS)


def action_kind(source: Column, tag: Column, role: Column, selector: Column, expanded: Column, within_table: Column) -> Column:
    """What using an element does, before its label is looked at."""
    low, kind = F.lower(_filled(selector)), F.lower(_filled(role))
    return (
        F.when(source == "links", "link_navigation")
        .when(source == "buttons", "button_click")
        .when(in_table(within_table, low) & expanded.isNotNull(), "expand_row")
        .when(expanded.isNotNull(), "expand_or_collapse")
        .when((kind == "tab") | has_tab_semantics(low), "tab_click")
        .when(kind == "menuitem", "menu_item_click")
        .when(is_collapsable(F.lower(_filled(tag)), low, expanded), "expand_or_collapse")
        .when(_any(low, NAVIGATION_WORDS), "navigation_click")
        .otherwise("generic_ui_click")
    )


def scored(items: DataFrame, dangerous_words: tuple[str, ...] = (), safe_words: tuple[str, ...] = (), longest: int = 100) -> DataFrame:
    """items with label, tag, action_kind, score, reasons and dangerous. Signs add up; a container's text ends it all."""
    c = F.col
    default = F.when(c("source") == "links", "a").when(c("source") == "buttons", "button").otherwise("")
    rows = items.withColumn("label", best_label(*map(c, ("text", "aria_label", "title", "placeholder", "name", "id"))))
    rows = rows.withColumn("tag", F.lower(F.coalesce(F.nullif(c("tag"), F.lit("")), default))).withColumn("region", F.coalesce("region", F.lit("main_content")))
    rows = rows.withColumn("action_kind", action_kind(c("source"), c("tag"), c("role"), c("selector"), c("aria_expanded"), c("within_table")))
    label, low, selector, role = c("label"), F.lower(c("label")), F.lower(_filled(c("selector"))), F.lower(_filled(c("role")))
    here, there = label != "", _filled(c("selector")) != ""
    container = here & (reduce(lambda a, b: a | b, [low.startswith(w) for w in CONTAINER_WORDS]) | (F.length(label) > longest))
    signs = (
        (here, 2, "has_label"), (here & (F.length(label) <= longest), 1, "label_length_ok"), (c("tag").isin("a", "button"), 2, "native_interactive_tag"),
        (role.isin("button", "menuitem", "tab", "option"), 2, "interactive_role"), (c("aria_expanded").isNotNull(), 3, "has_aria_expanded"),
        (_filled(c("onclick")) != "", 3, "has_onclick"), (_any(selector, NAVIGATION_WORDS), 2, "navigation_like_selector"),
        (_any(selector, HIGH_VALUE_AREAS), 3, "high_value_navigation_area"), (_any(selector, LOW_VALUE_AREAS), -5, "low_value_header_or_user_area"),
        (low.isin(*LOW_VALUE_LABELS), -5, "low_value_user_or_profile_label"), (F.contains(c("tag"), F.lit("-")), 1, "custom_element"),
        (is_collapsable(c("tag"), selector, c("aria_expanded")), 2, "collapsable_like_element"), (F.lit(True), 0, None), (there, 1, "has_selector"),
        (_any(low, dangerous_words), -5, "dangerous_text_detected"), (_any(low, safe_words), 1, "safe_text_detected"), (~there, -5, "missing_selector"),
    )
    total = reduce(lambda a, b: a + b, [F.when(holds, weight).otherwise(0) for holds, weight, _ in signs])
    told = F.array_compact(F.array(*[F.when(holds, F.lit(name) if name else F.concat(F.lit("region:"), c("region"))) for holds, _, name in signs]))
    submit = (c("source") == "buttons") & (F.coalesce(c("type"), F.lit("")) == "submit")
    reasons = F.when(container, F.array(F.lit("ignored_large_or_generic_container_text"))).otherwise(told)
    return rows.withColumns({
        "score": F.when(container, -10).otherwise(total),
        "reasons": F.when(submit, F.concat(reasons, F.array(F.lit("submit_button_blocked_by_forms_policy")))).otherwise(reasons),
        "dangerous": ~container & _any(low, dangerous_words),
    })


def category(rows: DataFrame) -> Column:
    """The event that using a scored item is; the first rule that holds decides."""
    c = F.col
    label, selector, tag, role = (text.label_key(_filled(c(k))) for k in ("label", "selector", "tag", "role"))
    squeezed = lambda first: text.label_key(F.concat_ws(" ", _filled(c("label")), first, _filled(c("tag")), _filled(c("role")), _filled(c("title")), _filled(c("aria_label"))))
    combined, local = squeezed(_filled(c("selector"))), squeezed(leaf(c("selector")))
    expanded = F.lower(c("aria_expanded").cast("string"))
    tab = (role == "tab") | has_tab_semantics(c("selector"))
    picker = _any(F.concat_ws(" ", label, text.label_key(_filled(c("aria_label"))), text.label_key(_filled(c("title"))), combined), DATE_PICKER_WORDS)
    row = in_table(c("within_table"), selector) & (c("aria_expanded").isNotNull() | _any(F.concat_ws(" ", label, combined), ROW_SIGNS))
    return (
        F.when(c("dangerous") | _has_word(label, MUTATIVE_WORDS), "mutative_action")
        .when((c("source") == "links") | (c("action_kind") == "link_navigation"), "navigation_link")
        .when(_any(combined, ("navigation-basic", "basic-item")) | (tag == "a") | ((role == "menuitem") & ~F.contains(tag, F.lit("collapsable"))), "navigation_link")
        .when(picker, "open_date_picker")
        .when(row, "expand_row")
        .when(tab, "activate_tab")
        .when((role.isin("combobox", "listbox") | tag.isin("select", "mat-select")) & F.coalesce(expanded == "true", F.lit(False)), "close_dropdown")
        .when(role.isin("combobox", "listbox") | tag.isin("select", "mat-select"), "open_dropdown")
        .when(_has_word(label, PAGINATION_WORDS) | _any(combined, PAGINATION_SIGNS), "change_pagination")
        .when(_has_word(label, SEARCH_WORDS), "submit_search")
        .when(text.label_key(_filled(c("type"))) == "submit", "mutative_action")
        .when(expanded == "true", "collapse_menu")
        .when(expanded.isNotNull(), "expand_menu")
        .when(_has_word(label, CLOSE_WORDS) & F.contains(combined, F.lit("drawer")), "close_drawer")
        .when(_has_word(label, CLOSE_WORDS), "close_modal")
        .when(F.contains(combined, F.lit("drawer")), "open_drawer")
        .when(_any(combined, ("dialog", "modal")), "open_modal")
        .when(is_collapsable(tag, selector, c("aria_expanded")) | F.contains(local, F.lit("menu")), "expand_menu")
        .when(_has_word(label, READONLY_WORDS), "open_readonly_view")
        .when(F.contains(selector, F.lit("row")) & _any(combined, ("expand", "detail")), "expand_row")
        .otherwise("unknown")
    )


def classified(items: DataFrame, dangerous_words: tuple[str, ...] = (), safe_words: tuple[str, ...] = (), longest: int = 100, allow_submit: bool = False, **rules) -> DataFrame:
    """Scored items with category, decision, risk and policy_reason. What the policy denies counts as dangerous."""
    rows = scored(items, dangerous_words, safe_words, longest)
    rows = rows.withColumn("category", category(rows))
    said = policy.decide(F.col("category"), F.col("label"), dangerous_words, F.col("disabled"), _filled(F.col("type")), F.col("dangerous"), allow_submit, **rules)
    rows = rows.withColumn("_p", said)
    return rows.select(*[c for c in rows.columns if c not in ("_p", "dangerous")], "_p.decision", "_p.risk", F.col("_p.reason").alias("policy_reason"), (F.col("dangerous") | (F.col("_p.decision") == "deny")).alias("dangerous"))


def table_template(selector: Column) -> Column:
    """A selector with the numbers of repeated rows left open."""
    one = F.regexp_replace(text.label_key(_filled(selector)), r"\b(tr|mat-row):nth-of-type\(\d+\)", "$1:nth-of-type(*)")
    return F.regexp_replace(one, r"""\b(tr|mat-row)\[data-(?:row)?index=['"]?\d+['"]?\]""", "$1[data-rowindex=*]")


def base_key() -> Column:
    """What makes two candidates of a screen one: rows of a table by template, navigation by label, others by selector."""
    c = F.col
    label = F.when(c("category").isin("expand_menu", "collapse_menu"), text.squeeze(c("label"))).otherwise(text.label_key(c("label")))
    named = (c("label") != "") & c("category").isin("navigation_link", "expand_menu", "collapse_menu", "activate_tab")
    return (
        F.when(in_table(c("within_table"), c("selector")), F.concat_ws("::", F.lit("table"), c("category"), c("region"), text.label_key(c("label")), table_template(c("selector"))))
        .when(named, F.concat_ws("::", F.lit("semantic"), c("category"), c("region"), label))
        .when(_filled(c("selector")) != "", F.concat_ws("::", F.lit("selector"), c("selector")))
        .when(c("label") != "", F.concat_ws("::", F.lit("label"), text.label_key(c("label")), c("tag")))
        .otherwise(F.concat_ws("::", F.lit("unknown"), c("tag"), c("source")))
    )


def deduplicated(rows: DataFrame) -> DataFrame:
    """The best candidate of each key of a screen, with `key`; among equals the first.

    Links of one key that lead elsewhere than the key's first link have keys of their own. An href outranks everything
    else, so the first link with one holds the key, and the order of the rest doesn't matter: one window finds it.
    """
    href = F.nullif(F.trim(_filled(F.col("href"))), F.lit(""))
    rows = rows.withColumn("key", base_key()).withColumn("_h", F.when(F.col("category") == "navigation_link", href))
    first = F.min_by("_h", F.when(F.col("_h").isNotNull(), F.col("seq"))).over(Window.partitionBy("screen", "key"))
    rows = rows.withColumn("_f", first).withColumn("key", F.when(F.col("_h").isNotNull() & (F.col("_h") != F.col("_f")), F.concat_ws("::href::", "key", F.lower("_h"))).otherwise(F.col("key")))
    quality = F.struct(
        href.isNotNull().cast("int"), (F.col("label") != "").cast("int"), _mapped(F.col("source"), SOURCE_QUALITY, 0), F.col("tag").isin("a", "button", "select").cast("int"), "score", -F.col("seq"),
    )
    best = rows.groupBy("screen", "key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("screen", "key", "_h", "_f")]), quality).alias("b"))
    return best.select("screen", "key", "b.*")


def eligible(rows: DataFrame, least: int = 3) -> DataFrame:
    """Worth a look: a good score, or a danger, or a question for a reviewer."""
    return rows.where((F.col("score") >= least) | F.col("dangerous") | (F.col("decision") == "review"))


def audit_order() -> list[Column]:
    return [_mapped(F.col("source"), SOURCE_ORDER, 3), F.desc("score"), F.lower("label"), F.col("seq")]


def exploration_order(path: str, home: str) -> list[Column]:
    region = F.col("region")
    place = (
        F.when(region == "dialog", 0).when(region == "main_content", 1).when(region == "global_navigation", F.when(F.col(path) == home, 1).otherwise(4))
        .when(region == "header", 5).when(region.isin("footer", "volatile"), 6).otherwise(2)
    )
    return [place, _mapped(F.col("category"), CATEGORY_ORDER, 9), F.desc("score"), F.lower("label"), F.col("seq")]


def explored(rows: DataFrame, path: str, home: str, limits: dict[str, int], home_limits: dict[str, int], most: int = 25, home_most: int | None = None, skip_links: bool = True, skip_global: bool = True) -> DataFrame:
    """Allowed candidates with `selected` and `excluded_by`: what rules and quotas of category and screen leave, in order.

    A category over its quota takes no room of the screen. Rows are cut to their category's quota and to the screen's room
    by row numbers, so a screen's order is found once for each.
    """
    at_home = (F.col(path) == home) & F.lit(home != "")
    quota = F.when(at_home, _mapped(F.col("category"), limits | home_limits or {"": 0}, 2**31 - 1)).otherwise(_mapped(F.col("category"), limits or {"": 0}, 2**31 - 1))
    room = F.when(at_home, F.lit(most if home_most is None else home_most)).otherwise(F.lit(most))
    barred = (
        F.when(_filled(F.col("selector")) == "", "missing_selector")
        .when(F.lit(skip_links) & (F.col("category") == "navigation_link"), "navigation_handled_by_route_crawler")
        .when(F.lit(skip_global) & ~at_home & (F.col("region") == "global_navigation"), "global_navigation_outside_home")
    )
    order = exploration_order(path, home)
    rows = rows.where((F.col("decision") == "allow") & ~F.col("dangerous")).withColumn("_b", barred).withColumn("_free", F.col("_b").isNull())
    rows = rows.withColumn("_c", F.row_number().over(Window.partitionBy("screen", "_free", "category").orderBy(*order))).withColumn("_q", quota).withColumn("_room", room)
    inside = F.col("_free") & (F.col("_c") <= F.col("_q"))
    rows = rows.withColumn("_g", F.count(F.when(inside, 1)).over(Window.partitionBy("screen").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("selected", inside & (F.col("_g") <= F.col("_room")))
    taken = F.count(F.when(F.col("selected"), 1)).over(Window.partitionBy("screen", "_free", "category"))
    why = F.when(F.least(F.col("_c") - 1, taken) >= F.col("_q"), F.concat(F.lit("category_budget:"), F.col("category"))).otherwise("state_event_budget")
    return rows.withColumn("excluded_by", F.when(~F.col("selected"), F.coalesce("_b", why))).drop("_b", "_free", "_c", "_q", "_room", "_g")


def capped(rows: DataFrame, order: list[Column], most: int = 80) -> DataFrame:
    """Each screen's first `most` rows, numbered."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("screen").orderBy(*order)).cast("long")).where(F.col("place") <= most)


def funnel(raw: DataFrame, kept: DataFrame, good: DataFrame, chosen: DataFrame) -> DataFrame:
    """How many candidates of each screen every stage leaves: raw, deduplicated, removed, eligible, allowed, selected."""
    count = lambda df, name, *more: df.groupBy("screen").agg(F.count("*").alias(name), *more)
    allowed = F.count_if((F.col("decision") == "allow") & ~F.col("dangerous")).alias("allowed")
    out = count(raw, "raw").join(count(kept, "deduplicated"), "screen", "left").join(count(good, "eligible", allowed), "screen", "left")
    out = out.join(chosen.groupBy("screen").agg(F.count_if("selected").alias("selected")), "screen", "left").na.fill(0)
    return out.withColumn("duplicates_removed", F.greatest(F.col("raw") - F.col("deduplicated"), F.lit(0)))


def exclusions(chosen: DataFrame) -> DataFrame:
    """How often each reason excluded a candidate of a screen."""
    return chosen.where("excluded_by is not null").groupBy("screen", F.col("excluded_by").alias("reason")).agg(F.count("*").alias("n"))


def in_scope(rows: DataFrame, path: str, home: str, home_categories: tuple[str, ...], local_categories: tuple[str, ...]) -> DataFrame:
    """Candidates of the categories that a screen of this route may explore."""
    return rows.where(F.when(F.col(path) == home, F.col("category").isin(*home_categories)).otherwise(F.col("category").isin(*local_categories)))


def segments(selector: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(_filled(selector)), ">"), lambda x: F.trim(x)), lambda x: x != "")


def is_descendant(selector: Column, ancestor: Column) -> Column:
    """Whether a selector goes on from another; it may leave out that one's first steps, two common steps at least."""
    own, above = segments(selector), segments(ancestor)
    most = F.least(F.size(above), F.size(own) - 1)
    within = (F.size(own) > F.size(above)) & (F.slice(own, F.lit(1), F.greatest(F.size(above), F.lit(1))) == above)
    shared = F.exists(F.sequence(F.lit(2), F.greatest(most, F.lit(2))), lambda n: (n <= most) & (F.slice(above, F.greatest(F.size(above) - n + 1, F.lit(1)), n) == F.slice(own, F.lit(1), n)))
    return (F.size(own) > 0) & (F.size(above) > 0) & (within | shared)


def event_scope(rows: DataFrame, categories: Column, walked: Column, skip_links: bool = True) -> DataFrame:
    """Candidates that may be tried in a state: harmless, of its categories (null: of all), and of menus only those that
    weren't walked on the way (walked, an array of their selectors) and lie inside the last one that was."""
    c = F.col
    menu = c("category").isin("expand_menu", "collapse_menu")
    last = F.try_element_at(walked, F.lit(-1))
    fresh = ~F.coalesce(F.array_contains(walked, c("selector")), F.lit(False)) & F.coalesce(is_descendant(c("selector"), last) | (last == ""), F.lit(True))
    link = (c("action_kind") == "link_navigation") | (c("category") == "navigation_link")
    wanted = F.coalesce(F.array_contains(categories, c("category")), F.lit(True))
    return rows.where((_filled(c("selector")) != "") & ~c("dangerous") & ~(F.lit(skip_links) & link) & wanted & (~menu | fresh))


def uncertainty(custom: Column, buttons: Column, inputs: Column, links: Column, blocked: Column, unclear: Column) -> Column:
    """Why a screen needs a person, in order, from counts of its elements, its links and its candidates' decisions."""
    return policy.reasons(
        interactives_without_routes=(custom > 0) & (links == 0), many_interactives=custom >= 10, blocked_actions=blocked > 0,
        ambiguous_actions=unclear > 0, depends_on_forms=(inputs > 0) & (buttons > 0) & (links == 0),
    )
