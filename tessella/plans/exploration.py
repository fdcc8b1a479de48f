"""Candidates of screens: parts stand for elements whose properties come from lists, so that every rule is reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import candidates as C
from tessella.operators import policy
from tessella.plans.registry import query
from tessella.session import load

DANGEROUS, SAFE, HOME = ("eliminar", "pagar"), ("ver", "buscar"), "/s0"
_LISTS: dict[str, tuple[int, list]] = {
    "source": (1, ["links", "buttons", "custom_interactives", "custom_interactives", "buttons"]),
    "text": (2, ["Guardar cambios", "Buscar", None, "", "Siguiente", "Cerrar", "Ver  detalle", "Abrir menú", "Expandir fila", "Menu de navegación lateral", "Admin", "Resumen", "x" * 120, "Pagar ya", "Inicio", "Perfil", "Detalles"]),
    "aria_label": (3, [None, None, None, "Abrir calendario", None, "Etiqueta", None]),
    "selector": (1, ["main > div.tab-group", "nav.sidebar > a", "", None, "table > tr:nth-of-type(3) > td", "div.drawer > span", "div.dialog > b", "header > div.user", "ul.paginator > li", "div.row-detail", "mat-row[data-rowindex='7'] > i", "div.collapsable > span", "p > span", "p > i", "div.tree > span", "div.box", "div.row > b.expand"]),
    "tag": (5, [None, "a", "div", "SPAN", "mat-select", "app-item", "span", "button", "div", "i"]),
    "role": (7, [None, "tab", None, "menuitem", "combobox", None, "option", None, "", None, None]),
    "aria_expanded": (11, [None, None, None, "true", "false", None, None]),
    "type": (13, [None, "submit", "button", None, ""]),
    "onclick": (17, [None, "go()"]),
    "region": (3, ["main_content", None, "dialog", "global_navigation", "header", "footer", "volatile", "side"]),
    "within_table": (23, [False, False, False, True, None]),
    "href": (2, [None, "/a", "/b", "", " /a "]),
    "disabled": (31, [False, None, False, False, False, False, True]),
}


def items(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")

    def pick(step: int, values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(k / step) % len(values) + 1).cast("int"))

    none = F.lit(None).cast("string")
    rows = load(spark, sf, "part").select((k % 50).alias("screen"), k.alias("seq"), F.concat(F.lit("/s"), (k % 50).cast("string")).alias("path"), *[pick(*v).alias(n) for n, v in _LISTS.items()])
    return rows.withColumns({"title": F.when(F.col("seq") % 41 == 0, F.lit("Título")).otherwise(none), "placeholder": none, "name": none, "id": F.when(F.col("seq") % 2 == 0, F.lit("id")).otherwise(none)})


def _lit(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def _has(value: str, words) -> str:
    return "(" + " OR ".join(f"contains({value}, {_lit(w)})" for w in words) + ")"


def _words(value: str, words) -> str:
    return f"list_has_any(string_split({value}, ' '), [{', '.join(map(_lit, words))}])"


def _any_of(words) -> str:
    return ", ".join(map(_lit, words))


def _key(v: str) -> str:
    return f"translate(lower(trim(regexp_replace({v}, '\\s+', ' ', 'g'))), 'áéíóúüñ', 'aeiouun')"


_TAB, _TABLE = C.TAB_PATTERN.replace("'", "''"), C.TABLE_PATTERN
_IN_TABLE = "(coalesce(within_table, false) OR regexp_matches({0}, '" + _TABLE + "'))"
_PICKS = ", ".join(f"([{', '.join(map(_lit, v))}])[(p_partkey // {step} % {len(v)} + 1)::INT] AS {n}" for n, (step, v) in _LISTS.items())
_ITEMS = f"""i0 AS (SELECT p_partkey % 50 AS screen, p_partkey AS seq, '/s' || (p_partkey % 50) AS path, {_PICKS}, CASE WHEN p_partkey % 41 = 0 THEN 'Título' END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'id' END AS id FROM part),
i1 AS (SELECT * REPLACE (lower(coalesce(nullif(tag, ''), CASE source WHEN 'links' THEN 'a' WHEN 'buttons' THEN 'button' ELSE '' END)) AS tag, coalesce(region, 'main_content') AS region),
  coalesce(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''), nullif(aria_label, ''), title, id, '') AS label, lower(coalesce(selector, '')) AS sel, lower(coalesce(role, '')) AS rol,
  trim(regexp_extract(coalesce(selector, ''), '[^>]*$')) AS leaf FROM i0),
i2 AS (SELECT *, aria_expanded IS NOT NULL OR {_has("lower(tag || ' ' || leaf)", C.COLLAPSABLE_WORDS)} AS folds, regexp_matches({_key("sel")}, '{_TAB}') AS tabbed FROM i1),
i3 AS (SELECT *, CASE WHEN source = 'links' THEN 'link_navigation' WHEN source = 'buttons' THEN 'button_click' WHEN {_IN_TABLE.format('sel')} AND aria_expanded IS NOT NULL THEN 'expand_row' WHEN aria_expanded IS NOT NULL THEN 'expand_or_collapse'
  WHEN rol = 'tab' OR tabbed THEN 'tab_click' WHEN rol = 'menuitem' THEN 'menu_item_click' WHEN folds THEN 'expand_or_collapse' WHEN {_has("sel", C.NAVIGATION_WORDS)} THEN 'navigation_click' ELSE 'generic_ui_click' END AS action_kind,
  label <> '' AND (starts_with(lower(label), 'menu de navegación') OR starts_with(lower(label), 'menu de navegacion') OR starts_with(lower(label), 'menú de navegación') OR starts_with(lower(label), 'navigation menu') OR length(label) > 100) AS box FROM i2),
i4 AS (SELECT *, [struct_pack(ok := label <> '', w := 2, n := 'has_label'), struct_pack(ok := label <> '' AND length(label) <= 100, w := 1, n := 'label_length_ok'), struct_pack(ok := tag IN ('a', 'button'), w := 2, n := 'native_interactive_tag'),
  struct_pack(ok := rol IN ('button', 'menuitem', 'tab', 'option'), w := 2, n := 'interactive_role'), struct_pack(ok := aria_expanded IS NOT NULL, w := 3, n := 'has_aria_expanded'), struct_pack(ok := coalesce(onclick, '') <> '', w := 3, n := 'has_onclick'),
  struct_pack(ok := {_has("sel", C.NAVIGATION_WORDS)}, w := 2, n := 'navigation_like_selector'), struct_pack(ok := {_has("sel", C.HIGH_VALUE_AREAS)}, w := 3, n := 'high_value_navigation_area'),
  struct_pack(ok := {_has("sel", C.LOW_VALUE_AREAS)}, w := -5, n := 'low_value_header_or_user_area'), struct_pack(ok := lower(label) IN ({_any_of(C.LOW_VALUE_LABELS)}), w := -5, n := 'low_value_user_or_profile_label'),
  struct_pack(ok := contains(tag, '-'), w := 1, n := 'custom_element'), struct_pack(ok := folds, w := 2, n := 'collapsable_like_element'), struct_pack(ok := true, w := 0, n := 'region:' || region), struct_pack(ok := coalesce(selector, '') <> '', w := 1, n := 'has_selector'),
  struct_pack(ok := {_has("lower(label)", DANGEROUS)}, w := -5, n := 'dangerous_text_detected'), struct_pack(ok := {_has("lower(label)", SAFE)}, w := 1, n := 'safe_text_detected'), struct_pack(ok := coalesce(selector, '') = '', w := -5, n := 'missing_selector')] AS signs FROM i3),
i5 AS (SELECT *, CASE WHEN box THEN -10 ELSE list_sum(list_transform(list_filter(signs, lambda x: x.ok), lambda x: x.w)) END::INT AS score,
  CASE WHEN box THEN 'ignored_large_or_generic_container_text' ELSE array_to_string(list_transform(list_filter(signs, lambda x: x.ok), lambda x: x.n), ',') END
  || CASE WHEN source = 'buttons' AND coalesce(type, '') = 'submit' THEN ',submit_button_blocked_by_forms_policy' ELSE '' END AS reasons, NOT box AND {_has("lower(label)", DANGEROUS)} AS danger FROM i4)"""


@query(f"WITH {_ITEMS} SELECT seq, label, action_kind, score, reasons FROM i5")
def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    return C.scored(items(spark, sf), DANGEROUS, SAFE).select("seq", "label", "action_kind", "score", F.array_join("reasons", ",").alias("reasons"))


_COMBINED = "coalesce(label, '') || ' ' || {0} || ' ' || tag || ' ' || coalesce(role, '') || ' ' || coalesce(title, '') || ' ' || coalesce(aria_label, '')"
_CLASSES = f"""{_ITEMS},
k AS (SELECT *, {_key("label")} AS l, {_key("sel")} AS s, {_key("tag")} AS t, {_key("rol")} AS r, {_key(_COMBINED.format("coalesce(selector, '')"))} AS m, {_key(_COMBINED.format("leaf"))} AS own FROM i5),
c AS (SELECT *, CASE WHEN danger OR {_words("l", C.MUTATIVE_WORDS)} THEN 'mutative_action' WHEN source = 'links' THEN 'navigation_link'
  WHEN contains(m, 'navigation-basic') OR contains(m, 'basic-item') OR t = 'a' OR r = 'menuitem' AND NOT contains(t, 'collapsable') THEN 'navigation_link'
  WHEN {_has(f"(l || ' ' || {_key(chr(99) + 'oalesce(aria_label, ' + chr(39) * 2 + ')')} || ' ' || m)", C.DATE_PICKER_WORDS)} THEN 'open_date_picker'
  WHEN {_IN_TABLE.format('s')} AND (aria_expanded IS NOT NULL OR {_has("(l || ' ' || m)", C.ROW_SIGNS)}) THEN 'expand_row' WHEN r = 'tab' OR tabbed THEN 'activate_tab'
  WHEN r IN ('combobox', 'listbox') OR t IN ('select', 'mat-select') THEN CASE WHEN aria_expanded = 'true' THEN 'close_dropdown' ELSE 'open_dropdown' END
  WHEN {_words("l", C.PAGINATION_WORDS)} OR {_has("m", C.PAGINATION_SIGNS)} THEN 'change_pagination' WHEN {_words("l", C.SEARCH_WORDS)} THEN 'submit_search' WHEN type = 'submit' THEN 'mutative_action'
  WHEN aria_expanded = 'true' THEN 'collapse_menu' WHEN aria_expanded IS NOT NULL THEN 'expand_menu' WHEN {_words("l", C.CLOSE_WORDS)} THEN CASE WHEN contains(m, 'drawer') THEN 'close_drawer' ELSE 'close_modal' END
  WHEN contains(m, 'drawer') THEN 'open_drawer' WHEN contains(m, 'dialog') OR contains(m, 'modal') THEN 'open_modal' WHEN folds OR contains(own, 'menu') THEN 'expand_menu' WHEN {_words("l", C.READONLY_WORDS)} THEN 'open_readonly_view'
  WHEN contains(s, 'row') AND (contains(m, 'expand') OR contains(m, 'detail')) THEN 'expand_row' ELSE 'unknown' END AS category FROM k),
p AS (SELECT *, CASE WHEN coalesce(disabled, false) THEN 'element_disabled' WHEN danger OR {_has("lower(label)", DANGEROUS)} THEN 'dangerous_text_or_signal_detected' WHEN category = 'mutative_action' THEN 'event_category_forbidden'
  WHEN type = 'submit' AND category <> 'submit_search' THEN 'submit_blocked_by_forms_policy' WHEN category IN ({_any_of(policy.ALLOWED)}) THEN 'event_category_explicitly_allowed' WHEN category IN ('expand_row', 'unknown') THEN 'event_category_requires_review'
  ELSE 'default_policy_applied' END AS policy_reason FROM c),
d AS (SELECT *, CASE policy_reason WHEN 'event_category_explicitly_allowed' THEN 'allow' WHEN 'event_category_requires_review' THEN 'review' ELSE 'deny' END AS decision,
  CASE policy_reason WHEN 'element_disabled' THEN 'low' WHEN 'dangerous_text_or_signal_detected' THEN 'critical' WHEN 'event_category_explicitly_allowed' THEN 'low' WHEN 'event_category_requires_review' THEN 'medium' ELSE 'high' END AS risk FROM p),
a AS (SELECT *, danger OR decision = 'deny' AS dangerous FROM d)"""


def classes(spark: SparkSession, sf: str) -> DataFrame:
    return C.classified(items(spark, sf), DANGEROUS, SAFE)


@query(f"WITH {_CLASSES} SELECT seq, category, decision, risk, policy_reason, dangerous FROM a")
def candidate_classes(spark: SparkSession, sf: str) -> DataFrame:
    return classes(spark, sf).select("seq", "category", "decision", "risk", "policy_reason", "dangerous")


_TEMPLATE = f"regexp_replace(regexp_replace({_key('sel')}, '\\b(tr|mat-row):nth-of-type\\(\\d+\\)', '\\1:nth-of-type(*)', 'g'), '\\b(tr|mat-row)\\[data-(?:row)?index=[''\"]?\\d+[''\"]?\\]', '\\1[data-rowindex=*]', 'g')"
_KEYS = f"""{_CLASSES},
b AS (SELECT *, nullif(trim(coalesce(href, '')), '') AS h, CASE WHEN {_IN_TABLE.format("coalesce(selector, '')")} THEN 'table::' || category || '::' || region || '::' || l || '::' || {_TEMPLATE}
  WHEN label <> '' AND category IN ('navigation_link', 'activate_tab') THEN 'semantic::' || category || '::' || region || '::' || l WHEN label <> '' AND category IN ('expand_menu', 'collapse_menu') THEN 'semantic::' || category || '::' || region || '::' || label
  WHEN coalesce(selector, '') <> '' THEN 'selector::' || selector WHEN label <> '' THEN 'label::' || l || '::' || tag ELSE 'unknown::' || tag || '::' || source END AS k0 FROM a),
f AS (SELECT *, CASE WHEN category = 'navigation_link' AND h <> min_by(h, seq) FILTER (h IS NOT NULL AND category = 'navigation_link') OVER (PARTITION BY screen, k0) THEN k0 || '::href::' || lower(h) ELSE k0 END AS key FROM b),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY screen, key ORDER BY (h IS NOT NULL) DESC, (label <> '') DESC, CASE source WHEN 'links' THEN 3 WHEN 'buttons' THEN 2 ELSE 1 END DESC, (tag IN ('a', 'button', 'select')) DESC, score DESC, seq) = 1),
e AS (SELECT * FROM u WHERE score >= 3 OR dangerous OR decision = 'review')"""


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return C.deduplicated(classes(spark, sf))


@query(f"WITH {_KEYS} SELECT screen, key, seq FROM u")
def distinct_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf).select("screen", "key", "seq")


_LIMITS, _HOME_LIMITS = {"expand_menu": 1, "open_dropdown": 2, "submit_search": 1}, {"expand_menu": 3}
_RANK = """CASE region WHEN 'dialog' THEN 0 WHEN 'main_content' THEN 1 WHEN 'global_navigation' THEN CASE WHEN path = '/s0' THEN 1 ELSE 4 END WHEN 'header' THEN 5 WHEN 'footer' THEN 6 WHEN 'volatile' THEN 6 ELSE 2 END,
  CASE category WHEN 'activate_tab' THEN 0 WHEN 'open_readonly_view' THEN 1 WHEN 'open_date_picker' THEN 2 WHEN 'open_modal' THEN 3 WHEN 'open_dropdown' THEN 4 WHEN 'submit_search' THEN 5 WHEN 'change_pagination' THEN 6
  WHEN 'expand_menu' THEN 7 WHEN 'close_modal' THEN 7 WHEN 'navigation_link' THEN 8 ELSE 9 END, score DESC, lower(label), seq"""
_PLAN = f"""{_KEYS},
x AS (SELECT *, CASE WHEN coalesce(selector, '') = '' THEN 'missing_selector' WHEN category = 'navigation_link' THEN 'navigation_handled_by_route_crawler' WHEN path <> '/s0' AND region = 'global_navigation' THEN 'global_navigation_outside_home' END AS barred,
  CASE category WHEN 'expand_menu' THEN CASE WHEN path = '/s0' THEN 3 ELSE 1 END WHEN 'open_dropdown' THEN 2 WHEN 'submit_search' THEN 1 ELSE 1000000 END AS quota, row_number() OVER (PARTITION BY screen ORDER BY {_RANK}) AS i FROM e WHERE decision = 'allow' AND NOT dangerous),
y AS (SELECT *, row_number() OVER (PARTITION BY screen, barred IS NULL, category ORDER BY i) AS c FROM x),
z AS (SELECT *, barred IS NULL AND c <= quota AND count(*) FILTER (barred IS NULL AND c <= quota) OVER (PARTITION BY screen ORDER BY i) <= CASE WHEN path = '/s0' THEN 9 ELSE 4 END AS selected FROM y),
w AS (SELECT *, count(*) FILTER (selected) OVER (PARTITION BY screen, barred IS NULL, category) AS taken FROM z),
v AS (SELECT *, CASE WHEN NOT selected THEN coalesce(barred, CASE WHEN least(c - 1, taken) >= quota THEN 'category_budget:' || category ELSE 'state_event_budget' END) END AS excluded_by FROM w)"""


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    return C.explored(C.eligible(kept(spark, sf)), "path", HOME, _LIMITS, _HOME_LIMITS, 4, 9)


@query(f"WITH {_PLAN} SELECT seq, selected, excluded_by FROM v")
def exploration_plan(spark: SparkSession, sf: str) -> DataFrame:
    return chosen(spark, sf).select("seq", "selected", "excluded_by")


@query(f"WITH {_PLAN} SELECT screen, excluded_by AS reason, count(*) AS n FROM v WHERE excluded_by IS NOT NULL GROUP BY ALL")
def exploration_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return C.exclusions(chosen(spark, sf))


@query(f"""
WITH {_PLAN}, r AS (SELECT screen, count(*) AS raw FROM a GROUP BY 1), n AS (SELECT screen, count(*) AS deduplicated FROM u GROUP BY 1),
g AS (SELECT screen, count(*) AS eligible, count(*) FILTER (decision = 'allow' AND NOT dangerous) AS allowed FROM e GROUP BY 1), o AS (SELECT screen, count(*) FILTER (selected) AS selected FROM v GROUP BY 1)
SELECT screen, raw, coalesce(deduplicated, 0) AS deduplicated, coalesce(eligible, 0) AS eligible, coalesce(allowed, 0) AS allowed, coalesce(selected, 0) AS selected, greatest(raw - deduplicated, 0) AS duplicates_removed
FROM r LEFT JOIN n USING (screen) LEFT JOIN g USING (screen) LEFT JOIN o USING (screen)
""")
def candidate_funnel(spark: SparkSession, sf: str) -> DataFrame:
    raw = classes(spark, sf)
    distinct = C.deduplicated(raw)
    return C.funnel(raw, distinct, C.eligible(distinct), chosen(spark, sf))


_AUDIT = "CASE source WHEN 'buttons' THEN 0 WHEN 'links' THEN 1 ELSE 2 END, score DESC, lower(label), seq"


@query(f"""
WITH {_KEYS}, s AS (SELECT 'safe' AS view, screen, seq, row_number() OVER (PARTITION BY screen ORDER BY {_RANK}) AS place FROM e WHERE decision = 'allow' AND NOT dangerous),
r AS (SELECT 'review' AS view, screen, seq, row_number() OVER (PARTITION BY screen ORDER BY {_AUDIT}) AS place FROM e WHERE decision = 'review')
SELECT * FROM s WHERE place <= 3 UNION ALL SELECT * FROM r WHERE place <= 3
""")
def candidate_views(spark: SparkSession, sf: str) -> DataFrame:
    """Each screen's first three safe ones in the order of exploration, and three for review in that of audits."""
    good = C.eligible(kept(spark, sf))
    safe = C.capped(good.where("decision = 'allow' and not dangerous"), C.exploration_order("path", HOME), 3)
    review = C.capped(good.where("decision = 'review'"), C.audit_order(), 3)
    view = lambda df, name: df.select(F.lit(name).alias("view"), "screen", "seq", "place")
    return view(safe, "safe").unionByName(view(review, "review"))


_SCOPE = ("expand_menu",), ("activate_tab", "open_dropdown", "expand_menu", "open_readonly_view")


@query(f"WITH {_PLAN} SELECT category, count(*) AS n, count(DISTINCT screen) AS screens FROM v WHERE selected AND CASE WHEN path = '/s0' THEN category IN ({_any_of(_SCOPE[0])}) ELSE category IN ({_any_of(_SCOPE[1])}) END GROUP BY category")
def event_plan_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What would be tried: selected candidates of the categories in scope, by category."""
    planned = C.in_scope(chosen(spark, sf).where("selected"), "path", HOME, *_SCOPE)
    return planned.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("screen").alias("screens"))


_WALKED = ["", "main > nav.sidebar", "x > div.collapsable"]


@query(f"""
WITH {_CLASSES}, w AS (SELECT *, CASE WHEN seq % 3 = 0 THEN NULL ELSE ([{_any_of(_WALKED)}])[(seq % 3 + 1)::INT] END AS last FROM a),
j AS (SELECT *, list_filter(list_transform(string_split(sel, '>'), lambda x: trim(x)), lambda x: x <> '') AS o, list_filter(list_transform(string_split(coalesce(last, ''), '>'), lambda x: trim(x)), lambda x: x <> '') AS u FROM w)
SELECT seq, category FROM j WHERE sel <> '' AND NOT dangerous AND category <> 'navigation_link' AND action_kind <> 'link_navigation' AND category IN ({_any_of(_SCOPE[1])})
  AND (category NOT IN ('expand_menu', 'collapse_menu') OR last IS NULL OR selector <> last AND (len(o) > len(u) AND o[1:len(u)] = u OR len(list_filter(range(2, least(len(u), len(o) - 1) + 1), lambda n: u[len(u) - n + 1:len(u)] = o[1:n])) > 0))
""")
def state_event_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three elements are met on a way through a menu."""
    walked = F.when(F.col("seq") % 3 != 0, F.array(F.element_at(F.array(*map(F.lit, _WALKED)), (F.col("seq") % 3 + 1).cast("int"))))
    return C.event_scope(classes(spark, sf), F.array(*map(F.lit, _SCOPE[1])), walked).select("seq", "category")


@query(f"""
WITH {_KEYS}, n AS (SELECT screen, count(*) FILTER (source = 'custom_interactives') AS custom, count(*) FILTER (source = 'buttons') AS buttons, count(*) FILTER (source = 'links' AND h IS NOT NULL AND screen % 3 = 0) AS links FROM b GROUP BY screen),
t AS (SELECT screen, count(*) FILTER (decision = 'deny') AS blocked, count(*) FILTER (decision = 'review') AS unclear FROM e GROUP BY screen)
SELECT screen, concat_ws(',', CASE WHEN custom > 0 AND links = 0 THEN 'interactives_without_routes' END, CASE WHEN custom >= 10 THEN 'many_interactives' END, CASE WHEN coalesce(blocked, 0) > 0 THEN 'blocked_actions' END,
  CASE WHEN coalesce(unclear, 0) > 0 THEN 'ambiguous_actions' END, CASE WHEN screen % 2 > 0 AND buttons > 0 AND links = 0 THEN 'depends_on_forms' END) AS reasons FROM n LEFT JOIN t USING (screen)
""")
def uncertain_screens(spark: SparkSession, sf: str) -> DataFrame:
    """Every second screen has inputs, every third one's links count."""
    raw = classes(spark, sf)
    c = F.col
    seen = raw.groupBy("screen").agg(F.count_if(c("source") == "custom_interactives").alias("custom"), F.count_if(c("source") == "buttons").alias("buttons"), F.count_if((c("source") == "links") & (F.trim("href") != "") & (c("screen") % 3 == 0)).alias("links"))
    said = C.eligible(C.deduplicated(raw)).groupBy("screen").agg(F.count_if(c("decision") == "deny").alias("blocked"), F.count_if(c("decision") == "review").alias("unclear"))
    rows = seen.join(said, "screen", "left").na.fill(0)
    return rows.select("screen", F.array_join(C.uncertainty(c("custom"), c("buttons"), c("screen") % 2, c("links"), c("blocked"), c("unclear")), ",").alias("reasons"))
