"""Descriptions held against their references, by the library and by plain rules over random statements."""

import random
import re

from tessella.operators import grounding as G

STATEMENT = "screen_id int, part string, position int, statement string, refs array<string>"
CHILD = "screen_id int, ref string, kind string, label string, category string, mutative boolean, decision string"
WORDS = [w for ws in G.ACTION_WORDS.values() for w in ws]


def key(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).strip()


def acts(tokens):
    return {a for a, ws in G.ACTION_WORDS.items() if set(tokens) & set(ws)}


def capability(statement, refs, index, plan):
    words, supported, hints = key(statement).split(), set(), plan
    if re.search(r"(?<!\w)(screen|module|field|control|table|column|state|event|transition|evidence):[A-Za-z0-9._-]+", statement, re.I):
        return "canonical_id_in_narrative"
    if len(words) < 3:
        return "insufficient_natural_language"
    if any(r not in index for r in refs):
        return "unknown_reference"
    found = [index[r] for r in refs]
    actions = acts(words)
    if {k["kind"] for k in found} & {"screen", "table", "column"} and (set(words) & {"muestra", "visualiza", "lista"} or {"presenta", "tabla"} <= set(words)):
        actions.add("view")
    if "manage" in actions:
        return "generic_management_action"
    if actions - set(hints):
        return "unsupported_action:" + ",".join(sorted(actions - set(hints)))
    if actions and (set(refs) - set().union(*(hints[a] for a in actions)) or any(not set(refs) & set(hints[a]) for a in actions)):
        return "action_reference_not_permitted"
    tokens = {t for k in found for t in key(f"{k['label'] or ''} {k['category'] or ''} {k['kind']}").split()} - set(G.STOPWORDS)
    for a in ("search", "navigate", "view", *G.MUTATIVE):
        if tokens & set(G.ACTION_WORDS[a]):
            supported.add(a)
    if "search" in supported or {k["kind"] for k in found} & {"screen", "table", "field", "column"}:
        supported.add("view")
    if actions - supported:
        return "unsupported_action:" + ",".join(sorted(actions - supported))
    if "view" in actions and set(words) & set(G.DETAIL) and not tokens & set(G.DETAIL):
        return "unsupported_view_detail_claim"
    if actions & set(G.MUTATIVE):
        near = [k for k in found if k["kind"] in ("control", "event")]
        decisions = {(k["decision"] or "unknown").lower() for k in near}
        if not any(k["mutative"] for k in near):
            return "missing_mutative_evidence"
        if "deny" in decisions:
            return "mutative_policy_denied"
        if "allow" not in decisions and not any(p in key(statement) for p in G.PRUDENT):
            return "mutative_wording_not_prudent"
    if not actions and not (set(words) - set(G.STOPWORDS) - set(WORDS)) & tokens:
        return "semantically_irrelevant_reference"
    return None


def test_random_statements(spark):
    rng = random.Random(4)
    index, plan = {"1": {"kind": "screen", "label": "Pedidos", "category": None, "mutative": None, "decision": None}}, {}
    for i in range(14):
        index[f"c{i}"] = {"kind": rng.choice(["control", "event", "field", "table", "column"]), "label": rng.choice(WORDS + ["detalle", "factura", "cliente"]), "category": rng.choice([None, "tab", "ver"]),
                          "mutative": rng.choice([True, False, None]), "decision": rng.choice(["allow", "deny", "review", None])}
    for a in ("search", "view", "create", "edit", "navigate"):
        plan[a] = rng.sample(list(index), 9)
    pool = WORDS + ["muestra", "presenta", "tabla", "detalle", "factura", "cliente", "la", "una", "x:y", "opción", "relacionada", "con"]
    claims = []
    for i in range(500):
        said = " ".join(rng.sample(pool, rng.choice([2, 3, 3, 4]))) + rng.choice(["", "", "", " presenta una opción", " table:1"])
        claims.append((1, "capability", i, said, rng.sample([*index] * 3 + ["lost"], rng.choice([1, 1, 2]))))
    claims += [(1, "capability", 500, None, None), (1, "purpose", 0, "", None)]
    children = spark.createDataFrame([(1, r, k["kind"], k["label"], k["category"], k["mutative"], k["decision"]) for r, k in index.items() if r != "1"], CHILD)
    screens = spark.createDataFrame([(1, "Pedidos", None, None)], "screen_id int, title string, module_id string, module string")
    hints = spark.createDataFrame([(1, a, refs) for a, refs in plan.items()], "screen_id int, action string, refs array<string>")
    got = {(r.part, r.position): r.error for r in G.checked(spark.createDataFrame(claims, STATEMENT), G.reference_index(screens, children), hints, screens).collect()}
    plain = str.maketrans("ó", "o")
    wrong = [(s, r, got["capability", i], capability(s.translate(plain), r, index, plan)) for _, _, i, s, r in claims[:500] if got["capability", i] != capability(s.translate(plain), r, index, plan)]
    assert not wrong, wrong[:3]
    assert len({(e or "").split(":")[0] for e in got.values()}) >= 9
    assert got["capability", 500] == got["purpose", 0] == "insufficient_natural_language"


def test_nothing_to_check(spark):
    screens = spark.createDataFrame([], "screen_id int, title string, module_id string, module string")
    index = G.reference_index(screens, spark.createDataFrame([], CHILD))
    hints = spark.createDataFrame([], "screen_id int, action string, refs array<string>")
    assert G.first_errors(G.checked(spark.createDataFrame([], STATEMENT), index, hints, screens)).count() == 0
