from pyspark.sql import functions as F

from tessella.operators import audits, subsets

ITEM = "canonical_id string, entity_type string, screen_id string, parent_id string, region string, label string, position int, target_route string, source_state_id string, target_state_id string, control_id string, link_id string, event_id string"


def items(spark):
    row = lambda i, kind, screen=None, **more: {"canonical_id": i, "entity_type": kind, "screen_id": screen} | more
    rows = [
        row("e", "erp"), row("m", "module", parent_id="e"), row("s1", "screen", parent_id="m"), row("s2", "screen", parent_id="m"), row("u1", "state", "s1", position=1), row("u2", "state", "s1", position=0), row("u9", "state", "s2"),
        row("t1", "table", "s1", position=0, label="T"), row("c1", "column", parent_id="t1"), row("c2", "column", parent_id="t1"), row("f1", "field", "s1", label="Name"), row("f2", "field", "s1", region="header"), row("b1", "control", "s1", label="Save"),
        row("b2", "control", "s1", label="unlabeled control"), row("l1", "link", "s1", target_route="/x"), row("l2", "link", "s1", target_route="/"), row("l3", "link", "s1", target_route="http://h/x"), row("v1", "event", "s1", source_state_id="u1", control_id="b1"),
        row("v2", "event", "s1", control_id="b2"), row("r1", "transition", source_state_id="u1", target_state_id="u2", event_id="v1"), row("r2", "transition", source_state_id="u1", target_state_id="u9"), row("r3", "transition", source_state_id="u1", target_state_id="u2", event_id="v2"),
    ]
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in ITEM.split(", ")) for r in rows], ITEM)


def test_core(spark):
    assert {r.canonical_id for r in subsets.core(items(spark), "s1").collect()} == {"e", "m", "s1", "u2", "t1", "c1", "c2"}


def test_complete(spark):
    got = {r.canonical_id: r.reason for r in subsets.complete(items(spark), "s1").collect()}
    assert got == {
        "f1": None, "f2": "global_scope_entity", "b1": None, "b2": "placeholder_control_label", "l1": None, "l2": "root_navigation_link", "l3": "unsafe_link_target", "v1": None, "v2": "event_source_not_selected",
        "r1": None, "r2": "cross_screen_transition", "r3": "transition_event_not_selected", "u1": None, "u2": None,
    }


def test_neighbourhood_follows_corrections(spark):
    moved = spark.createDataFrame([("f1", "s2", None)], "canonical_id string, screen_id string, parent_id string")
    assert "f1" not in {r.canonical_id for r in subsets.neighbourhood(items(spark), moved, "s1").collect()}
    assert {r.canonical_id for r in subsets.neighbourhood(items(spark), moved, "s2").collect()} == {"f1", "u9", "r2"}


def test_folds(spark):
    rows = [("/a", 1, "", None, None, "discovered"), ("/a", 2, "Old", 0.9, "m1", "observed"), ("/a", 3, "", 0.2, "m2", "discovered"), ("/a", 4, "New", 0.5, None, "discovered"), ("/b", 1, "B", None, "", "discovered")]
    got = {r.route: tuple(r)[1:] for r in audits.merged_nodes(spark.createDataFrame(rows, "route string, seq int, title string, confidence double, module string, status string")).collect()}
    assert got == {"/a": ("New", "m1", "observed"), "/b": ("B", None, "discovered")}


def test_prefix_and_outcome(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    prefix = lambda *r: one(audits.common_prefix(F.array(*map(F.lit, r))))
    assert [prefix("/a/b/c", "/a/b/d"), prefix("/a/b"), prefix("/a", "/ab"), prefix("/a/b", "/a")] == ["/a/b", "/a/b", None, "/a"]
    say = lambda e, ok, ch: one(audits.outcome(F.lit(None).cast("string"), F.lit(e).cast("string"), F.lit(ok), F.lit(ch)))
    assert [say("state_restore_failed", True, True), say("x", False, True), say("x", True, True), say(None, True, True), say(None, True, False)] == ["restore_failed", "interaction_failed", "execution_error", "changed", "unchanged"]
