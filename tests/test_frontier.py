"""Explorations against plain queues, and modules of crawls in odd shapes."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessella.operators import crawl, frontier, modules

EDGE = "source string, seq long, target string"


def plain(start, links, opened, events, revealed, most_pages=None, most_depth=None, most_steps=None):
    """Two queues, one after the other, as a crawl without Spark would have them."""
    out = lambda edges, x: [t for s, _, t in sorted((e for e in edges if e[0] is not None and e[2] is not None), key=lambda e: e[1]) if s == x]
    routes, states = deque((r, 0) for r in dict.fromkeys(start)), deque()
    queued, known, visited, done, rounds = {r for r, _ in routes}, set(), [], {}, 0
    room = lambda: most_pages is None or len(visited) < most_pages
    while routes and room() or states:
        rounds += 1
        while routes and room():
            r, d = routes.popleft()
            if most_depth is not None and d > most_depth:
                queued.discard(r)
                continue
            visited.append((r, d))
            for t in out(links, r):
                if t not in queued:
                    queued.add(t)
                    routes.append((t, d + 1))
            for t in out(opened, r):
                if t not in known:
                    known.add(t)
                    states.append((t, d, 0))
        while states:
            s, d, n = states.popleft()
            if most_steps is not None and n >= most_steps:
                done[s] = (n, "kept")
                continue
            done[s] = (n, "explored")
            for t in out(events, s):
                if t not in known:
                    known.add(t)
                    states.append((t, d, n + 1))
            for t in out(revealed, s):
                if t not in queued:
                    queued.add(t)
                    routes.append((t, d + 1))
    late = {r for r, d in routes if most_depth is None or d <= most_depth}
    return visited, done, late


def graph(rng, n):
    seq = iter(range(10_000))
    edges = lambda a, b, k: [(f"{a}{rng.randrange(n)}", next(seq), f"{b}{rng.randrange(n)}") for _ in range(k)]
    return edges("r", "r", 2 * n), edges("r", "s", n), edges("s", "s", n), edges("s", "r", n)


def run(spark, start, edges, **limits):
    frames = [spark.createDataFrame(e, EDGE) for e in edges]
    return frontier.explored(spark.createDataFrame([(s, i) for i, s in enumerate(start)], "id string, seq long"), *frames, **limits)


@pytest.mark.parametrize("most_pages", [None, 1, 3, 6, 9])
def test_two_queues(spark, most_pages):
    rng = random.Random(11)
    edges = graph(rng, 12)
    edges[0].extend([(None, 1, "r1"), ("r1", 1, None), ("r1", 99_999, "r2"), ("r1", 99_998, "r2")])
    visited, done, late = plain(["r1", "r2"], *edges, most_pages=most_pages)
    found = run(spark, ["r1", "r2", "r1"], edges, most_pages=most_pages)
    rows = found.found.orderBy("kind", "wave", "place").collect()
    assert [(r.id, r.depth) for r in rows if r.status == "visited"] == visited and found.visited == len(visited)
    assert {r.id: (r.depth, r.status) for r in rows if r.kind == "state"} == done
    assert {r.id for r in rows if r.status == "pending"} == late and found.pending == len(late)
    assert found.reason == ("page_limit" if late else "exhausted")


def test_depths(spark):
    rng = random.Random(5)
    edges = graph(rng, 10)
    visited, done, _ = plain(["r1"], *edges, most_depth=2, most_steps=1)
    rows = run(spark, ["r1"], edges, most_depth=2, most_steps=1).found.orderBy("kind", "wave", "place").collect()
    assert [(r.id, r.depth) for r in rows if r.status == "visited"] == visited
    assert {r.id: (r.depth, r.status) for r in rows if r.kind == "state"} == done


def test_nothing_to_explore(spark):
    found = run(spark, [], [[], [], [], []])
    assert (found.found.count(), found.reason, found.visited) == (0, "exhausted", 0)
    alone = frontier.explored(spark.createDataFrame([("a", 0)], "id string, seq long"), spark.createDataFrame([], EDGE))
    assert [(r.id, r.status, r.round) for r in alone.found.collect()] == [("a", "visited", 1)] and alone.rounds == 1


def test_fixed_point_that_does_not_settle(spark):
    start = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(RuntimeError):
        crawl.fixed_point(start, lambda t: t.select((F.col("n") + 1).alias("n")), lambda a, b: False, most_rounds=3)


NODE = "seq long, id string, route string, kind string, base_route string, depth int, steps array<struct<selector string>>"
LINK = "seq long, source string, target string, label string, category string, selector string"


def test_modules_without_functional_routes(spark):
    nodes = [(1, "s1", None, "ui_state", "/", 1, [("#a",)]), (2, "s2", None, "ui_state", "/", 2, [("#a",), ("#b",)]), (3, "s3", "/alias", "ui_state", None, 1, None), (4, "s4", None, "ui_state", "/x", 1, [("#a",)])]
    edges = [(1, "/", "s1", " Menú ", "expand_menu", None), (2, "/", "s3", "Other", "expand_menu", " "), (3, "s2", "/v/a?x#y", None, None, None), (4, "s1", "/v/b/", None, None, None),
             (5, "s1", "/v#state:1", None, None, None), (6, "s1", "http://x", None, None, None), (7, "s4", "/no", None, None, None), (8, "/", "s2", "Deep", "expand_menu", "#b"), (9, "/", "lost", "Lost", "expand_menu", "#l")]
    given = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, LINK)
    found = modules.discovered("E", *given, spark.createDataFrame([], "route string"))
    got = {r.name: (r.origin, r.normalized_name, r.route_prefix, r.n_routes) for r in found.modules.collect()}
    assert got == {"Menú": ("#a", "menu", "/v", 2), "Other": ("s3", "other", None, 0)}
    assert {r.route for r in found.routes.collect()} == {"/v/a", "/v/b"} and found.warnings.count() == 0
    none = spark.createDataFrame([], NODE), spark.createDataFrame([], LINK)
    assert modules.discovered("E", *none, spark.createDataFrame([("/v/a",)], "route string")).modules.count() == 0
    old = spark.createDataFrame([("Ventas", "/v/a"), ("Ventas", "/v/b/"), ("Compras", None)], "name string, route string")
    found = modules.discovered("E", *none, spark.createDataFrame([("/v/a",)], "route string"), legacy=old)
    assert [(r.name, r.origin, r.n_routes) for r in found.modules.collect()] == [("Ventas", "legacy:Ventas", 2)]
    assert [(r.code, r.subject) for r in found.warnings.collect()] == [("module_without_functional_screen", "Compras")]


def test_waves_are_not_broadcast(spark, monkeypatch):
    plans, counted = [], frontier.counted
    monkeypatch.setattr(frontier, "counted", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or counted(df, name))
    start = spark.createDataFrame([("0", 0)], "id string, seq long")
    links = spark.createDataFrame([("0", 0, "1"), ("1", 0, "2"), ("2", 0, "0")], "source string, seq long, target string")
    assert frontier.explored(start, links).visited == 3
    assert len(plans) == 4 and not any("BroadcastHashJoin" in p for p in plans)
