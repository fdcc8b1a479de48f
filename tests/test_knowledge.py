import datetime as dt
import json

from pyspark.sql import functions as F

from tessella.operators import graph, policy, ranking, relations, versions
from tessella.plans import QUERIES, canonical
from tessella.sources import documents
from tessella.streaming import reviews

LOG = "item_id string, created_at timestamp, action_id long, action string, corrected_payload string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def log_rows():
    return [
        ("a", at(1), 1, "correct", "A1"), ("b", at(1), 2, "correct", "B1"), ("b", at(2), 3, "approve", None), ("c", at(1), 4, "correct", "C1"), ("c", at(2), 5, "reset", None),
        ("d", at(1), 6, "correct", "D1"), ("d", at(2), 7, "reset", None), ("d", at(3), 8, "correct", "D2"), ("e", at(1), 9, "correct", "E1"), ("e", at(1), 10, "reset", None), ("f", at(1), 11, "correct", "{}"),
    ]


def test_effective_payload(spark):
    items = spark.createDataFrame([(k, k.upper()) for k in "abcdefg"], "item_id string, source_payload string")
    got = {r.item_id: r.effective for r in versions.effective(items, spark.createDataFrame(log_rows(), LOG)).collect()}
    assert got == {"a": "A1", "b": "B1", "c": "C", "d": "D2", "e": "E", "f": "F", "g": "G"}


def test_stream_gives_the_same(spark, tmp_path):
    for i, r in enumerate(log_rows()):
        spark.createDataFrame([r], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "*"))
    q = reviews.effective_corrections(stream).writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = reviews.effective_corrections(spark.createDataFrame(log_rows(), LOG))
    assert sorted(map(tuple, spark.table("folded").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_stable_fingerprints(spark, tmp_path):
    schema = "key string, seq long, fingerprint string, at timestamp"
    rows = [("k", i, f, at(i)) for i, f in enumerate("aabbbca")] + [("j", 1, "x", at(1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = reviews.stable_fingerprints(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3).writeStream.outputMode("append").format("memory").queryName("stable").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("stable").collect()] == [("k", "b", 3)]


def test_quota_is_the_greedy_choice(spark):
    import random

    rng = random.Random(1)
    rows = [(g, i, rng.choice("xyz")) for g in range(6) for i in range(15)]
    df = spark.createDataFrame(rows, "g long, i long, c string")
    got = {(r.g, r.i): (r.selected, r.excluded_by) for r in ranking.quota_selection(df, "g", "c", [F.col("i")], 2, 4).collect()}
    for g in range(6):
        taken, total = {}, 0
        for _, i, c in (r for r in rows if r[0] == g):
            if taken.get(c, 0) >= 2:
                want = (False, "category_quota")
            elif total >= 4:
                want = (False, "total_quota")
            else:
                taken[c], total, want = taken.get(c, 0) + 1, total + 1, (True, None)
            assert got[g, i] == want


def test_longest_prefix_is_by_segments(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a",), ("/z",)], "route string")
    p = spark.createDataFrame([("/a", "A"), ("/a/b", "AB")], "prefix string, module string")
    assert {r.route: r.module for r in relations.longest_prefix(df, "route", p, "prefix", "module").collect()} == {"/a/b/c": "AB", "/a/bc": "A", "/a": "A", "/z": None}


def test_paths_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("a", "c", "S")], "source string, target string, type string")
    got = {(r.id, r.length) for r in graph.paths(spark.createDataFrame([("a",)], "id string"), edges).collect()}
    assert got == {("b", 1), ("c", 1), ("b", 2), ("c", 2)}


def test_policy_order(spark):
    rows = [("mutative_action", "x", True, ""), ("navigation_link", "Renuevo", False, ""), ("navigation_link", "ok", False, "submit"), ("submit_search", "ok", False, "submit"), ("expand_row", "ok", False, ""), ("new", "ok", None, None)]
    df = spark.createDataFrame(rows, "c string, l string, d boolean, k string")
    said = df.select(policy.decide(F.col("c"), F.col("l"), ("nuevo",), F.col("d"), F.col("k"), F.lit(None).cast("boolean")).alias("s")).select("s.*").collect()
    assert [(r.decision, r.reason) for r in said] == [("deny", "element_disabled"), ("deny", "dangerous_text_or_signal_detected"), ("deny", "submit_blocked_by_forms_policy"), ("allow", "event_category_explicitly_allowed"), ("review", "event_category_requires_review"), ("deny", "default_policy_applied")]


def kb(spark, shuffled=False):
    screens = [
        {"route": "/sales/orders?x=1", "title": "Orders", "main_visible_text": "10.0.0.1 a@b.co", "inputs": [{"label": "Client"}, {"label": "secret", "region": "volatile"}, {"name": "client", "label": "CLIENT"}], "buttons": [{"text": "Search"}, {"text": " "}],
         "tables": [{"name": "Results", "headers": ["Id", "Total"], "row_count": 2}], "local_links": [{"text": "Items", "href": "/sales/items"}], "links": [{"text": "items", "href": "/sales/items/"}]},
        {"route": "/sales/items", "title": "Items", "inputs": [], "buttons": [], "tables": [], "local_links": [], "links": []},
        {"route": "/other", "title": "Other", "local_links": [{"text": "gone", "href": "/missing"}]},
    ]
    s = spark.createDataFrame(screens[::-1] if shuffled else screens, documents.SCREEN)
    states = spark.createDataFrame([("s1", "/sales/orders", "Orders", "f1"), ("s2", "/sales/items", "Items", "f2"), ("s3", "/nowhere", "?", "f3")], "state_id string, route string, title string, signature string")
    steps = spark.createDataFrame([("s1", "s2", "navigation_link", "Items", "a"), ("s1", "s9", "navigation_link", "?", "b")], "source_state_id string, target_state_id string, event_type string, label string, selector string")
    modules = spark.createDataFrame([("/sales", "Sales")], "prefix string, name string")
    return canonical.build("shop", s, states, steps, modules)


def test_canonical(spark):
    e = kb(spark)
    n = {r.entity_type: r.n for r in canonical.statistics(e).collect()}
    assert n == {"erp": 1, "module": 1, "screen": 3, "field": 1, "control": 2, "table": 1, "column": 2, "link": 2, "state": 2, "transition": 1, "warning": 2}
    screen = {r.title: r for r in e["screen"].collect()}
    assert screen["Orders"].module_id and not screen["Other"].module_id
    assert "@" not in screen["Orders"].main_content_text and "secret" not in screen["Orders"].main_content_text and "Client" in screen["Orders"].main_content_text
    assert canonical.issues(e).where("severity = 'error'").count() == 0
    again = canonical.flattened(kb(spark, True)).select("canonical_id", "content_hash")
    assert sorted(map(tuple, canonical.flattened(e).select("canonical_id", "content_hash").collect())) == sorted(map(tuple, again.collect()))


def test_import_is_idempotent_and_carries(spark):
    new = spark.createDataFrame([("f", "1", "h1"), ("f", "2", "h2x")], "entity_type string, canonical_id string, content_hash string")
    old = spark.createDataFrame([("f", "1", "h1", "approved", None, "v1"), ("f", "2", "h2", "approved", None, "v1")], "entity_type string, canonical_id string, content_hash string, status string, correction string, version string")
    known = spark.createDataFrame([("e", "v1", "active")], "erp_id string, version string, status string")
    items, vs = versions.imported(new, known, old, "e", "v2")
    assert {(r.canonical_id, r.status, r.action) for r in items.where("version = 'v2'").collect()} == {("1", "approved", "approve"), ("2", "pending", None)}
    assert {(r.version, r.status) for r in vs.collect()} == {("v1", "archived"), ("v2", "active")}
    items2, vs2 = versions.imported(new, vs, items.select(*old.columns), "e", "v2")
    assert items2.count() == items.count() and sorted(map(tuple, vs2.collect())) == sorted(map(tuple, vs.collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"screens": [{"route": "/a", "title": "A", "more": 1}]}))
    (tmp_path / "twice.json").write_text(json.dumps({"screens": [{"route": "/a"}, {"route": "/a"}]}))
    (tmp_path / "bad.json").write_text("{")
    read = lambda n: documents.screen_index(spark, str(tmp_path / n))
    assert read("ok.json")[0].count() == 1 and read("ok.json")[1] is None
    assert [read(n)[1] for n in ("twice.json", "bad.json")] == ["duplicate_route", "invalid_document"] and read("none.json")[0].count() == 0 and read("none.json")[1]
    df = spark.createDataFrame([("e", "v1", 1), ("e", "v2", 2)], "erp_id string, version string, x long")
    path = str(tmp_path / "out")
    documents.replace_scope(df, path)
    documents.replace_scope(df.where("version = 'v2'").withColumn("x", F.lit(9).cast("long")), path)
    assert sorted((r.version, r.x) for r in spark.read.parquet(path).collect()) == [("v1", 1), ("v2", 9)]
    m = documents.manifest({"a": df}).collect()[0]
    assert m.rows == 2 and m.content_hash == documents.manifest({"a": df.orderBy(F.desc("x"))}).collect()[0].content_hash


def test_main_text_and_tokens_of_every_document(spark, tmp_path):
    line = lambda n: "á" * n
    texts = [None, "", " \n\t\n", "one", "one\n\n  two   three \n", line(8001) + "\nshort", line(8000) + "\nshort", line(4000) + "\n" + line(3999) + "\nx", line(4000) + "\n" + line(4000) + "\nx", "\n".join(f"line {i}" for i in range(2000)), "Los módulos y las pantallas/listas", "The cats, the dogs"]
    langs = ["es", None, "en", "es", "de", "fr", "en", None, "en", "en", "es", None]
    spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def folded(t):
        kept = []
        for x in filter(None, (" ".join(x.split()) for x in t.split("\n"))):
            if len("\n".join([*kept, x])) > 8000:
                break
            kept.append(x)
        return "\n".join(kept)

    got = {r.doc_id: r.main_text for r in QUERIES["main_text"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else folded(t) for i, t in enumerate(texts)}
    tokens = {r.doc_id: r.tokens for r in QUERIES["token_set_normalize"](spark, str(tmp_path)).collect()}
    assert set(tokens) == set(range(len(texts)))
    assert tokens[0] is None and tokens[1] == tokens[2] == "" and tokens[10] == "lista pantalla" and tokens[4] == "one three two" and tokens[11] == "cats dogs the"
    numbers = {str(i) for i in range(2000)}
    assert set(tokens[9].split()) == numbers | {"line"}
