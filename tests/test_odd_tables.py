"""Queries against their SQL on small tables that hold what the given ones lack at their smallest."""

import duckdb
import pandas as pd
import pytest

from tessella.operators import dom
from tessella.plans import ORACLES, QUERIES
from tests.test_queries import same


@pytest.fixture
def against_sql(spark, tmp_path):
    def check(name, **tables):
        c = duckdb.connect()
        for table, rows in tables.items():
            pd.DataFrame(rows).to_parquet(f"{tmp_path}/{table}.parquet", index=False)
            c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        same(got, c.sql(ORACLES[name]).df())
        return got

    return check


CUT = (
    "<!DOCTYPE html><html><head><title>Site. A.</title></head><body><nav><ul><li><a href=\"/en/1\">Home &amp; all</a></li></ul></nav><!-- ad --><div class=\"ad\">Ad.</div>"
    "<article><h1>News of the&amp;&amp;&am{}</h1><p><b>Text &lt;x&gt;<br></article><footer>&copy; h.example</footer></body></html>"
)


@pytest.mark.parametrize("name", ["page_titles", "page_titles_with_hints", "structural_fingerprint", "screen_index"])
def test_headings_cut_within_references(against_sql, name):
    pages = [{"page_id": i, "url": f"https://h.example/en/{i}", "html": CUT.format(end)} for i, end in enumerate(("p;", "p", ""))]
    got = against_sql(name, pages=pages)
    if "title" in got:
        assert set(got["title"]) - {"From the menu"} >= {"News of the&&&amp", "News of the&&&am"} - ({"News of the&&&amp"} if name == "page_titles_with_hints" else set())


def test_whole_references():
    assert dom.whole_references("a&amp b&amp;c&#65;&#x42;&copy &copy;&notit;&bogus;&") == "a&amp b&cAB&copy ©&notit;&bogus;&"


def test_intents_of_ascii_words(against_sql):
    said = ["Ración. El ócreado es", "Quiero crear algo", "la búsqueda", "una página", "RECREAR", "veo un campo"]
    got = against_sql("answer_intents", conversations=[{"conv_id": i, "turn": 0, "role": "user", "text": t} for i, t in enumerate(said)])
    assert got["intent"].notna().sum() == 3


def test_turns_of_pages_that_keys_do_not_tell_apart(against_sql):
    customers = [{"c_custkey": k, "c_nationkey": 0} for k in (5, 10012, 20019, 7)]
    orders = [{"o_orderkey": i, "o_custkey": (10012, 5)[i % 2]} for i in range(10)]
    got = against_sql("crawl_order", nation=[{"n_nationkey": 0}], customer=customers, orders=orders)
    assert got.groupby(["depth", "turn"]).size().max() > 1


@pytest.mark.parametrize("name", ["effective_descriptions", "unbacked_corrections"])
def test_keys_of_a_million_and_more(against_sql, name):
    lines = [(3, 3, 5), (3, 1, 2_500_001), (7, 1, 1), (7, 3, 2), (11, 3, 1_000_003), (11, 4, 3), (15, 4, 4), (15, 3, 1_500_000), (19, 1, 1)]
    got = against_sql(name, orders=[{"o_orderkey": k} for k in (3, 7, 11, 15, 19, 23)], lineitem=[dict(zip(("l_orderkey", "l_linenumber", "l_partkey"), x, strict=True)) for x in lines])
    assert 0 < len(got)


def test_structures_are_not_sent_through_the_driver(spark):
    from tessella.operators import payloads

    items = spark.createDataFrame([("s", "ui_state", '{"screen_id": "p", "title": "t"}'), ("m", "transition", '{"category": "c", "source_state_id": "s"}')], "canonical_id string, entity_type string, payload string")
    found = payloads.structures(items)
    for part in found:
        assert "Broadcast" not in part._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in found.children.collect()) == ["m", "s"]


def test_columns_of_a_questions_tables_come_by_a_join(spark):
    from tessella.operators import retrieval

    questions = spark.createDataFrame([(1, "columnas de la tabla", "columnas de la tabla", "LIST_COLUMNS")], "question_id int, question string, key string, intent string")
    found = spark.createDataFrame([(1, "s", "screen", "S")], "question_id int, canonical_id string, entity_type string, safe_label string")
    rels = [(1, 1, "s", "HAS_TABLE", "t", "S", "T"), (1, 2, "t", "HAS_COLUMN", "c", "T", "C"), (1, 3, "other", "HAS_COLUMN", "d", "O", "D")]
    edges = spark.createDataFrame(rels, "question_id int, seq int, source string, type string, target string, source_label string, target_label string")
    planned = retrieval.plans(questions, found, edges)
    assert "array_contains" not in planned._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.supported, r.evidence) for r in planned.collect()] == [(True, ["t", "c"])]


def test_claims_by_their_references_alone(against_sql):
    """What a turn says, an action that changes data or a denial, is no part of the SQL."""
    said = ["Quiero borrar todo", "no existe nada", "ver esto"]
    got = against_sql("claim_validation", conversations=[{"conv_id": i, "turn": turn, "role": "user", "text": s} for i, s in enumerate(said) for turn in (1, 2, 3, 5)])
    assert got[got["turn"] < 3]["error"].isna().all()


def test_claims_with_their_words(spark):
    from pyspark.sql import functions as F

    from tessella.operators import evidence

    rows = spark.createDataFrame([("borrar", ["a"]), ("buscar", ["a"]), ("ver esto", ["a"]), ("borrar", []), ("borrar", ["b"]), ("ver", None)], "said string, refs array<string>")
    got = rows.select(evidence.claim_error(F.col("said"), F.col("refs"), F.array(F.lit("a")), F.array(F.lit("view"))).alias("e")).collect()
    assert [r.e for r in got] == ["unsupported_mutative_action", "unsupported_action", None, "missing_reference", "unknown_reference", "missing_reference"]


@pytest.mark.parametrize("name", ["safe_properties", "action_checks", "reference_counts", "capability_errors", "description_errors", "capability_support"])
def test_rows_are_dealt_before_their_texts_are_checked(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_relations_do_not_join_their_paths_again(spark):
    from tessella.operators import retrieval

    known = spark.createDataFrame([("s", "S", "screen"), ("t", "T", "table"), ("f", "F", "field")], "canonical_id string, safe_label string, entity_type string")
    edge = lambda a, b: {"source": a, "type": "HAS", "target": b}
    walks = [(1, "a", 1, "t", [edge("s", "t")]), (1, "b", 2, "x", [edge("s", "f"), edge("f", "x")]), (1, "c", 3, "f", [edge("s", "t"), edge("t", "f")])]
    walks = spark.createDataFrame(walks, "question_id int, path_id string, seq int, ends string, edges array<struct<source:string,type:string,target:string>>")
    found = retrieval.relations(walks, known)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert [(r.seq, r.source, r.target, r.source_label, r.target_type) for r in found.orderBy("seq").collect()] == [(1, "s", "t", "S", "table"), (2, "t", "f", "T", "field")]


def test_nodes_are_checked_once(spark):
    from tessella.plans import publishing

    kept, edges = publishing.projected(spark, "/root/testdata/sf0.001")
    assert "RLIKE" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert set(kept.columns) >= {"canonical_id", "entity_type"}


def test_ids_of_nodes_are_not_broadcast(spark):
    from tessella.plans import publishing

    edges = publishing.projected(spark, "/root/testdata/sf0.001")[1]
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
