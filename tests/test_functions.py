import pytest
from pyspark.sql import functions as F

from tessella.functions import hashing, privacy, routes, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("f, given, wanted", [
    (text.search_key, "  Ñandú / Órdenes_2 ", "nandu / ordenes 2"), (text.id_key, "Ñandú / Órdenes_2", "nandu ordenes 2"), (text.question_key, "¿Qué hay_aquí?", "que hay_aqui"),
    (text.search_key, "Straße", "strasse"), (text.label_key, " Añadir   Ítem", "anadir item"), (text.signature_key, " A  B\n", "a b"), (text.slug, " Créditos & Más ", "creditos-mas"),
])
def test_keys(spark, f, given, wanted):
    assert one(spark, f(F.lit(given))) == wanted


def test_tokens(spark):
    assert sorted(one(spark, text.tokens(F.lit("las configuraciones de los modulos papeles tren es")))) == ["configuracion", "es", "pantalla", "papel", "tren"]


def test_spoken_list_and_breadcrumb(spark):
    assert [one(spark, text.spoken_list(F.array(*map(F.lit, "abc"[:n])) if n else F.array().cast("array<string>"))) for n in range(4)] == ["", "a", "a y b", "a, b y c"]
    assert one(spark, text.breadcrumb(F.lit("/admin/pagos-x-mes/lista"))) == "Pagos  por  mes"


def test_sanitised(spark):
    r = one(spark, privacy.sanitised(F.lit("Call ana@example.com  or 10.0.0.1, total $ 12.50 on 2024-01-02")))
    assert "@" not in r.clean and "10.0" not in r.clean and "$" not in r.clean and r.detections == 4
    assert one(spark, privacy.is_sensitive(F.lit("password: x"))) and not one(spark, privacy.is_sensitive(F.lit("Fecha de factura")))


def test_safe_text_skips_what_does_not_fit(spark):
    r = one(spark, privacy.safe_text(F.lit("Orders"), F.array(*map(F.lit, ("orders", "x" * 30, "Name", "mail a@b.co"))), 20))
    assert r.text == "Orders | Name" and r.exclusions == 2


def test_routes(spark):
    assert [one(spark, routes.route_key(F.lit(x))) for x in ("", "a/b/?q=1", "/a/", None)] == ["/", "/a/b", "/a", "/"]
    assert one(spark, routes.masked_query(F.lit("/x?b=1&a=2&b=3&c"))) == "a=%2A&b=%2A"
    assert one(spark, routes.ancestors(F.lit("/a/b"))) == ["/a", "/a/b"]
    base = F.lit("http://h.example/app/x")
    links = {"../y?k=1#z": "/y?k=1", "http://other.example/a": None, "javascript:void(0)": None, "#top": None, "/p": "/p", None: None}
    assert {h: one(spark, routes.internal_link(F.lit(h).cast("string"), base)) for h in links} == links


def test_policy_of_routes(spark):
    is_allowed = lambda r: one(spark, routes.is_allowed(F.lit(r).cast("string"), ("/a",), ("/a/x",)))
    assert [is_allowed(r) for r in ("/a/b", "/a/x/1", "/c", "/", None)] == [True, False, False, False, False]


def test_hashes(spark):
    import hashlib
    import json

    wanted = "field:" + hashlib.sha256(json.dumps(["ñ/\"a", None], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24]
    assert one(spark, hashing.stable_id("field", F.lit('ñ/"a'), F.lit(None).cast("string"))) == wanted
    assert one(spark, hashing.content_hash(b=F.lit(1), a=F.lit(None).cast("string"))) == hashlib.sha256(b'{"a":null,"b":1}').hexdigest()


def test_signs_of_sensitive_values_lose_none(spark):
    """Values are tried with all patterns only where they have a sign of one."""
    hits = (
        "a@b.org", "at 10.20.30.40", "x fe80:0:aa", "bearer " + "k" * 32, "Key ſ" + "a" * 31, "TOKEN = x", "cookie:y", "001-002-123456789", "1790012345001", "0991234567", "nr 1234567 ok", "USD $ 1", "£ 2",
        "1.200,50", "12,34", "3 ENE 2024", "3 septiembre 2024", "1/2/24", "+593 99 123 45 67", "1 2 3 4 5 6 7", "1-2.3-4 5-6 7", "2024-01-02", "9:15", "Historial de inicio de sesión x", "٣٣٣٣٣٣٣", "HİSTORIAL DE INICIO DE SESION",
    )
    fine = ("", None, "why " * 300, "1-URGENT 33", "Screen 12345 BUILDING", "a" * 31, "x" * 31 + "é" + "y" * 31, "historial", "3 enero", "a/b", "+ 1", "123456")
    rows = spark.createDataFrame([(t,) for t in hits + fine], "t string")
    for r in rows.select("t", privacy.is_sensitive(F.col("t")).alias("new"), F.coalesce("t", F.lit("")).rlike(privacy._ANY).alias("every")).collect():
        assert r.new == r.every, r.t
        assert r.new or r.t not in hits or r.t.startswith("Hİ"), r.t


def test_long_values_are_not_searched(spark):
    """A value of over 500 characters goes whatever it holds, so its length is looked at first."""
    kept = spark.range(1).select(privacy.safe_metadata(F.create_map(F.lit("a"), F.repeat(F.lit("ab "), 200), F.lit("b"), F.lit("x"), F.lit("c"), F.lit("a@b.org"), F.lit("d"), F.lit(None).cast("string"))).alias("kept"))
    assert kept.head().kept == {"b": "x", "d": None}
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert plan.index("<= 500") < plan.index("RLIKE")


def test_ascii_does_not_go_to_python(spark):
    said = ["ÁRBOL Straße ﬁ", "PLAIN Text", None, "", "İı Å x"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", text.folded(F.col("t")).alias("f"), text.decomposed(F.col("t")).alias("d"))
    assert "CASE WHEN" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.f, r.d) for r in rows.collect()] == [(text._plain(t, True), text._plain(t, False)) for t in said]


def test_folding_takes_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    taken = []
    monkeypatch.setattr(pa, "array", lambda v, kind, make=pa.array: taken.append(len(v)) or make(v, kind))
    assert text._each(pa.chunked_array([["É"] * 150]).combine_chunks(), True).to_pylist() == ["e"] * 150
    assert max(taken) <= 64
