"""The pipeline's stages against their plain versions, stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_operators import brute_near, brute_removed

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], SF)
        out.write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    rows = [k.orderBy("doc_id").collect() for k in kept]
    assert all(k.columns == columns for k in kept[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in rows[1]}
    known = [r.doc_id for r in rows[0] if r.doc_id in labels]
    assert sum((i in left) == bool(labels[i]) for i in known) / len(known) > 0.97
    texts = [r.text for r in rows[1]]
    near = brute_near(texts, 5, 80)
    assert {r.doc_id for r in rows[2]} == {rows[1][i].doc_id for i, (_, c) in near.items() if i == c}
    removed = brute_removed([r.text for r in rows[2]], corpus_pipeline.REPEATED["window"])
    assert [r.text for r in rows[3]] == [k.decode("utf-8", "ignore") if n else r.text for r, (n, k) in zip(rows[2], removed, strict=True)]
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]}
    assert len(rows[5]) == len(rows[4]) and all(r.n_tokens == len(r.ids) for r in rows[5])


def test_passages_of_fifty_words(spark):
    import random

    import corpus_pipeline
    from tests.llm.test_operators import docs, words

    rng = random.Random(5)
    passages = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(50)) for _ in range(6)]
    texts = [f"{words(rng, 80, 9000)} {passages[i % 6]} {words(rng, 80, 9000)}" for i in range(30)] + [words(rng, 90, 9000), None, ""]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs(spark, texts), "").collect()}
    assert all(passages[i % 6] not in got[i] and len(got[i]) > 500 for i in range(30)) and all(got[i] == texts[i] for i in (30, 31, 32))


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated texts, columns with clashing names, and no rows at all."""
    import corpus_pipeline
    from tests.llm.test_operators import DOC

    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(None, None, None), (1, 1, 0), (1, 0, None), (2, 0, 0)], labels).write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (2, "One two three.", "en", None, 1), (2, "One two three.", "en", None, 1), (None, "x " * 400, "en", "s", 3), (5, "x " * 400, "en", "s", None)]
    for data in (rows, []):
        first = spark.createDataFrame(data, DOC)
        for name in ("_size", "rep", "th", "row", "spans", "score", "n", "kept", "_removed2"):
            first = first.withColumn(name, F.lit("mine"))
        now = first
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == first.columns
            out.write.parquet(str(tmp_path / f"{len(data)}-{i}"))
            now = spark.read.parquet(str(tmp_path / f"{len(data)}-{i}"))
        assert data or now.count() == 0
