"""WARC archives, the audit of filters and whitening against brute force, with nulls, ties, repeated rows and odd columns."""

import hashlib
import io
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import interaction, warc, whitening
from tessella.llm.common import shared_dir

PAGE = "page_id long, url string, html string"


# 11


def archives(spark, rows, name, **more):
    folder = f"{shared_dir(spark)}/{name}"
    return warc.write(warc.marked(rows), folder, **more)


def pages(spark):
    long, other = "é<p>" * 60, "x" * 100
    texts = [long, "short", None, "", other, long, "short", "y" * 99, "y" * 99, other, long, "<html>" + "z" * 300_000]
    rows = [(i, f"http://h/{i}?a=ü b\r\nWARC-Type: x", t) for i, t in enumerate(texts)]
    rows += [(None, None, long), (20, None, other), (20, None, other), (21, "u", "q" * 200), (21, "u", "q" * 200), (None, "u", "k" * 150), (None, "u", "k" * 150)]
    random.Random(3).shuffle(rows)
    return rows


def wanted(rows):
    first = {}
    for i, _, t in rows:
        if t is not None and len(t.encode()) >= 100 and i is not None:
            first[t] = min(i, first.get(t, i))
    out = []
    for i, _, t in rows:
        raw, f = (t or "").encode(), first.get(t)
        revisit = f is not None and (i is None or i > f)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages(spark)
    df = spark.createDataFrame(rows, PAGE).withColumn("payload", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    manifest = archives(spark, df, "round", archive=1500)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).head()[0] == len(rows)
    found = warc.resolved(warc.read(manifest, payloads=True)).collect()
    number = lambda u: None if u is None or u == warc.PREFIX else int(u.removeprefix(warc.PREFIX))
    got = sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found), key=str)
    assert got == wanted(rows) and all(r.problem is None for r in found)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in found)
    uri = {number(r.record_id): r.target_uri for r in found}
    assert uri[3] == "http://h/3?a=%C3%BC%20b%0D%0AWARC-Type:%20x" and uri[20] is None


def test_no_pages(spark):
    manifest = archives(spark, spark.createDataFrame([], PAGE), "none")
    assert manifest.count() == 0 and warc.resolved(warc.read(manifest)).count() == 0


def made(payload=b"hello", **changed):
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "Content-Type": "application/http; msgtype=response",
              "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest()} | changed
    return warc.framed(list(fields.items()), b"HTTP/1.1 200 OK\r\nX: a\r\n b\r\n\r\n", payload)


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_reader_takes_pieces(step):
    raw = io.BytesIO(made() + made(b"") + made(b"a" * 200_000))
    got = list(warc.records(lambda n: raw.read(min(n, step)), True))
    assert [r.payload for r in got] == [b"hello", b"", b"a" * 200_000] and not any(r.problem for r in got)


def member(raw):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@pytest.mark.parametrize("raw", [
    made()[:-9], member(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"), member(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nlonger\r\n\r\n"),
    member(b"WARC/1.1\r\nX: 1\r\n\r\n"), member(b"no record"), made() + b"not gzip",
])
def test_broken_archives(raw):
    with pytest.raises(warc.Damaged):
        list(warc.records(io.BytesIO(raw).read))


def test_wrong_digests(spark, tmp_path):
    wrong = "sha256:" + "0" * 64
    (tmp_path / "a.warc.gz").write_bytes(made(**{"WARC-Payload-Digest": wrong}) + made(**{"WARC-Block-Digest": wrong}) + made() + b"rest")
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    got = warc.read(paths, strict=False).collect()
    assert [r.problem for r in got][:3] == ["payload digest", "block digest", None] and got[3].record_id is None
    with pytest.raises(Exception, match="payload digest"):
        warc.read(paths).collect()


def test_lost_references(spark):
    rows = [("a", "response", None, None, 5, "d", None, "p"), ("b", "revisit", None, "a", 5, "d", None, "p"),
            ("c", "revisit", None, "a", 5, "other", None, "p"), ("d", "revisit", None, None, 5, "d", None, "p")]
    got = {r.record_id: r.problem for r in warc.resolved(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got["a"] is None and got["b"] is None and got["c"] and got["d"]


# 12

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_masks(rows):
    first = {}
    for i, t, s in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, s in rows:
        t = t or ""
        w = t.encode().split()
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 any(c in "#$%&*|" for c in t), i is not None and i > first[t]]
        out.append((i, s or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def documents():
    rng = random.Random(8)
    texts = [None, "", "é" * 97 + "AB", "é" * 98 + "AB", "a|b", " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k % 99}" for k in range(200)),
             "x " * 250, "A" * 300, "A b" * 40_000, "a b\x1cc " * 200]
    rows = [(i, rng.choice(texts), rng.choice(["hot", "hot", "hot", "s", None, ""])) for i in range(300)]
    return rows + [(7, "twice", "s"), (7, "twice", "s"), (None, "twice", "s"), (None, "é" * 97 + "AB", None), (None, "alone", "s"), (6, "twice", "hot")]


@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda c: F.lit(3), lambda c: F.length(c)])
@pytest.mark.parametrize("parts", ["1", "13"])
def test_masks(spark, fingerprint, parts):
    rows = documents()
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOC).withColumn("fp", F.lit("x")).withColumn("mask", F.lit(1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = sorted(map(tuple, interaction.masks(df, fingerprint=fingerprint).select("id", "part", "mask").collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(brute_masks(rows), key=str)


def test_audit(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOC)
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (3, None, None), (1, 1, 0), (1, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, t in marks if t == 1 and i is not None}
    found = brute_masks(rows)
    shapley, steps = {}, {}
    for part in {p for _, p, _ in found}:
        for order in map("".join, permutations("ABCDE")):
            before = 0
            for step, f in enumerate(order, 1):
                own = 1 << "ABCDE".index(f)
                here = [(i, m) for i, p, m in found if p == part]
                gone = [i for i, m in here if m & own and not m & before]
                steps[part, order, step] = (
                    sum(not m & (before | own) for _, m in here), len(gone), sum(bool(m & own and m & before) for _, m in here),
                    sum(m == own for _, m in here), sum(i in good for i in gone), sum(i in toxic for i in gone), f)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                before |= own
    got = interaction.audit(df, labels).collect()
    assert len(got) == len(steps)
    for r in got:
        *numbers, f = steps[r.part, r.filter_order, r.step]
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == [*numbers, shapley[r.part, f]]
    assert interaction.audit(spark.createDataFrame([], DOC), labels).count() == 0
    assert sum(r.good_lost for r in interaction.audit(df, labels.where("false")).collect()) == 0


# 13

VEC = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v]


def check_whitening(got, rows, components=16):
    usable = [(i, whole(v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    assert len({r.vec_id for r in got}) == len({i for i, _ in usable})
    fit = np.array(sorted({tuple(x) for _, x in usable}), np.int64)
    n, s = len(fit), fit.sum(0)
    cov = np.cov(fit.T.astype(float), bias=True)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-10 * e[0]).sum()))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    first = next(iter(by.values()))
    signs = {}
    for i, x in usable:
        d = n * np.array(x, np.int64) - s
        rs = by[i, int((d * d).sum())]
        assert sorted(rs) == list(range(1, k + 1))
        for c in rs:
            w = float(d / n @ v[:, c - 1] / np.sqrt(e[c - 1]))
            if abs(w) > 1e-6:
                signs.setdefault(c, set()).add(np.sign(w * rs[c].whitened))
            assert abs(abs(w) - abs(rs[c].whitened)) < 1e-6
            assert rs[c].n == n and rs[c].identity_error < 1e-4 and abs(rs[c].explained / (e[c - 1] / e.sum()) - 1) < 1e-9
    assert all(len(x) == 1 for x in signs.values()) and len(first) == k


def vectors(d, n, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(3, 1, d)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize(("d", "n"), [(5, 40), (20, 12), (24, 300)])
def test_whitening(spark, d, n):
    rows = vectors(d, n)
    rows += [(n + i, rows[0][1]) for i in range(50)] + [(n + 60, None), (n + 61, [None] * d), (n + 62, [float("nan")] * d), (n + 63, [float("inf")] * d)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VEC).withColumn("x", F.lit("mine")).withColumn("n", F.lit(1))
    check_whitening(whitening.whiten(df).collect(), rows)


def test_flat_directions(spark):
    rows = [(i, [*v, v[0], 7.0]) for i, v in vectors(3, 60)]
    got = whitening.whiten(spark.createDataFrame([(i, v, None) for i, v in rows], VEC)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check_whitening(got, rows)


def test_lengths_ids_and_equal_vectors(spark):
    short, long = vectors(3, 30), [(100 + i, v) for i, v in vectors(6, 30)]
    odd = [(None, short[0][1]), (None, short[0][1]), (3, short[5][1]), (900, []), (901, [1.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1) for i, v in short + long + odd], VEC)).collect()
    check_whitening([r for r in got if r.vec_id is not None and r.vec_id >= 100], long)
    check_whitening([r for r in got if r.vec_id is not None and r.vec_id < 100], short + odd[2:3])
    assert sum(r.vec_id is None for r in got) == 6 and not {r.vec_id for r in got} & {900, 901}
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(5)], VEC))
    empty = whitening.whiten(spark.createDataFrame([], VEC))
    assert same.count() == empty.count() == 0
    assert same.dtypes == empty.dtypes == whitening.whiten(spark.createDataFrame([(i, v, 1) for i, v in short], VEC)).dtypes


def test_overflow_fails(spark):
    rows = [(i, [float(10.0**15 * (-1) ** i)], 1) for i in range(4)]
    with pytest.raises(Exception, match="(?i)overflow"):
        whitening.whiten(spark.createDataFrame(rows, VEC)).collect()
