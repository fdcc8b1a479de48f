"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, common, language, minhash, mixing, passages, quality, sharding, suffixes, topk, vectors
from tessella.llm.common import connected

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# 1


def brute_removed(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - window + 1):
            seen[r[i : i + window]] = seen.get(r[i : i + window], 0) + 1
    out = []
    for r in raw:
        covered = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                covered[i : i + window] = True
        out.append((int(covered.sum()), bytes(np.frombuffer(r, np.uint8)[~covered])))
    return out


@pytest.mark.parametrize("most_pieces", [20_000, 3])
def test_suffixes(spark, most_pieces):
    rng = random.Random(4)
    text = lambda n, letters="abcdeñ": "".join(rng.choice(letters) for _ in range(n))
    shared, periodic = text(120), "xyz" * 60
    texts = [None, "", "short", text(300) + shared + text(50), shared, text(70) + shared[:60] + text(70), text(9) + shared[30:] + text(9), periodic, text(40) + periodic[:70], text(200), "a" * 150, "é" * 80]
    texts += [text(30) + shared[10:70] + text(30) for _ in range(8)] + [texts[3], texts[3]]
    df = docs(spark, texts).withColumn("_id", F.lit(1)).withColumn("spans", F.lit("x"))
    got = {r.doc_id: r for r in suffixes.without_repeats(df, window=40, gram=16, core=32, most_pieces=most_pieces).collect()}
    for i, (n, kept) in enumerate(brute_removed(texts, 40)):
        assert (sum(x.b - x.a for x in got[i]._removed), bytes(got[i]._kept)) == (n, kept), i
        assert got[i].spans == "x" and got[i].text == texts[i]


def test_suffixes_null_and_repeated_ids(spark):
    t = "".join(random.Random(5).choice("abcd") for _ in range(100))
    rows = [(None, t, None, None, None), (7, t, None, None, None), (7, t, None, None, None), (7, "other", None, None, None)]
    got = suffixes.without_repeats(spark.createDataFrame(rows, DOC), window=40, gram=16, core=32).collect()
    assert sorted(len(r._kept) for r in got) == [0, 0, 0, 5]
    assert suffixes.without_repeats(empty(spark)).count() == 0
    assert suffixes.digest(empty(spark)).count() == 0


def test_cleaned_drops_half_characters(spark):
    t = "".join(random.Random(6).choice("abcd") for _ in range(60))
    got = {r.doc_id: r for r in suffixes.cleaned(docs(spark, [t + "é1", "2é" + t, None]), window=40, gram=16, core=32).collect()}
    assert got[0].text == "é1" and got[0].n_chars == 2 and got[2].text is None


def test_collection_suffixes():
    rng = random.Random(3)
    for _ in range(60):
        given = [np.array([rng.randrange(3) for _ in range(rng.randrange(12))], np.uint16) for _ in range(rng.randrange(1, 8))]
        doc, start, lcp = suffixes.collection_suffixes(given, 5)
        rows = [tuple(given[d][s:].tolist()) for d, s in zip(doc, start, strict=True)]
        assert rows == sorted(rows) and len(rows) == sum(len(g) + 1 for g in given)
        for i in range(1, len(rows)):
            same = next((k for k, (x, y) in enumerate(zip(rows[i - 1], rows[i], strict=False)) if x != y), min(len(rows[i - 1]), len(rows[i])))
            assert lcp[i] == min(same, 5)


# 2


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", rng.choice(["big", "big", "big", "b", "c", None]), 0) for i in range(900)] + [(5, None, None, "c", None), (5, None, None, "c", None), (None, "x y", None, "zero", None)]
    df = spark.createDataFrame(rows, DOC).withColumn("_size", F.lit("mine"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r._copies <= 2 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r._source_size, r._target, 0])[2] += r._copies * r._size
    total = sum(v[0] for v in by.values())
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * total)
    for size, target, taken in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 130
    again = {(r.doc_id, r.text): r._copies for r in mixing.mix(df.repartition(7)).collect()}
    assert all(again[r.doc_id, r.text] == r._copies for r in got if r.text)
    assert mixing.mixed(df).count() == sum(r._copies for r in got) and mixing.mixed(df).columns == df.columns
    assert mixing.mix(empty(spark)).count() == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 200 and got["c"] == 0 and got[None] == 20 and got["b"] == pytest.approx(1665 - 220)


# 3


@pytest.mark.parametrize("scale", [1, 10])
def test_topk(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).round(2) * scale
    x[100:180] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [1.0, None] + [0.0] * 4), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    q = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    s = q @ q.T
    want = {(i, k + 1): (j, int(s[i, j])) for i in range(0, 300, 50) for k, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(v, v.where("vec_id % 50 = 0")).collect()} == want
    assert topk.search(v.where("vec_id < 3"), v.where("vec_id = 0")).count() == 2
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


# 4


def test_language(spark):
    rng = random.Random(3)
    stems = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "ung", "ein", "über"], "fr": ["eau", "ment", "que", "çon"], "es": ["ción", "ado", "que", "ñ"]}
    make = lambda c: " ".join("".join(rng.choice(stems[c]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    langs = [rng.choice(list(stems)) for _ in range(300)]
    texts = [make(c) for c in langs]
    texts[3], texts[4], texts[5], texts[6] = None, "", "123 ... !", "the " * 300_000
    langs[10] = None
    got = {r.doc_id: r for r in language.identify(docs(spark, texts, langs)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5)) and got[6].lang_pred == "en"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    ok = [got[i].lang_pred == langs[i] for i in got if got[i].held_out and i > 6 and langs[i]]
    assert sum(ok) / len(ok) > 0.98 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(docs(spark, ["abc", None], [None, None])).collect()} == {"und"}
    assert language.identify(empty(spark)).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 20):
        code = language.codewords(n)
        assert len({tuple(c) for c in code}) == n and not (code.all(0) | ~code.any(0)).any()


# 5


def brute_links(rows, cosine=0.98):
    ok = [(i, np.array(v, float), c) for i, v, c in rows if v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    n = dict.fromkeys(parent, 0)
    for a in range(len(ok)):
        for b in range(a):
            (i, x, c), (j, y, d) = ok[a], ok[b]
            if c == d and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in parent}


def test_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3])).astype(np.float32)], int(i % 3)) for i in range(400)]
    rows += [(400 + i, rows[0][1], 0) for i in range(50)] + [(450, None, 0), (451, [0.0] * 16, 0), (452, [None] + [1.0] * 15, 0), (453, [float("nan")] * 16, 0), (454, rows[0][1], None), (455, [2 * x for x in rows[0][1]], 0), (456, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == brute_links(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "PROBES", 3)
    monkeypatch.setattr(vectors, "LISTS", 3)
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(5, 16))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=16) * rng.choice([0.02, 0.12])).astype(np.float32)], int(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()} == brute_links(rows)


# 6


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: ". ".join(words(rng, 12).capitalize() for _ in range(rng.randrange(3, 30))) + "."
    bad = [lambda: words(rng, 80).upper() + "!!!", lambda: " ".join(w + rng.choice(["###", "$$$"]) for w in words(rng, 80).split()), lambda: (words(rng, 6) + "\n") * 40]
    y = [int(rng.random() < 0.7) for _ in range(600)]
    texts = [good() if v else rng.choice(bad)() for v in y]
    texts[0], texts[1] = None, ""
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)] + [(2, 1 - y[2], 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts)
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    right = [got[i].predicted == y[i] for i in range(2, 600) if got[i].held_out]
    assert sum(right) / len(right) > 0.97
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0
    kept = quality.accepted(df, quality.fit(df, labels))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


# 7


def test_bpe_round_trip(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    odd = ["a", "the", "ing", "\n", " ", "  ", "é", "汉", "😀", "́", "123", "###", "'ll", "\x00", "　", "<|endoftext|>", "a" * 50, "Ω"]
    texts = [None, "", "x" * 5000, "naïve 😀 " * 2000] + ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = docs(spark, texts).withColumn("ids", F.lit("clash"))
    for r in bpe.round_trip(df, path, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = own.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoded = bpe.encode(df, path, P.PATTERN, offsets=True)
    for r in bpe.decode(encoded, path).collect():
        t = texts[r.doc_id] or ""
        assert bytes(r.decoded).decode() == t and r.ids == own.encode_ordinary(t)
        assert len(r.starts) == len(r.ids) and all(0 <= a <= b <= len(t) for a, b in zip(r.starts, r.ends, strict=True))
    assert bpe.round_trip(empty(spark), path, P.PATTERN).count() == 0


# 8


def brute_passages(texts, n=50):
    where = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        for k in range(len(w) - n + 1):
            where.setdefault(tuple(w[k : k + n]), set()).add(i)
    return set().union(*(v for v in where.values() if len(v) > 1))


@pytest.mark.parametrize("least", [60, 200])
def test_long_passages(spark, least):
    """Of 60 pairs that share 260 words each none is lost, also where passages are longer than 131 words."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        shared = words(rng, 260, 100_000)
        texts += [f"{words(rng, rng.randrange(5, 90), 100_000)} {shared} {words(rng, 20, 100_000)}" for _ in range(2)]
    got = {r.doc_id: r.component_id for r in passages.near_passages(docs(spark, texts), words=least).collect()}
    assert got == {i: i - i % 2 for i in range(120)}
    with pytest.raises(ValueError):
        passages.near_passages(docs(spark, texts), words=1 << 15)


def test_passages(spark):
    rng = random.Random(9)
    common = words(rng, 70, 5000)
    near = common.split()
    near[20] = "changed"
    texts = [None, "", words(rng, 49, 5000)] + [f"{words(rng, rng.randrange(30, 200), 5000)} {common if i % 3 == 0 else ''} {words(rng, 40, 5000)}" for i in range(60)]
    texts += [texts[10], texts[10], "tail " + " ".join(near), (words(rng, 60, 5000) + " ") * 3, words(rng, 10), words(rng, 10)]
    got = {r.doc_id: r for r in passages.near_passages(docs(spark, texts)).collect()}
    exact = brute_passages(texts)
    assert exact <= set(got) and set(got) - exact <= {65}
    groups = {got[i].component_id for i in exact if common in texts[i]}
    assert len(groups) == 1
    for i in exact:
        w = texts[i].lower().split()
        if common in texts[i]:
            at = next(k for k in range(len(w)) if w[k : k + 70] == common.split())
            assert any(p.start <= at + 2 and p.end >= at + 68 for p in got[i].passages)
    assert passages.near_passages(empty(spark)).count() == 0


def brute_segments(match, least, percent):
    covered = set()
    for i in range(len(match)):
        for j in range(i + least, len(match) + 1):
            m = int(match[i:j].sum())
            if 100 * m >= percent * (2 * (j - i) - m):
                covered.update(range(i, j))
    return covered


def test_segments_cover_every_alike_stretch():
    rng = np.random.default_rng(6)
    cases = [rng.random(rng.integers(0, 40)) < rng.choice([0.5, 0.85, 0.95]) for _ in range(300)]
    for match in cases:
        found, covered = passages.segments(match, 9, 80), brute_segments(match, 9, 80)
        places = {k for s, e in found for k in range(s, e)}
        assert places <= covered and {k for k in covered if match[k]} <= places
        assert all(e - s >= 9 for s, e in found)


def test_segments_with_changed_words_at_every_place():
    for n in (50, 70):
        for k in range(n):
            match = np.zeros(n + 56, bool)
            match[30 : 30 + n - 4] = True
            match[max(30, 26 + k) : 31 + k] = False
            assert passages.segments(match, 46, 80), (n, k)
    for k in range(100):
        for j in range(k):
            match = np.ones(96, bool)
            match[max(0, k - 4) : k + 1] = False
            match[max(0, j - 4) : j + 1] = False
            assert passages.segments(match, 46, 80), (j, k)


def test_segments_after_a_long_one():
    for gap in range(1, 120):
        for long in (60, 500):
            match = np.array([False] * 20 + [True] * long + [False] * gap + [True] * 60 + [False] * 20)
            for m in (match, match[::-1]):
                places = {k for s, e in passages.segments(m, 46, 80) for k in range(s, e)}
                assert set(np.flatnonzero(m).tolist()) <= places, (gap, long)


def test_passages_with_a_changed_word(spark):
    rng = random.Random(12)
    texts = []
    for k in range(0, 70, 3):
        common = words(rng, 70, 5000).split()
        changed = [*common[:k], "changed", *common[k + 1 :]]
        texts += [f"{words(rng, 40, 5000)} {' '.join(w)} {words(rng, 40, 5000)}" for w in (common, changed)]
    got = {r.doc_id: r for r in passages.near_passages(docs(spark, texts)).collect()}
    assert set(got) == set(range(len(texts)))
    assert all(got[i].component_id == i // 2 * 2 for i in got)


@pytest.mark.parametrize("tile", [1024, 4])
def test_passages_of_common_lines(spark, monkeypatch, tile):
    monkeypatch.setattr(passages, "TILE", tile, raising=False)
    rng = random.Random(21)
    lines = [words(rng, 10, 5000) for _ in range(12)]
    texts = []
    for _ in range(60):
        common = " ".join(rng.sample(lines, 5))
        texts += [f"{words(rng, 40, 5000)} {common} {words(rng, 40, 5000)}" for _ in range(2)]
    got = {r.doc_id: r for r in passages.near_passages(docs(spark, texts)).collect()}
    assert set(got) == brute_passages(texts) == set(range(120))
    for i in range(0, 120, 2):
        assert got[i].component_id == got[i + 1].component_id
        assert all(any(p.start <= 40 and p.end >= 90 for p in got[k].passages) for k in (i, i + 1))
    assert all(r.n_component == sum(q.component_id == r.component_id for q in got.values()) for r in got.values())


def test_windows_of_a_tile_are_compared_together(monkeypatch):
    """80 windows that share most of their places, but no passage with most of the others: some passes, not one for each of
    3160 pairs, and what is found is what two windows alone give."""
    rng = np.random.default_rng(4)
    lines = rng.integers(0, 1 << 32, (40, 20), dtype=np.uint32)
    h = [np.concatenate([lines[k] for k in rng.permutation(40)[:25]]) for _ in range(80)]
    for k in range(0, 80, 8):
        h[k + 1][100:170] = h[k][30:100]
    frame = pd.DataFrame({"signature": 1, "lo": 0, "hi": 0, "part": 0, "tid": range(80), "component": range(80), "covered": False, "l": 0, "c": 500, "h": [x.tobytes() for x in h]})
    calls, alike = [], passages.alike
    monkeypatch.setattr(passages, "alike", lambda *a: calls.append(1) or alike(*a))
    found = passages.compare_tile(frame, 80, 50)
    assert 0 < len(calls) < 40
    words = lambda rows, k: {w for a, _, p, _ in rows if a == k for s in p for w in range(s["start"], s["end"])}
    pairs = [passages.compare_tile(frame.iloc[[j, i]], 80, 50) for i in range(80) for j in range(i)]
    for k in range(80):
        assert words(found, k) == words([r for rows in pairs for r in rows], k)
    edges = [np.array([(a, b) for a, b, _, _ in rows if a != b]).T for rows in (found, [r for rows in pairs for r in rows])]
    one, other = (common.forest(*e) for e in edges)
    assert all((x == y).all() for x, y in zip(one, other, strict=True)) and len(one[0]) >= 10


def test_windows_of_texts_are_those_of_each():
    rng = random.Random(8)
    texts = [None, "", "short", words(rng, 300, 900), ("a b c d e f g h " * 40), "é ü " * 90, words(rng, 70, 50) + " " + "x" * 200 + " " + "x" * 199 + "y " + words(rng, 60, 50), words(rng, 46, 9000)]
    whole = passages.shingle_hashes(texts)
    alone = [passages.shingle_hashes([t]) for t in texts]
    assert whole[1].tolist() == [int(s[0]) for _, s in alone] == [max(len((t or "").split()) - 4, 0) for t in texts]
    assert (whole[0] == np.concatenate([h for h, _ in alone])).all()
    by_words = {}
    for t, (h, _) in zip(texts, alone, strict=True):
        w = (t or "").split()
        for k, x in enumerate(h.tolist()):
            assert by_words.setdefault(x, w[k : k + 5]) == w[k : k + 5]
    assert len(by_words) == len({tuple(w) for w in by_words.values()})
    rows = {tuple(int(v) for v in r) for r in zip(*passages.windows_of(*whole, 46, 0), strict=True)}
    assert rows == {(i, int(k), int(p)) for i, (h, s) in enumerate(alone) for _, k, p in zip(*passages.windows_of(h, s, 46, 0), strict=True)} and rows


def test_compact_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(3)
    for _ in range(100):
        h = rng.integers(0, rng.choice([5, 1000]), rng.integers(0, 30)).astype(np.uint64)
        found = list(passages.compact_windows(h, 4))
        for i in range(len(h)):
            for j in range(i + 3, len(h)):
                holds = [c for left, c, right in found if left <= i <= c <= j <= right]
                assert holds == [i + int(h[i : j + 1].argmin())]


# 9


def test_sharding(spark, tmp_path):
    texts = [None, ""] + [f"text {i % 7}" * (i % 5) for i in range(3000)]
    df = docs(spark, texts).union(spark.createDataFrame([(7, "again", None, None, None), (7, "again", None, None, None), (None, "x", None, None, None)], DOC))
    now = sharding.first_map(spark, 40)
    got = sharding.shard(df, now, sharding.add_shard(now, 40)).collect()
    assert len(got) == df.count() and {r.shard for r in got} == set(range(40))
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 40) for r in got) and any(r.grown_shard == 40 for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    counts = [x["count"] for x in now.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    sharding.write_map(now, str(tmp_path / "maps"))
    levelled = sharding.rebalance(now, sharding.slot_bytes(df), 40)
    sharding.write_map(levelled, str(tmp_path / "maps"))
    stored = sharding.read_map(spark, str(tmp_path / "maps"), 2)
    assert stored.count() == sharding.SLOTS and stored.select("virtual_slot").distinct().count() == sharding.SLOTS
    load = lambda m: [r.b for r in m.join(sharding.slot_bytes(df), "virtual_slot").groupBy("shard").agg(F.sum("n_bytes").alias("b")).collect()]
    assert max(load(stored)) <= max(load(now))
    assert sharding.shard(empty(spark), now).count() == 0


def test_sharding_by_brute_force(spark, tmp_path):
    """Shards, grown shards, places and bytes from a plain version; hot null ids and many equal rows."""
    rng = random.Random(4)
    rows = [(rng.choice([None, None, *range(500)]), rng.choice([None, "", "same", "é", f"t{i}"])) for i in range(3000)] + [(7, "again")] * 900
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC).withColumn("slot", F.lit("mine")).withColumn("shard", F.lit(-1)).withColumn("id", F.lit(0))
    now, more = sharding.grown(spark, 40, str(tmp_path / "maps"))
    got = sharding.shard(df, now, more).collect()
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    order = sorted(range(4096), key=lambda v: (number(f"{v}:deal"), v))
    home = {v: i % 40 for i, v in enumerate(order)}
    turns = sorted((sorted((w for w in home if home[w] == home[v]), key=lambda w: (number(f"{w}:grow40"), w)).index(v), home[v], v) for v in range(4096))
    moved = {v for _, _, v in turns[: 4096 // 41]}
    raw = lambda t: (t or "").encode()
    key = lambda i: number("null" if i is None else str(i)) % 4096
    records = sorted(((home[key(i)], key(i), zlib.crc32(raw(t)) % 16, i is not None, i or 0, zlib.crc32(raw(t)), len(raw(t)) + 16), i) for i, t in rows)
    size = {}
    for (_, v, *_, n), _ in records:
        size[v] = size.get(v, 0) + n
    want, at = [], {}
    for (shard, v, _, _, _, crc, n), i in records:
        want.append((i, n, crc, shard, at.setdefault(shard, 0), 40 if v in moved else shard, v, size[v]))
        at[shard] += 1
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard, r.virtual_slot, r.slot_bytes)) for r in got)


# 10


def brute_near(texts, length, percent):
    sets = [minhash.shingles(t, length) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("length, leaders, tile", [(2, 2, 1024), (5, 2, 1024), (2, 1, 3)])
def test_minhash(spark, monkeypatch, length, leaders, tile):
    monkeypatch.setattr(minhash, "LEADERS", leaders)
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = random.Random(7)
    base = [words(rng, rng.randrange(20, 150), 3000) for _ in range(40)]
    texts = [None, "", " \n", "One", "one", "one two", "É x", "é x"] + base
    for b in base[:20]:
        for _ in range(rng.randrange(1, 8)):
            w = b.split()
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    texts += [base[0]] * 30 + [base[1] * 400]
    df = docs(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, length=length).collect()}
    assert got == brute_near(texts, length, 80)
    kept = minhash.one_of_each(df, length=length)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_null_and_repeated_ids(spark):
    rows = [(None, "a b c", None, None, None), (None, "a b c", None, None, None), (3, "a b c", None, None, None), (3, "x y z", None, None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC), length=2).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("3", "3", True), ("3", "3", True), ("None", "None", True), ("None", "None", True)]
    rng = random.Random(3)
    a, b = words(rng, 60), words(rng, 60)
    near = b.rsplit(" ", 1)[0] + " other"
    for order in ([(3, a), (3, b), (5, near)], [(3, b), (3, a), (5, near)], [(5, near), (3, a), (3, b), (3, b)]):
        df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in order], DOC).withColumn("rep", F.lit(1)).withColumn("th", F.lit(2)).withColumn("component", F.lit("x"))
        assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()} == {(3, 3), (5, 3)}
        kept = minhash.one_of_each(df)
        assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, a), (3, b)])


def test_forest_and_common_sizes():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 30)).astype(np.uint64)) for _ in range(rng.integers(2, 9))]
        split = int(rng.integers(1, len(sets) + 1))
        other = sets[split:] if split < len(sets) else sets
        got, wanted = minhash.common_sizes(sets, split), np.array([[len(np.intersect1d(x, y)) for y in other] for x in sets[:split]])
        assert (got == wanted)[[[x is not y for y in other] for x in sets[:split]]].all()
        pairs = rng.integers(0, 12, (rng.integers(0, 10), 2))
        rep = np.arange(12) * 10
        tree = minhash.forest(pairs, rep)
        join = lambda edges: {frozenset(g) for g in groups(edges)}
        assert join([(rep[a], rep[b]) for a, b in pairs]) == join(tree.tolist()) and len(tree) <= 12


def groups(edges):
    out = {}
    for a, b in edges:
        g = out.get(a, {a}) | out.get(b, {b})
        for x in g:
            out[x] = g
    return [g for g in out.values() if len(g) > 1]


def test_likelihood_estimate():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        shared = rng.integers(0, 2**63, int(2000 * j)).astype(np.uint64)
        rest = [rng.integers(0, 2**63, int(1000 * (1 - j))).astype(np.uint64) for _ in range(2)]
        x, y = (np.concatenate([shared, r]) for r in rest)
        a, b = minhash.registers(x), minhash.registers(y)
        true = len(shared) / (len(shared) + len(rest[0]) + len(rest[1]))
        got = minhash.similarity(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([float(len(x))]), np.array([float(len(y))]))[0]
        assert abs(got - true) < 0.1
        assert (np.maximum(a, b) == minhash.registers(np.concatenate([x, y]))).all()


@pytest.mark.parametrize("order", ["falling", "rising", "random"])
def test_connected_chain(spark, order):
    n = 10_000 if order == "random" else 1000
    at = list(range(n))
    if order == "random":
        random.Random(1).shuffle(at)
    edges = [(at[i + 1], at[i]) if order == "falling" else (at[i], at[i + 1]) for i in range(n - 1)]
    random.Random(2).shuffle(edges)
    got = connected(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()
    assert len(got) == n and {r.component for r in got} == {0}


def test_forest_joins_the_same(spark):
    rng = np.random.default_rng(2)
    for _ in range(50):
        pairs = rng.integers(0, 30, (rng.integers(1, 40), 2)) * 10**12
        a, b = common.forest(*pairs.T)
        join = lambda edges: {frozenset(g) for g in groups(edges)}
        assert join(pairs.tolist()) == join(list(zip(a.tolist(), b.tolist(), strict=True))) and (a < b).all()
    big = spark.range(3000).selectExpr("id as a", "id + 1 as b").union(spark.range(3000).selectExpr("id as a", "0 as b"))
    assert common.forests(big, block=64).count() < 6001


def test_connected(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        return a if parent[a] == a else find(parent[a])

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {a: find(a) for a in parent}


@pytest.mark.parametrize("overlap", [25, 32])
def test_passages_that_overlap_in_one_text(spark, overlap):
    """Of three texts, one shares its start with the second and its end with the third, which share less with each other:
    equal passages agree on every hash, so none is lost, whoever meets whom first."""
    rng = random.Random(31)
    texts = []
    for _ in range(400):
        shared = [f"w{rng.randrange(10**9)}" for _ in range(100 - overlap)]
        fill = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(30))
        texts += [f"{fill()} {' '.join(part)} {fill()}" for part in (shared, shared[:50], shared[-50:])]
    got = {r.doc_id: r for r in passages.near_passages(docs(spark, texts)).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: i - i % 3 for i in range(len(texts))}
    assert all(r.n_component == 3 for r in got.values())
    for i, r in got.items():
        assert any(p.start <= 30 and p.end >= 30 + (100 - overlap if i % 3 == 0 else 50) for p in r.passages)


def test_parts_of_ranges_that_are_not_alike_as_a_whole():
    rng = random.Random(5)
    one = words(rng, 133, 10**6).split()
    other = [*one[:27], "x", "y", "z", *one[30:86], *one[87:91], "u", *one[92:]]
    h, size = passages.shingle_hashes([" ".join(one), " ".join(other)])
    a, b = (x.astype(np.uint32) for x in np.split((h >> np.uint64(32)), [size[0]]))
    names = passages.distinct(b)
    found = passages.alike(a, size[:1], passages.numbered(names, a), b, np.searchsorted(names, b), np.array([0]), size[1:], len(names), 80, 50)
    assert {k for _, s, e, _, _ in found.tolist() for k in range(s, e)} >= set(range(30, 131))
