"""Operator 1, suffix-array dedup: bytes covered by a string of `window` bytes that starts more than once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import anchors
from tessella.llm.common import stored, trimmed

#: A string's bytes; of the grams by which texts are cut, first into runs, then into pieces.
WINDOW, GRAM, CORE = 400, 128, 352
#: Symbols that are sorted together, and pieces with one core that a task takes whole.
BATCH, PIECES = 1 << 18, 20_000


def collection_suffixes(docs: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of a collection: (doc, start, lcp) by row, lcp with the row before, counted up to depth.

    Column-wise: round j puts the suffix of length j of every document into the order, all at once. Its row follows from
    the transform: after the rows of smaller symbols come those of its symbol, in the order of that symbol in the
    transform. Then the transform gets the symbol before it, and its common prefixes with both neighbours are updated.
    The arrays are read in sequence only, once a round. Documents end in markers of their own, smaller than all symbols.
    """
    n = len(docs)
    size = np.array([len(d) for d in docs], np.int64)
    most = int(size.max(initial=0))
    back = np.zeros((n, most + depth + 1), np.uint16)  # text from its end, symbols from 1
    for i, d in enumerate(docs):
        back[i, : len(d)] = d[::-1].astype(np.uint16) + 1
    bwt = back[:, 0].copy()
    row_doc, row_len, lcp = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    pos, active = np.arange(n), np.arange(n)
    for j in range(1, most + 1):
        keep = size[active] >= j
        active, pos = active[keep], pos[keep]
        order = np.argsort(bwt, kind="stable")
        ends = np.count_nonzero(bwt == 0)
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        at = n + rank[pos] - ends
        by = np.argsort(at)
        active, at = active[by], at[by]
        old = np.ones(len(bwt) + len(at), bool)
        old[at] = False

        def put(a: np.ndarray, new, old=old, at=at) -> np.ndarray:
            out = np.empty(len(old), a.dtype)
            out[old], out[at] = a, new
            return out

        bwt, row_doc, row_len, lcp = put(bwt, back[active, j]), put(row_doc, active), put(row_len, j), put(lcp, 0)
        pos = at
        after = at[at + 1 < len(old)] + 1
        rows = np.unique(np.concatenate([at[at > 0], after]))
        same = np.zeros(len(rows), np.int64)
        go = np.arange(len(rows))
        a, b = (row_doc[rows - 1], row_len[rows - 1]), (row_doc[rows], row_len[rows])
        for k in range(depth):
            x, y = a[1][go] - 1 - k, b[1][go] - 1 - k
            live = (x >= 0) & (y >= 0)
            go, x, y = go[live], x[live], y[live]
            go = go[back[a[0][go], x] == back[b[0][go], y]]
            if not len(go):
                break
            same[go] += 1
        lcp[rows] = same
    return row_doc, size[row_doc] - row_len, lcp


def repeated_windows(pieces: list[tuple[bytes, bytes]], cores: np.ndarray, core: int, window: int) -> list[np.ndarray]:
    """For each piece (bytes before its core, bytes after), True for each of its windows that another piece, or it, has too.

    A core is one symbol, a different one for each value, so equal windows are equal strings of window - core + 1 symbols.
    """
    depth = window - core + 1
    _, name = np.unique(cores, return_inverse=True)
    docs = [np.concatenate([np.frombuffer(a, np.uint8).astype(np.uint16), [np.uint16(256 + c)], np.frombuffer(b, np.uint8)]) for (a, b), c in zip(pieces, name, strict=True)]
    doc, start, lcp = collection_suffixes(docs, depth)
    hit = lcp >= depth
    hit[:-1] |= lcp[1:] >= depth
    out = [np.zeros(max(len(d) - depth + 1, 0), bool) for d in docs]
    for i, s in zip(doc[hit], start[hit], strict=True):
        out[i][s] = True
    return out


def _ranges(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2).tolist()


def _pieces(text: bytes, window: int, core: int) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(start, count, key, content, before, after) of the parts of a run whose windows have their least gram, the first of
    equals, at one place."""
    raw = np.frombuffer(text, np.uint8)
    h = anchors.Hashes(raw)
    at = np.arange(len(raw) - core + 1)
    grams = h.of(at, at + core)
    least = anchors.sliding_min(grams, window - core + 1)
    windows, start = len(least), 0
    where = np.flatnonzero(anchors.sliding_min(np.concatenate([np.full(window - core, ~np.uint64(0)), ~least, np.full(window - core, ~np.uint64(0))]), window - core + 1) == ~grams)
    while start < windows:
        value = least[start]
        first = where[np.searchsorted(where, start) :]
        p = int(first[grams[first] == value][0])
        end = start + 1
        while end < windows and end <= p and least[end] == value:
            end += 1
        content = h.of(np.array([start]), np.array([end + window - 1]))[0]
        yield start, end - start, int(value.astype(np.int64)), int(content.astype(np.int64)), text[start:p], text[p + core : end + window - 1]
        start = end


def _bytes(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, core: int = CORE, most_pieces: int = PIECES) -> DataFrame:
    """docs (id long, th long, text string) to (id, th, spans array<struct<a int, b int>>): covered bytes of each text,
    unsorted and overlapping, where there are any. Rows with equal id and th (a hash of the text) have equal texts.

    Texts are cut into runs of windows that share their least gram. A run whose key no other run has, and that has it
    once, repeats nothing. Where all runs of a key are equal, all their windows repeat. What is left is cut again, by
    longer grams (cores), into pieces; a piece without its core is a few dozen bytes. Pieces of one core whose bytes
    differ go to one task, where the suffix order of the collection tells which windows repeat. A core with more than
    most_pieces different pieces isn't sorted in one task: its windows are hashed and counted as rows.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, th, texts = b["id"].to_numpy(), b["th"].to_numpy(), b["text"].tolist()
            for at in range(0, len(b), 256):
                for text, start, count, key, content, twice, _ in anchors.runs([_bytes(t) for t in texts[at : at + 256]], window, gram):
                    yield pd.DataFrame({"id": ids[at + text], "th": th[at + text], "start": start.astype(np.int32), "count": count.astype(np.int32), "key": key.view(np.int64), "content": content.view(np.int64), "twice": twice})

    runs = stored(docs.where(F.octet_length("text") >= window).mapInPandas(trimmed(cut), "id long, th long, start int, count int, key long, content long, twice boolean"), "runs")
    keys = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("c0"), F.max("content").alias("c1"), F.max("twice").alias("tw")).where("n > 1 or tw")
    shared = stored(runs.join(keys.select("key", (F.col("tw") | (F.col("c0") != F.col("c1"))).alias("hard")), "key").drop("twice"), "shared")
    whole = shared.where("not hard").select("id", "th", F.col("start").alias("a"), (F.col("start") + F.col("count") + window - 1).alias("b"))
    hard = shared.where("hard")
    # one occurrence stands for all equal runs
    one = hard.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "start", "count")).alias("r"))
    asked = one.groupBy(F.col("r.id").alias("id"), F.col("r.th").alias("th")).agg(F.collect_list(F.struct("key", "content", "n", F.col("r.start").alias("start"), F.col("r.count").alias("count"))).alias("asked"))

    def cut_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All runs asked of a batch are cut together; those that have their least gram twice, one by one."""
        for b in batches:
            parts, asked_as = [], []
            for text, rows in zip(b["text"], b["asked"], strict=True):
                raw = _bytes(text)
                for r in rows:
                    parts.append(raw[r["start"] : r["start"] + r["count"] + window - 1])
                    asked_as.append((r["key"], r["content"], r["n"]))
            for at in range(0, len(parts), 4096):
                out, some = [], parts[at : at + 4096]
                for found in anchors.runs(some, window, core):
                    text, start, count, key, content, twice, place = (c.view(np.int64).tolist() if c.dtype == np.uint64 else c.tolist() for c in found)
                    for i, s, n, k, c, again, p in zip(text, start, count, key, content, twice, place, strict=True):
                        t, end = some[i], s + n + window - 1
                        if again:
                            out += [(*asked_as[at + i], s + q[0], *q[1:]) for q in _pieces(t[s:end], window, core)]
                        else:
                            out.append((*asked_as[at + i], s, n, k, c, t[s : s + p], t[s + p + core : end]))
                if out:
                    yield pd.DataFrame(out, columns=["key", "content", "n", "start", "count", "core", "piece", "before", "after"])

    texts = docs.withColumnRenamed("id", "id2").withColumnRenamed("th", "th2")
    joined = asked.join(texts, (F.col("id") == F.col("id2")) & (F.col("th") == F.col("th2"))).select("id", "th", "asked", "text")
    pieces = stored(joined.mapInPandas(trimmed(cut_again), "key long, content long, n long, start int, count int, core long, piece long, before binary, after binary"), "pieces")
    # a repeated row gives its runs' pieces twice: n counts occurrences of a run, so equal pieces of one run are one
    distinct = pieces.groupBy("core", "piece", "key", "content", "start").agg(F.first("n").alias("n"), F.first("before").alias("before"), F.first("after").alias("after"), F.first("count").alias("count"))
    distinct = stored(distinct.groupBy("core", "piece").agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("after").alias("after"), F.first("count").alias("count")), "distinct")
    sizes = distinct.groupBy("core").agg(F.count("*").alias("d"))
    sized = distinct.join(sizes, "core")
    everything = F.array(F.array(F.lit(0), F.col("count")))
    plain = sized.where("d = 1 and n > 1").select("core", "piece", everything.alias("hits"))

    def sort_batch(rows: list) -> pd.DataFrame:
        marks = repeated_windows([(r[3], r[4]) for r in rows], np.array([r[0] for r in rows]), core, window)
        hits = [[[0, r[5]]] if r[2] > 1 else _ranges(m) for r, m in zip(rows, marks, strict=True)]
        return pd.DataFrame({"core": [r[0] for r in rows], "piece": [r[1] for r in rows], "hits": hits})

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by core; a batch ends where a core does."""
        rows, size = [], 0
        for b in batches:
            for r in b.itertuples(index=False, name=None):
                if size > BATCH and r[0] != rows[-1][0]:
                    yield sort_batch(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3]) + len(r[4]) + 1
        if rows:
            yield sort_batch(rows)

    mixed = sized.where((F.col("d") > 1) & (F.col("d") <= most_pieces)).select("core", "piece", "n", "before", "after", "count")
    ordered = mixed.repartition("core").sortWithinPartitions("core").mapInPandas(trimmed(sort), "core long, piece long, hits array<array<int>>")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, piece, n, before, after, count in b[["core", "piece", "n", "before", "after", "count"]].itertuples(index=False, name=None):
                for s in range(count):
                    d = len(before) - s
                    out.append((c, piece, n, s, hashlib.md5(b"%d " % d + before[s:] + after[: window - core - d]).digest()))
            if out:
                yield pd.DataFrame(out, columns=["core", "piece", "n", "s", "w"])

    single = sized.where(F.col("d") > most_pieces).mapInPandas(trimmed(windows), "core long, piece long, n long, s int, w binary")
    counted = single.groupBy("core", "w").agg(F.sum("n").alias("total")).where("total > 1")
    counted = single.join(counted, ["core", "w"]).groupBy("core", "piece").agg(F.collect_list(F.array(F.col("s"), F.col("s") + 1)).alias("hits"))
    hits = stored(plain.unionByName(ordered).unionByName(counted).where(F.size("hits") > 0), "hits")
    # hits of pieces back to runs, then to all places of the runs
    of_runs = pieces.select("key", "content", "start", "core", "piece").distinct().join(hits, ["core", "piece"]).select("key", "content", F.explode(F.transform("hits", lambda h: F.struct((h[0] + F.col("start")).alias("a"), (h[1] + F.col("start")).alias("b")))).alias("h"))
    of_runs = of_runs.groupBy("key", "content").agg(F.collect_list("h").alias("h"))
    found = hard.join(of_runs, ["key", "content"]).select("id", "th", F.explode(F.transform("h", lambda h: F.struct((h["a"] + F.col("start")).alias("a"), (h["b"] + F.col("start") + window - 1).alias("b")))).alias("s")).select("id", "th", "s.a", "s.b")
    return whole.unionByName(found).groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(found) -> list[tuple[int, int]]:
    """Maximal covered runs."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, as_text: bool = False, **options) -> DataFrame:
    """docs with `_removed`, the maximal runs of bytes that repeat, and `_kept`, the other bytes in order
    (as_text: as a string without the characters of which a byte is removed).

    Every text is its UTF-8 bytes, null is empty, and no string reaches over a document's end. Both places of a repeat
    are covered, in one document or two, overlapping or not; equal rows repeat each other; ids may be null or repeat.
    Texts shorter than window keep all; an empty table gives no rows. Other columns pass.
    """
    numbers = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    ident = F.coalesce(F.col(id_col).cast("long") if numbers else F.xxhash64(id_col), F.lit(-(2**63) + 1))
    base = docs.select(F.struct(*docs.columns).alias("row"), ident.alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    found = spans(base.select("id", "th", "text"), window, **options).select(F.col("id").alias("id2"), F.col("th").alias("th2"), "spans")
    joined = base.join(found, (F.col("id") == F.col("id2")) & (F.col("th") == F.col("th2")), "left").select("row", "text", "spans")
    ranges = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    schema = T.StructType([joined.schema["row"], T.StructField("_removed", ranges), T.StructField("_kept", T.StringType() if as_text else T.BinaryType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, s in zip(batch.column(1), batch.column(2), strict=True):
                raw, cuts = _bytes(text.as_py()), merged(s.as_py() or [])
                removed.append([{"a": x, "b": y} for x, y in cuts])
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(raw)], strict=True)))
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            out = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, kind), out], names=["row", "_removed", "_kept"])

    return joined.mapInArrow(trimmed(remove), schema).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("_removed", "_kept")), "_removed", "_kept")


def cleaned(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """docs with the text that is left, and its length where docs have one. A character of which a byte is removed goes
    as a whole; null texts stay null."""
    out = without_repeats(docs, text_col=text_col, as_text=True, **options)
    cut = F.size("_removed") > 0
    new = {text_col: F.when(cut, F.col("_kept")).otherwise(F.col(text_col))}
    if chars_col in docs.columns:
        new[chars_col] = F.when(cut, F.length("_kept")).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
    return out.withColumns(new).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    out = without_repeats(docs.select("doc_id", "text"))
    n = F.aggregate("_removed", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_removed"), F.size("_removed").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
