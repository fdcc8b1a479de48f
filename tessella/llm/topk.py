"""Operator 3, exact top-k search by a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, drawn from the vectors; vectors and queries that a task holds of one pivot; vectors of an annulus.
PIVOTS, PART, QUERIES, RING = 128, 1024, 4096, 128


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v) with v the components floor(scale * x); rows with a null id, no vector or bad components are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    ok = vectors.where(x.isNotNull() & F.col(id_col).isNotNull()).where(~bad)
    return ok.select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in floats where no sum can pass 2**53, so that nothing is rounded."""
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if exact else a @ b.T


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest inner products of each query among all vectors but its own: (query_id, rank, vec_id, score).

    Both are (vec_id, v array<long>); shorter vectors count as ended by zeros; ties go to the smaller vec_id; queries that
    repeat an id are asked once, vectors that repeat one are each found; fewer vectors give fewer rows, none give none.
    Sums must fit a long.

    A further component brings all vectors to one norm, so the largest product is the least distance. Each vector is
    keyed by its nearest pivot and the distance to it. A task has one pivot's vectors (at most about PART; a fuller pivot
    is dealt over several tasks) and the queries that may find something there. It expands the sorted annuli around each
    query's own distance, and drops those whose distance differs from the query's by more than the k-th best so far: by
    the triangle inequality nothing nearer lies in them. That best starts from the pivots, which are vectors themselves.
    """
    spark = vectors.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    top = vectors.union(queries).select(F.max(squares).alias("m"), F.max(F.size("v")).alias("d")).first()
    if top["m"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    m2, width = float(top["m"]), max(int(top["d"]), 1)
    exact = m2 < 2**52
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(PIVOTS).toPandas()
    pivots = spark.sparkContext.broadcast((drawn["vec_id"].to_numpy(), _matrix(drawn["v"], width)))

    def distances(x: np.ndarray, lifted: bool) -> np.ndarray:
        """To every pivot; queries have no further component."""
        p = pivots.value[1].astype(float)
        x = x.astype(float)
        own, theirs = (x * x).sum(1), (p * p).sum(1)
        cross = x @ p.T + (np.sqrt(np.maximum(m2 - own, 0))[:, None] * np.sqrt(np.maximum(m2 - theirs, 0)) if lifted else 0)
        return np.sqrt(np.maximum((m2 if lifted else own)[:, None] + m2 - 2 * cross, 0) if not lifted else np.maximum(2 * m2 - 2 * cross, 0))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"], width)
                d = distances(x, True)
                at = d.argmin(1)
                yield pd.DataFrame({"pivot": at.astype(np.int32), "id": b["vec_id"], "d": d[np.arange(len(b)), at], "x": [r.tobytes() for r in x]})

    index = vectors.mapInPandas(keyed, "pivot int, id long, d double, x binary")
    spans = index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    # one row a pivot
    known = spark.sparkContext.broadcast(spans.toPandas())
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    turns = max(1, -(-asked.count() // QUERIES))

    def posed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query for each part of each pivot that its bound doesn't exclude."""
        ids, p = pivots.value
        for b in batches:
            if not len(b):
                continue
            x, own_ids = _matrix(b["v"], width), b["vec_id"].to_numpy()
            d = distances(x, False)
            s = _products(x, p, exact).astype(float)
            s[own_ids[:, None] == ids] = -np.inf
            bound = np.sort(s, axis=1)[:, -k] if len(ids) >= k else np.full(len(b), -np.inf)
            own = (x.astype(float) ** 2).sum(1)
            reach = np.sqrt(np.maximum(own + m2 - 2 * bound, 0))
            for r in known.value.itertuples(index=False):
                dq = d[:, r.pivot]
                slack = 1e-6 * (1 + dq + r.hi)
                at = np.flatnonzero((dq - r.hi <= reach + slack) & (r.lo - dq <= reach + slack))
                for part in range(r.parts if len(at) else 0):
                    yield pd.DataFrame({"pivot": np.int32(r.pivot), "part": np.int32(part), "turn": (own_ids[at] % turns).astype(np.int32), "id": own_ids[at], "d": dq[at], "bound": bound[at], "x": [x[i].tobytes() for i in at]})

    left = asked.mapInPandas(posed, "pivot int, part int, turn int, id long, d double, bound double, x binary")
    parts = {r.pivot: r.parts for r in known.value.itertuples(index=False)}
    of = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("pivot"))
    right = index.withColumn("part", F.pmod(F.xxhash64("id", "x"), of).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def expand(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        if not len(q) or not len(v):
            return none
        v = v.sort_values("d")
        x, ids, d = np.frombuffer(b"".join(v["x"]), np.int64).reshape(len(v), width), v["id"].to_numpy(), v["d"].to_numpy()
        qx, qid, dq = np.frombuffer(b"".join(q["x"]), np.int64).reshape(len(q), width), q["id"].to_numpy(), q["d"].to_numpy()
        own, kth = (qx.astype(float) ** 2).sum(1), q["bound"].to_numpy().copy()
        starts = np.arange(0, len(v), RING)
        lo, hi = d[starts], d[np.minimum(starts + RING, len(v)) - 1]
        low = np.maximum(np.maximum(dq[:, None] - hi, lo - dq[:, None]), 0)
        found = [np.zeros(0, np.int64)] * 3
        for ring in np.argsort(low.mean(0), kind="stable"):
            reach = np.sqrt(np.maximum(own + m2 - 2 * kth, 0))
            near = np.flatnonzero(low[:, ring] <= reach + 1e-6 * (1 + reach + low[:, ring]))
            if not len(near):
                continue
            part = slice(starts[ring], starts[ring] + RING)
            s = _products(qx[near], x[part], exact)
            a, c = np.nonzero((s >= kth[near, None]) & (qid[near, None] != ids[part]))
            new = [np.concatenate(p) for p in zip(found, (near[a], s[a, c], ids[part][c]), strict=True)]
            order = np.lexsort((new[2], -new[1], new[0]))
            new = [n[order] for n in new]
            first = np.searchsorted(new[0], new[0])
            place = np.arange(len(first)) - first
            found = [n[place < k] for n in new]
            last = place == k - 1
            kth[new[0][last]] = np.maximum(kth[new[0][last]], new[1][last])
        return pd.DataFrame({"query_id": qid[found[0]], "vec_id": found[2], "score": found[1]})

    hits = left.groupBy("pivot", "part", "turn").cogroup(right.groupBy("pivot", "part", "turn")).applyInPandas(expand, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
