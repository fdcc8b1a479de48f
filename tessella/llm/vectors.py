"""Operator 5, near-duplicate embeddings by product quantisation with exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import connected, stored

COSINE = 0.98
#: Vectors that the quantisers are fitted on, at most; coarse lists; subspaces and codes of each.
SAMPLE, LISTS, SUBSPACES, CODES = 4096, 48, 8, 32
#: Vectors of a list, and probes, that a task compares.
BLOCK, PROBES = 1024, 2048


def _means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


def fit(x: np.ndarray) -> dict:
    """Coarse centroids and residual codebooks of unit vectors x."""
    rng = np.random.default_rng(5)
    coarse = _means(x, LISTS, rng)
    at = ((coarse * coarse).sum(1) - 2 * x @ coarse.T).argmin(1)
    cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    return {"coarse": coarse, "cuts": cuts, "books": [_means((x - coarse[at])[:, c], CODES, rng) for c in cuts]}


def _unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.asarray(v, np.float64) for v in column])
    scale = np.abs(x).max(1, keepdims=True)
    return x, (x / scale) / np.sqrt(((x / scale) ** 2).sum(1, keepdims=True))


def adc(r: np.ndarray, codes: np.ndarray, model: dict) -> np.ndarray:
    """Squared distances of residuals r to the coded ones, summed from tables of distances to each subspace's codes."""
    total = np.zeros((len(r), len(codes)), np.float32)
    for m, (cut, book) in enumerate(zip(model["cuts"], model["books"], strict=True)):
        part = r[:, cut]
        tables = np.maximum((part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T, 0).astype(np.float32)
        total += tables[:, codes[:, m]]
    return total


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Only vectors of one label and one length link. Vectors that are null, empty, zero or hold bad components, and rows
    with a null label or id, link with nothing and stay (component_id is their own id). Equal vectors are one class, its
    smallest id stands for it; its members link with each other. A row that repeats an id is a vector of its own.

    Unit vectors link if they are no farther apart than t = sqrt(2 - 2 cosine). A vector can only have links across the
    plane between its own and another centroid if it lies within t of that plane; it probes all such lists, so probing
    loses nothing. In a list, the table-lookup distance less the coded vector's own error bounds the distance from
    below; pairs within t by that bound get their exact cosine in doubles. Lists and probes are cut into blocks. A task
    gives counts and a spanning forest of the links it finds, not the pairs: a dense list costs its size, not its square,
    in rows.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists(x, lambda c: c != 0)
    fine = x.isNotNull() & (F.size(x) > 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("vec_id"), x.alias("v"), F.col(label_col).alias("label"), F.when(fine, ~bad).otherwise(False).alias("ok"))
    ok = rows.where(F.coalesce("ok", F.lit(False))).select("vec_id", F.transform("v", lambda c: c + F.lit(0.0).cast(vectors.schema[vector_col].dataType.elementType)).alias("v"), "label")
    classes = stored(ok.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    models = {}
    for (length,) in classes.select(F.size("v")).distinct().collect():  # vectors of one table have one length, or few
        drawn = classes.where(F.size("v") == length).orderBy(F.xxhash64("rep", F.lit(5))).limit(SAMPLE).select("v").toPandas()
        models[length] = fit(_unit(drawn["v"])[1])
    sent = spark.sparkContext.broadcast(models)
    reach = np.sqrt(max(2 - 2 * cosine, 0)) + 1e-6

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every class in its list, and as a probe of that and of the later lists that may hold links."""
        for whole in batches:
            for length, b in whole.groupby(whole["v"].map(len)):
                model = sent.value[length]
                raw, u = _unit(b["v"])
                c = model["coarse"]
                d2 = np.maximum((u * u).sum(1)[:, None] + (c * c).sum(1) - 2 * u @ c.T, 0)
                home = d2.argmin(1)
                r = u - c[home]
                codes = np.stack([((k * k).sum(1) - 2 * r[:, cut] @ k.T).argmin(1) for cut, k in zip(model["cuts"], model["books"], strict=True)], 1).astype(np.uint8)
                back = np.concatenate([k[codes[:, m]] for m, k in enumerate(model["books"])], 1)
                error = np.sqrt(((r - back) ** 2).sum(1))
                apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 0))
                probes = d2 - d2[np.arange(len(u)), home][:, None] <= 2 * reach * apart[home] + 1e-9
                probes &= np.arange(len(c)) >= home[:, None]
                probes[np.arange(len(u)), home] = True
                at, to = np.nonzero(probes)
                data = [v.tobytes() for v in raw]
                part = lambda i, cell, listed: pd.DataFrame({"label": b["label"].to_numpy()[i], "width": np.int32(length), "cell": cell.astype(np.int32), "listed": listed, "own": cell == home[i], "rep": b["rep"].to_numpy()[i], "n": b["n"].to_numpy()[i],
                    "x": [data[j] for j in i], "codes": [codes[j].tobytes() for j in i], "error": error[i]})
                yield part(np.arange(len(b)), home, True)
                yield part(at, to, False)

    label = classes.schema["label"].dataType.simpleString()
    entries = stored(classes.mapInPandas(coded, f"label {label}, width int, cell int, listed boolean, own boolean, rep long, n long, x binary, codes binary, error double"), "lists")
    key = ["label", "width", "cell"]
    parts = entries.groupBy(*key).agg(F.ceil(F.sum(F.col("listed").cast("int")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum((~F.col("listed")).cast("int")) / PROBES).cast("int").alias("turns"))
    dealt = entries.join(parts.where("blocks > 0"), key)
    apart = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # cogroup asks for columns of two origins
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = dealt.where("listed").withColumn("block", own("blocks")).withColumn("turn", every("turns")).drop("blocks", "turns", "listed")
    probes = apart.where("not listed").withColumn("turn", own("turns")).withColumn("block", every("blocks")).drop("blocks", "turns", "listed")

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "links": []}).astype(np.int64)
        if not len(q) or not len(v):
            return none
        width, cell = int(v["width"].iloc[0]), int(v["cell"].iloc[0])
        model = sent.value[width]
        qx, vx = (np.frombuffer(b"".join(t["x"]), np.float64).reshape(-1, width) for t in (q, v))
        qr, vr = q["rep"].to_numpy(), v["rep"].to_numpy()
        codes = np.frombuffer(b"".join(v["codes"]), np.uint8).reshape(len(v), -1)
        unit = qx / np.abs(qx).max(1, keepdims=True)
        unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
        bound = np.sqrt(adc(unit - model["coarse"][cell], codes, model)) - v["error"].to_numpy()[None, :]
        same = q["own"].to_numpy(bool)
        near = bound <= reach + 1e-4
        # two vectors of one list meet as both probe and entry, perhaps in different blocks: once is enough
        near[same] &= qr[same][:, None] < vr[None, :]
        i, j = np.nonzero(near)
        linked = np.zeros(near.shape, bool)
        qs, vs = (t / np.abs(t).max(1, keepdims=True) for t in (qx, vx))
        qn, vn = np.sqrt((qs * qs).sum(1)), np.sqrt((vs * vs).sum(1))
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            linked[a, b] = np.einsum("ij,ij->i", qs[a], vs[b]) / (qn[a] * vn[b]) >= cosine
        if not linked.any():
            return none
        out_q, out_v = linked @ v["n"].to_numpy(), q["n"].to_numpy() @ linked
        lq, lv = qr.copy(), vr.copy()
        most = np.iinfo(np.int64).max
        while True:
            up = np.minimum(lq, np.where(linked, lv[None, :], most).min(1))
            down = np.minimum(lv, np.where(linked, up[:, None], most).min(0))
            if (up == lq).all() and (down == lv).all():
                break
            lq, lv = up, down
        a, n, to = np.concatenate([qr, vr]), np.concatenate([out_q, out_v]), np.concatenate([lq, lv])
        return pd.DataFrame({"a": a[n > 0], "b": to[n > 0], "links": n[n > 0]})

    group = [*key, "block", "turn"]
    found = stored(probes.groupBy(*group).cogroup(lists.groupBy(*group)).applyInPandas(compare, "a long, b long, links long"), "links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = connected(found)
    solved = classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("label").alias("_l"), F.col("v").alias("_v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"),
    )
    clean = F.transform("v", lambda c: c + F.lit(0.0).cast(vectors.schema[vector_col].dataType.elementType))
    joined = rows.withColumn("_k", F.when(F.col("ok"), clean)).join(solved, (F.col("_k") == F.col("_v")) & (F.col("label") == F.col("_l")) & F.col("ok"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
