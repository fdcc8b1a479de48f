"""Operator 10, near-duplicate documents by SetSketch registers, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.anchors import spread
from tessella.llm.common import connected, discard, mix64, stored, trimmed

#: Registers are ROWS in each of BANDS; base of their spacing; register of a minimum of 1. At similarity 0.8 a pair
#: shares no band with a chance of about one in ten million.
BANDS, ROWS, BASE, ZERO = 50, 6, 1.1, 24
#: How far below the threshold a likelihood estimate may lie before its pair is not confirmed: more than six deviations.
SLACK = 0.15
#: Rounds that compare a bucket's members with one of them, before all that is still apart is compared; members of a tile.
LEADERS, TILE = 2, 1024

_ODD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_WORDS = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower and bytes.split know ASCII only, as asked."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, length: int) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    return set(zip(*(w[i:] for i in range(length)), strict=False)) if len(w) >= length else {tuple(w)} if w else set()


class Hasher:
    """Distinct 64-bit hashes of a text's shingles; frequent words' hashes are remembered."""

    def __init__(self, length: int):
        self.length, self.known = length, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = words_of(text), self.known
        if len(known) > _WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = self.length if len(h) >= self.length else len(h)
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix64(out * np.uint64(0xD1342543DE82EF95) + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def registers(h: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: how many steps of BASE the least of its exponential values lies below 1.

    Register i of a union is the larger of the two sets' registers i.
    """
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):
        np.minimum(least, (h[at : at + 512, None] * _ODD).min(0), out=least)
    value = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53))
    return np.clip(np.floor(ZERO - np.log(value) / np.log(BASE)), 0, 255).astype(np.uint8)


def similarity(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs of sets of known sizes, from how many registers of a are above and below b's."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101) * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    same = np.maximum(1 - up - down, 1e-12)
    fit = more[:, None] * np.log(np.maximum(up, 1e-12)) + less[:, None] * np.log(np.maximum(down, 1e-12)) + (BANDS * ROWS - more - less)[:, None] * np.log(same)
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BANDS * ROWS)


def sketch(docs: DataFrame, length: int) -> DataFrame:
    """(id, th, n, s1, s2, regs) of docs (id, th, text): size, digest and registers of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length)
        signed = lambda x: int(np.uint64(x).astype(np.int64))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column(2):
                h = hasher(t.as_py())
                for to, value in zip(out, (len(h), signed(mix64(h).sum(dtype=np.uint64)), signed(np.bitwise_xor.reduce(mix64(h ^ np.uint64(0x5BD1E995)))), registers(h).tobytes()), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, out[:3], [pa.int64()] * 3), pa.array(out[3], pa.binary())],
                names=["id", "th", "n", "s1", "s2", "regs"],
            )

    return docs.select("id", "th", "text").mapInArrow(trimmed(run), "id long, th long, n long, s1 long, s2 long, regs binary")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the sizes allow and the registers do not rule out."""
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"r_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = _matrix(b["r_a"]), _matrix(b["r_b"])
                s = similarity((x > y).sum(1), (x < y).sum(1), b["n_a"].to_numpy(float), b["n_b"].to_numpy(float))
                yield b.loc[s >= percent / 100 - SLACK, ["a", "b"]]

    return both.mapInPandas(trimmed(run), "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough. b's text goes to its leader a once a pair, a's once for
    each TILE pairs."""
    rows = common.led(pairs.select(F.col("a").alias("lead"), F.col("b").alias("node")), TILE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = set()
        for b in batches:
            ok = []
            for lead, node, text in zip(b["lead"], b["node"], b["text"], strict=True):
                own = shingles(text, length)
                if lead == node:
                    held = own
                elif 100 * (both := len(held & own)) >= percent * (len(held) + len(own) - both):
                    ok.append((lead, node))
            if ok:
                yield pd.DataFrame(ok, columns=["a", "b"])

    return common.by_leader(rows.join(texts, "node")).select("lead", "node", "text").mapInPandas(trimmed(run), "a long, b long")


def _apart(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """A forest that joins all members (bucket, rep, c) that share a bucket, are of different components and likely to be
    near. They are compared by registers in tiles, so that no task holds more than two parts of a bucket; small tiles are
    compared many at once. As many rows leave a tile as it has members at most."""
    size = members.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    rows = members.where("m > 2").join(size.select("bucket"), "bucket").withColumn("parts", F.ceil(F.col("m") / TILE).cast("int")).join(classes.select("rep", "regs"), "rep")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "c", "n", "regs")

    def compare(b: pd.DataFrame, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the tiles begin..end of b: a row meets the later rows of its tile, of the other part if there are two."""
        rep, c, n, part = (b[k].to_numpy() for k in ("rep", "c", "n", "part"))
        two = (b["lo"] != b["hi"]).to_numpy()
        tile_end = np.repeat(end, end - begin)
        regs, found = _matrix(b["regs"]), []
        at = np.arange(len(b))
        for start in range(0, len(b), 4096):
            i = at[start : start + 4096]
            later = tile_end[i] - i - 1
            for some in np.array_split(np.arange(len(i)), max(1, int(later.sum()) >> 18)):
                j = spread(i[some] + 1, later[some])
                k = np.repeat(i[some], later[some])
                ok = (c[k] != c[j]) & (rep[k] != rep[j]) & (~two[k] | (part[k] != part[j])) & (100 * np.minimum(n[k], n[j]) >= percent * np.maximum(n[k], n[j]))
                k, j = k[ok], j[ok]
                for cut in range(0, len(k), 8192):
                    x, y = k[cut : cut + 8192], j[cut : cut + 8192]
                    # a pair as similar as asked shares about as many registers; few do, so the likelihood is for those
                    same = (regs[x] == regs[y]).mean(1) >= percent / 100 - SLACK - 0.1
                    x, y = x[same], y[same]
                    s = similarity((regs[x] > regs[y]).sum(1), (regs[x] < regs[y]).sum(1), n[x].astype(float), n[y].astype(float))
                    found.append(np.stack([x, y], 1)[s >= percent / 100 - SLACK])
        return forest(np.concatenate(found) if found else np.zeros((0, 2), np.int64), rep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b[["bucket", "lo", "hi"]].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            # the last tile may go on in the next batch
            whole, rest = b.iloc[: begin[-1]], b.iloc[begin[-1] :].reset_index(drop=True)
            if len(whole):
                yield pd.DataFrame(compare(whole, begin[:-1], begin[1:]), columns=["a", "b"])
        if rest is not None and len(rest):
            yield pd.DataFrame(compare(rest, np.array([0]), np.array([len(rest)])), columns=["a", "b"])

    dealt = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "rep")
    return dealt.mapInPandas(trimmed(run), "a long, b long")


def forest(pairs: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Pairs of rep that connect what pairs (of places in rep) connect: each with the first of its tree."""
    return np.stack(common.forest(rep[pairs[:, 0]], rep[pairs[:, 1]]), 1) if len(pairs) else np.zeros((0, 2), np.int64)


def common_sizes(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first `split` sets with the others (with all, if split is all): products of the
    sets' indicators, over the members that two sets share, in blocks of columns."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    name = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], name[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((split, len(sets) - split if split < len(sets) else split))
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        total += m[:split] @ (m[split:] if split < len(sets) else m).T
    return total


def _compared(clusters: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """A forest of the links between different components c inside clusters (rep, cluster, c), by full sets. Sets are made
    once, from texts (node, text), and dealt to tiles of two parts of a cluster; every pair of a tile is compared there."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(length)
        for b in batches:
            yield b.assign(s=[hasher(t).tobytes() for t in b["text"]])[["cluster", "rep", "c", "parts", "s"]]

    size = clusters.groupBy("cluster").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("cluster", F.ceil(F.col("m") / TILE).cast("int").alias("parts"))
    rows = clusters.join(size, "cluster").join(texts.select(F.col("node").alias("rep"), "text"), "rep").select("cluster", "rep", "c", "parts", "text").mapInPandas(trimmed(sets), "cluster long, rep long, c long, parts int, s binary")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cluster", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "c", "s")

    def compare(b: pd.DataFrame) -> np.ndarray:
        b = b.sort_values("part", kind="stable")
        lo, hi = b["lo"].iloc[0], b["hi"].iloc[0]
        split = int((b["part"] == lo).sum())
        if split == 0 or lo != hi and split == len(b):
            return np.zeros((0, 2), np.int64)
        own, c, rep = [np.frombuffer(x, np.uint64) for x in b["s"]], b["c"].to_numpy(), b["rep"].to_numpy()
        both, n = common_sizes(own, split), np.array([len(x) for x in own])
        other = slice(split, None) if split < len(b) else slice(None)
        linked = (100 * both >= percent * (n[:split, None] + n[other] - both)) & (c[:split, None] != c[other])
        x, y = np.nonzero(linked)
        return forest(np.stack([x, y + (split if split < len(b) else 0)], 1), rep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles come sorted; one may reach over batches."""
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b[["cluster", "lo", "hi"]].to_numpy()
            begin = [*np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist(), len(b)]
            found = [compare(b.iloc[i:j]) for i, j in zip(begin[:-2], begin[1:-1], strict=True)]
            rest = b.iloc[begin[-2] :].reset_index(drop=True)
            if found:
                yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])
        if rest is not None and len(rest):
            yield pd.DataFrame(compare(rest), columns=["a", "b"])

    return rows.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "rep").mapInPandas(trimmed(run), "a long, b long")


def _components(docs: DataFrame, id_col: str, text_col: str, length: int, percent: int) -> DataFrame:
    """(id, th, n, c, component) of each row; c tells components apart, component is the smallest id of one. Both are null
    for rows that cannot link. See near_duplicates."""
    text = F.col(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sketches = stored(sketch(base, length), "sketches")
    # a class of equal sets goes by a hash of its digest, whatever ids its rows have; any of its texts stands for it
    classes = sketches.where("n > 0 and id is not null").groupBy(F.xxhash64("n", "s1", "s2").alias("rep"))
    classes = stored(classes.agg(F.min("id").alias("id"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                b = whole.iloc[at : at + 2000]
                regs = _matrix(b["regs"]).reshape(-1, BANDS, ROWS).astype(np.int64)
                key = (regs << (8 * np.arange(ROWS))).sum(2) | (np.arange(BANDS) << 48)
                yield pd.DataFrame({"bucket": key.ravel(), "rep": np.repeat(b["rep"].to_numpy(), BANDS), "n": np.repeat(b["n"].to_numpy(), BANDS)})

    bands = classes.select("rep", "n", "regs").mapInPandas(trimmed(banded), "bucket long, rep long, n long")
    # one shuffle of the bands: a bucket's size comes by a window, which spills where a bucket is large
    buckets = every = stored(bands.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).where("m > 1"), "buckets")
    own: DataFrame | None = None  # (rep, c) of the classes that are linked
    tested: list[DataFrame] = []
    texts: list[DataFrame] = []

    def with_texts(nodes: DataFrame) -> DataFrame:
        """(node, text) of at least these classes; what was fetched before is not fetched again."""
        for t in texts:
            nodes = nodes.join(t.select("node"), "node", "left_anti")
        need = nodes.join(classes.select(F.col("rep").alias("node"), F.col("th").alias("of")), "node")
        texts.append(stored(base.join(need, F.col("th") == F.col("of")).groupBy("node").agg(F.first("text").alias("text")), "texts"))
        return reduce(DataFrame.union, texts)

    def component(rows: DataFrame) -> DataFrame:
        return rows.withColumn("c", F.col("rep")) if own is None else rows.join(own, "rep", "left").withColumn("c", F.coalesce("c", "rep"))

    def linked(links: DataFrame) -> DataFrame:
        """own with the components that the new links join: only components, not all earlier links, are looked at."""
        ends = component(component(links.withColumnRenamed("a", "rep")).select(F.col("c").alias("a"), F.col("b").alias("rep"))).select("a", F.col("c").alias("b"))
        groups = connected(ends)
        named = groups.select(F.col("node").alias("c"), "component")
        new = named.select(F.col("c").alias("rep"), F.col("component").alias("c"))
        if own is not None:
            moved = own.join(named, "c", "left").select("rep", F.coalesce("component", "c").alias("c"))
            new = moved.union(new.join(own, "rep", "left_anti"))
        out = stored(new, "own")
        discard(links, groups, own)
        return out

    for turn in range(LEADERS + 1):
        members = component(buckets)
        if turn < LEADERS:
            first = F.struct((F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")).alias("h"), "rep", "c", "n")
            lead = members.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(first).alias("l")).where("c0 < c1")
            led = members.join(lead.select("bucket", F.col("l.rep").alias("lead"), F.col("l.c").alias("lead_c"), F.col("l.n").alias("lead_n")), "bucket")
            led = led.where(f"c <> lead_c and 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
            pairs = led.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
            for t in tested:
                pairs = pairs.join(t, ["a", "b"], "left_anti").join(t.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
            pairs = stored(_likely(pairs, classes, percent), "pairs")
            if turn == 0:  # buckets of two are done: their pair was compared with its leader
                buckets = buckets.where("m > 2")
            tested.append(pairs)
            if not pairs.isEmpty():
                known = with_texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
                own = linked(stored(_confirmed(pairs, known, length, percent), "links"))
        else:
            near = stored(_apart(members, classes, percent), "near")
            if not near.isEmpty():
                joined = connected(near)
                clusters = joined.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
                known = with_texts(clusters.select(F.col("rep").alias("node")))
                own = linked(stored(_compared(component(clusters), known, length, percent), "links"))
                discard(joined)
            discard(near)
    discard(every, *tested, *texts)
    solved = component(classes.select("rep", "id"))
    solved = stored(solved.join(solved.groupBy("c").agg(F.min("id").alias("component")), "c").select("rep", "c", "component"), "solved")
    discard(classes, own)
    return sketches.drop("regs").withColumn("rep", F.when(F.col("id").isNotNull(), F.xxhash64("n", "s1", "s2"))).join(solved, "rep", "left").select("id", "th", "n", "c", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, percent: int = 80) -> DataFrame:
    """One row for each of docs: id, n_shingles, component_id, kept.

    Documents link if 100 * |intersection| >= percent * |union| of their sets of word shingles. Texts with fewer words than
    a shingle have their whole sequence as one; null texts and those without words have no set and link with nothing.
    Equal sets are one class from the start. Rows with a null id link with nothing; each row that repeats an id is
    compared with its own text, and component_id is the smallest id of a row's component. An empty table gives no rows;
    other columns, whatever their names, are not read. A set is held in memory, one text at a time.

    Classes go by 64 bits of a 192-bit digest of their sets: two of 10^9 different sets share them with a chance of 3 %.
    Classes that share a band's registers are candidates; a pair at the threshold shares none with a chance of 10^-7, and
    the estimates that rule a pair out are six deviations off. In each bucket all are compared with one of them; what is
    then in one component needs no further comparison, what is not meets another leader. In the end members still apart
    are compared by registers; those that are likely near make clusters, inside which all full sets are compared in tiles.
    No pair that shares a band is skipped unless its ends are already connected or its estimate is far below the
    threshold, and no step lists pairs: tasks give forests.
    """
    found = _components(docs, id_col, text_col, length, percent)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, with its columns, for each group of near duplicates: that with the smallest id, of rows that share
    it the one with the least hash of its text, of equal ones any. Rows that link with nothing stay, so do null ids."""
    found = _components(docs, id_col, text_col, length, percent)
    rows = found.groupBy("id", "th", "c").agg(F.count("*").alias("copies"))
    best = rows.where("c is not null").groupBy("c").agg(F.min(F.struct("id", "th")).alias("k")).select("k.id", "k.th")
    alone = rows.where("c is null").select("id", "th", F.lit(1).cast("long").alias("copies"))
    kept = stored(best.join(rows.select("id", "th", "copies"), ["id", "th"]).unionByName(alone).withColumnsRenamed({"id": "_id", "th": "_th"}), "kept")
    own = (F.col(id_col).cast("long").eqNullSafe(F.col("_id"))) & (F.xxhash64(text_col) == F.col("_th"))
    one = F.col("copies") == 1
    several = docs.join(kept.where(~one), own, "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(kept.where(one), own, "left_semi").unionByName(several)
