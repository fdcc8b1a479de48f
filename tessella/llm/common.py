"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = "\x20\x09-\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session (tests) gets one of its
    own; a cluster must name one, as executors don't see each other's temporary folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what stored() wrote, once nothing that is still to run reads it."""
    for t in tables:
        path = _FOLDERS.pop(t, None) if t is not None else None
        if path:
            context = t.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes of the rows that are sent to a Python worker at once. A batch is held several times: in the JVM's vectors, which
#: double as they grow, on its way, and in the worker.
BATCH = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Lowers the session's bound of a batch's bytes to `most`, so that texts of any length cross to Python in bounded memory.
    A single longer text is a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", now.lower()).groups()
    size = int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit]
    if size < 0 or size > most:
        spark.conf.set(name, str(most))


def word_count(text) -> F.Column:
    """Number of words; null counts as empty. Counts word starts, so no array of words is made."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", ""))).cast("long")


def release() -> None:
    """Gives what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow and mapInPandas. Spark gives a worker process one task after the other, in turns with the others
    that its executor has started, so what each keeps from its largest task adds up: it is released at a task's end."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return task


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts that spread every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges a-b connect: each node but the smallest of its tree, with that smallest one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots hang on smaller roots, so there are no rings
        while (root[root] != root).any():
            root = root[root]
    low = np.flatnonzero(root != np.arange(len(names)))
    return names[root[low]], names[low]


def forests(edges: DataFrame, block: int = 1 << 18) -> DataFrame:
    """Edges (a long, b long) that connect the same nodes: of each `block` edges of a task a forest is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= block:
                a, b = forest(*pd.concat(held)[["a", "b"]].to_numpy().T)
                held, size = [pd.DataFrame({"a": a, "b": b})], len(a)
                if size >= block // 2:
                    yield held.pop()
                    size = 0
        if size:
            yield pd.DataFrame(dict(zip("ab", forest(*pd.concat(held)[["a", "b"]].to_numpy().T), strict=True)))

    return edges.select("a", "b").mapInPandas(trimmed(run), "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long): component is the smallest node reachable.

    Randomised contraction: each round names every node after the node that comes first among itself and its neighbours,
    and keeps the edges between different names. In every other round the order is drawn anew, which leaves three
    quarters of the nodes at most, as an expected value on any graph, so chains, hubs and rings end after some log n
    rounds and there is no limit of rounds; the rounds between take the smallest node, which ends trees that hang on
    their smallest nodes, as those of tasks do, at once. Tasks cut their edges to forests before these are written, names are composed in the end, and a
    table is deleted when its successor is there. A hub's edges meet in partial minima and plain joins, which adaptive
    execution splits. Null ends and self loops are ignored; no edges give no rows.
    """
    left = stored(forests(edges.where("a is not null and b is not null and a <> b")), "edges")
    names: list[DataFrame] = []
    while not left.isEmpty():
        key = (lambda c, n=len(names): F.xxhash64(c, F.lit(n))) if len(names) % 2 else (lambda c: F.col(c))
        both = left.union(left.select("b", "a"))
        first = both.groupBy("a").agg(F.min(F.struct(key("b").alias("h"), F.col("b").alias("node"))).alias("m"))
        own = (key("a") < F.col("m.h")) | ((key("a") == F.col("m.h")) & (F.col("a") < F.col("m.node")))
        names.append(stored(first.select(F.col("a").alias("node"), F.when(own, F.col("a")).otherwise(F.col("m.node")).alias("name")), "names"))
        side = lambda k: names[-1].select(F.col("node").alias(k), F.col("name").alias(f"{k}_name"))
        moved = left.join(side("a"), "a").join(side("b"), "b").where("a_name <> b_name")
        new = stored(forests(moved.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))), "edges")
        discard(left)
        left = new
    if not names:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(left)
    label, held = names[-1], []
    for i, step in enumerate(reversed(names[:-1])):
        last = label.select(F.col("node").alias("at"), F.col("name").alias("above"))
        label = step.join(last, step.name == last["at"], "left").select("node", F.coalesce("above", "name").alias("name"))
        if i % 4 == 3:  # a plan of many joins would be long
            label = stored(label, "names")
            held.append(label)
    least = label.groupBy("name").agg(F.min("node").alias("component"))
    out = stored(label.join(least, "name").select("node", "component"), "components")
    discard(*names, *held)
    return out


def led(pairs: DataFrame, part: int) -> DataFrame:
    """(lead, part, node) for pairs (lead, node): each node in one of its leader's parts, of about `part` nodes, and the
    leader itself in each of them."""
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    nodes = pairs.join(parts, "lead").select("lead", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    return nodes.union(parts.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lead").alias("node")))


def by_leader(rows: DataFrame) -> DataFrame:
    """Rows of led() with what was joined to them: parts whole in one task, one after the other, the leader first."""
    return rows.repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("lead") != F.col("node"), "node")
