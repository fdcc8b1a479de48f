"""Operator 12: how filters of documents interact, over every order in which they can be applied.

Each document's failures are a mask of five bits. Whether its text is a repeat comes from a sort over all documents: equal
texts stand together, and each is compared with the one before it. Masks are counted by part, 32 counters at most, and
counters, which add up over any division of the documents, are all that the orders need.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import discard, stored

FILTERS = "ABCDE"
#: Filters A to D: fewest words, least percentage of distinct words, most percentage of capitals, characters not allowed.
WORDS, DISTINCT, CAPITALS, BARRED = 200, 50, 2, re.compile(rb"[#$%&*|]")
REPEAT = 1 << FILTERS.index("E")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INSIDE = bytes(range(0x80, 0xC0))  # all but the first bytes of characters


def failing(text: bytes) -> int:
    """Bits of the filters A to D that the text fails. bytes.split() cuts at the six characters that end a word."""
    words = text.split()
    points = len(text.translate(None, _INSIDE))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (
        len(words) < WORDS, 100 * len(set(words)) < DISTINCT * len(words), 100 * capitals > CAPITALS * points,
        BARRED.search(text) is not None,
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, part, mask) of every document: bit i is set if it fails FILTERS[i].

    Documents are dealt by ranges of (fingerprint, id) and sorted by (fingerprint, text, id), so that a text with very many
    copies goes on from one task to the next, and bounds of ranges, which the driver samples, hold no texts. Within a task
    each document is compared with the one before it. Copies of one fingerprint may begin in an earlier task: the texts of
    a task's first and last fingerprint are written with their smallest ids, and the smallest of all tasks decides. Texts
    are compared in full, so equal fingerprints of different texts do no harm.

    A repeat has a text that some row with a smaller id has: rows that share text and id are equally first, rows without an
    id neither are repeats nor make any. Null texts are empty, null parts ''. An empty table gives no rows; other columns
    are not read. The result is a written table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        fingerprint(text).cast("long").alias("fp"), text.alias("text"), F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    )
    kind = rows.schema["id"].dataType
    schema = T.StructType([
        T.StructField("task", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("id", kind),
        T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("fp", T.LongType()),
        T.StructField("text", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        firsts: list[list] = []  # text and smallest id, of the task's first fingerprint, and of the present one
        group: list[list] = []
        first_fp = last_fp = low = None
        mask = 0
        ids = pa.null()
        for batch in batches:
            fps, texts, keys, parts = batch.columns
            ids = keys.type
            edges, made = [], []
            for fp, text, key in zip(fps.to_pylist(), texts.cast(pa.binary()).to_pylist(), keys.to_pylist(), strict=True):
                if fp != last_fp:
                    if first_fp is None:
                        first_fp = fp
                    group, last_fp = (firsts if fp == first_fp else []), fp
                if not group or group[-1][0] != text:
                    mask, low = failing(text), None
                    group.append([text, None])
                if low is None:
                    low = group[-1][1] = key  # ids ascend, nulls come first
                first = group is firsts
                edges.append(len(group) - 1 if first else None)
                made.append(mask | REPEAT if not first and key is not None and key > low else mask)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * n, pa.int32()), pa.array(edges, pa.int32()), keys, parts, pa.array(made, pa.int32()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=schema.names)
        ends = [(i, first_fp, *g) for i, g in enumerate(firsts)] + [(None, last_fp, *g) for g in group if group is not firsts]
        if ends:
            edge, fp, text, least = zip(*ends, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(ends), pa.int32()), pa.array(edge, pa.int32()), pa.array(least, ids),
                 pa.nulls(len(ends), pa.string()), pa.nulls(len(ends), pa.int32()), pa.array(fp, pa.int64()),
                 pa.array(text, pa.binary())], names=schema.names)

    dealt = rows.repartitionByRange("fp", "id").sortWithinPartitions("fp", "text", F.asc_nulls_first("id"))
    found = stored(dealt.mapInArrow(run, schema), "interaction-sorted")
    # one or two rows a task: the smallest id of a text over all tasks
    ends = found.where("mask is null").withColumn("least", F.min("id").over(Window.partitionBy("fp", "text")))
    ends = ends.where("edge is not null").select("task", "edge", "least")
    own = found.where("mask is not null and edge is null").select("id", "part", "mask")
    repeat = F.when(F.col("id") > F.col("least"), REPEAT).otherwise(0)
    late = found.where("mask is not null and edge is not null").join(ends, ["task", "edge"])
    out = stored(own.union(late.select("id", "part", F.col("mask").bitwiseOR(repeat).alias("mask"))), "interaction-masks")
    discard(found)
    return out


def counters(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those that a row of labels with their id calls good or toxic.

    Counters of several tables, or of parts of one, are added by part and mask. Documents without labels, or without an id,
    are neither good nor toxic.
    """
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good + toxic > 0")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return masked.join(marks, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def orders(counted: DataFrame) -> DataFrame:
    """What each filter does at each place of each order, a row for every part, order and step.

    What a filter removes depends on which filters came before it, not on their order, so each part needs 80 sums of its
    counters (a set of filters before, and one more), and an order's steps are looked up among them.
    """
    spark, n = counted.sparkSession, len(FILTERS)
    bit = lambda f: F.shiftleft(F.lit(1), f)
    cases = counted.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))))
    cases = cases.withColumn("filter", F.explode(F.array(*(F.lit(i) for i in range(n))))).withColumn("own", F.expr("shiftleft(1, filter)"))
    cases = cases.where("before & own = 0")
    total = lambda rule, c, name: F.sum(F.when(F.expr(rule), F.col(c)).otherwise(0)).cast("long").alias(name)
    gone = "mask & own <> 0 and mask & before = 0"
    sums = cases.groupBy("part", "before", "filter").agg(
        total("mask & (before | own) = 0", "n", "kept"), total(gone, "n", "removed"),
        total("mask & own <> 0 and mask & before <> 0", "n", "redundant"), total("mask = own", "n", "unique_fails"),
        total(gone, "good", "good_lost"), total(gone, "toxic", "toxic_lost"),
    )
    # so many orders have just these filters before
    ways = F.factorial(F.bit_count("before")) * F.factorial(F.lit(n - 1) - F.bit_count("before"))
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "filter")).cast("long"))
    names = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    every = spark.range(1).select(F.explode(names).alias("filter_order"))
    every = every.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    prior = F.expr("substring(filter_order, 1, step - 1)")
    steps = every.select(
        "filter_order", "step", (F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")) - 1).alias("filter"),
        sum((F.when(F.instr(prior, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0)).alias("before"),
    )
    # 600 rows by construction
    return sums.join(F.broadcast(steps), ["before", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """orders() of the documents' masks. A table without rows has no parts and gives no rows."""
    masked = masks(docs)
    counted = stored(counters(masked, labels), "interaction-counters")
    discard(masked)
    return orders(counted)
