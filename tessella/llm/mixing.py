"""Operator 2, mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import word_count

#: Weights dealt to sources in code point order, again and again.
WEIGHTS = (3, 1, 2)
#: Of all words, the share that the mix takes; times a source's words that it may give.
SHARE, CAP = 1.5, 2.0
#: Parts of a class of sizes, each ordered by itself.
SALTS = 64


def _bits(text, bits: int) -> F.Column:
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % (1 << bits)).cast("long")


def size_class(size) -> F.Column:
    """Sizes that agree in their five leading binary digits: some 16 classes for each doubling."""
    digits = F.length(F.bin(size))
    return (digits * 32 + F.call_function("shiftright", size, F.greatest(digits - 5, F.lit(0)))).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) with `target`: shares by weight, none above cap times its size, excess reshared.

    In order of cap by weight, a source is full if its cap is below its share of what the sources before it leave; the
    others divide the rest by weight. One row a source: the windows hold sources, not documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("ceiling", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("ceiling") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    t = t.withColumn("before", F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    t = t.withColumn("full", F.col("ratio") <= (F.col("budget") - F.col("before")) / F.col("rest"))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("ceiling")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    return t.withColumn("left", left).withColumn("open_w", open_w).select(
        "source", "source_size", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("left") * F.col("w") / F.col("open_w")).alias("target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """docs with `_size`, `_source_size`, `_target` and `_copies`: the times the mix takes each document.

    Every document of a source has the same expected copies, target / source_size; the running sum of those, from one
    offset drawn for the source, crosses an integer once for each copy. Documents are summed in order of size, so sizes
    are sampled evenly too. A source may hold most rows: places are counted in (source, class of size, salt) and moved by
    the counts before them, a table of some 20,000 rows a source at most. Null texts have size 0, the null source is a
    source, rows that repeat an id are separate documents, sources without words get target 0 and no copies, an empty
    table gives none. Other columns pass; those named like
    the four added ones are replaced. Reruns agree.
    """
    base = docs.select(
        F.struct(*docs.columns).alias("row"), word_count(F.col(text_col)).alias("_size"), F.xxhash64(text_col).alias("_text"), F.col(id_col).alias("_id"),
        F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name")).alias("_source"),
        (_bits(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)), 31) % SALTS).alias("_salt"),
    ).withColumn("_class", size_class(F.col("_size")))
    part = ["_source", "_class", "_salt"]
    counts = base.groupBy(*part).agg(F.count("*").alias("n"), F.sum("_size").alias("words"))
    sizes = counts.groupBy("_source").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(~F.col("_source.none"), F.col("_source.name")))
    goals = targets(sizes.select("source", "source_size"), weights, share, cap)
    offset = _bits(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit(""))), 20) / F.lit(float(1 << 20))
    goals = goals.select(
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"), offset.alias("_offset"),
    )
    before = Window.partitionBy("_source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "words").join(goals, "_source")
    place = F.row_number().over(Window.partitionBy(*part).orderBy("_id", "_size", "_text"))
    placed = base.withColumn("_place", place).join(starts, part)
    at = F.col("_start") + F.col("_place")
    copies = F.floor(F.col("_offset") + at * F.col("_rate")) - F.floor(F.col("_offset") + (at - 1) * F.col("_rate"))
    added = {"_size": F.col("_size"), "_source_size": F.col("_source_size"), "_target": F.col("_target"), "_copies": copies.cast("int")}
    return placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in added), *(c.alias(k) for k, c in added.items()))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    out = mix(docs, **options).where("_copies > 0")
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
