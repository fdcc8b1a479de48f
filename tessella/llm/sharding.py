"""Operator 9, sharding by fixed virtual slots. DataFrame functions only.

A record's slot is a hash of its id. A versioned map, kept as a table, gives each slot's shard; adding a shard or levelling
bytes edits the map, so only records of edited slots move. Maps have one row a slot (a few thousand), and starts of places
SALTS rows a slot, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots, and the parts in which a slot's records are numbered.
SLOTS, SALTS = 4096, 16
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def _hash(col, salt: str) -> F.Column:
    """31 bits of md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(col.cast("string"), F.lit("null")), F.lit(salt))), 1, 8), 16, 10).cast("long")


def slot_of(col, slots: int = SLOTS) -> F.Column:
    return (_hash(col, "") % slots).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots in hashed order are dealt round, so every shard has the same number of slots or one more."""
    if not 0 < shards <= slots:
        raise ValueError("shards must lie between 1 and slots")
    dealt = Window.orderBy(_hash(F.col("id"), ":deal"), "id")
    rows = spark.range(0, slots, 1, 1)
    return rows.select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), ((F.row_number().over(dealt) - 1) % shards).cast("int").alias("shard"))


def add_shard(slot_map: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The next version with shard number `shards` added: it takes its equal part of slots, as evenly from all others as
    can be; no slot moves between old shards."""
    within = Window.partitionBy("shard").orderBy(_hash(F.col("virtual_slot"), f":grow{shards}"), "virtual_slot")
    turn = slot_map.withColumn("_turn", F.row_number().over(within))
    pick = F.row_number().over(Window.orderBy("_turn", "shard"))
    return turn.withColumn("_pick", pick).select(
        (F.col("version") + 1).alias("version"), "virtual_slot",
        F.when(F.col("_pick") <= slots // (shards + 1), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def slot_bytes(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(virtual_slot, n_rows, n_bytes), one row a slot that has records."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16
    return docs.select(slot_of(F.col(id_col), slots).alias("virtual_slot"), size.alias("s")).groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("s").alias("n_bytes"))


def rebalance(slot_map: DataFrame, usage: DataFrame, shards: int) -> DataFrame:
    """The next version, levelled by bytes: a slot stays while its shard's running bytes, largest slots first, are within
    the mean; the rest are dealt, largest first, to the shards in order of the room they have left. Empty slots stay."""
    known = slot_map.join(usage, "virtual_slot", "left").withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))
    run = Window.partitionBy("shard").orderBy(F.desc("n_bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum("n_bytes").over(Window.partitionBy()) / shards
    ran = known.withColumn("_run", F.sum("n_bytes").over(run)).withColumn("_mean", mean)
    over = (F.col("_run") > F.col("_mean")) & (F.col("n_bytes") > 0)
    room = slot_map.sparkSession.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("to"))
    kept = ran.where(~over).groupBy(F.col("shard").alias("to")).agg(F.sum("n_bytes").alias("kept"))
    room = room.join(kept, "to", "left").withColumn("_place", F.row_number().over(Window.orderBy(F.coalesce("kept", F.lit(0)), "to")) - 1)
    moved = ran.where(over).withColumn("_place", (F.row_number().over(Window.orderBy(F.desc("n_bytes"), "virtual_slot")) - 1) % shards)
    moved = moved.join(room, "_place").select((F.col("version") + 1).alias("version"), "virtual_slot", F.col("to").alias("shard"))
    return ran.where(~over).select((F.col("version") + 1).alias("version"), "virtual_slot", "shard").unionByName(moved)


def write_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the store of maps at path, a Parquet table partitioned by version."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def grown(spark: SparkSession, shards: int, path: str, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The maps for `shards` and for one more shard, from the store at path; they are written there if it has none."""
    first = first_map(spark, shards, slots)
    write_map(first, path)
    now = read_map(spark, path, 1)
    write_map(add_shard(now, shards, slots), path)
    return now, read_map(spark, path, 2)


def shard(docs: DataFrame, slot_map: DataFrame, grown_map: DataFrame | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each record's id, size, checksum, virtual slot, shard, place (`slot`, gapless from 0 in its shard) and its virtual
    slot's bytes.

    Law `key`: the id and the map decide. Null texts have size 16 and the checksum of no bytes; null ids share a slot;
    repeated rows take neighbouring places; an empty table gives no rows; other columns, whatever their names, are not
    read. Equal records are counted before they are shuffled, and spread out again at the end. Places are numbered in parts
    of a virtual slot, by checksum, and moved by the counts of the shard's earlier parts, so no task orders a whole shard,
    nor a slot that holds many different texts without an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    checksum = F.crc32(text)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 16).alias("size"), checksum.alias("text_crc32"), slot_of(F.col(id_col), slots).alias("virtual_slot"), (checksum % SALTS).cast("int").alias("salt"),
    )
    distinct = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    usage = rows.groupBy("virtual_slot", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    maps = slot_map.select("virtual_slot", "shard")
    maps = maps.join(grown_map.select("virtual_slot", F.col("shard").alias("grown_shard")), "virtual_slot") if grown_map is not None else maps.withColumn("grown_shard", F.lit(None).cast("int"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = maps.join(usage, "virtual_slot").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("slot_bytes", F.sum("b").over(Window.partitionBy("virtual_slot"))).drop("n", "b")
    place = Window.partitionBy("virtual_slot", "salt").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("place", F.coalesce(F.sum("copies").over(place), F.lit(0)))
    # starts has slots * SALTS rows at most, by construction
    joined = placed.join(F.broadcast(starts), ["virtual_slot", "salt"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return joined.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") + F.col("copy")).cast("long").alias("slot"), "grown_shard", "virtual_slot", "slot_bytes",
    )
