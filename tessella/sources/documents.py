"""Reading artifacts and stored versions, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_FIELD = T.StructType([T.StructField(c, T.StringType()) for c in ("label", "name", "type", "placeholder", "region", "selector")])
_BUTTON = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "type", "region", "selector")])
_LINK = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "href", "region")])
_TABLE = T.StructType([T.StructField("name", T.StringType()), T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("row_count", T.LongType()), T.StructField("region", T.StringType())])
#: A screen of the index of screens.
SCREEN = T.StructType([
    T.StructField("route", T.StringType()), T.StructField("title", T.StringType()), T.StructField("main_visible_text", T.StringType()), T.StructField("inputs", T.ArrayType(_FIELD)), T.StructField("buttons", T.ArrayType(_BUTTON)),
    T.StructField("tables", T.ArrayType(_TABLE)), T.StructField("local_links", T.ArrayType(_LINK)), T.StructField("links", T.ArrayType(_LINK)),
])


def screen_index(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(screens, error): the screens of JSON documents {"screens": [...]}; any fault gives no rows and its name."""
    empty = spark.createDataFrame([], SCREEN)
    try:
        rows = spark.read.schema(T.StructType([T.StructField("screens", T.ArrayType(SCREEN)), T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).json(path)
        rows = rows.select("screens", "_corrupt_record").cache()  # a corrupt record is seen only in what is kept; documents are small
        if rows.where("_corrupt_record is not null or screens is null").limit(1).count():
            return empty, "invalid_document"
        screens = rows.select(F.inline("screens"))
        if not screens.limit(1).count():
            return empty, "no_screens"
        if screens.groupBy("route").count().where("count > 1").limit(1).count():
            return empty, "duplicate_route"
        return screens, None
    except AnalysisException as e:
        return empty, type(e).__name__


def artifacts(spark: SparkSession, folder: str, names: tuple[str, ...], required: str) -> tuple[dict[str, DataFrame], list[str]]:
    """({name: rows}, warnings): JSON artifacts that are there. Only `required` must be."""
    found, warnings = {}, []
    for name in names:
        try:
            found[name] = spark.read.option("multiLine", True).json(f"{folder}/{name}")
        except AnalysisException:
            if name == required:
                raise
            warnings.append(f"missing:{name}")
    return found, warnings


def latest_files(spark: SparkSession, pattern: str, key: str, stamp: str) -> DataFrame:
    """(key, path): of files named by key and time, the newest of each; the smaller path among equals."""
    names = spark.read.format("binaryFile").load(pattern).select(F.input_file_name().alias("path"))
    parts = names.select("path", F.regexp_extract("path", key, 1).alias("key"), F.regexp_extract("path", stamp, 1).alias("at")).where("key <> '' and at <> ''")
    newest = parts.groupBy("key", "at").agg(F.min("path").alias("path"))
    return newest.groupBy("key").agg(F.max_by("path", "at").alias("path"))


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def export(df: DataFrame, issues: DataFrame, path: str) -> None:
    """Writes df unless there are issues of severity error. Spark's commit makes the folder appear as a whole."""
    if issues.where("severity = 'error'").limit(1).count():
        raise ValueError("not exported: the knowledge base has errors")
    df.write.mode("overwrite").parquet(path)


def manifest(entities: dict[str, DataFrame]) -> DataFrame:
    """(entity_type, rows, content_hash): the hash is an order-free sum of row digests, so no rows are gathered."""
    out = None
    for name, df in sorted(entities.items()):
        digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        one = df.select(digest.alias("d")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("d"), F.lit(0)).cast("string").alias("s")).select(F.lit(name).alias("entity_type"), "rows", F.sha2(F.col("s"), 256).alias("content_hash"))
        out = one if out is None else out.unionByName(one)
    return out


def replace_scope(df: DataFrame, path: str, scope: tuple[str, ...] = ("erp_id", "version")) -> None:
    """Replaces the stored rows of the scopes that df has; other scopes stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def append_only(log: DataFrame, path: str) -> None:
    """Logs are added to and never rewritten."""
    log.write.mode("append").parquet(path)


def merged_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """(edges after the upsert, requested): edges without both ends are asked for and not written."""
    from tessella.operators.relations import projected_edges

    key = ["source", "type", "target"]
    return old.select(*key).union(projected_edges(new, nodes).select(*key)).distinct(), new.count()


def opened(entities: DataFrame, issues: DataFrame) -> DataFrame:
    """entities, if none of the issues is an error: a knowledge base is checked when it is opened."""
    if not issues.where("severity = 'error'").isEmpty():
        raise ValueError("not opened: the knowledge base has errors")
    return entities


def looked_up(entities: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """asked with the entity that has its keys, by id or by system and route: joins on equality take the place of indices."""
    return asked.join(entities.dropDuplicates(list(keys)), list(keys), "left")


def aliases_for(profiles: DataFrame, erp: str | None = None) -> DataFrame:
    """(label, aliases) of the profile that is of the system: by its id, code or name, or because the system's id ends in its
    code. The first file of those that fit; without a system the last one. profiles (file, id, code, name, aliases map)."""
    fits = F.lit(True) if erp is None else (F.lit(erp).isin(F.col("id"), F.col("code"), F.col("name")) | F.lit(erp.lower()).endswith(F.lower(F.coalesce("code", F.lit("")))))
    best = profiles.where(fits).orderBy(F.col("file").desc() if erp is None else F.col("file")).limit(1)
    return best.select(F.explode("aliases").alias("label", "aliases"))
