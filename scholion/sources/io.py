"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion import dims
from scholion.functions.shared import cut_lineage

ENTITY_ITEM = "array<struct<en_name:string,number_category:string,en_unit:string,en_context:string>>"
EXTRACTION = f"en_summary string, heb_summary string, passage_types array<string>, Entities map<string,{ENTITY_ITEM}>, Rel map<string,array<struct<term1:string,term2:string>>>"
EXTRACTION_FILE = f"res struct<{EXTRACTION.replace(' ', ':').replace(',:', ',')}>, {EXTRACTION}"
ENRICHMENT_FILE = (
    "entities array<struct<key:string,display_en_name:string,display_heb_name:string,timePeriod:string,isWoman:boolean,isNonJew:boolean,"
    "isGroup:boolean,roles:array<string>,heb_unit:string,heb_context:string,placeType:string,symbolType:string>>"
)


def read_keyed_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A1: (rows, rejects) of a directory of JSON files, the key from the file name (``;`` for
    ``:``).  A byte order mark is skipped, a file that is a JSON string is parsed once more,
    and files that are no objects of the schema are listed with their text."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    key = F.replace(F.regexp_replace(name, r"\.json$", ""), F.lit(";"), F.lit(":"))
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    return parse_keyed(files.select(key.alias("key"), text.alias("text")), schema)


def parse_keyed(raw: DataFrame, schema: str, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """A1: (rows, rejects) of JSON documents as text (key, text); where ``stored``, documents are
    made and parsed once for both."""
    inner = F.from_json(F.concat(F.lit('{"s":'), "text", F.lit("}")), "s string")["s"]
    raw = raw.withColumn("text", F.when(F.startswith("text", F.lit('"')), inner).otherwise(F.col("text")))
    full = T._parse_datatype_string(schema).add("_corrupt", "string")
    parsed = raw.withColumn("j", F.from_json("text", full, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("j").isNull() | F.col("j._corrupt").isNotNull() | ~F.startswith("text", F.lit("{"))
    if stored:
        kept = parsed.select("key", bad.alias("bad"), F.when(bad, F.col("text")).alias("text"), F.when(~bad, F.col("j").dropFields("_corrupt")).alias("j"))
        parsed, bad = cut_lineage(kept, "parsed"), F.col("bad")
        return parsed.where(~bad).select("key", "j.*"), parsed.where(bad).select("key", "text")
    rows = parsed.where(~bad).select("key", "j.*").drop("_corrupt")
    return rows, parsed.where(bad).select("key", "text")


def scan_passages(spark: SparkSession, path: str, src_type: str | None = None) -> DataFrame:
    """A2: key and content of complete rows; a source type prunes to its partition."""
    df = spark.read.parquet(path)
    if src_type is not None:
        df = df.where(F.col("src_type") == src_type)
    return df.where("key IS NOT NULL AND content IS NOT NULL").select("key", "content")


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A3: entities, rels or metadata."""
    return spark.read.parquet(path)


def read_merge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4: (rows, rejects) of a directory of merge lists named after an entity type, such as
    ``person_to_merge.csv``; a header is optional, blank rows go; rows of other files reject.
    A row is the number of its line; lists are kept by hand, so a file is read whole."""
    files = spark.read.text(path, pathGlobFilter="*.csv", wholetext=True).select(F.url_decode("_metadata.file_name").alias("list"), "value")
    return parse_merge_lists(files)


def parse_merge_lists(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (rows, rejects) of merge lists as text (list, value)."""
    spark = files.sparkSession
    lines = files.select("list", F.posexplode(F.split("value", r"\r?\n")).alias("row", "line"))
    cells = F.from_csv("line", "final_name string, names string, merged string")
    rows = lines.select("list", F.col("row").cast("long").alias("row"), cells.alias("c")).select("list", "row", "c.*")
    rows = rows.where("trim(coalesce(final_name, '') || coalesce(names, '')) <> '' AND lower(trim(coalesce(final_name, ''))) <> 'final_display_name'")
    known = dims.entity_types(spark).select(F.lower("entity_type").alias("stem"), "entity_type")
    typed = rows.withColumn("stem", F.lower(F.regexp_extract("list", r"^(.*?)_to_merge\.csv$", 1))).join(F.broadcast(known), "stem", "left").drop("stem")
    return typed.where("entity_type IS NOT NULL"), typed.where("entity_type IS NULL").drop("entity_type")


def read_query_sheet(spark: SparkSession, path: str, src_type: str = "BT") -> DataFrame:
    """A5: queries of the sheet that have the source type's flag and a text."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE")
    return query_rows(raw, src_type)


def query_rows(raw: DataFrame, src_type: str = "BT") -> DataFrame:
    """A5: typed rows of a sheet (flags, query_name, query_content, entities, rels, max_sources)."""
    flags = [c for c in ("BT", "JT", "RM", "TN", "MS") if c in raw.columns]
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    out = raw.select(
        *[F.coalesce(F.trim(c).try_cast("int"), F.lit(0)).alias(c) for c in flags],
        F.trim("query_name").alias("query_name"),
        F.trim("query_content").alias("query_content"),
        items("entities").alias("entities"),
        items("rels").alias("rels"),
        F.trim("max_sources").try_cast("int").alias("max_sources"),
    )
    return out.where((F.col(src_type) == 1) & (F.col("query_content") != ""))


def snapshot_tables(tables: dict[str, DataFrame], db: str = "scholion") -> DataFrame:
    """(db, coll, data): every row of every table as JSON."""
    out = None
    for coll, df in tables.items():
        rows = df.select(F.lit(db).alias("db"), F.lit(coll).alias("coll"), F.to_json(F.struct("*")).alias("data"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_snapshot(tables: dict[str, DataFrame], path: str, db: str = "scholion") -> None:
    snapshot_tables(tables, db).write.option("compression", "gzip").json(path)


def write_glossary(terms: DataFrame, path: str, col: str = "term") -> None:
    """Sorted distinct terms with empty columns to fill in."""
    glossary(terms, col).write.csv(path, header=True)


def glossary(terms: DataFrame, col: str = "term") -> DataFrame:
    return terms.select(F.col(col).alias("term")).distinct().orderBy("term").select("term", F.lit("").alias("translation"), F.lit("").alias("notes"))


def append_rows(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Plain append, no dedup."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
