"""File sources and sinks: images by listing, gold labels, NDJSON events, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.schemas import EXTENSIONS

GOLD = "map<string, struct<template:string, ballot_type:string, page_number:int, page_total:int, barcode_text:string, province:string, municipality:string, station_name:string, officer:string, voting_district:string, registered_voters:int, votes:map<string,int>, totals:map<string,int>>>"


def run_sql(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """SQL with parameter markers (? or :name): values never become part of the text."""
    return spark.sql(text, args=args)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def presented(df: DataFrame) -> DataFrame:
    """Rows as they are shown: times in ISO form, structs and lists as JSON text, empty ones as NULL."""
    out = {}
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind == "timestamp":
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ssXXX")
        elif kind == "array":
            out[f.name] = F.when(F.size(f.name) > 0, F.to_json(f.name))
        elif kind in ("struct", "map"):
            out[f.name] = F.to_json(f.name)
    return df.withColumns(out) if out else df


def parse_list(raw: str | None) -> list[str] | None:
    return [x.strip() for x in (raw or "").split(",") if x.strip()] or None


def list_images(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """(name, path, length) of the accepted files of a folder, by lower-cased name; contents are not read."""
    d = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")
    d = d.where(F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$"))
    return (d.where(F.col("name").isin(names)) if names else d).orderBy(F.lower("name"))


def page_rows(files: DataFrame) -> DataFrame:
    """(.., page_index): a row for each page of a file; files have a column n_pages, without pages there are no rows."""
    return files.withColumn("page_index", F.explode(F.when(F.col("n_pages") >= 1, F.sequence(F.lit(0), F.col("n_pages") - 1)).otherwise(F.array().cast("array<int>")))).drop("n_pages")


def uploads(files: DataFrame) -> DataFrame:
    """Accepted files (name, length) under stored names that their content's place and name determine."""
    ext = F.lower(F.concat(F.lit("."), F.element_at(F.split("name", r"\."), -1)))
    return files.where(ext.isin(*EXTENSIONS)).withColumn("stored_name", F.concat(F.sha2(F.concat_ws("|", "name", F.col("length").cast("string")), 256).substr(1, 32), ext))


def packs(config: DataFrame, files: DataFrame) -> DataFrame:
    """(pack_id, available, present): config is (pack_id, names); a pack is available if all its files exist, and takes
    those that do."""
    each = config.select("pack_id", F.posexplode("names").alias("i", "name")).join(files.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("i", "name"))))
    d = each.groupBy("pack_id").agg((F.count_if("there") == F.count("*")).alias("available"), found.alias("f"))
    return d.select("pack_id", "available", F.transform("f", lambda x: x["name"]).alias("present"))


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """(file, g) of a JSON object of files, g with all stated fields; a file that is missing states nothing."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm):
        return spark.createDataFrame([], f"file string, g {GOLD[len('map<string, '):-1]}")
    # One object is one value: a label file is written by hand and fits a task.
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", GOLD)).alias("file", "g"))


def gold_votes(gold: DataFrame) -> DataFrame:
    """(file, party_code, votes)."""
    return gold.select("file", F.explode("g.votes").alias("party_code", "votes"))


def gold_pages(gold: DataFrame) -> DataFrame:
    """A row a file, with the fields that are compared; totals under the page's names."""
    t = {"total_valid_votes": "valid", "total_spoilt_votes": "spoilt", "total_votes_cast": "cast", "special_votes": "special", "section_24a_votes": "s24a"}
    return gold.select("file", "g.*", *[F.try_element_at("g.totals", F.lit(k)).alias(n) for n, k in t.items()]).drop("votes", "totals")


def read_ndjson(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, doubled quotes, CRLF and empty nulls."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def summary_json(df: DataFrame) -> DataFrame:
    """One row a slip with its children as JSON; nulls stay."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
