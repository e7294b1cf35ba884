"""File sources and sinks: delimited text in two encodings, JSON arrays, JSON lines, landed API pages, keyed output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | list[str], schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and a fixed schema; ids stay strings. A byte order mark before the first name is ignored, as
    columns go by position. Korean code page files: encoding MS949."""
    if encoding.upper() in ("MS949", "CP949"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        encoding = "MS949"
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("enforceSchema", True).csv(path)


def encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The CSV files of a folder by encoding: UTF-8 where every line is valid, else the Korean code page where every line decodes, else an
    error that names the file. Lines are read as bytes by the executors; one row a file comes back."""
    settings = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}  # what does not decode becomes U+FFFD
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    valid, korean = F.is_valid_utf8(F.col("line").cast("string")), ~F.contains(F.decode("line", "MS949"), F.lit("\ufffd"))
    found = lines.groupBy("file").agg(F.every(valid).alias("utf8"), F.every(korean).alias("korean"))
    files = found.collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    bad = sorted(r.file for r in files if not (r.utf8 or r.korean))
    if bad:
        raise ValueError(f"neither UTF-8 nor MS949: {', '.join(bad)}")
    out = {"UTF-8": sorted(r.file for r in files if r.utf8), "MS949": sorted(r.file for r in files if not r.utf8)}
    return {k: v for k, v in out.items() if v}


def read_csv_detected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV files of a folder, each in its own encoding: one scan an encoding, in one union. Files without lines are left out."""
    parts = [read_csv(spark, files, schema, encoding) for encoding, files in encodings(spark, path).items()]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_json_array(spark: SparkSession, path: str, schema: str, wrapper: str | None = None) -> DataFrame:
    """A JSON array of records, or an object that holds it under wrapper."""
    if wrapper is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.read.schema(f"{wrapper} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(wrapper))


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str, order: str | None = None) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped; the last record of a key wins, by order or else by file and place."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("_at", F.col(order) if order else F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    rows = rows.where(F.col(key).isNotNull() & F.col("_bad").isNull())
    columns = [c for c in rows.columns if c not in ("_bad", "_at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_at").alias("_last")).select("_last.*")


def landed_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Responses of a paged interface that were landed as JSON, one page a file: page, total, and items, which may be one object or a list."""
    raw = spark.read.schema("page int, total int, items string").option("multiLine", True).json(path)
    many = F.from_json("items", f"array<struct<{schema}>>")
    one = F.array(F.from_json("items", f"struct<{schema}>"))
    return raw.withColumn("rows", F.when(F.startswith(F.ltrim("items"), F.lit("[")), many).otherwise(one)).select("page", F.inline("rows")).dropDuplicates()


def complete_pages(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The items of landed pages, all of them or an error: pages run from 1 without a gap, all name one total, and the items, a page that
    was landed twice counted once, are as many. The test is one row, which every item meets. lines: a page a line, not a file."""
    raw = spark.read.schema("page int, total int, items string").option("multiLine", not lines).json(path)
    many = F.from_json("items", f"array<struct<{schema}>>")
    rows = F.when(F.startswith(F.ltrim("items"), F.lit("[")), many).when(F.ltrim("items") != "", F.array(F.from_json("items", f"struct<{schema}>"))).otherwise(F.array().cast(f"array<struct<{schema}>>"))
    pages = raw.withColumn("rows", F.coalesce(rows, F.array().cast(f"array<struct<{schema}>>"))).dropDuplicates(["page"]).select("page", "total", "rows")
    seen = pages.agg(F.count("*").alias("pages"), F.min("page").alias("first"), F.max("page").alias("last"), F.min("total").alias("low"), F.max("total").alias("high"), F.sum(F.size("rows")).alias("items"))
    whole = (F.col("first") == 1) & (F.col("last") == F.col("pages")) & (F.col("low") == F.col("high")) & (F.col("items") == F.col("low"))
    said = F.concat(F.lit("incomplete pages: "), F.to_json(F.struct("pages", "first", "last", "low", "high", "items")))
    seen = seen.select(F.when(F.coalesce(whole, F.col("pages") == 0), True).otherwise(F.raise_error(said).cast("boolean")).alias("_whole"))
    return pages.crossJoin(F.broadcast(seen)).where("_whole").select("page", F.inline("rows"))


def write_keyed(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Overwrite the touched partitions only; writing the same rows again changes nothing."""
    rows.repartition(*partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_csv(rows: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header; mark puts a byte order mark in front of each file, as part of the first column's name."""
    names = ["\ufeff" + rows.columns[0], *rows.columns[1:]] if mark else rows.columns
    rows.toDF(*names).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
