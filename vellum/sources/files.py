"""File sources and sinks: documents by extension, attachments, JSON ground truth, CSV and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, MOST_BYTES = ("md", "markdown", "txt", "csv"), 10 << 20


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files below ``path``: ``source_id, source_type, text``; a file without a title takes its name as one.
    Others and those over ``MOST_BYTES`` are left out; ``rejected_documents`` names them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(extension(F.col("path")).isin(*TEXT) & (F.col("length") <= MOST_BYTES)).select(name.alias("name"), F.decode("content", "UTF-8").alias("raw"))
    text = F.when(F.trim("raw").startswith("#"), F.col("raw")).otherwise(F.concat(F.lit("# "), "name", F.lit("\n\n"), "raw"))
    label = F.substring(F.regexp_replace("name", r"(?U)[^\w\-. ]", "_"), 1, 200)
    return rows.select(F.concat(F.lit("file:upload:"), F.when(label == "", "document").otherwise(label)).alias("source_id"), F.concat(F.lit("file_"), extension(F.col("name"))).alias("source_type"), text.alias("text"))


def rejected_documents(spark: SparkSession, path: str) -> DataFrame:
    """``name, reason`` of the files below ``path`` that ``read_documents`` leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")
    reason = F.when(~extension(F.col("path")).isin(*TEXT), "unknown_type").when(F.col("length") > MOST_BYTES, "too_large")
    return files.select("name", reason.alias("reason")).where("reason IS NOT NULL")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("queries array<struct<query:string,module:string,expected_keys:array<string>,prd_source_id:string,prd_section:string,notes:string>>").json(path).select(F.explode("queries").alias("q")).select("q.*")


def page_id(source: Column) -> Column:
    """The numeric id of a page given by id or by url; '' where there is none."""
    return F.when(source.rlike("^[0-9]+$"), source).otherwise(F.regexp_extract(source, r"/pages/(\d+)", 1))


def source_parts(source_id: Column) -> tuple[Column, Column]:
    return F.substring_index(source_id, ":", 1), F.regexp_extract(source_id, r"^[^:]*:(.*)$", 1)


def csv_fields(df: DataFrame) -> DataFrame:
    """Columns by name as CSV text: null as '', booleans as 1 and 0."""
    kinds = dict(df.dtypes)
    return df.select(*[F.coalesce(F.col(c).cast("int").cast("string") if kinds[c] == "boolean" else F.to_json(c) if kinds[c][:5] in ("array", "struc", "map<s") else F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(df.columns)])


def write_csv(df: DataFrame, path: str) -> None:
    csv_fields(df).write.option("header", True).csv(path)


def append_ledger(spark: SparkSession, entries: DataFrame, path: str) -> None:
    """Appends entries as JSON lines, each with the SHA-256 of its summary."""
    entries.withColumn("summary_sha256", F.sha2("summary", 256)).write.mode("append").json(path)
