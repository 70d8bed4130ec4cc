"""File sources and sinks: nested JSON directories, JSON lines, CSV, binary manifests, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, body): whole JSON files, gzip too, one row each; ``year`` is the name of the file's folder."""
    df = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    return df.withColumn("year", F.element_at(F.split("file", "/"), -2))


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, one folder per value of ``by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV table with a header and a declared schema (no inference pass)."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows of ``df`` whose key is not yet stored at ``path``; a rerun adds nothing."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path).select(key).distinct()
        df = df.join(stored, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    df.dropDuplicates([key]).write.mode("append").parquet(path)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, length, sha256) of all files that match; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(pattern)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, pattern: str, stored: DataFrame) -> DataFrame:
    """(file, problem): files that are missing, new or changed against a stored manifest."""
    now = manifest(spark, pattern).select("file", F.col("sha256").alias("now"))
    both = stored.select("file", F.col("sha256").alias("then")).join(now, "file", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def as_csv_text(df: DataFrame, most: int = 10_000) -> str:
    """A small result as CSV text for download; more than ``most`` rows raise."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows.to_csv(index=False)
