"""Sources and sinks: CSV in old encodings, keyed JSON, templates, Parquet."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text columns of raw postings; links and codes stay text, so nothing is inferred.
POSTING_COLUMNS = ("ts_code", "official_name", "company_name", "company_industry", "company_scale", "title", "salary", "location", "experience", "degree", "skills", "welfare", "jd", "job_link", "is_dispatch")


def posting_schema(extra: Sequence[str] = ()) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in (*POSTING_COLUMNS, *extra)])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, path: str, hint: str = "") -> str:
    """The path, or FileNotFoundError with a hint."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no such input: {path}" + (f"; {hint}" if hint else ""))
    return path


def optional(spark: SparkSession, path: str, reader) -> DataFrame | None:
    """What reader makes of the path, or None where it isn't there."""
    return reader(path) if exists(spark, path) else None


def raw_path(default: str, variable: str = "JOBS_RAW_CSV") -> str:
    """An input's place: the environment's, or default."""
    return os.environ.get(variable) or default


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8", row_id: str | None = None) -> DataFrame:
    """CSV with a header, quoted cells of several lines, and a byte-order mark or none.

    Encodings beyond Spark's own, such as GB18030, turn spark.sql.legacy.javaCharsets on for this
    session. A file with cells of several lines can't be split, so one task reads each file. row_id adds
    a number that keeps the order of the files by path and of the rows in each.
    """
    if encoding.upper() not in ("UTF-8", "UTF8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    first = df.columns[0] if df.columns else ""
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first[1:])
    if not row_id:
        return df
    # The place of a row within its task keeps the order within a file, whichever files a task reads.
    ranks = {p: i for i, p in enumerate(sorted(df.inputFiles()))}
    names = spark.createDataFrame(list(ranks.items()), "_file string, _rank bigint")
    placed = df.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    return placed.join(names, "_file").select(*df.columns, (F.shiftleft("_rank", 33) + F.col("_at")).alias(row_id))


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header. With bom each file's first column name starts with a byte-order mark, for spreadsheets."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    # Blanks at the ends of a cell belong to it, so they are not trimmed as is the default.
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """The primary sink; partition columns let later reads skip files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Parquet only where there are rows."""
    if df.isEmpty():
        return False
    write_parquet(df, path)
    return True


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file that is one JSON array of objects."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def read_keyed_json(spark: SparkSession, path: str, value: str, skip: Sequence[str] = ("_doc", "_rule")) -> DataFrame:
    """(key, value) of a file that is one JSON object; value is the DDL type of its members."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))
    return rows.where(~F.col("key").isin(*skip)) if skip else rows


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_template(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    return spark.read.text(path, wholetext=True).first()["value"]


def missing_keys(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that a sink should have and hasn't, and the other way round: (key, side)."""
    a = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("missing"))
    return a.unionByName(found.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("unexpected")))


def only(df: DataFrame, key: str, subset: str) -> DataFrame:
    """Rows whose key is in a comma-separated list; all of them for an empty list."""
    keys = [k.strip() for k in subset.split(",") if k.strip()]
    return df.where(F.col(key).isin(*keys)) if keys else df
