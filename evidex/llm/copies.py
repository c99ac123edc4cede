"""Duplicates hidden by formatting differences.

A record's key is the sorted list of the letters and digits of its values. Keys are counted exactly
with map-side partial counts. Keys above the hot bound are salted into a two-level aggregation,
the rest goes through one shuffle; the record with the smallest identifier stands for its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.session import cut

#: A key with this many rows or more is hot: what one task can well hold, whatever the size of the table.
HOT_ROWS = 100_000
SALTS = 64

# Everything that is no letter or digit, but for a point between two digits.
_DROP = r"(?<!\p{Nd})\.|\.(?!\p{Nd})|[^\p{L}\p{N}.]"


def letters_and_digits(value: Column) -> Column:
    """Lower-cased letters and digits of a text, with the points between digits; empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), _DROP, "")


def canonical_key(columns: list[str]) -> Column:
    """The values' letters and digits in sorted order, whichever column each stands in; empty ones left out."""
    values = F.array_sort(F.filter(F.array(*[letters_and_digits(F.col(c)) for c in columns]), lambda x: x != ""))
    return F.array_join(values, "\u0001")


def keyed(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, k1, k2): a record's identifier and the 128-bit hash of its canonical key."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), canonical_key(columns).alias("key")).select(
        "id", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2")
    )


def _parted(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of cold and of hot keys.

    Counts are exact and combined in the map tasks. There is at most one hot key for hot_rows rows;
    whether they are broadcast is left to Spark, which knows their size.
    """
    hot = cut(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows).select("k1", "k2"))
    return rows.join(hot, ["k1", "k2"], "left_anti"), rows.join(hot, ["k1", "k2"], "left_semi")


def _salted(rows: DataFrame) -> DataFrame:
    """(k1, k2, keep_id, n_copies) by two levels: the salts of a key first, then the key."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).groupBy("k1", "k2", "salt").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    return salted.groupBy("k1", "k2").agg(F.min("least").alias("keep_id"), F.sum("n").alias("n_copies"))


def copies(df: DataFrame, id_col: str, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row (keep_id, copy_id) for each record except the first of its group.

    Null equals empty, so records without any letter or digit form one group. Rows with a null
    identifier are left out; a repeated identifier counts as one record. Other columns play no part.
    Keys are worked out once. The rows of cold keys are shuffled once, for their groups and for the
    join with these; hot groups are never gathered.
    """
    cold, hot = _parted(cut(keyed(df, id_col, columns).where(F.col("id").isNotNull())), hot_rows)
    spread = cold.repartition("k1", "k2")
    first = spread.groupBy("k1", "k2").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = spread.join(first, ["k1", "k2"]).unionByName(hot.join(_salted(hot).drop("n_copies"), ["k1", "k2"]))
    return pairs.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def collapsed(df: DataFrame, id_col: str, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row (keep_id, n_copies) for each group, the first record included in the count."""
    cold, hot = _parted(cut(keyed(df, id_col, columns).where(F.col("id").isNotNull())), hot_rows)
    groups = cold.groupBy("k1", "k2").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))
    return groups.unionByName(_salted(hot)).select("keep_id", "n_copies")
