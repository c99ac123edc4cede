"""Row filters, deterministic de-duplication and sampling frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _short(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """What stands for the keys in a shuffle: the keys, or where texts are among them 128 bits of a hash of all.

    A null has a mark of its own, so that it equals only a null in the same column.
    """
    kinds = dict(df.dtypes)
    if not any(kinds[k] == "string" for k in keys):
        return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    # Adding nought makes the negative one the plain one, as a comparison takes them.
    values = {k: F.col(k) + F.lit(0.0) if kinds[k] in ("float", "double") else F.col(k) for k in keys}
    marked = [F.when(x.isNull(), F.lit("!")).otherwise(F.concat(F.lit("="), x.cast("string"))) for x in values.values()]
    return [F.xxhash64(*marked).alias("_k0"), F.xxhash64(F.lit("second"), *marked).alias("_k1")]


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest `order` of each key; null keys are equal.

    Done by an aggregate with map-side combine, so a key with very many rows leaves each task as one
    row, then a semi-join on the unique order column. Long texts aren't shuffled as keys, their hashes
    are. Rows with a null order are left out.
    """
    short = df.where(F.col(order).isNotNull()).select(*_short(df, keys), F.col(order))
    first = short.groupBy(*[c for c in short.columns if c != order]).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def drop_full_copies(df: DataFrame, order: str) -> DataFrame:
    """The first of the rows that are equal in all columns but `order`."""
    return keep_first(df, [c for c in df.columns if c != order], order)


def differs(column: Column, value: object) -> Column:
    """Inequality that keeps nulls."""
    return ~column.eqNullSafe(F.lit(value))


def clean_postings(df: DataFrame, order: str, link: str = "job_link", business: Sequence[str] = ("company_name", "title", "location", "salary"), dispatch: str = "is_dispatch", dispatch_value: str = "是") -> DataFrame:
    """Postings once by link, once by business key with the city for the place, without dispatched ones; column city added.

    Null links are equal, so they collapse into one row, as null business values do. Which rows stay is
    settled on the few columns that decide it; the whole rows are joined once, with what stays.
    """
    def city() -> Column:
        return F.btrim(F.split_part(F.col("location"), F.lit("·"), F.lit(1)))

    narrow = df.select(order, link, *[c for c in business if c != "location"], city().alias("city"), dispatch)
    linked = keep_first(narrow, [link], order)
    kept = keep_first(linked, ["city" if c == "location" else c for c in business], order).where(differs(F.col(dispatch), dispatch_value))
    return df.join(kept.select(order), order, "left_semi").withColumn("city", city())


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """(stage, metric, value): number of rows after each stage."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("stage"), F.lit("rows").alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def clean_frame(df: DataFrame, text: str, order: str, shortest: int = 180, longest: int = 700, most_marks: float = 0.004) -> DataFrame:
    """Rows with a text once each, of usual length and with few question marks (lost characters)."""
    frame = keep_first(df.where(F.col(text).isNotNull()), [text], order)
    n = F.length(text)
    marks = n - F.length(F.replace(F.col(text), F.lit("?"), F.lit("")))
    return frame.where((n >= shortest) & (n <= longest) & (marks < F.lit(most_marks) * n))


def stratified(df: DataFrame, stratum: Column, sizes: Mapping[str, int], order: str, seed: int | None = None) -> DataFrame:
    """A fixed number of rows of each stratum: the first by `order`, or by its hash with a seed.

    Only the rows that can win are sorted: a partial top-k in each map task precedes the shuffle.
    """
    rank = F.col(order) if seed is None else F.xxhash64(F.lit(seed), F.col(order))
    wanted = F.coalesce(*[F.when(F.col("stratum") == F.lit(k), F.lit(n)) for k, n in sizes.items()])
    rows = df.withColumn("stratum", stratum).where(F.col("stratum").isin(*sizes))
    w = Window.partitionBy("stratum").orderBy(rank, F.col(order))
    # The plain bound lets Spark keep only so many rows of each stratum in each map task.
    top = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(sizes.values(), default=0))
    return top.where(F.col("place") <= wanted)
