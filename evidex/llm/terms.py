"""Frequency of every distinct value or term.

(term, record) pairs are summed with map-side combines, range-partitioned and sorted by Spark's
external sort; one run-length scan over each partition counts occurrences and distinct records of
every term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import batches
from evidex.session import cut


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, occurrences, records) of each run of a term in sorted pairs.

    A run that goes on in the next batch gives a row in each, as it does in the next partition.
    """
    for batch in batches(rows):
        terms, n = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        size = batch.num_rows
        differs = pc.not_equal(terms.slice(1), terms.slice(0, size - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(differs) + 1))
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(starts)), pa.array(np.add.reduceat(n, starts)), pa.array(np.add.reduceat((n > 0).astype(np.int64), starts))], ["term", "occurrences", "records"])


def term_counts(df: DataFrame, term: str, record: str, count: str | None = None) -> DataFrame:
    """One row (term, occurrences, records) for each non-null term, exactly as recorded.

    occurrences sums count (1 a row without it); a row whose count is null, zero or less is no
    occurrence, and a term without any occurrence gets 0 and 0. Null records make one record only
    where the count is above 0. Repeated rows count each time. A pair is one row after the sums, so a
    hot term is parted by its records; its pairs may lie in several partitions, whose sums are added.
    """
    n = F.greatest(F.coalesce(F.col(count).cast("bigint"), F.lit(0)), F.lit(0)) if count else F.lit(1).cast("bigint")
    pairs = df.where(F.col(term).isNotNull()).select(F.col(term).cast("string").alias("term"), F.coalesce(F.col(record).cast("string"), F.lit("\u0000")).alias("record"), n.alias("n"))
    # The range partitioning reads its input twice, for the borders and for the rows.
    summed = cut(pairs.groupBy("term", "record").agg(F.sum("n").alias("n")))
    ordered = summed.repartitionByRange("term", "record").sortWithinPartitions("term", "record").select("term", "n")
    counted = ordered.mapInArrow(_scan, "term string, occurrences bigint, records bigint")
    return counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, term: str, record: str, count: str | None = None, rare: int = 2, common: float = 0.5) -> DataFrame:
    """term_counts with mark: rare in at most `rare` records, common in at least a share of all records, else null.

    All records are the distinct non-null values of the record column. A term in no record has no mark.
    """
    total = df.agg(F.countDistinct(record).alias("all_records")).first()[0]
    records = F.col("records")
    mark = F.when((records > 0) & (records <= rare), "rare").when((records > 0) & (records >= F.lit(common) * F.lit(total)), "common")
    return term_counts(df, term, record, count).withColumn("mark", mark)
