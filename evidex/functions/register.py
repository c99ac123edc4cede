"""SQL names for the functions that Spark lacks."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def register(spark: SparkSession) -> None:
    """Register evidex_nfkc(text) and evidex_json_level(text) for spark.sql."""
    @F.pandas_udf(StringType())
    def nfkc(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    spark.udf.register("evidex_nfkc", nfkc)
    # The same reading as records.json_level, as an SQL function of the session.
    body = r"(?s)\\{.*\\}"
    comma = r"(?U),(\\s*[}\\]])"
    whole = "try_variant_get(try_parse_json(concat('[', {0}, ',', xxhash64({0}), ']')), '$[1]', 'bigint') = xxhash64({0})"
    inner = f"translate(regexp_replace(regexp_extract(t, '{body}', 0), '{comma}', '$1'), '“”', '\"\"')"
    spark.sql(
        f"""create or replace temporary function evidex_json_level(t string) returns string
        return case when t is null then null when {whole.format("t")} then 'strict' when {whole.format(inner)} then 'repaired' else 'text' end"""
    )


def to_json(value: object) -> str:
    """Readable JSON of a small result, such as a log of counters."""
    return json.dumps(value, ensure_ascii=False, indent=2)
