"""Sparse TF-IDF and dense similarity as joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import char_wb_ngrams
from evidex.session import cut


def tfidf(docs: DataFrame, doc: str, text: str, low: int = 2, high: int = 4, n: int | None = None, times: str | None = None) -> DataFrame:
    """(doc, gram, weight): smoothed inverse document frequency, raw counts, vectors of length 1.

    A document without n-grams has no row. Rows of one document count as one text; n is the number of
    documents where some have several rows. A document that stands for several equal ones says so in
    the column times. Counts combine on the map side; the frequency table joins by broadcast where
    Spark finds it small.
    """
    weight = F.col(times).cast("bigint") if times else F.lit(1).cast("bigint")
    grams = docs.select(F.col(doc).alias("doc"), weight.alias("times"), F.explode(char_wb_ngrams(F.col(text), low, high)).alias("gram"))
    # The counts are read three times.
    tf = cut(grams.groupBy("doc", "gram").agg(F.count("*").alias("tf"), F.max("times").alias("times")))
    if n is None:
        n = docs.agg(F.sum(weight)).first()[0] or 0
    df = tf.groupBy("gram").agg(F.sum("times").alias("df")).select("gram", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = tf.join(df, "gram").select("doc", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "doc").select("doc", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc, match, score) of the pairs that share a gram: a sparse product, the grams join by key."""
    r = right.select(F.col("doc").alias("match"), "gram", F.col("weight").alias("w2"))
    return left.join(r, "gram").groupBy("doc", "match").agg(F.sum(F.col("weight") * F.col("w2")).alias("score"))


def best_match(left: DataFrame, right: DataFrame, order: Sequence[str]) -> DataFrame:
    """(doc, match, score) of the most similar right document; ties go to the one earlier in order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("match"))
    best = cosine(left, right).groupBy("doc").agg(F.max(F.struct("score", (-place).alias("p"), "match")).alias("m"))
    return best.select("doc", F.col("m.match").alias("match"), F.col("m.score").alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; null where one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def centroids(df: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """(group, centroid): the mean vector of each group, by one pass with map-side partial sums."""
    means = df.where(F.col(vector).isNotNull()).groupBy(group).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"c{i}") for i in range(size)])
    return means.select(group, F.array(*[F.col(f"c{i}") for i in range(size)]).alias("centroid"))


#: Most numbers of all centroids together: they become a part of the plan.
MOST_NUMBERS = 1 << 16


def nearest_centroid(df: DataFrame, key: str, vector: str, centres: DataFrame, group: str) -> DataFrame:
    """(key, group, score) of the most similar centroid, of equals the smaller group; null where a vector has no length.

    Centroids are a stated, small set of one row a class, which rides along with each row as one array,
    so no pairs of rows are made. ValueError where they hold more than MOST_NUMBERS numbers.
    """
    size = centres.agg(F.sum(F.size("centroid")).alias("n")).first()["n"] or 0
    if size > MOST_NUMBERS:
        raise ValueError(f"centroids of {size} numbers are too many for a plan")
    rows = centres.orderBy(group).collect()
    cs = F.array(*[F.struct(F.lit(c[group]).alias("g"), F.array(*map(F.lit, c["centroid"])).alias("v")) for c in rows]) if rows else F.array().cast("array<struct<g:int,v:array<double>>>")
    best = F.array_max(F.transform(cs, lambda c: F.struct(cosine_of(F.col(vector), c["v"]).alias("score"), (-c["g"]).alias("p"))))
    return df.select(key, (-best["p"]).alias(group), best["score"].alias("score"))
