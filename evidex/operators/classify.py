"""Ordered rules, role claims and similarity back-fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.dictionaries import Role, Rule
from evidex.functions.text import first_keyword, half_even, let
from evidex.operators.similarity import best_match, tfidf
from evidex.session import cut

_NONE = "struct<category:string,keyword:string,level:string>"


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def rule_class(title: Column, text: Column, rules: Sequence[Rule], snippet: int = 400) -> Column:
    """struct(category, keyword, level) of the first rule, by title, then by the strict words in the start of the text.

    A rule whose excluded words the title holds is passed over for the title only. Null where no rule
    holds. The start of the text is the rule's feature, not a shortcut.
    """

    def found(keyword: Column, rule: Rule, level: str) -> Column:
        value = F.struct(F.lit(rule.name).alias("category"), keyword.alias("keyword"), F.lit(level).alias("level"))
        return F.when(keyword.isNotNull(), value)

    def chosen(row: Column) -> Column:
        t, start = row["title"], row["start"]
        by_title = [found(F.when(~_any(t, r.excludes), first_keyword(t, r.keywords)), r, "title") for r in rules]
        by_text = [found(first_keyword(start, r.strict), r, "jd") for r in rules if r.strict]
        return F.coalesce(*by_title, *by_text, F.lit(None).cast(_NONE))

    # Title and text are worked out once for all keywords, wherever the optimizer moves this expression.
    return let(F.struct(title.alias("title"), F.substring(text, 1, snippet).alias("start")), chosen)


def claim_role(title: Column, roles: Sequence[Role]) -> Column:
    """The first role whose pattern the title has and whose excluded pattern it has not; null titles claim none.

    Claims one after another, each of rows that none before took, are the same as this ordered choice.
    """
    low = F.lower(title)
    out = None
    for r in roles:
        hit = F.coalesce(low.rlike(r.pattern), F.lit(False))
        if r.exclude:
            hit = hit & ~low.rlike(r.exclude)
        out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def prototypes(classified: DataFrame, order: str, most: int = 400) -> DataFrame:
    """(category, text): the first `most` titles of each class that a title keyword gave, joined by spaces.

    `most` is a property of the prototype, as in a top-k report. Titles are cut per map task first.
    """
    from pyspark.sql import Window

    rows = classified.where(F.col("match_level") == "title").select("category", order, "std_title")
    w = Window.partitionBy("category").orderBy(order)
    top = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    titles = F.array_sort(F.collect_list(F.struct(order, "std_title")))["std_title"]
    return top.groupBy("category").agg(F.array_join(titles, " ").alias("text"))


def backfill(unmatched: DataFrame, protos: DataFrame, key: str, text: str, order: Sequence[str], threshold: float = 0.12, low: int = 2, high: int = 4) -> DataFrame:
    """(key, category, score) of the most similar prototype of each unmatched text; category null below the threshold.

    Weights come from prototypes and unmatched texts as one corpus. Equal texts are worked out once and
    count as often as they stand. Ties go to the earlier class.
    """
    texts = unmatched.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("times"))
    docs = protos.select(F.concat(F.lit("p:"), "category").alias("doc"), "text", F.lit(1).cast("bigint").alias("times")).unionByName(texts.select(F.concat(F.lit("u:"), "text").alias("doc"), "text", "times"))
    weights = tfidf(docs, "doc", "text", low, high, times="times")
    left = weights.where(F.col("doc").startswith("u:"))
    right = weights.where(F.col("doc").startswith("p:"))
    best = best_match(left, right, [f"p:{c}" for c in order])
    scored = best.select(F.substring("doc", 3, 1 << 30).alias(text), F.when(F.col("score") >= threshold, F.substring("match", 3, 1 << 30)).alias("category"), "score")
    return unmatched.select(key, text).join(scored, text, "left").select(key, "category", F.coalesce("score", F.lit(0.0)).alias("score"))


def classify(df: DataFrame, rules: Sequence[Rule], fallback: str, key: str, threshold: float = 0.12) -> DataFrame:
    """Rows with a unique key, std_title and text_all, with category, assign_method, match_keyword, match_level and sim_score added."""
    narrow = df.select(key, "std_title", rule_class(F.col("std_title"), F.col("text_all"), rules).alias("_r"))
    # Titles and rules are worked out once; what follows reads the narrow result several times.
    ruled = cut(narrow.select(key, "std_title", F.col("_r.category").alias("category"), F.col("_r.keyword").alias("match_keyword"), F.col("_r.level").alias("match_level")))
    unmatched = ruled.where(F.col("category").isNull())
    filled = backfill(unmatched, prototypes(ruled, key), key, "std_title", [*(r.name for r in rules), fallback], threshold)
    filled = filled.select(key, F.col("category").alias("_c"), F.col("score").alias("sim_score"))
    joined = df.drop("std_title").join(ruled, key).join(filled, key, "left")
    method = F.when(F.col("category").isNotNull(), "rule").when(F.col("_c").isNotNull(), "embedding_sim").otherwise("fallback")
    return joined.select(
        *df.columns, F.coalesce("category", "_c", F.lit(fallback)).alias("category"), method.alias("assign_method"),
        "match_keyword", "match_level", half_even(F.col("sim_score"), 4).alias("sim_score"),
    )
