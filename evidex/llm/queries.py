"""Queries of the training-data operators over the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.llm import copies as dup
from evidex.llm import quantiles, terms
from evidex.llm.forms import LOOKALIKES, unify_text
from evidex.llm.leakage import PASSAGE, SEED, leaks
from evidex.llm.matching import map_fields, map_values, unmatched_values
from evidex.llm.quality import document_kinds, document_statistics
from evidex.llm.tokens import decoded_hashes, encode_corpus
from evidex.plans.registry import Registry, table

registry = Registry()
SHARES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
FORM_FIELDS = [
    ("company_jobs_merged", "row_id", {"company_jobs_merged.title": "title"}),
    ("jobinfo", "info_id", {"jobinfo.职位名称": "职位名称", "jobinfo.学历要求": "学历要求"}),
]
COPY_COLUMNS = ["company_name", "title", "salary", "location"]


@registry.query("p1_percentiles")
def p1_percentiles(spark, sf_dir):
    df = table(spark, sf_dir, "risk_scores_subjob")
    return quantiles.group_percentiles(df, "category", "薪资中位数K", SHARES).withColumnRenamed("grp", "category")


@registry.query("p1_by_day_combined")
def p1_by_day_combined(spark, sf_dir):
    """Sketches of each day and category, merged into those of all days."""
    df = table(spark, sf_dir, "risk_scores_subjob")
    day = F.coalesce(F.date_format("scored_at", "yyyyMMdd"), F.lit("--------"))
    keyed = df.select(F.concat(day, F.coalesce(F.concat(F.lit("="), "category"), F.lit("!"))).alias("k"), "薪资中位数K")
    days = quantiles.merge_sketches(quantiles.sketch_column(keyed, "k", "薪资中位数K"))
    category = F.when(F.substring("grp", 9, 1) == "=", F.expr("substring(grp, 10)"))
    merged = quantiles.merge_sketches(days.select(category.alias("grp"), "sketch"))
    return quantiles.read_quantiles(merged, SHARES).withColumnRenamed("grp", "category")


_RANK_SQL = """
    select category, count(*) as n, true as within_bound from risk_scores_subjob
    where 薪资中位数K is not null and not isnan(薪资中位数K) group by category
"""


def rank_check(spark, sf_dir, found):
    """Exact ranks of reported percentiles: each must lie within the bound that its sketch carries."""
    df = table(spark, sf_dir, "risk_scores_subjob")
    found = found.withColumnRenamed("category", "grp")
    names = [c for c in found.columns if c not in ("grp", "n", "rank_error")]
    rows = df.select("category", F.col("薪资中位数K").alias("v")).where("v is not null and not isnan(v)")
    joined = rows.join(found, rows["category"].eqNullSafe(found["grp"]))
    ranks = joined.groupBy("category").agg(
        F.count("*").alias("n"),
        F.first("rank_error").alias("e"),
        *[F.count_if(F.col("v") < F.col(c)).alias(f"lo_{c}") for c in names],
        *[F.count_if(F.col("v") <= F.col(c)).alias(f"hi_{c}") for c in names],
    )
    within = F.lit(True)
    for share, c in zip(SHARES, names):
        rank = F.ceil(F.col("n") * F.lit(share))
        within = within & (F.col(f"lo_{c}") + 1 <= rank + F.col("e")) & (F.col(f"hi_{c}") >= rank - F.col("e"))
    return ranks.select("category", "n", within.alias("within_bound"))


@registry.query("p1_rank_check", _RANK_SQL)
def p1_rank_check(spark, sf_dir):
    return rank_check(spark, sf_dir, p1_percentiles(spark, sf_dir))


@registry.query("p1_combined_rank_check", _RANK_SQL)
def p1_combined_rank_check(spark, sf_dir):
    """The rank check of the percentiles that come from the sketches of single days."""
    return rank_check(spark, sf_dir, p1_by_day_combined(spark, sf_dir))


_KEY_SQL = """
    with v as (select row_id, list_sort(list_filter([{values}], lambda x: x <> '')) as k from company_jobs_merged where row_id is not null),
    g as (select row_id, min(row_id) over (partition by k) as keep_id from v)
""".format(
    values=", ".join(
        # A point between two digits is kept through a letter that the data does not hold.
        f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1ꙮ\\2', 'g'), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1ꙮ\\2', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
        for c in COPY_COLUMNS
    )
)


@registry.query("p2_found", _KEY_SQL + "select keep_id, row_id as copy_id from g where row_id <> keep_id")
def p2_found(spark, sf_dir):
    return dup.copies(table(spark, sf_dir, "company_jobs_merged"), "row_id", COPY_COLUMNS)


@registry.query("p2_salted", _KEY_SQL + "select keep_id, row_id as copy_id from g where row_id <> keep_id")
def p2_salted(spark, sf_dir):
    """p2_found with a bound so low that the commoner keys of the tables go by salted two-level aggregation."""
    return dup.copies(table(spark, sf_dir, "company_jobs_merged"), "row_id", COPY_COLUMNS, hot_rows=4)


@registry.query("p2_collapsed", _KEY_SQL + "select keep_id, count(*) as n_copies from g group by keep_id")
def p2_collapsed(spark, sf_dir):
    return dup.collapsed(table(spark, sf_dir, "company_jobs_merged"), "row_id", COPY_COLUMNS)


_TERM_SQL = """
    with t as (select 关键词 as term, sum(greatest(coalesce(出现岗位数, 0), 0))::bigint as occurrences,
                      count(distinct case when 出现岗位数 > 0 then coalesce(batch_id, chr(1)) end) as records
               from skill_frequency where 关键词 is not null group by 1),
    b as (select count(distinct batch_id) as n from skill_frequency),
    m as (select term, occurrences, records, case when records between 1 and 2 then 'rare' when records > 0 and records >= 0.5 * n then 'common' end as mark from t, b)
"""


@registry.query("p4_found", _TERM_SQL + "select term, mark from m where mark is not null")
def p4_found(spark, sf_dir):
    return p4_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


@registry.query("p4_terms", _TERM_SQL + "select term, occurrences, records, mark from m")
def p4_terms(spark, sf_dir):
    return terms.marked_terms(table(spark, sf_dir, "skill_frequency"), "关键词", "batch_id", "出现岗位数")


def mapped_fields(spark, sf_dir):
    jobs, scores = table(spark, sf_dir, "company_jobs_merged"), table(spark, sf_dir, "risk_scores_subjob")
    titles, categories = table(spark, sf_dir, "title_reference"), table(spark, sf_dir, "category_reference")
    return [
        (jobs, "row_id", "title", "company_jobs_merged.title", titles, "std_title"),
        (scores, "score_id", "std_title", "risk_scores_subjob.std_title", titles, "std_title"),
        (scores, "score_id", "category", "risk_scores_subjob.category", categories, "category"),
    ]


@registry.query("p5_found")
def p5_found(spark, sf_dir):
    return map_fields(mapped_fields(spark, sf_dir))


@registry.query("p5_unmatched")
def p5_unmatched(spark, sf_dir):
    """The values that mean no entry, with how many records have them."""
    return unmatched_values(mapped_fields(spark, sf_dir))


@registry.query("p5_values")
def p5_values(spark, sf_dir):
    """Each distinct title of the postings with its entry, similarity and way of the match."""
    values = table(spark, sf_dir, "company_jobs_merged").select(F.col("title").alias("value"))
    return map_values(values, table(spark, sf_dir, "title_reference"), "std_title")


# Spelled with classes of RE2: wide letters and digits, spaces, invisible and apart characters, Han forms,
# scripts within one word, and short words of look-alikes that lean on Han or a digit.
_ALIKE = "".join(c for c in LOOKALIKES if c not in "кмтпгηγωα")
_MARKS = r"[\p{Mn}\p{Cf}]*"
_FOREIGN = r"\p{Cyrillic}\p{Greek}\p{Cherokee}\p{Armenian}"
_FORM_SQL = "|".join(
    [
        "[０-９Ａ-Ｚａ-ｚ]", r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", r"\p{Cf}", r"[\p{Latin}\p{Greek}\p{Cyrillic}]\p{Mn}",
        r"[\x{2e80}-\x{2fdf}\x{f900}-\x{fa6d}]", rf"\p{{Latin}}{_MARKS}[{_FOREIGN}]", rf"[{_FOREIGN}]{_MARKS}\p{{Latin}}",
        rf"\p{{Cyrillic}}{_MARKS}[\p{{Greek}}\p{{Cherokee}}]", rf"[\p{{Greek}}\p{{Cherokee}}]{_MARKS}\p{{Cyrillic}}",
        rf"(^|[^\p{{L}}]|\p{{Han}})[{_ALIKE}]{{1,3}}[\p{{Han}}0-9]", rf"[\p{{Han}}0-9][{_ALIKE}]{{1,3}}($|[^\p{{L}}])",
    ]
)

# A short word of look-alikes one space away from a Latin word, in a text without a letter that only its script has.
_LONE_SQL = rf"(^|[^\p{{L}}])[{_ALIKE}]{{1,3}} \p{{Latin}}|\p{{Latin}} [{_ALIKE}]{{1,3}}($|[^\p{{L}}])"


@registry.query(
    "p6_found",
    f"""
    with v as (select 'company_jobs_merged.title' as field, row_id as record_id, title as t from company_jobs_merged
        union all select 'jobinfo.职位名称', info_id, 职位名称 from jobinfo union all select 'jobinfo.学历要求', info_id, 学历要求 from jobinfo)
    select field, record_id from v where regexp_matches(t, '{_FORM_SQL}')
        or (regexp_matches(t, '{_LONE_SQL}') and not regexp_matches(regexp_replace(t, '[{_ALIKE}]', '', 'g'), '[{_FOREIGN}]'))
    """,
)
def p6_found(spark, sf_dir):
    return p6_unified(spark, sf_dir).where("kinds > 0").select("field", "record_id")


@registry.query("p6_unified")
def p6_unified(spark, sf_dir):
    one, two = [unify_text(table(spark, sf_dir, t), fields, key) for t, key, fields in FORM_FIELDS]
    return one.unionByName(two)


@registry.query("p8_ids")
def p8_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


@registry.query("p8_token_counts")
def p8_token_counts(spark, sf_dir):
    return p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_ids"))


@registry.query("p8_round_trip", "select doc_id, md5(coalesce(text, '')) as md5 from documents")
def p8_round_trip(spark, sf_dir):
    """The hash of the text that each document's ids stand for."""
    return decoded_hashes(p8_ids(spark, sf_dir))


@registry.query("p8_tree", "select doc_id, true as same from documents")
def p8_tree(spark, sf_dir):
    """Whether the ids of each document are those that cuts and trees of joins give, with bounds that nearly every text passes."""
    trees = encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", long=48, size=32, leaf=8).select("doc_id", F.col("ids").alias("joined"))
    return p8_ids(spark, sf_dir).join(trees, "doc_id").select("doc_id", (F.col("ids") == F.col("joined")).alias("same"))


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_BARE_SQL = f"regexp_replace(lower(translate(text, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"


def _shared_sql(n: int) -> str:
    """CTEs up to f: documents and items of 50 letters or more that share n letters in a row."""
    grams = f"list_transform(range(1, length(t) - {n - 2}), lambda k: substr(t, k::int, {n}))"
    return f"""
    with d as (select doc_id, {_BARE_SQL} as t from documents where text is not null), i as (select item_id, {_BARE_SQL} as t from eval_items where text is not null),
    g as (select item_id, unnest(list_distinct({grams})) as gram from i where length(t) >= {PASSAGE}),
    h as (select doc_id, unnest(list_distinct({grams})) as gram from d where length(t) >= {n}),
    f as (select distinct doc_id, item_id from h join g using (gram))
"""


_LEAK_SQL = _shared_sql(PASSAGE)


@registry.query("p9_found", _LEAK_SQL + "select doc_id, item_id from f")
def p9_found(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edited=False).where(F.col("longest_run") >= PASSAGE)
    return found.select("doc_id", "item_id").distinct()


@registry.query("p9_alignments")
def p9_alignments(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@registry.query("p9_seeded_pairs", _shared_sql(SEED) + "select doc_id, item_id from f")
def p9_seeded_pairs(spark, sf_dir):
    """The pairs that were aligned: those that share as many letters in a row as a seed has."""
    return p9_alignments(spark, sf_dir).where(F.col("longest_run") >= SEED).select("doc_id", "item_id").distinct()


@registry.query("p9_leaked_items", _LEAK_SQL + "select item_id, count(*) as documents from f group by 1")
def p9_leaked_items(spark, sf_dir):
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


@registry.query("p10_found")
def p10_found(spark, sf_dir):
    return p10_kinds(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


@registry.query("p10_kinds")
def p10_kinds(spark, sf_dir):
    return document_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


@registry.query("p10_statistics")
def p10_statistics(spark, sf_dir):
    return document_statistics(table(spark, sf_dir, "documents"), "doc_id", "text")
