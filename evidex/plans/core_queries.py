"""Queries of the record, text, classification and scoring operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex import dictionaries as D
from evidex.dictionaries import Role, Rule, TitleSpec
from evidex.functions import text as T
from evidex.operators import charts, classify, dedupe, features, scoring, similarity
from evidex.plans import pipelines
from evidex.plans.registry import Registry, table

registry = Registry()
query = registry.query

# A small study over the test vocabulary.
TITLES = TitleSpec(("高薪诚聘", "诚聘", "急聘", "急招", "储备", "资深", "senior", "2026届"), ("岗", "双休", "包吃住"), {"erp总账主管": "总账主管", "crm线索运营": "线索运营"})
RULES = (
    Rule("数据", ("etl", "湖仓", "数据", "报表", "埋点", "bi"), ("隐私",), ("数据仓库", "指标口径")),
    Rule("风险", ("反欺诈", "风险", "压力", "名单", "aml", "模型验证"), (), ("预警",)),
    Rule("研发", ("java", "rust", "前端", "kotlin", "开发", "架构师"), ("rpa",), ("接口",)),
    Rule("财务", ("会计", "票据", "总账", "清结算", "稽核"), (), ("对账", "结账")),
    Rule("营销", ("地推", "主播", "渠道", "销售", "运营"), (), ("渠道投放",)),
)
ROLES = (
    Role("核算", "会计|票据|总账|结算", "java|开发", "财务"),
    Role("数据工程", "etl|湖仓|数据|埋点", "隐私", "数据"),
    Role("工程师", "工程师|开发", "", "研发"),
    Role("渠道", "渠道|地推|主播", "", "营销"),
    Role("稀有", "诉讼档案", "", "财务"),
)
WORDS = {
    "ai": ("模型", "算法", "ai", "知识图谱", "ocr", "rag"),
    "digital": ("sql", "python", "excel", "数据", "报表", "接口"),
    "human": ("沟通", "协调", "协助", "客户", "团队"),
    "repeat": ("核对", "整理", "复核", "归档", "手工", "底稿"),
    "creative": ("创新", "设计", "搭建", "优化"),
    "rule": ("规范", "流程", "口径", "合同", "期限"),
}
PRIORS = {"数据": (58, 60, 95, 78, 45), "风险": (55, 72, 85, 75, 55), "研发": (55, 58, 92, 72, 45), "财务": (88, 90, 85, 85, 25), "营销": (45, 42, 45, 45, 85), "其他": (50, 55, 45, 40, 60)}
RATIONALES = {"数据": "指标与报表以规则加工为主", "财务": "核对与结账流程标准化"}
STUDY = D.Study(RULES, "其他", ROLES, TITLES, WORDS, {k: dict(zip(D.DIMENSIONS, map(float, v))) for k, v in PRIORS.items()}, rationales=RATIONALES, core=("财务", "风险"))


def jobs_of(spark, sf_dir):
    return table(spark, sf_dir, "company_jobs_merged")


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# --- rows and filters ---------------------------------------------------------------------------


@query("dedupe_keep_first", "select doc_id, source from documents qualify row_number() over (partition by text order by doc_id) = 1")
def dedupe_keep_first(spark, sf_dir):
    return dedupe.keep_first(table(spark, sf_dir, "documents"), ["text"], "doc_id").select("doc_id", "source")


@query("dedupe_composite", "select row_id from company_jobs_merged qualify row_number() over (partition by company_name, title, location, salary order by row_id) = 1")
def dedupe_composite(spark, sf_dir):
    return dedupe.keep_first(jobs_of(spark, sf_dir), ["company_name", "title", "location", "salary"], "row_id").select("row_id")


@query("dedupe_full_rows", "select event_id, user_id from events qualify row_number() over (partition by ts, user_id, event_type, value, props order by event_id) = 1")
def dedupe_full_rows(spark, sf_dir):
    return dedupe.drop_full_copies(table(spark, sf_dir, "events"), "event_id").select("event_id", "user_id")


@query("null_safe_exclude", "select row_id, is_dispatch from company_jobs_merged where is_dispatch is distinct from '是'")
def null_safe_exclude(spark, sf_dir):
    return jobs_of(spark, sf_dir).where(dedupe.differs(F.col("is_dispatch"), "是")).select("row_id", "is_dispatch")


_CLEAN_SQL = """
    with l as (select *, trim(split_part(location, '·', 1)) as city from company_jobs_merged qualify row_number() over (partition by job_link order by row_id) = 1),
    b as (select * from l qualify row_number() over (partition by company_name, title, city, salary order by row_id) = 1),
    c as (select * from b where is_dispatch is distinct from '是')
"""


@query("clean_postings", _CLEAN_SQL + "select row_id, city from c")
def clean_postings(spark, sf_dir):
    return dedupe.clean_postings(jobs_of(spark, sf_dir), "row_id").select("row_id", "city")


@query(
    "stage_counts",
    _CLEAN_SQL + "select 'raw' as stage, 'rows' as metric, count(*) as value from company_jobs_merged union all select 'linked', 'rows', count(*) from l union all select 'clean', 'rows', count(*) from c",
)
def stage_counts(spark, sf_dir):
    raw = jobs_of(spark, sf_dir)
    return dedupe.stage_counts({"raw": raw, "linked": dedupe.keep_first(raw, ["job_link"], "row_id"), "clean": dedupe.clean_postings(raw, "row_id")})


@query(
    "clean_frame",
    """
    with f as (select * from documents where text is not null qualify row_number() over (partition by text order by doc_id) = 1)
    select doc_id from f where length(text) between 180 and 700 and length(text) - length(replace(text, '?', '')) < 0.004::double * length(text)
    """,
)
def clean_frame(spark, sf_dir):
    return dedupe.clean_frame(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@query(
    "stratified_sample",
    """
    select doc_id, lang as stratum from documents where lang in ('zh', 'en', 'mixed')
    qualify row_number() over (partition by lang order by doc_id) <= case lang when 'zh' then 8 else 6 end
    """,
)
def stratified_sample(spark, sf_dir):
    return dedupe.stratified(table(spark, sf_dir, "documents"), F.col("lang"), {"zh": 8, "en": 6, "mixed": 6}, "doc_id").select("doc_id", "stratum")


@query("min_support", "select o_custkey, count(*) as n, max(o_totalprice) as most from orders group by 1 having count(*) >= 5")
def min_support(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most")).where("n >= 5")


@query("semi_join_core", "select score_id from risk_scores_subjob s where exists (select 1 from category_reference c where c.category = s.category)")
def semi_join_core(spark, sf_dir):
    return table(spark, sf_dir, "risk_scores_subjob").join(table(spark, sf_dir, "category_reference"), "category", "left_semi").select("score_id")


# --- text -----------------------------------------------------------------------------------------


def _affix_sql(source: str, spec: TitleSpec, passes: int = 5) -> tuple[str, str]:
    """CTEs that strip affixes token by token; the last one's name."""
    parts, at = [], source
    for i in range(passes):
        for j, (tok, front) in enumerate([(t, True) for t in spec.prefixes] + [(t, False) for t in spec.suffixes]):
            n = len(tok)
            hit, rest = (f"starts_with(s, '{tok}')", f"substr(s, {n + 1})") if front else (f"ends_with(s, '{tok}')", f"left(s, length(s) - {n})")
            parts.append(f"a{i}_{j} as (select * replace (case when {hit} and length(s) - {n} >= 2 then {rest} else s end as s) from {at})")
            at = f"a{i}_{j}"
    return ", ".join(parts), at


_TITLE_CTES, _TITLE_LAST = _affix_sql("q4", TITLES)
_TITLE_SQL = f"""
    with q0 as (select row_id, regexp_replace(regexp_replace(lower(coalesce(title, '')), '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') as b from company_jobs_merged),
    q1 as (select *, regexp_replace(regexp_replace(b, '[（(\\[【].*?[)）\\]】]', '', 'g'), '[（(\\[【].*$', '', 'g') as s from q0),
    q2 as (select * replace (regexp_replace(s, '[a-z]{{1,3}}[0-9]{{4,}}', '', 'g') as s) from q1),
    q3 as (select * replace (case when length(s) > 12 then regexp_replace(s, '[-—_/、,，|]+.*$', '', 'g') else s end as s) from q2),
    q4 as (select * replace (regexp_replace(s, '[\\s\\p{{Z}}]+', '', 'g') as s) from q3),
    {_TITLE_CTES},
    t0 as (select row_id, case when trim(s, '·-/ ') = '' then b else trim(s, '·-/ ') end as s from {_TITLE_LAST}),
    t as (select row_id, case s when 'erp总账主管' then '总账主管' when 'crm线索运营' then '线索运营' else s end as std_title from t0)
"""


def std_titles(spark, sf_dir):
    jobs = jobs_of(spark, sf_dir)
    return jobs.withColumn("std_title", T.normalize_title(F.col("title"), TITLES))


@query("title_normalize", _TITLE_SQL + "select row_id, std_title from t")
def title_normalize(spark, sf_dir):
    return std_titles(spark, sf_dir).select("row_id", "std_title")


_STRIP_CTES, _STRIP_LAST = _affix_sql("s0", TitleSpec(("red", "small", "blue", "hot", " "), ("bolt", "ring", " ")), 4)


@query("affix_strip", f"with s0 as (select p_partkey, p_name as s from part), {_STRIP_CTES} select p_partkey, s as stripped from {_STRIP_LAST}")
def affix_strip(spark, sf_dir):
    stripped = T.strip_affixes(F.col("p_name"), ("red", "small", "blue", "hot", " "), ("bolt", "ring", " "))
    return table(spark, sf_dir, "part").select("p_partkey", stripped.alias("stripped"))


@query("synonym_map", "select p_partkey, case p_type when 'ECONOMY' then 'BUDGET' when 'PROMO' then 'OFFER' else p_type end as kind from part")
def synonym_map(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.lookup(F.col("p_type"), {"ECONOMY": "BUDGET", "PROMO": "OFFER"}, F.col("p_type")).alias("kind"))


def _sql_rules(title: str, text: str) -> str:
    out = []
    for r in RULES:
        not_excluded = " and ".join(f"not contains({title}, '{x}')" for x in r.excludes) or "true"
        out += [f"when {not_excluded} and contains({title}, '{k}') then '{r.name}|{k}|title'" for k in r.keywords]
    for r in RULES:
        out += [f"when contains(substr({text}, 1, 400), '{k}') then '{r.name}|{k}|jd'" for k in r.strict]
    return "case " + " ".join(out) + " end"


_TEXT_SQL = "lower(coalesce(title, '') || chr(10) || coalesce(skills, '') || chr(10) || coalesce(jd, ''))"


def with_text(df):
    return df.withColumn("text_all", F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "skills", "jd")])))


@query(
    "rule_classify",
    _TITLE_SQL + f", r as (select row_id, {_sql_rules('std_title', _TEXT_SQL)} as r from t join company_jobs_merged using (row_id)) "
    "select row_id, split_part(r, '|', 1) as category, split_part(r, '|', 2) as keyword, split_part(r, '|', 3) as level from r where r is not null",
)
def rule_classify(spark, sf_dir):
    found = classify.rule_class(F.col("std_title"), F.col("text_all"), RULES)
    return with_text(std_titles(spark, sf_dir)).select("row_id", found.alias("r")).where("r is not null").select("row_id", "r.category", "r.keyword", "r.level")


_ROLE_SQL = "case " + " ".join(f"when regexp_matches(lower(title), '{r.pattern}')" + (f" and not regexp_matches(lower(title), '{r.exclude}')" if r.exclude else "") + f" then '{r.name}'" for r in ROLES) + " end"


@query("first_claim_roles", f"select {_ROLE_SQL} as role, count(*) as n, count(distinct official_name) as companies from company_jobs_merged where {_ROLE_SQL} is not null group by 1 having count(*) >= 5")
def first_claim_roles(spark, sf_dir):
    claimed = jobs_of(spark, sf_dir).withColumn("role", classify.claim_role(F.col("title"), ROLES)).where("role is not null")
    return claimed.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("official_name").alias("companies")).where("n >= 5")


def _sql_hits(text: str, words) -> str:
    return f"list_filter({sql_list(words)}, lambda k: contains({text}, k))"


@query("keyword_hits", f"select doc_id, array_to_string({_sql_hits('lower(text)', WORDS['repeat'])}, '|') as hits from documents where text is not null")
def keyword_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(T.keyword_hits(F.col("text"), WORDS["repeat"]), "|").alias("hits"))


_FULL_SQL = "lower(coalesce(title, '') || ' ' || coalesce(skills, '') || ' ' || coalesce(jd, ''))"
_FEATURE_SQL = (
    "with f0 as (select *, "
    + _FULL_SQL
    + " as full_text from company_jobs_merged), f1 as (select *, "
    + ", ".join(f"len({_sql_hits('full_text', words)}) as n_{d}" for d, words in WORDS.items())
    + """, case degree when '学历不限' then 1 when '中专/中技' then 1 when '高中' then 1 when '大专' then 2 when '本科' then 3 when '硕士' then 4 when '博士' then 5 else 3 end as degree_level,
    case experience when '经验不限' then 1 when '在校/应届' then 1 when '1年以内' then 1 when '1-3年' then 2 when '3-5年' then 3 when '5-10年' then 4 when '10年以上' then 5 else 2 end as exp_level,
    coalesce(
        (regexp_extract(salary, '([0-9]+(?:\\.[0-9]+)?)\\s*-\\s*([0-9]+(?:\\.[0-9]+)?)\\s*[kK]', 1)::varchar).nullif('')::double * 0 +
        (try_cast(regexp_extract(salary, '([0-9]+(?:\\.[0-9]+)?)\\s*-\\s*([0-9]+(?:\\.[0-9]+)?)\\s*[kK]', 1) as double) + try_cast(regexp_extract(salary, '([0-9]+(?:\\.[0-9]+)?)\\s*-\\s*([0-9]+(?:\\.[0-9]+)?)\\s*[kK]', 2) as double)) / 2
            * (coalesce(try_cast(regexp_extract(salary, '·\\s*([0-9]+)\\s*薪', 1) as double), 12.0::double) / 12),
        (try_cast(regexp_extract(salary, '([0-9]+)\\s*-\\s*([0-9]+)\\s*元/天', 1) as double) + try_cast(regexp_extract(salary, '([0-9]+)\\s*-\\s*([0-9]+)\\s*元/天', 2) as double)) / 2 * (21.75::double / 1000),
        (try_cast(regexp_extract(salary, '([0-9]+)\\s*-\\s*([0-9]+)\\s*元/月', 1) as double) + try_cast(regexp_extract(salary, '([0-9]+)\\s*-\\s*([0-9]+)\\s*元/月', 2) as double)) / 2 * (1::double / 1000)) as salary_k
    from f0), f as (select *, (degree_level <= 2 or exp_level <= 1)::int as low_barrier, (exp_level >= 4 or degree_level >= 4)::int as senior_barrier, """
    + ", ".join(f"(n_{d} > 0)::int as has_{d}" for d in WORDS)
    + " from f1)"
)
_FEATURE_SQL = _FEATURE_SQL.replace("(regexp_extract(salary, '([0-9]+(?:\\.[0-9]+)?)\\s*-\\s*([0-9]+(?:\\.[0-9]+)?)\\s*[kK]', 1)::varchar).nullif('')::double * 0 +\n        ", "")


@query("keyword_features", _FEATURE_SQL + " select row_id, " + ", ".join(f"n_{d}, has_{d}" for d in WORDS) + " from f")
def keyword_features(spark, sf_dir):
    f = features.job_features(jobs_of(spark, sf_dir), WORDS)
    return f.select("row_id", *[c for d in WORDS for c in (f"n_{d}", f"has_{d}")])


@query("level_map_default", _FEATURE_SQL + " select row_id, degree_level, exp_level from f")
def level_map_default(spark, sf_dir):
    return features.job_features(jobs_of(spark, sf_dir), {}).select("row_id", "degree_level", "exp_level")


@query("barrier_flags", _FEATURE_SQL + " select row_id, low_barrier, senior_barrier from f")
def barrier_flags(spark, sf_dir):
    return features.job_features(jobs_of(spark, sf_dir), {}).select("row_id", "low_barrier", "senior_barrier")


@query("salary_parse", _FEATURE_SQL + " select row_id, round(salary_k, 6) as salary_k from f")
def salary_parse(spark, sf_dir):
    return features.job_features(jobs_of(spark, sf_dir), {}).select("row_id", F.round("salary_k", 6).alias("salary_k"))


@query(
    "keyword_topk",
    f"""
    with h as (select 'human' as dimension, unnest({_sql_hits(_FULL_SQL, WORDS["human"])}) as keyword from company_jobs_merged
               union all select 'digital', unnest({_sql_hits(_FULL_SQL, WORDS["digital"])}) from company_jobs_merged),
    c as (select dimension, keyword, count(*) as n from h group by 1, 2)
    select dimension, keyword, n, round(n * 100::double / (select count(*) from company_jobs_merged), 6) as share from c
    qualify row_number() over (partition by dimension order by n desc, keyword) <= 3
    """,
)
def keyword_topk(spark, sf_dir):
    f = features.job_features(jobs_of(spark, sf_dir), {k: WORDS[k] for k in ("human", "digital")})
    return features.keyword_topk(f, {"human": "human_hits", "digital": "digital_hits"}, 3).select("dimension", "keyword", "n", F.round("share", 6).alias("share"))


# From a table texts (doc, t): grams, weights, and of each query document the best match, the earlier of equals.
_GRAMS_OF_SQL = """
    w as (select doc, ' ' || unnest(list_filter(regexp_split_to_array(lower(t), '[\\s\\p{Z}]+'), lambda x: x <> '')) || ' ' as p from texts),
    n as (select unnest([2, 3, 4]) as n),
    g as (select doc, substr(p, i::int, n::int) as gram from w, n, unnest(range(1, greatest(length(p) - n + 2, 2))) as r(i) where length(p) > n
          union all select doc, p as gram from w where length(p) <= 4)
"""
_WEIGHTS_OF_SQL = (
    _GRAMS_OF_SQL
    + """, tf as (select doc, gram, count(*) as tf from g group by 1, 2),
    idf as (select gram, ln(((select count(distinct doc) from texts) + 1)::double / (count(*) + 1)) + 1 as idf from tf group by 1),
    x as (select doc, gram, tf * idf as w from tf join idf using (gram)),
    v as (select doc, gram, w / sqrt(sum(w * w) over (partition by doc)) as weight from x)
"""
)
_GRAM_SQL = "with texts as (select p_partkey as doc, p_name as t from part), " + _GRAMS_OF_SQL


@query("ngram_explode", _GRAM_SQL + "select gram, count(*) as n, count(distinct doc) as docs from g group by 1")
def ngram_explode(spark, sf_dir):
    grams = table(spark, sf_dir, "part").select("p_partkey", F.explode(T.char_wb_ngrams(F.col("p_name"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("docs"))


_TFIDF_SQL = "with texts as (select p_partkey as doc, p_name as t from part), " + _WEIGHTS_OF_SQL


@query("tfidf_weights", _TFIDF_SQL + "select doc, gram, round(weight, 6) as weight from v")
def tfidf_weights(spark, sf_dir):
    return similarity.tfidf(table(spark, sf_dir, "part"), "p_partkey", "p_name").select("doc", "gram", F.round("weight", 6).alias("weight"))


@query(
    "cosine_argmax",
    "with texts as (select 'u:' || p_partkey as doc, p_name as t from part union all select 'p:' || p_type, p_name from part where p_type is not null), "
    + _WEIGHTS_OF_SQL
    + """, s as (select a.doc, b.doc as match, round(sum(a.weight * b.weight), 9) as score from v a join v b using (gram) where a.doc like 'u:%' and b.doc like 'p:%' group by 1, 2),
    b as (select * from s qualify row_number() over (partition by doc order by score desc, match) = 1)
    select p_partkey as doc, substr(match, 3) as match, coalesce(round(score, 6), 0) as score from part left join b on b.doc = 'u:' || p_partkey""",
)
def cosine_argmax(spark, sf_dir):
    """For each part name the most similar prototype of a part type, which is all names of the type.

    Names and prototypes are one corpus. Ties go to the earlier type; a name that shares no n-gram with
    any prototype has no match and score 0.
    """
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat(F.lit("u:"), F.col("p_partkey").cast("string")).alias("doc"), "p_name")
    types = part.where("p_type is not null").select(F.concat(F.lit("p:"), "p_type").alias("doc"), "p_name")
    weights = similarity.tfidf(names.unionByName(types), "doc", "p_name", n=part.count() + types.select("doc").distinct().count())
    found = similarity.cosine(weights.where("doc like 'u:%'"), weights.where("doc like 'p:%'"))
    best = found.groupBy("doc").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), F.substring("match", 3, 1 << 30).alias("match"))).alias("b"))
    scored = best.select("doc", F.col("b.match").alias("match"), F.round(-F.col("b.s"), 6).alias("score"))
    all_parts = part.select(F.col("p_partkey").alias("part"), F.concat(F.lit("u:"), F.col("p_partkey").cast("string")).alias("doc"))
    return all_parts.join(scored, "doc", "left").select(F.col("part").alias("doc"), "match", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(
    "embedding_cosine",
    """
    with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
    c as (select label, i, avg(x) as c from e group by 1, 2), p as (select e.vec_id, c.label, sum(e.x * c.c) / (sqrt(sum(e.x * e.x)) * sqrt(sum(c.c * c.c))) as s from e join c using (i) group by 1, 2)
    select vec_id, arg_max(label, s) as label, round(max(s), 6) as score from p group by 1
    """,
)
def embedding_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    centres = similarity.centroids(e, "label", "embedding", 64)
    return similarity.nearest_centroid(e, "vec_id", "embedding", centres, "label").select("vec_id", "label", F.round("score", 6).alias("score"))


def classified_jobs(spark, sf_dir):
    return classify.classify(with_text(std_titles(spark, sf_dir)), RULES, "其他", "row_id")


def _classified_sql(rows: str) -> str:
    """CTEs up to cls: class, method and similarity of the rows that a query gives as row_id."""
    place = f"list_position({sql_list([*(r.name for r in RULES), '其他'])}, match)"
    return (
        _TITLE_SQL
        + f""", src as ({rows}),
    r0 as (select row_id, std_title, {_sql_rules('std_title', _TEXT_SQL)} as r from t join company_jobs_merged using (row_id) semi join src using (row_id)),
    ruled as (select row_id, std_title, nullif(split_part(coalesce(r, ''), '|', 1), '') as category, split_part(coalesce(r, ''), '|', 3) as level from r0),
    p0 as (select * from ruled where level = 'title' qualify row_number() over (partition by category order by row_id) <= 400),
    texts as (select 'p:' || category as doc, string_agg(std_title, ' ' order by row_id) as t from p0 group by category
              union all select 'u:' || row_id, std_title from ruled where category is null),
    """
        + _WEIGHTS_OF_SQL
        + f""", sims as (select a.doc, substr(b.doc, 3) as match, round(sum(a.weight * b.weight), 12) as score from v a join v b using (gram) where a.doc like 'u:%' and b.doc like 'p:%' group by 1, 2),
    best as (select * from sims qualify row_number() over (partition by doc order by score desc, {place}) = 1),
    cls as (select row_id, std_title, coalesce(category, case when score >= 0.12 then match end, '其他') as category,
            case when category is not null then 'rule' when score >= 0.12 then 'embedding_sim' else 'fallback' end as assign_method,
            case when category is null then round_even(coalesce(score, 0), 4) end as sim_score from ruled left join best on best.doc = 'u:' || row_id)
    """
    )


@query("similarity_backfill", _classified_sql("select row_id from company_jobs_merged") + "select row_id, category, assign_method, sim_score from cls")
def similarity_backfill(spark, sf_dir):
    return classified_jobs(spark, sf_dir).select("row_id", "category", "assign_method", "sim_score")


@query("backfill_methods", _TITLE_SQL + f", r as (select row_id, {_sql_rules('std_title', _TEXT_SQL)} as r from t join company_jobs_merged using (row_id)) select (r is null) as unmatched, count(*) as n from r group by 1")
def backfill_methods(spark, sf_dir):
    return classified_jobs(spark, sf_dir).groupBy((F.col("assign_method") != "rule").alias("unmatched")).agg(F.count("*").alias("n"))


_NORM_SQL = "regexp_replace(regexp_replace(lower(coalesce({}, '')), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85\\-_·・.。,，、；;:：/／\\\\|｜()（）\\[\\]【】“”\"''’‘*#>+~!！?？]', '', 'g'), '[的与和及等]', '', 'g')"


@query("norm_text", f"select doc_id, {_NORM_SQL.format('text')} as norm from documents where text is not null")
def norm_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", T.norm_text(F.col("text"), wide=False).alias("norm"))


_SCALAR_SQL = "trim(regexp_replace(trim(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '。;；'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def _sql_scalar(column: str) -> str:
    bare = _SCALAR_SQL.format(column)
    tokens = ", ".join(f"'{t}'" for t in D.NULL_TOKENS)
    return f"case when lower({bare}) in ({tokens}) or regexp_matches({bare}, '^({'|'.join(D.NULL_STARTS)})') then null else {bare} end"


@query("clean_scalar", f"select info_id, {_sql_scalar('学历要求')} as degree, {_sql_scalar('经验要求')} as experience, {_sql_scalar('工作地点')} as place from jobinfo")
def clean_scalar(spark, sf_dir):
    info = table(spark, sf_dir, "jobinfo")
    return info.select("info_id", *[T.clean_scalar(F.col(c)).alias(n) for c, n in (("学历要求", "degree"), ("经验要求", "experience"), ("工作地点", "place"))])


def _sql_items(column: str) -> str:
    space = "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$"
    parts = f"regexp_split_to_array({_sql_scalar(column)}, '[、,，;；/|][\\s\\p{{Z}}]*|[\\s\\p{{Z}}]{{2,}}')"
    bare = f"list_transform({parts}, lambda x: regexp_replace(regexp_replace(trim(regexp_replace(x, '{space}', '', 'g'), '。.;；·-—*'), '{space}', '', 'g'), '^[0-9]+[.、]\\s*', ''))"
    tokens = sql_list(D.NULL_TOKENS)
    kept = f"list_filter({bare}, lambda x: not list_contains({tokens}, lower(x)))"
    return f"list_filter({kept}, lambda x, i: list_position(list_transform({kept}, lambda y: lower(y)), lower(x)) = i)"


@query("list_clean", f"select info_id, coalesce(array_to_string({_sql_items('软技能')}, '¦'), '') as items from jobinfo")
def list_clean(spark, sf_dir):
    return table(spark, sf_dir, "jobinfo").select("info_id", F.array_join(T.split_list(F.col("软技能")), "¦").alias("items"))


@query("delimited_explode", "select k as part, count(*) as n from (select unnest(list_filter(string_split(skills, '|'), lambda x: x <> '')) as k from company_jobs_merged) group by 1")
def delimited_explode(spark, sf_dir):
    return jobs_of(spark, sf_dir).select(F.explode(T.delimited(F.col("skills"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("template_fill", "select doc_id, replace('A {x} B', '{x}', text) as prompt from documents where text is not null")
def template_fill(spark, sf_dir):
    """The template filled with each whole text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", T.fill_template("A {x} B", F.col("text"), "{x}").alias("prompt"))


_TOKENS_SQL = "floor((length({0}) - length(regexp_replace({0}, '[一-鿿　-〿＀-￯]', '', 'g'))) + length(regexp_replace({0}, '[一-鿿　-〿＀-￯]', '', 'g')) / 4.0)::int"


@query("token_latency", f"select doc_id, {_TOKENS_SQL.format('text')} as tokens, round(0.35::double + {_TOKENS_SQL.format('text')} / 3000::double + 175 / 42::double, 6) as seconds from documents where text is not null")
def token_latency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return docs.select("doc_id", "tokens", F.round(T.run_seconds(F.col("tokens"), F.lit(175)), 6).alias("seconds"))


# --- aggregates, windows, scores ----------------------------------------------------------------


@query(
    "group_profile",
    _FEATURE_SQL + """ select company_industry, count(*) as n, count(distinct official_name) as companies, round(median(salary_k), 6) as pay_median, round(avg(has_ai), 6) as ai, round(avg(n_human), 6) as human
    from f where company_industry is not null group by 1""",
)
def group_profile(spark, sf_dir):
    f = features.job_features(jobs_of(spark, sf_dir), WORDS)
    p = features.group_profile(f, ["company_industry"], "official_name", "salary_k", {"ai": "has_ai", "human": "n_human"})
    return p.select("company_industry", "n", "companies", *[F.round(c, 6).alias(c) for c in ("pay_median", "ai", "human")])


def _matrix_ctes(source: str, key: str) -> str:
    """CTEs up to raw: profile and raw dimension scores of each class."""
    covers = ", ".join(f"avg(has_{d}) as {d}_cover, avg(n_{d}) as {d}_depth" for d in WORDS)
    scales = ", ".join(f"({d}_depth - min({d}_depth) over ()) / (max({d}_depth) over () - min({d}_depth) over () + 1e-9) as z_{d}" for d in WORDS)
    return f"""mg as (select {key} as category, count(*) as n, {covers}, avg(low_barrier) as low_share, avg(senior_barrier) as senior_share from {source} where {key} is not null group by 1),
    mz as (select *, {scales} from mg),
    raw as (select *, 0.40::double * repeat_cover + 0.20::double * z_repeat + 0.20::double * (1 - creative_cover) + 0.20::double * low_share as R_raw,
        0.70::double * rule_cover + 0.30::double * z_rule as S_raw, 0.70::double * digital_cover + 0.30::double * z_digital as D_raw,
        0.70::double * ai_cover + 0.30::double * z_ai as A_raw, 0.55::double * human_cover + 0.20::double * z_human + 0.25::double * senior_share as H_raw from mz)
"""


_MATRIX_SQL = _FEATURE_SQL + ", " + _matrix_ctes("f", "company_industry")


def industry_matrix(spark, sf_dir):
    f = features.job_features(jobs_of(spark, sf_dir), WORDS).withColumn("category", F.col("company_industry"))
    return features.category_matrix(f)


@query("category_matrix", _MATRIX_SQL + " select category, n, " + ", ".join(f"round({d}_raw, 6) as {d}_raw" for d in D.DIMENSIONS) + " from raw")
def category_matrix(spark, sf_dir):
    return industry_matrix(spark, sf_dir).select("category", "n", *[F.round(f"{d}_raw", 6).alias(f"{d}_raw") for d in D.DIMENSIONS])


@query(
    "minmax_calibrate",
    """
    with g as (select p_type, p_brand, avg(p_retailprice) as m from part group by 1, 2)
    select p_type, p_brand, round((m - min(m) over ()) / (max(m) over () - min(m) over () + 1e-9), 6) as unit,
           round(case when max(m) over () - min(m) over () < 1e-9 then 50 else 10 + (m - min(m) over ()) / (max(m) over () - min(m) over ()) * 80 end, 6) as calibrated from g
    """,
)
def minmax_calibrate(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("m"))
    return g.select("p_type", "p_brand", F.round(features.unit_scale(F.col("m")), 6).alias("unit"), F.round(features.calibrate(F.col("m")), 6).alias("calibrated"))


@query(
    "shrinkage_blend",
    """
    with g as (select c_nationkey, count(*) as n, avg(o_totalprice) / 5000 as data from orders join customer on o_custkey = c_custkey group by 1)
    select c_nationkey, n, round(0.6::double * n / (n + 30), 6) as weight, round(0.6::double * n / (n + 30) * data + (1 - 0.6::double * n / (n + 30)) * 50, 6) as blended from g
    """,
)
def shrinkage_blend(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    g = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 5000).alias("data"))
    weight = scoring.shrinkage(F.col("n"), 0.6, 30.0)
    return g.select("c_nationkey", "n", F.round(weight, 6).alias("weight"), F.round(scoring.blend(F.col("n"), F.col("data"), F.lit(50.0), 0.6, 30.0), 6).alias("blended"))


_DIMS_SQL = "with d as (select category, count(*) as n, avg(R) as R, avg(S) as S, avg(D) as D, avg(A) as A, avg(H) as H, sum(岗位数)::bigint as jobs from risk_scores_subjob where category is not null group by 1), s as (select *, round(0.25::double * R + 0.2::double * S + 0.2::double * D + 0.2::double * A + 0.15::double * (100 - H), 9) as Risk from d)"


def category_dims(spark, sf_dir):
    df = table(spark, sf_dir, "risk_scores_subjob").where("category is not null")
    g = df.groupBy("category").agg(F.count("*").alias("n"), *[F.avg(d).alias(d) for d in D.DIMENSIONS], F.sum("岗位数").alias("jobs"))
    return g.withColumn("Risk", F.round(scoring.weighted_score({d: F.col(d) for d in D.DIMENSIONS}), 9))


@query(
    "risk_tier_rank",
    _DIMS_SQL + """ select category, n, Risk, case when Risk >= 70 then '高替代风险' when Risk >= 40 then '中等替代风险' else '低替代风险' end as tier,
    floor(rank() over (order by Risk desc) + (count(*) over (partition by Risk) - 1) / 2.0)::int as place from s""",
)
def risk_tier_rank(spark, sf_dir):
    d = category_dims(spark, sf_dir)
    return d.select("category", "n", "Risk", scoring.tier(F.col("Risk")).alias("tier"), F.floor(scoring.average_rank(F.col("Risk"))).cast("int").alias("place"))


@query("unpivot_detail", _DIMS_SQL + " select category, dimension, round(value, 6) as value from (unpivot (select category, R, S, D, A, H from s) on R, S, D, A, H into name dimension value value)")
def unpivot_detail(spark, sf_dir):
    d = category_dims(spark, sf_dir)
    return d.unpivot("category", list(D.DIMENSIONS), "dimension", "value").select("category", "dimension", F.round("value", 6).alias("value"))


@query(
    "subgroup_offset",
    """
    with t as (select p_type, avg(p_retailprice) as m from part group by 1), g as (select p_type, p_brand, count(*) as n, avg(p_retailprice) as own from part group by 1, 2 having count(*) >= 5)
    select p_type, p_brand, n, round(least(95, greatest(5, 50 + (own - m) * 0.35::double * n / (n + 15))), 6) as score from g join t using (p_type)
    """,
)
def subgroup_offset(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    t = part.groupBy("p_type").agg(F.avg("p_retailprice").alias("m"))
    g = part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("own")).where("n >= 5").join(t, "p_type")
    moved = F.lit(50.0) + (F.col("own") - F.col("m")) * 0.35 * scoring.shrinkage(F.col("n"), 1.0, 15.0)
    return g.select("p_type", "p_brand", "n", F.round(scoring.clip(moved), 6).alias("score"))


@query("avg_tie_rank", "select c_custkey, rank() over (partition by c_nationkey order by (c_acctbal / 1000)::int desc) + (count(*) over (partition by c_nationkey, (c_acctbal / 1000)::int) - 1) / 2.0::double as place from customer")
def avg_tie_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("v", F.round(F.col("c_acctbal") / 1000).cast("int"))
    return c.select("c_custkey", scoring.average_rank(F.col("v"), [F.col("c_nationkey")]).alias("place"))


@query(
    "spearman",
    """
    with r as (select p_type, rank() over (partition by p_type order by p_size desc) + (count(*) over (partition by p_type, p_size) - 1) / 2.0 as a,
        rank() over (partition by p_type order by p_retailprice desc) + (count(*) over (partition by p_type, p_retailprice) - 1) / 2.0 as b from part)
    select p_type, round(corr(a, b), 6) as rho from r group by 1
    """,
)
def spearman(spark, sf_dir):
    by = [F.col("p_type")]
    r = table(spark, sf_dir, "part").select("p_type", scoring.average_rank(F.col("p_size"), by).alias("a"), scoring.average_rank(F.col("p_retailprice"), by).alias("b"))
    return r.groupBy("p_type").agg(F.round(scoring.correlation("a", "b"), 6).alias("rho"))


def _scenario_sql() -> str:
    rows = ", ".join(f"('{name}', {', '.join(f'{w[d]!r}::double' for d in D.DIMENSIONS)})" for name, w in scoring.scenario_weights().items())
    return f"(values {rows}) as w(scenario, wr, ws, wd, wa, wh)"


@query(
    "sensitivity_scenarios",
    _DIMS_SQL + f""", x as (select scenario, category, Risk, round(wr * R + ws * S + wd * D + wa * A + wh * (100 - H), 9) as v from s, {_scenario_sql()}),
    r as (select *, rank() over (partition by scenario order by Risk desc) + (count(*) over (partition by scenario, Risk) - 1) / 2.0 as a,
          rank() over (partition by scenario order by v desc) + (count(*) over (partition by scenario, v) - 1) / 2.0 as b from x)
    select scenario, round(corr(a, b), 6) as rho, round(max(v) - min(v), 6) as spread from r group by 1""",
)
def sensitivity_scenarios(spark, sf_dir):
    s = scoring.sensitivity(category_dims(spark, sf_dir))
    return s.select("scenario", F.round("rho", 6).alias("rho"), F.round("spread", 6).alias("spread"))


@query("share_of_total", "select event_type, count(*) as n, round(count(*) * 100::double / sum(count(*)) over (), 6) as share from events group by 1")
def share_of_total(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", "n", F.round(features.share_of_total(F.col("n")), 6).alias("share"))


@query("value_counts", "select source as value, count(*) as n, round(count(*) * 100::double / sum(count(*)) over (), 6) as share from documents where source is not null group by 1")
def value_counts(spark, sf_dir):
    return features.value_counts(table(spark, sf_dir, "documents"), "source").select("value", "n", F.round("share", 6).alias("share"))


@query("argmax_argmin", "select p_type, arg_max(p_partkey, p_retailprice * 1000000 - p_partkey) as dearest, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) as cheapest from part group by 1")
def argmax_argmin(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(
        F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest")
    )


@query("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    clustered = scoring.kmeans(category_dims(spark, sf_dir), list(D.DIMENSIONS), 3)
    named = scoring.name_clusters(clustered, "Risk", ["high", "middle", "low"])
    return named.select("category", "Risk", "cluster_name")


@query("cluster_agreement")
def cluster_agreement(spark, sf_dir):
    tier = scoring.tier(F.col("Risk"), ((70.0, "high"), (40.0, "middle"), (0.0, "low")))
    return kmeans_labels(spark, sf_dir).agg(scoring.agreement(tier, F.col("cluster_name")).alias("agreement"))


_TASKS = [("A", 56.0), ("C", 18.0), ("C", 10.0), ("H", 12.0), ("H", 4.0)]


@query("task_hours", "with t as (select owner, sum(share) as before from (values " + ", ".join(f"('{o}', {s}::double)" for o, s in _TASKS) + ") as v(owner, share) group by 1), a as (select *, before * case owner when 'A' then 0.15::double when 'C' then 0.55::double else 1 end as l from t) select owner, before, round(l / sum(l) over () * 100, 6) as after from a")
def task_hours(spark, sf_dir):
    tasks = spark.createDataFrame(_TASKS, "owner string, share double")
    return scoring.time_structure(tasks).select("owner", "before", F.round("after", 6).alias("after"))


_OWNERS = {"A": "AI主导·人监督", "C": "人机协同", "H": "人类主导·AI辅助"}


@query("task_export", "select owner, share, case owner when 'A' then 'AI主导·人监督' when 'C' then '人机协同' when 'H' then '人类主导·AI辅助' end as label from (values " + ", ".join(f"('{o}', {s}::double)" for o, s in _TASKS) + ") as v(owner, share)")
def task_export(spark, sf_dir):
    tasks = spark.createDataFrame(_TASKS, "owner string, share double")
    return tasks.withColumn("label", T.lookup(F.col("owner"), _OWNERS, F.lit(None).cast("string")))


@query("enum_align", "select ref_id, c.category, coalesce(n, 0) as n, companies from category_reference c left join (select category, count(*) as n, max(公司数) as companies from risk_scores_subjob where Risk >= 55 group by 1) s using (category)")
def enum_align(spark, sf_dir):
    """Counts in the order of the reference list, which also has the classes without rows."""
    counted = table(spark, sf_dir, "risk_scores_subjob").where("Risk >= 55").groupBy("category").agg(F.count("*").alias("n"), F.max("公司数").alias("companies"))
    aligned = table(spark, sf_dir, "category_reference").join(counted, "category", "left").na.fill(0, ["n"])
    return aligned.select("ref_id", "category", "n", "companies").orderBy("ref_id")


@query("quadrants", _DIMS_SQL + " select category, case when Risk >= 50 and H >= 50 then 'I' when Risk < 50 and H >= 50 then 'II' when Risk < 50 and H < 50 then 'III' else 'IV' end as quadrant, round(90 + pow(n, 0.62) * 26, 6) as size from s")
def quadrants(spark, sf_dir):
    return charts.risk_matrix(category_dims(spark, sf_dir), "category").select("category", "quadrant", F.round("size", 6).alias("size"))


@query("chart_radar", _DIMS_SQL + " select category, dimension, round(value, 6) as value from (unpivot (select category, R, S, D, A, H from s where category in ('数据工程治理', '渠道拓客')) on R, S, D, A, H into name dimension value value)")
def chart_radar(spark, sf_dir):
    return charts.radar(category_dims(spark, sf_dir), "category", ["渠道拓客", "数据工程治理"]).select("category", "dimension", F.round("value", 6).alias("value"))


@query("chart_heatmap", _DIMS_SQL + " select category, round(R, 6) as R, round(S, 6) as S, round(D, 6) as D, round(A, 6) as A, round(H, 6) as H, Risk from s")
def chart_heatmap(spark, sf_dir):
    return charts.heatmap(category_dims(spark, sf_dir), "category").select("category", *[F.round(d, 6).alias(d) for d in D.DIMENSIONS], "Risk")


@query("chart_coverage", _MATRIX_SQL + " select category, " + ", ".join(f"round({d}_cover * 100, 6) as {d}" for d in WORDS) + " from raw")
def chart_coverage(spark, sf_dir):
    return charts.coverage(industry_matrix(spark, sf_dir)).select("category", *[F.round(d, 6).alias(d) for d in WORDS])


@query("pivot_coverage", "select source, count(*) filter (lang = 'zh') as zh, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'mixed') as mixed from documents where source is not null group by 1")
def pivot_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").pivot("lang", ["zh", "en", "mixed"]).agg(F.count(F.lit(1)))
    return p.na.fill(0, ["zh", "en", "mixed"])


@query("category_summary", _TITLE_SQL + " select company_industry as category, count(*) as n, count(distinct official_name) as companies, count(distinct std_title) as titles from t join company_jobs_merged using (row_id) group by 1")
def category_summary(spark, sf_dir):
    jobs = std_titles(spark, sf_dir).withColumn("category", F.col("company_industry"))
    return pipelines.category_summary(jobs).select("category", "n", "companies", "titles")


@query("title_map", _TITLE_SQL + " select title, std_title, company_industry as category, count(*) as n from t join company_jobs_merged using (row_id) where title is not null and company_industry is not null group by 1, 2, 3")
def title_map(spark, sf_dir):
    return pipelines.title_map(std_titles(spark, sf_dir).withColumn("category", F.col("company_industry")))


@query("order_segments", "select o_orderpriority, count(distinct l_orderkey) as orders, count(*) as n, round(median(l_extendedprice), 6) as middle, round(avg(l_discount), 6) as discount from lineitem join orders on l_orderkey = o_orderkey group by 1")
def order_segments(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    g = joined.groupBy("o_orderpriority").agg(F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"))
    middle = features.exact_median(joined, ["o_orderpriority"], "l_extendedprice", "middle")
    return g.join(middle, "o_orderpriority").select("o_orderpriority", "orders", "n", F.round("middle", 6).alias("middle"), "discount")


# --- whole pipelines ------------------------------------------------------------------------------


def _each(text: str, end: str = ", ") -> str:
    """The text once for each dimension, {d} being its name."""
    return end.join(text.replace("{d}", d) for d in D.DIMENSIONS)


def _risk_sql(of: str = "{d}") -> str:
    return " + ".join(f"{w!r}::double * " + ("(100 - " + of.format(d=d) + ")" if d == "H" else of.format(d=d)) for d, w in D.WEIGHTS.items())


_TIER_SQL = "case when Risk >= 70 then '高替代风险' when Risk >= 40 then '中等替代风险' else '低替代风险' end"
_OWN = {"R": "has_repeat", "S": "has_rule", "D": "has_digital", "A": "has_ai", "H": "has_human"}
_OWN_SQL = ", ".join(f"avg({c}) as own_{d}" for d, c in _OWN.items()) + ", avg(low_barrier) as own_low"
_MEANS_SQL = ", ".join(f"avg({c}) as mean_{d}" for d, c in _OWN.items()) + ", avg(low_barrier) as mean_low"
_PRIOR_ROWS = ", ".join(f"('{c}', {', '.join(f'{float(x)!r}::double' for x in p)})" for c, p in PRIORS.items())
_PIPELINE_SQL = (
    "with " + _CLEAN_SQL.strip().removeprefix("with ") + ", " + _classified_sql("select row_id from c").strip().removeprefix("with ") + ", " + _FEATURE_SQL.removeprefix("with ")
    + ", jobs as (select f.*, cls.category, cls.std_title, cls.assign_method from f join cls using (row_id)), " + _matrix_ctes("jobs", "category")
    + ", cal as (select *, " + _each("round_even(case when max({d}_raw) over () - min({d}_raw) over () < 1e-9 then 50 else 10::double + ({d}_raw - min({d}_raw) over ()) / (max({d}_raw) over () - min({d}_raw) over ()) * 80::double end, 2) as {d}_data") + " from raw)"
    + f", prior as (select * from (values {_PRIOR_ROWS}) as p(category, {_each('{d}_expert')}))"
    + ", sc0 as (select cal.*, " + _each("{d}_expert") + ", " + ", ".join(f"{w!r}::double * n / (n + 30) as {d}_weight" for d, w in D.EVIDENCE_WEIGHTS.items()) + " from cal join prior using (category))"
    + ", sc1 as (select *, " + _each("round_even({d}_weight * {d}_data + (1 - {d}_weight) * {d}_expert, 2) as {d}") + " from sc0)"
    + f", sc2 as (select *, round_even({_risk_sql()}, 1) as Risk from sc1)"
    + f", sc as (select *, {_TIER_SQL} as tier, floor(rank() over (order by Risk desc) + (count(*) over (partition by Risk) - 1) / 2.0)::int as place from sc2)"
    + f", base as (select category as anchor, {_MEANS_SQL}, " + _each("any_value(sc.{d}) as base_{d}") + " from jobs join sc using (category) group by 1)"
)


def _offset_sql(source: str, name: str, barrier: str) -> str:
    """CTEs up to name: the anchor's score moved by the group's own evidence."""
    w = "(1.0::double * n / (n + 15))"
    moved = _each(f"round_even(greatest(5, least(base_{{d}} + (own_{{d}} - mean_{{d}}) * 35::double * {w}, 95)), 2) as {{d}}")
    return (
        f"{name}0 as (select *, {w} as weight, {moved} from {source} join base using (anchor)), "
        f"{name}1 as (select * replace (round_even(greatest(5, least(R + (own_low - mean_low) * 12 * {barrier}, 95)), 2) as R) from {name}0), "
        f"{name} as (select *, round_even({_risk_sql()}, 1) as Risk from {name}1)"
    )


_REASON_SQL = "case category " + " ".join(f"when '{c}' then '{r}'" for c, r in RATIONALES.items()) + " end"


@query("pipeline_scores", _PIPELINE_SQL + f" select category, n, {_each('{d}')}, Risk, tier, place, category in ('财务', '风险') as is_core, {_REASON_SQL} as rationale from sc")
def pipeline_scores(spark, sf_dir):
    """Postings to class scores: clean, normalise, classify, features, matrix, blend, risk."""
    return pipelines.scored(jobs_of(spark, sf_dir), STUDY)["scores"].select("category", "n", *D.DIMENSIONS, "Risk", "tier", "place", "is_core", "rationale")


@query("pipeline_clusters")
def pipeline_clusters(spark, sf_dir):
    """The scored classes with the cluster that each is in, named from the riskiest on."""
    scores = pipelines.scored(jobs_of(spark, sf_dir), STUDY)["scores"]
    return scoring.with_clusters(scores).select("category", "Risk", "tier", "cluster_name")


_HIT_ROWS_SQL = " union all ".join(f"select '{d}' as dimension, unnest({_sql_hits('full_text', words)}) as keyword from jobs" for d, words in WORDS.items())


@query(
    "pipeline_keywords",
    _PIPELINE_SQL
    + f""", hr as ({_HIT_ROWS_SQL}), hc as (select dimension, keyword, count(*) as n from hr group by 1, 2)
    select dimension, keyword, n, round(n * 100::double / (select count(*) from jobs), 6) as share from hc qualify row_number() over (partition by dimension order by n desc, keyword) <= 30""",
)
def pipeline_keywords(spark, sf_dir):
    """The commonest keywords of each dimension among the clean postings."""
    return pipelines.scored(jobs_of(spark, sf_dir), STUDY)["keywords"].select("dimension", "keyword", "n", F.round("share", 6).alias("share"))


@query(
    "pipeline_detail",
    _PIPELINE_SQL + " " + _each("select category, '{d}' as dimension, {d}_data as data, {d}_expert as prior, round_even({d}_weight, 3) as weight, {d} as blended from sc", " union all "),
)
def pipeline_detail(spark, sf_dir):
    return pipelines.scored(jobs_of(spark, sf_dir), STUDY)["detail"]


@query(
    "pipeline_subgroups",
    _PIPELINE_SQL
    + f", own as (select category, category as anchor, std_title, count(*) as n, count(distinct official_name) as companies, {_OWN_SQL} from jobs where std_title is not null group by 1, 2, 3 having count(*) >= 5), "
    + _offset_sql("own", "sg", "1.0::double")
    + f" select category, std_title, n, companies, {_each('{d}')}, Risk, {_TIER_SQL} as tier, category in ('财务', '风险') as is_core from sg",
)
def pipeline_subgroups(spark, sf_dir):
    return pipelines.scored(jobs_of(spark, sf_dir), STUDY)["subgroups"].select("category", "std_title", "n", "companies", *D.DIMENSIONS, "Risk", "tier", "is_core")


_ANCHORS_SQL = ", ".join(f"('{r.name}', '{r.anchor}', {i})" for i, r in enumerate(ROLES))
_ROLES_SQL = (
    _PIPELINE_SQL
    + f", claims as (select *, {_ROLE_SQL} as role from jobs), own as (select role, anchor, ord, count(*) as n, {_OWN_SQL} from claims join (values {_ANCHORS_SQL}) as an(role, anchor, ord) using (role) group by 1, 2, 3), "
    + "kept as (select * from own where n >= 5), " + _offset_sql("kept", "ro", "weight")
)


@query(
    "pipeline_roles",
    _ROLES_SQL
    + f" select row_number() over (order by Risk desc, ord)::int as place, role, anchor, n, {_each('{d}')}, Risk, {_TIER_SQL} as tier, round_even(n * 100::double / (select count(*) from jobs), 2) as share, round(own_R, 6) as own_R, round_even(weight, 3) as weight, case when n >= 50 then 'strong' when n >= 20 then 'middle' else 'weak' end as strength from ro",
)
def pipeline_roles(spark, sf_dir):
    return pipelines.scored(jobs_of(spark, sf_dir), STUDY)["roles"].select("place", "role", "anchor", "n", *D.DIMENSIONS, "Risk", "tier", "share", F.round("own_R", 6).alias("own_R"), "weight", "strength")


_LOG_SQL = (
    _ROLES_SQL.replace(", kept as (", f", sgs as (select category, std_title from jobs where std_title is not null group by 1, 2 having count(*) >= 5), kept as (", 1)
    + f""", tiers as (select *, {_TIER_SQL} as t from sc) select 'clean' as stage, 'raw' as metric, count(*)::double as value from company_jobs_merged union all select 'clean', 'by link', count(*) from l
    union all select 'clean', 'clean', count(*) from c union all select 'clean', 'companies', count(distinct official_name) from jobs union all select 'clean', 'titles', count(distinct title) from jobs
    union all select 'clean', 'standard titles', count(distinct std_title) from jobs union all select 'classify', assign_method, count(*) from jobs group by 2
    union all select 'features', 'ai', round(avg(has_ai) * 100, 2) from jobs union all select 'features', 'digital', round(avg(has_digital) * 100, 2) from jobs
    union all select 'features', 'human', round(avg(has_human) * 100, 2) from jobs union all select 'features', 'pay', round(avg((salary_k is not null)::int) * 100, 2) from jobs
    union all select 'scores', 'highest', max(Risk) from sc union all select 'scores', 'lowest', min(Risk) from sc union all select 'scores', 'classes', count(*) from sc union all select 'tiers', t, count(*) from tiers group by 2
    union all select 'roles', 'ranked', count(*) from ro union all select 'roles', 'coverage', round(sum(round_even(n * 100::double / (select count(*) from jobs), 2)) / 100, 3) from ro
    union all select 'roles', 'dropped', {len(ROLES)} - count(*) from ro union all select 'subgroups', 'scored', count(*) from sgs"""
)


@query("pipeline_log", _LOG_SQL)
def pipeline_log(spark, sf_dir):
    """Counts and rates of the scoring pipeline's run."""
    return pipelines.run_log(jobs_of(spark, sf_dir), pipelines.scored(jobs_of(spark, sf_dir), STUDY))


def _cases_sql() -> str:
    """Rows (scenario, label, base, score) of all scenarios, rounded so that scores equal but for the last bits are tied."""
    cases = {name: " + ".join(f"{w[d]!r}::double * " + ("(100 - H)" if d == "H" else d) for d in D.DIMENSIONS) for name, w in scoring.scenario_weights().items()}
    cases |= {"prior only": _risk_sql("{d}_expert"), "data only": _risk_sql("{d}_data")}
    return " union all ".join(f"select '{name}' as scenario, category as label, Risk as base, round({x}, 9) as score from sc" for name, x in cases.items())


_ORDER_SQL = f"list_position({sql_list([*(r.name for r in RULES), '其他'])}, label)"


@query(
    "pipeline_sensitivity",
    _PIPELINE_SQL
    + f""", cases as ({_cases_sql()}), places as (select *, rank() over (partition by scenario order by base desc) + (count(*) over (partition by scenario, base) - 1) / 2.0 as rb,
    rank() over (partition by scenario order by score desc) + (count(*) over (partition by scenario, score) - 1) / 2.0 as rs,
    row_number() over (partition by scenario order by score desc, {_ORDER_SQL}) as top, row_number() over (partition by scenario order by score, {_ORDER_SQL}) as low from cases)
    select scenario, round(corr(rb, rs), 6) as rho, max(label) filter (top = 1) as highest, max(label) filter (low = 1) as lowest, round(max(score) - min(score), 6) as spread from places group by 1""",
)
def pipeline_sensitivity(spark, sf_dir):
    found = pipelines.scored(jobs_of(spark, sf_dir), STUDY)["sensitivity"]
    return found.select("scenario", F.round("rho", 6).alias("rho"), "highest", "lowest", F.round("spread", 6).alias("spread"))


@query("chart_role_ranking", _ROLES_SQL + f" select row_number() over (order by Risk desc, ord)::int as place, role, Risk, {_TIER_SQL} as tier, n < 20 as hatched from ro")
def chart_role_ranking(spark, sf_dir):
    return charts.role_ranking(pipelines.scored(jobs_of(spark, sf_dir), STUDY)["roles"])


@query(
    "chart_risk_pay",
    _PIPELINE_SQL
    + """, pm as (select category, median(salary_k) as pay from jobs where salary_k is not null group by 1)
    select category, Risk as x, round(pay, 6) as y, round(90 + pow(n, 0.62) * 22, 6) as size,
           case when Risk >= 50 and pay >= 12 then 'I' when Risk < 50 and pay >= 12 then 'II' when Risk < 50 and pay < 12 then 'III' else 'IV' end as quadrant from sc join pm using (category)""",
)
def chart_risk_pay(spark, sf_dir):
    points = charts.risk_pay(pipelines.scored(jobs_of(spark, sf_dir), STUDY)["scores"], "category", 12.0)
    return points.select("category", "x", F.round("y", 6).alias("y"), F.round("size", 6).alias("size"), "quadrant")
