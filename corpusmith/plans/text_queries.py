"""Preprocessing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith import dictionaries as D
from corpusmith.functions import text as T
from corpusmith.operators import feedback, prepare, series
from corpusmith.plans.registry import query, table

_STOP = "[" + ", ".join(f"'{w}'" for w in T.stop_words()) + "]"
_NUMBERS = "[" + ", ".join(f"'{w}'" for w in T.NUMBER_WORDS) + "]"
_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '\p{P}+', ' ', 'g'), '\s+'), lambda w: w <> '')"


def _lemma_sql(w: str) -> str:
    irregular = " ".join(f"when {w} = '{k}' then '{v}'" for k, v in T.IRREGULAR.items())
    return (
        f"case {irregular} when regexp_matches({w}, '[a-z]{{2}}ies$') then regexp_replace({w}, 'ies$', 'y') when regexp_matches({w}, '(sses|shes|ches|xes)$') then regexp_replace({w}, 'es$', '') "
        f"when regexp_matches({w}, '[a-z]{{2}}{T.DOUBLED}ing$') then regexp_replace({w}, '[a-z]ing$', '') when regexp_matches({w}, '[a-z]{{2}}{T.DOUBLED}ed$') then regexp_replace({w}, '[a-z]ed$', '') "
        f"when regexp_matches({w}, '[a-z]{{3}}ing$') then regexp_replace({w}, 'ing$', '') when regexp_matches({w}, '[a-z]{{3}}ed$') then regexp_replace({w}, 'ed$', '') when regexp_matches({w}, '[a-z]{{2}}[^su]s$') then regexp_replace({w}, 's$', '') else {w} end"
    )


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _terms(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return D.clean_terms(table(spark, d, "team_terms"), kind)


_CLEAN = "select trim(term) as term, max(trim(replacement)) as replacement from team_terms where kind = '{}' and trim(term) <> '' and trim(replacement) <> '' group by 1"
_ACRONYMS = r"list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_&]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9&]+'))"


@query("norm_text", f"select doc_id, array_to_string(list_transform(list_filter({_TOKENS}, lambda w: not list_contains({_STOP}, w)), lambda w: {_lemma_sql('w')}), ' ') as processed_text from documents")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.normalize(F.col("text")).alias("processed_text"))


@query("norm_batch", f"select doc_id, array_to_string(list_filter({_TOKENS}, lambda w: not list_contains({_STOP}, w)), ' ') as processed_text from sample_documents")
def norm_batch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_documents").select("doc_id", T.normalize(F.col("text"), lemmatize=False).alias("processed_text"))


@query("norm_fn", f"select doc_id, array_to_string(list_filter({_TOKENS}, lambda w: not list_contains(list_append({_STOP}, 'claim'), w)), ' ') as processed_text from documents where lang = 'en'")
def norm_fn(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("lang = 'en'").select("doc_id", T.normalize(F.col("text"), lemmatize=False, custom=("claim",)).alias("processed_text"))


@query("norm_stop", f"select doc_id, len(list_filter({_TOKENS}, lambda w: list_contains({_STOP}, w))) as stop_words from documents")
def norm_stop(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.filter(F.split(T.strip_punctuation(F.lower(T.text_or_empty(F.col("text")))), r"\s+"), lambda w: w != "")
    return _docs(spark, d).select("doc_id", F.size(F.filter(tokens, lambda w: w.isin(T.stop_words()))).cast("long").alias("stop_words"))


@query("norm_punct", r"select doc_id, regexp_replace(coalesce(text, ''), '\p{P}+', ' ', 'g') as plain from documents")
def norm_punct(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.strip_punctuation(T.text_or_empty(F.col("text"))).alias("plain"))


@query("norm_num", rf"select doc_id, array_to_string(list_filter({_TOKENS}, lambda w: not (regexp_matches(w, '^[+-]?[0-9][0-9.,/]*$') or list_contains({_NUMBERS}, w))), ' ') as processed_text from documents")
def norm_num(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.normalize(F.col("text"), lemmatize=False, remove_numbers=True, remove_stop_words=False).alias("processed_text"))


@query("norm_lemma", rf"select term, {_lemma_sql('term')} as lemma from (select distinct unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) as term from documents)")
def norm_lemma(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(T.words(F.col("text"))).alias("term")).distinct()
    return words.select("term", T.lemma(F.col("term")).alias("lemma"))


@query("acr_extract", f"select doc_id, array_to_string({_ACRONYMS}, ' ') as acronyms from documents")
def acr_extract(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(T.acronyms(F.col("text")), " ").alias("acronyms"))


@query("acr_count", f"select acronym, count(*) as count from (select unnest({_ACRONYMS}) as acronym from documents) group by 1")
def acr_count(spark: SparkSession, d: str) -> DataFrame:
    return prepare.acronym_counts(_docs(spark, d), "text")


@query("acr_detect", f"select acronym, count(*) as count from (select unnest({_ACRONYMS}) as acronym from sample_documents) where acronym not in (select trim(term) from team_terms where kind = 'acronym' and trim(term) <> '' and trim(replacement) <> '') group by 1 having count(*) >= 2 order by 2 desc, 1 limit 50")
def acr_detect(spark: SparkSession, d: str) -> DataFrame:
    return prepare.detect_acronyms(table(spark, d, "sample_documents"), "text", _terms(spark, d, "acronym"), limit=50)


@query("acr_detect_all", f"select acronym, count(*) as count, acronym in (select trim(term) from team_terms where kind = 'acronym' and trim(term) <> '' and trim(replacement) <> '') as known from (select unnest({_ACRONYMS}) as acronym from sample_documents) group by 1 having count(*) >= 2 order by 2 desc, 1 limit 50")
def acr_detect_all(spark: SparkSession, d: str) -> DataFrame:
    return prepare.detect_acronyms(table(spark, d, "sample_documents"), "text", _terms(spark, d, "acronym"), limit=50, include_known=True)


_EXPAND = r"""with m as (select map_from_entries(list({{'k': term, 'v': term || ' (' || replacement || ')'}})) as m from ({clean}))
select doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_&]+|[^\p{{L}}\p{{N}}_&]+'), lambda w: coalesce(m[w], w)), '') as text from sample_documents, m"""


@query("acr_expand", _EXPAND.format(clean=_CLEAN.format("acronym")))
def acr_expand(spark: SparkSession, d: str) -> DataFrame:
    known = D.as_dict(_terms(spark, d, "acronym"))
    return table(spark, d, "sample_documents").select("doc_id", prepare.expand_acronyms(F.col("text"), known).alias("text"))


_NESTED = f"""with m as (select map_from_entries(list({{'k': term, 'v': term || ' (' || replacement || ')'}})) as m from ({_CLEAN.format('acronym')}))
select doc_id, list_reduce([coalesce(text, '')] || {_ACRONYMS}, lambda acc, a: replace(acc, a, coalesce(m[a], a))) as text from sample_documents, m"""


@query("acr_expand_compat", _NESTED)
def acr_expand_compat(spark: SparkSession, d: str) -> DataFrame:
    """Every match in order replaces all occurrences, inside other words too, so repeated acronyms nest."""
    known = D.as_dict(_terms(spark, d, "acronym"))
    return table(spark, d, "sample_documents").select("doc_id", prepare.expand_acronyms(F.col("text"), known, compat=True).alias("text"))


_SCORE = "round(100.0 * (1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)), 4)"


@query("acr_suggest", f"""with words as (select distinct unnest({_ACRONYMS}) as word from documents), known as ({_CLEAN.format('acronym')}),
s as (select word, term as suggestion, replacement as value, {_SCORE.format('word', 'term')} as score from words, known)
select word, suggestion, value, score, cast(row_number() over (partition by word order by score desc, suggestion) as integer) as rank from s where score >= 60 qualify rank <= 5""")
def acr_suggest(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(T.acronyms(F.col("text"))).alias("word"))
    return prepare.suggest(words, "word", _terms(spark, d, "acronym"), "term", "replacement")


@query("acr_dict", _CLEAN.format("acronym"))
def acr_dict(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d, "acronym")


_CORRECT = f"""known as ({_CLEAN.format('correction')}), dict as (select lower(term) as word, max(replacement) as replacement from known group by 1), rights as (select distinct lower(replacement) as w from known where replacement not like '% %'),
near as (select word, w, {_SCORE.format('word', 'w')} as score, levenshtein(word, w) as dist from words, rights where length(word) >= 4),
best as (select word, w, score from near where dist <= 2 and score >= 80 qualify row_number() over (partition by word order by score desc, w desc) = 1),
fixed as (select words.word, coalesce(dict.replacement, case when words.word not in (select w from rights) then best.w end, words.word) as correction from words left join dict using (word) left join best using (word))"""
_WORDS = r"words as (select unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) as word from sample_documents)"


def _corrections(spark: SparkSession, d: str) -> dict[str, str]:
    return D.as_dict(_terms(spark, d, "correction"))


@query("spell_word", f"with raw as (select * from (with {_WORDS} select * from words)), words as (select distinct word from raw), {_CORRECT} select word, correction from fixed")
def spell_word(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "sample_documents").select(F.explode(F.regexp_extract_all(F.lower(T.text_or_empty(F.col("text"))), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return prepare.corrections_of(words, "word", _corrections(spark, d))


@query("spell_detect", f"with raw as (select * from (with {_WORDS} select * from words)), words as (select word, count(*) as count from raw where length(word) >= 4 group by 1 having count(*) >= 2), {_CORRECT} select fixed.word, words.count, correction, {_SCORE.format('fixed.word', 'correction')} as ratio from fixed join words using (word) where correction <> fixed.word")
def spell_detect(spark: SparkSession, d: str) -> DataFrame:
    return prepare.detect_misspellings(table(spark, d, "sample_documents"), "text", _corrections(spark, d))


@query("spell_text", r"""with raw as (select distinct unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) as part from documents), words as (select distinct lower(part) as word from raw), """ + _CORRECT + r""",
m as (select map_from_entries(list({'k': part, 'v': correction})) as m from raw join fixed on lower(part) = fixed.word where correction <> fixed.word)
select doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda w: coalesce(m[w], w)), '') as text from documents, m""")
def spell_text(spark: SparkSession, d: str) -> DataFrame:
    return prepare.correct_texts(_docs(spark, d).select("doc_id", "text"), "text", _corrections(spark, d))


@query("ctx_top3", r"""with known as (""" + _CLEAN.format("acronym") + r"""), toks as (select distinct doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_&]+')) as word from documents),
hits as (select word, doc_id, cast(row_number() over (partition by word order by doc_id) as integer) as rank from toks where word in (select term from known) qualify rank <= 3)
select word, doc_id, case when length(text) > 200 then text[:200] || '...' else text end as context, rank from hits join documents using (doc_id)""")
def ctx_top3(spark: SparkSession, d: str) -> DataFrame:
    return prepare.contexts(_docs(spark, d), "doc_id", "text", _terms(spark, d, "acronym"), "term")


@query("doc_stats", r"""with n as (select case when trim(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) = '' then 0 else len(string_split_regex(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+')) end as w from documents)
select count(*) as documents, count(*) filter (w > 0) as filled, round(avg(w), 4) as mean_words, cast(sum(w) as bigint) as words from n""")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return prepare.corpus_statistics(_docs(spark, d), "text")


@query("corpus_hash", "select doc_id, md5(coalesce(text, '')) as key from documents")
def corpus_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.text_or_empty(F.col("text"))).alias("key"))


@query("agg_word_freq", r"select category as topic, word, count(*) as count from (select category, unnest(string_split_regex(lower(coalesce(text, '')), '\s+')) as word from documents where category is not null) where length(word) > 3 group by 1, 2")
def agg_word_freq(spark: SparkSession, d: str) -> DataFrame:
    return prepare.word_frequencies(_docs(spark, d), "category", "text")


@query("wf_preprocess", _EXPAND.format(clean=_CLEAN.format("acronym")).replace("select doc_id, array_to_string", "select doc_id, lower(array_to_string").replace("'') as text from", "'')) as processed_text from"))
def wf_preprocess(spark: SparkSession, d: str) -> DataFrame:
    """Workflow stages in a row: acronyms expanded, then lower case."""
    known = D.as_dict(_terms(spark, d, "acronym"))
    return table(spark, d, "sample_documents").select("doc_id", F.lower(prepare.expand_acronyms(F.col("text"), known)).alias("processed_text"))


# projections and predicates
@query("prj_rename", "select doc_id as id, text as body, lang as language from documents")
def prj_rename(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "text", "lang").withColumnsRenamed({"doc_id": "id", "text": "body", "lang": "language"})


@query("prj_select", "select doc_id, category from documents")
def prj_select(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "category")


@query("flt_expr", "select doc_id, n_chars from documents where lang = 'en' and n_chars > 500")
def flt_expr(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("lang = 'en' and n_chars > 500").select("doc_id", "n_chars")


@query("flt_topic", "select obs_id, obs_value from topic_activity where topic = 'Topic_0'")
def flt_topic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_activity").where("topic = 'Topic_0'").select("obs_id", "obs_value")


@query("flt_year", "select obs_id, obs_value from topic_activity where topic = 'Topic_1' and year(obs_ts) = (select max(year(obs_ts)) from topic_activity where topic = 'Topic_1')")
def flt_year(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "topic_activity").where("topic = 'Topic_1'")
    last = some.agg(F.max(F.year("obs_ts")).alias("y"))
    return some.join(F.broadcast(last), F.year("obs_ts") == F.col("y")).select("obs_id", "obs_value")


@query("flt_contains", "select doc_id, topic from sample_documents where contains(lower(text), 'windscreen')")
def flt_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_documents").where(F.lower("text").contains("windscreen")).select("doc_id", "topic")


@query("flt_notnull", "select doc_id, latitude, longitude from claim_points where latitude is not null and longitude is not null")
def flt_notnull(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claim_points").dropna(subset=["latitude", "longitude"]).select("doc_id", "latitude", "longitude")


@query("flt_outlier", "select topic, count(*) as count from sample_documents where topic is not null and topic <> 'Noise' group by 1 having count(*) >= 10")
def flt_outlier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_documents").where("topic <> 'Noise'").groupBy("topic").agg(F.count("*").alias("count")).where("count >= 10")


@query("flt_valid", "select session_id, doc_id, corrected_topic from feedback_log where corrected_topic in (select distinct topic from sample_documents)")
def flt_valid(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "sample_documents").select(F.col("topic").alias("corrected_topic")).distinct()
    return table(spark, d, "feedback_log").join(known, "corrected_topic", "left_semi").select("session_id", "doc_id", "corrected_topic")


@query("case_unknown", "select doc_id, case when topic_probability >= 0.5 and not isnan(topic_probability) then topic else 'Unknown' end as topic from sample_documents")
def case_unknown(spark: SparkSession, d: str) -> DataFrame:
    good = (F.col("topic_probability") >= 0.5) & ~F.isnan("topic_probability")
    return table(spark, d, "sample_documents").select("doc_id", F.when(good, F.col("topic")).otherwise("Unknown").alias("topic"))


@query("cast_time", "select doc_id, strftime(doc_date, '%Y-%m-%d') as day from claim_points where doc_date is not null")
def cast_time(spark: SparkSession, d: str) -> DataFrame:
    from corpusmith.functions.periods import as_time

    text = F.date_format("doc_date", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "claim_points").select("doc_id", F.date_format(as_time(text), "yyyy-MM-dd").alias("day")).where("day is not null")


@query("cast_num", "select doc_id, try_cast(trim(postcode) as integer) as code from claim_points")
def cast_num(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claim_points").select("doc_id", F.expr("try_cast(trim(postcode) as int)").alias("code"))


# joins
@query("jn_left_names", "with n as (select topic, count(*) as documents from sample_documents where topic is not null group by 1), c as (select topic, count(*) as observations from topic_activity where topic is not null group by 1) select c.topic, observations, documents from c left join n using (topic)")
def jn_left_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "sample_documents").where("topic is not null").groupBy("topic").agg(F.count("*").alias("documents"))
    return table(spark, d, "topic_activity").where("topic is not null").groupBy("topic").agg(F.count("*").alias("observations")).join(names, "topic", "left")


@query("jn_semi_topn", "select obs_id, topic from topic_activity where topic in (select topic from topic_activity where topic is not null group by 1 order by count(*) desc, 1 limit 5)")
def jn_semi_topn(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topic_activity")
    return t.join(F.broadcast(series.top_topics(t, "topic", 5).select("topic")), "topic", "left_semi").select("obs_id", "topic")


@query("jn_anti_remaining", "select distinct doc_id from sample_documents where doc_id not in (select doc_id from feedback_log where doc_id is not null)")
def jn_anti_remaining(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_documents").select("doc_id").distinct().join(table(spark, d, "feedback_log").select("doc_id"), "doc_id", "left_anti")


@query("jn_anti_known", f"select distinct acronym from (select unnest({_ACRONYMS}) as acronym from documents) where acronym not in (select trim(term) from team_terms where kind = 'acronym' and trim(term) <> '' and trim(replacement) <> '')")
def jn_anti_known(spark: SparkSession, d: str) -> DataFrame:
    return prepare.acronym_counts(_docs(spark, d), "text").select("acronym").join(_terms(spark, d, "acronym").select(F.col("term").alias("acronym")), "acronym", "left_anti")


@query("jn_map_lookup", f"select doc_id, acronym, replacement from (select doc_id, unnest({_ACRONYMS}) as acronym from documents) join ({_CLEAN.format('acronym')}) on acronym = term")
def jn_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", F.explode(T.acronyms(F.col("text"))).alias("acronym"))
    return found.join(_terms(spark, d, "acronym").withColumnRenamed("term", "acronym"), "acronym").select("doc_id", "acronym", "replacement")


@query("jn_positional", "with s as (select doc_id, min(topic) as topic from sample_documents group by 1), p as (select doc_id, min(state_code) as state_code from claim_points group by 1) select doc_id, topic, state_code from s join p using (doc_id)")
def jn_positional(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sample_documents").groupBy("doc_id").agg(F.min("topic").alias("topic"))
    return s.join(table(spark, d, "claim_points").groupBy("doc_id").agg(F.min("state_code").alias("state_code")), "doc_id")


@query("jn_metadata", "with m as (select doc_id, max(doc_date) as doc_date, min(category) as category from claim_points group by 1) select s.doc_id, s.topic, strftime(m.doc_date, '%Y-%m-%d') as day, m.category from (select distinct doc_id, topic from sample_documents) s left join m using (doc_id)")
def jn_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "claim_points").groupBy("doc_id").agg(F.max("doc_date").alias("doc_date"), F.min("category").alias("category"))
    return table(spark, d, "sample_documents").select("doc_id", "topic").distinct().join(m, "doc_id", "left").select("doc_id", "topic", F.date_format("doc_date", "yyyy-MM-dd").alias("day"), "category")


@query("jn_full_counts", "with b as (select original_topic as topic, count(*) as before from feedback_log where original_topic is not null group by 1), a as (select corrected_topic as topic, count(*) as after from feedback_log where corrected_topic is not null group by 1) select coalesce(b.topic, a.topic) as topic, coalesce(before, 0) as before, coalesce(after, 0) as after, coalesce(after, 0) - coalesce(before, 0) as difference from b full join a on b.topic = a.topic")
def jn_full_counts(spark: SparkSession, d: str) -> DataFrame:
    return feedback.before_after(table(spark, d, "feedback_log"), "original_topic", "corrected_topic")


# sets
@query("set_union_rows", "select doc_id, topic from sample_documents union all select doc_id, topic from claim_points")
def set_union_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_documents").select("doc_id", "topic").unionByName(table(spark, d, "claim_points").select("topic", "doc_id"))


@query("set_merge", "with t as (select term, replacement, 0 as n from (" + _CLEAN.format("acronym") + ") union all select term, replacement, 1 from (" + _CLEAN.format("correction") + ") union all select 'PH', 'Policy Holder', 2) select term, replacement from t qualify row_number() over (partition by term order by n desc, replacement desc) = 1")
def set_merge(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([("PH", "Policy Holder")], "term string, replacement string")
    return D.merge(_terms(spark, d, "acronym"), _terms(spark, d, "correction"), own)


@query("set_configs", "with a as (" + _CLEAN.format("acronym") + "), b as (select * from (values ('PH', 'Policy Holder'), ('UW', 'Underwriting'), ('ZZ', 'New')) v(term, replacement)) select coalesce(a.term, b.term) as term, case when b.replacement is null then 'only_a' when a.replacement is null then 'only_b' when a.replacement = b.replacement then 'same' else 'different' end as state, a.replacement as in_a, b.replacement as in_b from a full join b on a.term = b.term")
def set_configs(spark: SparkSession, d: str) -> DataFrame:
    other = spark.createDataFrame([("PH", "Policy Holder"), ("UW", "Underwriting"), ("ZZ", "New")], "term string, replacement string")
    return D.compare(_terms(spark, d, "acronym"), other)
