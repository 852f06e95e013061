"""Aggregates over time, space and category, windows and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.functions import periods as P
from corpusmith.operators import feedback, series
from corpusmith.plans.registry import query, table


def _act(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_activity")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claim_points")


_SOME = "select * from topic_activity where obs_ts is not null and topic is not null"
_WEEK = "cast(date_trunc('week', obs_ts) as date) + 6"
_QUARTER = "last_day(cast(date_trunc('quarter', obs_ts) as date) + interval 2 month)"


def _grid(period: str, value: str = "cast(count(*) as double)", top: int | None = None, order: str = "count(*)") -> str:
    limit = f" and topic in (select topic from topic_activity where obs_ts is not null and topic is not null group by 1 order by {order} desc, 1 limit {top})" if top else ""
    return f"""with cells as (select strftime({period}, '%Y-%m-%d') as period_end, topic, {value} as value from topic_activity where obs_ts is not null and topic is not null{limit} group by 1, 2),
grid as (select * from (select distinct period_end from cells), (select distinct topic from cells)),
filled as (select period_end, topic, coalesce(value, 0.0) as value from grid left join cells using (period_end, topic))"""


def _day(df: DataFrame, col: str = "period_end") -> DataFrame:
    return df.withColumn(col, F.date_format(col, "yyyy-MM-dd"))


@query("agg_topic_dist", "select topic, count(*) as count from sample_documents where topic is not null group by 1")
def agg_topic_dist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_documents").where("topic is not null").groupBy("topic").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "topic")


@query("agg_topic_props", "select topic, round(avg(value), 6) as mean from (select event_type as topic, value from events) group by 1")
def agg_topic_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("topic")).agg(F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("mean"), "topic")


@query("agg_topics_df", "select topic, count(*) as size, topic = 'Noise' as noise from sample_documents where topic is not null group by 1")
def agg_topics_df(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_documents").where("topic is not null").groupBy("topic").agg(F.count("*").alias("size")).withColumn("noise", F.col("topic") == "Noise").orderBy(F.desc("size"), "topic")


@query("agg_period_topic", _grid(_WEEK) + " select * from filled")
def agg_period_topic(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.topic_periods(_act(spark, d), "obs_ts", "topic", "W"))


@query("agg_period_topic_sum", _grid("last_day(obs_ts)", "cast(coalesce(sum(obs_value), 0) as double)", 5, "coalesce(sum(obs_value), 0)") + " select period_end, topic, round(100.0 * value / nullif(sum(value) over (partition by period_end), 0), 6) as value from filled")
def agg_period_topic_sum(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.topic_periods(_act(spark, d), "obs_ts", "topic", "M", "obs_value", top=5, normalize=True)).withColumn("value", F.round("value", 6))


@query("agg_period_dense", """with cells as (select cast(logged_at as date) as p, corrected_topic as topic, cast(count(*) as double) as value from feedback_log where logged_at is not null and corrected_topic is not null group by 1, 2),
days as (select cast(unnest(generate_series(min(p), max(p), interval 1 day)) as date) as p from cells), grid as (select * from days, (select distinct topic from cells))
select strftime(p, '%Y-%m-%d') as period_end, topic, coalesce(value, 0.0) as value from grid left join cells using (p, topic)""")
def agg_period_dense(spark: SparkSession, d: str) -> DataFrame:
    """Days without any review between the first and the last appear with zeros."""
    return _day(series.topic_periods(table(spark, d, "feedback_log"), "logged_at", "corrected_topic", "D", densify=True))


@query("agg_period_topic_wide", "select strftime(cast(ts as date), '%Y-%m-%d') as period_end, " + ", ".join(f"cast(count(*) filter (event_type = '{t}') as double) as {t}" for t in ("click", "error", "purchase", "signup", "view")) + " from events where ts is not null group by 1")
def agg_period_topic_wide(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.topic_periods_wide(table(spark, d, "events"), "ts", "event_type", ["click", "error", "purchase", "signup", "view"], "D"))


@query("win_cumsum", _grid("last_day(obs_ts)", top=10) + " select period_end, topic, sum(value) over (partition by topic order by period_end rows unbounded preceding) as value from filled")
def win_cumsum(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.topic_periods(_act(spark, d), "obs_ts", "topic", "M", top=10, cumulative=True))


@query("win_share", _grid(_QUARTER) + " select period_end, topic, round(100.0 * value / nullif(sum(value) over (partition by period_end), 0), 6) as value from filled")
def win_share(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.topic_periods(_act(spark, d), "obs_ts", "topic", "Q", normalize=True)).withColumn("value", F.round("value", 6))


@query("agg_heatmap", _grid(_QUARTER, top=10) + " select period_end, topic, value, period_end[:4] || ' Q' || cast(quarter(cast(period_end as date)) as varchar) as label from filled")
def agg_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.heatmap(_act(spark, d), "obs_ts", "topic", "Q", top=10))


@query("agg_area", _grid(_WEEK, top=8) + " select period_end, topic, round(100.0 * value / nullif(sum(value) over (partition by period_end), 0), 6) as value from filled")
def agg_area(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.topic_periods(_act(spark, d), "obs_ts", "topic", "W", top=8, normalize=True)).withColumn("value", F.round("value", 6))


@query("agg_ridge", _grid("last_day(obs_ts)", top=10) + """, shares as (select period_end, topic, 100.0 * value / nullif(sum(value) over (partition by period_end), 0) as value from filled),
places as (select topic, row_number() over (order by round(sum(value), 6) desc, topic) - 1 as place from shares group by 1)
select period_end, topic, round(value, 6) as value, cast(place as integer) as place, round(place * 0.05 * (select max(value) from shares), 6) as baseline from shares join places using (topic)""")
def agg_ridge(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.ridge(_act(spark, d), "obs_ts", "topic", "M")).withColumn("value", F.round("value", 6)).withColumn("baseline", F.round("baseline", 6))


@query("agg_calendar", """with y as (select max(year(obs_ts)) as y from topic_activity where topic = 'Topic_0'), days as (select unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), interval 1 day)) as day from y),
c as (select cast(obs_ts as date) as day, cast(count(*) as double) as value from topic_activity where topic = 'Topic_0' group by 1)
select strftime(days.day, '%Y-%m-%d') as day, coalesce(value, 0.0) as value, month(days.day) as month, day(days.day) as dom, isodow(days.day) - 1 as weekday, week(days.day) as week, month(days.day) * 100 + week(days.day) as month_week from days left join c on days.day = c.day""")
def agg_calendar(spark: SparkSession, d: str) -> DataFrame:
    out = _day(series.calendar(_act(spark, d), "obs_ts", "topic", "Topic_0"), "day")
    return out.select("day", "value", *[F.col(c).cast("long").alias(c) for c in ("month", "dom", "weekday", "week", "month_week")])


@query("jn_left_calendar", """with days as (select unnest(generate_series(date '2024-01-01', date '2024-12-31', interval 1 day)) as day), c as (select cast(obs_ts as date) as day, cast(coalesce(sum(obs_value), 0) as double) as value from topic_activity where topic = 'Topic_2' group by 1)
select strftime(days.day, '%Y-%m-%d') as day, coalesce(value, 0.0) as value from days left join c on days.day = c.day""")
def jn_left_calendar(spark: SparkSession, d: str) -> DataFrame:
    return _day(series.calendar(_act(spark, d), "obs_ts", "topic", "Topic_2", 2024, "obs_value"), "day").select("day", "value")


@query("agg_space_time", """with c as (select topic, strftime(doc_date, '%Y-%m') as period, state_code as region, cast(count(*) as double) as value from claim_points where doc_date is not null and state_code is not null and topic is not null group by 1, 2, 3)
select *, round(100.0 * value / nullif(sum(value) over (partition by topic, period), 0), 6) as share from c""")
def agg_space_time(spark: SparkSession, d: str) -> DataFrame:
    return series.space_time(_points(spark, d), "doc_date", "state_code", "topic").withColumn("share", F.round("share", 6))


@query("agg_cat_time", """with src as (select * from claim_points where doc_date is not null and category is not null and topic is not null), best as (select topic from src group by 1 order by count(*) desc, 1 limit 5),
c as (select category, cast(year(doc_date) as varchar) || 'Q' || cast(quarter(doc_date) as varchar) as period, topic, cast(count(*) as double) as value from src where topic in (select topic from best) group by 1, 2, 3)
select *, round(100.0 * value / nullif(sum(value) over (partition by category, period), 0), 6) as share from c""")
def agg_cat_time(spark: SparkSession, d: str) -> DataFrame:
    return series.category_time(_points(spark, d), "doc_date", "category", "topic", "Q").withColumn("share", F.round("share", 6))


_ANIMATED = """with c as (select strftime(doc_date, '%Y-%m') as period, topic, latitude as lat, longitude as lon, cast(coalesce(sum(importance), 0) as double) as value from claim_points where doc_date is not null and topic is not null and latitude is not null and longitude is not null group by 1, 2, 3, 4),
w as (select *, min(value) over (partition by period) as low, max(value) over (partition by period) as high from c)
select period, topic, lat, lon, value, round(case when high > low then 5 + (value - low) / (high - low) * 20 else 25.0 end, 6) as size from w"""


@query("agg_animated", _ANIMATED)
def agg_animated(spark: SparkSession, d: str) -> DataFrame:
    return series.animated_map(_points(spark, d), "doc_date", "topic", "latitude", "longitude", "M", "importance").withColumn("size", F.round("size", 6))


@query("win_minmax", "with c as (select event_type as topic, strftime(ts, '%Y-%m-%d') as period, count(*) as value from events group by 1, 2) select topic, period, value, round(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) else 1.0 end, 6) as scaled from c window w as (partition by period)")
def win_minmax(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "events").groupBy(F.col("event_type").alias("topic"), F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("value"))
    return cells.withColumn("scaled", F.round(series.rescale("value", 0.0, 1.0, "period"), 6))


@query("agg_marker", "with s as (select doc_id, latitude as lat, longitude as lon, cast(importance as double) as value from claim_points where latitude is not null and longitude is not null), m as (select min(value) as low, max(value) as high from s) select doc_id, lat, lon, value, round(case when high > low then 5 + (value - low) / (high - low) * 20 else 25.0 end, 6) as size from s, m")
def agg_marker(spark: SparkSession, d: str) -> DataFrame:
    return series.point_map(_points(spark, d), "doc_id", "latitude", "longitude", "importance").withColumn("size", F.round("size", 6))


@query("agg_region", "select state_code as region, topic, cast(count(*) as double) as value from claim_points where state_code is not null and topic is not null group by 1, 2")
def agg_region(spark: SparkSession, d: str) -> DataFrame:
    return series.regions(_points(spark, d), "state_code", "topic")


for _how, _sql in (("sum", "cast(sum(importance) as double)"), ("mean", "round(avg(importance), 6)"), ("median", "cast(median(importance) as double)"), ("max", "cast(max(importance) as double)"), ("min", "cast(min(importance) as double)")):

    @query(f"agg_region_{_how}", f"select state_code as region, topic, {_sql} as value from claim_points where state_code is not null and topic is not null group by 1, 2")
    def _agg_region(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        return series.regions(_points(spark, d), "state_code", "topic", how, "importance").withColumn("value", F.round("value", 6))




def _band(axis: int) -> str:
    return "case " + " ".join(f"when n between {r[0]} and {r[1]} then {r[2 + axis]}" for r in series.POSTCODE_BANDS) + " end"


@query("agg_postcode", f"""with p as (select lpad(trim(postcode), 4, '0') as postcode, topic, importance from claim_points where postcode is not null and topic is not null), q as (select *, case when regexp_full_match(postcode, '[0-9]{{4}}') then cast(postcode as integer) end as n from p)
select postcode, topic, round({_band(0)} + ((n * 37) % 100) / 100.0 - 0.5, 6) as lat, round({_band(1)} + ((n * 73) % 100) / 100.0 - 0.5, 6) as lon, cast(coalesce(sum(importance), 0) as double) as value from q group by 1, 2, 3, 4""")
def agg_postcode(spark: SparkSession, d: str) -> DataFrame:
    return series.postcode_points(_points(spark, d), "postcode", "topic", "importance").withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query("agg_density", "select topic, count(*) as points, round(avg(latitude), 6) as lat, round(avg(longitude), 6) as lon from claim_points where topic is not null and latitude is not null and longitude is not null group by 1")
def agg_density(spark: SparkSession, d: str) -> DataFrame:
    return series.density(_points(spark, d), "topic", "latitude", "longitude").withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query("agg_centroid", "select round(avg(latitude), 6) as lat, round(avg(longitude), 6) as lon from claim_points")
def agg_centroid(spark: SparkSession, d: str) -> DataFrame:
    return series.centre(_points(spark, d), "latitude", "longitude").select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("agg_topic_cat", """with src as (select * from claim_points where topic is not null and category is not null), best as (select topic from src group by 1 order by count(*) desc, 1 limit 10), grid as (select * from best, (select distinct category from src)), c as (select topic, category, count(*) as count from src group by 1, 2)
select topic, category, coalesce(count, 0) as count from grid left join c using (topic, category)""")
def agg_topic_cat(spark: SparkSession, d: str) -> DataFrame:
    return series.topic_categories(_points(spark, d), "topic", "category")


@query("agg_over_time", """with s as (select topic, cast(floor(epoch(obs_ts)) as bigint) as s from topic_activity where obs_ts is not null and topic is not null), m as (select min(s) as low, max(s) as high from s)
select least(10, cast(floor((s - low) * 10 / greatest(high - low, 1)) as integer) + 1) as bin, topic, count(*) as count from s, m group by 1, 2""")
def agg_over_time(spark: SparkSession, d: str) -> DataFrame:
    return series.time_bins(_act(spark, d), "obs_ts", "topic")


@query("agg_dash_time", "select strftime(last_day(ts), '%Y-%m-%d') as period_end, event_type as topic, round(avg(value), 6) as mean from events where ts is not null group by 1, 2")
def agg_dash_time(spark: SparkSession, d: str) -> DataFrame:
    return _day(table(spark, d, "events").groupBy(P.period_end(F.col("ts"), "M").alias("period_end"), F.col("event_type").alias("topic")).agg(F.round(F.avg("value"), 6).alias("mean")))


for _f, _end, _label in (
    ("D", "cast(obs_ts as date)", "strftime(obs_ts, '%Y-%m-%d')"), ("W", _WEEK, "strftime(date_trunc('week', obs_ts), '%Y-%m-%d')"), ("M", "last_day(obs_ts)", "strftime(obs_ts, '%Y-%m')"),
    ("Q", _QUARTER, "cast(year(obs_ts) as varchar) || 'Q' || cast(quarter(obs_ts) as varchar)"), ("Y", "make_date(year(obs_ts), 12, 31)", "strftime(obs_ts, '%Y')"),
):

    @query(f"fn_period_{_f.lower()}", f"select strftime({_end}, '%Y-%m-%d') as period_end, {_label} as period_label, count(*) as count from topic_activity where obs_ts is not null group by 1, 2")
    def _fn_period(spark: SparkSession, d: str, freq: str = _f) -> DataFrame:
        t = F.col("obs_ts")
        return _day(_act(spark, d).where("obs_ts is not null").groupBy(P.period_end(t, freq).alias("period_end"), P.period_label(t, freq).alias("period_label")).agg(F.count("*").alias("count")))


@query("fn_calendar", "select obs_id, year(obs_ts) as y, month(obs_ts) as m, day(obs_ts) as dom, isodow(obs_ts) - 1 as weekday, week(obs_ts) as w from topic_activity where obs_ts is not null")
def fn_calendar(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("obs_ts")
    return _act(spark, d).where("obs_ts is not null").select("obs_id", *[c.cast("long").alias(n) for c, n in ((F.year(t), "y"), (F.month(t), "m"), (F.dayofmonth(t), "dom"), (F.weekday(t), "weekday"), (F.weekofyear(t), "w"))])


@query("fn_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def fn_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# reports
@query("rpt_topics", """with s as (select * from sample_documents where topic is not null), c as (select topic, count(*) as count from s group by 1), e as (select topic, text, row_number() over (partition by topic order by doc_id, text) as r from s where text is not null)
select c.topic, count, (select string_agg(text, ' | ' order by r) from e where e.topic = c.topic and r <= 5) as examples from c""")
def rpt_topics(spark: SparkSession, d: str) -> DataFrame:
    return series.topic_report(table(spark, d, "sample_documents"), "doc_id", "text", "topic").withColumn("examples", F.array_join("examples", " | "))


@query("rpt_sample", "select distinct topic, doc_id, cast(r as integer) as rank from (select topic, doc_id, row_number() over (partition by topic order by doc_id) as r from (select distinct topic, doc_id from sample_documents where topic is not null)) where r <= 5")
def rpt_sample(spark: SparkSession, d: str) -> DataFrame:
    return series.topic_sample(table(spark, d, "sample_documents").select("topic", "doc_id").distinct(), "doc_id", "topic").select("topic", "doc_id", "rank")


# windows, sorting, limits
@query("topk_topics", "select topic, cast(coalesce(sum(obs_value), 0) as double) as total from topic_activity where topic is not null group by 1 order by 2 desc, 1 limit 10")
def topk_topics(spark: SparkSession, d: str) -> DataFrame:
    return series.top_topics(_act(spark, d), "topic", 10, "obs_value")


@query("topk_topic_docs", "select topic, doc_id, topic_probability, cast(row_number() over (partition by topic order by topic_probability desc, doc_id) as integer) as rank from (select distinct topic, doc_id, topic_probability from sample_documents where topic is not null and topic_probability between 0 and 1 and not isnan(topic_probability)) qualify rank <= 20")
def topk_topic_docs(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "sample_documents").where("topic is not null and topic_probability between 0 and 1 and not isnan(topic_probability)").select("topic", "doc_id", "topic_probability").distinct()
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("topic_probability"), "doc_id"))).where("rank <= 20")


@query("argmax", "with c as (select user_id, event_type, sum(value) as s from events group by 1, 2) select user_id, event_type as topic from c qualify row_number() over (partition by user_id order by round(s, 6) desc, event_type) = 1")
def argmax(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("s"))
    return cells.groupBy("user_id").agg(F.min(F.struct((-F.col("s")).alias("minus"), F.col("event_type").alias("t"))).alias("b")).select("user_id", F.col("b.t").alias("topic"))


@query("argmax_abs", "with c as (select vec_id, unnest(embedding) as x, unnest(range(64)) as j from embeddings) select vec_id, cast(j as integer) as component from c qualify row_number() over (partition by vec_id order by abs(x) desc, j) = 1")
def argmax_abs(spark: SparkSession, d: str) -> DataFrame:
    best = F.array_max(F.transform("embedding", lambda x, i: F.struct(F.abs(x).alias("x"), (-i).alias("i"))))
    return table(spark, d, "embeddings").select("vec_id", (-best["i"]).alias("component"))


@query("sort_count", "select category, count(*) as count from claim_points where category is not null group by 1")
def sort_count(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).where("category is not null").groupBy("category").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category")


@query("limit_first", "select doc_id, category from documents order by doc_id limit 20")
def limit_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "category").orderBy("doc_id").limit(20)


@query("sample_n", "select doc_id, category from documents order by md5('42:' || cast(doc_id as varchar)), doc_id limit 100")
def sample_n(spark: SparkSession, d: str) -> DataFrame:
    return series.hash_sample(table(spark, d, "documents").select("doc_id", "category"), "doc_id", 100)


# feedback
def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback_log")


_CHANGED = "corrected_topic is not null and corrected_topic is distinct from original_topic"


@query("agg_transitions", "with c as (select original_topic as original, corrected_topic as corrected, count(*) as count from feedback_log where original_topic is not null and corrected_topic is not null and original_topic <> corrected_topic group by 1, 2) select *, round(100.0 * count / sum(count) over (), 6) as share from c")
def agg_transitions(spark: SparkSession, d: str) -> DataFrame:
    return feedback.transitions(_log(spark, d), "original_topic", "corrected_topic")


@query("agg_sessions", f"""with p as (select session_id as session, count(*) as reviewed, count(*) filter ({_CHANGED}) as changed from feedback_log group by 1), n as (select count(distinct doc_id) as n from sample_documents)
select session, reviewed, changed, round(100.0 * changed / reviewed, 6) as percent, cast(sum(reviewed) over w as bigint) as reviewed_so_far, cast(sum(changed) over w as bigint) as changed_so_far, round(100.0 * sum(reviewed) over w / n, 6) as percent_of_corpus from p, n window w as (order by session rows unbounded preceding)""")
def agg_sessions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_documents").select("doc_id").where("doc_id is not null").distinct().count()
    return feedback.sessions(_log(spark, d), "session_id", "original_topic", "corrected_topic", n)


@query("agg_feedback_delta", """with s as (select * from feedback_log where original_topic is not null and corrected_topic is not null and original_topic <> corrected_topic), m as (select original_topic as topic, -1 as d from s union all select corrected_topic, 1 from s),
p as (select topic, count(*) filter (d < 0) as lost, count(*) filter (d > 0) as gained, cast(sum(d) as bigint) as net from m group by 1) select *, cast(row_number() over (order by abs(net) desc, topic) as integer) as rank from p""")
def agg_feedback_delta(spark: SparkSession, d: str) -> DataFrame:
    return feedback.net_change(_log(spark, d), "original_topic", "corrected_topic")


@query("agg_summary", f"select count(*) as reviewed, count(*) filter ({_CHANGED}) as changed, round(count(*) filter ({_CHANGED}) / count(*), 6) as rate from feedback_log")
def agg_summary(spark: SparkSession, d: str) -> DataFrame:
    return feedback.summary(_log(spark, d), "original_topic", "corrected_topic")


@query("fb_apply", """with last as (select doc_id, corrected_topic from feedback_log where doc_id is not null qualify row_number() over (partition by doc_id order by logged_at desc, corrected_topic desc nulls last) = 1), docs as (select distinct doc_id, topic from sample_documents)
select docs.doc_id, topic, coalesce(corrected_topic, topic) as current_topic, coalesce(corrected_topic, topic) is distinct from topic as changed from docs left join last using (doc_id)""")
def fb_apply(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "sample_documents").select("doc_id", "topic").distinct()
    return feedback.apply_feedback(docs, "doc_id", "topic", _log(spark, d), "corrected_topic", "logged_at")


@query("al_corrected", "select doc_id, corrected_topic from feedback_log where doc_id is not null qualify row_number() over (partition by doc_id order by logged_at desc, corrected_topic desc nulls last) = 1")
def al_corrected(spark: SparkSession, d: str) -> DataFrame:
    return feedback.latest(_log(spark, d), "doc_id", "logged_at", "corrected_topic").select("doc_id", "corrected_topic")
