"""Topics over time, space and category: long tables ready for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import periods as P


def measure(value: str | None, how: str = "sum") -> Column:
    """Rows, or the sum of a value; a group without values sums to 0."""
    if value is None or how == "count":
        return F.count(F.lit(1) if value is None else value).cast("double")
    return F.coalesce(F.sum(value), F.lit(0)).cast("double")


def top_topics(df: DataFrame, topic: str, n: int, value: str | None = None) -> DataFrame:
    """The ``n`` topics with the largest total; ties by name. At most ``n`` rows."""
    return df.where(F.col(topic).isNotNull()).groupBy(topic).agg(measure(value).alias("total")).orderBy(F.desc("total"), topic).limit(n)


def share(value: str, *by: str) -> Column:
    """Percent of the group's sum; null where that is 0."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return F.when(total != 0, 100.0 * F.col(value) / total)


def rescale(value: str, low: float, high: float, *by: str) -> Column:
    """Min-max scaling to low..high within a group; a group with one value gets ``high``."""
    if not by:
        raise ValueError("rescale within groups; one window over the whole table would be one task")
    w = Window.partitionBy(*by)
    least, most = F.min(value).over(w), F.max(value).over(w)
    return F.when(most > least, low + (F.col(value) - least) / (most - least) * (high - low)).otherwise(F.lit(float(high)))


def topic_periods(df: DataFrame, time: str, topic: str, freq: str = "W", value: str | None = None, top: int | None = None, normalize: bool = False, cumulative: bool = False, densify: bool = False) -> DataFrame:
    """(period_end, topic, value): count or sum by period and topic, missing cells of a period 0.

    Null times and topics are dropped; periods without any row appear only with ``densify``. ``top`` keeps the largest topics. Shares are
    taken before sums are accumulated.
    """
    some = df.where(F.col(time).isNotNull() & F.col(topic).isNotNull())
    if top is not None:
        some = some.join(F.broadcast(top_topics(some, topic, top, value).select(topic)), topic, "left_semi")
    cells = some.groupBy(P.period_end(F.col(time), freq).alias("period_end"), F.col(topic).alias("topic")).agg(measure(value).alias("value"))
    # every (period, topic): both lists are as long as the chart's axes
    periods = cells.select("period_end").distinct()
    if densify:  # every period between the first and the last, by way of its days
        span = periods.agg(F.min("period_end").alias("a"), F.max("period_end").alias("b")).where(F.col("a").isNotNull())
        periods = span.select(F.explode(F.sequence("a", "b")).alias("day")).select(P.period_end(F.col("day"), freq).alias("period_end")).distinct()
    grid = periods.crossJoin(cells.select("topic").distinct())
    full = grid.join(cells, ["period_end", "topic"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if normalize:
        full = full.withColumn("value", F.coalesce(share("value", "period_end"), F.lit(0.0)))
    if cumulative:
        full = full.withColumn("value", F.sum("value").over(Window.partitionBy("topic").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)))
    return full


def topic_periods_wide(df: DataFrame, time: str, topic: str, topics: list[str], freq: str = "W", value: str | None = None) -> DataFrame:
    """One column a topic; the list of topics saves a job."""
    some = df.where(F.col(time).isNotNull() & F.col(topic).isNotNull())
    return some.groupBy(P.period_end(F.col(time), freq).alias("period_end")).pivot(topic, topics).agg(measure(value)).na.fill(0.0)


def heatmap(df: DataFrame, time: str, topic: str, freq: str = "M", value: str | None = None, top: int | None = None, normalize: bool = False) -> DataFrame:
    return topic_periods(df, time, topic, freq, value, top, normalize).withColumn("label", P.heat_label(F.col("period_end"), freq))


def ridge(df: DataFrame, time: str, topic: str, freq: str = "W", value: str | None = None, top: int = 10) -> DataFrame:
    """Shares per period with a baseline a topic: topics by falling total, 0.05 of the highest share apart."""
    full = topic_periods(df, time, topic, freq, value, top, normalize=True)
    totals = full.groupBy("topic").agg(F.round(F.sum("value"), 6).alias("total"))
    place = totals.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "topic")) - 1)
    most = full.agg(F.max("value").alias("most"))
    return full.join(F.broadcast(place.select("topic", "place")), "topic").crossJoin(F.broadcast(most)).select("period_end", "topic", "value", "place", (F.col("place") * 0.05 * F.col("most")).alias("baseline"))


def calendar(df: DataFrame, time: str, topic: str, chosen: str, year: int | None = None, value: str | None = None) -> DataFrame:
    """Each day of a year with the topic's count or sum, 0 where there is none; the year is the topic's last if not given."""
    some = df.where((F.col(topic) == chosen) & F.col(time).isNotNull())
    if year is None:
        year = some.agg(F.max(F.year(time))).first()[0]
    counts = some.where(F.year(time) == F.lit(year)).groupBy(F.to_date(time).alias("day")).agg(measure(value).alias("value"))
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31)))).alias("day")).where("day is not null")
    full = days.join(counts, "day", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return full.select("day", "value", F.month("day").alias("month"), F.dayofmonth("day").alias("dom"), F.weekday("day").alias("weekday"), F.weekofyear("day").alias("week"), (F.month("day") * 100 + F.weekofyear("day")).alias("month_week"))


def space_time(df: DataFrame, time: str, region: str, topic: str, freq: str = "M", value: str | None = None, chosen: str | None = None) -> DataFrame:
    """(topic, period, region, value, share): share of the topic's period in percent."""
    some = df.where(F.col(time).isNotNull() & F.col(region).isNotNull() & F.col(topic).isNotNull())
    if chosen is not None:
        some = some.where(F.col(topic) == chosen)
    cells = some.groupBy(F.col(topic).alias("topic"), P.period_label(F.col(time), freq).alias("period"), F.col(region).alias("region")).agg(measure(value).alias("value"))
    return cells.withColumn("share", share("value", "topic", "period"))


def category_time(df: DataFrame, time: str, category: str, topic: str, freq: str = "M", value: str | None = None, top: int = 5) -> DataFrame:
    """(category, period, topic, value, share) of the top topics; share within category and period in percent."""
    some = df.where(F.col(time).isNotNull() & F.col(category).isNotNull() & F.col(topic).isNotNull())
    some = some.join(F.broadcast(top_topics(some, topic, top, value).select(topic)), topic, "left_semi")
    cells = some.groupBy(F.col(category).alias("category"), P.period_label(F.col(time), freq).alias("period"), F.col(topic).alias("topic")).agg(measure(value).alias("value"))
    return cells.withColumn("share", share("value", "category", "period"))


def animated_map(df: DataFrame, time: str, topic: str, lat: str, lon: str, freq: str = "M", value: str | None = None, sizes: tuple[float, float] = (5.0, 25.0)) -> DataFrame:
    """(period, topic, lat, lon, value, size): points of each frame, marker sizes scaled within the frame."""
    some = df.dropna(subset=[time, topic, lat, lon])
    cells = some.groupBy(P.period_label(F.col(time), freq).alias("period"), F.col(topic).alias("topic"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(measure(value).alias("value"))
    return cells.withColumn("size", rescale("value", *sizes, "period"))


def point_map(df: DataFrame, id_col: str, lat: str, lon: str, value: str, sizes: tuple[float, float] = (5.0, 25.0)) -> DataFrame:
    """One marker a row with coordinates, its size scaled over the whole table through one aggregated row."""
    some = df.dropna(subset=[lat, lon]).select(id_col, F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(value).cast("double").alias("value"))
    span = some.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), sizes[0] + (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * (sizes[1] - sizes[0])).otherwise(F.lit(sizes[1]))
    return some.crossJoin(F.broadcast(span)).withColumn("size", scaled).drop("low", "high")


def regions(df: DataFrame, region: str, topic: str, how: str = "count", value: str | None = None) -> DataFrame:
    """(region, topic, value): count, sum, mean, median, max or min; all but count need a value."""
    if how != "count" and value is None:
        raise ValueError(f"{how} needs a value column")
    pick = {"count": lambda: F.count(value or "*"), "sum": lambda: F.sum(value), "mean": lambda: F.avg(value), "median": lambda: F.median(value), "max": lambda: F.max(value), "min": lambda: F.min(value)}
    if how not in pick:
        raise ValueError(f"unknown aggregation {how}")
    some = df.where(F.col(region).isNotNull() & F.col(topic).isNotNull())
    return some.groupBy(F.col(region).alias("region"), F.col(topic).alias("topic")).agg(pick[how]().cast("double").alias("value"))


# fixed values: approximate centres of the postcode bands of the Australian states
POSTCODE_BANDS = ((1000, 2999, -33.0, 147.0), (3000, 3999, -37.0, 144.5), (4000, 4999, -23.0, 146.0), (5000, 5999, -32.0, 136.5), (6000, 6999, -27.5, 121.5), (7000, 7999, -42.0, 146.5), (800, 999, -19.5, 133.5))


def postcode_points(df: DataFrame, postcode: str, topic: str, value: str | None = None) -> DataFrame:
    """(postcode, topic, lat, lon, value): postcodes at their band's centre, moved by a fixed hash of the code; others have no place.

    Blanks are trimmed and lost leading zeros put back.
    """
    code = F.lpad(F.trim(F.col(postcode)), 4, "0")
    number = F.when(code.rlike("^[0-9]{4}$"), code.cast("int"))
    lat, lon = F.lit(None).cast("double"), F.lit(None).cast("double")
    for low, high, y, x in POSTCODE_BANDS:
        lat = F.when(number.between(low, high), F.lit(y)).otherwise(lat)
        lon = F.when(number.between(low, high), F.lit(x)).otherwise(lon)
    jitter = lambda k: ((number * k) % 100) / 100.0 - 0.5
    some = df.where(F.col(postcode).isNotNull() & F.col(topic).isNotNull())
    placed = some.select(code.alias("postcode"), F.col(topic).alias("topic"), (lat + jitter(37)).alias("lat"), (lon + jitter(73)).alias("lon"), *([F.col(value)] if value else []))
    return placed.groupBy("postcode", "topic", "lat", "lon").agg(measure(value).alias("value"))


def density(df: DataFrame, topic: str, lat: str, lon: str) -> DataFrame:
    """(topic, points, lat, lon): rows with coordinates and their mean place, the layers of a density map."""
    some = df.dropna(subset=[topic, lat, lon])
    return some.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("points"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def centre(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def topic_categories(df: DataFrame, topic: str, category: str, top: int = 10) -> DataFrame:
    """(topic, category, count) of the top topics with every category, empty cells 0."""
    some = df.where(F.col(topic).isNotNull() & F.col(category).isNotNull())
    best = top_topics(some, topic, top).select(topic)
    cells = some.join(F.broadcast(best), topic, "left_semi").groupBy(topic, category).agg(F.count("*").alias("count"))
    grid = best.crossJoin(some.select(category).distinct())
    return grid.join(cells, [topic, category], "left").select(F.col(topic).alias("topic"), F.col(category).alias("category"), F.coalesce("count", F.lit(0)).alias("count"))


def time_bins(df: DataFrame, time: str, topic: str, bins: int = 10) -> DataFrame:
    """(bin, topic, count): equal bins between the first and last time."""
    some = df.where(F.col(time).isNotNull() & F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.unix_seconds(F.col(time).cast("timestamp")).alias("s"))
    span = some.agg(F.min("s").alias("low"), F.max("s").alias("high"))
    place = F.least(F.lit(bins), F.floor((F.col("s") - F.col("low")) * bins / F.greatest(F.col("high") - F.col("low"), F.lit(1))).cast("int") + 1)
    return some.crossJoin(F.broadcast(span)).groupBy(place.alias("bin"), "topic").agg(F.count("*").alias("count"))


def topic_report(df: DataFrame, id_col: str, text: str, topic: str, examples: int = 5) -> DataFrame:
    """(topic, count, examples): sizes and the first texts by id of each topic."""
    some = df.where(F.col(topic).isNotNull())
    sizes = some.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("count"))
    first = Window.partitionBy(topic).orderBy(id_col, text)
    picked = some.where(F.col(text).isNotNull()).withColumn("r", F.row_number().over(first)).where(F.col("r") <= examples)
    lists = picked.groupBy(F.col(topic).alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(text).alias("t")))), lambda x: x["t"]).alias("examples"))
    return sizes.join(lists, "topic", "left")


def topic_sample(df: DataFrame, id_col: str, topic: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows of each topic by id."""
    first = Window.partitionBy(topic).orderBy(id_col)
    return df.where(F.col(topic).isNotNull()).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that look random and are the same on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)
