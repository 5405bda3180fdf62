"""Dates of sessions in the forms that dialogue sets write them, and back into one form.

Columns in, columns out, in built-in expressions. A text that holds no date, or one that
no calendar has, gives null.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.asked import stripped, text_of

# Marks of the afternoon and of noon.
AFTERNOON, NOON = "下午|晚上", "中午"
MONTHS = "january february march april may june july august september october november december".split()
SPOKEN = r"(?i)^(\d{1,2}):(\d{1,2})\s+(am|pm)\s+on\s+(\d{1,2})\s+(" + "|".join(MONTHS) + r"),\s+(\d{4})$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


def clock_suffix(text: Column) -> Column:
    """struct(hour, minute): 9:00 without a time; an afternoon mark adds twelve hours, noon makes 12 of 9 or 0, an hour beyond 23 becomes 9."""
    text = text_of(text)
    timed = r"(\d{1,2})\s*[:：]\s*(\d{2})"
    hour = F.coalesce(_part(text, timed, 1), _part(text, r"(\d{1,2})\s*点", 1), F.lit(9))
    hour = F.when(text.rlike(AFTERNOON) & (hour < 12), hour + 12).otherwise(hour)
    hour = F.when(F.contains(text, F.lit(NOON)) & hour.isin(9, 0), 12).otherwise(hour)
    return F.struct(F.when(hour > 23, 9).otherwise(hour).alias("hour"), F.coalesce(_part(text, timed, 2), F.lit(0)).alias("minute"))


def _moment(year, month, day, hour, minute, second=None) -> Column:
    """A timestamp of the session's time zone; null where the calendar or the clock has none."""
    second = F.lit(0) if second is None else second
    padded = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second)
    return F.when((year >= 1) & (month > 0) & (hour < 24) & (minute < 60) & (second < 60), padded.try_cast("timestamp"))


def parsed_datetime(text: Column, fallback_year: Column) -> Column:
    """The moment that a text names: by clock and month name, as an ISO date, as a Chinese date, range of years, year, or month and day in ``fallback_year``; the first form found decides."""
    text = stripped(text_of(text))
    lit = F.lit
    clock = clock_suffix(text)
    spoken_hour, half = _part(text, SPOKEN, 1), F.lower(F.regexp_extract(text, SPOKEN, 3))
    month = F.array_position(F.array(*(lit(m) for m in MONTHS)), F.lower(F.regexp_extract(text, SPOKEN, 5))).cast("int")
    spoken = _moment(_part(text, SPOKEN, 6), month, _part(text, SPOKEN, 4), spoken_hour % 12 + F.when(half == "pm", 12).otherwise(0), _part(text, SPOKEN, 2))
    iso = r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?"
    chinese, years, year, days = r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日", r"(\d{4})\s*-\s*\d{4}年", r"(\d{4})年", r"(\d{1,2})月\s*(\d{1,2})日"
    return (
        F.when(spoken.isNotNull() & spoken_hour.between(1, 12), spoken)
        .when(text.rlike(iso), _moment(*(_part(text, iso, k) for k in (1, 2, 3)), F.coalesce(_part(text, iso, 4), lit(9)), F.coalesce(_part(text, iso, 5), lit(0)), F.coalesce(_part(text, iso, 6), lit(0))))
        .when(text.rlike(chinese), _moment(*(_part(text, chinese, k) for k in (1, 2, 3)), clock["hour"], clock["minute"]))
        .when(text.rlike(years), _moment(_part(text, years, 1), lit(1), lit(1), lit(9), lit(0)))
        .when(text.rlike(year), _moment(_part(text, year, 1), lit(1), lit(1), lit(9), lit(0)))
        .when(text.rlike(days), _moment(fallback_year.cast("int"), _part(text, days, 1), _part(text, days, 2), clock["hour"], clock["minute"]))
    )


def spoken_datetime(moment: Column) -> Column:
    """As in "1:56 pm on 8 May, 2023"."""
    return F.concat(F.date_format(moment, "h:mm "), F.lower(F.date_format(moment, "a")), F.date_format(moment, "' on 'd MMMM, yyyy"))


def session_datetime(session: Column, sample: Column) -> Column:
    """The made-up clock of a session: weekly from 1 May 2023, a day later for each sample, the hour from the session's number."""
    hours = F.pmod(session, F.lit(11)).cast("int")
    days = ((session - 1) * 7 + sample).cast("int")
    return spoken_datetime(F.make_interval(days=days, hours=hours) + F.lit("2023-05-01 01:00:00").cast("timestamp"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in six forms by the order's number, and read again."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    ymd = [F.year(d), F.month(d), F.dayofmonth(d)]
    form = (
        F.when(k == 0, spoken_datetime(F.make_interval(hours=F.lit(13), mins=F.lit(56)) + d.cast("timestamp")))
        .when(k == 1, F.format_string("am %d-%d-%d 7:05", *ymd))
        .when(k == 2, F.format_string("%d年%d月%d日 下午3点", *ymd))
        .when(k == 3, F.format_string("%d-2030年", ymd[0]))
        .when(k == 4, F.format_string("%d年", ymd[0]))
        .otherwise(F.format_string("%d月 %d日 中午", *ymd[1:]))
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", form.alias("written"), F.year(d).alias("y"))
    at = parsed_datetime(F.col("written"), F.col("y"))
    return orders.select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm").alias("moment"))


def session_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", session_datetime(F.col("conv_id") % 20 + 1, F.floor(F.col("conv_id") / 20)).alias("said_at"))


def page_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = clock_suffix(F.col("html"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", at["hour"].alias("hour_"), at["minute"].alias("minute_"))


QUERIES = []
BUILT = {
    "o337_clock_suffix": (
        page_clocks,
        r"""WITH p AS (SELECT page_id, html, try_cast(regexp_extract(html, '([0-9]{1,2})\s*[:：]\s*([0-9]{2})', 1) AS int) AS h, try_cast(regexp_extract(html, '([0-9]{1,2})\s*[:：]\s*([0-9]{2})', 2) AS int) AS m, try_cast(regexp_extract(html, '([0-9]{1,2})\s*点', 1) AS int) AS spoken FROM pages),
        a AS (SELECT *, CASE WHEN regexp_matches(html, '下午|晚上') AND coalesce(h, spoken, 9) < 12 THEN coalesce(h, spoken, 9) + 12 ELSE coalesce(h, spoken, 9) END AS t FROM p)
        SELECT page_id, CASE WHEN contains(html, '中午') AND t IN (0, 9) THEN 12 WHEN t > 23 THEN 9 ELSE t END AS hour_, coalesce(m, 0) AS minute_ FROM a""",
    ),
    "o336_parsed_dates": (
        order_dates,
        "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 13:56') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 07:05') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 15:00') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d 12:00') ELSE strftime(o_orderdate, '%Y-01-01 09:00') END AS moment FROM orders",
    ),
    "o335_session_clocks": (
        session_clocks,
        "SELECT conv_id, turn, strftime(m, '%-I:%M ') || lower(strftime(m, '%p')) || strftime(m, ' on %-d %B, %Y') AS said_at FROM (SELECT conv_id, turn, TIMESTAMP '2023-05-01 01:00:00' + to_days(CAST(conv_id % 20 * 7 + conv_id // 20 AS int)) + to_hours(CAST((conv_id % 20 + 1) % 11 AS int)) AS m FROM conversations) x",
    ),
}
