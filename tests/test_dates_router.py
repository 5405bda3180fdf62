"""Dates in all their forms, and routes by the shape of scores, against plain Python."""

import datetime
import math
import re

from pyspark.sql import functions as F

from turnloom.functions import dates
from turnloom.plans import router

TEXTS = [
    None, "", "1:56 pm on 8 May, 2023", "12:05 AM on 31 December, 2022", "13:00 pm on 8 May, 2023", "1:56 pm on 31 April, 2023", "on 2023-5-8", "2023-05-08T7:09", "at 2023-05-08 17:09:33 sharp", "2023-13-01", "2019年5月5日", "2019年5月5日 下午3点", "2019年 5月 5日 晚上 9:30", "2019年5月5日 中午",
    "2019年5月5日 25:10", "2019年5月5日 12:75", "2010 - 2015年", "1998年的冬天", "5月 5日 上午8：05", "2月 30日", "dayid 1", "session 2023", "  2023-01-02  ", "2020年2月29日 0:30 中午", "12点 5月6日 下午",
]


def clock(text):
    hour, minute = 9, 0
    if m := re.search(r"(\d{1,2})\s*[:：]\s*(\d{2})", text):
        hour, minute = int(m[1]), int(m[2])
    elif m := re.search(r"(\d{1,2})\s*点", text):
        hour = int(m[1])
    hour += 12 if re.search("下午|晚上", text) and hour < 12 else 0
    hour = 12 if "中午" in text and hour in (9, 0) else hour
    return (hour if hour <= 23 else 9), minute


def moment(text, year):
    text = (text or "").strip()
    try:
        return datetime.datetime.strptime(text, "%I:%M %p on %d %B, %Y")
    except ValueError:
        pass
    try:
        if m := re.search(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?", text):
            return datetime.datetime(*map(int, m.group(1, 2, 3)), int(m[4] or 9), int(m[5] or 0), int(m[6] or 0))
        if m := re.search(r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日", text):
            return datetime.datetime(*map(int, m.groups()), *clock(text))
        if m := re.search(r"(\d{4})\s*-\s*\d{4}年", text) or re.search(r"(\d{4})年", text):
            return datetime.datetime(int(m[1]), 1, 1, 9)
        if m := re.search(r"(\d{1,2})月\s*(\d{1,2})日", text):
            return datetime.datetime(year, *map(int, m.groups()), *clock(text))
    except ValueError:
        pass
    return None


def test_dates(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    at = dates.parsed_datetime(F.col("t"), F.lit(2021))
    for r in df.select("i", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), dates.clock_suffix(F.col("t")).alias("c"), dates.spoken_datetime(at).alias("said")).collect():
        want = moment(TEXTS[r.i], 2021)
        assert r.at == (want and want.strftime("%Y-%m-%d %H:%M:%S")), TEXTS[r.i]
        assert (r.c.hour, r.c.minute) == clock(TEXTS[r.i] or ""), TEXTS[r.i]
        assert r.said == (want and want.strftime("%-I:%M ") + want.strftime("%p").lower() + want.strftime(" on %-d %B, %Y")), TEXTS[r.i]
    clocks = spark.range(1, 30).select("id", dates.session_datetime(F.col("id"), F.col("id") % 3).alias("s")).collect()
    for r in clocks:
        want = datetime.datetime(2023, 5, 1, 1) + datetime.timedelta(days=(r.id - 1) * 7 + r.id % 3, hours=r.id % 11)
        assert r.s == want.strftime("%-I:%M ") + want.strftime("%p").lower() + want.strftime(" on %-d %B, %Y")


LISTS = [None, [], [0.0], [0.0, 0.0], [0.9], [0.9, 0.1], [0.95, 0.02, 0.01, 0.01, 0.01, 0.0], [0.8, 0.79, 0.1], [0.5, 0.5], [1.0, -0.2], [0.76, 0.0, 0.0, 0.0]]


def shape(xs):
    xs = xs or []
    n, s = len(xs), sum(xs)
    gini = 2 * sum((i + 1) * x for i, x in enumerate(sorted(xs))) / (n * s) - (n + 1) / n if n > 1 and s else 0
    bits = -sum(x / s * math.log2(x / s) for x in xs if x > 0) if s else 0
    return gini, bits, xs[0] if xs else 0, xs[0] - xs[1] if n > 1 else 0, s / n if n else 0


def test_routes(spark):
    rows = [(i, a, b, safe, t) for i, (a, b, safe, t) in enumerate((a, b, safe, t) for a in LISTS for b in LISTS for safe in (True, False, None) for t in (None, ("HYBRID", 0.5)))]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, safe boolean, t struct<decision: string, confidence: double>")
    f = router.features(F.col("a"), F.col("b"))
    for r in df.select("*", f.alias("f"), router.route(f, F.col("safe"), F.col("t")).alias("r")).collect():
        (g, _, top, gap, _), (_, _, epi, _, _) = sem, own = shape(r.a), shape(r.b)
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(r.f, (*sem, *own), strict=True)), r
        if r.safe:
            want = ("BASELINE_EPISODIC", 1.0)
        elif r.t:
            want = ("HYBRID", 0.5)
        elif epi >= top + 0.1:
            want = ("BASELINE_EPISODIC", 0.8)
        elif not (g >= 0.65 and top >= 0.75 and gap >= 0.15):
            want = ("BASELINE_EPISODIC", 0.6)
        else:
            want = ("HYBRID", 0.7) if epi >= top - 0.05 else ("SEMANTIC_ONLY", 0.75)
        assert tuple(r.r) == want, r
