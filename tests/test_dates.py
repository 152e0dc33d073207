"""Dates in loose wording: two hundred forms with their dates, and texts without one."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillmill.functions import dates

DAYS = [datetime.date(2024, 3, 5), datetime.date(1999, 12, 31), datetime.date(2000, 2, 29), datetime.date(2011, 11, 11), datetime.date(1985, 9, 2),
        datetime.date(2033, 10, 23), datetime.date(1970, 1, 1), datetime.date(2020, 5, 13), datetime.date(2007, 7, 21), datetime.date(2019, 8, 30)]


def ordinal(n):
    return f"{n}{'th' if n in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


FORMS = [
    lambda d: d.strftime("%B ") + f"{d.day}, {d.year}", lambda d: d.strftime("%b. ") + f"{d.day}, {d.year}", lambda d: d.isoformat(), lambda d: f"{d.month}/{d.day}/{d.year}",
    lambda d: d.strftime("%m-%d-%Y"), lambda d: f"{d.day} " + d.strftime("%B %Y"), lambda d: "the " + ordinal(d.day) + d.strftime(" of %B, %Y"), lambda d: d.strftime("%A, %B ") + ordinal(d.day) + f" {d.year}",
    lambda d: f"{d.day}-" + d.strftime("%b-%Y"), lambda d: d.strftime("%m/%d/%y"), lambda d: d.strftime("%Y/%m/%d"), lambda d: d.strftime("%Y%m%d"), lambda d: d.strftime("%B ") + f"{d.day} '{d:%y}",
    lambda d: d.strftime("%d %b %y").upper(), lambda d: "dated this " + ordinal(d.day) + d.strftime(" day of %B %Y at 10:30 p.m."), lambda d: d.strftime("on or about %B ") + f"{d.day} of {d.year}",
    lambda d: d.strftime("%Y, %B ") + str(d.day), lambda d: d.strftime("%a %d %b %Y 23:59:01"), lambda d: f"{d.month}.{d.day}.{d.year}", lambda d: "\t" + d.strftime("%B").upper() + f"  {ordinal(d.day).upper()} ,{d.year}",
]


def test_two_hundred_forms(spark):
    rows = [(f(d), d) for f in FORMS for d in DAYS]
    assert len(rows) == 200
    table = spark.createDataFrame(rows, "found string, day date")
    wrong = table.withColumn("got", dates.fuzzy(F.col("found"))).where("got is distinct from day").collect()
    assert not wrong


@pytest.mark.parametrize("text,want", [
    ("March '24", "2024-03-01"), ("Sept 2019", "2019-09-01"), ("23/4/2020", "2020-04-23"), ("13.12.99", "1999-12-13"), ("4/2021", "2021-04-01"), ("2021-04", "2021-04-01"), ("May 5 68", "2068-05-05"), ("May 5 69", "1969-05-05"),
    ("", None), (None, None), ("no date", None), ("March 5", None), ("2024", None), ("Monday", None), ("the last 3 months", None), ("Feb 30, 2024", None), ("13/13/2024", None), ("March April 2024", None), ("May 5 2024 or 2025", None),
    ("1 2 3 4", None), ("room 12 of 2024 9 9 9", None), ("99999999999 5 May 2024", "2024-05-05"), ("mayor 5 2024", "2024-05-01"), ("x " * 20000, None),
])
def test_other_forms(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(dates.fuzzy(F.col("t")).cast("string").alias("d")).first()["d"]
    assert got == want


def test_loose_dates_move(spark):
    rows = [("the 5th of March, 2024", "2024-03-15"), ("5 March 2024", "15 March 2024"), ("dated 5th day of March 2024", "March 2024"), ("no date", "no date"), (None, None), ("3/5/24", "2024-03-15")]
    table = spark.createDataFrame(rows, "t string, want string").withColumn("got", dates.shift(F.col("t"), F.lit(10)))
    assert [(r["t"], r["got"]) for r in table.collect()] == rows
