import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicloom import functions as fn


def test_bin_left_follows_integer_borders(spark):
    lo, hi, n = 820497600, 1104516000, 200
    edges = [int(v) for v in np.linspace(lo, hi, n, endpoint=False)]
    rnd = random.Random(3)
    xs = [rnd.randint(lo - 10, hi + 10) for _ in range(2000)] + edges + [e - 1 for e in edges] + [lo, hi, hi + 10**12]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", fn.bin_left(F.col("x"), lo, hi, n).alias("b")).collect()
    for x, b in got:
        below = [e for e in edges if e <= x]
        assert b == (below[-1] if below else None)
    assert spark.range(1).select(fn.borders(lo, hi, n).alias("b")).first().b == edges


def test_bin_left_without_value(spark):
    row = spark.range(1).select(fn.bin_left(F.lit(None).cast("long"), 0, 10, 3).alias("b")).first()
    assert row.b is None


def test_bin_right_closed_matches_cut(spark):
    x = np.random.default_rng(5).integers(946_700_000, 1_012_000_000, 500) * 1000
    want = pd.cut(pd.Series(x), bins=80, labels=False)
    df = spark.createDataFrame([(int(v),) for v in x], "x long")
    lo, hi = F.lit(float(x.min())), F.lit(float(x.max()))
    got = df.select("x", fn.bin_right_closed(F.col("x").cast("double"), lo, hi, 80).alias("b")).collect()
    assert [r.b for r in got] == list(want)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:15.678' AS t, '2001-05-14T16:39:00-07:00' AS s, 'junk' AS j")
        row = df.select(
            fn.epoch_seconds(F.col("t")).alias("a"), fn.epoch_millis(F.col("t")).alias("b"),
            fn.parse_epoch_seconds(F.col("s")).alias("c"), fn.parse_epoch_seconds(F.col("j")).alias("d"),
            F.unix_micros(fn.instant(df, "t")).alias("e"),
        ).first()
        assert tuple(row) == (1710037815, 1710037815678, 989883540, None, 1710037815678000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_percent_text(spark):
    df = spark.createDataFrame([(12.345,), (5.0,), (100.0,), (0.12345,), (0.05,), (0.0,)], "p double")
    got = [r[0] for r in df.select(fn.percent_text(F.col("p"), F.lit(100.0))).collect()]
    assert got == ["12.3%", "5.00%", "100%", "0.123%", "< 0.1%", "< 0.1%"]


def test_small_scalars(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (float("-inf"),), (1.0,), (0.0,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(fn.nan_to_zero(F.col("v"))).collect()] == [0, 0, 0, 0, 1, 0, -1]
    row = spark.sql("SELECT '(17' AS a, '0.5))' AS b, ' 3\tword\t9 \n' AS l, array('root', 'c', 't') AS p").select(
        fn.strip_cast(F.col("a"), 1, 0, "int"), fn.strip_cast(F.col("b"), 0, 2, "double"), fn.strip_cast(F.col("b"), 2, 0, "int"),
        fn.split_line(F.col("l")), fn.ancestors(F.col("p")), fn.value_or_na(F.lit(None).cast("double")),
        fn.value_or_na(F.lit(1234.5)), fn.error_interval(F.lit(-2.0)), fn.link_width(F.lit(9.0)), fn.label("Topic", F.lit(3)),
    ).first()
    assert list(row) == [17, 0.5, None, ["3", "word", "9"], ["c", "t"], "N/A", "1,234.50", [-2.0, 2.0], 3.0, "Topic 3"]
