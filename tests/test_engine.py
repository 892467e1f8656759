"""Operators of the engine on small series: identities, causality, errors."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helmwind.functions.casts import to_day, to_number
from helmwind.functions.ewm import ewm_means
from helmwind.functions.features import build_features, engineer, feature_columns, resolve_pins
from helmwind.functions.specs import custom_features, parse_spec
from helmwind.operators import backtest as B
from helmwind.operators.asof import asof_join
from helmwind.operators.clean import clean_panel, validate_panel
from helmwind.operators.schedule import COPIES, fixed_schedule, refit_schedule, refit_slices, training_windows
from helmwind.sources.headers import find_column

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(12)]
LEVELS = [10.0, 11, 12, 11, 10, 9, 10, 11, 12, 13, 12, 11]
REGIME = [0, 1, 1, 1, 0, 0, 1, 1, 0, 0, 0, 0]
RET = np.linspace(-0.01, 0.01, 12)


def series(spark, **columns):
    frame = pd.DataFrame({"series_id": "s", "date": DAYS} | columns)
    return spark.createDataFrame(frame).withColumn("date", F.to_date("date"))


def business(spark, start, n, values):
    days = pd.bdate_range(start, periods=n).date
    return spark.createDataFrame(pd.DataFrame({"series_id": "s", "date": days, "ret": values}))


def column(df, name):
    return [r[0] for r in df.orderBy("date").select(F.col(f"`{name}`")).collect()]


def test_headers():
    assert find_column(["Trade Date", "Adj_Close", "rf"], "date") == "Trade Date"
    assert find_column(["Trade Date", "Adj_Close", "rf"], "close") == "Adj_Close"
    assert find_column(["날짜", "종가", "무위험금리"], "rf") == "무위험금리"
    assert find_column(["a", "The Px Here"], "close") == "The Px Here"
    assert find_column(["a", "B c"], "close", "b_C") == "B c"
    with pytest.raises(KeyError):
        find_column(["a"], "rf")


def test_casts(spark):
    rows = spark.createDataFrame([("1,234.5",), ("4.25%",), ("-",), ("",), ("nan",), (None,), ("x",)], "t string")
    assert [r[0] for r in rows.select(to_number(F.col("t"))).collect()] == [1234.5, 4.25, None, None, None, None, None]
    rows = spark.createDataFrame([("2020-01-02",), ("1990/01/02",), ("19900102",), ("1990.01.02",), ("soon",)], "t string")
    got = [r[0] for r in rows.select(to_day(F.col("t"))).collect()]
    assert got == [dt.date(2020, 1, 2), *[dt.date(1990, 1, 2)] * 3, None]


def test_ewm_equals_pandas_with_gaps_and_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=900)
    x[[0, 1, 5, 400]] = np.nan
    frame = business(spark, "2015-01-01", 900, x).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret")))
    got = ewm_means(frame, {"a": ("ret", 0.5), "b": ("ret", 20)}).orderBy("date").toPandas()
    for name, h in (("a", 0.5), ("b", 20)):
        np.testing.assert_allclose(got[name], pd.Series(x).ewm(halflife=h).mean(), rtol=1e-12, atol=1e-13)


@pytest.mark.parametrize("ver", ["paper", "example", "extra"])
def test_features_are_causal_and_named(spark, ver):
    x = np.random.default_rng(0).normal(0.0003, 0.011, 300)
    whole = engineer(business(spark, "2015-01-01", 300, x), ver).orderBy("date").toPandas()
    part = engineer(business(spark, "2015-01-01", 200, x[:200]), ver).orderBy("date").toPandas()
    assert list(whole.columns[2:]) == feature_columns(ver)
    np.testing.assert_allclose(whole[:200].iloc[:, 2:].astype(float), part.iloc[:, 2:].astype(float), rtol=1e-9)


def test_set_sizes():
    assert [len(feature_columns(v)) for v in ("paper", "example", "extra")] == [3, 9, 35]
    with pytest.raises(NotImplementedError):
        feature_columns("other")


def test_transforms(spark):
    rows = series(spark, x=LEVELS)
    specs = ["x", "x:diff", "x:pct:2", "x:log", "x:logdiff", "x:ewm:3"]
    df, names = custom_features(rows, specs)
    assert names == ["x", "x_diff1", "x_pct2", "x_log", "x_logdiff1", "x_ewm3"]
    got, s = df.orderBy("date").toPandas(), pd.Series(LEVELS)
    want = {"x_diff1": s.diff(), "x_pct2": s.pct_change(2), "x_log": np.log(s), "x_logdiff1": np.log(s).diff(), "x_ewm3": s.ewm(halflife=3).mean()}
    for name, values in want.items():
        np.testing.assert_allclose(got[name].astype(float), values, rtol=1e-12)
    with pytest.raises(ValueError):
        custom_features(series(spark, x=[0.0] + LEVELS[1:]), ["x:log"])


def test_specs():
    assert parse_spec(" VIX : EWM ").name == "VIX_ewm20" and parse_spec("a b").name == "ab"
    for bad in ("", "x:what", "x:diff:0", "x:ewm:-1", "a:b:c:d", "x:diff:y"):
        with pytest.raises(ValueError):
            parse_spec(bad)


def test_pins():
    columns = [*feature_columns("paper"), "VIX_log"]
    assert resolve_pins(columns, ["VIX:log", "DD_10"]) == ["DD_10", "VIX_log"]
    assert resolve_pins(columns, ["paper"]) == feature_columns("paper")
    assert resolve_pins(columns, ["custom"]) == ["VIX_log"] and resolve_pins(columns, ["all"]) == columns
    with pytest.raises(KeyError):
        resolve_pins(columns, ["nothing"])
    with pytest.raises(ValueError):
        resolve_pins(columns, [" "])
    with pytest.warns(UserWarning):
        resolve_pins(["sortino_20"], ["paper"])


def test_trading_delay_costs_and_limits(spark):
    rows = series(spark, regime=REGIME, ret=RET, rf=[1e-4] * 12)
    for delay in (0, 1, 3):
        got = column(B.run_strategy(rows, delay), "weight")
        assert got == ([1.0] * (delay + 1) + [1.0 - r for r in REGIME])[:12]
    table = B.run_strategy(rows, 0, buy_cost_bps=5, sell_cost_bps=15).orderBy("date").toPandas()
    cost = table.bought * 5 / 1e4 + table.sold * 15 / 1e4
    np.testing.assert_allclose(table.jm, table.weight * RET + (1 - table.weight) * 1e-4 - cost)
    half = column(B.run_strategy(rows, 0, min_cash=0.1, max_cash=0.6), "weight")
    assert set(np.round(half, 9)) == {0.9, 0.4} and half[0] == 0.9
    for bad in ({"min_cash": 0.8, "max_cash": 0.5}, {"max_cash": 1.5}, {"cost_bps": -1}, {"delay": -1}):
        with pytest.raises(ValueError):
            B.run_strategy(rows, **bad)
    assert B.parse_delays("1, 5,10") == (1, 5, 10)


def test_performance_values(spark):
    rows = series(spark, regime=REGIME, ret=RET, rf=[1e-4] * 12)
    table = B.run_strategy(rows, 0)
    got = {(r.strategy, r.metric): r.value for r in B.performance_table(table, label="JM").collect()}
    frame = table.orderBy("date").toPandas()
    wealth = (1 + frame.jm).cumprod()
    want = {
        "Return": wealth.iloc[-1] ** (252 / 12) - 1,
        "Volatility": frame.jm.std() * 252**0.5,
        "Sharpe": (frame.jm - 1e-4).mean() * 252 / (frame.jm.std() * 252**0.5),
        "MDD": (wealth / wealth.cummax() - 1).min(),
        "ES_0.05": frame.jm[frame.jm <= np.quantile(frame.jm, 0.05)].mean(),
        "Turnover": frame.weight.diff().abs().sum() / 2 * 252 / 12,
        "Leverage": frame.weight.mean(),
        "Cost": frame.cost.mean() * 252,
    }
    for metric, value in want.items():
        assert got["JM", metric] == pytest.approx(value, rel=1e-9), metric
    assert got[B.BUY_AND_HOLD, "Turnover"] == 0 and got[B.BUY_AND_HOLD, "Leverage"] == 1


def test_robustness_layout(spark):
    rows = series(spark, regime=REGIME, ret=RET, rf=[1e-4] * 12)
    long = B.delay_robustness({"JM": rows}, rows, (1, 2)).collect()
    assert {(r.model, r.delay) for r in long} == {("JM", 1), ("JM", 2), (B.BUY_AND_HOLD, None)}
    assert {r.metric for r in long} == set(B.ROBUST)


def test_median_filter(spark):
    rows = series(spark, state=[0, 0, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1])
    got = column(rows.withColumn("m", B.median_filter("state", 6)), "m")
    assert got == [0] * 10 + [1, 1]
    assert column(rows.withColumn("m", B.median_filter("state", 1)), "m")[3] == 1


def test_schedule_and_windows(spark):
    days = pd.bdate_range("2010-01-01", "2013-12-31").date
    rows = spark.createDataFrame(pd.DataFrame({"series_id": "s", "date": days}))
    got = refit_schedule(rows, 400, 200).orderBy("pos").collect()
    assert [(r.refit_date.month, r.refit_date.day <= 3) for r in got] == [(1 if i % 2 == 0 else 7, True) for i in range(len(got))]
    assert all(r.win == min(400, r.pos) and r.pos >= 200 for r in got)
    assert [r.seg_end for r in got[:-1]] == [r.pos for r in got[1:]] and got[-1].seg_end == len(days)
    sizes = {r.refit_id: r["count"] for r in training_windows(rows, refit_schedule(rows, 400, 200)).groupBy("refit_id").count().collect()}
    assert sizes == {r.refit_id: r.win + r.seg_end - r.pos for r in got}
    with pytest.raises(ValueError):
        refit_schedule(rows, 100, 200)


@pytest.mark.parametrize("window,least,every", [(3000, 500, 21), (300, 100, 1), (50, 10, 7)])
def test_slices_hold_what_the_refits_read(spark, window, least, every):
    days = spark.createDataFrame(pd.DataFrame({"series_id": "s", "date": pd.date_range("1990-01-01", periods=9000).date}))
    rows = days.unionByName(days.where("date < '1995-01-01'").withColumn("series_id", F.lit("t")))
    plan = fixed_schedule(rows, every, window, least)
    dealt, slices = refit_slices(rows, plan, window)
    per_row = dealt.groupBy("series_id", "date").count()
    assert per_row.agg(F.max("count")).head()[0] <= COPIES
    assert dealt.groupBy("series_id", "slice_id").count().agg(F.max("count")).head()[0] <= window + -(-window * 2 // 5) + 2 * every
    if window > 300:
        refits = slices.select("series_id", "slice_id", F.inline("refits"))
        kept = dealt.join(refits, ["series_id", "slice_id"]).where("row_pos >= pos - win and row_pos < seg_end").select("series_id", "refit_id", "date", "row_pos")
        want = training_windows(rows, plan).select("series_id", "refit_id", "date", "row_pos")
        assert kept.count() == want.count() and kept.exceptAll(want).isEmpty()
    assert slices.select(F.explode("refits")).count() == plan.count()


def test_cleaning(spark):
    raw = spark.createDataFrame(
        [
            ("s", "2020-01-01", 10.0, None, 1.0, 0), ("s", "2020-01-02", 11.0, 2.0, None, 1), ("s", None, 9.0, 2.0, None, 2),
            ("s", "2020-01-03", 99.0, 2.0, 2.0, 3), ("s", "2020-01-03", 12.0, 3.0, None, 4), ("s", "2020-01-04", None, 3.0, None, 5),
            ("s", "2020-01-05", 6.0, None, 5.0, 6),
        ],
        "series_id string, date string, close double, rf_raw double, v double, row_idx long",
    ).withColumn("date", F.to_date("date"))
    got = clean_panel(raw, variables=["v"]).orderBy("date").collect()
    assert [r.date.day for r in got] == [2, 3, 5]
    assert [round(r.ret, 9) for r in got] == [0.1, round(12 / 11 - 1, 9), -0.5]
    assert [r.rf_raw for r in got] == [2.0, 3.0, 3.0] and [r.v for r in got] == [None, None, 5.0]
    later = clean_panel(raw, start="2020-01-03").orderBy("date").collect()
    assert round(later[0].ret, 9) == round(12 / 11 - 1, 9)
    with pytest.raises(ValueError):
        validate_panel(raw.withColumn("close", F.lit(-1.0)))


def test_asof_skips_nulls_by_column(spark):
    data = series(spark, x=LEVELS)
    extra = spark.createDataFrame(
        [("s", DAYS[2], 1.0, 5.0), ("s", DAYS[5], None, 6.0), ("s", DAYS[8], 3.0, None)], "series_id string, date date, a double, b double"
    )
    got = asof_join(data, extra, ["a", "b"])
    assert column(got, "a") == [None] * 2 + [1.0] * 6 + [3.0] * 4
    assert column(got, "b") == [None] * 2 + [5.0] * 3 + [6.0] * 7


def test_build_features_drops_gaps(spark):
    x = np.random.default_rng(1).normal(0.0003, 0.011, 120)
    rows = business(spark, "2020-01-01", 120, x).withColumn("v", F.when(F.dayofmonth("date") != 5, F.lit(2.0)))
    found, names = build_features(rows, "paper", 30, specs=["v"])
    assert names == [*feature_columns("paper"), "v"] and found.where("v is null").count() == 0
    assert found.agg(F.min("date")).head()[0] > pd.bdate_range("2020-01-01", periods=30)[-1].date()


def test_align_needs_every_day(spark):
    rows = series(spark, regime=REGIME, ret=RET, rf=[1e-4] * 12)
    assert B.align(rows, rows).count() == 12
    with pytest.raises(ValueError):
        B.align(rows, rows.where("date > '2020-01-03'"))
