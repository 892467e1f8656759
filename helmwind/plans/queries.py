"""Registered queries of the engine: each applies an operator to the order and line tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.functions.casts import rf_to_daily, to_day, to_number
from helmwind.functions.features import build_features, engineer, ewm_dd, ewm_sortino, ewm_vol, feature_columns, with_moments
from helmwind.functions.lasso import lasso_weights
from helmwind.functions.specs import custom_features
from helmwind.models.hmm import HmmFit
from helmwind.operators import backtest as B
from helmwind.operators.asof import asof_join
from helmwind.operators.clean import clean_panel, dedup_last, fill_forward, fill_rf, quality_report, with_returns
from helmwind.operators.frames import KEY, full, trailing
from helmwind.operators.online import online_regimes, register_functions, viterbi_online, viterbi_trailing
from helmwind.operators.rolling import (
    fit_from_centers,
    ranked_selection,
    rolling_hmm,
    rolling_jump,
    scale_by_window,
    selection_summary,
    sparse_step,
)
from helmwind.operators.schedule import anchors, refit_schedule, training_windows
from helmwind.plans.pipeline import write_tables
from helmwind.sources.files import load_extra_table, load_market_data, load_with_extras, make_sample
from helmwind.sources.sheets import workbook, write_bytes
from helmwind.sources.store import shared_dir, written
from helmwind.sources.tables import daily_close, daily_extra, panel, raw_panel

#: Scale of the refits on these tables, which span six and a half years.
WARMUP, WINDOW, MIN_WINDOW = 60, 750, 250
RULE_WINDOW, RULE_MEAN = 20, 60


def _rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"} - set(keep)
    return df.select([F.round(F.col(f"`{c}`"), digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


def rule_regimes(market: DataFrame) -> DataFrame:
    """(series_id, date, ret, rf, regime): 1 where 20-day volatility is above its mean over 60 days."""
    rows = market.select(KEY, "date", "ret", "rf").withColumn("vol", full(F.col("ret"), RULE_WINDOW, F.stddev_samp("ret").over(trailing(RULE_WINDOW))))
    rows = rows.where("vol is not null")
    return rows.withColumn("regime", (F.col("vol") > F.avg("vol").over(trailing(RULE_MEAN))).cast("int")).drop("vol")


def load_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel(spark, sf_dir), 8)


def to_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price, kind = F.col("o_totalprice").cast("string"), F.pmod("o_orderkey", F.lit(5))
    text = F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("-")).when(kind == 2, F.concat(price, F.lit("%")))
    text = text.when(kind == 3, F.concat(F.lit(" "), price)).otherwise(F.concat(price, F.lit(", ")))
    return orders.select("o_orderkey", to_number(text).alias("value"))


def to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind, day = F.pmod("o_orderkey", F.lit(5)), F.col("o_orderdate")
    text = F.when(kind == 0, F.lit("soon"))
    for i, layout in enumerate(("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"), 1):
        text = text.when(kind == i, F.date_format(day, layout))
    return orders.select("o_orderkey", to_day(text.otherwise(F.date_format(day, "yyyy.MM.dd"))).alias("day"))


def rf_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rf = F.col("rf_raw")
    units = [F.round(rf_to_daily(rf, u), 12).alias(u) for u in ("annual_percent", "annual_decimal", "daily")]
    return daily_extra(spark, sf_dir).select("date", *units)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw panel with a third of the rates and variables and a fifth of the closes missing."""
    raw, day = raw_panel(spark, sf_dir), F.dayofmonth("date")
    hole = {c: F.when(day % 3 != 0, F.col(c)) for c in ("rf_raw", "qty")} | {"close": F.when(day % 5 != 0, F.col("close"))}
    return raw.withColumns(hole)


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderpriority").alias(KEY), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"), "o_orderkey")
    return dedup_last(rows, "o_orderkey")


def filled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).withColumn("rf", fill_rf()).select(KEY, "date", "rf")


def filled_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_forward(_gaps(spark, sf_dir), ["qty"]).select(KEY, "date", "qty")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_panel(spark, sf_dir).withColumn("rf", rf_to_daily(F.col("rf_raw")))
    return _rounded(with_returns(rows).select(KEY, "date", "ret", "excess_ret"), 8)


def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel(spark, sf_dir, start="1996-03-01", end="1998-02-28").select(KEY, "date", "ret"), 8)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_gaps(spark, sf_dir))


def clean_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning of one row an order: days repeat, and dates, closes, rates and variables are missing."""
    key = F.col("o_orderkey")
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias(KEY),
        F.when(key % 11 != 0, F.to_date("o_orderdate")).alias("date"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("close"),
        F.when(key % 5 != 0, key % 400 / 100).alias("rf_raw"),
        F.when(key % 3 != 0, (key % 50).cast("double")).alias("qty"),
        key.alias("row_idx"),
    )
    return _rounded(clean_panel(raw, variables=["qty"], start="1993-01-01"), 8)


def _csv(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/helmwind-{name}-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return path


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, close, rf_raw, qty) of one series: a day's highest price, the rate and the variable as of it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    closes = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("close"))
    return asof_join(closes, daily_extra(spark, sf_dir), ["rf_raw", "qty"], key=None)


def market_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as files with thousands separators, percents and gaps, and loaded by their headers."""
    day = F.dayofmonth("date")
    table = _market(spark, sf_dir).select(
        F.when(day % 7 == 0, F.lit("?")).otherwise(F.date_format("date", "yyyy/MM/dd")).alias("Trade Date"),
        F.when(day % 5 == 0, F.lit("-")).otherwise(F.format_number("close", 4)).alias("Close_Price"),
        F.when(day % 3 != 0, F.concat(F.format_number("rf_raw", 4), F.lit("%"))).alias("무위험금리"),
        F.when(day % 3 != 0, F.format_number("qty", 4)).alias("Qty"),
    )
    loaded = load_market_data(spark, _csv(table, "market"), start_date="1993-01-01", extra_cols=["qty"], series_id="ALL")
    return _rounded(loaded, 8)


def market_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same days as an Excel sheet, with dates, numbers, strings and empty cells; a workbook holds one row a day."""
    found = _market(spark, sf_dir).orderBy("date").collect()
    body = [
        ["?" if r.date.day % 7 == 0 else r.date, None if r.date.day % 5 == 0 else r.close]
        + ([None, None] if r.date.day % 3 == 0 or r.rf_raw is None else [f"{r.rf_raw:.4f}%", r.qty])
        for r in found
    ]
    path = f"{shared_dir(spark)}/helmwind-market-{uuid.uuid4().hex}.xlsx"
    write_bytes(spark, path, workbook([["Trade Date", "Close_Price", "무위험금리", "Qty"], *body]))
    return _rounded(load_market_data(spark, path, start_date="1993-01-01", extra_cols=["qty"], series_id="ALL"), 8)


def files_with_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market file and a second file of a variable that is known once a month, joined as of each day."""
    table = _market(spark, sf_dir)
    day = F.dayofmonth("date")
    main = table.select(
        F.when(day % 7 == 0, F.lit("?")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("일자"),
        F.when(day % 5 != 0, F.format_number("close", 4)).alias("종가"),
        F.when(day % 3 != 0, F.format_number("rf_raw", 4)).alias("금리"),
    )
    monthly = daily_extra(spark, sf_dir).where(day == 1).select(F.date_format("date", "yyyyMMdd").alias("Date"), F.format_number("qty", 4).alias("Slow Qty"))
    found, _ = load_with_extras(spark, _csv(main, "main"), ["slow_qty:ewm:5"], _csv(monthly, "monthly"), start_date="1993-01-01", series_id="series")
    return _rounded(found, 8)


def extra_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as files with unreadable days and empty cells, and loaded with all columns but the date."""
    day = F.dayofmonth("date")
    table = daily_extra(spark, sf_dir).select(
        F.when(day % 7 == 0, F.lit("soon")).otherwise(F.date_format("date", "yyyyMMdd")).alias("날짜"),
        F.when(day % 3 != 0, F.format_number("rf_raw", 4)).alias("rf_raw"),
        F.when(day % 2 != 0, F.format_number("qty", 4)).otherwise(F.lit("-")).alias("qty"),
    )
    return load_extra_table(spark, _csv(table, "extra"), series_id="ALL")


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First days of months; the variable is missing in every other month."""
    extra = daily_extra(spark, sf_dir).where(F.dayofmonth("date") == 1)
    return extra.select("date", "rf_raw", F.when(F.month("date") % 2 == 0, F.col("qty")).alias("qty"))


def extra_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir)


def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_close(spark, sf_dir).join(_monthly(spark, sf_dir), "date", "left").select(KEY, "date", "close", "rf_raw", "qty")


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = daily_close(spark, sf_dir)
    extra = closes.select(KEY).distinct().crossJoin(F.broadcast(_monthly(spark, sf_dir)))
    return asof_join(closes, extra, ["rf_raw", "qty"]).select(KEY, "date", "close", "rf_raw", "qty")


def common_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_regimes(panel(spark, sf_dir))
    return B.common_period({"a": rows.where("regime = 1"), "b": rows.where(F.dayofweek("date") != 1)})


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select(KEY, "date")


def anchor_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors(_dates(spark, sf_dir)).select(KEY, "date", F.col("pos").cast("int").alias("pos"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refit_schedule(_dates(spark, sf_dir), WINDOW, MIN_WINDOW)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = _dates(spark, sf_dir)
    return training_windows(dates, refit_schedule(dates, WINDOW, MIN_WINDOW)).select(KEY, "refit_id", "date", "row_pos")


def _moments(spark: SparkSession, sf_dir: str, value: Callable[[float], Column], **halflives) -> DataFrame:
    rows = with_moments(panel(spark, sf_dir).select(KEY, "date", "ret"), **halflives)
    return _rounded(rows.select(KEY, "date", *[value(h).alias(f"hl_{h}") for h in (5, 20, 60)]))


def ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir, lambda h: F.col(f"__mean_{h}"), means=(5, 20, 60))


def ewm_downside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir, ewm_dd, downs=(5, 20, 60))


def ewm_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir, ewm_vol, squares=(5, 20, 60))


def sortino(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir, ewm_sortino, means=(5, 20, 60), downs=(5, 20, 60))


def features(ver: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(engineer(panel(spark, sf_dir), ver))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_features(panel(spark, sf_dir), "paper", WARMUP)[0])


def transform(spec: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, names = custom_features(panel(spark, sf_dir), [spec])
        return _rounded(rows.select(KEY, "date", F.col(names[0]).alias("value")))

    return run


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = build_features(panel(spark, sf_dir), "paper", WARMUP, specs=["qty", "qty:diff:5", "qty:log"])
    return _rounded(found)


def _rule_strategy(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return B.run_strategy(rule_regimes(panel(spark, sf_dir)), **options)


def build_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_regimes(panel(spark, sf_dir))
    return rows.select(KEY, "date", "regime", F.round(B.weights(3, min_cash=0.1, max_cash=0.8), 8).alias("weight"))


def trade_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rule_strategy(spark, sf_dir, max_cash=0.7).select(KEY, "date", "bought", "sold", "traded"))


def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rule_strategy(spark, sf_dir, delay=1, buy_cost_bps=5.0, sell_cost_bps=15.0), 8)


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same strategy table written as csv by the run's sink and read again."""
    table, folder = _rule_strategy(spark, sf_dir, delay=1, buy_cost_bps=5.0, sell_cost_bps=15.0), f"{shared_dir(spark)}/helmwind-sink-{uuid.uuid4().hex}"
    write_tables({"strategy": table}, folder)
    return _rounded(spark.read.option("header", True).schema(table.schema).csv(f"{folder}/strategy"), 8)


def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = B.drawdowns(panel(spark, sf_dir), "ret").groupBy(KEY).agg(F.min("drawdown").alias("max_drawdown"))
    return _rounded(worst, 8)


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.performance_table(_rule_strategy(spark, sf_dir), label="rule"), 5)


def performance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = _rule_strategy(spark, sf_dir, delay=5)
    long = B.performance_table(_rule_strategy(spark, sf_dir), others={"slow": slow}, label="rule")
    return _rounded(B.wide(long, values=[B.BUY_AND_HOLD, "rule", "slow"]).withColumnRenamed(B.BUY_AND_HOLD, "hold"), 5)


def performance_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = B.performance_table(_rule_strategy(spark, sf_dir), label="rule")
    return B.format_performance(long.where(F.col("metric").isin("Volatility", "MDD", "Turnover", "Leverage", "Sharpe", "Cost")))


def regime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.regime_summary(rule_regimes(panel(spark, sf_dir))), 8)


def delay_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = panel(spark, sf_dir)
    rows = rule_regimes(market).select(KEY, "date", "regime")
    late = rows.where(F.col("date") >= F.to_date(F.lit("1996-01-01"))).withColumn("regime", 1 - F.col("regime"))
    return _rounded(B.delay_robustness({"rule": rows, "anti": late}, market, (1, 5, 10)), 5)


def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_regimes(panel(spark, sf_dir)).select(KEY, "date", "regime", B.median_filter("regime", 6).alias("smooth"))


def cumret_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.cumulative_curves(_rule_strategy(spark, sf_dir)), 6)


def annualized_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engineer(panel(spark, sf_dir), "paper")
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("v")) for n in feature_columns("paper")])
    mean = rows.select(F.inline(pairs)).groupBy("feature").agg(F.avg("v").alias("v"))
    return _rounded(mean.select("feature", B.annualize_center(F.col("feature"), F.col("v")).alias("value")), 6)


#: Centres and penalty of the fixed online model: small and large returns, low and high rates.
CENTERS, PENALTY = ((0.2, 0.1), (0.6, 0.5)), 0.4


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, x, ret) with the size of the return and the rate as features."""
    x = F.array(F.abs("ret") / 3, F.col("rf") * 1000)
    return rule_regimes(panel(spark, sf_dir)).select(KEY, "date", x.alias("x"), "ret")


def jm_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_regimes(_sizes(spark, sf_dir), CENTERS, PENALTY)


def jm_online_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, in SQL; the function partitions and orders by itself."""
    register_functions(spark)
    centers = ", ".join(f"array({a}D, {b}D)" for a, b in CENTERS)
    return spark.sql(f"SELECT * FROM jm_online(TABLE(SELECT series_id, date, x FROM {{sizes}}), array({centers}), {PENALTY}D)", sizes=_sizes(spark, sf_dir))


#: Rounds of coordinate descent of the registered fit.
FIT_ROUNDS = 3


def jm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A jump model of each series from the same centres: labels by back-pointers, states by total return."""
    found = fit_from_centers(_sizes(spark, sf_dir), CENTERS, PENALTY, FIT_ROUNDS)
    centers = [F.round(F.get("center", i), 6).alias(f"center_{i}") for i in range(2)]
    return found.select(KEY, "date", "state", *centers, F.round("objective", 6).alias("objective"))


#: Training rows of the registered scaling.
SCALED_ROWS = 750


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns and rates, clipped and standardised by the first rows of each series."""
    rows = panel(spark, sf_dir).select(KEY, "date", F.array("ret", "rf_raw").alias("x"))
    found = scale_by_window(rows, SCALED_ROWS, 1.5)
    return found.select(KEY, "date", F.round(F.get("z", 0), 6).alias("z_ret"), F.round(F.get("z", 1), 6).alias("z_rf"))


def sparse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of a sparse jump model: the states of the rule, what separates them, and the weights of the features."""
    rows = rule_regimes(panel(spark, sf_dir))
    x = F.array(F.abs("ret"), F.col("ret"), F.col("rf") * 1000, F.pow("ret", F.lit(2)) / 4)
    found = sparse_step(rows.select(KEY, x.alias("x"), F.col("regime").alias("state")), ["size", "ret", "rate", "square"], 1.5, ["rate"])
    return _rounded(found)


#: Parameters of the registered Viterbi queries: calm and wild days.
FIXED_HMM = HmmFit(np.array([0.6, 0.4]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([0.0, 0.1]), np.array([0.3, 0.8]), float("nan"))
DECODE_WINDOW, DECODE_LEAST, DECODE_EVERY = 60, 40, 21


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select(KEY, "date", F.col("ret").alias("x"))


def viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_online(_returns(spark, sf_dir), FIXED_HMM)


def viterbi_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_trailing(_returns(spark, sf_dir), FIXED_HMM, DECODE_WINDOW, DECODE_LEAST)


def hmm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling HMM with given parameters: its slices, decoding, segments and median filter."""
    return rolling_hmm(panel(spark, sf_dir), DECODE_WINDOW, DECODE_LEAST, DECODE_EVERY, use_log=False, given=FIXED_HMM).regimes


#: Line numbers whose weights stay, and the number of features that the 1-norm bound stands for.
PINNED_LINES, LASSO_FEATURES = (2, 5), 3.0


def lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of line numbers for each supplier: a number's score is its quantity above nine tenths of the mean one's."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    numbers = [r[0] for r in lines.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]  # seven
    each = F.array(*[F.coalesce(F.sum(F.when(F.col("l_linenumber") == n, F.col("l_quantity"))), F.lit(0.0)).cast("double") for n in numbers])
    sums = lines.groupBy("l_suppkey").agg(each.alias("sums"))
    mean = F.aggregate("sums", F.lit(0.0), lambda total, v: total + v) / len(numbers)
    weights = lasso_weights(F.transform("sums", lambda v: v / mean - 0.9), LASSO_FEATURES**0.5, [n in PINNED_LINES for n in numbers])
    named = F.arrays_zip(F.array(*[F.lit(n) for n in numbers]).alias("line"), weights.alias("weight"))
    return _rounded(sums.select("l_suppkey", F.inline(named)).toDF("l_suppkey", "line", "weight"))


def _jump(spark: SparkSession, sf_dir: str, model: str = "jm", **options):
    market = written(panel(spark, sf_dir), "panel")
    ver = "paper" if model == "jm" else "example"
    rows, names = build_features(market, ver, WARMUP, specs=["qty:ewm:20"] if model == "sjm" else None)
    return rolling_jump(rows, names, market, jump_penalty=20.0, window=WINDOW, min_window=MIN_WINDOW, n_init=3, model=model, **options), market


def rolling_jm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jump(spark, sf_dir)[0].regimes


def rolling_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jump(spark, sf_dir)[0].params


def rolling_sjm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jump(spark, sf_dir, "sjm", max_feats=5, pins=["qty_ewm20"])[0].feat_weights


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit, _ = _jump(spark, sf_dir, "sjm", max_feats=5, pins=["qty_ewm20"])
    return selection_summary(fit.feat_weights, fit.pins)


def hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_hmm(panel(spark, sf_dir), WINDOW, MIN_WINDOW, refit_every=63, n_init=4).regimes


def regimes_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes with the panel and the strategy's return."""
    fit, market = _jump(spark, sf_dir)
    found = written(fit.regimes, "regimes")
    table = B.run_strategy(found.join(market.select(KEY, "date", "ret", "rf"), [KEY, "date"]))
    return B.regimes_table(found, market, table)


def regimes_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table for the volatility rule."""
    market = panel(spark, sf_dir)
    found = rule_regimes(market)
    return _rounded(B.regimes_table(found.select(KEY, "date", "regime"), market, B.run_strategy(found)), 8)


def selection_of_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary over days taken as refits: a variable's weight is what it has above a bar."""
    days, bars = daily_extra(spark, sf_dir), {"qty": 25.0, "rf_raw": 5.0}
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.greatest(F.col(c) - bar, F.lit(0.0)).alias("weight")) for c, bar in bars.items()])
    weights = days.select(F.lit("ALL").alias(KEY), F.col("date").alias("refit_date"), F.inline(pairs))
    return _rounded(selection_summary(weights, ["qty"]), 8)


def selection_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers by falling weight for each supplier, whose weights follow from its quantities."""
    weights = lasso(spark, sf_dir).select(F.col("l_suppkey").cast("string").alias(KEY), F.col("line").alias("feature"), "weight")
    return ranked_selection(_rounded(selection_summary(weights, None), 8)).select(KEY, "feature", "mean_weight", "selected_share", "place")


def sample_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(make_sample(daily_close(spark, sf_dir), seed=0, with_extra=True))


def streaming_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helmwind.streaming.online import stream_table

    return stream_table(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_panel": load_panel,
    "to_numeric": to_numeric,
    "to_date": to_date,
    "rf_to_daily": rf_units,
    "dedup_last": dedup,
    "fill_rf": filled_rates,
    "fill_extra": filled_variables,
    "returns": returns,
    "date_filter": date_filter,
    "validate_panel": report,
    "clean_panel": clean_dirty,
    "load_market_data": market_file,
    "load_excel": market_sheet,
    "load_with_extras": files_with_extras,
    "csv_sink": csv_sink,
    "scaled_features": scaled,
    "sparse_weights": sparse_weights,
    "load_extra_table": extra_file,
    "extra_table": extra_table,
    "left_join": left_join,
    "asof_join": asof,
    "common_period": common_period,
    "anchors": anchor_days,
    "refit_schedule": schedule,
    "training_windows": windows,
    "ewm_mean": ewm_mean,
    "ewm_dd": ewm_downside,
    "ewm_vol": ewm_volatility,
    "ewm_sortino": sortino,
    "features_paper": features("paper"),
    "features_example": features("example"),
    "features_extra": features("extra"),
    "build_features": matrix,
    "transform_raw": transform("qty"),
    "transform_ewm": transform("qty:ewm:20"),
    "transform_diff": transform("qty:diff:5"),
    "transform_pct": transform("qty:pct:1"),
    "transform_log": transform("qty:log"),
    "transform_logdiff": transform("qty:logdiff:2"),
    "custom_features": custom,
    "build_weights": build_weights,
    "trade_legs": trade_legs,
    "strategy": strategy,
    "max_drawdown": max_drawdown,
    "performance": performance,
    "performance_table": performance_table,
    "performance_fmt": performance_text,
    "regime_summary": regime_summary,
    "delay_robustness": delay_robustness,
    "median_filter": median_filter,
    "cumret_curve": cumret_curve,
    "annualize_center": annualized_centers,
    "jm_online": jm_online,
    "jm_online_sql": jm_online_sql,
    "jm_fit": jm_fit,
    "viterbi_online": viterbi,
    "viterbi_trailing": viterbi_windows,
    "hmm_decode": hmm_decode,
    "lasso_weights": lasso,
    "rolling_jm": rolling_jm,
    "rolling_jm_params": rolling_params,
    "rolling_sjm": rolling_sjm,
    "feature_selection_summary": selection,
    "rolling_hmm": hmm,
    "regimes_out": regimes_out,
    "regimes_rule": regimes_rule,
    "selection_of_weights": selection_of_weights,
    "selection_ranks": selection_ranks,
    "sample_data": sample_data,
    "streaming_online": streaming_online,
}
