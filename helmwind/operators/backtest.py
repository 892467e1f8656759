"""0/1 strategies on a regime: weights with a delay, trades, costs, returns and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwind.operators.frames import KEY, by_date
from helmwind.operators.scan import running_sums, wealth_and_peak
from helmwind.sources.store import written

#: Days a year in counts of shifts, whatever the metrics use.
YEAR = 252
METRICS = ("Return", "Volatility", "Sharpe", "MDD", "Calmar", "ES_0.05", "Turnover", "Leverage", "Cost")
ROBUST = ("Return", "Sharpe", "Calmar")
BUY_AND_HOLD = "B & H"


def weight_limits(min_cash: float = 0.0, max_cash: float = 1.0) -> tuple[float, float]:
    """Weight in the bull state and in the others."""
    if not 0 <= min_cash <= max_cash <= 1:
        raise ValueError("0 <= min_cash <= max_cash <= 1 must hold")
    return 1 - min_cash, 1 - max_cash


def cost_legs(cost_bps: float = 10.0, buy: float | None = None, sell: float | None = None) -> tuple[float, float]:
    """Cost of buying and of selling, in basis points."""
    legs = (cost_bps if buy is None else buy, cost_bps if sell is None else sell)
    if min(legs) < 0:
        raise ValueError("costs must not be negative")
    return legs


def parse_delays(text: str | Sequence[int]) -> tuple[int, ...]:
    parts = text.split(",") if isinstance(text, str) else text
    delays = tuple(int(p) for p in parts if str(p).strip())
    if not delays or min(delays) < 0:
        raise ValueError("delays are numbers of 0 or more")
    return delays


def weights(delay: int = 1, bull_state: int = 0, min_cash: float = 0.0, max_cash: float = 1.0, window=None) -> Column:
    """Weight of a row: that of the regime delay + 1 rows before; the bull weight where there is none."""
    if delay < 0:
        raise ValueError("a delay must be 0 or more")
    bull, rest = weight_limits(min_cash, max_cash)
    own = F.when(F.col("regime") == bull_state, F.lit(float(bull))).otherwise(F.lit(float(rest)))
    return F.coalesce(F.lag(own, delay + 1).over(window or by_date()), F.lit(float(bull)))


def trade_legs(window=None) -> tuple[Column, Column]:
    """Bought and sold share of wealth; the first row trades nothing."""
    change = F.coalesce(F.col("weight") - F.lag("weight").over(window or by_date()), F.lit(0.0))
    return F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))


def align(regimes: DataFrame, market: DataFrame, check: bool = True) -> DataFrame:
    """(series_id, date, regime, ret, rf) of every day of ``regimes``; raises if the market lacks one (one aggregate)."""
    rows = regimes.select(KEY, "date", "regime").join(market.select(KEY, "date", "ret", "rf"), [KEY, "date"], "left")
    if check:
        missing = rows.agg(F.count_if(F.col("ret").isNull() | F.col("rf").isNull())).head()[0]
        if missing:
            raise ValueError(f"{missing} days of the regimes have no return or no rate")
    return rows


def run_strategy(
    rows: DataFrame,
    delay: int = 1,
    cost_bps: float = 10.0,
    bull_state: int = 0,
    min_cash: float = 0.0,
    max_cash: float = 1.0,
    buy_cost_bps: float | None = None,
    sell_cost_bps: float | None = None,
    extra_keys: tuple[str, ...] = (),
) -> DataFrame:
    """Strategy table of (series_id, date, regime, ret, rf): regime, weight, bought, sold, traded, cost, rf, bh, jm."""
    buy, sell = cost_legs(cost_bps, buy_cost_bps, sell_cost_bps)
    order = by_date(*extra_keys)
    bought, sold = trade_legs(order)
    out = rows.withColumn("weight", weights(delay, bull_state, min_cash, max_cash, order)).withColumns({"bought": bought, "sold": sold})
    cost = F.col("bought") * F.lit(buy / 1e4) + F.col("sold") * F.lit(sell / 1e4)
    out = out.withColumn("traded", F.col("bought") + F.col("sold")).withColumn("cost", cost)
    jm = F.col("weight") * F.col("ret") + (1 - F.col("weight")) * F.col("rf") - F.col("cost")
    out = out.withColumn("bh", F.col("ret")).withColumn("jm", jm)
    return out.select(KEY, *extra_keys, "date", "regime", "weight", "bought", "sold", "traded", "cost", "rf", "bh", "jm")


def drawdowns(rows: DataFrame, column: str, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds drawdown: wealth over its highest so far, less 1. Wealth starts with the first row's return."""
    out = wealth_and_peak(rows, 1 + F.col(column), extra_keys)
    return out.withColumn("drawdown", F.col("__wealth") / F.col("__peak") - 1).drop("__wealth", "__peak")


def performance(rows: DataFrame, trading_days: int = YEAR, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """The nine metrics in long form, from (series_id, *keys, date, r, rf, weight, traded, cost).

    A ratio whose denominator is 0 is NULL. Wealth is scanned in blocks, one window
    pass gives the tail quantile, one aggregate the rest.
    """
    group = (KEY, *keys)
    td = F.lit(float(trading_days))
    at = Window.partitionBy(*group)
    tail = F.percentile("r", F.lit(0.05)).over(at)
    marked = drawdowns(rows, "r", keys).withColumn("__tail", F.when(F.col("r") <= tail, F.col("r")))
    m = marked.groupBy(*group).agg(
        F.pow(F.product(1 + F.col("r")), td / F.count("*")).alias("grown"),
        (F.stddev_samp("r") * F.sqrt(td)).alias("Volatility"),
        (F.avg(F.col("r") - F.col("rf")) * td).alias("excess"),
        F.min("drawdown").alias("MDD"),
        F.avg("__tail").alias("ES_0.05"),
        (F.sum("traded") / 2 * td / F.count("*")).alias("Turnover"),
        F.avg("weight").alias("Leverage"),
        (F.avg("cost") * td).alias("Cost"),
    )
    made = {
        "Return": F.col("grown") - 1,
        "Volatility": F.col("Volatility"),
        "Sharpe": F.try_divide(F.col("excess"), F.when(F.col("Volatility") > 0, F.col("Volatility"))),
        "MDD": F.col("MDD"),
        "Calmar": F.try_divide(F.col("excess"), F.when(F.col("MDD") < 0, F.abs("MDD"))),
    } | {k: F.col(f"`{k}`") for k in ("ES_0.05", "Turnover", "Leverage", "Cost")}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in made.items()])
    return m.select(*group, F.inline(pairs))


def as_strategies(table: DataFrame, label: str = "JM", extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Long rows (series_id, strategy, date, r, rf, weight, traded, cost) of a strategy table: buy and hold and the strategy."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def pick(name, r, weight, traded, cost):
        return F.struct(F.lit(name).alias("strategy"), r.alias("r"), weight.alias("weight"), traded.alias("traded"), cost.alias("cost"))

    both = F.array(
        pick(BUY_AND_HOLD, F.col("bh"), one, zero, zero), pick(label, F.col("jm"), F.col("weight"), F.col("traded"), F.col("cost"))
    )
    return table.select(KEY, *extra_keys, "date", "rf", F.inline(both))


def performance_table(table: DataFrame, trading_days: int = YEAR, others: dict[str, DataFrame] | None = None, label: str = "JM 0/1") -> DataFrame:
    """Metrics of buy and hold, the strategy and other strategy tables, each over its own rows, in long form."""
    rows = as_strategies(table, label)
    for name, other in (others or {}).items():
        rows = rows.unionByName(as_strategies(other, name).where(F.col("strategy") == name))
    return performance(rows, trading_days)


def format_performance(long: DataFrame) -> DataFrame:
    """Metrics as text: percents with one decimal, Cost with two, ratios with two decimals."""
    v, name = F.col("value"), F.col("metric")
    text = (
        F.when(name.isin("Sharpe", "Calmar"), F.format_string("%.2f", v))
        .when(name == "Cost", F.format_string("%.2f%%", v * 100))
        .otherwise(F.format_string("%.1f%%", v * 100))
    )
    return long.withColumn("text", F.when(v.isNull(), F.lit("nan")).otherwise(text)).drop("value")


def wide(long: DataFrame, by: str = "strategy", values: list[str] | None = None, column: str = "value") -> DataFrame:
    """Metrics in rows, strategies in columns."""
    return long.groupBy(KEY, "metric").pivot(by, values).agg(F.first(column))


def regimes_table(regimes: DataFrame, panel: DataFrame, strategy: DataFrame) -> DataFrame:
    """Regimes with the panel and the weight and return of the strategy that follows them."""
    own = strategy.select(KEY, "date", "weight", F.col("jm").alias("strategy_ret"))
    return regimes.join(panel, [KEY, "date"]).join(own, [KEY, "date"])


def regime_summary(rows: DataFrame, bear_state: int = 1) -> DataFrame:
    """Per series: first and last date, days, share of the bear state, shifts and shifts a year."""
    shift = F.col("regime") != F.lag("regime").over(by_date())
    return (
        rows.withColumn("__shift", F.coalesce(shift, F.lit(False)))
        .groupBy(KEY)
        .agg(
            F.min("date").alias("start"),
            F.max("date").alias("end"),
            F.count("*").alias("n_days"),
            F.avg((F.col("regime") == bear_state).cast("double")).alias("bear_share"),
            F.count_if("__shift").alias("n_shifts"),
        )
        .withColumn("shifts_per_year", F.col("n_shifts") / F.col("n_days") * F.lit(float(YEAR)))
    )


def common_period(regimes: dict[str, DataFrame]) -> DataFrame:
    """(series_id, date) that every model has."""
    tables = [r.select(KEY, "date") for r in regimes.values()]
    both = tables[0]
    for other in tables[1:]:
        both = both.join(other, [KEY, "date"], "left_semi")
    return both


def delay_robustness(regimes: dict[str, DataFrame], market: DataFrame, delays: Sequence[int] = (1, 5, 10), trading_days: int = YEAR, **options) -> DataFrame:
    """Return, Sharpe and Calmar by model and delay over the models' common period; buy and hold once, without a delay.

    The aligned rows are written once; one pass over them holds every delay of every
    model, as rows keyed by (series, model, delay), and buy and hold.
    """
    days = common_period(regimes)
    base = None
    for name, table in regimes.items():
        own = table.select(KEY, "date", "regime").withColumn("model", F.lit(name))
        base = own if base is None else base.unionByName(own)
    base = written(base.join(days, [KEY, "date"], "left_semi").join(market.select(KEY, "date", "ret", "rf"), [KEY, "date"]), "aligned")
    keys = ("model", "delay")
    first = next(iter(regimes))
    hold = F.when(F.col("model") == first, F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = base.withColumn("delay", F.explode(F.concat(F.array(*[F.lit(int(d)) for d in delays]), hold)))
    order = by_date(*keys)
    at_delay = None
    for delay in dict.fromkeys(delays):
        own = weights(delay, options.get("bull_state", 0), options.get("min_cash", 0.0), options.get("max_cash", 1.0), order)
        at_delay = F.when(F.col("delay") == int(delay), own) if at_delay is None else at_delay.when(F.col("delay") == int(delay), own)
    rows = rows.withColumn("weight", at_delay.otherwise(F.lit(1.0)))
    bought, sold = trade_legs(order)
    buy, sell = cost_legs(options.get("cost_bps", 10.0), options.get("buy_cost_bps"), options.get("sell_cost_bps"))
    rows = rows.withColumns({"bought": bought, "sold": sold}).withColumn("traded", F.col("bought") + F.col("sold"))
    rows = rows.withColumn("cost", F.col("bought") * F.lit(buy / 1e4) + F.col("sold") * F.lit(sell / 1e4))
    r = F.col("weight") * F.col("ret") + (1 - F.col("weight")) * F.col("rf") - F.col("cost")
    model = F.when(F.col("delay").isNull(), F.lit(BUY_AND_HOLD)).otherwise(F.col("model"))
    rows = rows.withColumn("r", r).withColumn("model", model).select(KEY, *keys, "date", "r", "rf", "weight", "traded", "cost")
    return performance(rows, trading_days, keys).where(F.col("metric").isin(*ROBUST))


def median_filter(column: str, k: int = 6, window=None) -> Column:
    """1 where the trailing mean of a 0/1 state over k rows exceeds a half; shorter at the head; k < 2 changes nothing."""
    if k < 2:
        return F.col(column).cast("int")
    frame = (window or by_date()).rowsBetween(-(k - 1), 0)
    return (F.avg(column).over(frame) > 0.5).cast("int")


def cumulative_curves(table: DataFrame) -> DataFrame:
    """Arithmetic running sums of the excess returns, and whether a row is invested least."""
    limits = table.groupBy(F.col(KEY).alias("__of")).agg(F.min("weight").alias("__low"), F.max("weight").alias("__top"))
    sums = running_sums(table, {"bh_cum": F.col("bh") - F.col("rf"), "jm_cum": F.col("jm") - F.col("rf")})
    shaded = (F.col("__low") < F.col("__top")) & (F.col("weight") <= F.col("__low") + 1e-9)
    return sums.join(limits, F.col(KEY).eqNullSafe(F.col("__of"))).select(KEY, "date", "bh_cum", "jm_cum", shaded.alias("shaded"))


def annualize_center(name: Column, value: Column, trading_days: int = YEAR) -> Column:
    """A centre in yearly units: none for log downside, root-of-time scales for downside and Sortino, days for returns."""
    td = float(trading_days)
    return (
        F.when(name.startswith("DD-log"), value)
        .when(name.startswith("DD"), value * F.lit((2 * td) ** 0.5))
        .when(name.startswith("sortino"), value * F.lit((td / 2) ** 0.5))
        .when(name.startswith("ret"), value * F.lit(td))
        .otherwise(value)
    )
