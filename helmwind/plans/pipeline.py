"""The whole run: load, features, refits, strategy, benchmark model, robustness, tables on disk."""

from __future__ import annotations

import warnings
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.functions.features import WARMUP, build_features, resolve_pins
from helmwind.functions.specs import parse_spec
from helmwind.operators import backtest as B
from helmwind.operators.frames import KEY
from helmwind.operators.rolling import ranked_selection, rolling_hmm, rolling_jump, selection_summary
from helmwind.sources.files import load_with_extras
from helmwind.sources.store import written


def run_on_panel(
    panel: DataFrame,
    feature_set: str = "paper",
    log_dd: bool = False,
    warmup: int = WARMUP,
    specs: list[str] | None = None,
    model: str = "jm",
    max_feats: float | None = None,
    pin_features: list[str] | None = None,
    jump_penalty: float = 50.0,
    window: int = 3000,
    min_window: int = 500,
    n_components: int = 2,
    clip_mul: float = 3.0,
    n_init: int = 10,
    random_state: int = 0,
    refit_start: str | None = None,
    trading_days: int = 252,
    hmm: bool = False,
    hmm_window: int | None = None,
    hmm_refit_every: int = 21,
    hmm_smooth_k: int = 6,
    hmm_n_init: int = 10,
    hmm_covariance_type: str = "diag",
    hmm_simple_ret: bool = False,
    delay: int = 1,
    cost_bps: float = 10.0,
    buy_cost_bps: float | None = None,
    sell_cost_bps: float | None = None,
    max_cash: float = 1.0,
    min_cash: float = 0.0,
    delays: tuple[int, ...] | str = (1, 5, 10),
    robustness: bool = True,
    checks: bool = True,
) -> dict[str, DataFrame]:
    """All result tables of a clean panel by name; each series is a study of its own.

    Panel, features and refits are written once to the shared folder; the tables
    that follow from them are lazy.
    """
    B.weight_limits(min_cash, max_cash)
    B.cost_legs(cost_bps, buy_cost_bps, sell_cost_bps)
    delays = B.parse_delays(delays)
    strategy = {"min_cash": min_cash, "max_cash": max_cash, "cost_bps": cost_bps, "buy_cost_bps": buy_cost_bps, "sell_cost_bps": sell_cost_bps}
    panel = written(panel, "panel")
    matrix, names = build_features(panel, feature_set, warmup, log_dd, specs)
    matrix = written(matrix, "features")
    pins = resolve_pins(names, pin_features, feature_set, log_dd)
    fit = rolling_jump(
        matrix, names, panel, jump_penalty, window, min_window, n_components, clip_mul, n_init, random_state, refit_start, model, max_feats, pins
    )
    fit = fit.__class__(written(fit.rows, "refits"), fit.schedule, fit.features, fit.k, fit.model, fit.pins)
    market = panel.select(KEY, "date", "ret", "rf")
    table = B.run_strategy(B.align(fit.regimes, market, checks), delay, **strategy)
    label = "JM 0/1" if model == "jm" else "SJM 0/1"
    out = {
        "panel": panel,
        "features": matrix,
        "schedule": fit.schedule,
        "regimes": B.regimes_table(fit.regimes, panel, table),
        "refit_params": fit.params,
        "insample_last_window": fit.insample_last,
        "strategy": table,
        "regime_summary": B.regime_summary(fit.regimes, n_components - 1),
        "cumret": B.cumulative_curves(table),
    }
    if model == "sjm":
        out["feat_weights"] = fit.feat_weights
        out["feature_selection"] = ranked_selection(selection_summary(fit.feat_weights, pins))
    others, models = {}, {label.split()[0]: fit.regimes}
    if hmm:
        found = rolling_hmm(
            panel.select(KEY, "date", "ret"), hmm_window or window, min_window, hmm_refit_every, hmm_smooth_k, n_components, hmm_n_init,
            random_state=random_state, use_log=not hmm_simple_ret, start_date=refit_start, covariance_type=hmm_covariance_type,
        )
        found = found.__class__(written(found.rows, "hmm"), found.schedule, found.k, found.smooth_k)
        both = B.common_period({"a": fit.regimes, "b": found.regimes})
        common = found.regimes.join(both, [KEY, "date"], "left_semi")
        out["hmm_strategy"] = B.run_strategy(B.align(common, market, checks), delay, **strategy)
        out["hmm_regimes"], out["hmm_refit_params"] = found.regimes, found.params
        out["hmm_regime_summary"] = B.regime_summary(found.regimes, n_components - 1)
        others, models["HMM"] = {"HMM 0/1": out["hmm_strategy"]}, found.regimes
    out["performance"] = B.performance_table(table, trading_days, others, label)
    if checks:
        warn_about(fit, window, specs, panel, found if hmm else None)
    if robustness:
        out["delay_robustness"] = B.delay_robustness(models, market, delays, trading_days, **strategy)
    return out


def warn_about(fit, window: int, specs: list[str] | None, panel: DataFrame, hmm=None) -> None:
    """Warnings on what a run had to make do with: one small aggregate each over written tables."""
    short = fit.schedule.agg(F.count("*").alias("n"), F.count_if(F.col("win") < window).alias("short"), F.min("win").alias("least")).head()
    if not short.n:
        raise ValueError("no refit has the training rows that min_window asks for")
    if short.short:
        warnings.warn(f"{short.short} of {short.n} training windows are shorter than {window} rows, the shortest has {short.least}", stacklevel=3)
    absent = fit.params.where("freq = 0").count()
    if absent:
        warnings.warn(f"{absent} states are absent from their training windows; their parameters are empty", stacklevel=3)
    names = sorted({parse_spec(s).column for s in specs or []} & set(panel.columns))
    if names:
        gaps = panel.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names]).head()
        for c in names:
            if gaps[c]:
                warnings.warn(f"{c} has no value yet on {gaps[c]} rows, which are left out", stacklevel=3)
    if hmm is not None:
        least = hmm.schedule.agg(F.min("win")).head()[0]
        if least is not None and least < window:
            warnings.warn(f"training windows of the HMM start with {least} rows", stacklevel=3)
        days, own = (t.regimes.agg(F.min("date"), F.max("date"), F.count("*")).head() for t in (fit, hmm))
        if days != own:
            warnings.warn("the models cover different days; comparisons use the common ones", stacklevel=3)


def run_pipeline(
    spark: SparkSession,
    input_path: str,
    outdir: str | None = None,
    sheet: str | int | None = None,
    date_col: str | None = None,
    close_col: str | None = None,
    rf_col: str | None = None,
    rf_unit: str = "annual_percent",
    trading_days: int = 252,
    start_date: str | None = None,
    end_date: str | None = None,
    extra_features: list[str] | None = None,
    extra_file: str | None = None,
    extra_sheet: str | int | None = None,
    extra_date_col: str | None = None,
    save_features: bool = False,
    **options,
) -> dict[str, DataFrame]:
    """Load a file, run everything, write the tables as csv if ``outdir`` is given, and return them."""
    panel, specs = load_with_extras(
        spark, input_path, extra_features, extra_file, extra_sheet, extra_date_col, sheet=sheet, date_col=date_col, close_col=close_col,
        rf_col=rf_col, rf_unit=rf_unit, trading_days=trading_days, start_date=start_date, end_date=end_date,
    )
    out = run_on_panel(panel, specs=specs, trading_days=trading_days, **options)
    if outdir is not None:
        write_tables({k: v for k, v in out.items() if k != "panel" and (k != "features" or save_features)}, outdir)
    return out


def write_tables(tables: dict[str, DataFrame], outdir: str, fmt: str = "csv") -> None:
    """One folder per table, a file for each task that has rows; arrays are written as text."""
    for name, table in tables.items():
        flat = [F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in table.schema.fields]
        if not table.columns:
            warnings.warn(f"{name} has no columns", stacklevel=2)
            continue
        writer = table.select(*flat).write.mode("overwrite")
        writer.option("header", True).format(fmt).save(str(PurePosixPath(outdir) / name))
