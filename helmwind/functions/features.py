"""Feature sets of a return series: exponentially weighted, rolling and custom columns."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmwind.functions.ewm import ewm_means
from helmwind.functions.specs import custom_features, parse_spec
from helmwind.operators.frames import KEY, by_date, full, so_far, trailing, with_position

# Halflives and windows of the sets.
EXAMPLE_HALFLIVES = (5, 20, 60)
WINDOWS = (5, 20, 60)
DOWNSIDE_HALFLIVES = (5, 10, 20, 60)
RATIOS = ((5, 20), (20, 60))
WARMUP = 252
SETS = ("paper", "example", "extra")
GROUPS = (*SETS, "custom", "all")


def downside_name(halflife: int, log_dd: bool) -> str:
    return f"DD-log_{halflife}" if log_dd else f"DD_{halflife}"


def feature_columns(ver: str = "paper", log_dd: bool = False) -> list[str]:
    """Names of a set, in order."""
    if ver == "paper":
        return [downside_name(10, log_dd), "sortino_20", "sortino_60"]
    by_halflife = ("ret", "DD-log", "sortino") if ver == "example" else ("ret", "sortino")
    names = [f"{f}_{h}" for h in EXAMPLE_HALFLIVES for f in by_halflife]
    if ver == "example":  # always on the log scale
        return names
    if ver == "extra":
        names += ["ret-simple", "ret-log", "ret-abs", "ret-sq", "ret-cumlog"]
        names += [f"{f}_{w}" for w in WINDOWS for f in ("std", "var", "mad", "rms")]
        names += [f"{f}_{h}" for h in EXAMPLE_HALFLIVES for f in ("vol-log", "vol-chg")]
        names += [f"vol-ratio_{a}-{b}" for a, b in RATIOS]
        return names + [downside_name(h, log_dd) for h in DOWNSIDE_HALFLIVES]
    raise NotImplementedError(f"feature set {ver!r}; there are {', '.join(SETS)}")


def _moments(halflives_mean, halflives_down, halflives_square) -> dict[str, tuple[str, float]]:
    return (
        {f"__mean_{h}": ("ret", h) for h in halflives_mean}
        | {f"__down_{h}": ("__below", h) for h in halflives_down}
        | {f"__square_{h}": ("__sq", h) for h in halflives_square}
    )


def with_moments(df: DataFrame, means=(), downs=(), squares=()) -> DataFrame:
    """Exponentially weighted means of the return, its squared losses and its squares, for the halflives given."""
    below = F.when(F.col("ret").isNotNull(), F.pow(F.least(F.col("ret"), F.lit(0.0)), F.lit(2.0)))
    rows = df.withColumn("__below", below).withColumn("__sq", F.col("ret") * F.col("ret"))
    return ewm_means(rows, _moments(means, downs, squares))


def ewm_dd(h: float) -> Column:
    return F.sqrt(F.col(f"__down_{h}"))


def ewm_vol(h: float) -> Column:
    return F.sqrt(F.col(f"__square_{h}"))


def ewm_sortino(h: float) -> Column:
    """NULL where there was no loss yet."""
    return F.try_divide(F.col(f"__mean_{h}"), F.when(ewm_dd(h) != 0, ewm_dd(h)))


def downside(h: int, log_dd: bool) -> Column:
    return F.when(ewm_dd(h) > 0, F.ln(ewm_dd(h))) if log_dd else ewm_dd(h)


def rolling_columns() -> dict[str, Column]:
    """The columns of the extra set that need no exponential weighting."""
    r = F.col("ret")
    log = F.when(r > -1, F.log1p(r))
    out = {"ret-simple": r, "ret-log": log, "ret-abs": F.abs(r), "ret-sq": r * r}
    out["ret-cumlog"] = F.when(log.isNotNull(), F.sum(log).over(so_far()))
    for w in WINDOWS:
        frame = trailing(w)
        out[f"std_{w}"] = full(r, w, F.stddev_samp(r).over(frame))
        out[f"var_{w}"] = full(r, w, F.var_samp(r).over(frame))
        out[f"mad_{w}"] = full(r, w, F.avg(F.abs(r)).over(frame))
        out[f"rms_{w}"] = full(r, w, F.sqrt(F.avg(r * r).over(frame)))
    return out


def engineer(df: DataFrame, ver: str = "paper", log_dd: bool = False) -> DataFrame:
    """series_id, date and the columns of a set, for every row of (series_id, date, ret)."""
    names = feature_columns(ver, log_dd)
    base = df.select(KEY, "date", "ret")
    if ver == "paper":
        rows = with_moments(base, (20, 60), (10, 20, 60))
        made = {names[0]: downside(10, log_dd), "sortino_20": ewm_sortino(20), "sortino_60": ewm_sortino(60)}
        return rows.select(KEY, "date", *[made[n].alias(n) for n in names])
    downs = EXAMPLE_HALFLIVES if ver == "example" else DOWNSIDE_HALFLIVES
    rows = with_moments(base, EXAMPLE_HALFLIVES, downs, EXAMPLE_HALFLIVES if ver == "extra" else ())
    made = {f"ret_{h}": F.col(f"__mean_{h}") for h in EXAMPLE_HALFLIVES}
    made |= {f"sortino_{h}": ewm_sortino(h) for h in EXAMPLE_HALFLIVES}
    log = log_dd or ver == "example"
    made |= {downside_name(h, log): downside(h, log) for h in downs}
    if ver == "extra":
        logs = {f"vol-log_{h}": F.when(ewm_vol(h) > 0, F.ln(ewm_vol(h))) for h in EXAMPLE_HALFLIVES}
        rows = rows.withColumns(logs)
        made |= {n: F.col(f"`{n}`") for n in logs} | rolling_columns()
        made |= {f"vol-chg_{h}": F.col(f"`vol-log_{h}`") - F.lag(f"`vol-log_{h}`", h).over(by_date()) for h in EXAMPLE_HALFLIVES}
        made |= {f"vol-ratio_{a}-{b}": F.col(f"`vol-log_{a}`") - F.col(f"`vol-log_{b}`") for a, b in RATIOS}
    return rows.select(KEY, "date", *[made[n].alias(n) for n in names])


def build_features(
    panel: DataFrame, ver: str = "paper", warmup: int = WARMUP, log_dd: bool = False, specs: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Feature matrix and its column names: the set and the custom variables, without the first ``warmup`` rows and rows with a gap."""
    names = feature_columns(ver, log_dd)
    rows = engineer(panel, ver, log_dd)
    if specs:
        custom, added = custom_features(panel, specs)
        clash = set(added) & set(names)
        if clash:
            raise ValueError(f"custom variables are named like features: {sorted(clash)}")
        rows = rows.join(custom.select(KEY, "date", *[f"`{c}`" for c in added]), [KEY, "date"], "left")
        names = names + added
    fine = [F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`") & (F.abs(F.col(f"`{c}`")) != F.lit(float("inf"))) for c in names]
    keep = F.col("__at") >= warmup
    for condition in fine:
        keep = keep & condition
    rows = with_position(rows, "__at").where(keep)
    return rows.select(KEY, "date", *[f"`{c}`" for c in names]), names


def resolve_pins(columns: list[str], pins: list[str] | None, ver: str = "paper", log_dd: bool = False) -> list[str]:
    """Columns that a pinned model must keep, in matrix order: groups, columns or specs by name.

    A group wins over a column of its name (with a warning); of a group the columns
    that the matrix lacks are skipped with a warning.
    """
    wanted: set[str] = set()
    own = set(feature_columns(ver, log_dd))
    for pin in pins or []:
        name = pin.strip()
        if not name:
            raise ValueError("a pin is blank")
        group = name.lower()
        if group in GROUPS:
            if name in columns:
                warnings.warn(f"{name!r} is read as the group, not as the column", stacklevel=2)
            if group == "all":
                members = list(columns)
            elif group == "custom":
                members = [c for c in columns if c not in own]
                if not members:
                    warnings.warn("there are no custom columns to pin", stacklevel=2)
            else:
                members = feature_columns(group, log_dd)
                missing = [c for c in members if c not in columns]
                if missing:
                    warnings.warn(f"the matrix lacks {missing} of the group {group!r}", stacklevel=2)
                if len(missing) == len(members):
                    raise KeyError(f"the matrix has no column of the group {group!r}")
            wanted.update(c for c in members if c in columns)
        elif name in columns:
            wanted.add(name)
        else:
            try:
                spec = parse_spec(name).name
            except ValueError:
                spec = None
            if spec not in columns:
                raise KeyError(f"{name!r} is neither a group nor a column of {columns}")
            wanted.add(spec)
    return [c for c in columns if c in wanted]
