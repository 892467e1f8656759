"""Custom variables: ``column[:transform[:parameter]]`` and six causal transforms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmwind.functions.ewm import ewm_means
from helmwind.operators.frames import KEY, by_date

TRANSFORMS = ("raw", "ewm", "diff", "pct", "log", "logdiff")
LOGS = ("log", "logdiff")


@dataclass(frozen=True)
class Spec:
    column: str
    transform: str = "raw"
    parameter: float | None = None

    @property
    def name(self) -> str:
        """Feature name: ``VIX``, ``VIX_log``, ``VIX_ewm20``."""
        plain = re.sub(r"\s+", "", self.column)
        if self.transform == "raw":
            return plain
        return f"{plain}_{self.transform}" + ("" if self.transform == "log" else f"{self.parameter:g}")


def parse_spec(text: str) -> Spec:
    parts = [p.strip() for p in text.split(":")]
    if not parts[0] or len(parts) > 3:
        raise ValueError(f"{text!r} is not column[:transform[:parameter]]")
    transform = (parts[1].lower() if len(parts) > 1 else "") or "raw"
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform {transform!r}; there are {', '.join(TRANSFORMS)}")
    if len(parts) == 3 and parts[2]:
        parameter = float(parts[2])
    else:
        parameter = 20.0 if transform == "ewm" else 1.0
    if transform == "ewm" and parameter <= 0:
        raise ValueError("a halflife must be positive")
    if transform in ("diff", "pct", "logdiff") and int(parameter) < 1:
        raise ValueError("a lag must be 1 or more")
    return Spec(parts[0], transform, parameter)


def custom_features(df: DataFrame, specs: list[str | Spec], key: str = KEY, check: bool = True) -> tuple[DataFrame, list[str]]:
    """``df`` with one column per spec, and their names. Specs of the same name: the last one counts.

    ``log`` and ``logdiff`` refuse values of 0 or less (one aggregate over all of them).
    """
    parsed = [s if isinstance(s, Spec) else parse_spec(s) for s in specs]
    for s in parsed:
        if s.column not in df.columns:
            raise KeyError(f"no column {s.column!r}; there are {df.columns}")
    logs = sorted({s.column for s in parsed if s.transform in LOGS})
    if check and logs:
        low = df.agg(*[F.count_if(F.col(f"`{c}`") <= 0).alias(str(i)) for i, c in enumerate(logs)]).head()
        if any(low):
            raise ValueError(f"logarithms need positive values: {[c for c, n in zip(logs, low) if n]}")
    by_name = {s.name: s for s in parsed}
    means = {n: (s.column, s.parameter) for n, s in by_name.items() if s.transform == "ewm"}
    out = {}
    for name, s in by_name.items():
        c, lag = F.col(f"`{s.column}`"), int(s.parameter or 1)
        if s.transform == "raw":
            out[name] = c
        elif s.transform == "diff":
            out[name] = c - F.lag(c, lag).over(by_date())
        elif s.transform == "pct":
            out[name] = F.try_divide(c, F.lag(c, lag).over(by_date())) - 1
        elif s.transform == "log":
            out[name] = F.ln(c)
        elif s.transform == "logdiff":
            out[name] = F.ln(c) - F.lag(F.ln(c), lag).over(by_date())
    return ewm_means(df.withColumns(out), means, key), list(by_name)
