"""The four figures of a run, drawn from its tables. Needs matplotlib, which is optional."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmwind.operators.backtest import annualize_center
from helmwind.operators.frames import KEY, with_position

try:
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt
except ImportError:
    plt = None

#: A figure reads at most this many rows of a series, evenly spaced: more cannot be told apart.
POINTS = 5_000


def thinned(df: DataFrame, points: int = POINTS) -> DataFrame:
    """About ``points`` evenly spaced rows of each series, by date."""
    size = F.count("*").over(Window.partitionBy(KEY))
    rows = with_position(df, "__at").withColumn("__step", F.greatest(F.lit(1), F.ceil(size / F.lit(points))))
    return rows.where(F.col("__at") % F.col("__step") == 0).drop("__at", "__step")


def center_table(params: DataFrame, features: list[str], trading_days: int = 252) -> DataFrame:
    """(series_id, refit_date, state, feature, value) with centres in yearly units."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`center_{n}`").alias("v")) for n in features])
    long = params.select(KEY, "refit_date", "state", F.inline(pairs))
    return long.select(KEY, "refit_date", "state", "feature", annualize_center(F.col("feature"), F.col("v"), trading_days).alias("value"))


def draw(tables: dict[str, DataFrame], features: list[str], outdir: str, trading_days: int = 252) -> list[str]:
    """Writes regimes_and_cumret, refit_params, weights and feat_weights as png for each series; returns the paths."""
    if plt is None:
        raise ImportError("figures need matplotlib")
    os.makedirs(outdir, exist_ok=True)
    curves = thinned(tables["cumret"]).orderBy(KEY, "date").toPandas()
    weights = thinned(tables["strategy"]).select(KEY, "date", "weight").orderBy(KEY, "date").toPandas()
    centers = center_table(tables["refit_params"], features, trading_days).orderBy("refit_date").toPandas()
    chosen = tables["feat_weights"].orderBy("refit_date").toPandas() if "feat_weights" in tables else None
    paths = []

    def save(figure, name):
        paths.append(os.path.join(outdir, f"{name}.png"))
        figure.savefig(paths[-1], dpi=150, bbox_inches="tight")
        plt.close(figure)

    for series, own in curves.groupby(KEY):
        figure, axis = plt.subplots(figsize=(12, 5))
        axis.plot(own["date"], own["bh_cum"], label="B & H")
        axis.plot(own["date"], own["jm_cum"], label="0/1")
        low, high = axis.get_ylim()
        axis.fill_between(own["date"], low, high, where=own["shaded"], alpha=0.2, step="mid")
        axis.legend()
        save(figure, f"{series}_regimes_and_cumret")
        figure, axis = plt.subplots(figsize=(12, 3))
        mine = weights[weights[KEY] == series]
        axis.step(mine["date"], mine["weight"], where="post")
        save(figure, f"{series}_weights")
        mine = centers[centers[KEY] == series]
        figure, axes = plt.subplots(len(features), 1, figsize=(12, 2.5 * len(features)), squeeze=False)
        for axis, name in zip(axes[:, 0], features):
            for state, line in mine[mine["feature"] == name].groupby("state"):
                axis.plot(line["refit_date"], line["value"], marker="o", label=str(state))
            axis.set_title(name)
        save(figure, f"{series}_refit_params")
        if chosen is not None:
            grid = chosen[chosen[KEY] == series].pivot(index="feature", columns="refit_date", values="weight")
            figure, axis = plt.subplots(figsize=(12, 0.4 * len(grid) + 1))
            image = axis.imshow(grid.to_numpy(), aspect="auto")
            axis.set_yticks(range(len(grid)), grid.index)
            figure.colorbar(image)
            save(figure, f"{series}_feat_weights")
    return paths
