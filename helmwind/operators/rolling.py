"""Rolling refits: a run of consecutive refits is one group, fitted and applied online in an Arrow batch.

Runs are independent of each other, so they spread over the cluster. A group holds the
rows that its refits read, once, and each refit works on a view of them; its
size follows from the window, whatever the series' length.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmwind.models.hmm import HmmFit, fit_hmm, last_states
from helmwind.models.jump import YEAR, fit_jump
from helmwind.models.scaling import Scaler
from helmwind.models.sparse import between_cluster, fit_sparse, lasso, resolve_max_feats
from helmwind.operators.backtest import median_filter
from helmwind.operators.frames import KEY
from helmwind.operators.schedule import fixed_schedule, refit_schedule, refit_slices
from helmwind.sources.store import written

_ROWS = (
    "series_id string, refit_id int, refit_date date, kind string, date date, state int, "
    "train_start date, train_end date, n_train int, freq double, ret_ann double, vol_ann double, stay_prob double, "
    "loglik double, values array<double>"
)
_NAMES = [part.split()[0] for part in _ROWS.split(", ")]
#: A fit has one row of its kind; the regime rows of a refit without parameters to use have no state yet.
_HMM_ROWS = (
    "series_id string, refit_id int, refit_date date, kind string, date date, state int, "
    "train_start date, train_end date, n_train int, loglik double, "
    "start array<double>, moves array<double>, means array<double>, vols array<double>"
)
_HMM_NAMES = [part.split()[0] for part in _HMM_ROWS.split(", ")]


def state_name(state, k: int, low: str = "bull", high: str = "bear"):
    return F.when(state == 0, F.lit(low)).when(state == k - 1, F.lit(high)).otherwise(F.concat(F.lit("mid"), state.cast("string")))


@dataclass(frozen=True)
class RollingFit:
    """Lazy results of rolling refits. ``rows`` holds all of them; persist it before using several."""

    rows: DataFrame
    schedule: DataFrame
    features: list[str]
    k: int
    model: str
    pins: list[str]

    @property
    def regimes(self) -> DataFrame:
        """series_id, date, regime, proba_0.., refit_date: what was known on each day."""
        one = self.rows.where("kind = 'regime'")
        probabilities = [(F.col("state") == i).cast("double").alias(f"proba_{i}") for i in range(self.k)]
        return one.select(KEY, "date", F.col("state").alias("regime"), *probabilities, "refit_date")

    @property
    def params(self) -> DataFrame:
        """One row per refit and state, with the centre in the units of the features."""
        centers = [F.element_at("values", i + 1).alias(f"center_{name}") for i, name in enumerate(self.features)]
        return self.rows.where("kind = 'param'").select(
            KEY, "refit_date", "train_start", "train_end", "n_train", "state", state_name(F.col("state"), self.k).alias("regime"),
            "freq", "ret_ann", "vol_ann", "stay_prob", *centers,
        )

    @property
    def feat_weights(self) -> DataFrame:
        """series_id, refit_date, feature, weight of the sparse model."""
        names = F.array(*[F.lit(n) for n in self.features])
        pairs = F.arrays_zip(names.alias("feature"), F.col("values").alias("weight"))
        return self.rows.where("kind = 'weight'").select(KEY, "refit_date", F.inline(pairs)).toDF(KEY, "refit_date", "feature", "weight")

    @property
    def insample_last(self) -> DataFrame:
        """Training labels of each series' last refit."""
        one = self.rows.where("kind = 'insample'")
        last = F.max("refit_id").over(Window.partitionBy(KEY))
        return one.withColumn("__last", last).where("refit_id = __last").select(KEY, "date", F.col("state").alias("insample_regime"))


def _block(kind: str, head: tuple, n: int, names: list[str] = _NAMES, **columns) -> dict[str, list]:
    """``n`` output rows; a single value stands for all of them, a column that is not given is null."""
    out = {"series_id": [head[0]] * n, "refit_id": [head[1]] * n, "refit_date": [head[2]] * n, "kind": [kind] * n}
    for name in names[4:]:
        value = columns.get(name)
        out[name] = list(value) if isinstance(value, (list, range, np.ndarray)) else [value] * n
    return out


def _rows(blocks: list[dict[str, list]], names: list[str] = _NAMES) -> pd.DataFrame:
    out = pd.DataFrame({name: pd.Series([v for b in blocks for v in b[name]], dtype=object) for name in names})
    return out.astype({"refit_id": "Int32", "state": "Int32", "n_train": "Int32"})


def rolling_jump(
    features: DataFrame,
    names: list[str],
    returns: DataFrame,
    jump_penalty: float = 50.0,
    window: int = 3000,
    min_window: int = 500,
    n_components: int = 2,
    clip_mul: float = 3.0,
    n_init: int = 10,
    random_state: int = 0,
    start_date: str | None = None,
    model: str = "jm",
    max_feats: float | None = None,
    pins: list[str] | None = None,
    parallel: int | None = None,
) -> RollingFit:
    """Semi-annual refits of a jump model (``jm``) or a sparse one (``sjm``) with online inference between them.

    ``features`` has series_id, date and ``names``; ``returns`` series_id, date, ret.
    Clipping and scaling follow from the training window alone; a segment's inference
    starts at the head of its training window and looks at no later row.
    """
    if model not in ("jm", "sjm"):
        raise ValueError("model must be jm or sjm")
    pins = list(pins or [])
    if model == "jm" and pins:
        warnings.warn("a jump model weighs all features alike; pins are ignored", stacklevel=2)
        pins = []
    if model == "sjm" and len(names) <= 3:
        warnings.warn("a sparse model has little to choose among so few features", stacklevel=2)
    if model == "sjm" and pins and len(pins) == len(names):
        warnings.warn("all features are pinned", stacklevel=2)
    bound = resolve_max_feats(max_feats, len(names), len(pins)) if model == "sjm" else None
    mask = np.array([n in pins for n in names])
    schedule = refit_schedule(features.select(KEY, "date"), window, min_window, start_date)
    x = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    rows = features.select(KEY, "date", x.alias("x")).join(returns.select(KEY, "date", "ret"), [KEY, "date"])
    dealt, slices = refit_slices(rows, schedule, window)

    def fit_slice(own: pd.DataFrame, refits: pd.DataFrame) -> pd.DataFrame:
        own, parts = own.sort_values("row_pos"), []
        values, returned, days = np.array(own["x"].tolist(), dtype=float), own["ret"].to_numpy(), own["date"].to_numpy()
        first = 0 if own.empty else int(own["row_pos"].iat[0])
        for refit in _refits(own, refits):
            at = slice(refit["pos"] - refit["win"] - first, refit["seg_end"] - first)
            parts += one((own["series_id"].iat[0], refit["refit_id"], refit["refit_date"]), refit["win"], values[at], returned[at], days[at])
        return _rows(parts)

    def one(head: tuple, win: int, values: np.ndarray, ret: np.ndarray, dates: np.ndarray) -> list[dict]:
        scaler = Scaler.fit(values[:win], clip_mul)
        z = scaler.apply(values)
        if model == "jm":
            fit = fit_jump(z[:win], ret[:win], jump_penalty, n_components, n_init, random_state)
            centers = fit.centers
        else:
            fit = fit_sparse(z[:win], ret[:win], jump_penalty, bound, mask, n_components, n_init, random_state)
            centers = between_cluster(z[:win], fit.labels, n_components)[0]
        states = fit.online(z)[win:]
        k = n_components
        parts = [
            _block("regime", head, len(states), date=dates[win:], state=states),
            _block(
                "param", head, k, state=range(k), train_start=dates[0], train_end=dates[win - 1], n_train=win,
                freq=[float((fit.labels == s).mean()) for s in range(k)], ret_ann=fit.ret * YEAR, vol_ann=fit.vol * np.sqrt(YEAR),
                stay_prob=np.diag(fit.transitions), values=[list(c) for c in scaler.invert(centers)],
            ),
            _block("insample", head, win, date=dates[:win], state=fit.labels),
        ]
        if fit.weights is not None:
            parts.append(_block("weight", head, 1, values=[list(fit.weights)]))
        return parts

    out = _by_slice(dealt, slices, fit_slice, _ROWS, parallel)
    return RollingFit(_nan_to_null(out), schedule, list(names), n_components, model, pins)


def _refits(own: pd.DataFrame, refits: pd.DataFrame) -> list:
    """The refits of a slice in order; none if it has no rows."""
    return [] if own.empty or refits.empty else list(refits["refits"].iat[0])


def _by_slice(dealt: DataFrame, slices: DataFrame, run, schema: str, parallel: int | None) -> DataFrame:
    """Apply ``run`` to the rows and the refits of each slice."""
    tasks = parallel or max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    refits = slices.toDF("refits_of", "refits_slice", "refits").repartition(tasks, "refits_of", "refits_slice").groupBy("refits_of", "refits_slice")
    return dealt.repartition(tasks, KEY, "slice_id").groupBy(KEY, "slice_id").cogroup(refits).applyInPandas(run, schema)


_FIT = f"{KEY} string, date date, state int, center array<double>, objective double"


def fit_from_centers(rows: DataFrame, centers: list, penalty: float, rounds: int) -> DataFrame:
    """(series_id, date, state, center, objective): a jump model of each series (series_id, date, x, ret), from given centres.

    At most ``rounds`` rounds of coordinate descent; each is a cheapest path with back-pointers
    and the means of its states. A series is fitted whole, as its training window.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        z, k = np.array(group["x"].tolist(), dtype=float), len(centers)
        fit = fit_jump(z, group["ret"].to_numpy(), penalty, k, n_init=0, start=np.asarray(centers, dtype=float), rounds=rounds)
        out = group[[KEY, "date"]].assign(state=fit.labels.astype("int32"), objective=fit.objective)
        out["center"] = [fit.centers[s].tolist() for s in fit.labels]
        return out[[part.split()[0] for part in _FIT.split(", ")]]

    return rows.select(KEY, "date", "x", "ret").groupBy(KEY).applyInPandas(one, _FIT)


def scale_by_window(rows: DataFrame, window: int, clip_mul: float = 3.0) -> DataFrame:
    """(series_id, date, z) of (series_id, date, x array<double>): clipped and standardised by each series' first ``window`` rows."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        values = np.array(group["x"].tolist(), dtype=float)
        z = Scaler.fit(values[:window], clip_mul).apply(values)
        return pd.DataFrame({KEY: group[KEY].to_numpy(), "date": group["date"].to_numpy(), "z": z.tolist()})

    return rows.select(KEY, "date", "x").groupBy(KEY).applyInPandas(one, f"{KEY} string, date date, z array<double>")


def sparse_step(rows: DataFrame, names: list[str], max_feats: float, pins: list[str] | None = None, n_components: int = 2) -> DataFrame:
    """(series_id, feature, score, weight) of (series_id, x, state): what separates the states, and the weights that follow from it.

    The scores are the features' sums of squares between states over the largest, the weights the next ones of a
    sparse jump model.
    """
    mask = np.array([n in (pins or []) for n in names])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        z = np.array(group["x"].tolist(), dtype=float)
        _, score = between_cluster(z, group["state"].to_numpy(), n_components)
        score = score / score.max() if score.max() > 0 else score
        return pd.DataFrame({KEY: group[KEY].iat[0], "feature": names, "score": score, "weight": lasso(score, np.sqrt(max_feats), mask)})

    return rows.select(KEY, "x", "state").groupBy(KEY).applyInPandas(one, f"{KEY} string, feature string, score double, weight double")


def _nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [c for c in ("freq", "ret_ann", "vol_ann", "stay_prob", "loglik") if c in df.columns]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


@dataclass(frozen=True)
class HmmResult:
    rows: DataFrame
    schedule: DataFrame
    k: int
    smooth_k: int

    @property
    def regimes(self) -> DataFrame:
        """series_id, date, state_raw, regime (median-filtered), refit_date."""
        one = self.rows.where("kind = 'regime'").withColumnRenamed("state", "state_raw")
        return one.withColumn("regime", median_filter("state_raw", self.smooth_k)).select(KEY, "date", "state_raw", "regime", "refit_date")

    @property
    def params(self) -> DataFrame:
        return self.rows.where("kind = 'param'").select(
            KEY, "refit_date", "train_start", "train_end", "n_train", "state",
            state_name(F.col("state"), self.k, "low_vol", "high_vol").alias("regime"), "ret_ann", "vol_ann", "stay_prob", "loglik",
        )


def rolling_hmm(
    returns: DataFrame,
    window: int = 3000,
    min_window: int = 500,
    refit_every: int = 21,
    smooth_k: int = 6,
    n_components: int = 2,
    n_init: int = 10,
    n_iter: int = 100,
    random_state: int = 0,
    use_log: bool = True,
    start_date: str | None = None,
    covariance_type: str = "diag",
    parallel: int | None = None,
    given: HmmFit | None = None,
) -> HmmResult:
    """Gaussian HMM on (log) returns, refitted every so many rows; each day takes the last Viterbi state of its trailing window.

    A slice of consecutive refits is read once: each refit is fitted and its days decoded,
    and both are written. A refit that fails (a training window without variation) warns
    and leaves the series' last parameters in use, also those of an earlier slice, whose days are
    then decoded in a second pass; if the first refit of a series fails, there are none and
    a RuntimeError says so. With ``given`` parameters nothing is fitted. The series is one
    variable, so ``spherical`` and ``full`` mean ``diag``; ``tied`` gives all states one
    variance, and they are ordered by their means.
    """
    if covariance_type not in ("diag", "spherical", "full", "tied"):
        raise ValueError("covariance_type must be diag, spherical, full or tied")
    value = F.log1p("ret") if use_log else F.col("ret")
    rows = returns.where(F.col("ret").isNotNull()).select(KEY, "date", value.alias("x")).where(F.col("x").isNotNull())
    schedule = fixed_schedule(rows.select(KEY, "date"), refit_every, window, min_window, start_date)
    dealt, slices = refit_slices(rows, schedule, window)

    def segment(own: pd.DataFrame, refit, used: tuple | None) -> dict:
        """Rows of the days that a refit serves, by parameters and the date of their refit."""
        x, dates, pos = own["x"].to_numpy(), own["date"].to_numpy(), own["row_pos"].to_numpy()
        low, high = refit["pos"] - pos[0], refit["seg_end"] - pos[0]
        head = (own["series_id"].iat[0], refit["refit_id"], refit["refit_date"] if used is None else used[1])
        states = None
        if used is not None:
            # Each day's own window: it grows with the day until it is full.
            states = last_states(used[0], x, np.arange(low, high), np.minimum(window, pos[low:high]))
        return _block("regime", head, high - low, _HMM_NAMES, date=dates[low:high], state=states)

    def fit_slice(own: pd.DataFrame, refits: pd.DataFrame) -> pd.DataFrame:
        own, parts, used = own.sort_values("row_pos"), [], None
        x, dates = own["x"].to_numpy(), own["date"].to_numpy()
        first = 0 if own.empty else int(own["row_pos"].iat[0])
        for refit in _refits(own, refits):
            low, high = refit["pos"] - refit["win"] - first, refit["pos"] - first
            fit = given or fit_hmm(x[low:high], n_components, n_init, n_iter, seed=random_state, tied=covariance_type == "tied")
            found = {"train_start": dates[low], "train_end": dates[high - 1], "n_train": refit["win"]}
            if fit is not None:
                used = (fit, refit["refit_date"])
                found |= {"start": [list(fit.start)], "moves": [list(fit.transitions.ravel())], "means": [list(fit.means)], "vols": [list(fit.vols)]}
                found["loglik"] = fit.loglik
            head = (own["series_id"].iat[0], refit["refit_id"], refit["refit_date"])
            parts += [_block("fit", head, 1, _HMM_NAMES, **found), segment(own, refit, used)]
        return _rows(parts, _HMM_NAMES)

    found = written(_by_slice(dealt, slices, fit_slice, _HMM_ROWS, parallel), "hmm")
    fits, regimes = found.where("kind = 'fit'"), found.where("kind = 'regime'")
    failed = fits.where("means is null").count()
    if failed:
        regimes = _with_earlier_fits(regimes, fits, dealt, slices, segment, parallel)
        warnings.warn(f"{failed} HMM refits failed; the parameters before them stay in use", stacklevel=2)
    regimes = regimes.select(KEY, "refit_id", "refit_date", "kind", "date", "state")
    stay = F.transform(F.sequence(F.lit(0), F.lit(n_components - 1)), lambda i: F.get("moves", i * (n_components + 1)))
    states = F.posexplode(F.arrays_zip("means", "vols", stay.alias("stay"))).alias("state", "own")
    params = fits.where("means is not null").select(
        KEY, "refit_id", "refit_date", F.lit("param").alias("kind"), "train_start", "train_end", "n_train", "loglik", states
    )
    params = params.withColumns(
        {"ret_ann": F.col("own.means") * YEAR, "vol_ann": F.col("own.vols") * F.sqrt(F.lit(float(YEAR))), "stay_prob": F.col("own.stay")}
    ).drop("own")
    return HmmResult(_nan_to_null(regimes.unionByName(params, allowMissingColumns=True)), schedule, n_components, smooth_k)


def _with_earlier_fits(regimes: DataFrame, fits: DataFrame, dealt: DataFrame, slices: DataFrame, segment, parallel: int | None) -> DataFrame:
    """Decode the days of failed refits at the head of a slice by the last parameters of an earlier one."""
    own = F.when(F.col("means").isNotNull(), F.struct(F.col("refit_date").alias("used_date"), "start", "moves", "means", "vols"))
    carried = fits.withColumn("used", F.last(own, ignorenulls=True).over(Window.partitionBy(KEY).orderBy("refit_id")))
    open_ = regimes.where("state is null").select(KEY, "refit_id").distinct().join(carried.select(KEY, "refit_id", "used"), [KEY, "refit_id"])
    without = open_.where("used is null").head()
    if without is not None:
        raise RuntimeError(f"the first HMM fit of series {without[KEY]!r} failed from all starts")
    refits = slices.select(KEY, "slice_id", F.explode("refits").alias("refit"), F.col("refit.refit_id").alias("refit_id")).join(open_, [KEY, "refit_id"])
    refits = refits.groupBy(KEY, "slice_id").agg(F.array_sort(F.collect_list(F.struct("refit", "used"))).alias("refits"))

    def decode(own: pd.DataFrame, refits: pd.DataFrame) -> pd.DataFrame:
        own, parts = own.sort_values("row_pos"), []
        for each in _refits(own, refits):
            start, moves, means, vols = (np.array(each["used"][c], dtype=float) for c in ("start", "moves", "means", "vols"))
            fit = HmmFit(start, moves.reshape(len(start), -1), means, vols, np.nan)
            parts.append(segment(own, each["refit"], (fit, each["used"]["used_date"])))
        return _rows(parts, _HMM_NAMES)

    late = _by_slice(dealt.join(refits.select(KEY, "slice_id"), [KEY, "slice_id"], "left_semi"), refits, decode, _HMM_ROWS, parallel)
    return regimes.where("state is not null").unionByName(late)


def selection_summary(feat_weights: DataFrame, pins: list[str] | None = None) -> DataFrame:
    """Per series and feature: mean weight, share of refits with a weight, whether it is pinned."""
    return feat_weights.groupBy(KEY, "feature").agg(
        F.avg("weight").alias("mean_weight"), F.avg((F.col("weight") > 0).cast("double")).alias("selected_share")
    ).withColumn("pinned", F.col("feature").isin(list(pins or [])) if pins else F.lit(False))


def ranked_selection(summary: DataFrame) -> DataFrame:
    """A selection summary with the place of each feature in its series, by falling mean weight, as it is shown and written."""
    order = Window.partitionBy(KEY).orderBy(F.desc("mean_weight"), "feature")
    return summary.withColumn("place", F.row_number().over(order)).orderBy(KEY, "place")
