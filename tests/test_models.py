"""Kernels against brute force and planted regimes; rolling runs; the stream."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from helmwind.models.hmm import fit_hmm, last_states
from helmwind.models.jump import best_path, fit_jump, losses, online_states
from helmwind.models.sparse import fit_sparse, lasso, resolve_max_feats
from helmwind.operators.online import fold
from helmwind.operators.rolling import rolling_hmm, rolling_jump, selection_summary
from helmwind.streaming.online import Online, Refit


def test_best_path_is_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k, penalty = int(rng.integers(1, 8)), int(rng.integers(2, 4)), rng.random()
        loss = rng.random((n, k))
        path, cost = best_path(loss, penalty)
        all_ = (sum(loss[t, s] for t, s in enumerate(q)) + penalty * sum(a != b for a, b in zip(q, q[1:])) for q in itertools.product(range(k), repeat=n))
        assert cost == pytest.approx(min(all_))
        assert sum(loss[t, s] for t, s in enumerate(path)) + penalty * (np.diff(path) != 0).sum() == pytest.approx(cost)
        prefixes = [best_path(loss[: t + 1], penalty)[0][-1] for t in range(n)]
        assert list(online_states(loss, penalty)) == prefixes
        assert list(fold(loss, penalty, None)[0]) == prefixes


def planted(n=900, seed=0):
    rng = np.random.default_rng(seed)
    state = (np.arange(n) // 90) % 2
    return state, np.where(state == 0, rng.normal(0.001, 0.006, n), rng.normal(-0.001, 0.02, n)), rng


def test_jump_recovers_planted_states():
    state, ret, _ = planted()
    vol = pd.Series(np.abs(ret)).ewm(halflife=5).mean().to_numpy()
    z = ((vol - vol.mean()) / vol.std())[:, None]
    fit = fit_jump(z, ret, 10.0)
    assert (fit.labels == state).mean() > 0.93 and fit.vol[1] > fit.vol[0]
    again = fit_jump(z, ret, 10.0)
    assert again.objective == fit.objective and (again.labels == fit.labels).all()


def test_lasso():
    w = lasso([1, 0.9, 0.05, 0.02], 1.2)
    assert w[2] == w[3] == 0 and np.linalg.norm(w) == pytest.approx(1) and w.sum() <= 1.2 + 1e-6
    pinned = lasso([1, 0.9, 0.05, 0.02], 1.2, [False, False, True, True])
    assert (pinned > 0).all() and np.linalg.norm(pinned) == pytest.approx(1)
    assert lasso([1, 0.9, 0], 1.2, [False, False, True])[2] > 0
    assert lasso([0, 0], 1.2) == pytest.approx([0.5**0.5] * 2)
    with pytest.raises(ValueError):
        lasso([1, 2], 1.2, [True])
    assert resolve_max_feats(None, 9) == 4.5
    with pytest.warns(UserWarning):
        assert resolve_max_feats(2, 9, 4) == 4
    with pytest.warns(UserWarning):
        assert resolve_max_feats(99, 9) == 9
    with pytest.raises(ValueError):
        resolve_max_feats(0.5, 9)


def test_sparse_drops_noise():
    state, ret, rng = planted()
    vol = pd.Series(np.abs(ret)).ewm(halflife=5).mean().to_numpy()
    x = np.stack([vol, rng.normal(size=900), rng.normal(size=900), vol + rng.normal(size=900) * 1e-4], axis=1)
    z = (x - x.mean(0)) / x.std(0)
    fit = fit_sparse(z, ret, 10.0, 2.0)
    assert fit.weights[0] > 0.5 and fit.weights[3] > 0.5 and max(fit.weights[1], fit.weights[2]) < 0.2
    pins = fit_sparse(z, ret, 10.0, 1.5, np.array([False, True, False, False]))
    assert pins.weights[1] > 0


def test_hmm_recovers_and_improves():
    state, ret, _ = planted(1800)
    fit = fit_hmm(ret)
    assert fit.vols[0] < fit.vols[1] and abs(fit.vols[0] - 0.006) < 0.001 and abs(fit.vols[1] - 0.02) < 0.002
    assert fit_hmm(ret, n_iter=2).loglik <= fit.loglik + 1e-6
    found = last_states(fit, ret, np.arange(900, 1800), 800)
    assert (found == state[900:]).mean() > 0.9
    assert fit_hmm(np.zeros(100)) is None


def test_last_state_is_the_full_viterbi():
    _, ret, _ = planted(120)
    fit = fit_hmm(ret)
    density, moves = fit.log_densities(ret), np.log(np.maximum(fit.transitions, 1e-300))
    for end in (40, 80, 119):
        value = np.log(np.maximum(fit.start, 1e-300)) + density[end - 30]
        for t in range(end - 29, end + 1):
            value = (value[:, None] + moves).max(axis=0) + density[t]
        assert last_states(fit, ret, np.array([end]), 31)[0] == value.argmax()
    ends = np.arange(40, 120)
    together = last_states(fit, ret, ends, np.minimum(60, ends))
    assert together.tolist() == [last_states(fit, ret, ends[i : i + 1], min(60, int(e)))[0] for i, e in enumerate(ends)]


@pytest.fixture(scope="module")
def toy(spark):
    state, ret, rng = planted(900)
    days = pd.bdate_range("2015-01-01", periods=900).date
    vol = pd.Series(np.abs(ret)).ewm(halflife=10).mean()
    frame = pd.DataFrame({"series_id": "s", "date": days, "vol": vol, "noise": rng.normal(size=900), "more": rng.normal(size=900), "ret": ret})
    return spark.createDataFrame(frame.iloc[60:])


def test_rolling_jump(toy):
    names = ["vol", "noise", "more"]
    fit = rolling_jump(toy, names, toy, 10.0, 300, 250, n_init=2, parallel=2)
    regimes = fit.regimes.orderBy("date").toPandas()
    schedule = fit.schedule.collect()
    assert len(regimes) == max(r.seg_end for r in schedule) - min(r.pos for r in schedule) and regimes.date.is_unique
    params = fit.params.toPandas()
    assert len(params) == 2 * len(schedule) and set(params.regime) == {"bull", "bear"} and "center_vol" in params
    assert fit.insample_last.count() == 300
    cut = toy.where("date < '2017-11-01'")
    early = rolling_jump(cut, names, cut, 10.0, 300, 250, n_init=2, parallel=2).regimes.orderBy("date").toPandas()
    assert early.regime.tolist() == regimes.regime[: len(early)].tolist()  # no later row matters


def test_rolling_sparse(toy):
    with pytest.warns(UserWarning):
        fit = rolling_jump(toy, ["vol", "noise", "more"], toy, 10.0, 300, 250, n_init=2, model="sjm", max_feats=1.5, pins=["more"], parallel=2)
    rows = selection_summary(fit.feat_weights, fit.pins).toPandas().set_index("feature")
    assert rows.selected_share["more"] == 1 and bool(rows.pinned["more"]) and rows.mean_weight["vol"] > rows.mean_weight["noise"]
    with pytest.warns(UserWarning):
        assert rolling_jump(toy, ["vol"], toy, model="jm", pins=["vol"], window=300, min_window=250).pins == []


def test_rolling_hmm(toy):
    found = rolling_hmm(toy.select("series_id", "date", "ret"), 300, 250, 63, n_init=2, parallel=2)
    regimes = found.regimes.orderBy("date").toPandas()
    assert len(regimes) == 840 - 250 and set(regimes.regime) <= {0, 1}
    assert found.params.count() == 2 * found.schedule.count()
    with pytest.raises(ValueError):
        rolling_hmm(toy.select("series_id", "date", "ret"), covariance_type="round")


def test_hmm_refit_that_fails_keeps_the_last_parameters(spark):
    ret = np.random.default_rng(4).normal(0, 0.01, 300)
    ret[120:260] = 0.0
    days = pd.DataFrame({"series_id": "s", "date": pd.bdate_range("2020-01-01", periods=300).date, "ret": ret})
    with pytest.warns(UserWarning, match="refits failed"):
        found = rolling_hmm(spark.createDataFrame(days), 100, 60, 20, n_init=2, parallel=2)
    regimes, refits = found.regimes.toPandas().sort_values("date"), found.params.select("refit_date").distinct().toPandas()
    assert regimes["date"].tolist() == days["date"].tolist()[60:]
    constant = {d for p, d in enumerate(days["date"]) if p >= 60 and (p - 60) % 20 == 0 and p - 100 >= 120 and p <= 260}
    assert constant and not constant & set(refits["refit_date"])
    kept = regimes[regimes["date"].isin(constant)]["refit_date"].unique().tolist()
    assert kept == [days["date"][200]]
    with pytest.raises(RuntimeError, match="first HMM fit"):
        rolling_hmm(spark.createDataFrame(days.assign(ret=0.0)), 100, 60, 20, n_init=2, parallel=2)


def test_stream_state_equals_one_pass():
    """Cut at any day, also at a refit, whose costs come from the last days under the new centres."""
    days = pd.DataFrame({"date": pd.bdate_range("2020-01-01", periods=90).date, "ret": np.random.default_rng(3).normal(size=90)})
    days.loc[7, "ret"] = np.nan
    refits = (Refit(dt.date(1, 1, 1), ((0.1, 0.1), (1.0, 0.6))), Refit(days["date"][40], ((-0.3, 0.0), (0.3, 0.1))))
    online = Online(refits, penalty=0.2, lookback=15)
    whole, after = online.advance(days, None)
    for cut in (1, 20, 39, 40, 41, 89):
        first, state = online.advance(days[:cut], None)
        second, again = online.advance(days[max(cut - 2, 0) :], state)  # the repeats count once
        both = pd.concat([first, second])
        np.testing.assert_allclose(both["mean_20"].to_numpy(), whole["mean_20"].to_numpy())
        assert both["regime"].tolist() == whole["regime"].tolist() and again == after
    x = np.nan_to_num(whole[["mean_5", "mean_20"]].to_numpy())
    late, _ = fold(losses(x[25:], np.asarray(refits[1].centers)), 0.2, None)
    assert whole["regime"].tolist()[40:] == late[15:].tolist()


def test_hmm_tied_and_starts_that_converge_early():
    rng = np.random.default_rng(6)
    state = (np.arange(1500) // 150) % 2
    x = rng.normal(np.where(state, -0.02, 0.02), 0.01)
    fit = fit_hmm(x, tied=True)
    assert fit.vols[0] == pytest.approx(fit.vols[1]) == pytest.approx(0.01, rel=0.1)
    np.testing.assert_allclose(fit.means, [-0.02, 0.02], atol=2e-3)
    many, one = fit_hmm(x, n_init=10, seed=3), [fit_hmm(x, n_init=10, n_iter=n, seed=3) for n in (1, 400)]
    assert one[0].loglik <= many.loglik <= one[1].loglik + 1e-6
