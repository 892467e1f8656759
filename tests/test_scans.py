"""Scans in blocks, Viterbi recurrences and array lasso against plain loops."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helmwind.functions.lasso import lasso_weights
from helmwind.models.hmm import HmmFit, last_states
from helmwind.models.jump import fit_jump, losses
from helmwind.models.sparse import lasso
from helmwind.operators import backtest as B
from helmwind.operators.online import fold, online_regimes, viterbi_online, viterbi_trailing
from helmwind.operators.rolling import fit_from_centers, rolling_hmm
from helmwind.operators.scan import chain, cheapest_states, replay, running_sums, summaries, wealth_and_peak


def days(n, start="2001-03-05"):
    return pd.bdate_range(start, periods=n).date


@pytest.mark.parametrize("k", [1, 2, 3])
def test_blocks_chain_to_the_whole(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        loss, moves = rng.random((int(rng.integers(1, 30)), k)), rng.random((k, k)) * (1 - np.eye(k))
        cuts = sorted(rng.integers(0, len(loss) + 1, 3))
        blocks = [b for b in np.split(loss, cuts) if len(b)]
        start = rng.random(k)
        want, value = [], start + loss[0]
        for t, row in enumerate(loss):
            value = value if t == 0 else (value[:, None] + moves).min(axis=0) + row
            want.append(int(value.argmin()))
        carried = chain(start, summaries(blocks, moves), moves)
        assert list(itertools.chain(*(s.tolist() for s in replay(blocks, np.array(carried), moves)))) == want


def test_a_long_series_spreads_over_tasks(spark):
    """Nine thousand days and three short series, in small Arrow batches so that blocks run over their ends."""
    rng = np.random.default_rng(0)
    frames = [pd.DataFrame({"series_id": s, "date": days(n), "x": rng.normal(size=(n, 2)).tolist()}) for s, n in (("long", 9000), ("a", 1), ("b", 261), ("c", 700))]
    rows = spark.createDataFrame(pd.concat(frames), "series_id string, date date, x array<double>").repartition(7)
    centers, penalty = ((0.2, 0.1), (0.6, -0.5), (-1.0, 0.4)), 1.3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        found = online_regimes(rows, centers, penalty)
        got = found.toPandas().sort_values(["series_id", "date"])
        tasks = found.where("series_id = 'long'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for frame in frames:
        want, _ = fold(losses(np.array(frame["x"].tolist()), np.asarray(centers)), penalty, None)
        own = got[got["series_id"] == frame["series_id"].iat[0]]
        assert own["regime"].tolist() == want.tolist() and own["date"].tolist() == frame["date"].tolist()
    assert tasks > 1
    assert online_regimes(rows.limit(0), centers, penalty).count() == 0


def test_wealth_and_sums_with_gaps(spark):
    rng = np.random.default_rng(1)
    frames = []
    for s, m, n in (("a", "x", 900), ("a", "y", 3), ("b", "x", 300)):
        ret = rng.normal(0, 0.05, n)
        ret[rng.random(n) < 0.2] = np.nan
        ret[0] = np.nan
        frames.append(pd.DataFrame({"series_id": s, "model": m, "date": days(n), "ret": ret}))
    rows = spark.createDataFrame(pd.concat(frames)).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret"))).repartition(5)
    got = wealth_and_peak(rows, 1 + F.col("ret"), ("model",)).toPandas().sort_values(["series_id", "model", "date"])
    sums = running_sums(rows, {"total": F.col("ret")}, ("model",)).toPandas().sort_values(["series_id", "model", "date"])
    dropped = B.drawdowns(rows, "ret", ("model",)).toPandas().sort_values(["series_id", "model", "date"])
    wealth = [(1 + f["ret"]).cumprod().ffill() for f in frames]
    np.testing.assert_allclose(got["__wealth"], pd.concat(wealth), rtol=1e-12)
    np.testing.assert_allclose(got["__peak"], pd.concat([w.cummax() for w in wealth]), rtol=1e-12)
    np.testing.assert_allclose(dropped["drawdown"], pd.concat([w / w.cummax() - 1 for w in wealth]), atol=1e-12)
    np.testing.assert_allclose(sums["total"], pd.concat([f["ret"].cumsum().ffill() for f in frames]), rtol=1e-9)
    plan = B.drawdowns(rows, "ret", ("model",))._jdf.queryExecution().executedPlan().toString()
    assert "__block" in plan and "functions=[(series_id" not in plan


FIT = HmmFit(np.array([0.5, 0.2, 0.3]), np.array([[0.9, 0.1, 0.0], [0.2, 0.7, 0.1], [0.0, 0.3, 0.7]]), np.array([0.0, 0.5, -1.0]), np.array([0.4, 1.0, 2.0]), np.nan)


def test_viterbi_recurrences_equal_the_kernel(spark):
    """Three states, steps that cannot be taken, and windows that fill up."""
    x = np.random.default_rng(5).normal(0, 1, 700)
    rows = spark.createDataFrame(pd.DataFrame({"series_id": "s", "date": days(700), "x": x}))
    ends = np.arange(20, 700)
    want = last_states(FIT, x, ends, np.minimum(50, ends))
    got = viterbi_trailing(rows, FIT, 50, 20).orderBy("date").toPandas()
    assert got["state"].tolist() == want.tolist() and got["date"].tolist() == days(700)[20:].tolist()
    whole = viterbi_online(rows, FIT).orderBy("date").toPandas()["state"]
    assert whole.tolist() == last_states(FIT, x, np.arange(700), np.arange(700) + 1).tolist()
    rolled = rolling_hmm(rows.withColumnRenamed("x", "ret"), 50, 20, 30, n_components=3, use_log=False, given=FIT, parallel=2)
    assert rolled.regimes.orderBy("date").toPandas()["state_raw"].tolist() == want.tolist()
    assert viterbi_trailing(rows.limit(0), FIT, 50, 20).count() == 0


def test_fit_from_centers(spark):
    rng = np.random.default_rng(2)
    z, ret = rng.normal(size=(400, 2)) + np.repeat([[0.0], [1.5]], 200, axis=0), rng.normal(size=400)
    rows = spark.createDataFrame(pd.DataFrame({"series_id": "s", "date": days(400), "x": z.tolist(), "ret": ret}), "series_id string, date date, x array<double>, ret double")
    fit = fit_jump(z, ret, 2.0, n_init=0, start=np.array([[0.0, 0.0], [1.0, 1.0]]), rounds=50)
    got = fit_from_centers(rows, [[0.0, 0.0], [1.0, 1.0]], 2.0, 50).orderBy("date").toPandas()
    assert got["state"].tolist() == fit.labels.tolist() and got["objective"].iat[0] == fit.objective
    one_round = fit_from_centers(rows, [[0.0, 0.0], [1.0, 1.0]], 2.0, 1).head()
    assert one_round.objective >= fit.objective


def test_cheapest_states_with_a_start(spark):
    rows = spark.createDataFrame([("s", days(1)[0], [1.0, 1.0])], "series_id string, date date, loss array<double>")
    assert cheapest_states(rows, [[0.0, 1.0], [1.0, 0.0]]).head().state == 0  # a tie
    assert cheapest_states(rows, [[0.0, 1.0], [1.0, 0.0]], [0.5, 0.0]).head().state == 1


@pytest.mark.parametrize("pins", [None, [True, False, False, True, False, False]])
@pytest.mark.parametrize("bound", [1.0, 1.2, 1.7, 2.2, 3.0])
def test_array_lasso_equals_the_kernel(spark, bound, pins):
    rng = np.random.default_rng(int(10 * bound))
    scores = [rng.random(6) * (rng.random(6) < p) - q for p in (1.0, 0.5) for q in (0.0, 0.3) for _ in range(25)]
    scores += [np.zeros(6), -np.ones(6), np.ones(6), np.array([1.0, 0, 0, 0, 0, 0]), np.array([1, 1, 0.5, 0.5, 0.5, 0.1]), np.array([1, 1e-9, 1e-9, 0, 0, 0])]
    rows = spark.createDataFrame([(i, list(map(float, s))) for i, s in enumerate(scores)], "i int, s array<double>")
    got = {r.i: r.w for r in rows.select("i", lasso_weights(F.col("s"), bound, pins).alias("w")).collect()}
    for i, s in enumerate(scores):
        np.testing.assert_allclose(got[i], lasso(s, bound, None if pins is None else np.array(pins), tolerance=1e-12 if s.max() > 1e-6 else 1e-8), atol=2e-8)
