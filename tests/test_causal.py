"""Detectors and blocks against scalar loops, and the properties a causal score must have."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.causal import decayed_sums, midrank, normal_quantile
from tidemark.operators import blocks, detectors
from tidemark.sources.series import _positions
from tidemark.streaming import scorer


def frame(spark, series):
    """Series frame from {id: (history, online)}."""
    out = []
    for i, (h, o) in series.items():
        out += [(i, k, float(v), len(h) + len(o), len(h), 1 if k < len(h) else 2) for k, v in enumerate([*h, *o])]
    return _positions(spark.createDataFrame(pd.DataFrame(out, columns=["id", "k", "value", "n", "H", "period"])))


def loop(history, online):
    h = np.asarray(history, float)
    mu, sd = (h.mean() if len(h) else 0.0), max(h.std(ddof=1) if len(h) > 1 else 1.0, 1e-8)
    z = (h - mu) / sd
    ref = {"mu": mu, "sd": sd, "ref_var": z.var(ddof=1) if len(z) > 1 else 1.0}
    for n, a in (("abs", np.abs(z)), ("sq", z * z)):
        ref |= {f"ref_{n}": a.mean() if len(a) else 0.0, f"ref_{n}_sd": max(a.std(ddof=1) if len(a) > 1 else 1.0, 1e-8)}
    state, out = scorer.START, []
    for x in online:
        state, scores = scorer.advance(state, float(x), ref)
        out.append(scores)
    return np.array(out)


R = np.random.default_rng(7)
CASES = {
    1: (R.normal(size=100), R.normal(size=80)), 2: (R.normal(size=50), R.normal(size=300) * 3 + 1), 3: (np.full(40, 2.0), np.full(30, 2.0)),
    4: (R.normal(size=60) * 1e-10, R.normal(size=40) * 1e-10), 5: (R.normal(size=60) + 1e6, R.normal(size=40) + 1e6), 6: (np.zeros(20), np.zeros(10)),
}


def detect(spark, cases):
    return detectors.detect(frame(spark, cases), *scorer.SCORES).toPandas().sort_values(["id", "t"])


def test_detectors_match_the_loop(spark):
    got = detect(spark, CASES)
    for i, (h, o) in CASES.items():
        mine = got[got.id == i][list(scorer.SCORES)].to_numpy()
        assert np.abs(mine - loop(h, o)).max() < 1e-7 if i == 5 else np.abs(mine - loop(h, o)).max() < 1e-9


def test_constant_unchanged_series_score_nothing(spark):
    got = detect(spark, {3: CASES[3], 6: CASES[6]})
    assert (got[list(scorer.SCORES)].to_numpy() == 0).all()


def test_prefix_and_order_do_not_matter(spark):
    whole = detect(spark, CASES).set_index(["id", "t"])
    short = detect(spark, {k: (h, o[:25]) for k, (h, o) in reversed(list(CASES.items()))}).set_index(["id", "t"])
    both = whole.loc[short.index]
    assert np.abs(both[list(scorer.SCORES)].to_numpy() - short[list(scorer.SCORES)].to_numpy()).max() < 1e-12


def test_decayed_sum_beyond_one_block(spark):
    x = R.normal(size=9500)
    df = spark.createDataFrame(pd.DataFrame({"id": 1, "k": np.arange(len(x)), "x": x}))
    got = decayed_sums(df, {"s": ("x", 0.95)}, "k").toPandas().sort_values("k")["s"].to_numpy()
    want, s = [], 0.0
    for v in x:
        s = 0.95 * s + v
        want.append(s)
    assert np.abs(got - np.array(want)).max() < 1e-11


def test_normal_quantile(spark):
    p = [1e-300, 1e-12, 0.01, 0.074, 0.076, 0.5, 0.9, 0.925, 0.999999]
    q = normal_quantile(spark.createDataFrame([(v,) for v in p], ["p"]), "p", "q").collect()
    assert max(abs(r["q"] - statistics.NormalDist().inv_cdf(r["p"])) for r in q) < 1e-12


def test_midrank_micro_vector(spark):
    df = spark.createDataFrame([(1, v, True) for v in (-2.0, 1.0, 1.0, 1.0, 5.0)] + [(1, -100.0, False), (1, 100.0, False)], ["id", "x", "ref"])
    got = {(r["x"], r["ref"]): r["u"] for r in midrank(df, "x", F.col("ref"), "u").collect()}
    assert got[-100.0, False] == pytest.approx(0.5 / 6)
    assert got[100.0, False] == pytest.approx(5.5 / 6)
    assert got[1.0, True] == pytest.approx((1 + 1.5 + 0.5) / 6)


def series_with_lags(seed=3, h=400, n=320):
    r = np.random.default_rng(seed)
    x = np.zeros(h + n)
    for k in range(1, h + n):
        x[k] = 0.4 * x[k - 1] + r.standard_t(5)
    return x[:h], x[h:]


def test_autoregression_matches_a_direct_fit(spark):
    h, o = series_with_lags()
    got = blocks.autoregression(frame(spark, {1: (h, o)})).orderBy("k").toPandas()
    cut = int(0.7 * len(h))
    mu, sd = h[:cut].mean(), h[:cut].std(ddof=1)
    z = (np.concatenate((h, o)) - mu) / sd
    w = np.lib.stride_tricks.sliding_window_view(z, 6)
    x = np.column_stack((np.ones(len(w)), w[:, :-1][:, ::-1]))
    fit = slice(0, cut - 5)
    beta = np.linalg.solve(x[fit].T @ x[fit] + np.diag([0, 1, 1, 1, 1, 1]), x[fit].T @ w[fit, -1])
    assert np.abs(got[[f"beta{i}" for i in range(6)]].iloc[0].to_numpy() - beta).max() < 1e-10
    assert np.abs(got["e"].to_numpy()[5:] - (w[:, -1] - x @ beta)).max() < 1e-9


def test_short_history_fails_closed(spark):
    with pytest.raises(Exception, match="history too short"):
        blocks.autoregression(frame(spark, {1: (R.normal(size=20), R.normal(size=10))})).select("e").collect()


def test_rolling_energy_and_scale_match_loops(spark):
    h, o = series_with_lags(5)
    f = blocks.features(frame(spark, {1: (h, o)}).withColumn("target", F.lit(0)), "scale").orderBy("t").toPandas()
    cut = int(0.7 * len(h))
    c = h[cut:]
    zc, zo = ((v - c.mean()) / c.std(ddof=1) for v in (c, o))
    ref = zc**2
    for t in (0, 5, 200, 319):
        parts = []
        for w in (32, 128, 256, 10**9):
            part = zo[max(0, t + 1 - w) : t + 1] ** 2
            q = math.sqrt(len(part)) * abs(part.mean() - ref.mean()) / ref.std(ddof=1)
            parts.append(q / (1 + q))
        assert f["blk_r"][t] == pytest.approx(np.mean(parts), abs=1e-9)
    e = blocks.autoregression(frame(spark, {1: (h, o)})).orderBy("k").toPandas()["e"].to_numpy()
    b = np.mean(e[5:cut] ** 2)
    s, v = b, []
    for k in range(5, len(e)):
        v.append(max(s, 1e-16, 1e-4 * b))
        s = 0.99 * s + 0.01 * e[k] ** 2
    assert np.abs(f["v_s"].to_numpy() - np.array(v)[len(h) - 5 :]).max() < 1e-10


def test_bounded_blocks(spark):
    h, o = series_with_lags(9)
    f = blocks.features(frame(spark, {1: (h, o)}).withColumn("target", F.lit(0))).toPandas()
    names = ["blk_r", "blk_i", "blk_p", "blk_d", "blk_js", "blk_jf", "blk_jr", "blk_ps", *blocks.MOMENTS, "l_plus", "l_minus", "c_plus", "c_minus", "drawdown", "trajectory_ewma"]
    x = f[names].to_numpy()
    assert np.isfinite(x).all()
    assert (x >= 0).all() and (x <= 1).all()
    assert len(f) == len(o)
