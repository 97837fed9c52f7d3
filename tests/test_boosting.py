"""Boosted trees against trees grown row by row, and what bounds them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, models, scoring


def frame(seed, series=60):
    r = np.random.default_rng(seed)
    rows = [(i, t, int(i % 2 and t >= 4), i % 6 if i % 6 < 5 else 7, *np.round(r.random(4) ** 2 + 0.2 * (i % 2) * (t >= 4), 2)) for i in range(series) for t in range(r.integers(4, 17))]
    f = pd.DataFrame(rows, columns=["id", "t", "target", "fold", *models.BASE])
    f[list(models.BASE)] = np.minimum(f[list(models.BASE)], 1.0)
    return f


def by_rows(f, k, omega, rounds, step, least, l2):
    """Predictions for fold k: every split of every node tried on the rows themselves, at most two levels."""
    x = np.minimum((f[list(models.BASE)].to_numpy() * boosting.GRID).astype(int), boosting.GRID - 1)
    on = ((f["fold"] != k) & (omega > 0)).to_numpy()
    b = np.stack([boosting._bins(np.bincount(x[on, j], minlength=boosting.GRID))[x[:, j]] for j in range(4)], 1)
    score, y = np.zeros(len(f)), f["target"].to_numpy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = np.where(on, omega * (p - y), 0), np.where(on, omega * p * (1 - p), 0)
        worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)

        def add(m, depth):
            best = (0.0, None)
            for j in range(4) if depth < 2 else ():
                for s in range(63):
                    left, right = m & (b[:, j] <= s), m & (b[:, j] > s)
                    if min((left & on).sum(), (right & on).sum()) >= least and min(h[left].sum(), h[right].sum()) >= 1e-3:
                        gain = worth(left) + worth(right) - worth(m)
                        best = (gain, (left, right)) if gain > best[0] + 1e-15 else best
            if best[1]:
                for part in best[1]:
                    add(part, depth + 1)
            else:
                score[m] -= step * g[m].sum() / (h[m].sum() + l2)

        add(np.ones(len(f), bool), 0)
    return 1 / (1 + np.exp(-score))


@pytest.mark.parametrize("few", [2, 32])  # 2: sums go through tasks
def test_trees_are_those_grown_row_by_row(spark, monkeypatch, few):
    monkeypatch.setattr(boosting, "FEW", few)
    monkeypatch.setattr(boosting, "CHUNK", 100)
    f = frame(1)
    settings = {"rounds": 6, "step": 0.3, "least": 30, "l2": 0.01}
    got = models.boosted(spark.createDataFrame(f).repartition(5), **settings).toPandas().sort_values(["id", "t"])
    assert sorted(got["fold"].unique()) == [0, 1, 2, 3, 4]  # fold 7 trains all and is not predicted
    for k in range(5):
        rest = scoring.training_weights(spark.createDataFrame(f[f["fold"] != k])).toPandas()[["id", "t", "omega"]]
        omega = f.merge(rest, on=["id", "t"], how="left")["omega"].fillna(0).to_numpy()
        want = f.assign(p=by_rows(f, k, omega, **settings))[f["fold"] == k].sort_values(["id", "t"])
        mine = got[got["fold"] == k]
        assert mine[["id", "t"]].to_numpy().tolist() == want[["id", "t"]].to_numpy().tolist()
        assert np.abs(mine["prediction"].to_numpy() - want["p"].to_numpy()).max() < 1e-9
        assert mine["prediction"].nunique() > 4


def test_held_out_rows_fix_nothing(spark):
    f = frame(2)
    other = f.assign(target=np.where(f["fold"] == 3, 1 - f["target"], f["target"]))
    settings = {"rounds": 3, "least": 30}
    a, b = (models.boosted(spark.createDataFrame(x), **settings).toPandas().sort_values(["id", "t"]) for x in (f, other))
    assert (a[a["fold"] == 3]["prediction"].to_numpy() == b[b["fold"] == 3]["prediction"].to_numpy()).all()


def test_nulls_fail(spark):
    f = spark.createDataFrame(frame(3)).withColumn("blk_p", F.when(F.col("id") != 5, F.col("blk_p")))
    with pytest.raises(Exception, match="non-finite"):
        models.boosted(f, rounds=1).collect()
