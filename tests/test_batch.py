"""The frame by numpy is the frame by windows, and models read no more than they need."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, batch, blocks, models
from tidemark.plans import queries
from tidemark.sources.series import from_lineitem

COLUMNS = ("blk_r", "blk_i", "blk_p", "blk_d", "mse_ratio", "c_s", "c_f", "c_r", "k_s", "blk_i1", "blk_i4", "blk_p_location", "blk_p_energy", *blocks.MOMENTS, *batch.LIKELIHOOD)


@pytest.mark.parametrize("longest", [batch.LONGEST, 600])  # by 600 some series go through the windows
def test_same_frame(spark, sf_dir, monkeypatch, longest):
    monkeypatch.setattr(batch, "LONGEST", longest)
    x = from_lineitem(spark, sf_dir)
    assert (batch.odd(x).count() > 0) == (longest == 600)
    order = lambda df: df.toPandas().sort_values(["id", "t"]).reset_index(drop=True)
    got = order(batch.features(x, COLUMNS, ("target",)))
    want = order(blocks.features(x, "normal").select("id", "t", "target", *COLUMNS))
    assert got[["id", "t", "target"]].equals(want[["id", "t", "target"]])
    for c in COLUMNS:
        assert np.abs(got[c] - want[c]).max() < 1e-9, c


def test_short_history_fails(spark, sf_dir):
    with pytest.raises(Exception, match="history too short"):
        batch.features(from_lineitem(spark, sf_dir).filter("k < 40").withColumns({"H": F.lit(30), "cut": F.lit(21)}), ("blk_i",)).collect()


@pytest.mark.parametrize("experiment", ["E14", "E16", "E18", "E19", "E20", "E21"])
def test_a_model_writes_what_it_reads(spark, sf_dir, experiment):
    f = queries._frame(spark, sf_dir, experiment)
    assert set(f.columns) == {"id", "t", "target", "fold", "mse_ratio", *models.BASE, *models.EXTRAS[experiment]}


def test_folds_fitted_together_are_those_fitted_alone(spark, sf_dir):
    f = queries._frame(spark, sf_dir, "base").cache()
    for e in ("E08", "E12"):
        for k, m in enumerate(models.fits(f, e, list(range(5)))):
            if k in (0, 3):
                rest = f.filter(F.col("fold") != k)
                assert models.fit(rest, e)["slopes"] == pytest.approx(m["slopes"], abs=1e-9)
                assert models.gradient(rest, m).agg(F.max(F.abs("gradient"))).first()[0] < 1e-9


def test_quantiles_hold_no_column_in_one_task(spark):
    """Exact quantiles of ties, a heavy tail, nulls and a constant, without a percentile aggregate."""
    r = np.random.default_rng(4)
    f = pd.DataFrame({"a": r.normal(size=3001), "b": np.round(r.normal(size=3001), 1), "c": np.exp(9 * r.normal(size=3001)), "d": 0.25})
    df = spark.createDataFrame(f).withColumn("a", F.when(F.col("a") < 2, F.col("a"))).repartition(5)
    f.loc[f["a"] >= 2, "a"] = np.nan
    spans = {c: (int(f[c].count()), f[c].min(), f[c].max()) for c in f}
    levels = list(audits.LEVELS.values())
    got = audits.quantiles(df, spans, levels)
    for c in f:
        assert got[c] == pytest.approx(np.quantile(f[c].dropna(), levels), rel=1e-12), c
