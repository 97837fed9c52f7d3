"""From files to results: prepared tables, bundles, tampering, packages, and the commands' functions."""

import pytest
from pyspark.sql import functions as F

from tidemark import api
from tidemark.operators import models
from tidemark.sources import artifacts, series


def test_prepare_is_immutable(spark, tmp_path):
    x, y, i = series.synthetic(spark)
    paths = [str(tmp_path / n) for n in ("x", "y", "i")]
    for df, p in zip((x.drop("ordinal"), y, i), paths, strict=True):
        df.coalesce(1).write.parquet(p)
    s = artifacts.prepare(spark, *paths, str(tmp_path / "cache"))
    assert s.select("id").distinct().count() == 30
    assert artifacts.prepare(spark, *paths, str(tmp_path / "cache")).count() == s.count()
    y.limit(5).coalesce(1).write.mode("append").parquet(paths[1])
    with pytest.raises(ValueError, match="changed"):
        artifacts.prepare(spark, *paths, str(tmp_path / "cache"))
    with pytest.raises(ValueError, match="twice_y"):
        artifacts.prepare(spark, *paths, str(tmp_path / "other"))


def test_train_then_infer_without_labels(spark, sf_dir, tmp_path):
    frame = series.from_lineitem(spark, sf_dir)
    folder = str(tmp_path / "model")
    m = api.train(frame, folder, "E08")
    p = api.infer(frame.drop("target", "tau_index"), folder)
    assert p.filter("prediction > 0 and prediction < 1").count() == frame.filter("period = 2").count()
    assert models.loads(artifacts.read_bundle(folder))["slopes"] == m["slopes"]
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_table(p, f"{folder}-features")
    (tmp_path / "model" / "model.json").write_bytes(b"{}")
    with pytest.raises(ValueError, match="changed"):
        artifacts.read_bundle(folder)


def test_package_is_reproducible(tmp_path):
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    for n in ("1.zip", "2.zip"):
        artifacts.package(tmp_path, tmp_path / n, ("b.txt", "a.txt"))
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()


def test_admission_against_a_frozen_specification(tmp_path):
    guarded, path = tmp_path / "folds.csv", tmp_path / "spec.json"
    guarded.write_text("1,2\n")
    spec = {"sources": {"x": "ab"}, "config": {"rate": 0.5, "limit": None}, "folds": [1, 2]}
    pin = artifacts.freeze(path, spec, (guarded,))
    assert artifacts.admit(path, pin, spec) == spec
    with pytest.raises(ValueError, match="already"):
        artifacts.freeze(path, spec)
    with pytest.raises(ValueError, match="config, folds, more$"):
        artifacts.admit(path, pin, {"sources": {"x": "ab"}, "config": {"rate": 0.5}, "more": None})
    with pytest.raises(ValueError, match="pinned"):
        artifacts.admit(path, "0" * 64, spec)
    guarded.write_text("1,3\n")
    with pytest.raises(ValueError, match="folds.csv"):
        artifacts.admit(path, pin, spec)


def test_backtest_and_compare(spark, sf_dir):
    frame = series.from_lineitem(spark, sf_dir)
    a, b = api.backtest(frame, "squared").cache(), api.backtest(frame, "E03").cache()
    r = api.compare(frame, a, b)
    assert set(r["gate"]) == {"pooled", "folds", "late", "early"}
    same = api.compare(frame, a, a)
    assert set(same["folds"].values()) == {0.0}
    assert a.filter(F.col("prediction").isNull()).count() == 0
