"""A frame written in passes is the frame written at once, and leaves no shuffle behind."""

import glob
import os

import numpy as np
import pytest

from tidemark.operators import batch, decisions, models, scoring
from tidemark.plans import queries
from tidemark.sources.series import from_lineitem


def test_folds_are_the_manifests(spark, sf_dir):
    x = from_lineitem(spark, sf_dir)
    got, want = (df.select("id", "fold").orderBy("id").toPandas() for df in (decisions.folds(x), decisions.manifest(x)))
    assert got.astype(int).equals(want.astype(int))


def test_folds_need_no_place_in_the_series(spark, sf_dir):
    plan = decisions.folds(from_lineitem(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan.split("Relation")[0]


@pytest.mark.parametrize("experiment", ["E16", "E18", "E19", "E20", "E21"])
def test_passes_give_the_same_frame_and_drop_their_shuffles(spark, sf_dir, monkeypatch, experiment):
    def frame():
        return queries._frame(spark, sf_dir, experiment).toPandas().sort_values(["id", "t"]).reset_index(drop=True)

    local = os.path.realpath(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = set(glob.glob(f"{local}/*/shuffle_*"))
    whole = frame()
    monkeypatch.setattr(queries, "_PASS_ROWS", 1)
    parts = frame()
    assert list(whole) == list(parts) and whole[["id", "t", "target", "fold"]].equals(parts[["id", "t", "target", "fold"]])
    for c in whole:
        assert np.abs(whole[c] - parts[c]).max() < 1e-12, c
    made = set(glob.glob(f"{local}/*/shuffle_*")) - before
    assert sum(os.path.getsize(f) for f in made if os.path.exists(f)) < 20_000


def test_passes_cover_every_cell_and_shrink_as_the_frame_grows():
    for passes in (1, 2, 4, 7):
        for columns in (1, 6, 11):
            parts = batch.dealt(passes, columns)
            assert [c for a, b in parts for c in range(a, b)] == list(range(batch.CELLS))
            sizes = [b - a for a, b in parts]
            assert all(x > y > 0 for x, y in zip(sizes, sizes[1:], strict=False))


@pytest.mark.parametrize("experiment", ["E20", "E16", "E19", "E21"])
def test_scores_over_passes_are_the_scores_at_once_and_leave_no_frame(spark, sf_dir, monkeypatch, experiment):
    want = scoring.pooled_and_folds(models.out_of_fold(queries._frame(spark, sf_dir, experiment), experiment)).orderBy("fold").collect()
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    monkeypatch.setattr(queries, "_PASS_ROWS", 1)
    got = queries.QUERIES[f"model_{experiment}"](spark, sf_dir).orderBy("fold").collect()
    assert [r["fold"] for r in got] == [-1, 0, 1, 2, 3, 4]
    for a, b in zip(got, want, strict=True):
        assert (a["pair_weight"], a["eligible_ages"]) == (b["pair_weight"], b["eligible_ages"]) and abs(a["ts_auc"] - b["ts_auc"]) < 1e-9
    left = {name for d in set(os.listdir(shared)) - before for name in os.listdir(f"{shared}/{d}")}
    assert left == {"terms"}
