"""Streams give the batch's scores, resume where they stopped, and refuse what is late or not finite."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors
from tidemark.sources.series import from_events, from_lineitem
from tidemark.streaming import blocks as stream_blocks
from tidemark.streaming import scorer


def test_stream_resumes_and_equals_batch(spark, sf_dir, tmp_path):
    x = from_events(spark, sf_dir)
    points = x.filter("period = 2").select("id", F.col("k").cast("long").alias("ordinal"), "value", "t")
    refs = scorer.references(x)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    points.filter("t < 9").select("id", "ordinal", "value").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    scorer.replay(spark, src, schema, refs, out, state)
    rest = points.filter("t >= 9").union(points.filter("t = 2"))  # t = 2 comes again, late
    rest.select("id", "ordinal", "value").coalesce(1).write.mode("append").parquet(src)
    scorer.replay(spark, src, schema, refs, out, state)
    got = spark.read.parquet(out).toPandas()
    series = got.id.nunique()
    assert got.late.sum() == series
    batch = detectors.detect(x, *scorer.SCORES).toPandas()
    m = got[~got.late].merge(batch, left_on=["id", "ordinal"], right_on=["id", "k"], suffixes=("", "_batch"))
    assert len(m) == len(batch)
    for s in scorer.SCORES:
        assert np.abs(m[s] - m[f"{s}_batch"]).max() < 1e-9


def test_non_finite_fails():
    ref = {"mu": 0.0, "sd": 1.0, "ref_var": 1.0, "ref_abs": 0.0, "ref_abs_sd": 1.0, "ref_sq": 0.0, "ref_sq_sd": 1.0}
    with pytest.raises(ValueError):
        scorer.advance(scorer.START, float("nan"), ref)


def test_sessions(spark):
    e = spark.createDataFrame(pd.DataFrame({"user_id": [1, 1, 1], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 05:00", "2024-01-01 12:00"]), "value": [1.0, 2.0, 3.0]}))
    got = sorted((r["events"], r["value"]) for r in scorer.sessions(e).collect())
    assert got == [(1, 3.0), (2, 3.0)]


def test_references_by_numpy_are_those_by_windows(spark, sf_dir):
    x = from_lineitem(spark, sf_dir)
    got, want = (df.toPandas().sort_values("id") for df in (stream_blocks.references(x), stream_blocks.by_windows(x).select("id", *stream_blocks.REFERENCE)))
    assert list(got["id"]) == list(want["id"])
    for c in stream_blocks.REFERENCE:
        for a, b in zip(got[c], want[c], strict=True):
            assert np.abs(np.asarray(a, float) - np.asarray(b, float)).max() < 1e-9, c


def test_points_meet_references_by_batch(spark):
    """Points of a series come gathered, whatever their order, and no null or repeat is lost."""
    b = pa.record_batch({"id": ["a", "b", "a", "a"], "ordinal": pa.array([5, 1, 4, 5], pa.int64()), "value": [0.5, None, 0.25, 0.75]})
    (g,) = stream_blocks._gathered([b])
    assert g.to_pylist() == [{"id": "a", "ordinals": [5, 4, 5], "points": [0.5, 0.25, 0.75]}, {"id": "b", "ordinals": [1], "points": [None]}]
