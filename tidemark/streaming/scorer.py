"""The simple detectors over streams, with one small state a series.

A point is scored from the state and the frozen history references that arrive
with it (a stream-static join), and the state then takes it in: one row out for
one row in. Within a micro-batch points are ordered by their ordinal; a point
whose ordinal is not above the last one seen is late and comes out with null
scores, and a non-finite value fails the query.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.detectors import KAPPA, KEEP, SLACK, TOLERANCE, standardised

SCORES = ("ewma", "cusum", "page_hinkley", "running_mean", "variance_ratio", "absolute", "squared")
STATE = "last long, n long, mean double, m2 double, level double, weight double, up double, down double, ph_up double, ph_down double, ph_up_min double, ph_down_min double, mean_abs double, mean_sq double"
OUTPUT = "id long, ordinal long, late boolean, " + ", ".join(f"{s} double" for s in SCORES)
REFERENCES = ("mu", "sd", "ref_var", "ref_abs", "ref_abs_sd", "ref_sq", "ref_sq_sd")
START = (-1, 0) + (0.0,) * 12


def references(series: DataFrame) -> DataFrame:
    """One row a series: what detectors need to know of its history."""
    return standardised(series).groupBy("id").agg(*[F.first(c).alias(c) for c in REFERENCES])


def advance(state: tuple, value: float, ref: dict) -> tuple[tuple, tuple]:
    """The state after a value, and the value's scores."""
    if not math.isfinite(value):
        raise ValueError("non-finite observation")
    last, n, mean, m2, level, weight, up, down, pu, pd_, pu0, pd0, ma, ms = state
    z, n = (value - ref["mu"]) / ref["sd"], n + 1
    step = z - mean
    mean += step / n
    m2 += step * (z - mean)
    level = KEEP * level + (1 - KEEP) * (value - ref["mu"])
    weight = KEEP * weight + 1
    up, down = max(0.0, up + z - SLACK), max(0.0, down - z - SLACK)
    pu, pd_ = pu + z - mean - TOLERANCE, pd_ - z + mean - TOLERANCE
    pu0, pd0 = min(pu0, pu), min(pd0, pd_)
    ma += (abs(z) - ma) / n
    ms += (z * z - ms) / n
    half = lambda q: q / (1 + q)
    scores = (
        math.tanh(abs(level / max(ref["sd"] / math.sqrt(max(weight, 1.0)), 1e-8)) / KAPPA), half(max(up, down)), half(max(pu - pu0, pd_ - pd0)), half(math.sqrt(n) * abs(mean)),
        half(abs(math.log(max(m2 / (n - 1), 1e-12) / max(ref["ref_var"], 1e-12)))) if n > 1 else 0.0,
        half(math.sqrt(n) * abs(ma - ref["ref_abs"]) / ref["ref_abs_sd"]), half(math.sqrt(n) * abs(ms - ref["ref_sq"]) / ref["ref_sq_sd"]),
    )
    return (last, n, mean, m2, level, weight, up, down, pu, pd_, pu0, pd0, ma, ms), scores


def _points(key, batches, state):
    rows = pd.concat(list(batches)).sort_values("ordinal", kind="stable")
    now = state.get if state.exists else START
    out = []
    for r in rows.to_dict("records"):
        if r["ordinal"] <= now[0]:
            out.append((key[0], r["ordinal"], True, *[None] * len(SCORES)))
            continue
        now, scores = advance(now, r["value"], r)
        now = (int(r["ordinal"]), *now[1:])
        out.append((key[0], r["ordinal"], False, *scores))
    state.update(now)
    yield pd.DataFrame(out, columns=["id", "ordinal", "late", *SCORES])


def score(points: DataFrame, refs: DataFrame) -> DataFrame:
    """Streaming points (id, ordinal, value) to one row each: id, ordinal, late, and the scores."""
    joined = points.select("id", F.col("ordinal").cast("long").alias("ordinal"), "value").join(refs, "id")
    return joined.groupBy("id").applyInPandasWithState(_points, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, source: str, schema: StructType, refs: DataFrame, sink: str, checkpoint: str, files: int = 1) -> None:
    """Run a folder of parquet files through score() until none is left; a restart on the same checkpoint goes on where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = score(stream, refs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Event-time sessions by user with a watermark, over a stream or a table: start, end, events, total value."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    g = e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")
