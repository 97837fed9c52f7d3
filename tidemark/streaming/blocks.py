"""Evidence blocks over streams: raw energy, innovations, ranks, sign dependence and the slow conditional scale.

What a series' history fixes (references()) arrives with the series' points, gathered
from a batch, by a stream-static join. The state of a series holds the last points of each channel,
as many as the widest window needs, sums over all of them, the autoregression's
last inputs, the last sign and the scale's next forecast: a bounded number of
values, however long the stream. A point is scored from the forecast made before
it, and the state then takes it in. Micro-batches are worked through by numpy,
a series at a time. A late point (ordinal not above the last one seen) comes out
with null scores; a non-finite value fails the query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..operators import batch, blocks, models

CHANNELS = ("r", "i", "p_location", "p_energy", "js")
#: Column of each channel in the batch frame, and how its block is called.
BATCH = {"r": "blk_r", "i": "blk_i", "p_location": "blk_p_location", "p_energy": "blk_p_energy", "js": "blk_js"}
KEEP = max(blocks.WINDOWS)
SCORES = ("blk_r", "blk_i", "blk_p", "blk_d", "c_s", *[f"blk_i{k}" for k in range(1, 5)], "blk_p_location", "blk_p_energy", "blk_js")
STATE = "last long, n long, recent array<double>, sums array<double>, lags array<double>, signs array<double>, h double"
OUTPUT = "id {id}, ordinal long, t int, late boolean, " + ", ".join(f"{s} double" for s in (*SCORES, "mse_ratio"))


def references(frame: DataFrame) -> DataFrame:
    """One row a series: everything that the blocks need to know of its history, among it the sorted innovations of C.

    By numpy, a series at a time; series that only windows take (batch.odd) go through by_windows.
    """
    strange = batch.odd(frame)
    if strange.limit(1).count():
        return _by_numpy(frame.join(strange, "id", "left_anti")).unionByName(by_windows(frame.join(strange, "id", "left_semi")).select("id", *REFERENCE))
    return _by_numpy(frame)


#: Columns of the references.
REFERENCE = {"H": "int", "ar_mu": "double", "ar_sd": "double", "beta": "array<double>", "raw_mu": "double", "raw_sd": "double", "e_mu": "double", "e_sd": "double", "mse_ratio": "double", "cdf": "array<double>", "e_med": "double", "sg_ref": "double", "b0": "double", "u_mu": "double", "u_sd": "double", "tail": "array<double>", **{f"{n}_{k}": "double" for n in CHANNELS for k in ("rm", "rs")}, "h0": "double"}


def reference(v: np.ndarray, cut: int, name: object = None) -> dict:
    """The references of one history, whose first cut rows fit."""
    order, share, h = blocks.ORDER, blocks.SCALES["s"][0], len(v)
    c = h - cut
    sd = v[:cut].std(ddof=1) if cut > 1 else 0.0
    if cut < max(32, 4 * order) or sd <= 1e-8:
        raise ValueError(f"history too short or constant: {name}")
    out = {"H": h, "ar_mu": v[:cut].mean(), "ar_sd": sd}
    az = (v - out["ar_mu"]) / sd
    x = np.stack([np.ones(h - order), *[az[order - j : h - j] for j in range(1, order + 1)]])
    f = x[:, : cut - order]
    out["beta"] = beta = np.linalg.solve(f @ f.T + np.diag([0.0, *[blocks.RIDGE] * order]), f @ az[order:cut])
    e = az[order:] - beta @ x
    fit, tail = e[: cut - order], e[cut - order :]
    z2 = (az[cut:] ** 2).mean()
    out["mse_ratio"] = (tail**2).mean() / z2 if z2 else None
    out["raw_mu"], out["raw_sd"] = batch._centre(v[cut:])
    out["e_mu"], out["e_sd"] = batch._centre(tail)
    r = (tail - out["e_mu"]) / out["e_sd"]
    out["cdf"], out["e_med"] = np.sort(r), np.median(tail)
    s = np.sign(tail - out["e_med"])
    a, b = s[: c - 1], s[1:]
    ref = float(batch._correlation(c - 1, a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()))
    out["sg_ref"] = None if np.isnan(ref) else ref
    out["b0"] = b0 = max((fit * fit).mean(), 1e-16)
    forecast = batch._forecasts(np.append(e * e, 0.0), b0, share)
    out["h0"] = forecast[-1]
    u = tail / np.sqrt(np.maximum(np.maximum(forecast[cut - order : -1], 1e-16), 1e-4 * b0))
    out["u_mu"], out["u_sd"] = batch._centre(u)
    p = 2 * batch._midrank(r, r) - 1
    made = (((v[cut:] - out["raw_mu"]) / out["raw_sd"]) ** 2, r * r, p, p * p, ((u - out["u_mu"]) / out["u_sd"]) ** 2)
    for n, x in zip(CHANNELS, made, strict=True):
        out[f"{n}_rm"], out[f"{n}_rs"] = batch._centre(x)
    out["tail"] = az[-order:]
    return out


def _by_numpy(frame: DataFrame) -> DataFrame:
    def made(table):
        table = table.combine_chunks()
        k, v, h, cut, size = (table.column(c).to_numpy() for c in ("k", "value", "H", "cut", "_n"))
        at, found = [], []
        for first, order in batch.orders(k, size):
            at.append(first)
            found.append(reference(v[order[: int(h[first])]].astype(float), int(cut[first]), table.column("id")[first].as_py()))
        kinds = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(pa.array(at)), *[pa.array([f[c] for f in found], kinds[t]) for c, t in REFERENCE.items()]], ["id", *REFERENCE])

    return batch.by_series(frame, ("k", "value", "H", "cut"), f"id {dict(frame.dtypes)['id']}, " + ", ".join(f"`{c}` {t}" for c, t in REFERENCE.items()), made)


def by_windows(frame: DataFrame) -> DataFrame:
    """The references of series of any length, by windows."""
    d = blocks.raw_energy(frame, "_raw2")
    ref, past, v = blocks.ref_rows(), blocks.past(), F.col("value")
    d = blocks.innovation(blocks.autoregression(d))
    d = blocks.centred_ranks(d.withColumn("_inn2", F.col("r") * F.col("r")), "r", "_p")
    d = blocks.scales(blocks.sign_pairs(d), ["s"]).withColumn("_js2", F.pow("a_s", 2))
    order, share = blocks.ORDER, blocks.SCALES["s"][0]
    fit = blocks.fit_rows() & (F.col("k") >= order)
    e2 = F.col("e") * F.col("e")
    when = lambda c, x: F.when(c, x)
    floor = lambda x: F.greatest(F.stddev_samp(when(ref, x)), F.lit(1e-8))
    # what is only known after b0 and the last inputs' order
    aggs = [
        F.max("H").alias("H"), F.first("ar_mu").alias("ar_mu"), F.first("ar_sd").alias("ar_sd"), F.array(*[F.first(f"beta{i}") for i in range(order + 1)]).alias("beta"),
        F.avg(when(ref, v)).alias("raw_mu"), floor(v).alias("raw_sd"), F.avg(when(ref, F.col("e"))).alias("e_mu"), floor(F.col("e")).alias("e_sd"),
        F.first("mse_ratio").alias("mse_ratio"), F.sort_array(F.collect_list(when(ref, F.col("r")))).alias("cdf"),
        F.percentile(when(ref, F.col("e")), F.lit(0.5)).alias("e_med"), F.first("sg_ref").alias("sg_ref"),
        F.greatest(F.avg(when(fit, e2)), F.lit(1e-16)).alias("b0"), F.avg(when(ref, F.col("u_s"))).alias("u_mu"), floor(F.col("u_s")).alias("u_sd"),
        F.sum(when(past & (F.col("k") >= order), e2 * F.pow(F.lit(1 - share), F.col("H") - 1 - F.col("k")))).alias("_decayed"),
        F.transform(F.sort_array(F.collect_list(when(past & (F.col("k") >= F.col("H") - order), F.struct("k", "az")))), lambda x: x["az"]).alias("tail"),
    ]
    channels = {"r": "_raw2", "i": "_inn2", "p_location": "_p_v", "p_energy": "_p_w", "js": "_js2"}
    aggs += [x for n, c in channels.items() for x in (F.avg(when(ref, F.col(c))).alias(f"{n}_rm"), floor(F.col(c)).alias(f"{n}_rs"))]
    g = d.groupBy("id").agg(*aggs)
    first = F.pow(F.lit(1 - share), F.col("H") - order) * F.col("b0") + share * F.col("_decayed")
    return g.withColumn("h0", first).drop("_decayed")


def _signs(e: np.ndarray, middle: float) -> np.ndarray:
    return np.sign(e - middle)


def advance(state: tuple, values: np.ndarray, ref: dict) -> tuple[tuple, dict[str, np.ndarray]]:
    """The state after values, and the scores of each of them."""
    if not np.isfinite(values).all():
        raise ValueError("non-finite observation")
    last, n, recent, sums, lags, signs, h = state
    m, order, share = len(values), blocks.ORDER, blocks.SCALES["s"][0]
    beta = np.asarray(ref["beta"])
    az = np.concatenate((lags, (values - ref["ar_mu"]) / ref["ar_sd"]))
    e = az[order:] - beta[0] - sum(beta[j] * az[order - j : len(az) - j] for j in range(1, order + 1))
    r = (e - ref["e_mu"]) / ref["e_sd"]
    cdf = np.asarray(ref["cdf"])
    rank = (np.searchsorted(cdf, r, "left") + np.searchsorted(cdf, r, "right")) / 2
    p = 2 * (rank + 0.5) / (len(cdf) + 1) - 1
    forecast = np.empty(m)
    for k in range(m):  # observe the forecast, then commit the innovation
        forecast[k] = h
        h = (1 - share) * h + share * e[k] * e[k]
    v = np.maximum(np.maximum(forecast, 1e-16), 1e-4 * ref["b0"])
    a = (e / np.sqrt(v) - ref["u_mu"]) / ref["u_sd"]
    new = np.stack([((values - ref["raw_mu"]) / ref["raw_sd"]) ** 2, r * r, p, p * p, a * a])
    # rolling sums from the kept points and the new ones; channel by channel
    old = np.asarray(recent).reshape(len(CHANNELS), -1)
    both = np.concatenate((old, new), 1)
    total = np.concatenate((np.zeros((len(CHANNELS), 1)), np.cumsum(both, 1)), 1)
    at = old.shape[1] + np.arange(1, m + 1)
    count = n + np.arange(1, m + 1)
    out: dict[str, np.ndarray] = {}
    sums = np.asarray(sums)
    running = sums[:, None] + np.cumsum(new, 1)
    for c, name in enumerate(CHANNELS):
        parts = []
        for w in (*blocks.WINDOWS, None):
            k = count if w is None else np.minimum(count, w)
            s = running[c] if w is None else total[c, at] - total[c, at - k]
            q = np.sqrt(k) * np.abs(s / k - ref[f"{name}_rm"]) / ref[f"{name}_rs"]
            parts.append(q / (1 + q))
        out[BATCH[name]] = np.mean(parts, 0)
        if name == "i":
            out |= {f"blk_i{j}": x for j, x in enumerate(parts, 1)}
    out["blk_p"] = (out["blk_p_location"] + out["blk_p_energy"]) / 2
    out["c_s"] = (out["blk_js"] - out["blk_i"]) / np.sqrt(2.0)
    # signs of all kept points, the first of the stream among them until it falls out
    s = np.concatenate((signs, _signs(e, ref["e_med"])))
    x, y = np.concatenate(([0.0], s[:-1])), s
    base = len(signs)
    sign_scores = []
    # sums of signs and of their products are whole numbers, so differences of running sums are exact
    total = np.concatenate((np.zeros((5, 1)), np.cumsum(np.stack([x, y, x * x, y * y, x * y]), 1)), 1)
    at = base + 1 + np.arange(m)
    for w in blocks.SIGN_WINDOWS:
        score = np.zeros(m)
        k = np.minimum(n + np.arange(m), w - 1)
        on = np.flatnonzero(k >= blocks.FEWEST_PAIRS)
        if len(on) and ref["sg_ref"] is not None:
            far = np.sqrt(k[on]) * np.abs(batch._correlation(k[on], *(total[:, at[on]] - total[:, at[on] - k[on]])) - ref["sg_ref"])
            score[on] = np.where(np.isnan(far), 0.0, far / (1 + far))
        sign_scores.append(score)
    out["blk_d"] = np.mean(sign_scores, 0)
    kept = both[:, -KEEP:]
    return (last, n + m, kept.ravel(), running[:, -1], az[-order:], s[-KEEP:], float(h)), out


def _start(ref: dict) -> tuple:
    return -1, 0, np.empty(0), np.zeros(len(CHANNELS)), np.asarray(ref["tail"], float), np.empty(0), ref["h0"]


def _points(key, batches, state):
    rows = pd.concat(list(batches))
    ref = {k: None if isinstance(v, float) and np.isnan(v) else v for k, v in rows.iloc[0].items()}
    ordinal, value = (np.concatenate(rows[c].to_list()) for c in ("ordinals", "points"))
    order = np.argsort(ordinal, kind="stable")
    ordinal, value = ordinal[order], value[order].astype(float)
    now = state.get if state.exists else _start(ref)
    now = (*now[:2], *[np.asarray(x, float) for x in now[2:6]], now[6]) if state.exists else now
    late = ordinal <= now[0]
    late[1:] |= ordinal[1:] == ordinal[:-1]
    fresh = value[~late]
    out = pd.DataFrame({"id": key[0], "ordinal": ordinal, "t": pd.array([None] * len(ordinal), "Int32"), "late": late, **{s: np.full(len(ordinal), np.nan) for s in SCORES}, "mse_ratio": np.nan if ref["mse_ratio"] is None else ref["mse_ratio"]})
    if len(fresh):
        n = now[1]
        now, scores = advance(now, fresh, ref)
        now = (int(ordinal[~late].max()), *now[1:])
        at = np.flatnonzero(~late)
        out.loc[at, "t"] = n + np.arange(len(at))
        for k in SCORES:
            out.loc[at, k] = scores[k]
    state.update((now[0], now[1], *[[float(v) for v in x] for x in now[2:6]], float(now[6])))
    yield out


def _gathered(batches):
    """A row for each series of a batch, so that references are sent with a batch's points and not with every one."""
    for b in batches:
        g = pa.Table.from_batches([b]).group_by("id", use_threads=False).aggregate([("ordinal", "list"), ("value", "list")]).combine_chunks()
        yield from g.select(["id", "ordinal_list", "value_list"]).rename_columns(["id", "ordinals", "points"]).to_batches()


def score(points: DataFrame, refs: DataFrame) -> DataFrame:
    """Streaming points (id, ordinal, value) to one row each: id, ordinal, t, late, the blocks, and mse_ratio."""
    points = points.filter("id is not null").select("id", F.col("ordinal").cast("long").alias("ordinal"), F.col("value").cast("double").alias("value"))
    joined = points.mapInArrow(_gathered, f"id {dict(points.dtypes)['id']}, ordinals array<long>, points array<double>").join(refs, "id")
    return joined.groupBy("id").applyInPandasWithState(_points, OUTPUT.format(id=dict(points.dtypes)["id"]), STATE, "append", GroupStateTimeout.NoTimeout)


def infer(points: DataFrame, refs: DataFrame, model: dict) -> DataFrame:
    """Streaming points to id, ordinal, t, prediction of a model over the base blocks and c_s; late points are left out."""
    s = score(points, refs).filter("not late")
    return models.predict(s, model).select("id", "ordinal", "t", "prediction")


def replay(spark: SparkSession, source: str, schema: StructType, made, sink: str, checkpoint: str, files: int = 1, batches: int | None = None) -> None:
    """Run a folder of parquet files through made(stream) until none is left, or for so many batches; a restart on the checkpoint goes on there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    w = made(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    if batches is None:
        w.trigger(availableNow=True).start().awaitTermination()
        return
    q = w.trigger(processingTime="0 seconds").start()
    try:
        while q.lastProgress is None or q.lastProgress["batchId"] < batches - 1:
            if q.exception() is not None:
                raise q.exception()
            q.awaitTermination(0.1)
    finally:
        q.stop()


def last_points(frame: DataFrame) -> DataFrame:
    """id, ordinal, value of the online rows, as a stream would bring them."""
    return frame.filter("period = 2").select("id", F.col("k").cast("long").alias("ordinal"), "value", F.ntile(4).over(W.partitionBy("id").orderBy("k")).alias("part"))
