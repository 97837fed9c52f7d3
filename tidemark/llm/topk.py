"""Exact top-k by inner product, with a pivot table.

Vectors are scaled to whole numbers and saved with a key of their own and with
their distances to PIVOTS pivot vectors, the pivot table. By the triangle
inequality the largest difference of two vectors' distances to a pivot bounds
their own distance from below, and as
    2 <q, x> = |q|^2 + |x|^2 - |q - x|^2
this bounds the inner product from above.

Vectors fall into cells: the nearest pivot, cut into rings by the distance to
it, CELLS at most; a cell keeps the range of its vectors' distances to every
pivot and their greatest norm, so one bound holds for all its vectors. Large
cells are dealt into slices of about SLICE vectors. A query first meets one slice
of its own cell; its k-th best score there is its threshold. It is then sent to
the other slices of those cells alone whose bound reaches the threshold, in
blocks of queries. Within a slice the candidates of a query are evaluated in the
order of their bounds until no bound that is left beats the k-th best score, so
the result is exact; winners are merged by a window that keeps k.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; vectors of other lengths than the query's are not its
candidates; every row whose vec_id is divisible is a query of its own, compared
with every row but itself, so a repeated vec_id gives as many lists, told apart
by query_row; a null vec_id takes no part; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

PIVOTS = 32
CELLS = 2048
QUERY_BLOCK = 1024
SLICE = 8192
STEP = 64


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors to pivots; no better than double precision of their squares."""
    a, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (p * p).sum(1) - 2 * a @ p.T, 0))


def _low(gap: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A lower bound of distances from differences of distances to a pivot: slack for the rounding of squares of this size."""
    return np.maximum(gap - 1e-6 * np.sqrt(size) - 1e-3, 0)


def _block_top(q: np.ndarray, x: np.ndarray, q_row: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, dq: np.ndarray, dx: np.ndarray, least: np.ndarray, k: int):
    """For each query the places of its k best candidates in the slice that reach its threshold, and their scores."""
    wide = max(float(np.abs(q).max(initial=0)), 1) * max(float(np.abs(x).max(initial=0)), 1) * x.shape[1] >= 2**52
    if not wide:
        q, x = q.astype(np.float64), x.astype(np.float64)  # products and sums stay exact
    fq, fx = q.astype(np.float64), x.astype(np.float64)
    nq, nx = (fq * fq).sum(1), (fx * fx).sum(1)
    out = []
    for i in range(len(q)):
        low = np.zeros(len(x))
        for p in range(dx.shape[1]):
            np.maximum(low, np.abs(dx[:, p] - dq[i, p]), out=low)
        low = _low(low, nq[i] + nx)
        high = (nq[i] + nx - low * low) / 2 * (1 + 1e-9) + 1 + 1e-9 * (nq[i] + nx)
        ok = np.flatnonzero((x_row != q_row[i]) & (high >= least[i]))
        order = ok[np.argsort(-high[ok], kind="stable")]
        best_s, best_at = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(order), STEP):
            take = order[at : at + STEP]
            if len(best_s) == k and best_s[-1] > high[take[0]]:
                break
            s = (x[take] @ q[i]).astype(np.int64)
            best_s, best_at = np.concatenate((best_s, s)), np.concatenate((best_at, take))
            keep = np.lexsort((x_id[best_at], -best_s))[:k]
            best_s, best_at = best_s[keep], best_at[keep]
        out.append((best_at, best_s))
    return out


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist())


def top_k(vectors: DataFrame, modulus: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: the k best candidates of every row whose vec_id is divisible by modulus."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter("vec_id is not null and e is not null and size(e) > 0").filter(fine)
    v = v.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("e"), F.size("e").alias("dim"))
    v = scratch.save(v, "vectors")
    slot = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(PIVOTS))
    pivots = v.groupBy("dim", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("vec_id"), "vec_id", "e")).alias("s")).select("dim", "s.e")  # PIVOTS at most for each length
    held = spark.sparkContext.broadcast({d: _matrix(g["e"]) for d, g in pivots.toPandas().groupby("dim")})

    def measure(batches):
        for b in batches:
            f = b.to_pandas()
            dim, e = f["dim"].to_numpy(), f["e"]
            dist, cell, norm = np.empty(len(f), object), np.empty(len(f), np.int32), np.empty(len(f))
            for n in np.unique(dim):
                at = np.flatnonzero(dim == n)
                x = _matrix(e.iloc[at])
                d = _far(x, held.value[int(n)])
                near = d.argmin(1)
                x = x.astype(np.float64)
                norm[at], cell[at] = (x * x).sum(1), near
                for i, r in zip(at, d, strict=True):
                    dist[i] = r
            own = [d[c] for d, c in zip(dist, cell, strict=True)]
            cols = [b.column(c) for c in ("row", "vec_id", "e", "dim")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(dist), pa.list_(pa.float64())), pa.array(cell), pa.array(own, pa.float64()), pa.array(norm, pa.float64())], ["row", "vec_id", "e", "dim", "dist", "near", "own", "norm"])

    t = v.mapInArrow(measure, "row long, vec_id long, e array<long>, dim int, dist array<double>, near int, own double, norm double")
    t = scratch.save(t, "table")
    # Rings of about SLICE vectors, fewer if that would make more than CELLS cells in all; equal distances share a ring.
    kinds = t.groupBy("dim", "near").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("own", F.lit([i / 64 for i in range(1, 64)]).cast("array<double>"), F.lit(1000)).alias("cuts")).collect()  # PIVOTS for each length
    total = sum(r["n"] for r in kinds)
    size = max(SLICE, math.ceil(2 * total / CELLS))
    cuts = []
    for r in kinds:
        rings = min(64, max(1, r["n"] // size))
        cuts.append((r["dim"], r["near"], sorted({r["cuts"][round(64 * i / rings) - 1] for i in range(1, rings)})))
    cuts = F.broadcast(spark.createDataFrame(cuts, "dim int, near int, cuts array<double>")) if cuts else None
    if cuts is None:
        return t.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"), F.col("row").alias("query_row"))
    t = t.join(cuts, ["dim", "near"]).withColumn("ring", F.size(F.filter("cuts", lambda c: c <= F.col("own")))).drop("cuts")
    least = [F.min(F.get("dist", i)) for i in range(PIVOTS)]
    most = [F.max(F.get("dist", i)) for i in range(PIVOTS)]
    cells = t.groupBy("dim", "near", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.array(*least).alias("lo"), F.array(*most).alias("hi")).collect()  # CELLS at most
    by_dim: dict[int, dict] = {}
    for d in sorted({r["dim"] for r in cells}):
        own = [r for r in cells if r["dim"] == d]
        p = len(held.value[d])
        by_dim[d] = {
            "key": [(r["near"], r["ring"]) for r in own], "slices": np.array([-(-r["n"] // SLICE) for r in own]), "norm": np.array([r["norm"] for r in own]),
            "lo": np.array([r["lo"][:p] for r in own], float), "hi": np.array([r["hi"][:p] for r in own], float),
        }
    plan = spark.sparkContext.broadcast(by_dim)
    sliced = F.broadcast(spark.createDataFrame([(r["dim"], r["near"], r["ring"], -(-r["n"] // SLICE)) for r in cells], "dim int, near int, ring int, slices int"))
    t = t.join(sliced, ["dim", "near", "ring"]).withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
    columns = ["row", "vec_id", "e", "dim", "dist", "near", "ring", "slice"]
    x = scratch.save(t.select(*columns), "sliced")
    # the home slice is dealt by another hash than the vectors are, so that equal queries spread
    q = x.filter(F.col("vec_id") % modulus == 0)
    empty = pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
    shape = "query_row long, query_id long, vec_id long, score long"

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return empty
        rows = _block_top(_matrix(a["e"]), _matrix(b["e"]), a["row"].to_numpy(), b["row"].to_numpy(), b["vec_id"].to_numpy(), _matrix(a["dist"]), _matrix(b["dist"]), a["least"].to_numpy(), k)
        parts = [pd.DataFrame({"query_row": r, "query_id": i, "vec_id": b["vec_id"].to_numpy()[at], "score": s}) for r, i, (at, s) in zip(a["row"], a["vec_id"], rows, strict=True)]
        return pd.concat(parts)

    slice_ = ["dim", "near", "ring", "slice"]
    home = q.withColumn("least", F.lit(-math.inf)).groupBy(*slice_).cogroup(x.groupBy(*slice_)).applyInPandas(work, shape)
    home = scratch.save(home, "home")
    # the k-th best score at home, where there are k
    held_k = home.groupBy("query_row").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("found"))
    ready = q.join(held_k, q["row"] == held_k["query_row"], "left").select(*[q[c] for c in columns], F.when(F.col("found") >= k, F.col("low").cast("double")).otherwise(F.lit(-math.inf)).alias("least"))

    def route(batches):
        """Each query with every slice that may hold a candidate as good as its threshold, its home left out."""
        for b in batches:
            f = b.to_pandas()
            out = []
            for r in f.itertuples():
                c = plan.value[int(r.dim)]
                d, n = np.array(r.dist), float((np.array(r.e, float) ** 2).sum())
                low = _low(np.maximum(np.maximum(c["lo"] - d, d - c["hi"]).max(1), 0), n + c["norm"])
                high = (n + c["norm"] - low * low) / 2 * (1 + 1e-9) + 1 + 1e-9 * (n + c["norm"])
                for j in np.flatnonzero(high >= r.least):
                    near, ring = c["key"][j]
                    out += [(r.row, r.vec_id, r.e, r.dim, r.dist, near, ring, s, r.least) for s in range(int(c["slices"][j])) if (near, ring, s) != (r.near, r.ring, r.slice)]
                if len(out) > 2000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*columns, "least"])

    sent = ready.mapInArrow(route, "row long, vec_id long, e array<long>, dim int, dist array<double>, near int, ring int, slice int, least double")
    n_q = q.count()
    sent = scratch.save(sent.withColumn("block", F.pmod(F.xxhash64("row", F.lit(9)), F.lit(max(1, math.ceil(n_q / QUERY_BLOCK)))).cast("int")), "sent")
    # a slice goes once to each block of queries that asks for it
    asked = x.join(sent.select(*slice_, F.col("block").alias("asker")).distinct(), slice_)
    away = sent.groupBy(*slice_, "block").cogroup(asked.groupBy(*slice_, "asker")).applyInPandas(work, shape)
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    won = home.unionByName(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return won.select("query_id", "rank", "vec_id", "score", "query_row")
