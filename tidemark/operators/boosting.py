"""Boosted trees of depth two on the base blocks, out of fold: Newton steps on histograms, all folds in one pass a round.

Rows are cut into at most 64 bins a column, by quantiles of a fold's own training
rows. Trees of depth two over bins are a table for each pair of columns, so a
score is six look-ups however many trees there are, and the histograms of all
pairs give a tree's root and both its children: a round is one pass over the
binned rows, which are written once in large pieces. Blocks lie in [0, 1]; bins
end at multiples of 1 / GRID.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import shared_dir
from .models import BASE, LEAST_LEAF, _omegas

GRID, BINS = 2**14, 64
CHUNK = 200_000  # binned rows in a piece
BLOCK = 16_384  # rows worked through at a time
FEW = 32  # arrays of a sum that the driver takes
LEAST_HESSIAN = 1e-3
PAIRS = list(combinations(range(len(BASE)), 2))


def _total(x: DataFrame, run, size: int) -> np.ndarray:
    """The sum of the arrays that run(batches) gives in every task; many are summed by tasks first."""

    def summed(made):
        def tasks(batches):
            out = np.zeros(size)
            for v in made(batches):
                out += v
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

        return tasks

    def sent(batches):
        return (np.frombuffer(v) for b in batches for v in b.column(0).to_pylist())

    n, x = x.rdd.getNumPartitions(), x.mapInArrow(summed(run), "v binary")
    while n > FEW:
        n = -(-n // FEW)
        x = x.repartition(n).mapInArrow(summed(sent), "v binary")
    return np.sum([np.frombuffer(r["v"]) for r in x.collect()], 0)


def _cells(b: pa.RecordBatch, at: int) -> np.ndarray:
    """Grid cells of the base columns, which start at a place in the batch."""
    x = np.stack([b.column(at + j).to_numpy(zero_copy_only=False).astype(float, copy=False) for j in range(len(BASE))])
    if not np.isfinite(x).all():
        raise ValueError("null or non-finite inputs")
    return np.clip((x * GRID).astype(np.int64), 0, GRID - 1)


def _bins(counts: np.ndarray) -> np.ndarray:
    """The bin of each cell of a grid, by the quantiles of counted rows."""
    run = np.cumsum(counts)
    edges = np.unique(np.searchsorted(run, run[-1] * np.arange(1, BINS) / BINS))
    return np.searchsorted(edges[edges < GRID - 1], np.arange(GRID)).astype(np.uint32)


def _codes(cells: np.ndarray, bins: np.ndarray) -> np.ndarray:
    out = np.zeros(cells.shape[1], np.uint32)
    for c, table in zip(cells, bins, strict=True):
        out = out << 6 | table[c]
    return out


def _places(code: np.ndarray) -> list[np.ndarray]:
    """The place in each pair's table."""
    one = [(code >> (6 * (len(BASE) - 1 - j)) & 63).astype(np.int64) for j in range(len(BASE))]
    high = [b << 6 for b in one]
    return [high[i] | one[j] for i, j in PAIRS]


def _score(tables: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    return sum(t.take(i) for t, i in zip(tables, places, strict=True))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, l2: float) -> tuple[float, int, tuple[float, float]] | None:
    """Gain, last bin on the left, and the steps of both sides, for sums by bin; none where no split gains."""
    gl, hl, nl = (np.cumsum(x)[:-1] for x in (g, h, n))
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
    gain[(nl < least) | (nr < least) | (hl < LEAST_HESSIAN) | (hr < LEAST_HESSIAN)] = 0.0
    s = int(np.argmax(gain))
    return (float(gain[s]), s, (-gl[s] / (hl[s] + l2), -gr[s] / (hr[s] + l2))) if gain[s] > 0 else None


def grow(tables: np.ndarray, sums: np.ndarray, least: int, step: float, l2: float) -> None:
    """Adds the tree of sums (gradient, Hessian and rows; by pair, bin and bin) to the tables of pairs."""
    columns = range(len(BASE))

    def of(x: np.ndarray, f: int, c: int) -> np.ndarray:
        """By bins of f and c: a view."""
        return x[PAIRS.index((f, c))] if f < c else x[PAIRS.index((c, f))].T

    def best(f: int, inside: np.ndarray):
        """The best split of the rows in some bins of f: with its column."""
        found = None
        for c in columns:
            other = (f + 1) % len(BASE) if c == f else c
            three = [of(x, f, other)[inside].sum(0) if c != f else of(x, f, other).sum(1) * inside for x in sums]
            got = _split(*three, least, l2)
            if got and (found is None or got[0] > found[0]):
                found = (*got, c)
        return found

    def add(f: int, inside: np.ndarray, c: int, values: np.ndarray) -> None:
        if c == f:
            of(tables, f, (f + 1) % len(BASE))[inside] += values[inside][:, None]
        else:
            of(tables, f, c)[inside] += values[None]

    every = np.ones(BINS, bool)
    root = best(0, every)
    if root is None:
        g, h = sums[0, 0].sum(), sums[1, 0].sum()
        add(0, every, 0, np.full(BINS, -step * g / (h + l2)))
        return
    _, s, sides, f = root
    for side, inside in enumerate((np.arange(BINS) <= s, np.arange(BINS) > s)):
        child = best(f, inside)
        if child is None:
            add(f, inside, f, np.full(BINS, step * sides[side]))
        else:
            add(f, inside, child[3], step * np.where(np.arange(BINS) <= child[1], *child[2]))


def boosted(df: DataFrame, folds: int = 5, rounds: int = 100, step: float = 0.05, least: int = LEAST_LEAF, l2: float = 0.01) -> DataFrame:
    """df's rows of the folds, with prediction: each fold by trees grown on the others."""
    spark = df.sparkSession
    x = df.filter(F.col("fold").isNotNull()).select(F.col("fold").cast("int").alias("fold"), F.col("t").cast("int").alias("t"), F.col("target").cast("int").alias("target"), *BASE)
    omega = _omegas(x, list(range(folds)))
    sent = spark.sparkContext.broadcast(omega.reshape(folds, -1))
    few = max(2 * spark.sparkContext.defaultParallelism, 1)

    def keys(b):
        fold, t, y = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        return np.where((fold >= 0) & (fold < folds), fold, folds), 2 * t + y

    def counts(batches):
        for b in batches:
            (fold, at), cells = keys(b), _cells(b, 3)
            out = np.zeros((folds, len(BASE), GRID))
            for k in range(folds):
                on = (fold != k) & (sent.value[k][at] > 0)
                for j, c in enumerate(cells):
                    out[k, j] = np.bincount(c[on], minlength=GRID)
            yield out.ravel()

    grid = _total(x.coalesce(few), counts, folds * len(BASE) * GRID).reshape(folds, len(BASE), GRID)
    bins = spark.sparkContext.broadcast(np.stack([[_bins(c) for c in own] for own in grid]))

    def pieces(batches):
        """Of CHUNK rows each: places of the folds, then ages and classes, then codes for each fold left out."""
        rest, n = [], 0
        for b in batches:
            fold, at = keys(b)
            cells = _cells(b, 3)
            rest.append((fold, at, *[_codes(cells, bins.value[k]) for k in range(folds)]))
            n += len(fold)
            if n >= CHUNK:
                yield piece(rest)
                rest, n = [], 0
        if n:
            yield piece(rest)

    def piece(rest):
        fold, at, *codes = (np.concatenate(v) for v in zip(*rest, strict=True))
        order = np.argsort(fold, kind="stable")
        ends = np.searchsorted(fold[order], np.arange(folds + 2)).astype(np.uint32)
        whole = np.concatenate([ends, at[order].astype(np.uint32), *[c[order] for c in codes]])
        return pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["v"])

    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/bins"
    x.mapInArrow(pieces, "v binary").write.option("compression", "lz4").parquet(path)
    binned = spark.read.parquet(path).coalesce(few)
    shape = (folds, 2, len(PAIRS), BINS * BINS)

    def trained(v: bytes):
        """k, code, age and class of the rows that train without fold k."""
        whole = np.frombuffer(v, np.uint32)
        ends, rows = whole[: folds + 2].astype(np.int64), whole[folds + 2 :].reshape(folds + 1, -1)
        for k in range(folds):
            yield k, *(np.concatenate((r[: ends[k]], r[ends[k + 1] :])) for r in (rows[k + 1], rows[0]))

    def passed(tables):
        def run(batches):
            for b in batches:
                for v in b.column(0):
                    out = np.zeros(shape)
                    for k, codes, ats in trained(v.as_py()):
                        for a in range(0, len(codes), BLOCK):
                            at, places = ats[a : a + BLOCK], _places(codes[a : a + BLOCK])
                            w = sent.value[k].take(at)
                            if tables is None:  # rows that count
                                made = [(w > 0).astype(float)]
                            else:
                                p = 1 / (1 + np.exp(-_score(tables.value[k], places)))
                                made = [w * (p - (at & 1)), w * p * (1 - p)]
                            for i, m in enumerate(made):
                                for j, place in enumerate(places):
                                    out[k, i, j] += np.bincount(place, m, BINS * BINS)
                    yield out.ravel()

        return _total(binned, run, int(np.prod(shape))).reshape(folds, 2, len(PAIRS), BINS, BINS)

    rows = passed(None)[:, :1]
    tables = np.zeros((folds, len(PAIRS), BINS, BINS))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(tables.reshape(folds, len(PAIRS), -1))
        sums = np.concatenate((passed(now), rows), 1)
        now.destroy()
        for k in range(folds):
            grow(tables[k], sums[k], least, step, l2)
    last = spark.sparkContext.broadcast(tables.reshape(folds, len(PAIRS), -1))
    keep = [c for c in df.columns if c != "prediction"]
    x = df.filter(F.col("fold").between(0, folds - 1)).select(*keep)
    first = len(keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)

    def predicted(batches):
        for b in batches:
            fold, cells = b.column(first).to_numpy(zero_copy_only=False), _cells(b, first + 1)
            out = np.zeros(len(fold))
            for k in range(folds):
                on = np.flatnonzero(fold == k)
                out[on] = 1 / (1 + np.exp(-_score(last.value[k], _places(_codes(cells[:, on], bins.value[k])))))
            yield pa.RecordBatch.from_arrays([*b.columns[:first], pa.array(out)], [*keep, "prediction"])

    return x.select("*", F.col("fold").cast("int").alias("_fold"), *[F.col(c).cast("double").alias(f"_{c}") for c in BASE]).mapInArrow(predicted, f"{kinds}, prediction double")
