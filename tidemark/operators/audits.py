"""Audits: what must come out the same by two ways, and what the frozen references look like."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.causal import series
from . import blocks, integrity, models, profile

LEVELS = {"min": 0.0, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}


def spread(df: DataFrame, column: str, *by: str) -> DataFrame:
    """p50, p95 and max of a column, by groups."""
    q = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95))).alias("q")
    return df.groupBy(*by).agg(q, F.max(column).alias("max")).select(*by, F.get("q", 0).alias("p50"), F.get("q", 1).alias("p95"), "max")


def agreement(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """component, rows, unmatched, differing: how far two frames agree, exactly, column by column."""
    a = left.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(1).alias("_a"))
    b = right.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(1).alias("_b"))
    j = a.join(b, keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    one = j.agg(F.count(F.lit(1)).alias("rows"), n(lone).alias("unmatched"), *[n(~lone & integrity.differs(F.col(f"{c}_a"), F.col(f"{c}_b"))).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("differing")) for c in columns])).alias("x")
    return one.select("rows", "unmatched", each).select("x.component", "rows", "unmatched", "x.differing")


def components(frame: DataFrame) -> DataFrame:
    """Whether the base blocks made together are, value by value, those that are made one at a time."""
    together = blocks.features(frame, only=("r", "i", "p", "d"))
    out = None
    for b in ("r", "i", "p", "d"):
        x = agreement(together, blocks.features(frame, only=(b,)), ["id", "t"], [f"blk_{b}"])
        out = x if out is None else out.unionByName(x)
    return out


PIECES = 4096  # of a column's range, to find the piece a rank is in


def quantiles(df: DataFrame, spans: dict[str, tuple[int, float | None, float | None]], levels: list[float]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of finite columns, nulls aside. spans: column -> (values, least, greatest).

    Values are counted in PIECES of each range; only those of the pieces that hold
    a wanted rank are put in order. Percentile aggregates hold every distinct value in one task.
    """
    ranks = {c: sorted({r for q in levels for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}) for c, (n, lo, hi) in spans.items() if n and lo < hi}
    names = list(ranks)

    def piece(c: str) -> Column:
        _, lo, hi = spans[c]
        inside = F.greatest(F.lit(0), F.least(F.lit(PIECES - 1), F.floor((F.col(c) - lo) / (hi - lo) * PIECES))).cast("int")
        return F.when(F.col(c).isNotNull(), inside)

    found: dict[tuple[str, int], float] = {}
    if names:
        x = df.select(*names, *[piece(c).alias(f"_b{i}") for i, c in enumerate(names)])

        def count(batches):
            n = np.zeros((len(names), PIECES), np.int64)
            for b in batches:
                for i in range(len(names)):
                    n[i] += np.bincount(b.column(i).drop_null().to_numpy(zero_copy_only=False), minlength=PIECES)
            i, p = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(n[i, p])], ["c", "piece", "n"])

        counts = x.select(*[f"_b{i}" for i in range(len(names))]).mapInArrow(count, "c int, piece int, n long").groupBy("c", "piece").agg(F.sum("n").alias("n")).toPandas()
        wanted, before = {}, {}
        for i, c in enumerate(names):
            own = np.bincount(counts["piece"][counts["c"] == i], counts["n"][counts["c"] == i], PIECES).astype(np.int64)
            upto = np.cumsum(own)
            wanted[c] = sorted({int(np.searchsorted(upto, r, "right")) for r in ranks[c]})
            before |= {(i, p): int(upto[p] - own[p]) for p in wanted[c]}
        each = [F.when(F.col(f"_b{i}").isin(wanted[c]), F.struct(F.lit(i).alias("c"), F.col(f"_b{i}").alias("piece"), F.col(c).cast("double").alias("v"))) for i, c in enumerate(names)]
        ties = x.select(F.explode(F.filter(F.array(*each), lambda s: s.isNotNull())).alias("s")).groupBy("s.c", "s.piece", "s.v").agg(F.count(F.lit(1)).alias("n"))
        start = F.create_map(*[y for k, v in before.items() for y in (F.lit(k[0] * PIECES + k[1]), F.lit(v))])
        end = F.sum("n").over(W.partitionBy("c", "piece").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.try_element_at(start, F.col("c") * PIECES + F.col("piece"))
        at = F.create_map(*[y for i, c in enumerate(names) for y in (F.lit(i), F.array(*[F.lit(r) for r in ranks[c]]))])
        hits = ties.withColumn("end", end).select("c", "v", F.explode(F.filter(F.try_element_at(at, F.col("c")), lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))).alias("rank"))
        found = {(names[r["c"]], r["rank"]): r["v"] for r in hits.collect()}

    def level(c: str, q: float) -> float | None:
        n, lo, _ = spans[c]
        if c not in ranks:
            return lo
        at = q * (n - 1)
        a, b = math.floor(at), math.ceil(at)
        return found[c, a] if a == b else (b - at) * found[c, a] + (at - a) * found[c, b]

    return {c: [level(c, q) for q in levels] for c in spans}


def extensions(df: DataFrame, against: dict[str, tuple[str, ...]]) -> DataFrame:
    """extension, against, seven quantiles of the extension and its plain correlation with the other; null where either is constant."""
    aggs = {}
    for e, others in against.items():
        aggs |= {f"n_{e}": F.count(e), f"lo_{e}": F.min(e), f"hi_{e}": F.max(e)}
        for o in others:
            aggs[f"r_{e}_{o}"] = F.when((F.min(e) < F.max(e)) & (F.min(o) < F.max(o)), F.corr(e, o))
    one = df.agg(*[v.alias(k) for k, v in aggs.items()]).first()
    q = quantiles(df, {e: (one[f"n_{e}"], one[f"lo_{e}"], one[f"hi_{e}"]) for e in against}, list(LEVELS.values()))
    rows = [(e, o, *q[e], one[f"r_{e}_{o}"]) for e, others in against.items() for o in others]
    return df.sparkSession.createDataFrame(rows, "extension string, against string, " + ", ".join(f"`{n}` double" for n in LEVELS) + ", correlation double")


def squared_dependence(frame: DataFrame) -> DataFrame:
    """By series: lag-one correlation of squared innovations over C before and after each scale divides them, and the group of the former.

    The groups are unsupported (no correlation), le0.1 and gt0.1.
    """
    d = blocks.scales(blocks.innovation(blocks.autoregression(frame)), list(blocks.SCALES)).filter(blocks.ref_rows())
    values = {"before": F.col("r") * F.col("r"), **{f"after_{k}": F.pow(f"a_{k}", 2) for k in blocks.SCALES}}
    d = d.select("id", "k", *[v.alias(n) for n, v in values.items()])
    d = d.withColumns({f"_{n}": F.lag(n).over(series().orderBy("k")) for n in values})

    def corr(n: str):
        x, y = F.col(f"_{n}"), F.when(F.col(f"_{n}").isNotNull(), F.col(n))
        return F.when(F.count(x) >= 4, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))).alias(n)

    g = d.groupBy("id").agg(*[corr(n) for n in values])
    group = F.when(F.col("before").isNull(), "unsupported").when(F.col("before") <= 0.1, "le0.1").otherwise("gt0.1")
    return g.withColumn("context", group)


def reference_table(frame: DataFrame) -> DataFrame:
    """By series, over C: its size, the range of the standardised innovations, and mean, spread and variance of their normal scores, and the long-run factor."""
    d = blocks.long_run_factor(blocks.normal_scores(blocks.scales(blocks.innovation(blocks.autoregression(frame)), ["s"]))).filter(blocks.ref_rows())
    return d.groupBy("id").agg(
        F.count("nz").alias("c_rows"), F.min("u_s").alias("u_min"), F.max("u_s").alias("u_max"), F.avg("nz").alias("z_mean"), F.stddev_samp("nz").alias("z_sd"),
        F.first("nz_v0").alias("v0"), F.first("hac_eta").alias("eta"),
    )


def reference_distributions(frame: DataFrame) -> DataFrame:
    return profile.distribution(reference_table(frame), ["c_rows", "u_min", "u_max", "z_mean", "z_sd", "v0", "eta"])


def scale_replay(frame: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """id, rows, mismatches: the slow scale of every row from its plain recursion, step by step, against the closed form."""
    d = blocks.scales(blocks.innovation(blocks.autoregression(frame)), ["s"])
    fit = blocks.fit_rows() & (F.col("k") >= blocks.ORDER)
    d = d.select("id", "k", "e", "v_s", F.greatest(F.avg(F.when(fit, F.col("e") * F.col("e"))).over(series()), F.lit(1e-16)).alias("b0")).filter(F.col("k") >= blocks.ORDER)
    share, kind = blocks.SCALES["s"][0], dict(d.dtypes)["id"]

    def replay(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        h, b0, bad = pdf["b0"].iloc[0], pdf["b0"].iloc[0], 0
        for e, v in zip(pdf["e"].to_numpy(), pdf["v_s"].to_numpy(), strict=True):
            bad += abs(max(h, 1e-16, 1e-4 * b0) - v) > tolerance * v
            h = (1 - share) * h + share * e * e
        return pd.DataFrame({"id": [key[0]], "rows": [len(pdf)], "mismatches": [bad]})

    return d.groupBy("id").applyInPandas(replay, f"id {kind}, rows long, mismatches long")


def null_levels(frame: DataFrame) -> DataFrame:
    """feature, rows, seven quantiles and the shares at 0 (to nine decimals), at 1 and from 0.99 on, of the blocks of C itself."""
    names = [*blocks.MOMENTS, "l_plus", "l_minus", "c_plus", "c_minus"]
    long = blocks.historical_null(frame).select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("feature", "x"))
    share = lambda c: F.avg(c.cast("double"))
    q = F.percentile("x", F.array(*[F.lit(v) for v in LEVELS.values()])).alias("q")
    x = F.col("x")
    g = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), q, share(x <= 1e-9).alias("at_zero"), share(x == 1).alias("at_one"), share(x >= 0.99).alias("ge_099"))
    return g.select("feature", "rows", *[F.get("q", i).alias(n) for i, n in enumerate(LEVELS)], "at_zero", "at_one", "ge_099")


def embedded(parent: dict, child: str, extra: dict[str, tuple[float, float]]) -> dict:
    """The parent as a model of the child experiment: what the child adds has slope 0."""
    return parent | {"experiment": child, "extra": extra, "slopes": {k: parent["slopes"].get(k, 0.0) for k in models.inputs(child)}}


def nesting(df: DataFrame, parent: dict, children: list[str], tolerance: float = 1e-14) -> DataFrame:
    """child, parent, rows, differing: predictions of the parent and of itself embedded in each child; none may differ."""
    x = models.predict(df, parent, "_parent")
    for c in children:
        x = models.predict(x, embedded(parent, c, {n: (0.0, 1.0) for n in models.EXTRAS[c]}), f"_in_{c}")
    n = [F.count(F.when(F.abs(F.col(f"_in_{c}") - F.col("_parent")) > tolerance, 1)).alias(c) for c in children]
    one = x.agg(F.count(F.lit(1)).alias("rows"), *n)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("child"), F.lit(parent["experiment"]).alias("parent"), F.col("rows"), F.col(c).alias("differing")) for c in children])).alias("x")
    return one.select(each).select("x.*")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined to right on keys that both hold exactly once; anything else is an error."""
    twice = integrity.duplicates(left, *keys).limit(1).count() + integrity.duplicates(right, *keys).limit(1).count()
    lone = left.join(right, keys, "left_anti").limit(1).count() + right.join(left, keys, "left_anti").limit(1).count()
    if twice or lone:
        raise ValueError("keys repeat" if twice else "keys without a partner")
    return left.join(right, keys)


def attach(spark: SparkSession, folder: str, names: list[str], prefix: str) -> None:
    """Read-only temporary views <prefix><name> over the tables of a folder."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(f"{prefix}{n}")


def interval(values: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    a = (1 - level) / 2
    return float(np.quantile(values, a)), float(np.quantile(values, 1 - a))
